"""Operator 9: quality rules under weak supervision.

Rules look at a text's counts and each votes: against it, mildly against it, for it, or it abstains.
A bad text as a rule has one fault, which one rule sees while the others speak for it; votes are
independent only among texts with the same fault.  So the model has a class of good texts and one
class for each rule's fault.  Expectation-maximisation over the table of vote patterns estimates how
often each rule votes each way in each class, starting from rules that are all taken to be equally
accurate; what they are taken for counts as ``TRUST`` times all texts.  A text stays where its
posterior probability of being good is at least one half: a mild vote against it is overruled where
the estimation finds that such votes meet good texts, and one vote against six may reject it.  Texts
that fail the base rules go whatever the votes.

All of it is DataFrame functions.  A text is read once; its counts are written, and each round of
the estimation is one aggregation over the vote patterns, at most 4 ** 7 of them, whose posteriors
are then looked up.

Defined results: a null or blank text has no words and fails; repeated rows each keep their row;
other columns pass through ``filter_quality``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import materialise, only_spaces_apart, whole_text, without_spaces

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 40


def _count_of(characters: str) -> Column:
    """How many of the characters stand in _text."""
    left = F.col("_text")
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length("_text") - F.length(left)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with the counts that the rules look at."""
    step = docs.select(*keep, whole_text().alias("_text"))
    flat = only_spaces_apart(F.col("_text"))
    step = step.withColumn("_one", F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")
    step = step.select(
        *keep,
        F.size("_one").cast("long").alias("n_words"),
        F.length(without_spaces(F.col("_text"))).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).cast("long").alias("n_symbols"),
        _count_of("!").cast("long").alias("n_exclaims"),
        F.size(F.array_distinct("_one")).cast("long").alias("n_distinct"),
        lines.alias("_lines"),
        "_one",
    )
    step = step.withColumn("n_lines", F.size("_lines").cast("long"))
    step = step.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines"))).drop("_lines")
    # hashes of windows of 1, 2, 4 and 8 words, each from two of the one before
    name, width = "_one", 1
    while width < WINDOW:
        wider = f"_w{2 * width}"
        step = step.withColumn(
            wider,
            F.expr(
                f"zip_with(slice({name}, 1, greatest(size({name}) - {width}, 0)), "
                f"slice({name}, {width + 1}, greatest(size({name}) - {width}, 0)), (a, b) -> xxhash64(a, b))"
            ),
        ).drop(name)
        name, width = wider, 2 * width
    # texts with a repeated window are few; only they sort theirs
    step = step.withColumn(
        "_sorted",
        F.expr(
            f"CASE WHEN size(array_distinct({name})) < size({name}) "
            f"THEN sort_array(transform({name}, (x, i) -> struct(x AS h, i AS i))) END"
        ),
    ).drop(name)
    step = step.withColumn(
        "_again",
        F.expr(
            "sort_array(transform(filter(_sorted, (v, k) -> v.h <=> get(_sorted, k - 1).h OR v.h <=> get(_sorted, k + 1).h), v -> v.i))"
        ),
    ).drop("_sorted")
    covered = F.expr(
        f"aggregate(_again, struct(-{WINDOW} AS last, 0 AS n), (s, i) -> struct(i AS last, s.n + least({WINDOW}, i - s.last) AS n), s -> s.n)"
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_again")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column, Column]]:
    """For each rule when it votes against a text, when mildly against it, and when for it; else it abstains."""
    n = F.col("n_words")
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    per_hundred = lambda count, of=n: 100 * F.col(count) / F.greatest(of, F.lit(1))
    lines, repeats = per_hundred("n_dup_lines", F.col("n_lines")), per_hundred("n_repeat_words")
    symbols, exclaims, variety = per_hundred("n_symbols"), per_hundred("n_exclaims"), per_hundred("n_distinct")
    some = n >= 20
    return {
        "length": (n < 20, F.lit(False), n >= 50),
        "repeats": (repeats > 30, repeats > 10, some & (repeats <= 2)),
        "symbols": (symbols > 15, symbols > 3, symbols <= 1),
        "word_length": ((mean < 2.5) | (mean > 12), (mean < 3.5) | (mean > 9), mean.between(4, 7)),
        "lines": ((F.col("n_dup_lines") >= 3) & (lines > 30), lines > 15, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 4)),
        "exclaims": (exclaims > 30, exclaims > 5, exclaims <= 1),
        "variety": (some & (variety < 25), some & (variety < 45), some & (variety >= 55)),
    }


#: The votes by their number, and the chances of each that a rule is taken for at the start:
#: on good texts, on texts with another rule's fault, on texts with its own.
VOTES = ("against", "mildly against", "abstains", "for")
ON_GOOD, ON_OTHER, ON_OWN = (0.01, 0.04, 0.25, 0.70), (0.03, 0.10, 0.27, 0.60), (0.80, 0.12, 0.05, 0.03)
GOOD = 0.9
TRUST = 0.01


def pattern() -> Column:
    """The votes of all rules as one number, two bits to a vote."""
    total = F.lit(0)
    for k, (against, mildly, favour) in enumerate(rules().values()):
        vote = F.when(against, 0).when(mildly, 1).when(favour, 3).otherwise(2)
        total = total + F.shiftleft(vote, 2 * k)
    return total.cast("int")


def _let(x: Column, use) -> Column:
    """use(x) with x evaluated once: column expressions share nothing by themselves."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


class Rates:
    """The model: the share of each class and each rule's chances of each vote in it; class 0 is good."""

    def __init__(self):
        names = list(rules())
        self.rules, self.classes = len(names), len(names) + 1
        self.share = [GOOD] + [(1 - GOOD) / self.rules] * self.rules
        self.chance = [[list(ON_GOOD)] * self.rules]
        for fault in range(self.rules):
            self.chance.append([list(ON_OWN if k == fault else ON_OTHER) for k in range(self.rules)])

    def posteriors(self) -> Column:
        """For a row with pattern the probability of each class.

        The rates go in as one text, which is read once into an array.
        """
        flat = [math.log(s) for s in self.share]
        flat += [math.log(x) for own in self.chance for rule in own for x in rule]
        held = F.split(F.lit(",".join(map(repr, flat))), ",").cast("array<double>")
        rules = F.sequence(F.lit(0), F.lit(self.rules - 1))
        votes = F.array(*[F.shiftright("pattern", 2 * k).bitwiseAND(F.lit(3)) for k in range(self.rules)])

        def score(c):
            first = self.classes + 4 * self.rules * c
            return F.aggregate(rules, F.get(held, c), lambda total, k: total + F.get(held, first + 4 * k + F.get(votes, k)))

        scores = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), score)
        weights = _let(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        return _let(weights, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda t, y: t + y)))

    def updated(self, patterns: DataFrame) -> Rates:
        """The rates after one round; patterns: a row for each pattern with its count n."""
        first = Rates()
        each = patterns.select("n", self.posteriors().alias("g"), F.col("pattern"))
        votes = F.expr(f"explode(transform(sequence(0, {self.rules - 1}), k -> 4 * k + (shiftright(pattern, 2 * k) & 3)))")
        sums = each.select("n", "g", votes.alias("vote")).groupBy("vote")
        sums = sums.agg(*[F.sum(F.col("n") * F.get("g", F.lit(c))).alias(f"c{c}") for c in range(self.classes)])
        found = {row["vote"]: [row[f"c{c}"] for c in range(self.classes)] for row in sums.collect()}
        nothing = [0.0] * self.classes
        mass = [sum(found.get(v, nothing)[c] for v in range(4)) for c in range(self.classes)]
        trust = TRUST * max(1.0, sum(mass))
        new = Rates()
        new.share = [(mass[c] + trust * first.share[c]) / (sum(mass) + trust) for c in range(self.classes)]
        new.chance = [
            [
                [(found.get(4 * k + v, nothing)[c] + trust * first.chance[c][k][v]) / (mass[c] + trust) for v in range(4)]
                for k in range(self.rules)
            ]
            for c in range(self.classes)
        ]
        return new

    def apart(self, other: Rates) -> float:
        pairs = zip(self.chance, other.chance)
        return max(abs(x - y) for a, b in pairs for p, q in zip(a, b) for x, y in zip(p, q))


def estimate(patterns: DataFrame) -> Rates:
    """Rates by expectation-maximisation; patterns: a row for each pattern of votes with its count n."""
    rates = Rates()
    for _ in range(ROUNDS):
        before, rates = rates, rates.updated(patterns)
        if rates.apart(before) < 1e-3:
            break
    return rates


def with_posterior(voted: DataFrame) -> DataFrame:
    """voted with the posterior of its pattern; there are at most 4 ** 7 patterns."""
    counts = materialise(voted.groupBy("pattern").agg(F.count("*").alias("n")), "quality-patterns").coalesce(1)
    known = counts.select("pattern", F.get(estimate(counts).posteriors(), F.lit(0)).alias("posterior"))
    return voted.join(F.broadcast(known), "pattern")


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, the counts, the pattern of votes, base_failed, posterior and kept."""
    voted = materialise(measure(docs, keep).withColumn("pattern", pattern()), "quality-votes")
    judged = with_posterior(voted).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept.  Rows are written once with their votes; no text is shuffled."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    voted = measure(held, ["_row"]).select("_row", base_failed().alias("_failed"), pattern().alias("pattern"))
    kept = with_posterior(materialise(voted, "quality-votes")).where(~F.col("_failed") & (F.col("posterior") >= 0.5))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
