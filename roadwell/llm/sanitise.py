"""Operator 7: personal data, with information-theoretic sanitisation.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  What is protected
are those values, that a text holds one of a kind, and that it holds any: the entities.  Terms of an
entity's documents may give it away although they match no pattern.  How much a term t discloses of an
entity e is their pointwise mutual information over the corpus's documents, against the information
of e itself:

    PMI(e; t) = log2(P(e, t) / (P(e) P(t))),   IC(e) = -log2 P(e).

A term that never occurs without e has PMI = IC.  Terms whose PMI with an entity reaches ``DISCLOSURE``
times IC and which have e in at least half of their documents exceed the threshold, if that is more
than chance: n documents of t of which a share p holds e, where the corpus has a share q, speak with

    n * (p log2(p / q) + (1 - p) log2((1 - p) / (1 - q)))

bits for it, and they must outweigh the number of pairs (e, t) there could be by ``CHANCE``.  Copies of
one text speak once.  Such terms are generalised wherever they occur, also in documents without e.

All of it is DataFrame functions.  A text's terms are its words between white space without the
punctuation around them, in every step the same.  Counts of pairs and of terms are combined before
they are shuffled, as hashes; texts are read where they lie.

Defined results: a null text is empty and has no spans; a null doc_id keeps its row; repeated rows
each keep their row and count as one text of evidence; other columns pass through
``sanitise``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadwell.llm.shared import drop, materialise, only_spaces_apart, whole_text

DISCLOSURE = 0.8
#: Terms that may be told wrongly over the whole corpus, on average.
CHANCE = 0.01
#: Told terms that are looked up in each text as a list; more of them are joined.
LISTED = 10_000
#: Values that the inner step of a running sum takes.
RUN = 128
#: A word that is a term: three letters or more, without the punctuation around it.
TERM = r"^[^\p{L}\p{N}]*+([\p{L}'-]{3,})[^\p{L}\p{N}]*+$"
NO_SPANS = "cast(array() as array<struct<start: int, kind: int, stop: int>>)"
KINDS = ("email", "ip", "card", "phone", "term")

#: The base patterns, written so that no start is tried twice: a match may begin where the one
#: before it ended (\G) or where no character of its first class stands before.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _luhn(digits: Column) -> Column:
    def add(total, at):
        digit = F.substring(digits, -at, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 1, digit).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_card(match: Column) -> Column:
    length = F.length(_digits(match))
    return F.when(length.between(14, 19), _luhn(_digits(match))).otherwise(False)


def _let(x: Column, use) -> Column:
    """use(x) with x evaluated once: column expressions share nothing by themselves."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _running(values: Column, step) -> Column:
    """For each of an array's numbers what step (a sum, a maximum) makes of 0 and those before it.

    Two levels: an array grows by at most RUN values where they are met and by one for each RUN of
    them above, so long arrays take no square of their length.
    """

    def grow(state, value):
        return F.struct(step(state["t"], value).alias("t"), F.concat(state["out"], F.array(state["t"])).alias("out"))

    start = F.struct(F.lit(0).alias("t"), F.expr("cast(array() as array<int>)").alias("out"))

    def cut(held):
        last = F.greatest(F.ceil(F.size(held) / RUN).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(held, k * RUN + 1, RUN), start, grow))

    def join(runs):
        bases = F.aggregate(runs, start, lambda state, run: grow(state, run["t"]), lambda state: state["out"])
        return F.flatten(F.zip_with(runs, bases, lambda run, base: F.transform(run["out"], lambda v: step(base, v))))

    return _let(values, lambda held: _let(cut(held), join))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, kind: int, valid, present: Column) -> Column:
    """Spans (start, kind, stop) of the pattern's valid matches, in code points from 0."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    gaps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def span(g, at):
        start = at + g["gap"]
        return F.struct(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(g["m"])).alias("stop")).alias("span"), g["m"].alias("m"))

    def placed(held):
        before = _running(F.transform(held, lambda g: g["gap"] + F.length(g["m"])), _add)
        return F.transform(F.filter(F.zip_with(held, before, span), lambda x: valid(x["m"])), lambda x: x["span"])

    return F.when(present, _let(gaps, placed)).otherwise(F.expr(NO_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    always = lambda m: F.lit(True)
    found = F.concat(
        _spans(text, EMAIL, 0, always, F.contains(text, F.lit("@"))),
        _spans(text, IP, 1, lambda m: m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"), text.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        _spans(text, CARD, 2, _is_card, text.rlike("[0-9](?:[ -]?[0-9]){13}")),
        _spans(text, PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15), F.contains(text, F.lit("+"))),
    )
    return F.sort_array(found)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def _split(text: Column) -> Column:
    return F.split(only_spaces_apart(text), " ")


def _term(word: Column) -> Column:
    """The word's term, empty where it has none."""
    return F.regexp_extract(word, TERM, 1)


def _hash(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def terms(text: Column) -> Column:
    """The hashes of a text's different terms."""
    found = F.filter(F.transform(F.array_distinct(_split(text)), _term), lambda t: t != "")
    return F.array_distinct(F.transform(found, _hash))


#: Entities that are no value: a text holds personal data of this kind (as in KINDS), or any.
CLASSES = 5


def _entities(text: Column, base: Column) -> Column:
    """The different entities of a text, as hashes: its values and the classes they are of."""

    def value(s):
        return F.xxhash64(F.concat(s["kind"].cast("string"), F.lower(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))))

    classes = F.concat(F.transform(base, lambda s: s["kind"].cast("long")), F.array(F.lit(CLASSES - 1).cast("long")))
    return F.when(F.size(base) > 0, F.array_distinct(F.concat(classes, F.transform(base, value)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, its base spans, its entities, and its terms where it has any of those."""
    step = docs.select("doc_id", whole_text().alias("_text"))
    step = step.select("doc_id", F.xxhash64("_text").alias("text_hash"), base_spans(F.col("_text")).alias("base"), "_text")
    own = F.when(F.size("base") > 0, terms(F.col("_text")))
    return step.select("doc_id", "text_hash", "base", _entities(F.col("_text"), F.col("base")).alias("entities"), own.alias("terms"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term of the corpus stands."""
    return docs.select(F.explode(terms(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The terms that disclose an entity."""
    total = found.count()
    held = found.where("size(entities) > 0").groupBy("text_hash")
    held = held.agg(F.count("*").alias("rows"), F.any_value("entities").alias("entities"), F.any_value("terms").alias("terms"))
    held = materialise(held, "sanitise-held")
    each = held.select("text_hash", "rows", F.explode("entities").alias("entity"))
    # what stands in one text alone co-occurs with all of it
    known = each.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count("*").alias("texts"))
    known = materialise(known.where("texts >= 2").drop("texts"), "sanitise-known")
    each = each.join(known.select("entity"), "entity").groupBy("text_hash").agg(F.collect_list("entity").alias("entities"))
    pairs = held.drop("entities").join(each, "text_hash").select("rows", "entities", F.explode("terms").alias("term"))
    pairs = pairs.select("rows", "term", F.explode("entities").alias("entity")).groupBy("entity", "term")
    pairs = pairs.agg(F.sum("rows").alias("both"), F.count("*").alias("texts")).where("texts >= 2")
    counts = materialise(term_counts(docs), "sanitise-counts")
    possible = max(1, known.count()) * max(1, counts.count())
    counted = pairs.join(counts, "term").join(known, "entity")
    q, p = F.col("n_entity") / F.lit(float(total)), F.col("both") / F.col("n")
    information = -F.log2(q)
    rest = F.when(p < 1, (1 - p) * F.log2((1 - p) / (1 - q))).otherwise(0.0)
    # the rows that speak are as many as their different texts
    bits = F.col("n") * F.col("texts") / F.col("both") * (p * F.log2(p / q) + rest)
    told = (q < 1) & (F.log2(p / q) >= DISCLOSURE * information) & (2 * F.col("both") >= F.col("n"))
    found = materialise(counted.where(told & (bits >= math.log2(possible / CHANCE))).select("term").distinct(), "sanitise-told")
    for used in (held, known, counts):
        drop(used)
    return found


def _term_spans(text: Column, is_told) -> Column:
    """Spans of every occurrence of the told terms; is_told looks a term's hash up."""
    parts = F.transform(_split(text), lambda w: F.struct(w.alias("word"), _term(w).alias("term")))

    def span(part, at):
        # no letter stands before a term in its word
        start = at + F.instr(part["word"], part["term"]) - 1
        return F.struct(part["term"].alias("term"), F.struct(start.alias("start"), F.lit(4).alias("kind"), (start + F.length(part["term"])).alias("stop")).alias("span"))

    def placed(held):
        before = _running(F.transform(held, lambda p: F.length(p["word"]) + 1), _add)
        found = F.filter(F.zip_with(held, before, span), lambda x: (x["term"] != "") & is_told(_hash(x["term"])))
        return F.transform(found, lambda x: x["span"])

    return _let(parts, placed)


def told_terms(docs: DataFrame, told: DataFrame) -> DataFrame | list[int]:
    """The told terms as a list, or by text where they are many: (text_hash, told)."""
    if told.count() <= LISTED:
        return sorted(row["term"] for row in told.collect())
    texts = docs.select(F.xxhash64(whole_text()).alias("text_hash"), F.explode(terms(whole_text())).alias("term"))
    return materialise(texts.join(told, "term").groupBy("text_hash").agg(F.collect_set("term").alias("told")), "sanitise-hits")


def with_term_spans(rows: DataFrame, told: DataFrame | list[int]) -> DataFrame:
    """rows (with _text and base) and the column spans: base and told terms' spans, by start and then kind."""
    if not isinstance(told, list):
        rows = rows.withColumn("text_hash", F.xxhash64("_text")).join(told.withColumnRenamed("told", "_told"), "text_hash", "left").drop("text_hash")
        found = F.when(F.size("_told") > 0, _term_spans(F.col("_text"), lambda h: F.array_contains("_told", h))).otherwise(F.expr(NO_SPANS))
    elif told:
        # a list of literals is looked up in one hash set for all rows; most texts have none of them
        any_told = F.exists(terms(F.col("_text")), lambda t: t.isin(told))
        found = F.when(any_told, _term_spans(F.col("_text"), lambda h: h.isin(told))).otherwise(F.expr(NO_SPANS))
    else:
        found = F.expr(NO_SPANS)
    # a term inside a base span is covered already
    own = F.filter(found, lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return rows.withColumn("spans", F.sort_array(F.concat("base", own)))


def learn(docs: DataFrame) -> DataFrame | list[int]:
    """What told_terms gives for the terms that disclose an entity of docs."""
    found = materialise(find_entities(docs), "sanitise-entities")
    told = disclosing(found, docs)
    drop(found)
    return told_terms(docs, told)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and all (arrays of spans) for each row of docs."""
    rows = docs.select("doc_id", whole_text().alias("_text")).withColumn("base", base_spans(F.col("_text")))
    spans = with_term_spans(rows, learn(docs))
    return spans.select("doc_id", F.xxhash64("_text").alias("text_hash"), "base", F.col("spans").alias("all"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and span lists for each row of find_spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return spans.select(
        "doc_id", *[count(k) for k in range(4)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; spans that overlap are one.

    Spans are found in each row where it lies, so no text is shuffled and no crowd of copies meets.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), whole_text().alias("_text"))
    rows = with_term_spans(rows.withColumn("base", base_spans(F.col("_text"))), learn(docs))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    upto = _running(F.transform("spans", lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("_spans", F.zip_with("spans", upto, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at"))))
    pieces = F.transform(
        F.filter("_spans", lambda s: s["start"] >= s["at"]),
        lambda s: F.concat(F.substring("_text", s["at"] + 1, s["start"] - s["at"]), F.get(labels, s["kind"])),
    )
    rest = F.substring("_text", F.array_max(F.transform("spans", lambda s: s["stop"])) + 1, F.length("_text"))
    rows = rows.withColumn("_clean", F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)))

    def column(c: str) -> Column:
        own = F.col("_row").getField(c)
        if c == "text":
            return F.coalesce("_clean", own)
        if c == "n_chars":
            return F.when(F.col("_clean").isNotNull(), F.length("_clean").cast("long")).otherwise(own)
        return own

    return rows.select(*[column(c).alias(c) for c in names])
