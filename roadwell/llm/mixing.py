"""Operator 4: mixing sources to target weights along a curriculum.

Each source has a share of all words by its weight, at most ``CAP`` times what it holds; what is
over is shared again by weight (water-filling).  The source's documents stand in an order of
their own (by the MD5 of their id), and repeated passes over them supply its words.  A source's
weight changes over the schedule's time u in [0, 1] as 1 + slope * (2u - 1).  Its integral,

    demand(u) = target * (u + slope * (u * u - u)),

tells how many of the source's words are due by u, and inverting it gives the time at which each pass
over a document begins.  The integrals of all sources together, over all targets, turn that time into
the training position: the share of the whole mix's words that are trained on before it.

As positions are shares of the words, equal ranges of them hold about equally many words, and rows
come out dealt by such ranges and sorted inside.  Equal rows count as one row with their number;
sizes are summed over chunks of (source, leading hexadecimal digits of the MD5) before sources, so
no task holds a whole source, and to plan a mix only ids, sizes and sources are shuffled, never texts.

Defined results: a null text has size 0; a null source is a source of its own, after all others;
rows that share an id follow each other by size; documents of size 0 are taken 0 times; other
columns are ignored by ``plan_mix`` and kept by ``apply_mix``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadwell.llm.shared import SPACE_CLASS, count_words, materialise, whole_text

WEIGHTS = (5, 2, 1)
#: The slopes of the weights over time: early, even and late sources.
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3
#: Rows of a source that a chunk has on average at the most.
CHUNK = 50_000


def cycled(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """A row for each source of sizes (source, size): its size, target words and slope."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    sources = sources.select("*", cycled(weights, rank).cast("double").alias("w"), cycled(slopes, rank).alias("slope"))
    sources = sources.withColumn("most", (cap * F.col("source_size")).cast("double"))
    # sources that reach their cap first come first; once one does not, none behind it does
    reach = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("most").over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(reach.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = sources.select("*", ((whole - capped) / open_weight).alias("level"))
    full = F.col("most") / F.col("w") <= F.col("level")
    final = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    target = F.when(full, F.col("most")).otherwise(F.least("most", F.col("w") * final))
    return level.select("source", "source_size", "slope", target.alias("target"))


def schedule_time(due: Column, slope: Column) -> Column:
    """The time u at which a source has given the share due of its target: u + slope * (u * u - u) = due."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * due)
    return F.when(slope == 0, due).otherwise((root - (1 - slope)) / (2 * slope))


def plan_mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, positions for each row of docs.

    taken counts words, repeats included: whole passes, and in the last pass the words up to the
    source's target.  positions has where each pass over the document begins, position the first of
    them; without a word taken the one is empty and the other null.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = docs.select("doc_id", "source", count_words(whole_text()).alias("size"), order.alias("key"))
    rows = materialise(sizes.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    digits = 1
    while rows.count() > CHUNK << 4 * digits:
        digits += 1
    rows = rows.withColumn("chunk", F.substring("key", 1, digits))
    targets = source_targets(rows.select("source", (F.col("alike") * F.col("size")).alias("size")), weights, slopes, cap)
    # all sources together: demand(u) is the sum of targets times u + bend * (u * u - u)
    whole = Window.partitionBy()
    bend = F.sum(F.col("target") * F.col("slope")).over(whole) / F.sum("target").over(whole)
    targets = targets.withColumn("bend", F.coalesce(bend, F.lit(0.0)))
    chunks = rows.groupBy("source", "chunk").agg(F.sum(F.col("alike") * F.col("size")).alias("chunk_size"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("base"))
    chunks = chunks.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    chunks = chunks.withColumnsRenamed({"source": "_source", "chunk": "_chunk"})
    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(F.col("alike") * F.col("size")).over(inside), F.lit(0)))
    placed = placed.join(chunks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    placed = placed.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    before = F.col("base") + F.col("inside") + F.col("_turn") * F.col("size")
    quota = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    rest = quota - passes * F.col("source_size") - before
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    planned = placed.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "slope", "bend", before.alias("before")
    )

    def position(turn):
        u = schedule_time((F.col("before") + turn * F.col("source_size")) / F.col("target"), F.col("slope"))
        return F.round(u + F.col("bend") * (u * u - u), 9)

    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    turns = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    planned = planned.withColumn("positions", F.transform(turns, position)).drop("slope", "bend", "before")
    planned = planned.withColumn("position", F.get("positions", F.lit(0)))
    return in_order(planned, "position", "doc_id")


def in_order(rows: DataFrame, position: str, *then: str) -> DataFrame:
    """rows dealt by ranges of a position in [0, 1] and sorted inside; those without one come first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.coalesce(F.col(position), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    # rows without a position are not on the curriculum: they are dealt evenly
    part = F.when(F.col(position).isNull(), F.pmod(F.xxhash64(*then), F.lit(n)).cast("int")).otherwise(part) if then else part
    return rows.repartitionById(n, part).sortWithinPartitions(position, *then)


def apply_mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """docs as the mix takes them, by position: a row for each pass over a document, those never taken left out.

    The last pass over a source may end inside one document, which then keeps its words up to there.
    """
    names = docs.columns
    plan = plan_mix(docs, weights, slopes, cap).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    passes = F.transform(
        "positions", lambda p, k: F.struct(p.alias("position"), F.when(k < whole, F.lit(-1)).otherwise(rest).cast("long").alias("words"))
    )
    key = lambda size: F.struct("doc_id", "source", size.alias("size"))  # noqa: E731  a struct's null fields equal each other
    plan = plan.select(key(F.col("size")).alias("_key"), passes.alias("_passes"))
    # rows of one id, source and size are alike for the mix; each of them gets one of their plans
    plan = plan.groupBy("_key").agg(F.sort_array(F.collect_list("_passes")).alias("_plans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key(count_words(whole_text())).alias("_key"))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_row.text")))
    taken = rows.join(plan, "_key").withColumn("_turn", turn)
    taken = taken.select("_row", F.explode(F.get("_plans", F.col("_turn") - 1)).alias("_pass"))
    taken = in_order(taken.select("_row", F.col("_pass.words").alias("_words"), F.col("_pass.position").alias("_position")), "_position")
    head = F.concat(F.lit(f"^(?:{SPACE_CLASS}*+[^\\x20\\x09-\\x0D]++){{"), F.col("_words").cast("string"), F.lit("}+"))
    cut = F.when(F.col("_words") >= 0, F.regexp_substr(F.col("_row.text"), head)).otherwise(F.col("_row.text"))

    def column(c: str) -> Column:
        if c == "text":
            return cut
        own = F.col("_row").getField(c)
        return F.when(F.col("_words") >= 0, F.length(cut).cast("long")).otherwise(own) if c == "n_chars" else own

    return taken.select(*[column(c).alias(c) for c in names])
