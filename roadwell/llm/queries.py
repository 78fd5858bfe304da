"""The registered queries of the ten operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwell.llm.shared import new_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.token_store import read_token_files, write_token_files

    folder = new_folder(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), 2))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.media import probe, to_media

    return probe(to_media(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.mixing import CAP, plan_mix

    planned = plan_mix(table(spark, sf_dir, "documents"))
    passes = [F.get("positions", F.lit(k)).alias(f"position_{k + 1}") for k in range(CAP)]
    return planned.select("doc_id", "size", "source_size", "target", "taken", *passes)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return identify(docs, train(docs.where("NOT held_out")), ["doc_id", "held_out"])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.sanitise import digest, find_spans

    return digest(find_spans(table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.quality import judge

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *counts, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op9 look at, and its base rule: the part of it that SQL can state."""
    from roadwell.llm.quality import base_failed, measure

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measure(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *counts, base_failed().alias("base_failed"))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base findings of op7 by kind: the part of it that SQL can state."""
    from roadwell.llm.sanitise import KINDS, find_entities

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find_entities(table(spark, sf_dir, "documents")).select("doc_id", *[count(k) for k in range(4)])


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadwell.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_media_columns": op2_media_columns,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_repeats": op5_repeats,
        "op6_language": op6_language,
        "op7_personal_data": op7_personal_data,
        "op8_packing": op8_packing,
        "op9_quality": op9_quality,
        "op10_main_text": op10_main_text,
        "quality_counts": quality_counts,
        "personal_data_counts": personal_data_counts,
    }


MIXING_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
held AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM sizes GROUP BY source),
weighted AS (
  SELECT *, CAST(CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
    CAST(CASE r % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS slope, CAST(3 * source_size AS DOUBLE) AS most
  FROM held),
levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM weighted) AS DOUBLE)
      - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, slope,
    CASE WHEN most / w <= level THEN most ELSE least(most, w * (SELECT max(level) FROM levels WHERE most / w > level)) END AS target
  FROM levels),
bent AS (SELECT *, coalesce(sum(target * slope) OVER () / sum(target) OVER (), 0) AS bend FROM targets),
placed AS (
  SELECT row_number() OVER () AS n, doc_id, size, source_size, slope, bend, target,
    CAST(coalesce(sum(size) OVER (PARTITION BY sizes.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(floor(target + 0.5) AS BIGINT) AS quota
  FROM sizes JOIN bent ON sizes.source IS NOT DISTINCT FROM bent.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM placed),
counted AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, quota - passes * source_size - before)) AS BIGINT) AS taken FROM passed),
due AS (SELECT *, k, (before + k * source_size) / target AS share FROM counted CROSS JOIN range(3) AS t(k)),
timed AS (
  SELECT *, CASE WHEN taken > k * size THEN CASE WHEN slope = 0 THEN share
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS u
  FROM due)
SELECT doc_id, size, source_size, target, taken,
  max(CASE WHEN k = 0 THEN round(u + bend * (u * u - u), 9) + CAST(0 AS DOUBLE) END) AS position_1,
  max(CASE WHEN k = 1 THEN round(u + bend * (u * u - u), 9) + CAST(0 AS DOUBLE) END) AS position_2,
  max(CASE WHEN k = 2 THEN round(u + bend * (u * u - u), 9) + CAST(0 AS DOUBLE) END) AS position_3
FROM timed GROUP BY n, doc_id, size, source_size, target, taken"""


REPEATS_SQL = """
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM raw),
parts AS (SELECT r, n, c, substr(h, 4000 * c + 1, 4400) AS p FROM (SELECT r, n, h, unnest(range((n - 200) // 2000 + 1)) AS c FROM sized WHERE n >= 200)),
strings AS (SELECT r, 2000 * c + k AS i, md5(substr(p, 2 * k + 1, 400)) AS w FROM (SELECT r, c, p, unnest(range(least(2000, n - 199 - 2000 * c))) AS k FROM parts)),
again AS (SELECT w FROM strings GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings WHERE w IN (SELECT w FROM again)),
runs AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hits),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, g),
pieces AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b, b - a AS gone FROM spans
  UNION ALL SELECT r, coalesce(max(b), 0), any_value(n), NULL FROM sized LEFT JOIN spans USING (r) GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (pieces.b - pieces.a) AS BIGINT)), '' ORDER BY pieces.b) AS k, count(gone) AS n_spans, coalesce(sum(gone), 0) AS n_removed
  FROM pieces JOIN sized USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM sized JOIN kept USING (r)"""


COUNTS_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN again USING (r, g) CROSS JOIN range(8) AS o(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
counts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts"""


PERSONAL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
    regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda m: reverse(regexp_replace(m, '[^0-9]', '', 'g'))) AS cards,
    list_transform(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g'))) AS phones
  FROM d)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email,
  CAST(len(list_filter(ips, lambda m: list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(cards, lambda c: length(c) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(c) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN CAST(c[i] AS INTEGER) ELSE 2 * CAST(c[i] AS INTEGER) // 10 + 2 * CAST(c[i] AS INTEGER) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phones, lambda n: n BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM found"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can state; the tests hold the other queries against brute force."""
    return {"op4_mixing": MIXING_SQL, "op5_repeats": REPEATS_SQL, "quality_counts": COUNTS_SQL, "personal_data_counts": PERSONAL_SQL}
