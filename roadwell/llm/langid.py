"""Operator 6: language identification by averaged hashed subword embeddings.

A text's bytes, lower-cased and with every run of non-letters as one space, give grams of two to
four bytes.  Each gram is hashed to an embedding; their average goes through a linear softmax.
Embeddings and weights are trained together by stochastic gradient descent in numpy on a sample of
at most ``ROWS`` labelled rows of each language, those of the least hash of id and text.  A fifth of the sample is not
trained on: it gives the temperature that makes scores probabilities, and the score below which a
prediction is rejected so that those accepted are right as often as ``PRECISION`` says.

As embedding and softmax are linear, a gram's embedding times the weights is one row of numbers
for each language; a prediction averages these rows over the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0; a null doc_id is
predicted like any other and counts as not held out; repeated rows each keep their row; other
columns are ignored; with no labelled row to learn from every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadwell.llm.shared import ship

#: Labelled rows of a language to learn from; the only bound on what is read.
ROWS = 1000
BITS, DIMENSIONS, EPOCHS, RATE = 15, 12, 6, 0.6
PRECISION = 0.99
ROUND = 20_000
UNKNOWN = "und"

_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(text: str) -> np.ndarray:
    """The hashes of all grams of a text, each in the part of the table that its length has."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out, value = [], b
    for k, prime in enumerate(_PRIMES):
        if len(value) < 2:
            break
        value = value[:-1] * np.uint32(256) + b[k + 1 :]
        out.append(((value * prime) >> np.uint32(32 - BITS)) + np.uint32(k << BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """languages, one row of the table for each gram, a bias, the temperature and the least score."""

    def __init__(self, texts: list, labels: list[str], seed: int = 7):
        """texts, or their different grams with how often each occurs; labels are their languages."""
        self.languages = sorted(set(labels))
        number = {x: k for k, x in enumerate(self.languages)}
        held = [np.unique(grams(t), return_counts=True) if isinstance(t, str) else t for t in texts]
        found = [(g, times, number[y]) for (g, times), y in zip(held, labels) if len(g)]
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(found))
        tuned = [found[i] for i in order[: len(found) // 5]]
        counts = [found[i] for i in order[len(found) // 5 :]]
        table = rng.normal(0, 0.1, (3 << BITS, DIMENSIONS)).astype(np.float32)
        weights = np.zeros((len(self.languages), DIMENSIONS), np.float32)
        bias = np.zeros(len(self.languages), np.float32)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in rng.permutation(len(counts)):
                index, times, y = counts[i]
                share = (times / times.sum()).astype(np.float32)
                x = share @ table[index]
                error = softmax(weights @ x + bias)
                error[y] -= 1
                back = weights.T @ error
                weights -= rate * np.outer(error, x)
                bias -= rate * 0.1 * error
                # a gram's share is small; its step is scaled by the number of grams, within reason
                table[index] -= (rate * min(len(index), 50)) * share[:, None] * back
        self.table = (table @ weights.T).astype(np.float32)
        self.bias = bias
        self.temperature, self.least = 1.0, 0.0
        if tuned:
            logits = np.array([self.logits(np.repeat(g, times)) for g, times, _ in tuned])
            truth = np.array([y for _, _, y in tuned])
            choices = np.geomspace(0.25, 8, 60)
            loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in choices]
            self.temperature = float(choices[int(np.argmin(loss))])
            chance = softmax(logits / self.temperature)
            order = np.argsort(-chance.max(1), kind="stable")
            right = np.cumsum(chance.argmax(1)[order] == truth[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= PRECISION)
            self.least = float(chance.max(1)[order[good[-1]]]) if len(good) else 1.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for lo in range(0, len(found), 1 << 20):
            total += self.table[found[lo : lo + (1 << 20)]].sum(0, dtype=np.float64)
        return total / len(found) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        chance = softmax(self.logits(grams(text)) / self.temperature)
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """Of each language's labelled rows at most rows, those of the least hash of id and text: (lang, h, text).

    First a share of each language's rows by hash, about twice as many as wanted, then the least of
    them; so no window ever holds a language whole.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # as many rows as languages, which the softmax has a row of weights for each
    share = F.when(F.col("n") <= 2 * rows, F.lit(1.0)).otherwise(F.lit(2.0 * rows) / F.col("n"))
    some = labelled.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang")
    some = some.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return some.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "text")


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model of the labelled rows of docs (text, lang, doc_id), of at most rows of each language.

    Executors turn texts into counts of grams; only those come to the driver.
    """
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            found = [np.unique(grams(t), return_counts=True) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([g.astype("<u4").tobytes() for g, _ in found], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary()),
                ],
                ["lang", "h", "grams", "times"],
            )

    found = sample_of(docs, rows).mapInArrow(count, "lang string, h long, grams binary, times binary").collect()
    found.sort(key=lambda r: (r["lang"], r["h"], r["grams"]))
    number = lambda raw: np.frombuffer(raw, "<u4")
    return Model([(number(r["grams"]), number(r["times"])) for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep with lang_pred, score and rejected for each whole text."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(batches):
        own = held.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns += [
                pa.array([x for x, _ in found], pa.string()),
                pa.array([round(s, 6) for _, s in found], pa.float64()),
                pa.array([s < own.least for _, s in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "rejected"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(predict, f"{schema}lang_pred string, score double, rejected boolean")
