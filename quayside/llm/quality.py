"""Quality by hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are cut at white space. Features are hashed word 1- and 2-grams, 1- to 3-grams of word shapes (runs of
capitals, small letters and digits as one sign each, other signs as they are), and for each of these
orders the share of n-grams that repeat in the text. A text's score is a sparse dot product.

The model is fitted in one executor task on a bounded sample of at most TRAIN_ROWS distinct labelled rows,
chosen by hash, as their features: at most DIMS numbers a row. The driver gets weights alone. Scoring reads whole
texts, whatever their length.

Cases: null and empty texts have the bias alone and its score; rows without a label are scored; a doc_id
with several labels counts with its greatest; rows that share a doc_id are sampled by their texts, and of
repeated rows one is learned from; without labels every score is 0.5; repeated rows are scored each; a score of
0.5 counts as good; other columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm import worker
from quayside.llm.common import SHARES, fitted_in_task, packed_rows, remainder_of, share_hash, texts_of

BITS = 16
DIMS = 1 << BITS
TRAIN_ROWS = 5000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
#: Most words kept by a worker, and their greatest length: under 100 MB whatever the texts are.
CACHE_WORDS, LONG_WORD = 150_000, 64
FOLDS, HELD_OUT = 3, 1



class Words(dict):
    """word: (hash of the word, hash of its shape)"""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        shape = re.sub(r"\d+", "0", word)
        shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", shape)
        shape = re.sub(r"([^\w\s])\1+", r"\1", shape)
        got = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass"), 1))
        if len(word) <= LONG_WORD:
            self[word] = got
        return got


def features(text: str | None):
    """Indices (ascending, below DIMS) and values of a text's features."""
    import numpy as np

    known = worker.table("quality", Words, CACHE_WORDS)
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.float32)
    both = np.array([known[w] for w in words], np.uint64)
    idx, val = [], []
    for kind, orders in ((0, 2), (1, 3)):
        h = one = both[:, kind]
        for n in range(1, orders + 1):
            if n > 1:
                if len(one) < n:
                    break
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind * 8 + n)
            distinct, count = np.unique(mixed >> np.uint64(64 - BITS), return_counts=True)
            idx.append(distinct.astype(np.uint32))
            val.append(np.sqrt(count / len(h)))
            repeated = 1 - len(np.unique(mixed)) / len(h)
            idx.append(np.array([(kind * 8 + n) * 2654435761 >> 7 & (DIMS - 1)], np.uint32))
            val.append(np.array([repeated]))
    i, v = np.concatenate(idx), np.concatenate(val)
    at, where = np.unique(i, return_inverse=True)
    return at, np.bincount(where, weights=v).astype(np.float32)


@dataclass
class Model:
    weights: object
    bias: float

    def score(self, idx, val) -> float:
        import numpy as np

        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[idx] @ val, -35, 35))))


def fit(rows: list, epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader (proximal) updates over rows (idx, val, label)."""
    import numpy as np

    z, n, zb, nb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    weights_at = lambda z, n: np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, val, y = rows[k]
            zi, ni = z[idx], n[idx]
            w = weights_at(zi, ni)
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            g0 = 1 / (1 + np.exp(-np.clip(bias + w @ val, -35, 35))) - y
            g = g0 * val
            n[idx] = ni + g * g
            z[idx] = zi + g - (np.sqrt(n[idx]) - np.sqrt(ni)) / ALPHA * w
            zb += g0 - (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / ALPHA * bias
            nb += g0 * g0
    return Model(weights_at(z, n).astype(np.float32), -zb / ((BETA + np.sqrt(nb)) / ALPHA))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, y and h (a hash of the row) of about TRAIN_ROWS distinct rows with a label that isn't held out."""
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder_of("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    own = own.select(F.col("doc_id").alias("l"), "y", share_hash("doc_id", F.lit("quality")).alias("s"))
    share = min(1.0, 1.2 * TRAIN_ROWS / max(1, own.count()))
    rows = docs.select("doc_id", "text").join(F.broadcast(own.filter(F.col("s") < share * SHARES)), F.col("doc_id") == F.col("l"))  # the sample is bounded by TRAIN_ROWS
    # a doc_id may stand in many rows
    again = min(1.0, 1.2 * TRAIN_ROWS / max(1, rows.count()))
    rows = rows.select("text", "y", share_hash("doc_id", "text", F.lit("quality rows")).alias("h"))
    return rows.filter(F.col("h") < again * SHARES).dropDuplicates(["h"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs whose label is known and whose doc_id is not held out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(h, y, *features(t)) for t, y, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2].astype("<u2").tobytes() for r in out], pa.binary()), pa.array([r[3].astype("<f2").tobytes() for r in out], pa.binary())], names=["h", "y", "i", "v"])

    def learned(table) -> Model:
        import numpy as np

        cols = [table.column(c).slice(0, TRAIN_ROWS).to_pylist() for c in ("i", "v", "y")]
        return fit([(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(v, "<f2").astype(np.float32), y) for i, v, y in zip(*cols, strict=True)])

    found = fitted_in_task(sample(docs, labels).mapInArrow(run, "h long, y int, i binary, v binary"), ["h", "i", "v"], learned)
    return found or fit([])


def score_with(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """row (a struct of the columns to keep) and quality_score of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers
    rows = packed_rows(docs, keep)
    schema = T.StructType([rows.schema.fields[0], T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            scores = [model.score(*features(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score_with(docs, learn(docs, labels), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.cast("long").alias("doc_id"), (remainder_of(doc_id, FOLDS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))
