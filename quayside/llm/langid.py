"""Language identification by hierarchical discrimination.

Languages are grouped to families by the likeness of their mean character n-gram profiles. A linear
classifier predicts the family; within it, one-versus-one linear support vector machines vote between the
closely related languages. Features are square roots of hashed counts of 1- to 3-grams of the
lower-cased whole text, in which all but letters is a space.

The model is fitted in one executor task on a bounded sample of distinct rows: at most PER_LANGUAGE of each
language, and about MAX_ROWS in all while that leaves each language LEAST_ROWS. All languages are learned; a
family holds at most FAMILY of them, so the model grows by about 100 KB a language. The driver gets weights alone.

Cases: null texts and texts without letters are "und" with score 0; without labelled rows every text is
"und"; of repeated rows one is learned from and each is predicted; rows that share an id or have none are
sampled by their texts; of equal votes the larger share wins, of equal shares the language first by name; long
texts are read whole, in memory of some 20 bytes a character; only text enters a prediction; other columns are
ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm import worker
from quayside.llm.common import SHARES, fitted_in_task, packed_rows, remainder_of, share_hash, texts_of

DIMS = 4096
PER_LANGUAGE = 800
MAX_ROWS = 6000
LEAST_ROWS = 20
#: Most languages of a family.
FAMILY = 10
STEPS = 100
NONE = "und"

_letters = None


def profile(text: str | None):
    """Unit vector of a text's n-grams, or None without letters."""
    import numpy as np

    global _letters
    worker.table("language")
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    letters = _letters[c]
    if not letters.any():
        return None
    c = np.where(letters, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letters[1:] | letters[:-1]  # runs of other characters are one space
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    h, out = c, np.zeros(DIMS)
    for n in range(1, 4):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out += np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=DIMS)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_linear(x, y, steps: int = STEPS, c: float = 10.0):
    """Linear support vector machine with squared hinge loss; y is -1 or 1. Weights and bias by accelerated gradient steps."""
    import numpy as np

    n, y = len(y), y.astype(np.float32)  # single precision throughout, so that x is never copied
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), b
    rate, t = 1 / (4 * float(weight.sum()) + 0.01), 1.0
    for _ in range(steps if n else 0):
        slack = np.maximum(np.float32(0), 1 - y * (x @ v + np.float32(vb))) * weight * y
        new, nb = v - np.float32(rate) * (np.float32(0.01) * v - 2 * (slack @ x)), vb + rate * 2 * float(slack.sum())
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = new + np.float32((old - 1) / t) * (new - w), nb + (old - 1) / t * (nb - b)
        w, b = new, nb
    return w.astype(np.float32), float(b)


def families(means, most: int = FAMILY) -> list[list[int]]:
    """Average linkage of languages' mean profiles until about as many families as the square root of languages are
    left, or all pairs would make a family of over `most`."""
    import numpy as np

    n = len(means)
    groups: list[list[int]] = [[k] for k in range(n)]
    like = (means @ means.T).astype(np.float64)
    size = np.ones(n)
    left = n
    while left > max(1, math.ceil(math.sqrt(n))):
        open_ = np.triu((size[:, None] + size[None, :] <= most) & (size[:, None] > 0) & (size[None, :] > 0), 1)
        if not open_.any():
            break
        i, j = divmod(int(np.where(open_, like, -np.inf).argmax()), n)
        like[i] = like[:, i] = (size[i] * like[i] + size[j] * like[j]) / (size[i] + size[j])
        groups[i] += groups[j]
        size[i], size[j], groups[j] = size[i] + size[j], 0, []
        left -= 1
    return [sorted(g) for g in groups if g]


@dataclass
class Model:
    names: list[str]
    groups: list[list[int]]
    family_w: object
    family_b: object
    pairs: list[tuple[int, int, int]]  # family, language, language
    pair_w: object
    pair_b: object

    def predict(self, x):
        """Language and score of each profile: the family's share times the language's share of its pairs."""
        import numpy as np

        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        margin = x @ self.family_w.T + self.family_b
        family = margin.argmax(1)
        score = sure(margin[np.arange(len(x)), family]) if len(self.groups) > 1 else np.ones(len(x))
        each = sure(x @ self.pair_w.T + self.pair_b) if self.pairs else np.zeros((len(x), 0))
        out = np.zeros(len(x), np.int64)
        for f, group in enumerate(self.groups):
            rows = np.nonzero(family == f)[0]
            if len(group) == 1:
                out[rows] = group[0]
                continue
            share = np.zeros((len(rows), len(self.names)))
            votes = np.zeros_like(share)
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    p = each[rows, k]
                    share[:, a] += p
                    share[:, b] += 1 - p
                    votes[:, a] += p >= 0.5
                    votes[:, b] += p < 0.5
            share = share[:, group] / (len(group) - 1)
            best = (votes[:, group] + share / 2).argmax(1)
            out[rows] = np.array(group)[best]
            score[rows] *= share[np.arange(len(rows)), best]
        return [self.names[k] for k in out], score


def train(names: list[str], labels, x) -> Model:
    import numpy as np

    means = np.stack([x[labels == k].mean(0) for k in range(len(names))])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    groups = families(means)
    family_of = np.zeros(len(names), np.int64)
    for f, g in enumerate(groups):
        family_of[g] = f
    own = family_of[labels]
    if len(groups) == 1:
        fitted = [(np.zeros(DIMS, np.float32), 0.0)]
    elif len(groups) == 2:
        w, b = fit_linear(x, np.where(own == 0, 1.0, -1.0))
        fitted = [(w, b), (-w, -b)]
    else:
        fitted = [fit_linear(x, np.where(own == f, 1.0, -1.0)) for f in range(len(groups))]
    pairs = [(f, a, b) for f, g in enumerate(groups) for i, a in enumerate(g) for b in g[i + 1 :]]
    machines = []
    for _, a, b in pairs:
        rows = (labels == a) | (labels == b)
        machines.append(fit_linear(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
    stack = lambda ms: (np.stack([m[0] for m in ms]) if ms else np.zeros((0, DIMS), np.float32), np.array([m[1] for m in ms], np.float32))
    return Model(names, groups, *stack(fitted), pairs, *stack(machines))


def sample(labelled: DataFrame) -> DataFrame:
    """lang, text and h (a hash of the row) of about as many distinct rows of each language as learn takes."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", share_hash("doc_id", "text", F.lit("langid")).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n"))
    each = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(PER_LANGUAGE), F.floor(F.lit(MAX_ROWS) / F.count("*").over(W.partitionBy()))))  # a row for each language
    # a fifth more than wanted, which the task cuts to the number wanted
    shares = counts.select(F.col("lang").alias("l"), each.cast("int").alias("each"), (F.least(F.lit(1.0), 1.2 * each / F.col("n")) * SHARES).alias("share"))
    return rows.join(F.broadcast(shares), F.col("lang") == F.col("l")).filter("h < share").select("lang", "text", "h", "each").dropDuplicates(["lang", "h"])


def learn(labelled: DataFrame) -> Model | None:
    """Fit on rows (doc_id, text, lang); lang is the label."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(lang, p.astype("<f2").tobytes(), h, each) for lang, text, h, each in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) if (p := profile(text)) is not None]
            if rows:
                langs, profiles, hashes, wanted = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(profiles, pa.binary()), pa.array(hashes), pa.array(wanted, pa.int32())], names=["lang", "p", "h", "each"])

    def fit(table) -> Model:
        import numpy as np

        langs, each = table.column("lang").to_pylist(), table.column("each").to_pylist()
        taken: dict[str, int] = {}
        keep = []
        for k, lang in enumerate(langs):  # in the order of h
            taken[lang] = taken.get(lang, 0) + 1
            if taken[lang] <= each[k]:
                keep.append(k)
        x = np.empty((len(keep), DIMS), np.float32)
        profiles = table.column("p").combine_chunks()
        for at, k in enumerate(keep):
            x[at] = np.frombuffer(profiles[k].as_py(), "<f2")
        names = sorted(taken)
        place = {n: k for k, n in enumerate(names)}
        return train(names, np.array([place[langs[k]] for k in keep]), x)

    return fitted_in_task(sample(labelled).mapInArrow(run, "lang string, p binary, h long, each int"), ["lang", "h", "p"], fit)


FOLDS, HELD_OUT = 4, 2


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(remainder_of("doc_id", FOLDS) != HELD_OUT)


def score_with(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """row (a struct of the columns to keep), lang_pred and lang_score of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the languages and DIMS
    rows = packed_rows(docs, keep)
    schema = T.StructType([rows.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = texts_of(batch)
                names, scores = [NONE] * len(texts), np.zeros(len(texts))
                profiles = [profile(t) for t in texts] if held.value else []
                some = [i for i, p in enumerate(profiles) if p is not None]
                if some:
                    got, s = held.value.predict(np.stack([profiles[i] for i in some]))
                    scores[some] = s
                    for i, g in zip(some, got, strict=True):
                        names[i] = g
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = score_with(docs, learn(train_rows(docs)), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.cast("long").alias("doc_id"), (remainder_of(doc_id, FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
