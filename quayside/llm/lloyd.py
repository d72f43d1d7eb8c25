"""Clusters of vectors by plain Lloyd rounds on integers, so that every machine and every partitioning gives the same centroids.

Each component x of a vector becomes floor(SCALE * x). The first centroids are the vectors with the least
SHA-256 of a seed and their id. In each round the centroids, K rows, go to all tasks; a task computes the
squared differences of its vectors to each centroid in turn and takes the least, the lowest number on ties.
It gives back one row of integer sums for each centroid it met, and these merge by centroid: rows exchanged
in a round grow with tasks and centroids alone, and a cluster that holds most vectors is no hot key. New
centroids are exact floors of sum by count; one without vectors stays where it is.

Cases: null vectors, and those with another number of components or with one that is null or not finite, are
left out; components beyond CLAMP are cut to it, so that squared distances fit 64 bits, and a sum of distances that
doesn't is null; a null id is hashed as "null" and kept as null; repeated rows count each, and of equal ids the
vector that is least by components is first; with fewer than K vectors each is a centroid; other columns are ignored and may have any name; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import written

DIMS = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = 2
#: Greatest component before scaling: (2 * CLAMP * SCALE) ** 2 * DIMS is below 2 ** 63.
CLAMP = float(1 << 19)

Centroids = list[list[int]]


def integer_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components, of vectors that are whole."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    cut = lambda c: F.floor(F.least(F.greatest(c, F.lit(-CLAMP)), F.lit(CLAMP)) * scale).cast("int")
    return table.filter(whole).select("vec_id", F.transform(x, cut).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> Centroids:
    """The k vectors with the least hash of seed and id, in order of the hash; each task keeps its k least."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def nearest(x, centroids):
    """(number, squared distance) of the nearest centroid of each row of x, all int64; ties go to the lower number."""
    import numpy as np

    d = np.empty((len(centroids), len(x)), np.int64)
    for j, c in enumerate(centroids):
        diff = x - c
        d[j] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(0)
    return best, d[best, np.arange(len(x))]


def _matrix(frame):
    import numpy as np

    return np.stack(frame["v"].to_numpy()).astype(np.int64)


def sums(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """cluster, n and s0, s1, ...: how many vectors are nearest to each centroid, and their sums by component."""
    import numpy as np

    dims = len(centroids[0])
    held = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    names = ["n", *(f"s{i}" for i in range(dims))]

    def run(frames):
        import numpy as np
        import pandas as pd

        c = held.value
        total = np.zeros((len(c), dims + 1), np.int64)
        for frame in frames:
            if len(frame):
                x = _matrix(frame)
                best = nearest(x, c)[0]
                for j in np.unique(best):
                    mine = x[best == j]
                    total[j, 0] += len(mine)
                    total[j, 1:] += mine.sum(0)
        met = np.flatnonzero(total[:, 0])
        out = pd.DataFrame(total[met], columns=names)
        out.insert(0, "cluster", met)
        yield out

    parts = vectors.select("v").mapInPandas(run, T.StructType([T.StructField(n, T.LongType()) for n in ("cluster", *names)]))
    return parts.groupBy("cluster").agg(*[F.sum(n).alias(n) for n in names])


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> Centroids:
    """Centroids after that many rounds; k rows come to the driver in each."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        for r in sums(vectors, centroids).collect():  # a row for each centroid
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return centroids


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    import numpy as np

    held = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(frames):
        import pandas as pd

        for frame in frames:
            if len(frame):
                best, d = nearest(_matrix(frame), held.value)
                yield pd.DataFrame({"id": frame["id"], "no_id": frame["no_id"], "cluster": best.astype("int32"), "distance": d})

    # pandas has no null among integers
    whole = vectors.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("id"), F.col("vec_id").isNull().alias("no_id"), "v")
    out = whole.mapInPandas(run, "id long, no_id boolean, cluster int, distance long")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "cluster", "distance")


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector of a table (vec_id, embedding)."""
    spark = table.sparkSession
    vectors = written(integer_vectors(table, dims).withColumn("vec_id", F.col("vec_id").cast("long")), "lloyd-vectors")
    centroids = fit(vectors, k, rounds, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    digests = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")  # k rows
    rows = written(assign(vectors, centroids or [[0] * dims]), "lloyd-assigned")
    by_cluster = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"), F.count("*").alias("n"))
    overall = by_cluster.agg(F.when(F.count("*") == F.count("cluster_inertia"), F.try_sum("cluster_inertia")).alias("inertia"))
    facts = by_cluster.drop("n").join(F.broadcast(overall), F.lit(True)).join(digests, "cluster")  # k rows
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
