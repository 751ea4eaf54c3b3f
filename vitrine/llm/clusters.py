"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Components become integers, floor(scale * x). Identical vectors become one row with their number, so each round
reads distinct vectors only, and a third of all rows in one vector costs one row. A round assigns every distinct vector to its
nearest centroid (squared Euclidean distance, ties to the smaller number) and sums components times multiplicities as integers;
each task sends one row for each centroid it met, and k rows reach the driver. All arithmetic is exact, so neither
partitions nor their order change a result. At the end assignments are joined back to the rows by the vector's digest;
vectors with a crowd of copies, at most 1000 of them, meet theirs in a broadcast.

Kept are vectors with exactly ``dims`` components, none null, non-finite or so large that squared distances would not fit a
long (in 64 components, beyond 185,363 at scale 1024). Null vectors and others are left out. Repeated rows are rows of their own, with equal results.
Rows without an id are clustered but can't be a first centroid; of rows with one id, the smaller vector comes first.
With fewer than k rows there are as many centroids; an empty table gives no rows. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import begin, materialize
from vitrine.llm.components import CROWD, SHARE


def largest(dims: int) -> int:
    """Components below this give squared distances below 2^63."""
    return isqrt((1 << 63) // (4 * dims)) - 1


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for a vector that isn't kept."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < largest(dims) / scale, F.lit(False)))
    return F.when((F.size(vector) == dims) & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def digest(vector: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), 256))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, in whole numbers."""
    best, least = np.zeros(len(x), dtype=np.int64), None
    exact = x.shape[1] * float(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))) ** 2 < 2**53  # so in doubles too
    own = (x * x).sum(axis=1)
    for k, c in enumerate(centroids):
        d = own + (c * c).sum() - 2 * (x.astype(np.float64) @ c.astype(np.float64)).astype(np.int64) if exact else ((x - c) ** 2).sum(axis=1)
        if least is None:
            least = d
        else:
            closer = d < least
            best[closer], least = k, np.minimum(least, d)
    return best, least


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of weighted means; those without vectors stay."""
    dims = centroids.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("clusters")
        total = [[0] * dims for _ in centroids]
        count = [0] * len(centroids)
        for b in batches:
            x, n = np.stack(b["vec"].to_numpy()), b["n"].to_numpy()
            best, _ = nearest(x, centroids)
            for k in np.unique(best):
                at = best == k
                few = float(n[at].sum()) * float(np.abs(x[at]).max(initial=0)) < 2**62  # else Python's integers
                part = n[at] @ x[at] if few else n[at].astype(object) @ x[at].astype(object)
                total[k] = [a + int(v) for a, v in zip(total[k], part, strict=True)]
                count[k] += int(n[at].sum())
        met = [k for k, c in enumerate(count) if c]
        if met:
            yield pd.DataFrame({"cluster": met, "n": [count[k] for k in met], "total": [[str(v) for v in total[k]] for k in met]})

    parts = distinct.select("vec", "n").mapInPandas(sums, "cluster int, n long, total array<string>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in each.collect():  # k rows for each component
        out[r["cluster"], r["i"]] = int(r["v"]) // r["n"]
    return out


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hexadecimal sha256 of salt and id, in this order."""
    named = kept.filter("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "vec")
    return np.array([r["vec"] for r in named.orderBy("h", "vec").limit(k).collect()], dtype=np.int64)


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 1024, salt: str = "", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and ``copies``, how many rows have this vector."""
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dims, scale).alias("vec")).filter("vec is not null").withColumn("key", digest(F.col("vec")))
    distinct = materialize(rows.groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("n")), "distinct_vectors")
    centroids = first_centroids(rows, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        after = moved(distinct, centroids)
        if (after == centroids).all():  # further rounds would change nothing
            break
        centroids = after

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("clusters")
        for b in batches:
            best, least = nearest(np.stack(b["vec"].to_numpy()), centroids)
            yield pd.DataFrame({"key": b["key"], "n": b["n"], "cluster": best, "distance": least})

    told = materialize((distinct if len(centroids) else distinct.limit(0)).mapInPandas(assign, "key binary, n long, cluster int, distance long"), "assigned_vectors")
    inertias = {r["cluster"]: (int(r["inertia"]), int(r["n"])) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("inertia"), F.sum("n").alias("n")).collect()}
    return joined_back(rows.select("id", "key"), told, sum(n for _, n in inertias.values()), facts(centroids, inertias)).withColumnRenamed("id", id_col)


def facts(centroids: np.ndarray, inertias: dict[int, tuple[int, int]]) -> Sequence[Column]:
    """cluster_inertia, inertia and centroid_sha256 by the number of a cluster; k cases each."""
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if len(values) else F.lit(None).cast(kind)
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = [inertias.get(k, (0, 0))[0] for k in range(len(centroids))]
    return at(own, "long").alias("cluster_inertia"), F.lit(sum(own)).cast("long").alias("inertia"), at(shas, "string").alias("centroid_sha256")


def joined_back(rows: DataFrame, told: DataFrame, size: int, more: Sequence[Column]) -> DataFrame:
    """Rows with what their vector was told. A vector that is crowded, by the multiplicities, is looked up in a broadcast of at most 1000 rows."""
    crowded = told.filter(F.col("n") > max(CROWD, SHARE * size))
    few = materialize(crowded, "crowded_vectors")
    rest = rows.join(F.broadcast(few.select("key")), "key", "left_anti").join(told, "key")
    found = rest.unionByName(rows.join(F.broadcast(few), "key")) if not few.isEmpty() else rows.join(told, "key")
    return found.select("id", "cluster", "distance", *more, F.col("n").alias("copies"))
