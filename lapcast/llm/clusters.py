"""Integer k-means in column expressions: literal centroids, distances by zip_with and aggregate, sums by column.

Components become ``floor(scale * x)``. They are held within +-2^30 and a squared distance within 2^62, so that no step leaves
a long: results are exact while every ``scale * x`` lies in that range and the true squared distance is below 2^62; beyond, values
are held at the bound instead of failing. Sums of components are longs; a sum that leaves a long ends the job with an error.

A null vector, one of another length, or one with a null or non-finite component is left out. A null id starts as the text ``1:``.
Rows that repeat an id are rows of their own; among equal hashes the smaller vector is the earlier start. Fewer vectors than
centroids give as many centroids as there are vectors; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.session import written

_LOW, _HIGH, _FAR = -(2**30), 2**30 - 1, 2**62
_LONGEST = 2**63 - 1
_HALF = 31


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64) -> DataFrame:
    """``id`` and ``x``, an array of longs, of every usable vector."""
    plain = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    held = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(_HIGH))), F.lit(float(_LOW)))).cast("long")
    return plain.where((F.size("v") == dimensions) & finite).select("id", F.transform("v", held).alias("x"))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``<seed>:<id>``, in hash order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = vectors.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(count)
    return [list(r["x"]) for r in chosen.collect()]


def _distance(x: Column, centroid: list[int]) -> Column:
    literal = F.lit(centroid).cast("array<bigint>")
    squares = F.zip_with(x, literal, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, d: F.least(total + d, F.lit(_FAR)))


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """``distance`` and ``cluster`` of the nearest centroid, the smaller number on a tie."""
    return F.array_min(F.array(*[F.struct(_distance(x, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floored mean of its vectors; one without vectors stays. One row a cluster comes back."""
    placed = vectors.select("x", nearest(F.col("x"), centroids)["cluster"].alias("cluster"))
    parts = range(len(centroids[0]))
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in parts])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in parts]
    return out


def clustered(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64,
    count: int = 16, rounds: int = 3, seed: int = 1,
) -> tuple[DataFrame, list[list[int]]]:
    """(``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector, the final centroids).

    One scan for the start and one for each round; the last assignment is written once and its inertias are added up from there.
    Only centroids, at most ``count`` rows, pass through the driver.
    """
    vectors = integer_vectors(df, key, vector, dimensions, scale)
    centroids = first_centroids(vectors, count, seed)
    if not centroids:
        schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    near = vectors.select("id", nearest(F.col("x"), centroids).alias("n")).select("id", "n.cluster", "n.distance")
    placed = written(near, "clusters")
    # Two sums, of the high and the low bits, so that neither leaves a long.
    high, low = F.shiftright("distance", _HALF), F.col("distance").bitwiseAND(F.lit(2**_HALF - 1))
    sums = placed.groupBy("cluster").agg(F.sum(high).alias("high"), F.sum(low).alias("low")).collect()
    of = {r["cluster"]: (r["high"] << _HALF) + r["low"] for r in sums}
    longs = F.lit([min(of.get(k, 0), _LONGEST) for k in range(len(centroids))]).cast("array<bigint>")
    digests = F.lit([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])
    return placed.select(
        "id", "cluster", "distance", F.get(longs, "cluster").alias("cluster_inertia"),
        F.lit(min(sum(of.values()), _LONGEST)).cast("long").alias("inertia"), F.get(digests, "cluster").alias("centroid_sha256"),
    ), centroids
