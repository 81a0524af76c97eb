"""Nearest neighbours: exact by default, or over the nearest cells of a k-means partition with exact distances.

The filter applies first, then the cut to k by (distance, key), then the caller's sort and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.paths import find_path
from docquery.plans.filters import Knn

METRICS = ("cosine", "l2", "dot")


def distance(v: Column, query: tuple[float, ...], metric: str) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return -dot
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    own = sum(x * x for x in query) ** 0.5
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm == 0) | F.lit(own == 0), 1.0).otherwise(1 - dot / (norm * own))


def nearest(df: DataFrame, knn: Knn, pk: str, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """The k nearest rows with _distance; rows whose vector has another length are not indexed."""
    x = find_path(df.schema, knn.path)
    if x.kind != "arr" or not isinstance(x.dtype.elementType, T.NumericType):
        return df.withColumn("_distance", F.lit(None).cast("double")).limit(0)
    out = df.filter(F.size(x.col) == len(knn.query)).withColumn("_distance", distance(x.col, knn.query, metric))
    if keep is not None:
        out = out.filter(keep)
    return out.orderBy("_distance", pk).limit(knn.k)


def build_cells(df: DataFrame, path: str, cells: int, seed: int = 1, closure: int = 1, sample: int = 100_000) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """df with the column `cell`, and the centroids (cells x dimensions numbers, fitted on at most about `sample` rows).

    closure > 1 puts each row into so many nearest cells, one row each.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = find_path(df.schema, path).col
    n = df.count()
    fitted = df.sample(min(1.0, sample / max(1, n)), seed=seed).select(array_to_vector(F.transform(x, lambda e: e.cast("double"))).alias("features"))
    centers = [tuple(map(float, c)) for c in KMeans(k=cells, seed=seed, maxIter=10).fit(fitted).clusterCenters()]
    by = F.array_sort(F.array(*(F.struct(distance(x, c, "l2").alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centers))))
    out = df.withColumn("cell", F.explode(F.transform(F.slice(by, 1, closure), lambda s: s.cell)))
    return out, centers


def probe(df: DataFrame, centers: list[tuple[float, ...]], knn: Knn, pk: str, metric: str = "cosine", nprobe: int = 8, keep: Column | None = None) -> DataFrame:
    """nearest() over the nprobe cells nearest to the query; written by `cell`, the others are never read."""
    near = sorted(range(len(centers)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centers[i], knn.query, strict=True)))[:nprobe]
    return nearest(df.filter(F.col("cell").isin(*near)).dropDuplicates([pk]), knn, pk, metric, keep).drop("cell")
