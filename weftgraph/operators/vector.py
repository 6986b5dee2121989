"""Vector search: exact by distance, by inverted lists, and over several vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cosine, dot


def as_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2 (squared), cosine (1 - cosine), dot (1 - inner product) or hamming (of integer components)."""
    if metric == "hamming":
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long"))))
        return F.aggregate(bits, F.lit(0), lambda s, x: s + x).cast("double")
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    if metric == "l2":
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1.0 - cosine(x, y)
    if metric == "dot":
        return 1.0 - dot(x, y)
    raise ValueError(f"no metric {metric!r}")


def top(df: DataFrame, score: str, k: int, tie: Column, groups: list[str] | None = None, largest: bool = True) -> DataFrame:
    """The k best rows, of each group if there are any; ties by ``tie``."""
    first = F.col(f"`{score}`").desc_nulls_last() if largest else F.col(f"`{score}`").asc_nulls_last()
    if not groups:
        return df.orderBy(first, tie.asc()).limit(k)
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(first, tie.asc())
    return df.withColumn("@place", F.row_number().over(w)).where(F.col("@place") <= k).drop("@place")


def nearest(
    df: DataFrame, column: str, query: list[float], k: int = 10, metric: str = "l2", key: str = "id", prefilter: str | None = None,
    postfilter: str | None = None, distance_range: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """The k rows nearest to ``query``, with ``_distance``; rows without a vector of its length are left out.

    ``prefilter`` applies before the k are chosen, ``postfilter`` after; the range
    keeps low <= distance < high.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = df if prefilter is None else df.where(prefilter)
    rows = rows.where(F.size(column) == len(query)).withColumn("_distance", distance(F.col(column), as_vector(query), metric))
    low, high = distance_range
    if low is not None:
        rows = rows.where(F.col("_distance") >= low)
    if high is not None:
        rows = rows.where(F.col("_distance") < high)
    out = top(rows, "_distance", k, F.col(key), largest=False)
    return out if postfilter is None else out.where(postfilter)


def multi_nearest(df: DataFrame, column: str, queries: list[list[float]], k: int = 10, metric: str = "cosine", key: str = "id") -> DataFrame:
    """Rows hold several vectors; a row's score is the sum over the queries of its most alike vector (1 - distance)."""
    score = F.lit(0.0)
    for q in queries:
        score = score + F.array_max(F.transform(F.col(column), _likeness(q, metric)))
    return top(df.withColumn("_score", score), "_score", k, F.col(key))


def _likeness(query: list[float], metric: str):
    return lambda v: 1.0 - distance(v, as_vector(query), metric)


class InvertedLists:
    """Vectors in the cells of k-means centroids; a search reads the nearest cells only.

    The centroids are fitted on a bounded sample (``sample`` rows); every row is in
    the index. ``write`` lays the rows out by cell, so a search prunes files.
    """

    def __init__(self, rows: DataFrame, centroids: list[list[float]], column: str, key: str, metric: str):
        self.rows, self.centroids, self.column, self.key, self.metric = rows, centroids, column, key, metric

    @classmethod
    def build(cls, df: DataFrame, column: str, key: str = "id", cells: int = 32, metric: str = "l2", sample: int = 8192, seed: int = 7) -> InvertedLists:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if metric not in ("l2", "cosine"):
            raise ValueError("cells are by l2 or cosine")
        rows = df.where(F.col(column).isNotNull())
        some = rows.orderBy(F.xxhash64(F.lit(seed), key)).limit(sample).select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=cells, seed=seed, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(some)
        centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        return cls(cls.assigned(rows, column, centroids, metric), centroids, column, key, metric)

    @staticmethod
    def assigned(df: DataFrame, column: str, centroids: list[list[float]], metric: str) -> DataFrame:
        away = F.array(*[F.struct(distance(F.col(column), as_vector(c), metric).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centroids)])
        return df.withColumn("_cell", F.array_min(away)["cell"])

    def write(self, path: str) -> None:
        self.rows.repartition("_cell").write.mode("overwrite").partitionBy("_cell").parquet(path)

    def search(self, query: list[float], k: int = 10, nprobes: int = 1, prefilter: str | None = None) -> DataFrame:
        def away(c):
            if self.metric == "cosine":
                n = (sum(x * x for x in c) * sum(x * x for x in query)) ** 0.5
                return 1 - sum(x * y for x, y in zip(c, query)) / n if n else 1.0
            return sum((x - y) ** 2 for x, y in zip(c, query))

        cells = sorted(range(len(self.centroids)), key=lambda i: away(self.centroids[i]))[:nprobes]
        return nearest(self.rows.where(F.col("_cell").isin(cells)), self.column, query, k, self.metric, self.key, prefilter).drop("_cell")


def scalar_quantised(column: str, low: float, high: float) -> Column:
    """Components scaled to 0..255 between the bounds."""
    return F.transform(column, lambda x: F.least(F.greatest(F.round((x.cast("double") - low) / (high - low) * 255), F.lit(0.0)), F.lit(255.0)).cast("int"))


def sign_bits(column: str) -> Column:
    """One bit for each component: whether it is positive, as text of 0 and 1."""
    return F.array_join(F.transform(column, lambda x: F.when(x > 0, "1").otherwise("0")), "")


VECTOR = T.ArrayType(T.DoubleType())
