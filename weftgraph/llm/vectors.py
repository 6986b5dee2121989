"""Near-duplicate vectors by p-stable hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups, split_hot
from .components import connected_components

#: Hash tables, projections of each, width of a projection's cells, rows that one task compares.
TABLES, PROJECTIONS, WIDTH, CELL = 18, 5, 1.0, 2048


def usable(vector: str):
    """Whether a vector is not null or zero and all its components are finite numbers."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> list[np.ndarray]:
    return [np.asarray(r, dtype=np.float64) for r in column.to_pylist()]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _hashed(vectors: DataFrame, seed: int, kind: str) -> DataFrame:
    """A row for each vector and table: its bucket there and all its buckets."""

    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(1)
            rows = _matrix(batch.column(2))
            sizes = np.array([len(r) for r in rows])
            for d in np.unique(sizes):
                if d not in planes:
                    rng = np.random.default_rng([seed, int(d)])
                    planes[d] = (
                        rng.standard_normal((int(d), TABLES * PROJECTIONS)),
                        rng.uniform(0, WIDTH, TABLES * PROJECTIONS),
                        rng.integers(1, 1 << 62, PROJECTIONS, dtype=np.int64) | 1,
                    )
                normal, shift, mix = planes[d]
                at = np.nonzero(sizes == d)[0]
                x = np.stack([rows[i] for i in at])
                cells = np.floor((_unit(x) @ normal + shift) / WIDTH).astype(np.int64).reshape(len(at), TABLES, PROJECTIONS)
                with np.errstate(over="ignore"):
                    codes = (cells * mix).sum(axis=2) + int(d)
                    codes ^= codes >> 29
                n = len(at) * TABLES
                every = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        labels.take(pa.array(np.repeat(at, TABLES))),
                        pa.array(np.full(n, d, dtype=np.int32)),
                        pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))),
                        pa.array(codes.ravel()),
                        pa.array(np.repeat(ids[at], TABLES)),
                        pa.array([e for e in every for _ in range(TABLES)], pa.binary()),
                        pa.array([e for r in x for e in [r.astype(kind).tobytes()] * TABLES], pa.binary()),
                    ],
                    ["label", "d", "t", "code", "id", "codes", "vector"],
                )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"label {label}, d int, t int, code long, id long, codes binary, vector binary")


def _block(g: dict, t: int, own: bool, least: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of a bucket: the weight that each links with, and edges to the least reached.

    A pair that meets in an earlier table already is counted there. In a pair of
    different blocks only pairs across the blocks count.
    """
    vectors = _unit(np.stack([np.frombuffer(v, dtype=kind) for v in g["vector"]]).astype(np.float64))
    codes = np.stack([np.frombuffer(c, dtype=np.int64) for c in g["codes"]])
    mult, side = g["mult"].astype(np.int64), g["_b"]
    n = len(vectors)
    weight = np.zeros(n, dtype=np.int64)
    xs, ys = [], []
    for a in range(0, n, 512):
        hit = vectors[a : a + 512] @ vectors.T >= least
        rows = np.arange(a, min(a + 512, n))
        hit[rows - a, rows] = False
        if not own:
            hit &= side[None, :] != side[rows, None]
        i, j = np.nonzero(hit)
        if t and len(i):
            fresh = np.concatenate([~(codes[j[k : k + 65536], :t] == codes[i[k : k + 65536] + a, :t]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[fresh], j[fresh]
        np.add.at(weight, i + a, mult[j])
        up = j < i + a
        x, y = _forest(n, i[up] + a, j[up])
        xs.append(x)
        ys.append(y)
    x, y = _forest(n, np.concatenate(xs), np.concatenate(ys))
    return weight, x, y


def _pairs(dealt: DataFrame, least: float, kind: str) -> DataFrame:
    """For each vector: the weight of its links (``to`` is itself), and edges (with weight 0)."""

    def run(batches):
        for (_, t, _, b0, b1), g in groups(batches, ["_l", "t", "code", "_b0", "_b1"], ["id", "mult", "codes", "vector", "_b"]):
            if len(g["id"]) < 2:
                continue
            weight, x, y = _block(g, int(t), b0 == b1, least, kind)
            ids, some = g["id"].astype(np.int64), np.nonzero(weight)[0]
            out = (np.concatenate([ids[some], ids[x]]), np.concatenate([weight[some], np.zeros(len(x), np.int64)]), np.concatenate([ids[some], ids[y]]))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["id", "weight", "to"])

    return dealt.mapInArrow(run, "id long, weight long, to long")


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the least that it reaches over the pairs (x, y) among n vertices."""
    if not len(x):
        return x, y
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def near_duplicates(
    table: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 11
) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``least``.

    Returns for each row: the key, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest key reachable) and ``kept`` (it is its own
    component's id). Vectors that are null, zero or hold null or non-finite
    components, and rows without a label, link with nothing. Equal vectors of a
    label are compared as one, weighted by their number, and vectors of different
    lengths never link. Buckets over CELL rows are compared block by block, so no
    link is lost to their size; a link is lost only where no table brings it
    together (recall is measured in the tests).
    """
    rows = table.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector"))
    rows = rows.withColumn("_fine", usable("_vector") & F.col("_label").isNotNull())
    kind = "<f4" if "float" in table.schema[vector].dataType.simpleString() else "<f8"
    same, _ = cut(
        rows.where("_fine")
        .groupBy("_label", "_vector")
        .agg(F.count(F.lit(1)).alias("mult"), F.min("_key").alias("least"))
        .withColumn("id", F.xxhash64("_label", "_vector"))
    )
    hashed = _hashed(same.select("id", F.col("_label").alias("label"), F.col("_vector").alias("v")), seed, kind)
    hashed = hashed.join(same.where("mult > 1").select("id", "mult"), "id", "left").withColumn("mult", F.coalesce("mult", F.lit(1).cast("long")))
    hashed = hashed.withColumn("_l", F.xxhash64("label", "d")).drop("label", "d")
    dealt = split_hot(hashed, ["_l", "t", "code"], F.xxhash64("id"), CELL)
    keys = ["_l", "t", "code", "_b0", "_b1"]
    dealt = dealt.select(*keys, "id", "mult", "codes", "vector", "_b").repartition(*keys).sortWithinPartitions(*keys)
    found, _ = cut(_pairs(dealt, least, kind))
    weights = found.where("weight > 0").groupBy("id").agg(F.sum("weight").alias("weight"))
    roots = connected_components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = same.join(weights, "id", "left").join(roots.withColumnRenamed("id", "rid"), F.col("id") == F.col("rid"), "left")
    classes = classes.select(
        "_label", "_vector", "least", (F.coalesce("weight", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")
    )
    tops = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(tops, "root").select("_label", "_vector", "n_links", "component_id")
    linked = rows.where("_fine").join(classes, ["_label", "_vector"]).select("_key", "n_links", "component_id")
    alone = rows.where("not _fine").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("_key").alias(key), "n_links", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept")
    )
