"""Exact top-k inner products by histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, groups

#: Rows of a block of candidates and of queries; bits that one round of histograms resolves.
CANDIDATES, QUERIES, ROUND = 4096, 1024, 10


def quantised(vector: str, scale: int = 256):
    """floor(scale * x) of each component as long; null if the vector can't take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return F.when(v.isNotNull() & fine, whole)


def _blocks(rows: DataFrame, name: str, size: int, count: int) -> DataFrame:
    """``rows`` (id, v) packed: a row for each block with its ids and its matrix as bytes."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).repartition("block", "d").sortWithinPartitions("block", "d")

    def run(batches):
        for (block, d), g in groups(batches, ["block", "d"], ["id", "v"]):
            order = np.argsort(g["id"], kind="stable")
            ids = g["id"].astype(np.int64)[order]
            matrix = np.stack([np.asarray(v, dtype=np.int64) for v in g["v"]])[order] if d else np.zeros((len(ids), 0), np.int64)
            for a in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block)]), pa.array([int(d)], pa.int32()), pa.array([a], pa.int32())]
                    + [pa.array([x[a : a + size].tobytes()], pa.binary()) for x in (ids, matrix)],
                    [f"{name}_block", "d", f"{name}_part", f"{name}_ids", f"{name}_matrix"],
                )

    return dealt.mapInArrow(run, f"{name}_block long, d int, {name}_part int, {name}_ids binary, {name}_matrix binary")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where no sum can reach 2^53."""
    d = q.shape[1]
    if not d or not q.size or not c.size:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    top = float(np.abs(q).max()) * float(np.abs(c).max()) * d
    if top < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2.0**63:
        return q @ c.T
    raise OverflowError("an inner product may not fit in 64 bits")


def _pairs(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
            q = np.frombuffer(r["q_matrix"], np.int64).reshape(len(qi), r["d"])
            c = np.frombuffer(r["c_matrix"], np.int64).reshape(len(ci), r["d"])
            for a in range(0, len(qi), 256):
                s = _scores(q[a : a + 256], c)
                yield r, qi[a : a + 256], ci, s, ci[None, :] != qi[a : a + 256, None]


def top_k(
    table: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """The ``k`` candidates with the largest integer inner product for each query row.

    ``queries`` is a condition on the table's rows; candidates are all rows with
    another key. Components are quantised as floor(scale * x); vectors that are null
    or hold null or non-finite components, and rows without a key, take no part, and
    vectors only meet others of their length. Returns ``query_id``, ``rank`` (from
    1), the key and ``score``; ties go to the smaller key; fewer than k candidates
    give fewer rows.

    Every query meets every candidate, in blocks. Each round puts out histograms of
    the scores, coarse ones first; a block leaves out bins below the one that holds
    its own k-th score, as the global k-th can't lie below that. Summed over the
    blocks they tell in which bin a query's k-th score lies, and the next round
    resolves that bin further until a bin is one score. Then the pairs at or above
    it are kept, and ranked for each query with ties broken by key.
    """
    spark = table.sparkSession
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where("v is not null").withColumn("d", F.size("v"))
    rows, _ = cut(rows)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_query").cast("int")).alias("q"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m"),
        F.max("d").alias("d"),
    ).first()
    n, nq = stats["n"], stats["q"] or 0
    c_count, q_count = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    candidates = _blocks(rows.select("id", "d", "v"), "c", CANDIDATES, c_count)
    asked = _blocks(rows.where("is_query").dropDuplicates(["id"]).select("id", "d", "v"), "q", QUERIES, q_count)
    candidates, _ = cut(candidates)
    asked, _ = cut(asked)
    candidates = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_count - 1).cast("long"))))
    met = candidates.join(asked.hint("shuffle_hash"), ["q_block", "d"])
    met = met.repartition(F.col("q_block"), F.col("c_block"), F.col("c_part"))
    bits = max(1, ((stats["m"] or 0) ** 2 * max(1, stats["d"] or 0)).bit_length())
    shifts = list(range(max(0, bits + 1 - ROUND), 0, -ROUND)) + [0]

    def histogram(shift: int):
        def run(batches):
            for r, qi, ci, s, other in _pairs(batches):
                known = {b["query_id"]: b for b in r["bounds"]} if r.get("bounds") is not None else None
                q_out, b_out, n_out = [], [], []
                for i in range(len(qi)):
                    mine = s[i][other[i]]
                    if known is not None:
                        if int(qi[i]) not in known:
                            continue
                        at = known[int(qi[i])]
                        mine = mine[mine >> at["shift"] == at["bin"]]
                    if not len(mine):
                        continue
                    if len(mine) > k:
                        mine = mine[mine >> shift >= (np.partition(mine, len(mine) - k)[len(mine) - k] >> shift)]
                    bins, counts = np.unique(mine >> shift, return_counts=True)
                    q_out.append(np.full(len(bins), qi[i]))
                    b_out.append(bins)
                    n_out.append(counts)
                if q_out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).astype(np.int64)) for x in (q_out, b_out, n_out)], ["query_id", "bin", "n"]
                    )

        return run

    def with_bounds(bounds: DataFrame | None) -> DataFrame:
        """Each pair of blocks with what is known of its queries (at most QUERIES of them)."""
        if bounds is None:
            return met
        by_block = bounds.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(q_count)).alias("q_block")).agg(
            F.collect_list(F.struct("query_id", "bin", "shift")).alias("bounds")
        )
        return met.join(by_block, "q_block")

    bounds, path = None, None
    for shift in shifts:
        counted = with_bounds(bounds).mapInArrow(histogram(shift), "query_id long, bin long, n long")
        counted = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        found = counted if bounds is None else counted.join(bounds.select("query_id", "left"), "query_id")
        bins = found.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("bins"),
            (F.lit(k) if bounds is None else F.first("left")).alias("left"),
        )
        # Walk from the highest bin down until the wanted number is reached.
        walked = F.aggregate(
            "bins",
            F.struct(F.col("left").cast("long").alias("left"), F.lit(None).cast("long").alias("bin"), F.lit(False).alias("done")),
            lambda acc, x: F.when(acc["done"], acc).otherwise(
                F.struct(
                    F.when(acc["left"] > x["n"], acc["left"] - x["n"]).otherwise(acc["left"]).alias("left"),
                    (-x["b"]).alias("bin"),
                    (acc["left"] <= x["n"]).alias("done"),
                )
            ),
        )
        step = bins.select("query_id", walked.alias("w")).select(
            "query_id", F.col("w.bin").alias("bin"), F.lit(shift).alias("shift"), F.when(F.col("w.done"), F.col("w.left")).otherwise(F.lit(1 << 40)).cast("long").alias("left")
        )
        new, new_path = cut(step)
        if path:
            forget(spark, path)
        bounds, path = new, new_path

    def keep(batches):
        for r, qi, ci, s, other in _pairs(batches):
            known = {b["query_id"]: b["bin"] for b in r["bounds"]}
            least = np.array([known.get(int(i), np.iinfo(np.int64).max) for i in qi])
            i, j = np.nonzero((s >= least[:, None]) & other & np.isin(qi, list(known))[:, None])
            if len(i):
                # Of a block's pairs at one score only the k smallest keys can rank.
                order = np.lexsort((ci[j], -s[i, j], i))
                i, j = i[order], j[order]
                start = np.concatenate(([0], np.nonzero(np.diff(i))[0] + 1))
                place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                i, j = i[place < k], j[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ci[j]), pa.array(s[i, j])], ["query_id", "id", "score"])

    kept = with_bounds(bounds).mapInArrow(keep, "query_id long, id long, score long")
    best = kept.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (-F.col("x.s")).alias("score")
    )
