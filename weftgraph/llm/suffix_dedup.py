"""Exact removal of long repeated strings by suffix sorting.

The corpus is never sorted as one string. Every window of ``length`` bytes is
assigned to its anchor, the least gram by hash inside it, which depends on the
window's bytes alone: equal windows have equal anchors. So the windows of one
anchor form a slice of text, slices whose anchor occurs once hold no repeat and go
no further, and slices that share an anchor are sorted together, as suffixes, by
two-stage sorting.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, groups

LENGTH, GRAM = 400, 32
#: Windows sorted at once; distinct slices of an anchor from which they are cut finer; width of such a cut.
CHUNK, HOT, FINE = 120_000, 400, 16
_PIECE = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by running minima from both ends of blocks."""
    n = len(v) - w + 1
    size = -(-len(v) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of a text as bytes: hash and place of each anchor, its first and last window, hash of its slice."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    windows = len(data) - length + 1
    for base in range(0, windows, _PIECE):
        piece = data[base : base + _PIECE + length - 1]
        n = len(piece)
        up, down = _tables(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
            gram = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
        packed = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
        place = (_least(packed, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.concatenate(([0], np.nonzero(np.diff(place))[0] + 1))
        hi = np.concatenate((lo[1:], [len(place)])) - 1
        at = place[lo]
        with np.errstate(over="ignore"):
            whole = (prefix[hi + length] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _BASE
        for k, x in enumerate((gram[at].view(np.int64), at + base, lo + base, hi + base, _mixed(whole).view(np.int64))):
            out[k].append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def repeated(slices: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each slice: whether the string of ``length`` bytes at each start occurs at another start in any slice.

    Two-stage suffix sorting: suffixes that are smaller than their successors are
    sorted directly (by as many bytes as matter), the others take their order from
    a scan over the buckets of first bytes, each suffix placing the one before it;
    then neighbours' common prefixes tell the repeats.
    """
    sizes = np.array([len(s) for s in slices])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    text = np.zeros(int((sizes + 1).sum()) + length + 1, dtype=np.uint8)
    for b, s in zip(begin, slices):
        text[b : b + len(s)] = np.frombuffer(s, dtype=np.uint8) + np.uint8(1)
    n = len(text)
    # A suffix is small if it is less than the next one: told by the next change of byte.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change = np.where(step != 0, np.arange(n), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = step[change] > 0
    small[begin + sizes] = True  # ends of slices
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    starts = np.maximum(sizes - length + 1, 0)
    edge = np.zeros(n + 2, dtype=np.int32)
    live = starts > 0
    np.add.at(edge, begin[live], 1)
    last = begin[live] + starts[live] - 1
    np.add.at(edge, np.maximum(last, next_small[last]) + 1, -1)
    wanted = np.cumsum(edge[:n]) > 0
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, begin[live], 1)
    np.add.at(edge, last + 1, -1)
    window = np.cumsum(edge[:n]) > 0

    view = sliding_window_view(text, length)
    seeds = np.nonzero(wanted & small)[0]
    keys = np.ascontiguousarray(view[seeds]).view(f"S{length}").ravel()
    seeds = seeds[np.argsort(keys, kind="stable")]
    del keys
    first = text[seeds]
    ends = np.searchsorted(first, np.arange(257))
    large = wanted & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def place(found: np.ndarray, c: int) -> np.ndarray:
        """Give the suffixes before ``found`` to their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[large[before]]
        b = text[before]
        same = before[b == c]
        rest, b = before[b != c], b[b != c]
        if len(rest):
            by = np.argsort(b, kind="stable")
            rest, b = rest[by], b[by]
            cuts = np.nonzero(np.diff(b))[0] + 1
            for part in np.split(rest, cuts):
                waiting[text[part[0]]].append(part)
        return same

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else None
        waiting[c] = []
        while wave is not None and len(wave):
            order.append(wave)
            wave = place(wave, c)
        own = seeds[ends[c] : ends[c + 1]]
        if len(own):
            order.append(own)
            place(own, c)
    array = np.concatenate(order) if order else np.zeros(0, np.int64)
    array = array[window[array]]
    flag = np.zeros(n, dtype=bool)
    for a in range(0, len(array) - 1, 16384):
        part = array[a : a + 16385]
        rows = np.ascontiguousarray(view[part]).view(f"S{length}").ravel()
        same = rows[1:] == rows[:-1]
        flag[part[1:][same]] = True
        flag[part[:-1][same]] = True
    return [flag[b : b + k] for b, k in zip(begin, starts)]


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true."""
    d = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.nonzero(d == 1)[0], np.nonzero(d == -1)[0] - 1


def _prepared(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """A row for each document: its text compressed, and its anchors."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column(1).to_pylist()
                found = [anchors(np.frombuffer(t, dtype=np.uint8), length) for t in texts]
                counts = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
                flat = [np.concatenate([f[k] for f in found]) for k in range(5)]
                fields = pa.StructArray.from_arrays(
                    [pa.array(flat[0]), pa.array(flat[4]), *[pa.array(flat[k].astype(np.int32)) for k in (1, 2, 3)]], ["h", "s", "p", "lo", "hi"]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([pack.compress(t) for t in texts], pa.binary()), pa.ListArray.from_arrays(pa.array(counts), fields)],
                    ["_key", "rid", "packed", "anchors"],
                )

    return rows.mapInArrow(run, f"_key {kind}, rid long, packed binary, anchors array<struct<h:long,s:long,p:int,lo:int,hi:int>>")


def _cut_slices(requests: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked slices, keyed so that equal windows meet.

    The slices of an anchor with very many distinct ones are cut into groups of
    FINE windows at one distance from the anchor and keyed also by the bytes that
    all windows of the group share; equal windows still meet, and what meets
    differs in a few outer bytes only, so no task gets all slices of the anchor.
    """
    by_doc = requests.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "p", "lo", "hi", "hot")).alias("asked"))
    rows = by_doc.join(texts, "rid").select("asked", "packed")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            k2, hs, ss, offs, parts, held = [], [], [], [], [], 0
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                data = unpack.decompress(r["packed"])
                for q in r["asked"]:
                    h, p, lo, hi = q["h"], q["p"], q["lo"], q["hi"]
                    if not q["hot"]:
                        pieces = [(h, lo, hi)]
                    else:
                        pieces = []
                        for d in range((lo - p) // FINE, (hi - p) // FINE + 1):
                            inner = data[p + d * FINE + FINE - 1 : p + d * FINE + length]
                            code = int.from_bytes(sha256(inner + d.to_bytes(4, "big", signed=True) + h.to_bytes(8, "big", signed=True)).digest()[:8], "big", signed=True)
                            pieces.append((code, max(lo, p + d * FINE), min(hi, p + d * FINE + FINE - 1)))
                    for code, a, b in pieces:
                        k2.append(code)
                        hs.append(h)
                        ss.append(q["s"])
                        offs.append(a - lo)
                        parts.append(data[a : b + length])
                        held += b + length - a
                if held > 4_000_000:
                    yield _slices_batch(k2, hs, ss, offs, parts)
                    k2, hs, ss, offs, parts, held = [], [], [], [], [], 0
            if k2:
                yield _slices_batch(k2, hs, ss, offs, parts)

    return rows.mapInArrow(run, "k long, h long, s long, off int, slice binary")


def _slices_batch(k2, hs, ss, offs, parts):
    return pa.RecordBatch.from_arrays(
        [pa.array(k2, pa.int64()), pa.array(hs, pa.int64()), pa.array(ss, pa.int64()), pa.array(offs, pa.int32()), pa.array(parts, pa.binary())],
        ["k", "h", "s", "off", "slice"],
    )


def _sorted_slices(slices: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of each slice (``a`` to ``b``, counted from the slice's first window)."""
    dealt = slices.repartition("k").sortWithinPartitions("k")

    def run(batches):
        hs, ss, offs, parts, load = [], [], [], [], 0

        def work():
            index: dict[bytes, int] = {}
            of = np.array([index.setdefault(p, len(index)) for p in parts])
            shared = np.bincount(of)
            runs = []
            for i, flag in enumerate(repeated(list(index), length)):
                runs.append((np.array([0]), np.array([len(flag) - 1])) if shared[i] > 1 else _runs(flag))
            n = np.array([len(runs[i][0]) for i in of])
            if not n.sum():
                return None
            shift = np.repeat(np.array(offs, dtype=np.int64), n)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(hs, dtype=np.int64), n)),
                    pa.array(np.repeat(np.array(ss, dtype=np.int64), n)),
                    pa.array((np.concatenate([runs[i][0] for i in of]) + shift).astype(np.int32)),
                    pa.array((np.concatenate([runs[i][1] for i in of]) + shift).astype(np.int32)),
                ],
                ["h", "s", "a", "b"],
            )

        for _, g in groups(batches, ["k"], ["h", "s", "off", "slice"]):
            if len(g["h"]) < 2:
                continue
            hs += g["h"].tolist()
            ss += g["s"].tolist()
            offs += g["off"].tolist()
            parts += g["slice"].tolist()
            load += sum(map(len, g["slice"])) - (length - 1) * len(g["slice"])
            if load >= CHUNK:
                if (out := work()) is not None:
                    yield out
                hs, ss, offs, parts, load = [], [], [], [], 0
        if parts and (out := work()) is not None:
            yield out

    return dealt.mapInArrow(run, "h long, s long, a int, b int")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Texts count as UTF-8 bytes, a null one as empty; matches stay within documents,
    may overlap, may be of one document, and are judged on the input. Each row gives
    one: the key, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs as start
    and end, in bytes) and ``kept`` (the remaining bytes). Rows with one key or
    equal rows are distinct documents. A text shorter than ``length`` is kept whole.
    """
    spark = docs.sparkSession
    prepared, _ = cut(_prepared(docs, key, text, length))
    every = prepared.select("rid", F.explode("anchors").alias("x")).select("rid", "x.*")
    # Distinct slices of each anchor, with one place of each.
    distinct = every.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "p", "lo", "hi")).alias("r"))
    totals = distinct.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    shared, shared_path = cut(distinct.join(totals, "h").select("h", "s", "n", "kinds", "r"))
    asked = shared.where("kinds > 1").select("h", "s", "r.*", (F.col("kinds") > HOT).alias("hot"))
    runs = _sorted_slices(_cut_slices(asked, prepared.select("rid", "packed"), length), length)
    whole = shared.where("n > 1").select("h", "s", F.lit(0).alias("a"), F.col("r.hi").alias("_hi"), F.col("r.lo").alias("_lo"))
    whole = whole.select("h", "s", "a", (F.col("_hi") - F.col("_lo")).alias("b"))
    found, _ = cut(runs.unionByName(whole).groupBy("h", "s").agg(F.collect_list(F.struct("a", "b")).alias("runs")))
    hits = every.join(found, ["h", "s"]).select("rid", F.transform("runs", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b"))).alias("runs"))
    hits = hits.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    rows = prepared.select("rid", "_key", "packed").join(hits, "rid", "left").select("_key", "packed", "runs")
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sizes, removed, spans, kept = [], [], [], []
                for packed, r in zip(part.column(1).to_pylist(), part.column(2)):
                    data = unpack.decompress(packed)
                    sizes.append(len(data))
                    own, rest, gone, last = [], [], 0, 0
                    if r.is_valid:
                        v = r.values
                        a = v.field("a").to_numpy(zero_copy_only=False).astype(np.int64)
                        b = v.field("b").to_numpy(zero_copy_only=False).astype(np.int64) + length
                        order = np.argsort(a, kind="stable")
                        a, b = a[order], np.maximum.accumulate(b[order])
                        new = np.concatenate(([True], a[1:] > b[:-1]))
                        first = np.nonzero(new)[0]
                        for x, y in zip(a[first].tolist(), b[np.concatenate((first[1:], [len(a)])) - 1].tolist()):
                            own.append({"start": x, "end": y})
                            rest.append(data[last:x])
                            gone, last = gone + y - x, y
                    rest.append(data[last:])
                    spans.append(own)
                    removed.append(gone)
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()),
                    ],
                    ["_key", "n_bytes", "n_removed", "spans", "kept"],
                )

    out = rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    forget(spark, shared_path)
    return out.withColumnRenamed("_key", key)
