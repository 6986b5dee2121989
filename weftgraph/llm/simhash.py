"""Near duplicates by SimHash fingerprints, found in an embedding of segment bit counts."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import cut, forget, groups, hot_groups, split_hot
from .components import connected_components
from .passages import _all_shingles, _raw
from .vectors import _forest

#: Most differing bits of a link, words of a shingle, bits of a segment.
BITS, WORDS, SEGMENT = 4, 4, 2
#: Blocks of segments; any two close fingerprints agree in the counts of BLOCKS - BITS of them.
BLOCKS = 6
#: Rows of a cell that one task compares with each other.
CELL = 4096
#: Rows of a cell up to which all their pairs are compared in one table; large cells that are counted first up to which they are broadcast.
TABLE, BROADCAST_CELLS = 1024, 20_000
#: Bytes of text whose shingles are hashed together.
TOGETHER = 1 << 21
#: Of the deduplication of documents: words of a shingle, bits (of 128) between candidates, similarity, texts of a group that one task compares.
STAGE_WORDS, STAGE_BITS, SIMILAR, GROUP = 5, 28, 0.8, 2048


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``fp`` (long): the majority bits of the XXH64 of all word shingles.

    A-Z is lower-cased, words are runs without ASCII white space, shingles are
    joined by spaces and repeats count; a text with fewer words is one shingle, one
    without words (or null) gets 0. The hashes are made by the engine; only their
    bits are counted in Python, one text at a time. Without ``keep_text`` the text
    itself does not go through Python.
    """
    docs = docs.drop("fp")
    t = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("_words", parts)
    n = F.size("_words")
    shingles = F.when(
        n > words,
        F.transform(
            F.sequence(F.lit(1), n - words + 1),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at("_words", i + k) for k in range(words)])),
        ),
    ).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", "_words"))))
    rows = rows.withColumn("_hashes", shingles).drop("_words")
    if not keep_text:
        docs, rows = docs.drop(text), rows.drop(text)
    schema = T.StructType(list(docs.schema.fields)).add("fp", "long")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            starts = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(batch.num_rows):
                h = values[starts[i] : starts[i + 1]] if valid[i] else values[:0]
                if not len(h):
                    continue
                count = np.zeros(64, dtype=np.int64)
                for a in range(0, len(h), 1 << 16):
                    piece = h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
                    count += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * count > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], schema.names)

    return rows.mapInArrow(run, schema)


def _other(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return h ^ (h >> np.uint64(27))


#: For each byte its bits, the highest first, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _set_bits(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many of the hashes of each stretch (none empty, from ``begin`` on, the last bound included) have each of 64 bits, the highest first.

    Runs of 255 hashes at most are added up in lanes of a byte, and runs to stretches.
    """
    sizes = np.diff(begin)
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begin[:-1] - 255 * first, runs) + 255 * np.arange(runs.sum())
    out = np.zeros((len(runs), 64), dtype=np.int64)
    for a in range(0, len(starts), 512):
        x, y = starts[a], starts[a + 512] if a + 512 < len(starts) else begin[-1]
        lanes = _LANES[h[x:y].astype(">u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, starts[a : a + 512] - x, axis=0).view(np.uint8)
        owner = np.searchsorted(first, np.arange(a, a + len(sums)), side="right") - 1
        new = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1))
        out[owner[new]] += np.add.reduceat(sums, new, axis=0, dtype=np.int64)
    return out


def wide_fingerprints(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` without ``text``, with ``fp`` and ``fq`` (longs): 128 majority bits of the hashes of all word shingles.

    Words are those of :func:`_sets`. A text with fewer words is one shingle, one without
    words (or null) gets 0; of a bit that half the hashes have, the least hash decides.
    """
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in kept]).add("fp", "long").add("fq", "long")

    def made(texts):
        raw = _raw(texts)
        h, begin = _all_shingles(raw, words, wide=True)
        out = np.zeros((2, len(raw)), dtype=np.uint64)
        for k in np.nonzero(np.diff(begin) == 0)[0].tolist():
            if w := raw[k].split():
                out[0, k] = xxhash.xxh64_intdigest(b" ".join(w))
                out[1, k] = _other(out[0, k : k + 1])[0]
        some = np.nonzero(np.diff(begin))[0]
        if len(some):
            borders, n = np.concatenate((begin[some], begin[-1:])), np.diff(begin)[some][:, None]
            least = np.minimum.reduceat(h, borders[:-1])
            for k, change in enumerate((lambda x: x, _other)):
                count = 2 * _set_bits(change(h), borders)
                own = np.unpackbits(change(least).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) > 0
                out[k, some] = np.packbits((count > n) | (count == n) & own, axis=1).view(">u8").ravel()
        return out.view(np.int64)

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(pc.fill_null(batch.column(len(kept)), "")).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                held = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, held + TOGETHER, side="right")))
                part = batch.slice(a, b - a)
                out = made(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x) for x in out]], schema.names)
                a = b

    return docs.select(*kept, text).mapInArrow(run, schema)


def _counts():
    """Bit counts of all two-bit segments of ``fp``, side by side in their own two bits."""
    odd = 0x5555555555555555
    low, high = F.col("fp").bitwiseAND(F.lit(odd)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(odd))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(fps: DataFrame) -> DataFrame:
    """Each fingerprint in the grid cells of its embedding.

    The embedding counts the bits of every segment. Two fingerprints that differ in
    at most BITS bits are within BITS of each other in Manhattan distance there (a
    lower bound), so of BLOCKS blocks of segments at most BITS can have moved at
    all: the pair shares the cell of some BLOCKS - BITS whole blocks. There is one
    grid for each choice of those.
    """
    n = 64 // SEGMENT
    edges = [round(b * n / BLOCKS) * SEGMENT for b in range(BLOCKS + 1)]

    def block(b: int):
        mask = (1 << (edges[b + 1] - edges[b])) - 1
        return F.shiftrightunsigned(F.col("_counts"), edges[b]).bitwiseAND(F.lit(mask))

    grids = list(combinations(range(BLOCKS), BLOCKS - BITS))
    cells = []
    for g, blocks in enumerate(grids):
        key = F.lit(g).cast("long")
        for b in blocks:
            key = F.shiftleft(key, edges[b + 1] - edges[b]).bitwiseOR(block(b))
        cells.append(key)
    return fps.select("fp", _counts().alias("_counts")).select("fp", F.explode(F.array(*cells)).alias("cell"))


def _wide_cells(fps: DataFrame, rows: int, similar: float) -> DataFrame:
    """Each fingerprint in cells of grids over some of the segments, for links of more bits than whole blocks can stand.

    How many segments a grid takes follows from the number of ``rows``, so a cell holds
    some hundred of them at any size; how many grids there are follows from the chance
    that two texts that are just ``similar`` agree in all segments of a grid.
    """
    p = math.acos(2 * similar / (1 + similar)) / math.pi  # the share of bits in which they differ
    alike = (1 - p) ** 2 + p * p / 2  # a segment counts the same: no bit moved, or both and crosswise
    each = min(64 // SEGMENT, max(3, math.ceil(math.log2(max(2, rows / 200)) / 1.5)))
    grids = math.ceil(math.log(0.05) / math.log1p(-(alike**each)))
    rng = np.random.default_rng(64)
    cells = []
    for g in range(grids):
        mask = sum(3 << (SEGMENT * int(k)) for k in rng.choice(64 // SEGMENT, each, replace=False))
        cells.append(F.xxhash64(F.lit(g), F.col("_counts").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return fps.select("fp", "fq", _counts().alias("_counts")).select("fp", "fq", F.explode(F.array(*cells)).alias("cell"))


def _spanned(fp: np.ndarray, fq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a cell (wide fingerprints) that links inside it connect, each with the first one of its group, as places."""
    n = len(fp)
    if n <= TABLE:  # all pairs at once
        near = np.bitwise_count(fp[:, None] ^ fp)
        near += np.bitwise_count(fq[:, None] ^ fq)
        x, y = np.nonzero(near <= bits)
        own = x < y
        return _forest(n, x[own], y[own])
    total = np.bitwise_count(fp).astype(np.int16) + np.bitwise_count(fq)
    rest = np.argsort(total, kind="stable")
    total = total[rest]
    child, root = [], []
    while len(rest) > 1:
        start, front = rest[0], [rest[0]]
        rest, total = rest[1:], total[1:]
        while front and len(rest):
            v = front.pop()
            t = int(np.bitwise_count(fp[v])) + int(np.bitwise_count(fq[v]))
            a, b = np.searchsorted(total, t - bits, "left"), np.searchsorted(total, t + bits, "right")
            some = rest[a:b]
            hit = np.nonzero(np.bitwise_count(fp[some] ^ fp[v]) + np.bitwise_count(fq[some] ^ fq[v]) <= bits)[0]
            if len(hit):
                new = some[hit]
                child.append(new)
                root.append(np.full(len(new), start))
                front.extend(new)
                keep = np.ones(len(rest), dtype=bool)
                keep[a + hit] = False
                rest, total = rest[keep], total[keep]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(child), np.concatenate(root)) if child else (none, none)


def wide_links(fps: DataFrame, bits: int, similar: float) -> DataFrame:
    """Edges ``a``, ``b`` between ``id``s that connect wide fingerprints (distinct ``id``, ``fp``, ``fq``) within ``bits`` of each other.

    A pair of texts that are just ``similar`` shares a cell with a chance of 95 %, nearer
    ones with a higher one. Large cells are dealt out as those of :func:`links` are.
    """
    cells = _wide_cells(fps, fps.count(), similar)
    large, _ = cut(hot_groups(cells, ["cell"], CELL))
    if large.count() <= BROADCAST_CELLS:
        large = F.broadcast(large)
    dealt = split_hot(cells, ["cell"], F.xxhash64("fp", "fq"), CELL, large)
    dealt = dealt.select("cell", "_b0", "_b1", "fp", "fq").repartition("cell", "_b0", "_b1").sortWithinPartitions("cell", "_b0", "_b1")

    def run(batches):
        out, held = [[], [], [], []], 0
        for _, g in groups(batches, ["cell", "_b0", "_b1"], ["fp", "fq"]):
            if len(g["fp"]) < 2:
                continue
            fp, fq = (g[k].astype(np.int64).view(np.uint64) for k in ("fp", "fq"))
            x, y = _spanned(fp, fq, bits)
            if len(x):
                for o, v in zip(out, (fp[x], fq[x], fp[y], fq[y])):
                    o.append(v.view(np.int64))
                held += len(x)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["p", "q", "r", "s"])
                out, held = [[], [], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["p", "q", "r", "s"])

    found = dealt.mapInArrow(run, "p long, q long, r long, s long")
    return found.select(F.xxhash64("p", "q").alias("a"), F.xxhash64("r", "s").alias("b")).distinct()


def _reached(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a cell that links inside it connect, each with one representative.

    Breadth first; what is reached leaves the cell, so a tight group of n costs
    about n steps over a shrinking rest and puts out n rows, never its pairs. The
    total bit counts bound the range of the rest that is compared.
    """
    fps = np.unique(fps)
    total = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(total, kind="stable")
    rest, total = fps[order], total[order]
    child, root = [], []
    while len(rest) > 1:
        start = rest[0]
        front = [start]
        rest, total = rest[1:], total[1:]
        while front and len(rest):
            v = front.pop()
            t = int(np.bitwise_count(v))
            a, b = np.searchsorted(total, t - bits, "left"), np.searchsorted(total, t + bits, "right")
            if a == b:
                continue
            hit = np.nonzero(np.bitwise_count(rest[a:b] ^ v) <= bits)[0]
            if len(hit):
                new = rest[a:b][hit]
                child.append(new)
                root.append(np.full(len(new), start))
                front.extend(new)
                keep = np.ones(len(rest), dtype=bool)
                keep[a + hit] = False
                rest, total = rest[keep], total[keep]
    if not child:
        return fps[:0], fps[:0]
    return np.concatenate(child), np.concatenate(root)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints (distinct longs) within ``bits`` of each other.

    Cells with over CELL rows are dealt out as pairs of blocks, so a task holds two
    blocks at most and every pair of fingerprints that shares a cell still meets.
    """
    if bits >= BLOCKS:
        raise ValueError("more bits than the grids are made for")
    dealt = split_hot(_cells(fps), ["cell"], F.xxhash64("fp"), CELL)
    dealt = dealt.select("cell", "_b0", "_b1", "fp").repartition("cell", "_b0", "_b1").sortWithinPartitions("cell", "_b0", "_b1")

    def run(batches):
        a, b, held = [], [], 0
        for _, group in groups(batches, ["cell", "_b0", "_b1"], ["fp"]):
            if len(group["fp"]) < 2:
                continue
            x, y = _reached(group["fp"].astype(np.int64).view(np.uint64), bits)
            if len(x):
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
                held += len(x)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document: ``_key``, ``fp``, two hashes of the text, the component's ``root`` (a fingerprint) and ``component_id``."""
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), F.col(text)).alias("_h2"), F.col(text).alias("_text"))
    rows, _ = cut(fingerprints(slim, "_text", keep_text=False))
    fps = rows.groupBy("fp").agg(F.min("_key").alias("least"))
    roots = connected_components(links(fps.select("fp")))
    labelled = fps.join(roots, fps["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("fp", "root", "component_id"), "fp")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's key, ``fp`` and ``component_id``: the smallest key it reaches over links.

    Documents with one fingerprint are one vertex, whatever their number. Texts
    without words have fingerprint 0 and link like any other. A null key never is a
    component's id unless the whole component has none. Repeated rows each get a row.
    """
    return _labelled(docs, key, text).select(F.col("_key").alias(key), "fp", "component_id")


class _Kept:
    """Sets that were kept, found again by what sets must share.

    Of two sets that are similar enough, the parts of each that hold its least elements,
    all but the share that may be missing, have an element in common; so sets are
    looked up by those elements only, and none is passed over.
    """

    def __init__(self, least: float):
        self.least, self.sets, self.holders = least, [], {}

    def add(self, x: np.ndarray) -> bool:
        """Keep a sorted set unless it is similar to one that is kept; two empty sets are equal."""
        head = x[: len(x) - math.ceil(self.least * len(x) - 1e-9) + 1].tolist() or [-1]
        seen = {k for v in head for k in self.holders.get(v, ())}
        for k in sorted(seen):
            y = self.sets[k]
            if min(len(x), len(y)) < self.least * max(len(x), len(y)):
                continue
            if not len(x):
                return False
            both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
            if both >= self.least * (len(x) + len(y) - both):
                return False
        for v in head:
            self.holders.setdefault(v, []).append(len(self.sets))
        self.sets.append(x)
        return True


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    """The set of five-word shingles of each text (fewer words: the whole sequence; none: empty) as sorted hashes."""
    raw = _raw(texts)
    sh, begin = _all_shingles(raw)
    out = [np.unique(sh[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
    for k, r in enumerate(raw):
        if not len(out[k]) and (w := r.split()):
            out[k] = np.array([xxhash.xxh32_intdigest(b" ".join(w))], dtype=np.uint32)
    return out


def _led(rows: DataFrame, similar: float) -> DataFrame:
    """Of the rows of each ``g``, in their order, those that are similar to none that was kept before them.

    A group streams through: only the sets of kept rows are held.
    """
    kind = rows.schema["_key"].dataType.simpleString()
    names = ["g", "root", "_n", "_key", "_h1", "_h2"]
    dealt = rows.repartition("g").sortWithinPartitions("g", F.col("_key").asc_nulls_last(), "_h1", "_h2")

    def run(batches):
        now, kept = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                given = part.column(7).to_pylist()
                fresh = _sets([None if p is not None else t for p, t in zip(given, part.column(6).to_pylist())])
                sets = [np.frombuffer(p, dtype=np.uint32) if p is not None else x for p, x in zip(given, fresh)]
                stay = []
                for k, g in enumerate(part.column(0).to_pylist()):
                    if g != now:
                        now, kept = g, _Kept(similar)
                    if kept.add(sets[k]):
                        stay.append(k)
                if stay:
                    out = part.take(pa.array(stay))
                    yield pa.RecordBatch.from_arrays([*out.columns[:6], pa.array([sets[k].tobytes() for k in stay], pa.binary())], [*names, "_set"])

    return dealt.select(*names, "_text", "_set").mapInArrow(run, f"g long, root long, _n long, _key {kind}, _h1 long, _h2 long, _set binary")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS, bits: int = STAGE_BITS, similar: float = SIMILAR) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``similar`` or more.

    Fingerprints (of 128 bits) of five-word shingles within ``bits`` of each other make
    candidate groups; in each, documents are kept in the order of their keys (null last), and one
    goes only if it is similar to a kept one, which is verified on the whole texts.
    Groups of over GROUP texts are dealt out in blocks first, and what the blocks keep
    is held against each other; so every document that goes was similar to one before
    it. Equal texts are one (of rows that share key and text, one stays); null and
    empty texts are equal. A document without a near copy always stays. Documents are
    told apart by key and content; all columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    row = ["_key", "_h1", "_h2"]
    plain = F.coalesce(F.col(text), F.lit(""))
    named = [F.col(key).alias("_key"), F.xxhash64(plain).alias("_h1"), F.xxhash64(F.lit(7), plain).alias("_h2"), plain.alias("_text")]
    slim = docs.select(*named)
    rows, rows_path = cut(wide_fingerprints(slim, "_text", words))
    once = rows.groupBy(*row).agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("fq").alias("fq"))
    least = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "n")).alias("x")
    contents, contents_path = cut(once.groupBy("_h1", "_h2").agg(least, F.first("fp").alias("fp"), F.first("fq").alias("fq")).select("_h1", "_h2", "x._key", F.col("x.n").alias("_n"), "fp", "fq", F.xxhash64("fp", "fq").alias("id")))
    roots = connected_components(wide_links(contents.select("id", "fp", "fq").distinct(), bits, similar))
    labelled = contents.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    labelled, labelled_path = cut(labelled.join(sizes, "root").select(*row, "_n", "root", "size"))
    forget(spark, rows_path)
    forget(spark, contents_path)
    several = labelled.where("size > 1").select(*[F.col(n).alias("m" + n) for n in row], "_n", "root", F.ceil(F.col("size") / GROUP).alias("blocks"))
    texts = slim.join(several, [slim[n].eqNullSafe(several["m" + n]) for n in row])
    block = F.pmod(F.xxhash64("_h2"), F.col("blocks"))
    texts = texts.select(F.xxhash64("root", block).alias("g"), "root", "_n", *row, "_text", F.lit(None).cast("binary").alias("_set"), "blocks")
    led, led_path = cut(_led(texts, similar))
    split = labelled.where(F.col("size") > GROUP).select("root").distinct()
    again = led.join(split, "root").select(F.xxhash64(F.lit(1), "root").alias("g"), "root", "_n", *row, F.lit(None).cast("string").alias("_text"), "_set")
    whole = led.join(split, "root", "left_anti")
    stay = labelled.where("size = 1").select(*row, "_n").unionByName(whole.select(*row, "_n")).unionByName(_led(again, similar).select(*row, "_n"))
    found, _ = cut(stay)
    forget(spark, led_path)
    forget(spark, labelled_path)
    kept = found.select(*[F.col(n).alias("k" + n) for n in row])
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *named[:3])
    out = out.join(kept, [out[n].eqNullSafe(kept["k" + n]) for n in row], "left_semi")
    if not found.where("_n > 1").isEmpty():
        out = out.dropDuplicates(row)
    return out.select(*[F.col("_row")[c].alias(c) for c in names])
