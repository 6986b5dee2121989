"""Near-duplicate passages by compact windows over min-hashed word shingles."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, groups
from .components import connected_components
from .suffix_dedup import _least
from .suffix_dedup import _tables as _powers
from .vectors import _forest

#: Words of a shingle, shingles of the shortest passage (50 words), least Jaccard similarity, hash functions.
WORDS, SHORTEST, SIMILAR, FUNCTIONS = 5, 46, 0.8, 2
#: Contexts of a value in a block; values with more are dealt out as pairs of blocks.
HOT = 8192
#: Rounds of leaders after which groups that still have more than so many contexts are finished by what contexts share.
ROUNDS, MANY = 3, 48
#: Words prepared together; contexts verified together.
TOGETHER, VERIFIED = 200_000, 8192
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1) for k in range(FUNCTIONS)]


def _mixed(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


#: White space beyond ASCII at which words are split, and that of ASCII.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_PIECE = 1 << 22


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some UTF-8 text begins, and its hash, told from running sums of the bytes in pieces that end at white space."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    whole = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < len(whole):
        end = min(len(whole), at + _PIECE)
        while end < len(whole) and not _SPACE[whole[end - 1]]:
            more = np.nonzero(_SPACE[whole[end : end + _PIECE]])[0]
            end = end + int(more[0]) + 1 if len(more) else min(len(whole), end + _PIECE)
        x = whole[at:end]
        n = len(x)
        up, down = _powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        edge = np.diff(np.concatenate(([True], _SPACE[x], [True])).astype(np.int8))
        a, b = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        with np.errstate(over="ignore"):
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
            hashes.append(_mixed((prefix[b] - prefix[a]) * down[a], np.uint64(41)))
        starts.append(a + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(text: str | None) -> np.ndarray:
    """32-bit hashes of the five-word shingles of a text in lower case (none, if it has fewer words)."""
    return _all_shingles(_raw([text]))[0]


def compact_windows(values: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Windows (first, centre, last): every stretch within first..last that holds the centre has its least value there.

    They are the nodes of the Cartesian tree of the values whose span is at least
    ``shortest`` long; together they cover each such stretch exactly once.
    """
    out = []
    stack = [(0, len(values))]
    while stack:
        a, b = stack.pop()
        while b - a >= shortest:
            c = a + int(values[a:b].argmin())
            out.append((a, c, b - 1))
            if c - a >= shortest:
                stack.append((a, c))
            a = c + 1
    return out


def _raw(texts: list[str | None]) -> list[bytes]:
    """Texts in lower case, with ASCII white space only, as UTF-8."""
    plain = [t.lower() if t else "" for t in texts]
    return [(t if t.isascii() else _WIDE.sub(" ", t)).encode("utf-8", "replace") for t in plain]


def _all_shingles(raw: list[bytes], words: int = WORDS, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of some texts, one after the other, and where each text's begin (and the last ones end); ``wide``: of 64 bits."""
    border = np.cumsum([0] + [len(r) + 1 for r in raw])
    places, w = _word_hashes(b" ".join(raw))
    sizes = np.diff(np.searchsorted(places, border))
    n = max(0, len(w) - words + 1)
    x = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            x = x * np.uint64(0x100000001B3) + w[k : k + n]
    own = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n) >= words  # those that do not run into the next text
    counts = np.maximum(0, sizes - words + 1)
    hashes = _mixed(x[own], np.uint64(77))
    return hashes if wide else (hashes >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))


def _all_windows(sh: np.ndarray, begin: np.ndarray, j: int) -> tuple[np.ndarray, ...]:
    """The compact windows of all texts under function ``j``: value, centre, first and last shingle that a SHORTEST-long stretch reaches.

    The nodes of a text's Cartesian tree that span at least SHORTEST shingles are the
    least ones of its stretches of that length, so running minima give them all at
    once; what a node's stretches reach is its window cut to SHORTEST on either side.
    """
    v = _mixed(sh.astype(np.uint64), _SEEDS[j])
    n = len(sh)
    none = np.zeros(0, dtype=np.int64)
    if n < SHORTEST:
        return none, none, none, none
    packed = (v >> np.uint64(26) << np.uint64(26)) | np.arange(n, dtype=np.uint64)
    place = (_least(packed, SHORTEST) & np.uint64((1 << 26) - 1)).astype(np.int64)
    starts = np.arange(len(place))
    starts = starts[np.repeat(begin[1:], np.diff(begin))[: len(place)] - starts >= SHORTEST]
    if not len(starts):
        return none, none, none, none
    centre = place[starts]
    first = np.concatenate(([True], centre[1:] != centre[:-1]))
    at = np.nonzero(first)[0]
    last = np.concatenate((at[1:], [len(centre)])) - 1
    return v[centre[at]].view(np.int64) ^ j, centre[at], starts[at], starts[last] + SHORTEST - 1


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document: its text compressed and its compact windows, each cut to what its centre can reach.

    Of a window: value ``h``, content ``s`` and ``at``, the centre's place and the
    reach to its left and right side by side (48, 6 and 6 bits).
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    kind = rows.schema["_key"].dataType.simpleString()

    def made(part):
        raw = _raw(part.column(1).to_pylist())
        sh, begin = _all_shingles(raw)
        if len(sh) >= 1 << 26:
            raise OverflowError("a text of over 67 million words")
        n = len(sh)
        up, down = _powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        columns = []
        with np.errstate(over="ignore"):
            np.cumsum((sh.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
            for j in range(FUNCTIONS):
                h, c, lo, hi = _all_windows(sh, begin, j)
                content = (prefix[hi + 1] - prefix[lo]) * down[lo]
                s = _mixed(content, np.uint64(0x1234567)) + _mixed(((c - lo) << 6 | (hi - c)).astype(np.uint64), np.uint64(99))
                columns.append((h, s.view(np.int64), c, c - lo, hi - c))
        h, s, c, left, right = (np.concatenate(x) for x in zip(*columns))
        doc = np.searchsorted(begin, c, side="right") - 1
        order = np.argsort(doc, kind="stable")
        at = (c - begin[doc]) << 12 | left << 6 | right
        structs = pa.StructArray.from_arrays([pa.array(x[order], pa.int64()) for x in (h, s, at)], ["h", "s", "at"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32)
        pack = zstandard.ZstdCompressor(level=3)
        packed = [pack.compress(r) for r in raw]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), structs)],
            ["_key", "rid", "packed", "windows"],
        )

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                held = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, held + 6 * TOGETHER, side="right")))
                yield made(batch.slice(a, b - a))
                a = b

    return rows.mapInArrow(run, f"_key {kind}, rid long, packed binary, windows array<struct<h:long,s:long,at:long>>")


_NEED = int(np.ceil(2 * SHORTEST * SIMILAR / (1 + SIMILAR) - 1e-9))


def _covered(a: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which SHORTEST-long stretches of ``a`` have enough shingles in the sorted ``other``."""
    at = other.searchsorted(a)
    at[at == len(other)] = 0
    hit = np.zeros(len(a) + 1, dtype=np.int32)
    np.cumsum(other[at] == a, out=hit[1:])
    return hit[SHORTEST:] - hit[:-SHORTEST] >= _NEED


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which SHORTEST-long stretches of ``a`` and of ``b`` have a counterpart in the other.

    A stretch counts where so many of its shingles are in the other context that the
    Jaccard similarity to a stretch of its length there reaches SIMILAR.
    """
    return _covered(a, np.sort(b)), _covered(b, np.sort(a))


_SIDE = SHORTEST - 1  # shingles that a context has on either side of its centre, at most
_WIDTH = 2 * _SIDE + 1


def _stretches(hit: np.ndarray) -> np.ndarray:
    """For each row of cells: which SHORTEST-long stretches have enough hits."""
    n = np.zeros((len(hit), _WIDTH + 1), dtype=np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=n[:, 1:])
    return n[:, SHORTEST:] - n[:, :-SHORTEST] >= _NEED


def _spread(some: np.ndarray) -> np.ndarray:
    """For each row of stretches: the cells of those that are true."""
    d = np.zeros((len(some), _WIDTH + 1), dtype=np.int16)
    d[:, : _WIDTH - SHORTEST + 1] += some
    d[:, SHORTEST:] -= some
    return np.cumsum(d[:, :-1], axis=1, dtype=np.int16) > 0


def _verified(group: np.ndarray, centres: np.ndarray, bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches of each context have a counterpart in another one of its group (ascending), and the least row of its class.

    A stretch of SHORTEST shingles around the centre has a counterpart in a context
    that holds enough of its shingles. Only shingles that lie in a stretch of which
    enough shingles are held by others count (a pair of stretches that are alike
    consists of such). In each round every group has one leader, the context with the
    most shared shingles left, that is held against all others; those whose shared
    shingles the leader has all tell nothing more and leave with it: whatever links
    to them links to the leader. Two contexts of one class whose stretches all have
    counterparts already are not compared, and a group of such is done. Groups that
    are large after some rounds are finished by looking up, for each context that is
    not settled, those that hold one of its rarest shingles. So contexts are held
    against few others, and none is passed over for a group's size.
    """
    n = len(bodies)
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=n)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(_SIDE - centres, sizes)
    flat = np.concatenate(bodies) if n else np.zeros(0, np.uint32)
    filled = np.zeros((n, _WIDTH), dtype=bool)
    filled[row, column] = True
    whole = filled[:, : _WIDTH - SHORTEST + 1] & filled[:, SHORTEST - 1 :]
    # Shingles that occur twice in the group.
    keys = group[row].astype(np.uint64) << np.uint64(32) | flat
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    none = len(twice)
    slot = np.zeros(1 << 22, dtype=bool)
    mixed = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    with np.errstate(over="ignore"):
        slot[mixed(twice)] = True
        maybe = np.nonzero(slot[mixed(keys)])[0]
    ids = np.full((n, _WIDTH), none, dtype=np.int32)
    if none:
        at = np.minimum(np.searchsorted(twice, keys[maybe]), none - 1)
        fine = twice[at] == keys[maybe]
        ids[row[maybe[fine]], column[maybe[fine]]] = at[fine]
    possible = _stretches(ids < none) & whole
    ids[~_spread(possible)] = none
    shared = ids < none
    flags = np.zeros_like(possible)
    label = np.arange(n)
    live = np.nonzero(possible.any(axis=1))[0]
    live = live[np.lexsort((-shared[live].sum(axis=1), group[live]))]
    settled = np.zeros(n, dtype=bool)  # all its possible stretches have a counterpart
    led, cell = np.zeros(none + 1, dtype=bool), np.zeros(none + 1, dtype=np.int64)
    start, df = np.zeros(none + 1, dtype=np.int64), np.zeros(none + 1, dtype=np.int64)

    def held(p, q, stand, double):
        """Hold contexts against their leaders (which ``led`` and ``cell`` tell of): those that share enough, and of these who tells nothing more and who is linked."""
        have = led[ids[p]]
        near = (np.count_nonzero(have, axis=1) >= _NEED) | double
        p, q, have = p[near], q[near], have[near]
        own = _stretches(have) & whole[p]
        done = ~(shared[p] & ~have).any(axis=1)
        x, y = np.nonzero(have)
        theirs = np.zeros_like(have)
        theirs[x, cell[ids[p[x], y]]] = True
        other = _stretches(np.take_along_axis(theirs, stand[near], axis=1) & shared[q]) & whole[q]
        flags[p] |= own
        if len(q):
            new = np.concatenate(([0], np.nonzero(q[1:] != q[:-1])[0] + 1))
            flags[q[new]] |= np.logical_or.reduceat(other, new, axis=0)
        both = np.concatenate((p, q))
        settled[both] = ~(possible[both] & ~flags[both]).any(axis=1)
        return near, done, own.any(axis=1) | other.any(axis=1)

    def finish(rows):
        """Hold the contexts of one group that are left against those that can be like them; the labels that meet.

        A stretch is covered only by contexts that hold one of any SHORTEST - _NEED + 1
        of its shingles (places, repeats included), and its rarest ones tell the fewest.
        Contexts of the group's commonest shingles come first, so most are soon settled
        in the first one's class and need not ask. Those that end in another class are
        looked up among the rarest shingles of those that did not ask for all stretches.
        """
        m = len(rows)
        r, c = np.nonzero(shared[rows])
        pair = np.unique(ids[rows[r], c].astype(np.int64) * m + r)
        v, r = pair // m, pair % m
        known, begin, count = np.unique(v, return_index=True, return_counts=True)
        start[known], df[known] = begin, count
        common = np.bincount(r, df[v], minlength=m) / np.maximum(1, np.bincount(r, minlength=m))

        def rare(q, some):
            """Shingles of which one is in each context that covers any of some stretches."""
            out, k = [], 0
            while k < len(some):
                e = k + int(np.searchsorted(some[k:], some[k] + 8))
                x = ids[q, some[e - 1] : some[k] + SHORTEST]
                out.append(x[np.argpartition(df[x], SHORTEST - _NEED)[: SHORTEST - _NEED + 1]])
                k = e
            x = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
            return x[x < none]

        mine, moved = label[rows], np.zeros(n, dtype=bool)
        xs, ys = [], []

        def against(u, some):
            q = rows[u]
            some = some[some != u]
            some = some[~(settled[rows[some]] & settled[q] & (mine[some] == mine[u]))]
            if not len(some):
                return
            led[ids[q]] = True
            led[none] = False
            cell[ids[q]] = np.arange(_WIDTH)
            stand = cell[ids[q]]
            double = (shared[q] & (stand != np.arange(_WIDTH))).any()
            for a in range(0, len(some), 4096):
                w = some[a : a + 4096]
                near, _, linked = held(rows[w], np.full(len(w), q), np.broadcast_to(stand, (len(w), _WIDTH)), np.full(len(w), double))
                others = np.unique(mine[w[near][linked]])
                xs.append(others)
                ys.append(np.full(len(others), mine[u]))
                moved[others] = True
                mine[moved[mine]] = mine[u]
                moved[others] = False
            led[ids[q]] = False

        order = np.argsort(-common, kind="stable")
        main, whole_asked = order[0], np.zeros(m, dtype=bool)
        against(main, np.arange(m))
        whole_asked[main] = True
        for u in order[1:].tolist():
            q, inside = rows[u], mine[u] == mine[main]
            if settled[q] and inside:
                continue
            whole_asked[u] = not inside
            x = rare(q, np.nonzero(possible[q] & ~flags[q] if inside else possible[q])[0])
            met = [r[start[k] : start[k] + df[k]] for k in x.tolist()]
            if met:
                against(u, np.unique(np.concatenate(met)))
        apart = np.nonzero(mine != mine[main])[0]
        if len(apart):
            own = [(k, u) for u in np.nonzero(~whole_asked)[0].tolist() for k in rare(rows[u], np.nonzero(possible[rows[u]])[0]).tolist()]
            if own:
                k, u = np.array(sorted(own)).T
                for w in apart.tolist():
                    x = np.unique(ids[rows[w]][shared[rows[w]]])
                    met = [u[i:j] for i, j in zip(np.searchsorted(k, x).tolist(), np.searchsorted(k, x, side="right").tolist()) if i < j]
                    if met:
                        against(w, np.unique(np.concatenate(met)))
        df[known] = 0
        return xs, ys

    def join(xs, ys):
        nonlocal label
        x, y = _forest(n, np.concatenate(xs), np.concatenate(ys))
        if len(x):
            to = np.arange(n)
            to[x] = y
            label = to[label]

    turn = 0
    while len(live):
        turn += 1
        if turn % ROUNDS == 0:
            g = group[live]
            at = np.nonzero(np.concatenate(([True], g[1:] != g[:-1])))[0]
            sizes = np.diff(np.append(at, len(live)))
            found = [finish(live[a : a + m]) for a, m in zip(at.tolist(), sizes.tolist()) if m > MANY]
            if xs := [x for f in found for x in f[0]]:
                join(xs, [y for f in found for y in f[1]])
            live = live[np.repeat(sizes <= MANY, sizes)]
            if not len(live):
                break
        g = group[live]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        at = np.nonzero(first)[0]
        leader = np.repeat(live[at], np.diff(np.append(at, len(live))))
        news = ~(settled[live] & settled[leader] & (label[live] == label[leader]))
        more = np.logical_or.reduceat(news, at)  # groups that are one settled class are done
        if not more.all():
            keep = np.repeat(more, np.diff(np.append(at, len(live))))
            live = live[keep]
            continue
        rest = ~first
        i, k = live[rest], leader[rest]
        gone = np.zeros(len(i), dtype=bool)
        useful = np.nonzero(news[rest])[0]
        xs, ys = [], []
        heads = live[at]
        which = np.cumsum(first)[rest] - 1
        led[ids[heads]] = True
        led[none] = False
        cell[ids[heads]] = np.arange(_WIDTH)
        stand = cell[ids[heads]]  # of equal shingles of a leader one stands for all
        double = (shared[heads] & (stand != np.arange(_WIDTH))).any(axis=1)
        for a in range(0, len(useful), 4096):
            w = useful[a : a + 4096]
            p, q = i[w], k[w]
            near, done, linked = held(p, q, stand[which[w]], double[which[w]])
            w = w[near]
            xs.append(label[p[near][linked]])
            ys.append(label[q[near][linked]])
            gone[w] = done & linked
        led[ids[heads]] = False
        if xs:
            join(xs, ys)
        stay = rest.copy()
        stay[np.nonzero(rest)[0][gone]] = False
        live = live[stay]
    return flags, label


def _contexts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The shingles of the asked windows; those of a value in ``blocks`` blocks go to each pair that theirs is in."""
    by_doc = asked.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "at", "blocks")).alias("asked"))
    rows = by_doc.join(texts, "rid").select("asked", "packed")
    names = ["k", "h", "s", "centre", "body"]

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            lists, bodies = batch.column(0), batch.column(1)
            starts = lists.offsets.to_numpy()
            h, s, at, n = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            unpack = zstandard.ZstdDecompressor()
            for i in range(batch.num_rows):
                if i % 100 == 0:
                    sh, begin = _all_shingles([unpack.decompress(b) for b in bodies.slice(i, 100).to_pylist()])
                own = begin[i % 100]
                for q in range(starts[i], starts[i + 1]):
                    c, left, right = int(at[q]) >> 12, int(at[q]) >> 6 & 63, int(at[q]) & 63
                    body = sh[own + c - left : own + c + right + 1].tobytes()
                    m, mine = int(n[q]), int(s[q]) % int(n[q])
                    pairs = [f"{h[q]},{min(mine, o)},{max(mine, o)}" for o in range(m) if o != mine]
                    for code in [xxhash.xxh64_intdigest(x) - (1 << 63) for x in pairs] or [h[q]]:
                        for x, y in zip(out, (code, h[q], s[q], left, body)):
                            x.append(y)
                    if len(out[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                        out = [[], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return rows.mapInArrow(run, "k long, h long, s long, centre int, body binary")


def _compared(contexts: DataFrame) -> DataFrame:
    """Of the contexts that have a counterpart: runs of stretches that do (first and last shingle), and their class."""
    dealt = contexts.repartition("k").sortWithinPartitions("k", "s")

    def work(held):
        sizes = [len(g["h"]) for g in held]
        h, s, c = (np.concatenate([g[x] for g in held]).astype(np.int64) for x in ("h", "s", "centre"))
        bodies = [np.frombuffer(b, dtype=np.uint32) for g in held for b in g["body"]]
        flags, label = _verified(np.repeat(np.arange(len(held)), sizes), c, bodies)
        d = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(d == 1)
        if not len(row):
            return None
        b = np.nonzero(d == -1)[1]
        shift = c[row] - _SIDE  # from cells to shingles of the window
        root = label[row]
        with np.errstate(over="ignore"):
            name = _mixed(h[root].view(np.uint64) + _mixed(s[root].view(np.uint64), np.uint64(5)), np.uint64(3)) >> np.uint64(2)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[row]), pa.array(s[row]), pa.array((a + shift).astype(np.int32)), pa.array((b + shift + SHORTEST - 2).astype(np.int32)), pa.array(name.view(np.int64))],
            ["h", "s", "a", "b", "class"],
        )

    def run(batches):
        held, load = [], 0
        for _, g in groups(batches, ["k"], ["h", "s", "centre", "body"]):
            if len(g["h"]) < 2:
                continue
            held.append(g)
            load += len(g["h"])
            if load >= VERIFIED:
                if (out := work(held)) is not None:
                    yield out
                held, load = [], 0
        if held and (out := work(held)) is not None:
            yield out

    return dealt.mapInArrow(run, "h long, s long, a int, b int, class long")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of at least 50 words that nearly repeat elsewhere, in the same document or another.

    One row for each document that has any: the key, ``n_passages``, ``passages``
    (structs of first word and end, exclusive; overlapping ones are one), ``n_words``
    that they cover and ``class_id``, the smallest key reachable over shared
    passages. Texts are lower-cased and split at white space; a null text or one of
    fewer than 50 words has none. Repeated rows are documents that repeat each other.

    Windows whose value occurs once go no further. Equal contexts of a value need no
    look at the text; one copy of each different context is fetched and compared.
    """
    spark = docs.sparkSession
    prepared, prepared_path = cut(_prepared(docs, key, text))
    keys, _ = cut(prepared.select("rid", "_key"))
    every = prepared.select("rid", F.explode("windows").alias("x")).select("rid", "x.*")
    common = every.groupBy("h").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("h")
    shared, shared_path = cut(every.join(common, "h"))
    distinct = shared.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("r"))
    kinds = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    distinct, distinct_path = cut(distinct.join(kinds, "h").where("kinds > 1 or n > 1"))
    asked = distinct.where("kinds > 1").select("h", "s", "r.*", F.ceil(F.col("kinds") / max(HOT, 1)).cast("int").alias("blocks"))
    near = _compared(_contexts(asked, prepared.select("rid", "packed")))
    same = distinct.where("n > 1").select(
        "h", "s", F.lit(0).alias("a"), (F.shiftright("r.at", 6).bitwiseAND(F.lit(63)) + F.col("r.at").bitwiseAND(F.lit(63))).cast("int").alias("b"), F.shiftright(F.xxhash64("h", "s"), 2).alias("class")
    )
    found, found_path = cut(near.unionByName(same).distinct())
    forget(spark, prepared_path)
    forget(spark, distinct_path)
    lo = (F.shiftright("at", 12) - F.shiftright("at", 6).bitwiseAND(F.lit(63))).cast("int")
    hits, _ = cut(shared.join(found, ["h", "s"]).select("rid", (lo + F.col("a")).alias("a"), (lo + F.col("b") + WORDS).alias("b"), "class"))
    forget(spark, shared_path)
    forget(spark, found_path)
    least = hits.groupBy("class").agg(F.min("rid").alias("to"))
    roots = connected_components(hits.select("rid", "class").distinct().join(least, "class").select(F.col("rid").alias("a"), F.col("to").alias("b")))
    spans = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("all"))
    merged = F.aggregate(
        "all",
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))),
    )
    spans = spans.select("rid", merged.alias("passages"))
    rows = spans.join(keys, "rid").join(roots.withColumnRenamed("id", "rid"), "rid", "left")
    rows = rows.withColumn("root", F.coalesce("root", "rid"))
    tops = rows.groupBy("root").agg(F.min("_key").alias("class_id"))
    return rows.join(tops, "root").select(
        F.col("_key").alias(key),
        F.size("passages").cast("long").alias("n_passages"),
        "passages",
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("n_words"),
        "class_id",
    )
