"""Language identification by cross-parsing against labelled text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

#: Bounds of the labelled sample: characters and documents of each language, and of all.
CHARS_PER_LANGUAGE = 24_000
DOCS_PER_LANGUAGE = 64
CHARS_IN_ALL = 400_000
#: Texts are parsed in stretches of this many letters and spaces; a phrase ends at a border.
STRETCH = 256
_LETTERS = 62


@dataclass
class Model:
    """Suffix automata of all languages as one transition table."""

    languages: list[str]
    codes: np.ndarray  # code point (below 65536) to symbol: 0 space, 1 other letter, 2.. frequent letters
    step: np.ndarray  # (states, symbols), -1 where no such substring
    roots: np.ndarray


def _automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence; state 0 is its root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(nxt), width), -1, dtype=np.int32)
    for s, moves in enumerate(nxt):
        for c, t in moves.items():
            table[s, c] = t
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of labelled texts, ``{language: texts}``; languages without letters are left out."""
    counts: Counter = Counter()
    texts = {}
    for lang in sorted(samples):
        text = " ".join(samples[lang]).lower()
        if any(c.isalpha() for c in text):
            texts[lang] = text
            counts.update(c for c in text if c.isalpha() and ord(c) < 65536)
    codes = np.zeros(65536, dtype=np.uint8)
    for c in range(65536):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            codes[c] = 1
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:_LETTERS]):
        codes[ord(c)] = k + 2
    tables, roots, at = [], [], 0
    for text in texts.values():
        symbols = _squeeze(_coded(codes, _points(text)))[0]
        t = _automaton([0, *symbols.tolist(), 0], _LETTERS + 2)
        t[:, 1] = -1  # a letter that was not learned matches nothing
        t[t >= 0] += at
        roots.append(at)
        at += len(t)
        tables.append(t)
    step = np.concatenate(tables) if tables else np.zeros((0, _LETTERS + 2), np.int32)
    return Model(list(texts), codes, step, np.array(roots, dtype=np.int32))


def _coded(codes: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = codes[np.minimum(points, 65535)]
    high = np.nonzero(points >= 65536)[0]
    if high.size:
        out[high] = [chr(c).isalpha() for c in points[high]]
    return out


def _squeeze(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of what is no letter become one space; also the places kept."""
    keep = np.ones(len(symbols), dtype=bool)
    if len(symbols):
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    at = np.nonzero(keep)[0]
    return symbols[at], at


def parse(model: Model, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each lane (row of symbols) in each language: (lanes, languages).

    All lanes step through the automata together: while the substring goes on, the
    state follows it; where it ends, a phrase is counted and a new one starts.
    """
    n, k = len(lanes), len(model.languages)
    flat = model.step.ravel()
    width = model.step.shape[1]
    roots = np.tile(model.roots, (n, 1))
    state = roots.copy()
    phrases = np.ones((n, k), dtype=np.int32)
    order = np.argsort(-lengths, kind="stable")
    lanes, lengths = np.ascontiguousarray(lanes[order].T), lengths[order]
    live_at = np.searchsorted(-lengths, -np.arange(lanes.shape[0]), side="left")
    for t in range(lanes.shape[0]):
        m = int(live_at[t])
        if not m:
            break
        c = lanes[t, :m, None].astype(np.int32)
        go = flat[state[:m] * width + c]
        broken = go < 0
        if broken.any():
            phrases[:m] += broken
            again = flat[roots[:m] * width + c]
            go = np.where(broken, np.where(again < 0, roots[:m], again), go)
        state[:m] = go
    out = np.empty_like(phrases)
    out[order] = phrases
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text.

    The score is one less the ratio of the phrases that the best language needs to
    those that the next best needs, both for each letter (1 if there is no other).
    Ties go to the language that sorts first.
    """
    n, k = len(texts), len(model.languages)
    rows, owner, sizes, letters = [], [], [], np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        s, _ = _squeeze(_coded(model.codes, _points(t)))
        letters[i] = np.count_nonzero(s)
        if not letters[i]:
            continue
        parts = -(-len(s) // STRETCH)
        lane = np.zeros(parts * STRETCH, dtype=np.uint8)
        lane[: len(s)] = s
        rows.append(lane.reshape(parts, STRETCH))
        owner.append(np.full(parts, i))
        sizes.append(np.minimum(STRETCH, len(s) - np.arange(parts) * STRETCH))
    total = np.zeros((n, max(k, 1)), dtype=np.int64)
    if rows and k:
        lanes, owner, sizes = np.concatenate(rows), np.concatenate(owner), np.concatenate(sizes)
        for a in range(0, len(lanes), 8192):
            found = parse(model, lanes[a : a + 8192], sizes[a : a + 8192])
            np.add.at(total, owner[a : a + 8192], found)
    langs, scores = [], []
    for i in range(n):
        if not letters[i] or not k:
            langs.append("und")
            scores.append(0.0)
            continue
        order = np.argsort(total[i], kind="stable")
        langs.append(model.languages[order[0]])
        scores.append(1.0 if k == 1 else float(1 - total[i, order[0]] / total[i, order[1]]))
    return langs, scores


def held_out(key: str = "doc_id"):
    """Rows that no model learns from: crc32 of the key as text leaves 1 modulo 3 (a null key counts as '')."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    For each language the ``DOCS_PER_LANGUAGE`` rows that come first by a hash of
    their key, shorter ones (up to 2,000 characters) before longer, are used until
    ``CHARS_PER_LANGUAGE`` characters; over all languages the bound is
    ``CHARS_IN_ALL``, divided evenly. Only that sample reaches the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
        (F.length(text) > 2000).alias("long"),
        F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"),
    )
    first = Window.partitionBy("lang").orderBy("long", "h")
    picked = (
        rows.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= DOCS_PER_LANGUAGE)
        .select("lang", "rank", F.substring("text", 1, CHARS_PER_LANGUAGE).alias("text"))
        .orderBy("lang", "rank")
    )
    samples: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():
        have = samples.setdefault(r["lang"], [])
        room = CHARS_PER_LANGUAGE - sum(map(len, have))
        if room > 0:
            have.append(r["text"][:room])
    if samples:
        each = max(500, CHARS_IN_ALL // len(samples))
        for lang, texts in samples.items():
            samples[lang] = ["\n".join(texts)[: min(each, CHARS_PER_LANGUAGE)]]
    return fit(samples)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; every whole text is parsed.

    ``und`` and 0 where a text is null or has no letter, or where no language was
    learned. Columns with these names are replaced, others pass through.
    """
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by CHARS_IN_ALL
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            langs, scores = [], []
            for a in range(0, batch.num_rows, 500):
                found = predict(shipped.value, column.slice(a, 500).to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)
