"""BPE encoding and decoding by dynamic programming over prefixes."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
#: Characters on whose class or case the versions of Unicode in use may differ.
_UNSURE = re.compile("[^\x00-\u0557\u1e00-\u1fff\u2010-\u205f\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u2b4f\u3000-\u312f\u4e00-\u9fa5\uac00-\ud7a3]")
_END = "￿"
#: In front of a piece: not a plain word.
_MARK = "\n"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Bytes of a word up to which words are encoded together; characters of texts taken together; slots (as a power of 2) for pairs.
LONGEST, TOGETHER, _SLOTS = 64, 1 << 20, 20
#: Least number of places in the automaton for a byte to have a column in its table; words with others are encoded one by one.
COMMON = 8
_NEVER = 1 << 60
_START = 1 << 40


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer's JSON file.

    For each prefix of a word there is exactly one token that its encoding can end
    with. A left-to-right pass takes the tokens that end at the prefix (from an
    automaton that follows suffix links), and keeps the one that is compatible
    with the last token of the prefix before it. Following the kept tokens back
    from the end gives the encoding; nothing is searched or merged.
    """

    def __init__(self, spec: dict, cache: int = 60_000):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = _byte_letters()
        self.end = _END if self.suffix else ""
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a, b] = r
            parts.setdefault(whole, []).append((r, a, b))
        self.parts = {t: made[0] for t, made in parts.items()}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[int, bool] = {}
        self.cache_size, self.cache = cache, {}
        self.places, self.place = 3 * cache, {}  # of :meth:`ids`: an entry holds no text but its key
        self.bounds, self.store = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.numbers = {i: str(i) for i in self.tokens}
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        keys: list[tuple[str, int]] = []
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            if i in self.parts:
                _, a, b = self.parts[i]
                if len(parts[i]) > 1 and not self._settle(i, parts[i]):
                    continue
                if len(parts[i]) == 1 and not self.fits(a, b, self.parts[i][0]):
                    continue
            ends = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            body = text[: len(text) - len(self.suffix)] if ends else text
            if self.suffix and body.endswith(_END):
                continue
            key = body + _END if ends else body
            self.automaton.add_word(key, (i, len(key)))
            keys.append((key, i))
        self.automaton.make_automaton()
        self.tables = self._tables(keys)
        self.met = np.zeros(1 << _SLOTS, dtype=np.uint64), np.zeros(1 << _SLOTS, dtype=bool)
        self.met[0].fill(np.iinfo(np.uint64).max)
        self._spec, self._library = json.dumps(spec), None

    @property
    def library(self) -> tokenizers.Tokenizer:
        """The library's tokenizer, made only when a text has characters that it must split itself."""
        if self._library is None:
            self._library = tokenizers.Tokenizer.from_str(self._spec)
        return self._library

    def _tables(self, keys: list[tuple[str, int]]) -> tuple:
        """The automaton of the tokens as arrays: steps, and for each state the tokens that end there, longest first."""
        byte_of = self.byte_of | {_END: 256}
        moves, token, depth = [{}], [-1], [0]
        for key, i in keys:
            at = 0
            for c in key:
                nxt = moves[at].get(c)
                if nxt is None:
                    nxt = moves[at][c] = len(moves)
                    moves.append({})
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = nxt
            token[at] = i
        held = Counter(c for m in moves for c in m)
        used = sorted(c for c in held if held[c] >= COMMON or c == _END)
        symbol = np.zeros(257, dtype=np.int64)  # 0: a byte that few tokens have
        for k, c in enumerate(used):
            symbol[byte_of[c]] = k + 1
        number = {c: k + 1 for k, c in enumerate(used)}
        rare = bytes(b for b in range(256) if not symbol[b])
        n, width = len(moves), len(used) + 1
        step = np.zeros((n, width), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int32)
        token_at, size_at = np.array(token, dtype=np.int32), np.array(depth, dtype=np.int64)
        first, shorter = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        level = np.array([0])
        while len(level):
            if level[0]:
                step[level] = step[fail[level]]
                shorter[level] = first[fail[level]]
                first[level] = np.where(token_at[level] >= 0, level, shorter[level])
            edges = [(s, number[c], t) for s in level.tolist() for c, t in moves[s].items() if c in number]
            if not edges:
                break
            s, c, t = np.array(edges).T
            fail[t] = np.where(s == 0, 0, step[s, c])
            step[s, c] = t
            level = t
        return step.ravel(), width, first, token_at, size_at, shorter, symbol, re.compile(b"[" + re.escape(rare) + b"]") if rare else re.compile(b"(?!)")

    def _settle(self, token: int, made: list[tuple[int, int, int]]) -> bool:
        """Of several merges that give one token, keep the one that is really reached."""
        for r, a, b in made:
            if self.fits(a, b, r):
                self.parts[token] = (r, a, b)
                return True
        return False

    def _spine(self, token: int, side: int, kept: dict[int, list]) -> list[tuple[int, int]]:
        """Nodes on the edge of a token's merge tree with the rank at which each is merged away."""
        found = kept.get(token)
        if found is None:
            found, node, death = [], token, _NEVER
            while True:
                found.append((node, death))
                if node not in self.parts:
                    break
                death = self.parts[node][0]
                node = self.parts[node][side]
            kept[token] = found
        return found

    def fits(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether no merge joins ``a`` and ``b`` across their border (before a given rank)."""
        key = a << 20 | b
        if before == _NEVER:
            known = self._fits.get(key)
            if known is not None:
                return known
        rank, out = self.rank, True
        for u, gone_u in self._spine(a, 2, self._right):
            for v, gone_v in self._spine(b, 1, self._left):
                r = rank.get((u, v))
                if r is not None and r < gone_u and r <= gone_v and r < before:
                    out = False
                    break
            if not out:
                break
        if before == _NEVER:
            if len(self._fits) > 100_000:
                self._fits.clear()
            self._fits[key] = out
        return out

    def word(self, text: str, lettered: bool = False) -> list[int]:
        """The ids of one word of the pre-tokenizer (its bytes already as letters, if ``lettered``)."""
        if lettered:
            pass
        elif not text.isascii() or not text.isprintable() or " " in text:
            text = "".join(map(self.letters.__getitem__, text.encode()))
        text += self.end
        n = len(text)
        last, back = [0] * (n + 1), [0] * (n + 1)
        last[0] = _START
        known, fits = self._fits.get, self.fits
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            before = last[end - size]
            if not before:
                continue
            if before != _START:
                ok = known((before - 1) << 20 | token)
                if ok is None:
                    ok = fits(before - 1, token)
                if not ok:
                    continue
            last[end], back[end] = token + 1, end - size
        out, at = [], n
        while at:
            if not last[at]:
                raise ValueError("a byte is missing from the vocabulary")
            out.append(last[at] - 1)
            at = back[at]
        out.reverse()
        return out

    def _pieces(self, text: str) -> list[str]:
        """The words of a text, in lower case; special tokens and words cut by the library bear a mark in front."""
        out: list[str] = []
        for piece in self.split_special.split(text) if self.split_special and "<" in text else [text]:
            if piece in self.special:
                out.append(_MARK + piece)
            elif piece.isascii():
                out += _ASCII_WORDS.findall(piece.lower())
            elif _UNSURE.search(piece):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                out += [_MARK + w for w, _ in words]
            else:
                out += _WORDS.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return out

    def _coded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, their ids one after the other, and where each word's end."""
        plain = [w for w in words if w[0] != _MARK]
        raw = [w.encode() for w in plain]
        alone, lists = [], []
        if len(plain) < len(words):
            for w in words:
                if w[0] != _MARK:
                    continue
                if w[1:] in self.special:
                    alone.append(w)
                    lists.append([self.special[w[1:]]])
                else:
                    plain.append(w)
                    raw.append(bytes(map(self.byte_of.__getitem__, w[1:])))
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        long = sizes > LONGEST  # and those with rare bytes
        at = np.fromiter((m.start() for m in self.tables[-1].finditer(b"".join(raw))), dtype=np.int64)
        long[np.searchsorted(np.cumsum(sizes), at, side="right")] = True
        for k in np.nonzero(long)[0].tolist():
            w = plain[k]
            alone.append(w)
            lists.append(self.word(w[1:], True) if w[0] == _MARK else self.word(w))
        if long.any():
            fit = np.nonzero(~long)[0].tolist()
            plain, raw, sizes = [plain[k] for k in fit], [raw[k] for k in fit], sizes[~long]
        flat, ends = self._together(raw, sizes) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if alone:
            ends = np.concatenate((ends, len(flat) + np.cumsum([len(x) for x in lists])))
            flat = np.concatenate((flat, np.array([i for x in lists for i in x], dtype=np.int32)))
        return plain + alone, flat, ends

    def _learn(self, words: list[str]) -> None:
        """Encode the words and keep what they give."""
        order, flat, ends = self._coded(words)
        ids, at = flat.tolist(), 0
        for w, end in zip(order, ends.tolist()):
            self._kept(w, ids[at:end])
            at = end

    def _kept(self, word: str, ids: list[int]) -> None:
        numbers, tokens = self.numbers, self.tokens
        if len(ids) == 1:
            self.cache[word] = 1, numbers[ids[0]], tokens[ids[0]]
        elif ids:
            self.cache[word] = len(ids), " ".join([numbers[i] for i in ids]), " ".join([tokens[i] for i in ids])
        else:
            self.cache[word] = None

    def _together(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after the other, and where each word's end.

        The pass of :meth:`word` over all words at once, prefix by prefix: their states
        in the automaton step together, and the tokens that end at the prefix are tried
        from the longest on for the words that have none yet.
        """
        step, width, first, token_at, size_at, shorter, symbol, _ = self.tables
        n = len(raw)
        order = np.argsort(-sizes, kind="stable")
        length = sizes[order]
        longest = int(length[0])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
        flat = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
        last = np.zeros((longest + 2, n), dtype=np.int32)
        back = np.zeros((longest + 2, n), dtype=np.int16)
        last[0] = -1  # the start of a word
        state = np.zeros(n, dtype=np.int64)
        tail = bool(self.end)
        total = length + tail
        count = np.searchsorted(-total, -np.arange(1, longest + tail + 1), side="right")
        for t, m in enumerate(count.tolist()):
            c = symbol[flat[np.minimum(begin[:m] + t, len(flat) - 1)]]
            if tail:
                c[length[:m] == t] = symbol[256]
            now = step[state[:m] * width + c]
            state[:m] = now
            node = first[now]
            who = np.nonzero(node)[0]
            node = node[who]
            while len(who):
                token = token_at[node]
                start = t + 1 - size_at[node]
                before = last[start, who]
                good = before == -1
                test = np.nonzero(before > 0)[0]
                if len(test):
                    good[test] = self._fit_all(before[test] - 1, token[test])
                won = who[good]
                last[t + 1, won] = token[good] + 1
                back[t + 1, won] = start[good]
                bad = ~good
                node = shorter[node[bad]]
                who = who[bad]
                some = node > 0
                node, who = node[some], who[some]
        ids, owners = [], []
        who, at = np.arange(n), total.copy()
        while len(who):
            found = last[at, who]
            if (found <= 0).any():
                raise ValueError("a byte is missing from the vocabulary")
            ids.append(found - 1)
            owners.append(order[who])
            at = back[at, who].astype(np.int64)
            more = at > 0
            who, at = who[more], at[more]
        owners, ids = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])
        by = np.argsort(owners, kind="stable")
        return ids[by], np.cumsum(np.bincount(owners, minlength=n))

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fits` of many pairs, through a table of those met before."""
        keys, values = self.met
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        with np.errstate(over="ignore"):
            slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)
        out = values[slot]
        new = np.nonzero(keys[slot] != key)[0]
        if len(new):
            pairs, inverse = np.unique(key[new], return_inverse=True)
            found = np.fromiter((self.fits(k >> 20, k & 0xFFFFF) for k in pairs.tolist()), dtype=bool, count=len(pairs))
            out[new] = found[inverse]
            keys[slot[new]] = key[new]
            values[slot[new]] = out[new]
            # Two pairs of one slot: what stands there must belong together.
            clash = keys[slot[new]] == key[new]
            values[slot[new][clash]] = out[new][clash]
        return out

    def encoded(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text its words' number of ids, ids as text and tokens as text.

        New words of some texts are encoded together; how many texts those are depends
        on their length, and what is kept of words is dropped beyond a bound.
        """
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and size < TOGETHER:
                t = texts[at] or ""
                words.append(self._pieces(t))
                size += len(t)
                at += 1
            if len(self.cache) > self.cache_size:
                self.cache.clear()
            new = set().union(*words)
            new.difference_update(self.cache)
            if new:
                self._learn(list(new))
            get = self.cache.__getitem__
            for w in words:
                found = list(map(get, w))
                yield found if None not in found else [f for f in found if f]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has.

        As :meth:`encoded`, but of a word only the place of its ids in one array is
        kept, so the ids of all words of some texts are taken from there at once.
        """
        out, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            words, ends, size = [], [0], 0
            while at < len(texts) and size < TOGETHER:
                t = texts[at] or ""
                words += self._pieces(t)
                ends.append(len(words))
                size += len(t)
                at += 1
            if len(self.place) > self.places:
                self.place.clear()
                self.bounds, self.store = np.zeros(1, np.int64), np.zeros(0, np.int32)
            new = set(words).difference(self.place)
            if new:
                order, flat, stops = self._coded(list(new))
                self.place.update(zip(order, range(len(self.bounds) - 1, len(self.bounds) - 1 + len(order))))
                self.bounds = np.concatenate((self.bounds, len(self.store) + stops))
                self.store = np.concatenate((self.store, flat))
            k = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            begin, own = self.bounds[k], self.bounds[k + 1] - self.bounds[k]
            done = np.concatenate(([0], np.cumsum(own)))
            out.append(self.store[np.repeat(begin - done[:-1], own) + np.arange(done[-1])])
            counts.append(np.diff(done[ends]))
        return np.concatenate(out), np.concatenate(counts)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in next(self.encoded([text])) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones kept; ids outside the vocabulary are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


_MODELS: dict[str, WordBpe] = {}


def _model(key: str, spec) -> WordBpe:
    """One model in each Python worker."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(json.loads(spec.value))
    return _MODELS[key]


def _spec(df: DataFrame, path: str):
    """The vocabulary file, read on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return df.sparkSession.sparkContext.broadcast(text), sha256(text.encode()).hexdigest()


def _small(batches) -> Iterator[pa.RecordBatch]:
    """Batches of 1,000 rows at most, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            yield batch.slice(a, 1000)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with a column ``ids`` (array of int): the encoding of the whole ``text``.

    A null or empty text gives an empty array. Every other column passes through;
    one that already bears the name of the new column is replaced. Rows are
    independent: repeated rows give repeated results, an empty table an empty one.
    """
    spec, key = _spec(df, path)
    df = df.drop(ids)
    schema = T.StructType(list(df.schema.fields)).add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        model = _model(key, spec)
        for batch in _small(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            flat, counts = model.ids(texts)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text``: what the ids decode to. Null ids give an empty text."""
    spec, key = _spec(df, path)
    df = df.drop(text)
    schema = T.StructType(list(df.schema.fields)).add(text, "string")

    def run(batches):
        model = _model(key, spec)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([model.decode(r or []) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass and return counts and digests only.

    Returns the key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; the ids
    and the decoded text of a row live only while that row is worked on.
    """
    spec, key = _spec(df, path)
    df = df.select(key_column, text)
    kind = df.schema[key_column].dataType.simpleString()

    def run(batches):
        model = _model(key, spec)
        for batch in _small(batches):
            counts, first, second = [], [], []
            for found in model.encoded(batch.column(1).to_pylist()):
                counts.append(sum([f[0] for f in found]))
                first.append(sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                second.append(sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)],
                [key_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.mapInArrow(run, f"`{key_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
