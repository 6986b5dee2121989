"""Full-text search: tokens, BM25 scores, fuzzy, phrase, boosting and multi-column queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut

K1, B = 1.2, 0.75


@dataclass
class Tokenizer:
    """How text becomes tokens: ``simple`` splits at what is no letter or digit, ``whitespace`` at white space, ``raw`` not at all."""

    base: str = "simple"
    lower: bool = True
    max_length: int = 40
    stop_words: tuple[str, ...] = ()

    def __call__(self, text: Column) -> Column:
        t = F.lower(text) if self.lower else text
        if self.base == "raw":
            out = F.array(t)
        elif self.base == "whitespace":
            out = F.split(t, r"\s+")
        else:
            out = F.split(t, r"[^\p{L}\p{N}]+")
        out = F.filter(out, lambda w: (w != "") & (F.length(w) <= self.max_length))
        if self.stop_words:
            stop = F.array(*map(F.lit, self.stop_words))
            out = F.filter(out, lambda w: ~F.array_contains(stop, w))
        return out

    def words(self, text: str) -> list[str]:
        import re

        t = text.lower() if self.lower else text
        parts = [t] if self.base == "raw" else t.split() if self.base == "whitespace" else re.split(r"[\W_]+", t)
        return [w for w in parts if w and len(w) <= self.max_length and w not in self.stop_words]


class TextIndex:
    """Term frequencies of one text column; scores are BM25 over all documents.

    ``rows`` has one line for each document and different token - the only shuffle of
    a search is the aggregation of the few tokens asked for.
    """

    def __init__(self, df: DataFrame, key: str, column: str, tokenizer: Tokenizer | None = None):
        self.key, self.column, self.tokenizer = key, column, tokenizer or Tokenizer()
        self.docs = df.where(F.col(column).isNotNull()).select(F.col(key).alias("doc"), self.tokenizer(F.col(column)).alias("tokens"))

    def _found(self, terms: Column) -> DataFrame:
        """Documents with the frequencies of the asked terms (a literal array): one pass, nothing exploded but matches."""
        hits = self.docs.select("doc", F.size("tokens").alias("size"), F.filter("tokens", lambda w: F.array_contains(terms, w)).alias("hits"))
        return hits

    def match(self, text: str, k: int | None = None, operator: str = "or", boost: float = 1.0, fuzziness: int | None = 0, max_expansions: int = 50, edits: str = "characters", digits: int | None = None) -> DataFrame:
        """``key`` and ``_score`` of documents with any (or all) of the words.

        ``fuzziness`` allows so many edits of a word; None takes 0, 1 or 2 by its
        length (up to 2, up to 5, longer); at most ``max_expansions`` words of the
        corpus stand in for each, the nearest and then first ones. ``edits`` are of
        characters or of ``bytes`` in UTF-8. The first ``k`` are those of the highest
        scores (rounded to ``digits``, if given), ties by key.
        """
        words = list(dict.fromkeys(self.tokenizer.words(text)))
        if not words:
            return self.docs.select(F.col("doc").alias(self.key), F.lit(0.0).alias("_score")).limit(0)
        groups = {w: [w] for w in words}
        if fuzziness != 0:
            groups = {w: self._expanded(w, fuzziness, max_expansions, edits) for w in words}
        every = sorted({x for g in groups.values() for x in g})
        scored = self._scores(every)
        if operator == "and":
            for g in groups.values():
                scored = scored.where(F.arrays_overlap("found", F.array(*map(F.lit, g)))) if g else scored.where(F.lit(False))
        out = scored.select(F.col("doc").alias(self.key), (F.col("score") * boost).alias("_score"))
        return out if k is None else _first(out, k, self.key, digits)

    def _expanded(self, word: str, fuzziness: int | None, most: int, edits: str = "characters") -> list[str]:
        allowed = fuzziness if fuzziness is not None else 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2
        if allowed == 0:
            return [word]
        vocabulary = self.docs.select(F.explode("tokens").alias("w")).distinct()
        mine, asked = F.col("w"), word
        if edits == "bytes":  # a character for each byte
            mine, asked = F.decode(F.encode("w", "UTF-8"), "ISO-8859-1"), word.encode().decode("latin-1")
        near = vocabulary.withColumn("d", F.levenshtein(mine, F.lit(asked))).where(F.col("d") <= allowed)
        return [r["w"] for r in near.orderBy("d", "w").limit(most).collect()]

    def _scores(self, terms: list[str]) -> DataFrame:
        """doc, score and the terms found, for documents with any of the terms."""
        if not terms:
            return self.docs.select("doc", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("found")).limit(0)
        asked = F.array(*map(F.lit, terms))
        rows, _ = cut(self._found(asked))  # texts are split once; statistics and scores read what was found
        aggs = [F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg")]
        aggs += [F.sum(F.array_contains("hits", t).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)]
        stats = rows.agg(*aggs).first()
        n, average = stats["n"], stats["avg"] or 1.0
        score = F.lit(0.0)
        for i, t in enumerate(terms):
            df = stats[f"df{i}"] or 0
            idf = F.lit(((n - df + 0.5) / (df + 0.5) + 1.0)).cast("double")
            tf = F.size(F.filter("hits", self._is(t))).cast("double")
            score = score + F.ln(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / average))
        return rows.where(F.size("hits") > 0).select("doc", score.alias("score"), F.array_distinct("hits").alias("found"))

    @staticmethod
    def _is(term: str):
        return lambda w: w == F.lit(term)

    def phrase(self, text: str, k: int | None = None) -> DataFrame:
        """Documents with the words in a row, scored by them (not for the ``raw`` tokenizer, whose tokens may hold spaces)."""
        words = self.tokenizer.words(text)
        if not words:
            return self.match("")
        # Tokens hold no spaces, so the words stand in a row where their joined text occurs between spaces.
        joined = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
        rows = self.docs.where(joined.contains(" " + " ".join(words) + " ")).select(F.col("doc").alias("here"))
        out = self._scores(sorted(set(words))).join(rows, F.col("doc") == F.col("here"), "left_semi").select(F.col("doc").alias(self.key), F.col("score").alias("_score"))
        return out if k is None else out.orderBy(F.desc("_score"), self.key).limit(k)

    def boosted(self, positive: DataFrame, negative: DataFrame, weight: float = 0.5) -> DataFrame:
        """The positive scores less ``weight`` of the negative ones."""
        less = negative.select(F.col(self.key).alias("other"), F.col("_score").alias("less"))
        rows = positive.join(less, positive[self.key] == less["other"], "left")
        return rows.select(self.key, (F.col("_score") - weight * F.coalesce("less", F.lit(0.0))).alias("_score"))


def _first(scored: DataFrame, k: int, key: str, digits: int | None) -> DataFrame:
    """The ``k`` highest scores, those that round alike by key."""
    score = F.col("_score") if digits is None else F.round("_score", digits)
    return scored.orderBy(score.desc(), key).limit(k)


def multi_match(df: DataFrame, key: str, columns: list[str], text: str, k: int | None = None, tokenizer: Tokenizer | None = None, digits: int | None = None) -> DataFrame:
    """The best score of each document over several columns."""
    out = None
    for c in columns:
        rows = TextIndex(df, key, c, tokenizer).match(text)
        out = rows if out is None else out.unionByName(rows)
    out = out.groupBy(key).agg(F.max("_score").alias("_score"))
    return out if k is None else _first(out, k, key, digits)
