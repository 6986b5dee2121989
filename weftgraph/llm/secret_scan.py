"""Secrets in texts: certain ones by pattern, weak ones by what stands near (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: what may be a key, if an access identifier is near, and where it may be used.
WEAK_KEY = r"(?<![A-Za-z0-9+/_-])(?!AKIA[A-Z0-9]{12})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}"""
#: Parts link within this many code points.
SCOPE = 200
_KINDS = ("assign", "access", "hex", "key", "endpoint")


#: Elements up to which an array is folded in one go.
_FEW = 64


def _running(values: Column, merge) -> Column:
    """For each element of an array of int what ``merge`` makes of 0 and all before it.

    A fold copies its array at every step; long arrays are folded in pieces of about
    the root of their length, so the work stays far from the square of it.
    """

    def fold(some, start):
        end = F.aggregate(
            some,
            F.struct(start.alias("v"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(merge(acc["v"], x).alias("v"), F.concat(acc["out"], F.array(acc["v"])).alias("out")),
        )
        return end["out"]

    n = F.size(values)
    size = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda k: F.slice(values, k * size + 1, size))
    starts = fold(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), merge)), F.lit(0))
    long = F.flatten(F.zip_with(pieces, starts, fold))
    return F.when(n > _FEW, long).otherwise(fold(values, F.lit(0)))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start and end in code points.

    What lies between the matches (``split``) and the matches themselves tell where
    each one stands.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    before = _running(F.transform(sizes, lambda x: x["a"] + x["b"]), lambda v, x: v + x)
    return F.zip_with(before, sizes, lambda v, x: F.struct((v + x["a"]).alias("s"), (v + x["a"] + x["b"]).alias("e")))


_NONE = "array<struct<s:int,e:int>>"


#: One cheap test that every text with a certain span passes.
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}"


def _guarded(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(_NONE))


def _assign(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(_matches(text, ASSIGN), values, lambda m, v: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.length(v).alias("n")))
    return F.transform(F.filter(both, lambda x: x["n"] >= 8), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _listed(spans: Column) -> Column:
    """Spans (structs s, k, e) as text: by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Certain spans and weak parts of the documents that may have any, once for equal rows.

    The table is small (texts without a telling word are left out by one test) and is
    written, so that each pattern runs once over each text. Weak parts are looked
    for only where there is an access identifier.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    access = t.contains("AKIA")
    rows = docs.where(t.rlike(_ANY)).select(
        F.col(key).alias("_key"), *_content(text), _assign(t).alias("assign"), _guarded(access, _matches(t, ACCESS)).alias("access"),
        _matches(t, HEX).alias("hex"), _guarded(access, _matches(t, WEAK_KEY)).alias("key"), _guarded(access, _matches(t, ENDPOINT)).alias("endpoint"),
    )
    return cut(rows)[0].dropDuplicates(["_key", "_h1", "_h2"])


def _content(text: str) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(F.col(text)).alias("_h1"), F.xxhash64(F.lit(7), F.col(text)).alias("_h2")]


_ROW = ["_key", "_h1", "_h2"]


def weak_links(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans that complementary parts confirm: the row's columns and ``_weak`` (structs s, k, e).

    A possible key counts where an access identifier starts or ends within ``scope``
    code points of it; an endpoint where both an access identifier and a key or an
    assigned secret do. Parts and anchors meet in an interval join: both sides are
    laid on a grid of cells ``scope`` wide, joined on document and cell and compared
    exactly. Only spans are shuffled, never texts.
    """
    rows = parts.where(F.size("access") > 0).select(
        *_ROW, F.concat(_tagged(F.col("assign"), 0), _tagged(F.col("access"), 1), _tagged(F.col("key"), 3), _tagged(F.col("endpoint"), 4)).alias("spans")
    )
    spans = rows.select(*_ROW, F.explode("spans").alias("x")).select(*_ROW, "x.s", "x.k", "x.e")

    def near(some: DataFrame, anchors: DataFrame) -> DataFrame:
        left = some.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope))))
        right = anchors.select(*[F.col(c).alias("r" + c) for c in _ROW], F.col("s").alias("_s"), F.col("e").alias("_e")).withColumn(
            "_cell", F.explode(F.sequence(F.floor(F.col("_s") / scope), F.floor(F.col("_e") / scope)))
        )
        on = [left[c].eqNullSafe(right["r" + c]) for c in _ROW] + [
            left["_cell"] == right["_cell"],
            right["_s"] <= left["e"] + scope,
            right["_e"] >= left["s"] - scope,
        ]
        return left.join(right, on, "left_semi").drop("_cell").distinct()

    access = spans.where("k = 1")
    keys = near(spans.where("k = 3"), access)
    hidden = keys.unionByName(spans.where("k = 0"))
    ends = near(near(spans.where("k = 4"), access), hidden)
    return keys.unionByName(ends).groupBy(*_ROW).agg(F.collect_set(F.struct("s", "k", "e")).alias("_weak"))


def _found(docs: DataFrame, key: str, text: str, scope: int) -> DataFrame:
    """For each different row with a certain span: the arrays and ``spans`` with the weak ones."""
    parts = _parts(docs, key, text)
    weak = weak_links(parts, scope).select(*[F.col(n).alias("w" + n) for n in _ROW], "_weak")
    joined = parts.join(weak, [parts[n].eqNullSafe(weak["w" + n]) for n in _ROW], "left")
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    spans = F.concat(_tagged(F.col("assign"), 0), _tagged(F.col("access"), 1), _tagged(F.col("hex"), 2), F.coalesce("_weak", empty))
    return joined.select(*[F.col(n).alias("f" + n) for n in _ROW], "assign", "access", "hex", spans.alias("spans"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Each document's key, its certain spans by kind and ``spans`` (all of them, weak ones too).

    Columns: the key, ``assign``, ``access``, ``hex`` (arrays of start and end in
    code points) and ``spans`` (array of structs start ``s``, kind number ``k``,
    end ``e``). A null text counts as empty; repeated rows each get a row; documents
    are told apart by key and content, so rows that share a key do not mix.
    """
    slim = docs.select(F.col(key).alias("_key"), *_content(text))
    found = _found(docs, key, text, scope)
    joined = slim.join(found, [slim[n].eqNullSafe(found["f" + n]) for n in _ROW], "left")
    none = F.array().cast(_NONE)
    kinds = [F.coalesce(k, none).alias(k) for k in ("assign", "access", "hex")]
    return joined.select(F.col("_key").alias(key), *kinds, F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and listing of what :func:`scan` found."""
    base = F.concat(_tagged(F.col("assign"), 0), _tagged(F.col("access"), 1), _tagged(F.col("hex"), 2))
    return found.select(
        key,
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap get one mark.

    A null text stays null. Documents without spans are left as they are, and so are
    all other columns, whatever their names.
    """
    found = _found(docs, key, text, SCOPE).where(F.size("spans") > 0)
    found = found.select(*["f" + n for n in _ROW], F.transform(F.array_sort("spans"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), *_content(text))
    joined = rows.join(found, [rows[n].eqNullSafe(found["f" + n]) for n in _ROW], "left")
    whole, spans = F.col("row")[text], F.col("spans")
    before = _running(F.transform(spans, lambda x: x["e"]), lambda v, x: F.greatest(v, x))

    def built(cut_out):
        """What stands before each span that starts beyond all before it, and a mark; then the rest."""
        kept = F.zip_with(before, spans, lambda v, x: F.when(x["s"] >= v, F.concat(cut_out(v, x["s"] - v), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(kept, ""), cut_out(last, F.length(whole)))

    letters = F.split(whole, "")
    new = F.when(F.size(spans) > _FEW, built(lambda a, n: F.array_join(F.slice(letters, a + 1, n), ""))).otherwise(built(lambda a, n: F.substring(whole, a + 1, n)))
    out = F.when(spans.isNotNull(), new).otherwise(whole)
    return joined.select(*[(out if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
