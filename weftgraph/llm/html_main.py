"""Main text of web pages by scores passed up the element tree."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_RAW = frozenset("script style noscript template textarea title svg iframe select".split())
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_MARKS = re.compile("[>\"']")
_ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=\s|$|/))", re.I)
_WHITE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav footer aside form button dialog menu head header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre td th li blockquote dd dt figcaption div section article main".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|alert|popup|modal|overlay"
    r"|newsletter|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|reply"
    r"|responses|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|login|signup|search|skip|disclaimer)(?:$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What an opening tag closes, up to the scope's border.
_CLOSES = {"li": (("li",), {"ul", "ol", "menu"}), "dd": (("dd", "dt"), {"dl"}), "dt": (("dd", "dt"), {"dl"}),
           "td": (("td", "th"), {"table", "tr"}), "th": (("td", "th"), {"table", "tr"}), "tr": (("tr",), {"table"}), "option": (("option",), {"select"})}


class _Node:
    __slots__ = ("tag", "up", "bad", "score", "below", "own", "linked", "kids")

    def __init__(self, tag, up, bad):
        self.tag, self.up, self.bad = tag, up, bad
        self.score = self.below = 0.0
        self.own = self.linked = 0
        self.kids = []


def _is_bad(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element and all in it is page furniture."""
    if tag in _DROP and not (tag == "header" and in_article):
        return True
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, value in _ATTRS.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if _BAD.search(value):
                    return True
            elif name == "role":
                if value.lower() in _ROLES:
                    return True
            elif name == "style":
                if _HIDDEN.search(value):
                    return True
            elif name == "hidden" or value.lower() == "true":
                return True
    return False


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """Places of ``>`` and quotes, and for each the end of a tag that goes on there outside quotes (-1: it never ends).

    A quote that is not closed counts as any other character. Told from the page's
    end backwards, so each mark is looked at once.
    """
    at = [m.start() for m in _MARKS.finditer(html)]
    ends = [-1] * (len(at) + 1)
    later: dict[str, int] = {}
    for k in range(len(at) - 1, -1, -1):
        c = html[at[k]]
        if c == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[later.get(c, k) + 1]
            later[c] = k
    return at, ends


def _tokens(html: str):
    """Text as (None, text), and tags as (name, whether it closes, attributes); one pass forward.

    What stands between is left out: comments, declarations and elements whose content
    is no text. A ``<`` that starts none of these, or a tag that never ends, is text.
    """
    marks, ends = _tag_ends(html)
    last = html.rfind(">")
    pos, n, mark = 0, len(html), 0
    while pos < n:
        lt = html.find("<", pos)
        if lt != pos:
            yield None, html[pos : lt if lt >= 0 else n], ""
            if lt < 0:
                return
            pos = lt
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        m = _NAME.match(html, pos + 1)
        if m is None:
            if html[pos + 1 : pos + 2] in ("!", "?") and last > pos:
                pos = html.find(">", pos) + 1
                continue
            yield None, "<", ""
            pos += 1
            continue
        while mark < len(marks) and marks[mark] < m.end():
            mark += 1
        end = ends[mark]
        if end < 0:
            yield None, "<", ""
            pos += 1
            continue
        name = m[2].lower()
        pos = end + 1
        if name in _RAW and not m[1]:
            close = _ENDS[name].search(html, pos)
            pos = n if close is None else close.end()
            continue
        yield name, bool(m[1]), html[m.end() : end]


def extract(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by a blank line.

    A null, empty or text-free page gives an empty text. Work grows in proportion
    to the page, however it nests and whatever it leaves open: one pass over the tags,
    one over the elements from the last to the first, which hands points and lengths
    to the one above, and one over the blocks.
    """
    if not html:
        return ""
    root = _Node("html", None, False)
    stack = [root]  # open elements that are blocks
    made = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each kind stands
    blocks: list[tuple[_Node, str, int, int]] = []
    text: list[str] = []
    links = 0
    inlinks: list[str] = []
    articles = 0

    def flush():
        nonlocal text, inlinks
        if text:
            node = stack[-1]
            if not node.bad:
                plain = _WHITE.sub(" ", unescape("".join(text))).strip()
                if plain:
                    linked = len(_WHITE.sub(" ", unescape("".join(inlinks))).strip())
                    blocks.append((node, plain, len(plain), min(linked, len(plain))))
            text, inlinks = [], []

    def pop_to(k: int):
        nonlocal articles
        flush()
        for x in stack[k:]:
            articles -= x.tag == "article"
            places[x.tag].pop()
        del stack[k:]

    for tag, closes, attrs in _tokens(html):
        if tag is None:
            text.append(closes)
            if links:
                inlinks.append(closes)
            continue
        if closes:
            if tag == "a":
                links = 0
            elif tag in _BLOCK:
                if places[tag]:
                    pop_to(places[tag][-1])
                elif tag == "p":
                    flush()
            continue
        if tag == "br" or tag == "hr":
            text.append("\n")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            links = 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag in ("html", "body") and len(stack) > 1 and (tag == "html" or places[tag]):
            continue
        links = 0
        if tag in _CLOSES:
            what, until = _CLOSES[tag]
            open_at = max((places[w][-1] for w in what if places[w]), default=0)
            if open_at > max((places[u][-1] for u in until if places[u]), default=0):
                pop_to(open_at)
        elif tag == "p" or tag in _HEADINGS or tag in ("ul", "ol", "div", "section", "article", "table", "blockquote", "pre"):
            if stack[-1].tag == "p" or (stack[-1].tag in _HEADINGS and tag in _HEADINGS):
                pop_to(len(stack) - 1)
        up = stack[-1]
        node = _Node(tag, up, up.bad or _is_bad(tag, attrs, articles > 0))
        up.kids.append(node)
        made.append(node)
        if not attrs.endswith("/") or tag not in _VOID:
            articles += tag == "article"
            places[tag].append(len(stack))
            stack.append(node)
    flush()
    if not blocks:
        return ""

    for node, plain, n, linked in blocks:
        commas = plain.count(",") + plain.count("，") + plain.count("、")
        if node.tag in _PARAGRAPHS or node.tag in ("html", "body"):
            points = 1 + commas + min(n / 100, 3)
            points *= 1 - linked / n
            up = node.up if node.tag in ("p", "li", "td", "th", "dd", "dt", "pre", "figcaption", "blockquote") else node
            if up is not None:
                up.score += points
        node.own += n
        node.linked += linked
    # What an element was given whole goes on by half, what came from below by two thirds.
    for x in reversed(made):
        up = x.up
        if up is not None:
            up.below += x.score / 2 + x.below / 1.5
            up.own += x.own
            up.linked += x.linked
        x.score += x.below
    seen: dict[int, _Node] = {}
    for node, *_ in blocks:
        x = node
        while x is not None and id(x) not in seen:
            seen[id(x)] = x
            x = x.up
    bonus = {"article": 1.5, "main": 1.3}

    def worth(x: _Node) -> float:
        return x.score * (1 - x.linked / max(1, x.own)) * bonus.get(x.tag, 1.0)

    best = max(seen.values(), key=worth)
    article = best
    while article.up is not None and article.tag not in ("article", "main"):
        article = article.up
    if article.tag in ("article", "main"):
        best = article  # parts of one article are not split
    chosen = {id(best)}
    if best.up is not None and best.tag not in ("article", "main"):
        least = max(10.0, 0.2 * worth(best))
        for kid in best.up.kids:
            if id(kid) in seen and kid is not best:
                dense = kid.linked / max(1, kid.own)
                if worth(kid) >= least or kid.tag in _HEADINGS or (kid.tag == "p" and dense < 0.25):
                    chosen.add(id(kid))
    elif best.tag == "article" and best.up is not None:
        for kid in best.up.kids:
            if kid.tag == "article" and id(kid) in seen and worth(kid) >= max(10.0, 0.2 * worth(best)):
                chosen.add(id(kid))
    out = []
    kept: dict[int, bool] = {}
    for node, plain, n, linked in blocks:
        path, x, inside = [], node, False
        while x is not None:
            known = kept.get(id(x))
            if known is not None:
                inside = known
                break
            path.append(id(x))
            if id(x) in chosen:
                inside = True
                break
            x = x.up
        for k in path:
            kept[k] = inside
        # A list of links beside the text is a menu; in an article it is part of it.
        menu = node.tag == "li" and linked == n and best.tag not in ("article", "main") and node.up.linked > 0.8 * node.up.own
        if inside and not menu:
            out.append(plain)
    return "\n\n".join(out)


def main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the columns ``text`` and ``n_chars`` of each page's main text.

    Other columns pass through; ones with these names are replaced. Pages are
    independent of one another, so nothing is shuffled.
    """
    df = df.drop(text, "n_chars")
    schema = T.StructType(list(df.schema.fields)).add(text, "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            made = [extract(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())],
                [*batch.schema.names, text, "n_chars"],
            )

    return df.mapInArrow(run, schema)
