"""Main-text extraction by union-free wrapper inference over the pages of a host.

A page becomes a tree of elements with text slots; inline markup belongs to the text. Equal neighbouring
groups of a page fold into repeats. Pages of one host are aligned one after another: children are matched by
label, matched ones are merged recursively, what only one side has becomes optional, what one side repeats
becomes a repeat, and differing texts become slots. The result is a union-free regular expression over tags:
the host's wrapper. Text mass gathered in its slots then tells which element holds the article; that element's
text is taken from every page. Merging is associative enough to be done per task first, so that a host with
most of the pages is no heavier than others.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table

#: Elements whose content is no markup, and those whose content is never text of the page.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_EMBEDDED = frozenset("svg math object canvas select datalist noscript template audio video map".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
_PLAIN_END = re.compile(r"(?:\"[^\"<]*+\"|'[^'<]*+'|[^'\"<>])*+>")
_QUOTED_END = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open one of the set, up to the nearest of the bounds.
_ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_P_BOUNDS = frozenset("article aside body button div footer header main nav section table td th li blockquote form".split())
_DROPPED = frozenset("head nav aside footer form button dialog menu input fieldset".split()) | _RAW | _EMBEDDED
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget"
    " related recommended share sharing social comment comments commentlist respond reply replies disqus cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe signup login"
    " pagination pager toolbar skip copyright legal".split()
)
#: Words that may stand beside a noise word in a class name; beside any other the name says something else.
_PLACE = frozenset(
    "list box bar block section wrapper wrap container area link links button buttons item items form text content inner outer top bottom left right main primary secondary footer header title"
    " widget panel unit slot banner message msg policy site page post entry global row col column group holder placeholder zone nav menu body feed count icon icons tools".split()
)
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d.*")
#: Elements nested deeper than this are siblings.
_DEPTH = 250
#: Cells of the table of an exact alignment of two lists of children.
_TABLE = 250_000
#: Pages of a host from which a text that is the same on all of them is template text.
_TEMPLATE = 5


class Element:
    __slots__ = ("children", "label", "linked", "named", "noise", "tag")

    def __init__(self, tag: str, label: str, noise: bool, named: bool = False) -> None:
        self.tag, self.label, self.noise, self.named = tag, label, noise, named
        self.children: list[Element | str] = []  # elements and the text between them
        self.linked = 0  # characters of the texts that are link text


def _noisy(name: str) -> bool:
    """Whether a class name or id says that it is no article: a noise word, perhaps beside words of place."""
    words = _WORDS.findall(name)
    return not _NOISE.isdisjoint(words) and all(w in _NOISE or w in _PLACE or len(w) < 3 and w != "no" for w in words)


def _label(tag: str, attrs: str, inside_article: bool) -> tuple[str, bool, bool]:
    """Its label in wrappers, whether the element is noise, and whether only its names say so."""
    noise = tag in _DROPPED or tag == "header" and not inside_article
    if not attrs or attrs.isspace():
        return tag, noise, False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    classes = set(found.get("class", "").lower().split())
    label = tag + "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c) for c in classes}))  # generated names are one
    named = False
    if tag not in ("body", "html", *_ARTICLE) and any(map(_noisy, classes | {found.get("id", "").lower()})):
        named = not (inside_article and tag in _HEADINGS)
    if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        noise = True
    return label, noise or named, named and not noise


def _tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str, bool]]:
    """(begin, end, name or None, closing, attributes, without content) of the markup, in time linear in the page.

    A tag ends at the first > outside quotes; where such an end would need a < within, it is looked for as long as
    the page's budget lasts, then the first > ends it. What no > follows is text.
    """
    at, n, low, budget = 0, len(page), page.lower(), 4 * len(page) + 65_536
    closings: dict[str, int] = {}  # where each name is closed last
    while (begin := page.find("<", at)) >= 0:
        two = page[begin + 1 : begin + 2]
        if two in ("!", "?"):
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                end = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", begin) + 1 or n
            yield begin, end, None, False, "", True
            at = end
            continue
        m = _NAME.match(page, begin)
        if not m:
            at = begin + 1
            continue
        found = _PLAIN_END.match(page, m.end())
        if not found and budget > 0:
            found = _QUOTED_END.match(page, m.end())
            budget -= (found.end() if found else n) - begin
        end = found.end() if found else page.find(">", m.end()) + 1
        if not end:
            return
        closing, name, attrs = m[1] == "/", m[2].lower(), page[m.end() : end - 1]
        empty = attrs.endswith("/")
        if not closing and (name in _RAW or name in _EMBEDDED):
            if name not in closings:
                closings[name] = low.rfind("</" + name)
            if closings[name] < end:
                if name in ("script", "style"):
                    yield begin, n, None, False, "", True
                    return
                empty = True  # never closed: it has no content
            elif name in _RAW:
                end = page.find(">", low.find("</" + name, end)) + 1 or n
                yield begin, end, None, False, "", True
                at = end
                continue
            yield begin, end, name, False, attrs, empty
        else:
            yield begin, end, name, closing, attrs, name in VOID
        at = end


def parse(page: str) -> Element:
    """The page's tree; comments, declarations and the contents of scripts, styles and the like are gone."""
    root = Element("#root", "#root", False)
    stack, at, anchors, articles = [root], 0, 0, 0
    open_at: dict[str, list[int]] = {}

    def pop_to(n: int) -> None:
        nonlocal articles
        for e in stack[n:]:
            articles -= e.tag in _ARTICLE
            open_at[e.tag].pop()
        del stack[n:]

    def add(text: str) -> None:
        if not text:
            return
        top = stack[-1]
        if top.children and isinstance(top.children[-1], str):
            top.children[-1] += text
        else:
            top.children.append(text)
        if anchors:
            top.linked += len(text)

    def innermost(tags: frozenset[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    for begin, end, tag, close, attrs, empty in _tokens(page):
        if begin > at:
            add(page[at:begin])
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                anchors = max(0, anchors - 1) if close else 1
            continue
        anchors = 0
        if close:
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            elif tag == "p":
                stack[-1].children.append(Element("p", "p", False))
            continue
        if tag in _CLOSES_P and (p := innermost(frozenset({"p"}))) > innermost(_P_BOUNDS):
            pop_to(p)
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            bound = innermost(bounds)
            inside = [i for t in ends for i in open_at.get(t, ())[-2:] if i > bound]
            if inside:
                pop_to(min(inside))
        e = Element(tag, *_label(tag, attrs, articles > 0))
        stack[-1].children.append(e)
        if not empty and len(stack) < _DEPTH:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(e)
            articles += tag in _ARTICLE
    add(page[at:])
    _keep_containers(root)
    return root


def _keep_containers(root: Element) -> None:
    """Forms, and elements that are noise by their names alone, are no noise where they hold an article or half of the text."""
    mass: dict[int, tuple[int, bool]] = {}

    def weigh(e: Element, noise: bool) -> tuple[int, bool]:
        chars, article = 0, e.tag in _ARTICLE
        noise = noise or e.noise and not (e.named or e.tag == "form")
        for c in e.children:
            if isinstance(c, str):
                chars += 0 if noise else len(c)
            else:
                n, a = weigh(c, noise)
                chars, article = chars + n, article or a
        mass[id(e)] = chars - (0 if noise else 2 * min(chars, e.linked)), article
        return mass[id(e)]

    total = weigh(root, False)[0]
    if not any(e.noise and (e.named or e.tag == "form") for e in _elements(root)):
        return
    for e in _elements(root):
        if e.noise and (e.named or e.tag == "form"):
            chars, article = mass[id(e)]
            e.noise = not (article or chars > 0.5 * total)


def _elements(e: Element) -> Iterator[Element]:
    todo = [e]
    while todo:
        e = todo.pop()
        yield e
        todo.extend(c for c in e.children if not isinstance(c, str))


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(e: Element, template: frozenset[tuple[str, ...]] = frozenset(), path: tuple[str, ...] = ()) -> Iterator[str]:
    """The non-empty blocks under an element, in page order, without what is noise or the template's."""
    for c in e.children:
        if isinstance(c, str):
            if (not template or path not in template) and (text := clean(c)):
                yield text
        elif not c.noise:
            yield from blocks(c, template, (*path, c.label) if template else path)


# A wrapper node: [label, noise, quantifier, {"n", "text", "link", "same"} of its text slot or None, children].
# A quantifier is one of "1?+*".
Node = list


def fold(e: Element) -> Node:
    """The page's own wrapper: equal neighbours become one repeated child."""
    children: list[Node] = []
    chars, first = 0, None
    for c in e.children:
        if isinstance(c, str):
            if not c.isspace():
                text = clean(c)
                chars += len(text)
                first = text if first is None and len(text) <= 200 else ""
        else:
            children.append(fold(c))
    slot = {"n": 1, "text": chars, "link": min(chars, e.linked), "same": first or None} if chars else None  # one text, not too long
    return [e.label, e.noise, "1", slot, _fold_runs(children)]


def _fold_runs(children: list[Node]) -> list[Node]:
    """Repeats of one label, then of two alternating labels, are folded into repeated children."""
    out: list[Node] = []
    for c in children:
        if out and out[-1][0] == c[0] and out[-1][1] == c[1]:
            out[-1] = merge(out[-1], c)
            out[-1][2] = "*" if "*" in (out[-1][2], c[2]) else "+"
        elif len(out) > 1 and out[-2][0] == c[0] and out[-2][1] == c[1] and out[-1][2] == "1":
            # A B A: the second A joins the first, and B may come between; a following B joins likewise
            out[-2] = merge(out[-2], c)
            out[-2][2] = "+"
            out[-1][2] = "*"
        else:
            out.append(c)
    return out


def _either(a: str, b: str) -> str:
    optional, repeated = "?" in (a, b) or "*" in (a, b), "+" in (a, b) or "*" in (a, b)
    return ("*" if optional else "+") if repeated else ("?" if optional else "1")


def _optional(node: Node) -> Node:
    return [node[0], node[1], {"1": "?", "+": "*"}.get(node[2], node[2]), node[3], node[4]]


def _matched(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of what is over ``_TABLE`` between the common ends, a subsequence found
    by taking each label's next place, in time n log m."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x) - head - tail, len(y) - head - tail
    out = [(i, i) for i in range(head)]
    if n * m > _TABLE:
        places: dict = {}
        for j in range(head, head + m):
            places.setdefault(y[j], []).append(j)
        j = head
        for i in range(head, head + n):
            at = places.get(x[i], ())
            k = bisect_left(at, j)
            if k < len(at):
                out.append((i, at[k]))
                j = at[k] + 1
    elif n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if x[head + i] == y[head + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if x[head + i] == y[head + j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def merge(a: Node, b: Node) -> Node:
    """Align two wrappers of one label: matched children merge, the others become optional."""
    slot = a[3] or b[3]
    if a[3] and b[3]:
        slot = {k: a[3][k] + b[3][k] for k in ("n", "text", "link")} | {"same": a[3]["same"] if a[3]["same"] == b[3]["same"] else None}
    x, y = a[4], b[4]
    if [(c[0], c[1]) for c in x] == [(c[0], c[1]) for c in y]:
        children = [merge(p, q) for p, q in zip(x, y, strict=True)]
    else:
        children, i, j = [], 0, 0
        for p, q in [*_matched([(c[0], c[1]) for c in x], [(c[0], c[1]) for c in y]), (len(x), len(y))]:
            children.extend(map(_optional, x[i:p]))
            children.extend(map(_optional, y[j:q]))
            if p < len(x):
                children.append(merge(x[p], y[q]))
            i, j = p + 1, q + 1
        children = _fold_runs(children)
    return [a[0], a[1], _either(a[2], b[2]), slot, children]


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags: ``#`` is a text slot."""
    inner = ("#" if node[3] else "") + "".join(expression(c) for c in node[4])
    return f"<{node[0]}>({inner}){'' if node[2] == '1' else node[2]}"


def _mass(node: Node) -> float:
    """Unlinked text of the slots under a node that is not noise."""
    if node[1]:
        return 0.0
    own = max(0, node[3]["text"] - 2 * node[3]["link"]) if node[3] else 0
    return own + sum(_mass(c) for c in node[4])


def main_path(wrapper: Node) -> list[str]:
    """Labels from the root to the element that holds the article."""

    def find(node: Node, path: list[str]) -> Iterator[tuple[float, list[str]]]:
        if node[1]:
            return
        if node[0].split(".")[0] in _ARTICLE:
            yield _mass(node), path
        for c in node[4]:
            yield from find(c, [*path, c[0]])

    def loses(node: Node, kept: Node) -> bool:
        """Whether a heading or more text than links stands beside ``kept`` under ``node``."""
        if node is kept or node[1]:
            return False
        if node[3] and node[3]["text"] > 2 * node[3]["link"]:
            return True
        return any(loses(c, kept) for c in node[4])

    marked = [f for f in find(wrapper, []) if f[0] > 0]
    total = _mass(wrapper)
    if marked:
        top = max(marked, key=lambda f: f[0])
        if top[0] >= 0.3 * total:
            inner = [f for f in marked if f[1][: len(top[1])] == top[1] and (f[1] == top[1] or not loses(_node(wrapper, top[1]), _node(wrapper, f[1])))]
            return max(inner, key=lambda f: len(f[1]))[1]
    node, path = wrapper, []
    while True:  # down while nothing but noise and links stands beside one child
        child = max(node[4], key=_mass, default=None)
        if child is None or _mass(child) < 0.6 * max(total, 1e-9) or child[0].split(".")[0] in ("p", "h1", "h2", "h3", "li", "td", "blockquote", "pre"):
            return path
        if path and path != ["html"] and loses(node, child):
            return path
        node, path = child, [*path, child[0]]


def _node(wrapper: Node, path: list[str]) -> Node:
    for label in path:
        wrapper = max((c for c in wrapper[4] if c[0] == label), key=_mass)
    return wrapper


def template_slots(wrapper: Node, pages: int) -> list[list[str]]:
    """Paths of the slots that hold the same text on each of a host's pages: template text, no article's. None where the
    host has under ``_TEMPLATE`` pages, or nothing but such slots, as where its pages are copies of one."""
    if pages < _TEMPLATE:
        return []
    out: list[list[str]] = []
    varying = False
    todo: list[tuple[Node, list[str]]] = [(wrapper, [])]
    while todo:
        node, path = todo.pop()
        if node[1]:
            continue
        if node[3]:
            if node[3]["same"] is not None and node[3]["n"] == pages:
                out.append(path)
            else:
                varying = True
        todo.extend((c, [*path, c[0]]) for c in node[4])
    return out if varying else []


def rules(wrapper: Node, pages: int) -> dict[str, list]:
    """What a host's wrapper says of its pages: where the article is, and which texts below that are the template's."""
    path = main_path(wrapper)
    return {"path": path, "template": [t[len(path) :] for t in template_slots(wrapper, pages) if t[: len(path)] == path]}


def _at(e: Element, path: list[str]) -> Iterator[Element]:
    if not path:
        yield e
        return
    for c in e.children:
        if not isinstance(c, str) and c.label == path[0]:
            yield from _at(c, path[1:])


def main_text(page: str | None, rule: dict[str, list] | None) -> str:
    """The article of a page: under its host's path, or its own wrapper's where the page lacks that path."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    found: list[str] = []
    if rule is not None:
        template = frozenset(map(tuple, rule["template"]))
        found = [t for e in _at(root, rule["path"]) for t in blocks(e, template)]
    if not found:
        found = [t for e in _at(root, main_path(fold(root))) for t in blocks(e)]
    return "\n".join(found)


def _host(url: F.Column | str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper JSON): a host's pages aligned into one wrapper, per task first and then per host."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Any]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = page.as_py()
                if not text or text.isspace():
                    continue
                own = fold(parse(text))
                held = known.setdefault(host, [0, None])
                held[0] += 1
                held[1] = own if held[1] is None else merge(held[1], own)
            if len(known) > 5000:
                yield rows(known)
                known = {}
        if known:
            yield rows(known)

    def rows(known: dict[str, list[Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([v[0] for v in known.values()], pa.int64()), pa.array([json.dumps(v[1]) for v in known.values()])], ["host", "n", "wrapper"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[Any] | None = None
        for batch in batches:
            for host, n, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[0] == host:
                    now[1], now[2] = now[1] + n, merge(now[2], json.loads(wrapper))
                    continue
                if now is not None:
                    yield rows({now[0]: now[1:]})
                now = [host, n, json.loads(wrapper)]
        if now is not None:
            yield rows({now[0]: now[1:]})

    schema = "host string, n long, wrapper string"
    by_task = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(local, schema)
    return by_task.repartition("host").sortWithinPartitions("host").mapInArrow(join, schema)


def extract(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html), text from the whole html.

    A null, empty or text-less html gives the empty string. Pages without a host share one wrapper. Rows may
    repeat; each is extracted by itself. Other columns are ignored; an empty table gives an empty result.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(rules(json.loads(w), n)) for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["host", "rule"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                read = {r: json.loads(r) for r in set(part.column(3).to_pylist()) if r is not None}
                texts = [main_text(p.as_py(), read.get(r)) for p, r in zip(part.column(2), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    known = persist_table(infer_wrappers(pages).mapInArrow(paths, "host string, rule string"), "wrappers")
    few = known.count() <= broadcast_hosts  # its size is checked; beyond that pages are shuffled by host
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    joined = p.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", "rule")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
