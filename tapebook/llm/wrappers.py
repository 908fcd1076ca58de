"""Operator 8: main text of pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages: nested elements, texts, text slots, optional elements `?`
and repeated groups `+`.  Pages are aligned one after another: an element that one side lacks becomes optional, elements
that recur become a repeated group, and where texts differ the text becomes a slot.  What stays is the template: a text
that stands at its place on all pages which have that place, of TEMPLATE_PAGES different pages or more.  Alignment of
wrappers with wrappers is the same step, so each task folds its pages by host, and the tasks' wrappers are folded as a
tree of small groups.  A page is read through its host's wrapper: the slots inside the best kind of content root that the
page has are the main text, the template's texts are not.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import columns, drop_table, grown, write_table

#: About so many wrappers of a host are folded in one group of a round.
FAN = 32
#: A text is the template's if it stands on all of at least so many different pages.
TEMPLATE_PAGES = 12
#: Elements are nested so deep at most; deeper ones stand beside each other, as in browsers (which stop at some hundred). Their blocks
#: are the same, and what is skipped is skipped at any depth.
DEPTH = 100
#: A task's wrappers are handed on when it holds those of so many hosts.
HOSTS = 2_000
#: Wrappers are broadcast up to these bytes, and joined by host beyond.
BROADCAST_BYTES = 16_000_000

#: HTML elements by how they are treated.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SKIPPED = frozenset("head nav footer aside form button select dialog menu script style textarea title noscript iframe xmp template svg canvas object audio video".split())
_CONTAINERS = frozenset("div section ul ol dl table".split())

#: Class, id and role names (whole ones) of containers that hold no main text.
_SKIPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo sidebar side-bar comments comment-list disqus_thread replies notice notices cookie cookies "
    "cookie-notice cookie-banner consent gdpr banner menu nav navbar navigation main-nav footer header masthead share sharing social related recommended subscribe newsletter "
    "breadcrumb breadcrumbs popup modal login signup toolbar pagination widget complementary search".split()
)
#: Words that names of such containers are made of, and words that only say where or what kind of box it is.
_SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion sidebar comment comments disqus replies notice notices cookie cookies consent gdpr "
    "menu nav navbar navigation share sharing social related recommended subscribe newsletter breadcrumb breadcrumbs popup modal pagination".split()
)
_FRAME_WORDS = frozenset(
    "area banner bar block bottom box buttons container footer form group holder icons inner inline items left links list more outer panel post posts articles stories reader readers "
    "right row section site slot strip thread top unit user users visitor widget wrap wrapper zone".split()
)
#: Names of containers that hold it.
_MAIN_NAMES = frozenset("article article-body articlebody post-content entry-content main-content story post content".split())

_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOPS = re.compile(r"[>\"']")
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


# ---------------------------------------------------------------- pages as nested elements


class Element:
    """An element (label: tag and names), its children: elements and texts in page order."""

    __slots__ = ("label", "children")

    def __init__(self, label: str):
        self.label, self.children = label, []


def _label(tag: str, attributes: str) -> str:
    if not attributes:
        return tag
    return _short_label(tag, attributes) if len(attributes) < 500 else _labelled(tag, attributes)


def _labelled(tag: str, attributes: str) -> str:
    names = [re.sub(r"\d+", "", value.strip("\"'")) for _, value in _NAMES.findall(attributes)]
    return " ".join([tag, *sorted(set(" ".join(names).split()))])


_short_label = lru_cache(4096)(_labelled)


class _Tags:
    """The ends of a page's tags. A quote counts behind = only; once one is left open to the end of the page, none counts."""

    def __init__(self, page: str):
        self.page, self.loose, self.last = page, False, page.rfind(">")

    def end(self, at: int) -> int:
        """The place of the > that closes the tag around at, or -1."""
        if at > self.last:
            return -1
        place = at
        while not self.loose:
            m = _STOPS.search(self.page, place)
            if m is None:
                self.loose = True
            elif m[0] == ">":
                return m.start()
            elif self.page[at : m.start()].rstrip()[-1:] == "=" if m.start() - at < 200 else self.page[m.start() - 1] == "=":
                close = self.page.find(m[0], m.end())
                self.loose = close < 0
                place = close + 1
            else:
                place = m.end()
        return self.page.find(">", at)


@lru_cache(4096)
def _boilerplate(name: str) -> bool:
    """Whether a container's name says that it holds no main text: a listed name, or words that are all of the two lists, one of
    them a telling one (reader-comments, adSlot; not related-work, share-price)."""
    if name.lower() in _SKIPPED_NAMES:
        return True
    words = {w.lower() for w in _WORDS.findall(name)}
    return not words.isdisjoint(_SKIPPED_WORDS) and words <= _SKIPPED_WORDS | _FRAME_WORDS


def _skipped(label: str, inside: bool) -> bool:
    """Whether an element holds no main text; inside: it stands in an article's (or another root's) own content."""
    tag, _, names = label.partition(" ")
    if tag in _SKIPPED or tag == "header" and not inside:
        return True
    if tag == "article":
        return any("comment" in n for n in names.split())
    return tag in _CONTAINERS and any(map(_boilerplate, names.split()))


def _clean(held: list[str]) -> str:
    text = "".join(held)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _tidied(root: Element) -> Element:
    """The page with the texts between two elements as one, cleaned; what is skipped wherever it stands is emptied."""
    todo = [root]
    while todo:
        e = todo.pop()
        out: list[str | Element] = []
        held: list[str] = []
        for c in e.children:
            if isinstance(c, str):
                held.append(c)
                continue
            if held and (text := _clean(held)):
                out.append(text)
            held = []
            out.append(c)
            if _skipped(c.label, True):
                c.children = []
            else:
                todo.append(c)
        if held and (text := _clean(held)):
            out.append(text)
        e.children = out
    return root


def parse(page: str) -> Element:
    """The page's elements, in one pass over it. Missing end tags are implied as browsers do for paragraphs, items and cells;
    inline elements leave no trace but their texts; comments, scripts and other raw elements leave none at all. Texts are clean."""
    root = Element("")
    stack, tags = [root], [""]
    opened: dict[str, int] = {}  # how often each tag is on the stack
    beside: dict[str, int] = {}  # and how often it is open without being there, for its depth
    outer: dict[str, int] | None = None  # the same of what is around the skipped element at the end of the stack
    ends, low, at, n = _Tags(page), None, 0, len(page)

    def close(k: int) -> None:
        nonlocal beside, outer
        for tag in tags[k:]:
            opened[tag] -= 1
        del stack[k:], tags[k:]
        if outer is not None and k <= DEPTH + 1:
            beside, outer = outer, None

    def last(tag: str) -> int:
        return len(tags) - 1 - tags[::-1].index(tag) if tags[-1] != tag else len(tags) - 1

    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack[-1].children.append(page[at:])
            break
        following = page[start + 1 : start + 2]
        m = _TAG.match(page, start + 1)
        if m is None and following not in ("!", "?"):  # no tag: a plain character
            stack[-1].children.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        if m is None:
            mark, skip = ("-->", 4) if page.startswith("<!--", start) else ("]]>", 9) if page.startswith("<![CDATA[", start) else (">", 2)
            stop = page.find(mark, start + skip)
            at = stop + len(mark) if stop >= 0 else n
            continue
        stop = m.end() if page.startswith(">", m.end()) else ends.end(m.end())
        if stop < 0:
            stack[-1].children.append(page[start:])
            break
        at, tag, attributes = stop + 1, m[1].lower(), page[m.end() : stop]
        if following == "/":
            if tag in _INLINE:
                continue
            if beside.get(tag):
                beside[tag] -= 1
                stack[-1].children.append(Element(tag))
            elif opened.get(tag):
                close(last(tag))
            continue
        if tag in _RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{tag}", at)
            stop = page.find(">", stop) if stop >= 0 else -1
            at = stop + 1 if stop >= 0 else n
            continue
        if tag in _INLINE:
            if tag == "br":
                stack[-1].children.append(" ")
            continue
        if tag in _CLOSES_P and opened.get("p"):
            close(last("p"))
        if (closed := _CLOSED_BY.get(tag)) and tags[-1] in closed:
            close(len(tags) - 1)
        if tag == "tr" and tags[-1] == "tr":
            close(len(tags) - 1)
        e = Element(_label(tag, attributes))
        stack[-1].children.append(e)
        if tag in _VOID or attributes.endswith("/"):
            continue
        if len(stack) > DEPTH + 1 or len(stack) == DEPTH + 1 and not _skipped(e.label, True):
            beside[tag] = beside.get(tag, 0) + 1
            continue
        if len(stack) == DEPTH + 1:
            beside, outer = {}, beside
        stack.append(e)
        tags.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
    return _tidied(root)


# ---------------------------------------------------------------- wrappers

# A node of a wrapper is [label, often, nodes] or, for a text, ["#", often, [], texts, pages, slot].  often: "" once, "?"
# optional, "+" repeated, "*" both; "()" labels a repeated group of several nodes.  texts: what stands there on all pages
# so far; pages: the smallest fingerprints of them, TEMPLATE_PAGES at most; slot: other texts stood there too.


def _either(a: str, b: str) -> str:
    many = "+" in (x := a + b) or "*" in x
    maybe = "?" in x or "*" in x
    return "*" if many and maybe else "+" if many else "?" if maybe else ""


def _key(node: list) -> str:
    """What nodes match by: the label, of a group that of its first node."""
    return node[0] if node[0] != "()" else node[2][0][0]


def _body(node: list) -> list:
    """What a repeated group repeats; an element alone is a group of one."""
    return node[2] if node[0] == "()" else [[node[0], "", *node[2:]]]


def _merged(a: list, b: list, often: str, one_page: bool) -> list:
    """Two nodes with one key as one; one_page: both stand on the same page, so that each one's texts stand on it."""
    if "()" in (a[0], b[0]):
        body = _flat(align(_body(a), _body(b), one_page))
        often = _either(often, "+")
        return [body[0][0], often, *body[0][2:]] if len(body) == 1 else ["()", often, body]
    if a[0] != "#":
        return [a[0], often, align(a[2], b[2], one_page)]
    both = set(a[3]) | set(b[3])
    texts = sorted(both if one_page else set(a[3]) & set(b[3]))
    slot = a[5] or b[5] or not one_page and a[3] != b[3]
    return ["#", often, [], texts, sorted(set(a[4]) | set(b[4]))[:TEMPLATE_PAGES] if texts else [], slot]


def _optional(node: list) -> list:
    return [node[0], _either(node[1], "?"), *node[2:]]


def align(a: list, b: list, one_page: bool = False) -> list:
    """The nodes of both lists in order, those that match merged, the others optional. In each list no key recurs, so the
    longest common sequence is the longest rising one of the places in b."""
    ka, places = [_key(x) for x in a], {_key(x): j for j, x in enumerate(b)}
    tails: list[int] = []
    rows: list[int] = []
    before: dict[int, int | None] = {}
    for i, key in enumerate(ka):
        if (j := places.get(key)) is None:
            continue
        k = bisect_left(tails, j)
        before[i] = rows[k - 1] if k else None
        tails[k:] = [j] if k == len(tails) else [j, *tails[k + 1 :]]
        rows[k:] = [i] if k == len(rows) else [i, *rows[k + 1 :]]
    matched, i = [], rows[-1] if rows else None
    while i is not None:
        matched.append((i, places[ka[i]]))
        i = before[i]
    out, i, j = [], 0, 0
    for x, y in reversed(matched):
        out += map(_optional, a[i:x] + b[j:y])
        out.append(_merged(a[x], b[y], _either(a[x][1], b[y][1]), one_page))
        i, j = x + 1, y + 1
    return _grouped([*out, *map(_optional, a[i:] + b[j:])], one_page)


def _grouped(nodes: list, one_page: bool) -> list:
    """Nodes in which no key recurs: neighbours that match become one repeated node, and what lies from one occurrence of a
    key to its next becomes a repeated group."""
    while True:
        out: list = []
        for node in nodes:
            if out and _key(out[-1]) == _key(node):
                out[-1] = _merged(out[-1], node, _either(_either(out[-1][1], node[1]), "+"), one_page)
            else:
                out.append(node)
        seen: dict[str, int] = {}
        for k, node in enumerate(out):
            if (first := seen.setdefault(key := _key(node), k)) < k:
                break
        else:
            return out
        starts = [i for i in range(first, len(out)) if _key(out[i]) == key] + [len(out)]
        body: list = []
        for a, z in zip(starts, starts[1:]):
            share = _grouped(_flat([x for y in out[a:z] for x in (y[2] if y[0] == "()" else [y])]), one_page)
            body = _flat(align(body, share, one_page)) if body else share
        single = len(body) == 1
        nodes = [*out[:first], [body[0][0], _either(body[0][1], "+"), *body[0][2:]] if single else ["()", "+", body]]
        if single or not any(_key(x) == _key(nodes[-1]) for x in out[:first]):
            return nodes


def _flat(nodes: list) -> list:
    """A repeated group within the repeated group that is being formed says nothing more."""
    return [x for y in nodes for x in ([_optional(z) for z in _flat(y[2])] if y[0] == "()" else [y])]


def _value(text: str) -> str:
    """A text, or for a long one its fingerprint."""
    return text if len(text) <= 80 else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _page(e: Element) -> str:
    """A fingerprint of the texts that the page does not share with others by chance: those outside skipped elements."""
    said = hashlib.blake2b(digest_size=6)

    def walk(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                said.update(c.encode("utf-8", "surrogatepass") + b"\n")
            elif not _skipped(c.label, True):
                walk(c)

    walk(e)
    return said.hexdigest()


def skeleton(e: Element, page: str | None = None) -> list:
    """The wrapper of one page: every text is the template's so far."""
    page = _page(e) if page is None else page
    nodes: list = []
    for c in e.children:
        node = [c.label, "", skeleton(c, page)] if isinstance(c, Element) else ["#", "", [], [_value(c)], [page], False]
        if nodes and nodes[-1][0] == node[0]:
            nodes[-1] = _merged(nodes[-1], node, "+", True)
        else:
            nodes.append(node)
    return _grouped(nodes, True)


def expression(nodes: list) -> str:
    """The wrapper as a regular expression, to look at: template texts as they are, slots as TEXT."""
    said = []
    for node in nodes:
        label, often, inner = node[:3]
        body = ("TEXT" if node[5] else "|".join(node[3])) if label == "#" else f"({expression(inner)})" if label == "()" else f"<{label}>{expression(inner)}</>"
        said.append(f"({body}){often}" if often and label != "()" else body + often)
    return "".join(said)


# ---------------------------------------------------------------- reading


class _Place:
    """An element path of a wrapper: the places inside, the template's texts there, and the kinds of content root that it is."""

    __slots__ = ("inside", "template", "kinds")

    def __init__(self) -> None:
        self.inside: dict[str, _Place] = {}
        self.template: set[str] = set()
        self.kinds: list[int] = []


def _placed(nodes: list, place: _Place) -> None:
    for node in nodes:
        if node[0] == "#":
            if len(node[4]) >= TEMPLATE_PAGES:
                place.template.update(node[3])
        elif node[0] == "()":
            _placed(node[2], place)
        else:
            _placed(node[2], place.inside.setdefault(node[0], _Place()))


def _is_main(label: str, place: _Place) -> tuple[bool, ...]:
    """By kind of content root, the better ones first: the article; the main element or what is named so; what is named like
    content; whatever holds paragraphs; the body."""
    tag, *names = label.lower().split(" ")
    paragraphs = any(x.split(" ")[0] == "p" for x in place.inside)
    return tag == "article", tag == "main" or "main" in names, tag in _CONTAINERS and not _MAIN_NAMES.isdisjoint(names), paragraphs, tag == "body"


KINDS = 5


def _rooted(place: _Place, kind: int) -> None:
    """Mark the outermost places of a kind, not inside anything that is skipped."""
    for label, p in place.inside.items():
        if _skipped(label, False):
            continue
        if _is_main(label, p)[kind]:
            p.kinds.append(kind)
        else:
            _rooted(p, kind)


@lru_cache(512)
def _loaded(wrapper: str) -> _Place:
    root = _Place()
    _placed(json.loads(wrapper), root)
    for kind in range(KINDS):
        _rooted(root, kind)
    root.kinds.append(KINDS)
    return root


_NOWHERE = _Place()


def read(page: str, wrapper: str) -> str:
    """The main text of a page through its host's wrapper: the slots inside the content roots of the best kind that the page
    has, blocks joined by \\n."""
    root, places = parse(page), _loaded(wrapper)
    best = [KINDS]

    def look(e: Element, p: _Place) -> None:
        for c in e.children:
            if isinstance(c, Element) and not _skipped(c.label, False):
                below = p.inside.get(c.label, _NOWHERE)
                best[0] = min([best[0], *below.kinds])
                look(c, below)

    look(root, places)
    out: list[str] = []

    def walk(e: Element, p: _Place, inside: bool) -> None:
        for c in e.children:
            if isinstance(c, str):
                if inside and (not p.template or _value(c) not in p.template):
                    out.append(c)
            elif not _skipped(c.label, inside):
                below = p.inside.get(c.label, _NOWHERE)
                walk(c, below, inside or best[0] in below.kinds)

    walk(root, places, best[0] == KINDS)
    return "\n".join(out)


def covers(nodes: list, page: str) -> bool:
    """Whether every element path of the page is one of the wrapper's."""
    places = _loaded(json.dumps(nodes))

    def known(e: Element, p: _Place) -> bool:
        return all(c.label in p.inside and known(c, p.inside[c.label]) for c in e.children if isinstance(c, Element))

    return known(parse(page), places)


# ---------------------------------------------------------------- over tables


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


_FOUND = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def infer(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) for every host; every page takes part. A null url's host is empty; null html is an empty page.

    Each task gives one wrapper a host (a few, where it meets very many hosts). They are folded in rounds: groups of about
    `fan` of a host's wrappers, each round written, until every host has one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array(held), pa.array([json.dumps(w) for w in held.values()])], schema=_FOUND)
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = skeleton(parse(page or ""))
                held[host] = align(held[host], nodes) if host in held else nodes
                if len(held) > HOSTS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *rest = sorted(pdf["wrapper"])
        nodes = json.loads(first)
        for text in rest:
            nodes = align(nodes, json.loads(text))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(nodes)]})

    spark = pages.sparkSession
    kind = "host string, wrapper string"
    path = write_table(columns(pages, "url", "html").select(_host(F.col("url")).alias("host"), "html").mapInArrow(of, kind), "wrappers")
    while True:
        now = spark.read.schema(kind).parquet(path)
        many = now.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")
        if many.first() is None:
            return now
        dealt = now.join(many, "host").withColumn("share", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / fan)))
        folded = dealt.groupBy("host", "share").applyInPandas(fold, kind)
        after = write_table(now.join(many, "host", "left_anti").unionByName(folded), "wrappers")
        drop_table(spark, path)
        path = after


def extracted(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns and text of every page. Null or empty html, and pages without main text, give an empty text.

    Repeated rows stay and count as one page; so do pages with the same texts. A page of any length or depth is read whole."""
    wrappers = infer(pages)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    docs = columns(pages, *dict.fromkeys((*carry, "url", "html"))).withColumn("_host", _host(F.col("url")))
    named = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    rows = docs.join(F.broadcast(named) if size <= BROADCAST_BYTES else named, "_host", "left").select(*carry, "html", "_wrapper")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [read(p, w) if p else "" for p, w in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(text, pa.string())], names=[*b.schema.names[:-2], "text"])

    return rows.mapInArrow(of, grown(rows.schema.fields[:-2], "text string"))


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
