"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block tags (a tag with
class or id words that mean furniture is part of the path as such). Per path, text length, link text,
punctuation and blocks are added up; the ratios per block are smoothed along the page and fused into
one weight (length x punctuation x unlinked share). The weights of paths that share an ancestor add
up: from the root, the content node is the deepest ancestor that holds nearly all of the page's weight.
Its parts are content where their weight isn't far below that of the heaviest part, and so are headings
and short blocks beside these. Where there are articles or main parts, the outermost of them are the
content nodes, all of them. List items, and three or more neighbouring blocks of one path, whose text is mostly
links are a list of links and left out; outside articles and main parts, so is any path whose text is mostly links.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments carry no
weight, by tag, role or class words, and are never content. A heading in the header of an article is.

Cases: null and empty html give an empty text; unclosed and stray tags are repaired as browsers do in
the common cases (a paragraph ends where the next block begins); a page without content has an empty
text; long pages and deep nesting take time in proportion to their size; repeated rows are read each; extra columns pass through, and result
columns get a leading underscore where they clash; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rookery.llm.staging import fresh, slices, utf8

MOST_LINKED = 0.6  # a list of links, or a path outside articles, has more link text than this share
HOLDS = 0.95  # share of the page's weight that the content node holds at least
FAR_BELOW = 0.05  # parts of the content node below this share of the heaviest one's weight aren't content
SMOOTH = (0.25, 0.5, 0.25)

# fixed values: HTML's tags by what they do here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
FURNITURE_TAGS = frozenset(
    "nav header footer aside form script style noscript template button select option textarea input fieldset menu "
    "dialog head title iframe object svg canvas audio video map".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners nav "
    "navbar navigation menu menus menubar topbar toolbar breadcrumb breadcrumbs sidebar sidebars side rail aside footer "
    "foot header head masthead notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login search share sharing social follow related recommended recommendations "
    "comment comments commentlist discussion disqus respond replies reply widget widgets pagination pager disclaimer "
    "copyright legal skip hidden".split()
)
# words that titles and topics have too: they count as a whole name or as its last part
EVERYDAY_WORDS = frozenset(
    "side head header foot rail search social share sharing follow legal notice notices alert discussion comment comments copyright "
    "skip hidden reply replies respond related recommended recommendations promotion consent navigation menu dialog subscription "
    "login signup".split()
)
FURNITURE_STEMS = ("adsby", "advert", "cookie", "newsletter", "sidebar", "sponsor")
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
NEVER_FURNITURE = frozenset("html body main article".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SELF_NESTING = {  # a tag that ends an open one of these, up to the given container
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def is_furniture(tag: str, attrs: str, within: bool = False) -> bool:
    """Whether tag, role, class or id say that what is inside isn't content; `within`: inside an article or main part.

    Ids of headings, sections and whatever is within are made from titles and say nothing, nor do class words of headings.
    """
    if tag in FURNITURE_TAGS:
        return True
    if tag in NEVER_FURNITURE or not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if tag in HEADINGS or name == "id" and (within or tag == "section"):
            continue
        if name in ("class", "id") and any(map(_furniture_words, value.split())):
            return True
    return False


def _furniture_words(name: str) -> bool:
    """Whether a class or id names furniture; `with-sidebar` and the like name what surrounds it."""
    found = _WORD.findall(_CAMEL.sub(" ", name).lower())
    for k, (before, word) in enumerate(zip(["", *found], found)):
        named = word in FURNITURE_WORDS and (word not in EVERYDAY_WORDS or k == len(found) - 1)
        if (named or word.startswith(FURNITURE_STEMS)) and before not in ("with", "has", "no", "without"):
            return True
    return False


@dataclass
class Block:
    node: int
    furniture: bool
    text: str
    linked: int  # characters of link text


@dataclass
class _Open:
    """An open tag. node: its tag path, or that around it for formatting; the last two are for furniture."""

    tag: str
    furniture: bool
    node: int
    in_article: bool = False
    headings: int = 0  # open headings around it


@dataclass
class _Reader:
    """Open tags and the text since the last block boundary. Tag paths are numbered, parents before children."""

    open: list[_Open] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)  # open tags by name
    furnished: list[_Open] = field(default_factory=list)  # open furniture
    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    number: dict[tuple[int, str], int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: [""])
    headings: int = 0

    def push(self, tag: str, attrs: str) -> None:
        within = self.count["article"] + self.count["main"] > 0
        node = self.open[-1].node if self.open else 0
        if tag not in INLINE:
            key = (node, tag)
            if key not in self.number:
                self.number[key] = len(self.tags)
                self.parents.append(node)
                self.tags.append(tag)
            node = self.number[key]
        own = _Open(tag, is_furniture(tag, attrs, within), node, self.count["article"] > 0, self.headings)
        if own.furniture:
            self.flush()
        self.open.append(own)
        self.count[tag] += 1
        self.headings += tag in HEADINGS
        if own.furniture:
            self.furnished.append(own)

    def pop(self, at: int) -> None:
        if self.open[at].furniture:
            self.flush()
        own = self.open.pop(at)
        self.count[own.tag] -= 1
        self.headings -= own.tag in HEADINGS
        if own.furniture:
            for i in range(len(self.furnished) - 1, -1, -1):  # nearly always the last one
                if self.furnished[i] is own:
                    del self.furnished[i]
                    break

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                node = self.open[-1].node if self.open else 0
                self.blocks.append(Block(node, self.furniture(), text, min(self.linked, len(text))))
            self.text = []
        self.linked = 0

    def furniture(self) -> bool:
        """Inside furniture; a heading in the header of an article isn't."""
        if len(self.furnished) == 1 and self.furnished[0].tag == "header":
            return not (self.furnished[0].in_article and self.headings > self.furnished[0].headings)
        return bool(self.furnished)

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.count["a"]:
            self.linked += len(text.strip())

    def close_to(self, depth: int) -> None:
        if any(o.tag not in INLINE for o in self.open[depth:]):
            self.flush()
        while len(self.open) > depth:
            self.pop(-1)

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_PARAGRAPH:
            self.end("p", implied=True)
        if tag in SELF_NESTING and any(self.count[t] for t in SELF_NESTING[tag][0]):
            ends, within = SELF_NESTING[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in within:
                    break
                if self.open[i].tag in ends:
                    self.close_to(i)
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self.push(tag, attrs)

    def end(self, tag: str, implied: bool = False) -> None:
        """Closes the last open `tag`; an end tag doesn't reach out of a block that it isn't part of."""
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i].tag
            if own == tag:
                if tag in INLINE:  # formatting that was closed inside other formatting
                    self.pop(i)
                else:
                    self.close_to(i)
                return
            if own not in INLINE and (implied or tag in INLINE):
                return
            if own in ("article", "main", "body", "html", "table") and tag not in ("article", "main", "body", "html", "table") and tag in ("p", "li", "td", "tr"):
                return


def read(page: str) -> _Reader:
    """Text blocks of a page, in page order, and the tree of their tag paths."""
    reader, at = _Reader(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            reader.add(html.unescape(page[at:stop]))
        if not m:
            break
        at, tag = m.end(), (m["tag"] or "").lower()
        if m["cdata"]:
            reader.add(m["cdata"])
        if not tag:
            continue
        if m["end"]:
            if tag not in VOID:
                reader.end(tag)
            continue
        closed = m["attrs"].endswith("/") and tag in ("svg", "path", "g", "use")
        if tag in RAW:  # read up to its own end tag
            finish = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = finish.end() if finish else len(page)
            reader.flush()
        elif not closed:
            reader.start(tag, m["attrs"])
    reader.flush()
    return reader


def path_weights(found: list[Block], n_nodes: int) -> np.ndarray:
    """Fused weight of each tag path; furniture has none."""
    lengths = np.array([0 if b.furniture else len(b.text) for b in found], float)
    points = np.array([0 if b.furniture else len(_PUNCTUATION.findall(b.text)) for b in found], float)
    if len(found) >= 3:
        smooth = lambda v: np.convolve(np.pad(v, 1, mode="edge"), SMOOTH, "valid")
        lengths, points = smooth(lengths), smooth(points)
    own = np.array([i for i, b in enumerate(found) if not b.furniture], np.int64)
    node = np.array([found[i].node for i in own], np.int64)
    add = lambda v: np.bincount(node, v, n_nodes)
    size, linked = add([len(found[i].text) for i in own]), add([found[i].linked for i in own])
    n, p, count = add(lengths[own]), add(points[own]), np.maximum(add(np.ones(len(own))), 1)
    weight = count * np.log1p(n / count) * np.log1p(1 + p / count) * (1 - linked / np.maximum(size, 1)) * np.sqrt(size / count)
    return np.where(linked <= MOST_LINKED * size, weight, 0.0)


LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr blockquote pre dd dt".split())


def content_paths(reader: _Reader, weights: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which tag paths are content, and whether articles or main parts say so."""
    parents, tags, n = reader.parents, reader.tags, len(reader.tags)
    held = weights.tolist()
    for i in range(n - 1, 0, -1):
        held[parents[i]] += held[i]
    inside = np.zeros(n, bool)
    marked = [t in ("article", "main") and h > 0 for t, h in zip(tags, held)]
    if any(marked):
        for i in range(1, n):
            inside[i] = inside[parents[i]] or marked[i]
        return inside, True
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parents[i]].append(i)
    node = 0
    while held[0] > 0 and not weights[node]:  # a node with text of its own isn't left for a part of it
        heaviest = max(children[node], key=held.__getitem__, default=0)
        if not heaviest or held[heaviest] < HOLDS * held[0] or tags[heaviest] in LEAVES:
            break
        node = heaviest
    if held[0] <= 0:
        return inside, False
    parts = [held[i] for i in children[node]]
    least = FAR_BELOW * max(parts, default=0.0)
    inside[node] = True
    for i in range(node + 1, n):
        around = inside[parents[i]]
        inside[i] = around and (parents[i] != node or held[i] >= least and held[i] > 0 or tags[i] in LEAVES)
    return inside, False


def main_text(page: str) -> str:
    """Content blocks of a page, two line breaks between them."""
    reader = read(page)
    found = reader.blocks
    weights = path_weights(found, len(reader.tags))
    inside, marked = content_paths(reader, weights)
    kept: list[str] = []
    for node, run in groupby(found, key=lambda b: b.node):
        own = [b for b in run if not b.furniture]
        links = sum(b.linked for b in own) > MOST_LINKED * sum(len(b.text) for b in own)
        listed = len(own) > 2 or reader.tags[node] == "li" or not marked and weights[node] == 0
        if inside[node] and not (links and listed):
            kept += [b.text for b in own]
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """`pages` without its html, with text and n_chars."""
    columns = [c for c in pages.columns if c != page]
    rest = pages.select(*columns)
    names = [fresh(rest, n) for n in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            texts = [main_text(x.decode()) for x in utf8(batch.column(page)).to_pylist()]
            made = {names[0]: pa.array(texts, pa.string()), names[1]: pa.array([len(x) for x in texts], pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    schema = T.StructType([*rest.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])
    return pages.mapInArrow(run, schema)
