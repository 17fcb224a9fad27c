"""Main text of web pages: flat text blocks, each with the word counts and link densities of itself and its neighbours, classified by a decision tree.

1. One pass over the markup cuts a page into blocks: text between two tags that are not inline. Scripts, styles, comments, form fields and other
   elements without running text are skipped; open containers are followed on a stack, so that a block knows what it lies in.
2. A block's features (FEATURES) are its words, the share of them inside links, the same of the blocks before and after it, the kind of its
   element, and the containers around it (by element, role, and words of class and id).
3. A decision tree is grown by Spark on the blocks of a small labelled table of page layouts (`labelled`), and walked for all blocks of
   a slice of pages at once.

Defined cases: a null page is empty; a page without main blocks has an empty text; character references are decoded once, also those without a semicolon
where browsers do so; white space of any kind inside a block becomes one space; a tag that the page's end cuts off is markup and goes; an unclosed
comment, script or style reaches to the end; an end tag that nothing opened is ignored. Pages are read whole, in time in proportion to their length.
Repeated rows are extracted one by one; null ids and urls stay null; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks

#: Fixed values of the format: elements that stay inside a line of text.
INLINE = set(
    "a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt rtc ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is never running text; the first group holds no markup at all.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIPPED = {"head", "noscript", "template", "select", "button", "object", "svg", "math", "canvas", "audio", "video", "datalist", "map"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

#: What a container says about its blocks: element names, roles, and words of class and id.
HINTS: dict[str, set[str]] = {
    "article": set("article main post entry story content body text".split()),
    "nav": set("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc directory".split()),
    "header": set("header masthead topbar banner byline meta".split()),
    "footer": set("footer foot contentinfo copyright colophon legal imprint".split()),
    "aside": set("aside sidebar side complementary widget related recommended share sharing social tags trending popular promo teaser".split()),
    "advert": set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promotion affiliate dfp".split()),
    "form": set("form search subscribe signup login newsletter poll".split()),
    "comments": set("comment comments commentlist disqus discussion replies reply respond responses feedback".split()),
    "notice": set("notice cookie cookies consent gdpr alert alertdialog dialog popup modal overlay disclaimer toast paywall warning hidden".split()),
}
BITS = {kind: 1 << k for k, kind in enumerate(HINTS)}
_WORD_BITS = {w: sum(BITS[k] for k, words in HINTS.items() if w in words) for words in HINTS.values() for w in words}
#: Words that say too little in a class: only an element or a role of that name counts.
_WEAK = {"post", "entry", "story", "content", "body", "text", "banner", "meta", "main", "side", "legal", "directory", "search", "reply", "feedback", "warning"}
_ELEMENT_BITS = {e: _WORD_BITS[e] for e in ("article", "main", "nav", "menu", "header", "footer", "aside", "form", "dialog", "search")}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_MARKUP = re.compile(r"<(?:(!--)(?:-?>)?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*+>)")
_OPENING = re.compile(r"<[a-zA-Z!?/]")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"\s(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_NAMES = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Containers that never hold main text, whatever is in them.
_BESIDE = BITS["nav"] | BITS["footer"] | BITS["aside"] | BITS["advert"] | BITS["comments"] | BITS["notice"]

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "listed", "article", "header", "form", "beside")


class Block:
    __slots__ = ("parts", "words", "linked", "element", "bits", "text")

    def __init__(self, element: str, bits: int):
        self.parts: list[str] = []
        self.element, self.bits, self.linked = element, bits, 0


def hints(name: str, attributes: str) -> int:
    """The kinds of container that an opening tag names."""
    bits = _ELEMENT_BITS.get(name, 0)
    if not attributes or name in ("html", "body"):
        return bits
    for m in _ATTRIBUTE.finditer(" " + attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            bits |= BITS["notice"]
        elif key in ("class", "id", "role"):
            for word in _NAMES.findall(value):
                if key == "role" or word not in _WEAK:
                    bits |= _WORD_BITS.get(word, 0)
    return bits


#: Elements that an opening tag closes if they are the innermost one: a paragraph by any element that is not inline, these by their like.
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_LIKE |= {h: _HEADINGS for h in _HEADINGS}


class Open:
    """The open elements of a page that are not inline."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.count: dict[str, int] = {}

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        return name

    def start(self, name: str, bits: int) -> None:
        like = _LIKE.get(name, set()) | {"p"}
        while self.stack[-1][0] in like:
            self.pop()
        _, outer, skipped = self.stack[-1]
        if name in ("article", "main"):
            outer &= ~BITS["form"]  # a form around a whole page
        self.stack.append((name, outer | bits, skipped or name in SKIPPED))
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if self.count.get(name):
            while self.pop() != name:
                pass


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; blocks without a word are left out."""
    out: list[Block] = []
    tree, block, in_link, at, end = Open(), Block("", 0), False, 0, len(html)

    def close() -> None:
        nonlocal block
        words = "".join(block.parts).split()
        if words:
            block.words, block.text = len(words), " ".join(words)
            out.append(block)
        block = Block(*tree.stack[-1][:2])

    while at < end:
        start = html.find("<", at)
        found = _MARKUP.match(html, start) if start >= 0 else None
        if found:
            stop, after = start, found.end()
        elif start < 0:
            stop = after = end
        elif _OPENING.match(html, start):
            stop, after = start, end  # the page's end cuts a tag off
        else:
            stop = after = start + 1
        if stop > at and not tree.stack[-1][2]:
            text = unescape(html[at:stop])
            block.parts.append(text)
            if in_link:
                block.linked += len(text.split())
        at = after
        if not found:
            continue
        if found[1]:
            # <!--> and <!---> are whole comments
            if html[after - 1] == "-":
                shut = _COMMENT_END.search(html, after)
                at = shut.end() if shut else end
            continue
        name, closing = (found[3] or "").lower(), bool(found[2])
        if name == "a":
            in_link = not closing
        elif name == "br":
            block.parts.append(" ")
        elif name in RAW:
            if not closing:
                shut = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(html, after)
                at = shut.end() if shut else end
        elif name and name not in INLINE and (name == "hr" or name not in VOID):
            outside = not tree.stack[-1][2]
            if closing:
                tree.end(name)
                in_link = False
            elif name != "hr":
                tree.start(name, hints(name, found[4]))
            # what is skipped does not end the block around it
            if outside and not tree.stack[-1][2] and name not in SKIPPED:
                close()
    close()
    return out


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row of FEATURES for each block; beyond a page's ends there are no words and no links."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), len(FEATURES)))
    if not flat:
        return out
    out[:, 0] = [b.words for b in flat]
    out[:, 1] = [min(1.0, b.linked / b.words) for b in flat]
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum([0, *(len(p) for p in pages if p)])[:-1]] = True
    last = np.append(first[1:], True)
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, 0:2], out[1:, 0:2]
    out[first, 2:4], out[last, 4:6] = 0, 0
    out[:, 6] = [b.element in _HEADINGS for b in flat]
    out[:, 7] = [b.element in ("li", "dt", "dd", "td", "th", "option") for b in flat]
    bits = np.array([b.bits for b in flat])
    for k, own in enumerate((BITS["article"], BITS["header"], BITS["form"], _BESIDE)):
        out[:, 8 + k] = (bits & own) > 0
    return out


class Tree:
    """A binary decision tree as arrays: `feature` is -1 at a leaf, `left` is taken where the feature is at most `threshold`."""

    def __init__(self, feature: list[int], threshold: list[float], left: list[int], right: list[int], label: list[int]):
        self.feature, self.left, self.right, self.label = (np.array(x, dtype=np.int64) for x in (feature, left, right, label))
        self.threshold = np.array(threshold, dtype=float)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.label[node] == 1
            own = node[inner]
            low = rows[inner, self.feature[own]] <= self.threshold[own]
            node[inner] = np.where(low, self.left[own], self.right[own])

    @classmethod
    def read(cls, debug: str) -> Tree:
        """From the text that Spark prints for a fitted tree; nodes are numbered as they are met."""
        lines = [x for x in debug.splitlines() if re.match(r" *(If|Else|Predict)", x)]
        feature, threshold, left, right, label = [], [], [], [], []
        at = 0

        def grow() -> int:
            nonlocal at
            node = len(feature)
            for column in (feature, left, right):
                column.append(-1)
            threshold.append(0.0)
            label.append(0)
            test = re.match(r" *If \(feature (\d+) <= (\S+)\)", lines[at])
            if test:
                feature[node], threshold[node] = int(test[1]), float(test[2])
                at += 1
                left[node] = grow()
                at += 1  # the line of the other side
                right[node] = grow()
            else:
                label[node] = round(float(lines[at].split(":")[1]))
                at += 1
            return node

        grow()
        return cls(feature, threshold, left, right, label)


def _layouts() -> Iterator[str]:
    """Page layouts by rule: text whose words begin with `m` is main text, other words begin with `x`."""

    def words(n: int, sign: str = "m") -> str:
        return " ".join(f"{sign}{k}" for k in range(n))

    def links(n: int, each: int = 1, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/">{words(each, "x")}</a></{tag}>' for _ in range(n))

    # lengths are the same in main text and around it, so that they only tell where nothing else does
    sizes = [1, 2, 3, 5, 8, 11, 13, 17, 21, 27, 34, 55, 89, 144, 233, 377]
    # what lies around main text: marked by an element, a class, a role or an id; and bare lists of links and short lines
    marks = ["nav", "header", "footer", "aside", "form"]
    marks += [f'div class="{c}"' for c in ("menu", "ad", "sponsored box", "cookie-notice", "newsletter", "sidebar", "related", "footer", "comment-list", "share")]
    marks += ['div role="alert"', 'section id="comments"', 'div id="masthead"', 'ol class="comments"']
    around = [f"<{m}><p>{words(n, 'x')}</p></{m.split()[0]}>" for n in sizes for m in marks]
    around += [f"<{m}><h3>{words(2, 'x')}</h3>{words(n, 'x')}<ul>{links(5, n)}</ul></{m.split()[0]}>" for n in sizes[::3] for m in marks]
    around += ["", f"<ul>{links(6)}</ul>", links(4, 2, "p"), f"<div>{links(3, 5, 'div')}</div>", f"<p>{words(4, 'x')}</p>{links(3, 2, 'p')}"]
    bodies = [tuple(sizes[(5 * k + 3 * j) % len(sizes)] for j in range(1 + k % 5)) for k in range(12)]
    turn = 0

    def beside() -> str:
        nonlocal turn
        turn += 7
        return around[turn % len(around)]

    for k, body in enumerate(bodies):
        title, text = f"<h1>{words(sizes[k % 9])}</h1>", "".join(f"<p>{words(n)}</p>" for n in body)
        listed = f"<h2>{words(2)}</h2><ul><li>{words(7)}</li><li>{words(2)}</li></ul><blockquote>{words(11)}</blockquote><table><tr><td>{words(1)}</td></tr></table>"
        linked = f'<p>{words(6)} <a href="/">{words(2)}</a> {words(4)}</p><p><a href="/">{words(5)}</a></p>'
        for _ in range(5):
            mains = [f"<article>{title}{text}{extra}</article>" for extra in ("", listed, linked)]
            mains += [
                f"<article><header>{title}<p>{words(4, 'x')}</p></header>{text}<footer>{words(5, 'x')}</footer></article>",
                f"<article>{title}{text}{beside()}{text}{beside()}</article>", f"<main>{title}{beside()}{text}</main>", f'<div role="main">{title}{text}</div>',
            ]
            if max(body) >= 25:
                mains += [f"<div>{title}{text}</div>", f"<div><div>{text}</div></div>", f"<form>{title}{text}</form>"]
            for main in mains:
                yield beside() + beside() + main + beside() + beside()


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: (FEATURES, label), a row for each block of the layouts."""
    pages = [blocks(x) for x in _layouts()]
    label = [float(b.text.startswith("m")) for page in pages for b in page]
    rows = [(*map(float, f), y) for f, y in zip(features(pages), label, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*FEATURES, "label")))


def train(rows: DataFrame, depth: int = 16) -> Tree:
    """Fits the tree on labelled blocks (FEATURES, label): a small table."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).coalesce(1)
    return Tree.read(DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=1, seed=5).fit(vectors).toDebugString)


def extract(pages: DataFrame, tree: Tree, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main): the main blocks of every page, joined by line breaks."""
    schema = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            found = [blocks(x) for x in part["html"]]
            main = iter(tree.predict(features(found)).tolist())
            kept = [[b.text for b in page if next(main)] for page in found]
            texts = ["\n".join(x) for x in kept]
            columns = (part["page_id"], part["url"], texts, list(map(len, texts)), list(map(len, found)), list(map(len, kept)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, schema)
