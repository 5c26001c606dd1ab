"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks, runs of text between the borders of block-level elements. A block has features of its
ancestors (tags, words of their class and id) and of its text (length, share of linked text, end marks, place in the
page). The field scores every block and every pair of neighbours, is trained by gradient steps on the likelihood of
labelled pages, and the best labelling of a page is found by the Viterbi algorithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature buckets, pages that are learnt from at most, training rounds.
SIZE, FIT_PAGES, ROUNDS = 1 << 14, 300, 30

#: Fixed values of HTML: elements that end a block, have no end tag, whose content is no text,
#: that stand in a head, whose content knows self-closed elements, and that end an open one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe svg annotation annotation-xml canvas audio video textarea select button".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
_SCOPES = {"p": BLOCKS - {"p"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
           "th": {"tr", "table"}, "option": {"select"}}

#: Words in class, id and role that tell what is not the article.
ASIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|aside|widget|nav\w*|menu|breadcrumbs?|crumbs|toolbar|"
    r"footer|foot|bottom|copyright|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|search|form|comments?|respond|replies|reply|discussion|disqus|share|sharing|social|related|recommend\w*|more|tags?|"
    r"pagination|pager|skip|hidden|sr-only|legal|disclaimer|contentinfo|complementary|navigation)(?:$|[-_\s\d])", re.I)
_OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
_SPACE = re.compile(r"\s+")


@lru_cache(1 << 16)
def set_apart(tag: str, marks: str) -> bool:
    """Whether an element is no part of an article by its tag or by the words of its class, id and role."""
    return tag in _OUTSIDE or bool(ASIDE.search(marks))


class Element:
    """An open element with its parent, and what the elements from the page down to it come to: their tags, and the
    depths of the outermost and innermost article or main and of the innermost that is set apart (-1 for none)."""

    __slots__ = ("tag", "marks", "parent", "depth", "tags", "first", "article", "apart")

    def __init__(self, tag: str, marks: str, parent: Element | None) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.depth, self.tags, self.first, self.article, self.apart = 0, frozenset(), -1, -1, -1
        if parent:
            self.depth, self.tags, self.first, self.article, self.apart = parent.depth + 1, parent.tags, parent.first, parent.article, parent.apart
        if tag not in self.tags:
            self.tags |= {tag}
        if tag in ("article", "main"):
            self.article = self.depth
            self.first = self.depth if self.first < 0 else self.first
        if set_apart(tag, marks):
            self.apart = self.depth

    def above(self) -> Iterator[Element]:
        """The element and those around it, from the inside."""
        at: Element | None = self
        while at:
            yield at
            at = at.parent


@dataclass
class Block:
    """Text of a block, the innermost element around it, and how much of it is linked."""

    text: str
    at: Element | None
    linked: int = 0


class _Cutter(HTMLParser):
    """Blocks of a page, for any mark-up: what is never closed ends with its parent, a stray end tag is passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.silent = self.links = self.linked = self.foreign = 0

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            self.blocks.append(Block(text, self.open[-1] if self.open else None, self.linked))
        self.held, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        if any(x.tag in BLOCKS for x in self.open[depth:]):
            self._end_block()
        for x in self.open[depth:]:
            self.silent -= x.tag in SILENT
            self.links -= x.tag == "a"
            self.foreign -= x.tag in FOREIGN
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":  # ends an unclosed head
            depth = next((i for i, x in enumerate(self.open) if x.tag == "head"), None)
            if depth is not None:
                self._pop(depth)
        elif tag not in HEAD:
            self._end_head()
        ends, scope = CLOSES.get(tag, {"p"} if tag in BLOCKS else set()), _SCOPES.get(tag, BLOCKS - {"p"})
        for depth in range(len(self.open) - 1, -1, -1) if ends else ():
            if self.open[depth].tag in ends:
                self._pop(depth)
                if tag not in ("tr", "td", "th", "dt", "dd"):
                    break
            elif depth < len(self.open) and self.open[depth].tag in scope:
                break
        if tag in BLOCKS:
            self._end_block()
        elif tag in ("br", "wbr", "img"):
            self.held.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        if any(k == "hidden" or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs):
            marks += " hidden"
        self.open.append(Element(tag, marks, self.open[-1] if self.open else None))
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.foreign += tag in FOREIGN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = self.foreign or tag in FOREIGN or tag in SILENT  # elsewhere the slash says nothing
        self.handle_starttag(tag, attrs)
        if ends and tag not in VOID:
            self.handle_endtag(tag)

    def _end_head(self) -> None:
        """Ends a head that is not closed before something that cannot stand in it."""
        if self.open and self.open[-1].tag == "head":
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self._pop(depth)
                return
        if tag == "p":
            self._end_block()

    def handle_data(self, data: str) -> None:
        if self.silent and not data.isspace():
            self._end_head()
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str) -> list[Block]:
    """Blocks of a page in page order, without those of elements whose content is no text."""
    cutter = _Cutter()
    cutter.feed(html.replace("\0", ""))
    cutter.close()
    cutter._end_block()
    return cutter.blocks


def _bucket(name: str) -> int:
    value = 0xCBF29CE484222325
    for byte in name.encode():
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (value ^ (value >> 32)) % SIZE


_KNOWN: dict[str, int] = {}


def features(found: list[Block]) -> list[list[int]]:
    """Feature buckets of each block."""
    out = []
    for at, block in enumerate(found):
        around = block.at
        words = block.text.count(" ") + 1
        names = ["bias", "tag:" + (around.tag if around else ""), f"words:{min(words, 400).bit_length()}",
                 f"linked:{min(3, 4 * block.linked // max(1, len(block.text)))}", f"end:{block.text[-1] in '.!?:;…。'}",
                 f"place:{'first' if at == 0 else 'last' if at == len(found) - 1 else 'inner'}",
                 f"sign:{block.text[0] in '©®'}"]
        names += ["in:" + tag for tag in (sorted(around.tags) if around else ())]
        inside, apart = (around.article, around.apart) if around else (-1, -1)
        names.append(f"article:{inside >= 0}")
        names.append("outside:" + ("none" if apart < 0 else "below" if apart > inside else "above"))
        ids = []
        for name in names:
            if name not in _KNOWN:
                if len(_KNOWN) > 100_000:
                    _KNOWN.clear()
                _KNOWN[name] = _bucket(name)
            ids.append(_KNOWN[name])
        out.append(ids)
    return out


def told(found: list[Block]) -> list[int]:
    """Labels of a page that tells its article by mark-up: 1 in <article> or <main>, below nothing that is set apart.

    None of the blocks if the page has neither element; then it is not learnt from.
    """
    return [int(block.at is not None and block.at.first >= 0 and block.at.apart <= block.at.first) for block in found]


@dataclass
class Field:
    """Weights of (bucket, label), of (label, next label), and of the first label."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 2)))
    turns: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[ids].sum(axis=0) for ids in page])

    def best(self, page: list[list[int]]) -> list[int]:
        """The best labelling of a page (Viterbi)."""
        if not page:
            return []
        scores, (stay0, turn1), (turn0, stay1) = self.scores(page).tolist(), self.turns[0], self.turns[1]
        zero, one, back = scores[0][0] + self.start[0], scores[0][1] + self.start[1], []
        for a, b in scores[1:]:
            from0, from1 = zero + stay0 >= one + turn0, zero + turn1 > one + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = a + max(zero + stay0, one + turn0), b + max(zero + turn1, one + stay1)
        labels = [int(one > zero)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def step(self, page: list[list[int]], labels: list[int], rate: float) -> None:
        """A gradient step on the log-likelihood of a labelled page (forward and backward sums)."""
        scores, n = self.scores(page), len(page)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0] + self.start
        for i in range(1, n):
            forward[i] = scores[i] + np.logaddexp(forward[i - 1][0] + self.turns[0], forward[i - 1][1] + self.turns[1])
        for i in range(n - 2, -1, -1):
            on = scores[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(self.turns[:, 0] + on[0], self.turns[:, 1] + on[1])
        total = np.logaddexp(*forward[-1])
        one = np.exp(forward + backward - total)
        for i, label in enumerate(labels):
            miss = -one[i]
            miss[label] += 1
            self.weights[page[i]] += rate * miss
            if i == 0:
                self.start += rate * miss
            else:
                pair = np.exp(forward[i - 1][:, None] + self.turns + scores[i] + backward[i] - total)
                self.turns -= rate * pair
                self.turns[labels[i - 1], label] += rate


def trained(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, seed: int = 3) -> Field:
    """A field of labelled pages, by gradient steps with a falling rate and shrinking weights."""
    made, random = Field(), np.random.default_rng(seed)
    for turn in range(rounds):
        for i in random.permutation(len(pages)):
            made.step(*pages[i], 0.2 / (1 + turn))
        made.weights *= 0.999
    return made


def training_pages() -> list[tuple[list[list[int]], list[int]]]:
    """Labelled pages in other layouts than the corpus may have; every part is named in its class, c for content.

    Combinations of a few layouts and parts, so that the field learns from all kinds of parts that are set apart.
    """
    line, link = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt.", "<a href='/x'>Lorem ipsum</a>"
    nav = f"<nav><ul><li>{link}</li><li>{link}</li><li>{link}</li></ul></nav>"
    apart = [f"<header><div>{line}</div></header>", f"<aside><h3>Ipsum</h3><p>{line}</p></aside>", f"<div class='sidebar'><p>{line}</p><ul><li>{link}</li></ul></div>",
             f"<div class='ad'>{line}</div>", f"<div id='cookie-notice'><p>{line}</p></div>", f"<form><label>Ipsum</label><p>{line}</p></form>",
             f"<section class='comments'><h2>Ipsum</h2><div class='comment'><p>{line} {line}</p></div></section>",
             f"<div class='related'><h3>Dolor</h3><ul><li>{link}</li><li>{link}</li></ul></div>", f"<div class='share'>{link} {link}</div>",
             f"<div class='breadcrumb'>{link} / {link}</div>", nav, f"<div class='newsletter'><p>{line}</p></div>"]
    content = ["<h1>Lorem ipsum</h1>", f"<p>{line}</p>", f"<p>{line} {line} {line}</p>", "<h2>Dolor sit</h2>", f"<ul><li>{line}</li><li>Ipsum {link}</li></ul>",
               f"<blockquote><p>{line}</p></blockquote>", f"<p>Amet {link} {line}</p>", "<p>Ipsum.</p>", f"<table><tr><td>Sed</td><td>{line}</td></tr></table>"]
    holders = (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div id='main'><div class='post'>", "</div></div>"))
    random, out = np.random.default_rng(5), []
    for _ in range(160):
        begin, end = holders[random.integers(len(holders))]
        inner, parts = [], [nav, *(apart[i] for i in random.integers(0, len(apart), 2))]
        for i in [0, *random.integers(1, len(content), random.integers(1, 7))]:
            inner.append("<span class='c'>" + content[i] + "</span>")
            if random.random() < 0.15:
                inner.append(apart[random.integers(1, len(apart))])
        after = [apart[i] for i in random.integers(0, len(apart), random.integers(0, 3))]
        html = "<html><body>" + "".join(parts) + begin + "".join(inner) + end + "".join(after) + f"<footer>&copy; {line}</footer></body></html>"
        found = blocks(html)
        labels = [int(any(x.marks == "c" for x in block.at.above())) for block in found]
        for block in found:
            kept, block.at = [x for x in block.at.above() if x.marks != "c"], None
            for x in reversed(kept):
                block.at = Element(x.tag, x.marks, block.at)
        out.append((features(found), labels))
    return out


def fit(pages: DataFrame, html: str = "html", url: str = "url", most: int = FIT_PAGES) -> Field:
    """Fits a field on the written pages above and on at most `most` pages of the corpus that tell their article and
    have fewer than 50,000 characters.

    The pages of the smallest url hashes are taken; features are made where the pages are, and one task learns.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x or "") for x in batch.column(0).to_pylist()]
            labels = [told(x) for x in found]
            rows = [(features(f), y) for f, y in zip(found, labels, strict=True) if 0 < sum(y) < len(y)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.list_(pa.int32()))),
                                              pa.array([y for _, y in rows], pa.list_(pa.int32()))], ["features", "labels"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x["features"], x["labels"]) for batch in batches for x in batch.to_pylist())
        made = trained(training_pages() + rows)
        yield pa.RecordBatch.from_pydict({name: [getattr(made, name).astype("<f8").tobytes()] for name in ("weights", "turns", "start")})

    chosen = pages.select(F.col(html).cast("string").alias("html"), F.xxhash64(F.col(url).cast("string")).alias("h"))
    chosen = chosen.where("html is not null and length(html) < 50000").orderBy("h", "html").limit(most).select("html")
    found = chosen.mapInArrow(label, "features array<array<int>>, labels array<int>").repartition(1)
    row = found.mapInArrow(learn, "weights binary, turns binary, start binary").first()
    if row is None:
        return trained(training_pages())
    return Field(np.frombuffer(bytes(row["weights"])).reshape(SIZE, 2), np.frombuffer(bytes(row["turns"])).reshape(2, 2),
                 np.frombuffer(bytes(row["start"])))


def main_text(html: str, model: Field) -> str:
    """Text of the blocks that the field takes as the article's, joined by line ends."""
    found = blocks(html)
    return "\n".join(block.text for block, label in zip(found, model.best(features(found)), strict=True) if label)


def extract(pages: DataFrame, model: Field, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; a null page is empty and has no text.

    White space within a block is one space; blocks are joined by one line end. Repeated rows give rows each; a page
    without article text gives an empty text. Other columns are not looked at.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [main_text(x, model) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(run, kind)
