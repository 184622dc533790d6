"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text between block-level tags, with their path of tags. A
bidirectional LSTM in numpy reads hashed path, hashed words and a few measures of every block and labels each one with
the whole page in view. It learns from a bounded sample of the pages themselves, whose blocks are marked by plain hints
(article, main, nav, class names such as ``comments``); as one site's pages show few of those hints, each sampled page is
also shown in variants, its article in another container and some of its blocks once more inside menus, sidebars,
notices, forms, adverts or comments.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import Known, text_slices

#: Windows of pages learned from, blocks of the largest of them, and variants of each.
PAGES, MOST_BLOCKS, VARIANTS = 192, 160, 3
PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 160, 48, 6, 20
EPOCHS, BATCH, RATE = 10, 24, 8e-3
CACHED = 100_000
SLICE = 4 << 20

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes: open elements of the named kinds, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
IN_PARAGRAPH = BLOCK_TAGS - {"body", "html", "head", "title", "button", "option"}
#: Hints of what is and what is not the article, as tag names and as words of class and id.
ASIDE_TAGS = frozenset("nav footer aside form button select menu dialog option fieldset search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice popup modal newsletter subscribe signup login comment comments reply replies disqus related share "
    "sharing social widget toolbar pagination copyright form search".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())
CONTAINERS = ["article", "main", "main/article", "div.content", "div.post", "div.entry.content", "section.article", "div.article.body", "div.main/div.story"]
OTHERS = [
    "nav/ul/li", "div.menu/ul/li", "header/div", "footer/p", "div.footer", "aside/p", "div.sidebar/p", "div.cookie.notice/p", "div.banner", "form/p", "form/div",
    "div.ad", "div.advert", "div.comments/div.comment/p", "section.comments/p", "article/div.comments/p", "article/aside/p", "article/form/p", "article/div.ad",
    "article/section.comments/div.comment/p", "div.related/ul/li", "div.newsletter/form/p", "article/div.share", "main/aside/p", "main/div.sponsored/p", "div.popup",
    "article/footer/p", "main/nav/ul/li", "div.promo/p", "ul.breadcrumbs/li",
]

_PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b(?>[^>]*+)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|([^<]++|<)",
    re.S | re.I,
)
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+").findall


class Block(NamedTuple):
    path: str
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path of block-level tags with their class words, clean text, characters in links."""
    made, stack, parts, links, linked = [], [], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                made.append(Block("/".join(stack), text, linked))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].split(".", 1)[0] == name:
                del stack[i:]
                return

    for piece in _PIECES.finditer(page):
        text = piece[5]
        if text is not None:
            parts.append(text)
            linked += len(text) if links else 0
            continue
        if piece[3] is None:
            continue
        name = piece[3].lower()
        if name not in BLOCK_TAGS:
            if name == "a":
                links = 0 if piece[2] else 1
            elif name in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        if piece[2]:
            close(name)
            continue
        if name in IN_PARAGRAPH:
            close("p")
        if name in CLOSES:
            inner, outer = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                kind = stack[i].split(".", 1)[0]
                if kind in outer:
                    break
                if kind in inner:
                    del stack[i:]
                    break
        if name not in VOID_TAGS:
            words = [w for hint in _HINTS.findall(piece[4]) for w in _WORDS("".join(hint).lower())] if "=" in piece[4] else []
            stack.append(".".join([name, *words]))
    flush()
    return made


def hinted(path: str) -> int | None:
    """1 inside an article, 0 beside or against it, None if the path tells nothing."""
    article, found = False, None
    for element in path.split("/"):
        tag, *words = element.split(".")
        if tag in ("head", "title"):
            return 0
        if tag in ARTICLE_TAGS:
            article, found = True, 1
        elif tag in ASIDE_TAGS or tag == "header" and not article:
            return 0
        elif ASIDE_WORDS.intersection(words) and not (article and tag == "header"):
            return 0
        elif tag != "body" and ARTICLE_WORDS.intersection(words):
            found = 1
    return found


def marked(page: list[Block]) -> list[int]:
    """Labels of a page's blocks by hints; where no block is in an article, long unlinked text counts as one."""
    hints = [hinted(b.path) for b in page]
    if 1 in hints:
        return [int(h == 1) for h in hints]
    return [int(h is None and len(b.text) >= 40 and b.linked < 0.3 * len(b.text)) for h, b in zip(hints, page)]


def varied(page: list[Block], draw: np.random.Generator, labels: list[int]) -> tuple[list[Block], list[int]]:
    """The page with another article container and some of its texts once more outside the article."""
    container, made = str(draw.choice(CONTAINERS)), []
    top = "html/body" if draw.random() < 0.8 else "html/body/div"
    for block, label in zip(page, labels):
        leaf = block.path.rsplit("/", 1)[-1]
        made.append((block._replace(path=f"{top}/{container}/{leaf}") if label else block, label))
    for _ in range(int(draw.integers(1, 5))):
        where = f"{top}/{draw.choice(OTHERS)}"
        at = int(draw.integers(0, len(made) + 1))
        if "comments" in where or "footer" in where:
            at = max(at, int(draw.integers(0, len(made) + 1)))
        count = int(draw.integers(1, 4))
        for _ in range(count):
            source = page[int(draw.integers(0, len(page)))]
            made.insert(at, (Block(where, source.text, len(source.text) if where.endswith("li") else 0), 0))
    return [b for b, _ in made], [y for _, y in made]


class Features:
    """Vectors of blocks: hashed path elements and their parts, hashed words, measures."""

    def __init__(self):
        self.paths = Known(self._path, CACHED)
        self.words = Known(lambda w: zlib.crc32(w.encode("utf-8", "replace")) % WORD_WIDTH, CACHED)

    @staticmethod
    def _path(path: str) -> np.ndarray:
        made = np.zeros(PATH_WIDTH, dtype=np.float32)
        elements = path.split("/")
        for element in elements:
            for part in element.split("."):
                made[zlib.crc32(part.encode()) % PATH_WIDTH] = 1
        made[zlib.crc32(b"leaf " + elements[-1].split(".")[0].encode()) % PATH_WIDTH] = 1
        return made

    def __call__(self, page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
        """Vectors of a page's blocks, or of those from ``first`` on of a page of ``total``."""
        total = total or len(page)
        made = np.zeros((len(page), PATH_WIDTH + WORD_WIDTH + MEASURES), dtype=np.float32)
        for row, (i, block) in zip(made, enumerate(page)):
            row[:PATH_WIDTH] = self.paths[block.path]
            words = block.text.split()
            codes = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
            row[PATH_WIDTH:-MEASURES] = np.bincount(codes, minlength=WORD_WIDTH) / len(words)
            size = len(block.text)
            stops = sum(map(block.text.count, ".,;:!?"))
            row[-MEASURES:] = np.log1p(size) / 5, np.log1p(len(words)) / 4, block.linked / size, stops / len(words), (first + i) / total, 1 / (1 + first + i)
        return made


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks with one logistic output each."""

    def __init__(self):
        draw, width = np.random.default_rng(5), PATH_WIDTH + WORD_WIDTH + MEASURES
        self.w = {}
        for way in "fb":
            self.w["x" + way] = (draw.normal(0, 0.1, (width, 4 * HIDDEN))).astype(np.float32)
            self.w["h" + way] = (draw.normal(0, HIDDEN**-0.5 / 2, (HIDDEN, 4 * HIDDEN))).astype(np.float32)
            self.w["c" + way] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.w["o"] = draw.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.w["ob"] = np.zeros(1, dtype=np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, page, unit) of one direction over padded pages."""
        steps, n = mask.shape
        inputs = x @ self.w["x" + way] + self.w["c" + way]
        h = c = np.zeros((n, HIDDEN), dtype=np.float32)
        made = np.zeros((steps, n, HIDDEN), dtype=np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.w["h" + way]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = (f * c + i * g) * m
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, fresh))
            c = fresh
            h = o * np.tanh(c) * m
            made[t] = h
        return made

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask, None), self._run("b", x, mask, None)], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["ob"])

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy, back through time in both directions."""
        kept = {way: [] for way in "fb"}
        states = {way: self._run(way, x, mask, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        wrong = ((_sigmoid(both @ self.w["o"] + self.w["ob"]) - y) * mask / mask.sum()).astype(np.float32)
        made = {"o": np.einsum("tn,tnh->h", wrong, both), "ob": wrong.sum(keepdims=True)[0]}
        for k, way in enumerate("fb"):
            out = wrong[..., None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            back = np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32)
            recurrent = np.zeros_like(self.w["h" + way])
            dh = dc = np.zeros((mask.shape[1], HIDDEN), dtype=np.float32)
            for t, h, c, i, f, o, g, fresh in reversed(kept[way]):
                m = mask[t][:, None]
                dh = (dh + out[t]) * m
                bent = np.tanh(fresh)
                dc = (dc + dh * o * (1 - bent**2)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                back[t] = dz
                recurrent += h.T @ dz
                dh, dc = dz @ self.w["h" + way].T, dc * f
            made["x" + way] = np.tensordot(x, back, ((0, 1), (0, 1)))
            made["h" + way], made["c" + way] = recurrent, back.sum(axis=(0, 1))
        return made

    def fit(self, pages: list[np.ndarray], labels: list[list[int]]) -> Labeller:
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [_padded([pages[i] for i in order[s : s + BATCH]], [labels[i] for i in order[s : s + BATCH]]) for s in range(0, len(order), BATCH)]
        first, second, step, draw = {}, {}, 0, np.random.default_rng(9)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in draw.permutation(len(groups)):
                step += 1
                for name, g in self.slopes(*groups[at]).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    move = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.w[name] = (self.w[name] - move).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length are read together."""
        made: list = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            most = max(1, 40_000 // len(pages[order[min(start + 255, len(order) - 1)]]))
            chosen = order[start : start + min(most, 256)]
            x, mask, _ = _padded([pages[i] for i in chosen], None)
            chances = self.chances(x, mask)
            for k, i in enumerate(chosen):
                made[i] = chances[: len(pages[i]), k] >= 0.5
            start += len(chosen)
        return made


def _padded(pages: list[np.ndarray], labels: list[list[int]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask, y = np.zeros((steps, len(pages)), dtype=np.float32), np.zeros((steps, len(pages)), dtype=np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
        if labels:
            y[: len(page), k] = labels[k]
    return x, mask, y


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each page's blocks with their marks: all of a page of at most ``MOST_BLOCKS``, else one after the other."""
    names = ["turn", "h", "first", "total", "paths", "texts", "linked", "marks"]
    kinds = [*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = blocks(html.as_py())
            marks, count = marked(page), -(-len(page) // MOST_BLOCKS)
            for turn in range(min(count, PAGES)):
                first = (h + turn) % count * MOST_BLOCKS
                part = page[first : first + MOST_BLOCKS]
                row = turn, h, first, len(page), [b.path for b in part], [b.text for b in part], [b.linked for b in part], marks[first : first + MOST_BLOCKS]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)


def sampled(pages: DataFrame) -> list:
    """At most ``PAGES`` windows of different pages, drawn by the hash of their text; of the same pages if there are too few.

    Pages without blocks are replaced by the next ones, twice as many at a time.
    """
    fields = "turn long, h long, first long, total long, paths array<string>, texts array<string>, linked array<long>, marks array<long>"
    left = pages.select(F.col("html").cast("string").alias("html")).filter(F.length("html") > 0).withColumn("h", F.xxhash64("html"))
    found, most = [], PAGES
    while sum(r["turn"] == 0 for r in found) < PAGES:
        drawn = left.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
        if drawn is None:
            break
        texts = left.filter(F.col("h") <= drawn).groupBy("h").agg(F.min("html").alias("html"))
        found += texts.mapInArrow(_windows, fields).orderBy("turn", "h").limit(PAGES).collect()
        left, most = left.filter(F.col("h") > drawn), 2 * most
    return sorted(found, key=lambda r: (r["turn"], r["h"]))[:PAGES]


def trained(pages: DataFrame) -> Labeller:
    """The labeller fitted on windows of pages of any length; it is untrained only if no page has a block to label."""
    draw, features, xs, ys = np.random.default_rng(13), Features(), [], []
    for row in sampled(pages):
        page, marks = [Block(*b) for b in zip(row["paths"], row["texts"], row["linked"])], row["marks"]
        for part, labels in [(page, marks)] + [varied(page, draw, marks) for _ in range(VARIANTS)]:
            xs.append(features(part, row["first"], row["total"] + len(part) - len(page)))
            ys.append(labels)
    return Labeller().fit(xs, ys) if xs else Labeller()


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (main blocks joined by line ends, empty if none), n_chars.

    A null or empty page has an empty text. Rows are read on their own, so repeated rows and null ids stay as they are.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained(pages))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for start, end in text_slices(batch.column(2), SLICE):
                found = [blocks(t.as_py() or "") for t in batch.column(2)[start:end]]
                chosen = shared.value.label([features(page) for page in found])
                texts = ["\n".join(b.text for b, main in zip(page, mains) if main) for page, mains in zip(found, chosen)]
                made = [batch.column(0)[start:end], batch.column(1)[start:end], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
