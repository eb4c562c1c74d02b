"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element of a page is a node with features of its subtree (text, links, density), its
tag and attribute words, those of its ancestors, its depth and its siblings. Boosted trees
give the log-odds that a node belongs to the main text. Decoding is hierarchical: a node
can only be kept if its parent is, and of all such choices the most likely one is taken, so
no ancestor contradicts a descendant.

No table says what is main text, so the trees learn from the pages themselves: a bounded
sample of pages that name their article, and their paragraphs set anew into many invented
layouts, with menus, sidebars, notices, adverts, forms and comments around and inside.
"""

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import as_bytes
from .dom import Page

#: Pages the trees learn from, and layouts invented for them.
SAMPLE, LAYOUTS = 300, 600
#: Longer pages are not learnt from; they are extracted like all others.
SAMPLE_CHARS = 60_000
WORD_BUCKETS = 128
ROUNDS, DEPTH = 70, 5
#: Pages worked on at once.
TOGETHER = 256

TAGS = (
    "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl table tr td th form nav header footer aside blockquote "
    "pre figure figcaption fieldset span details address".split()
)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: Tags that ancestors pass down.
_ABOVE = "article main form nav header footer aside li table blockquote figure fieldset".split()


def _buckets(tokens: tuple[str, ...]) -> list[int]:
    """Each attribute word, and its first letters, in hashed buckets."""
    return [zlib.crc32(t.encode()) % WORD_BUCKETS for word in tokens for t in {word, "^" + word[:4]}]


def features(pages: list[Page]) -> np.ndarray:
    """A row per node of all pages, in order."""
    sizes = [len(p.tags) for p in pages]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    n = int(sum(sizes))
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.concatenate([np.array(p.parents) + o for p, o in zip(pages, first, strict=True)])
    parent[first] = first
    depth = np.concatenate([np.array(p.depths) for p in pages])
    tag = np.array([_TAG_AT.get(t, len(TAGS)) for p in pages for t in p.tags])

    # per node: characters, of these in links, words, sentence marks, blocks, nodes, paragraphs
    own = np.zeros((n, 7))
    before = np.zeros(n)
    for p, o in zip(pages, first, strict=True):
        last, so_far = (-1, -1), 0
        for block, node, said, linked in p.pieces:
            size = len(said) if not said.isspace() else 0
            if not size:
                continue
            at = o + node
            row = own[at]
            row[0] += size
            row[1] += size * linked
            row[2] += said.count(" ") + 1
            row[3] += said.count(".") + said.count(",") + said.count("!") + said.count("?")
            row[4] += (block, node) != last
            if not before[at]:
                before[at] = so_far
            so_far += size
            last = (block, node)
    own[:, 5] = 1
    own[:, 6] = tag == _TAG_AT["p"]
    sub = own.copy()
    by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    for at in reversed(by_depth[1:]):
        np.add.at(sub, parent[at], sub[at])

    words = np.zeros((n, WORD_BUCKETS), bool)
    i = 0
    for p in pages:
        for tokens in p.tokens:
            if tokens:
                words[i, _buckets(tokens)] = True
            i += 1
    mine = np.zeros((n, len(_ABOVE)), bool)
    for k, t in enumerate(_ABOVE):
        mine[:, k] = tag == _TAG_AT[t]
    above, tags_above = np.zeros_like(words), np.zeros_like(mine)
    for at in by_depth[1:]:
        above[at] = above[parent[at]] | words[parent[at]]
        tags_above[at] = tags_above[parent[at]] | mine[parent[at]]

    # siblings, in page order inside each parent
    order = np.lexsort((np.arange(n), parent))
    order = order[depth[order] > 0]
    siblings = np.bincount(parent[order], minlength=n)
    place = np.zeros(n)
    heads = np.flatnonzero(np.concatenate([[True], parent[order][1:] != parent[order][:-1]])) if len(order) else []
    if len(order):
        place[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(order)]])))
    near = np.zeros((n, 2))
    if len(order) > 1:
        same = parent[order][1:] == parent[order][:-1]
        near[order[1:][same], 0] = sub[order[:-1][same], 0]
        near[order[:-1][same], 1] = sub[order[1:][same], 0]
    alike = np.zeros(n)
    if len(order):
        pair, at, count = np.unique(parent[order] * (len(TAGS) + 1) + tag[order], return_inverse=True, return_counts=True)
        alike[order] = count[at]

    whole = np.maximum(sub[first, 0], 1)[page]
    chars = np.maximum(sub[:, 0], 1)
    up = np.maximum(sub[parent, 0], 1)
    numbers = np.stack(
        [
            np.log1p(sub[:, 0]), sub[:, 1] / chars, np.log1p(sub[:, 2]), 100 * sub[:, 3] / chars, np.log1p(sub[:, 4]),
            np.log1p(sub[:, 5]), np.log1p(sub[:, 6]), sub[:, 0] / sub[:, 5], sub[:, 0] / np.maximum(sub[:, 4], 1),
            np.log1p(own[:, 0]), sub[:, 0] / whole, sub[:, 0] / up, sub[parent, 1] / up, depth, siblings[parent], place,
            place / np.maximum(siblings[parent], 1), alike, np.log1p(near[:, 0]), np.log1p(near[:, 1]), before / whole,
        ],
        axis=1,
    )
    kinds = tag[:, None] == np.arange(len(TAGS) + 1)
    return np.concatenate([numbers, kinds, words, above, tags_above], axis=1).astype(np.float32)


def decode(page: Page, margins: np.ndarray) -> np.ndarray:
    """Which nodes stay: the likeliest choice in which a node stays only with its parent."""
    gain = margins.astype(float).tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parents[i]] += gain[i]
    kept = [True] * len(gain)
    for i in range(1, len(gain)):
        kept[i] = gain[i] > 0 and kept[page.parents[i]]
    return kept


# -- pages to learn from ------------------------------------------------------------------

CONTENT = "article post entry content story body text main page single prose markdown blog news document copy".split()
#: Attribute words of what is not main text, by kind.
OTHER = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs sitemap links toolbar".split(),
    "header": "header masthead site-header topbar banner logo branding hero-bar page-header top".split(),
    "footer": "footer site-footer copyright colophon legal bottom page-footer imprint credits".split(),
    "sidebar": "sidebar side widget related recommended popular trending rail aside more-stories see-also latest".split(),
    "notice": "notice cookie cookies consent gdpr alert warning disclaimer paywall popup modal toast message overlay "
    "announcement privacy".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion commercial ad-slot adbox banner-ad "
    "affiliate partner".split(),
    "form": "form newsletter subscribe signup login search contact-form register survey feedback-form poll".split(),
    "comments": "comments comment comment-list replies reply responses discussion disqus thread respond user-comments "
    "reviews guestbook".split(),
    "share": "share social follow sharing tags toolbox actions buttons".split(),
}
_TAG_OF = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}


class _Layout:
    """One invented page from given paragraphs."""

    def __init__(self, rng: np.random.Generator, texts: list[str]):
        self.rng, self.texts = rng, texts

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        got = self.pick(self.texts).split()
        n = int(self.rng.integers(low, high + 1))
        at = int(self.rng.integers(max(1, len(got) - n)))
        return " ".join(got[at : at + n]) or "text"

    def named(self, options) -> str:
        name = self.pick(options)
        if self.chance(0.3):
            name += self.pick(["-1", "-wrap", "-box", "-inner", "_block", " clearfix", " col", "-container", "-area"])
        return f' {self.pick(["class", "class", "id"])}="{name}"' if self.chance(0.92) else ""

    def items(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return "".join(f'<li><a href="#">{self.words(1, 4)}</a></li>' for _ in range(n))

    def other(self, kind: str) -> str:
        tag = _TAG_OF.get(kind, "div") if self.chance(0.5) else "div"
        # a plain element without a name says nothing; that a tag of its own may have
        name = self.named(OTHER[kind]) if tag != "div" else f' {self.pick(["class", "id"])}="{self.pick(OTHER[kind])}"'
        if tag == "section" and not name:
            name = ' id="comments"'
        if kind == "menu":
            inner = f"<ul>{self.items(3, 12)}</ul>" if self.chance(0.7) else " ".join(
                f'<a href="#">{self.words(1, 3)}</a>' for _ in range(6))
        elif kind == "header":
            inner = f"<a href='/'>{self.words(1, 3)}</a>" + self.pick(["", f"<h1>{self.words(2, 6)}</h1>", f"<p>{self.words(3, 12)}</p>"])
        elif kind == "footer":
            inner = self.pick([f"&copy; {self.words(2, 12)}", f"<p>{self.words(4, 40)}</p>", f"<ul>{self.items(3, 8)}</ul><p>{self.words(3, 25)}</p>"])
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3>" + self.pick([f"<ul>{self.items(3, 9)}</ul>", f"<p>{self.words(8, 60)}</p>", f"<div>{self.words(8, 60)}</div>"])
        elif kind == "form":
            inner = f"<p>{self.words(3, 30)}</p><label>{self.words(1, 3)}</label><input type='text'><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            each = self.pick(["div", "li", "article"])
            said = "".join(
                f'<{each} class="{self.pick(["comment", "reply", "comment-body", "response", "review"])}">'
                + self.pick([f"<b>{self.words(1, 2)}</b>", f'<span class="author">{self.words(1, 2)}</span>', ""])
                + f"<p>{self.words(4, 80)}</p></{each}>"
                for _ in range(int(self.rng.integers(1, 9)))
            )
            inner = f"<h3>{self.words(1, 3)}</h3>" + (f"<ul>{said}</ul>" if each == "li" else said)
        elif kind == "share":
            inner = " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(4))
        else:
            said = self.words(3, 50)
            inner = self.pick([said, f"<p>{said}</p>", f'<p>{said} <a href="#">{self.words(1, 3)}</a></p>', f"<span>{said}</span>"])
        return f"<{tag}{name}>{inner}</{tag}>"

    def block(self, text: str) -> str:
        mark = "data-main-text"
        kind = self.rng.random()
        if kind < 0.78:
            return f"<p {mark}>{self.linked(text)}" + self.pick(["</p>", "</p>", ""])
        if kind < 0.84:
            return f"<h2 {mark}>{' '.join(text.split()[:7])}</h2>"
        if kind < 0.89:
            half = text.split()
            return "<ul>" + "".join(f"<li {mark}>{' '.join(half[i : i + 12])}</li>" for i in range(0, min(len(half), 60), 12)) + "</ul>"
        if kind < 0.93:
            return f"<blockquote {mark}><p {mark}>{text}</p></blockquote>"
        if kind < 0.96:
            cells = text.split()
            return "<table>" + "".join(f"<tr><td {mark}>{' '.join(cells[i : i + 3])}</td></tr>" for i in range(0, min(len(cells), 18), 3)) + "</table>"
        return f"<div {mark}>{text}</div>"

    def linked(self, text: str) -> str:
        got = text.split()
        if len(got) > 8 and self.chance(0.3):
            at = int(self.rng.integers(len(got) - 3))
            got[at] = f'<a href="#">{got[at]}'
            got[at + 2] += "</a>"
        return " ".join(got)

    def page(self) -> str:
        short = self.chance(0.25)
        n = int(self.rng.integers(1, 3 if short else 16))
        blocks = [self.block(self.words(3, 14 if short else 120)) for _ in range(n)]
        if self.chance(0.8):
            blocks.insert(0, f"<h1 data-main-text>{self.words(3, 12)}</h1>")
        for kind in ("advert", "notice", "share", "sidebar", "form", "advert"):
            if self.chance(0.25):
                blocks.insert(int(self.rng.integers(1, len(blocks) + 1)), self.other(kind))
        if self.chance(0.25):
            blocks.append(self.other("comments"))
        inner = "".join(blocks)
        tag = self.pick(["article", "main", "div", "div", "section"])
        name = self.named(CONTENT)
        body = f"<{tag}{name}>{inner}</{tag}>"
        for _ in range(int(self.rng.integers(0, 3))):
            aside = self.other("sidebar") if self.chance(0.3) else ""
            end = self.other("comments") if self.chance(0.2) else ""
            body = f"<div{self.named(['wrapper', 'container', 'row', 'layout', 'page', 'site', 'content', 'main'])}>{body}{end}{aside}</div>"
        front = "".join(self.other(k) for k in ("notice", "header", "menu", "advert", "form") if self.chance(0.5))
        back = "".join(self.other(k) for k in ("comments", "sidebar", "advert", "form", "notice", "menu", "footer") if self.chance(0.45))
        return f"<html><head><title>x</title></head><body>{front}{body}{back}</body></html>"


def _own_labels(page: Page) -> np.ndarray | None:
    """1 for nodes with text of the page's only article or main element; None if there isn't one."""
    named = [i for i, t in enumerate(page.tags) if t == "article"] or [i for i, t in enumerate(page.tags) if t == "main"]
    if len(named) != 1:
        return None
    inside = {named[0]}
    for i in range(named[0] + 1, len(page.tags)):
        if page.parents[i] in inside:
            inside.add(i)
    return _up(page, inside)


def _up(page: Page, inside: set[int]) -> np.ndarray:
    y = np.zeros(len(page.tags))
    for _, node, said, _ in page.pieces:
        if node in inside and not said.isspace():
            y[node] = 1
    for i in range(len(y) - 1, 0, -1):
        y[page.parents[i]] = max(y[page.parents[i]], y[i])
    return y


def _inherited(page: Page) -> set[int]:
    """Marked nodes and all below them."""
    inside = set(page.marked)
    for i in range(1, len(page.tags)):
        if page.parents[i] in inside:
            inside.add(i)
    return inside


def fit(htmls: list[str], layouts: int = LAYOUTS) -> boosting.Trees:
    """Deterministic: pages are put in order first."""
    pages, labels, texts = [], [], []
    for html in sorted(htmls):
        page = Page(html)
        texts += [said for _, _, said, linked in page.pieces if not linked and said.count(" ") >= 8]
        y = _own_labels(page)
        if y is not None:
            pages.append(page)
            labels.append(y)
    rng = np.random.default_rng(11)
    for _ in range(layouts if texts else 0):
        page = Page(_Layout(rng, texts).page())
        pages.append(page)
        labels.append(_up(page, _inherited(page)))
    if not pages:
        return boosting.Trees(1.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    rows = np.concatenate([np.arange(len(y)) > 0 for y in labels])  # the page itself always stays
    return boosting.fit(features(pages)[rows], np.concatenate(labels)[rows], rounds=ROUNDS, depth=DEPTH)


def extract(htmls: list[str], trees: boosting.Trees) -> list[str]:
    out = []
    for k in range(0, len(htmls), TOGETHER):
        pages = [Page(h) for h in htmls[k : k + TOGETHER]]
        margins = trees.margins(features(pages))
        at = 0
        for page in pages:
            out.append(page.text(decode(page, margins[at : at + len(page.tags)])))
            at += len(page.tags)
    return out


def _fit_all(batches):
    htmls = []
    for batch in batches:
        for html in batch.column("html").to_pylist():
            if len(htmls) < 2 * SAMPLE:
                htmls.append(html)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(htmls))], pa.binary())], ["trees"])


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> boosting.Trees:
    """Fit on about ``sample`` pages, those with the least hash; one task reads them."""
    rows = pages.select(F.col(html).cast("string").alias("html")).filter("html IS NOT NULL")
    n = rows.count()
    share = int(min(1.0, sample / max(1, n)) * 2**32)
    few = rows.filter((F.pmod(F.xxhash64("html"), F.lit(2**32)) < share) & (F.length("html") <= SAMPLE_CHARS))
    found = few.repartition(1).mapInArrow(_fit_all, "trees binary").collect()
    return pickle.loads(found[0].trees) if found else fit([])


def _extract(sent):
    def run(batches):
        trees = sent.value
        for batch in batches:
            texts = extract([h.decode() for h in as_bytes(batch.column("html"))], trees)
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"]
            )

    return run


def main_text(
    pages: DataFrame, trees: boosting.Trees, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html"
) -> DataFrame:
    """A row per page: ``keys`` and text.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by one space. Null and empty pages, and pages without main text, have an empty
    text. Rows repeat as they do in ``pages``; further columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees)  # bounded by the rounds and the depth
    types = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    rows = pages.select(*keys, F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract(sent), f"{types}, text string")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, train(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op6_html_extraction": (op6_html_extraction, None)}
