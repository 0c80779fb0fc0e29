"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, and two clusters of lines.

The page is read as a stream of events of the standard library's parser. Every block of text becomes a line with the
length of its text and the number of tags in it. Ratios are smoothed along the page and cut in two by a threshold. The
dense lines choose the content: the articles that are dense for the most part or as a whole, or, where no article is marked up, the
deepest container that holds nearly all dense text, less its lists of links. All text there is returned, but for what is
marked as something else (menus, forms, notices, comments and so on).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts

# Elements of HTML by how they count here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
SKIPPED = {"head", "script", "style", "noscript", "template", "nav", "aside", "footer", "header", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "menu", "dialog", "audio", "video", "math", "title"}
#: A p element ends where one of these begins.
ENDS_P = BLOCKS - {"body", "caption", "head", "html", "legend", "li", "dd", "dt", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: Elements that end one another: a new one of the first ends the open one of these, up to the named container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark what isn't the article.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|advertisement|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|widget|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|comments?|comment-\w+|respond|disqus|discussion|replies|share|sharing|social|related|recommend\w*|toolbar|login|signup|search|complementary|contentinfo|pagination|pager)(?=$|[\s_-])", re.I)
#: The same for article elements, whose class often names their parts.
MARKED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|comment-\w+|replies|related|recommend\w*|teaser)(?=$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")


#: Elements that may hold an article; they and those that may hold a list of links.
CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "td"}
GROUPS = CONTAINERS | {"ul", "ol", "dl", "table", "p"}
#: Elements open at once, as in browsers; those beyond count as inside the last.
DEPTH = 512
#: Shares of text: of a kept article that is dense; of all dense text that the chosen container holds; of a dropped group that is links.
DENSE, HELD, LINKED = 0.5, 0.9, 0.5


class Blocks(HTMLParser):
    """Blocks of text as (text, tags, element around it, whether it is skipped, letters in links), from a stream of events.

    Elements are numbered in the order in which they begin, from 1, and know their parents: 0 is around all.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, whether it or one around it is skipped
        self.counts: Counter[str] = Counter()  # of open elements
        self.beyond: Counter[str] = Counter()  # of those that are too deep
        self.kinds, self.parents = ["html"], [0]
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, number, skipped = self.open[-1] if self.open else ("", 0, False)
            self.blocks.append((text, self.tags, number, skipped, self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, depth: int) -> None:
        self.end_block()
        for tag, _, _ in self.open[depth:]:
            self.counts[tag] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in ENDS_P and self.counts["p"]:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self.pop_to(at)
                    break
                if self.open[at][0] in ("td", "th", "caption", "button", "object", "table"):
                    break
        if tag in ENDS and any(self.counts[x] for x in ENDS[tag][0]):
            ended, within = ENDS[tag]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in within:
                    break
                if self.open[at][0] in ended:
                    self.pop_to(at)
                    if tag != "tr":
                        break
        if tag in BLOCKS:
            self.end_block()
            self.tags += 1
        if tag in VOID:
            return
        if len(self.open) >= DEPTH:
            self.beyond[tag] += 1
            return
        around = bool(self.open) and self.open[-1][2]
        skip = around or tag in SKIPPED
        if attrs and not skip and tag not in ("html", "body", "main"):
            marked = MARKED_ARTICLE if tag == "article" else MARKED
            skip = any(v and marked.search(v) or k == "hidden" for k, v in attrs if k in ("class", "id", "role", "hidden"))
        if skip and not around:
            self.end_block()
        self.parents.append(self.open[-1][1] if self.open else 0)
        self.open.append((tag, len(self.kinds), skip))
        self.kinds.append(tag)
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.beyond[tag]:
            self.beyond[tag] -= 1
            if tag in BLOCKS:
                self.end_block()
            return
        if not self.counts[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS or self.open[at][2]:
                    self.pop_to(at)
                else:
                    del self.open[at]
                    self.counts[tag] -= 1
                return
            if self.open[at][0] in ("article", "main", "body", "table") and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.counts["a"]:
            self.linked += len(data)


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Convolved with a Gaussian of standard deviation radius, its weights renewed at the ends."""
    weights = [math.exp(-(d * d) / (2 * radius * radius)) for d in range(-2 * radius, 2 * radius + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for d, w in enumerate(weights, i - 2 * radius):
            if 0 <= d < len(values):
                total += w * values[d]
                norm += w
        out.append(total / norm)
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """Cut between two clusters: the middle of their means, repeated until it stays."""
    cut = sum(values) / len(values)
    for _ in range(rounds):
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            return cut
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds; empty if there is none."""
    page = Blocks()
    page.feed(html)
    page.close()
    page.pop_to(0)
    return "\n".join(page.blocks[i][0] for i in chosen_blocks(page.blocks, page.kinds, page.parents))


def chosen_blocks(blocks: list[tuple], kinds: list[str], parents: list[int]) -> list[int]:
    """Places of the blocks of the article. Times and memory are linear in blocks and elements."""
    usable = [i for i, b in enumerate(blocks) if not b[3]]
    if not usable:
        return []
    ratios = smoothed([len(b[0]) / max(1, b[1]) for b in blocks])
    cut = threshold(ratios)
    dense = {i for i in usable if ratios[i] >= cut} or set(usable)
    weight, whole, tags = ([0] * len(kinds) for _ in range(3))  # letters of dense text, of all, and tags of each element
    for i in usable:
        n = len(blocks[i][0])
        whole[blocks[i][2]] += n
        tags[blocks[i][2]] += blocks[i][1]
        weight[blocks[i][2]] += n if i in dense else 0
    for e in range(len(kinds) - 1, 0, -1):
        whole[parents[e]] += whole[e]
        tags[parents[e]] += tags[e]
        weight[parents[e]] += weight[e]
    outer = [0] * len(kinds)  # the article around an element, the outermost
    for e in range(1, len(kinds)):
        outer[e] = outer[parents[e]] or (e if kinds[e] == "article" else 0)
    articles = {e for e in outer if e and whole[e]}
    mains = [e for e, kind in enumerate(kinds) if kind == "main" and weight[e]]
    best = max(articles, key=lambda e: (weight[e], -e), default=0)
    if best and weight[best] and (weight[best] >= 0.5 * weight[0] or not mains):
        kept = {best, *(e for e in articles if weight[e] > DENSE * whole[e] or whole[e] >= cut * max(1, tags[e]))}
        return [i for i in usable if outer[blocks[i][2]] in kept]
    main = max(mains, key=lambda e: (weight[e], e), default=0)
    if not main or weight[main] < 0.5 * weight[0]:
        main = max((e for e, kind in enumerate(kinds) if kind in CONTAINERS and weight[e] >= HELD * weight[0]), default=0)
    # blocks of the container by the outermost group in it; 0: in none, -1: outside
    group = [-1] * len(kinds)
    for e in range(len(kinds)):
        if e == main:
            group[e] = 0
        elif e and group[parents[e]] >= 0:
            group[e] = group[parents[e]] or (e if kinds[e] in GROUPS else 0)
    links = Counter()
    for i in usable:
        links[group[blocks[i][2]]] += blocks[i][4]
    return [i for i in usable if (g := group[blocks[i][2]]) >= 0 and (not g or weight[g] or links[g] <= LINKED * whole[g])]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """A row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html, and pages without text, give an empty text; of a page without a marked-up article the container of
    its dense text is taken. Null ids and urls stay null; repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def f(batch: pa.RecordBatch) -> dict:
        found = [main_text(x) for x in texts(batch.column("html"))]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(by_batch(f, schema, 256), "page_id long, url string, text string, n_chars long")
