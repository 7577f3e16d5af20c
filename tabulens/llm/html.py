"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of elements from the root to the leaf. Over all nodes of one path,
text and punctuation are added up: articles have long nodes with many signs per node, menus short ones without. The two
ratios of a path are fused, weighed down by the share of its text that lies in links, and smoothed over the nodes in page
order, so that a heading takes part in the text that it stands before. Paths whose nodes reach the threshold are content.
An article or main element is believed as far as it holds the page's text: the more of all ratios beside the text outside
lies in it, the more its paths count, and the less those outside; beside a longer text it counts for little. Classes and
ids that speak of menus, headers, footers, sidebars, notices, adverts or readers' comments weigh a path down, unless almost
all ratios of the page lie in that element, or an article does: then it is a name of the page. Only what HTML itself says
is no text of the page is left out before; a form or the like around an article, or around most of the ratios, is a
wrapper, and its controls alone are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table

#: Nodes to either side over which ratios are smoothed, and the share of their spread that content must reach.
REACH, SPREAD = 2, 0.5
#: How many times its ratios an article or main element counts against the text outside.
BELIEF = 2
#: What is left of a path's ratios under an element with an unwanted class or id: one that is the whole name, one that is a
#: part of it, and one that may as well name a part of an article and stands in one.
WHOLE, PART, OF_ARTICLE = 0.02, 0.05, 0.5
#: The share of the largest ratio that a path with such a name must reach besides, and of all ratios that lifts the name.
NAMED_LEAST, LIFTS = 0.1, 0.9

# Fixed values of HTML: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_ITSELF = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = frozenset("html body article section main div ul ol dl table td th blockquote nav aside header footer form figure details fieldset".split())
CONTENT = frozenset(("article", "main"))
LASTING = frozenset(("tag",))
NEVER = frozenset(
    "head nav footer aside form button select option datalist input dialog menu object svg math canvas audio video map fieldset script style".split()
)
WRAPS = frozenset("form fieldset dialog object".split())
LABELS = frozenset(("label", "legend"))
LANDMARKS = frozenset("navigation banner contentinfo complementary search menu menubar".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar widget footer header masthead comment "
    "comments discussion disqus replies share sharing social related recommended newsletter subscribe subscription login signup pagination"
).split()
ARTICLE_PARTS = frozenset("header related notice notices".split())
UNWANTED = re.compile(rf"(?:^|\s)(?!(?:has|no|with|without|is)[-_])(\w+[-_])?({'|'.join(NAMES)})([-_][\w-]+)?(?=\s|$)", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[^\w\s]")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


class Element(NamedTuple):
    tag: str
    parent: int
    path: str
    #: Why its text is not content: "tag", "wrap" (a tag or role that may stand around a whole page) or nothing.
    out: str
    #: What its class and id leave of ratios.
    weight: float = 1.0


class Node(NamedTuple):
    text: str
    element: int
    #: Whether a block ended before it.
    opens: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def name_weight(names: str, in_article: bool) -> float:
    """The least that any unwanted name in class and id leaves."""
    weights = [
        OF_ARTICLE if in_article and m[2].lower() in ARTICLE_PARTS else PART if m[1] or m[3] else WHOLE for m in UNWANTED.finditer(names)
    ]
    return min(weights, default=1.0)


def parse(page: str) -> tuple[list[Element], list[Node]]:
    """The elements of a page and its text nodes in order. Whatever is not closed is closed by what follows."""
    elements, nodes = [Element("", 0, "", "")], []
    stack, at, opens = [0], 0, True
    n = len(page)

    def close(to: int) -> None:
        del stack[to:]

    while at < n:
        found = TAG.search(page, at)
        until = found.start() if found else n
        if until > at:
            nodes.append(Node(html.unescape(page[at:until]), stack[-1], opens))
            opens = False
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            opens = True
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if elements[stack[i]].tag == name:
                    close(i)
                    break
                if name in INLINE and elements[stack[i]].tag in SCOPES:
                    break
            continue
        if name == "p" or name not in INLINE and name not in VOID:
            ends = CLOSED_BY_ITSELF.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                tag = elements[stack[i]].tag
                if tag == "p" or tag in ends:
                    close(i)
                elif tag in SCOPES and not (ends and tag not in ("ul", "ol", "dl", "table")):
                    break
        if name == "body":
            close(1 + (len(stack) > 1 and elements[stack[1]].tag == "html"))
        parent, out, label, weight = elements[stack[-1]], "", name, 1.0
        if found[3] and len(found[3]) > 4:
            said = _attributes(found[3])
            names = f"{said.get('class', '')} {said.get('id', '')}"
            label = f"{name}.{said['class'].split()[0]}" if said.get("class", "").strip() else name
            if name not in ("html", "body", "article", "main"):
                weight = name_weight(names, any(elements[i].tag in CONTENT for i in stack))
            role = said.get("role", "").lower()
            if role in LANDMARKS or "hidden" in said:
                out = "tag"
            elif role in ROLES or said.get("aria-hidden") == "true":
                out = out or "wrap"
        if name in WRAPS:
            out = out or "wrap"
        elif name in NEVER or name in RAW or (name == "header" and not any(elements[i].tag in CONTENT for i in stack)):
            out = "tag"
        elif name in LABELS and any(elements[i].tag in ("form", "fieldset") for i in stack):
            out = "tag"
        if name in CONTENT:
            # Something that holds the article is no part of the page beside it, whatever its name.
            for i in stack:
                elements[i] = elements[i]._replace(out=elements[i].out.replace("wrap", ""), weight=1.0)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in VOID and not found[0].endswith("/>"):
            elements.append(Element(name, stack[-1], f"{parent.path}/{label}", out, weight))
            stack.append(len(elements) - 1)
    return elements, nodes


class Ratios(NamedTuple):
    #: The nodes with text that are not left out.
    real: np.ndarray
    path: np.ndarray
    fused: np.ndarray
    #: The outermost article or main element that holds each node, 0 if none does.
    owner: np.ndarray
    #: What names leave of each path's ratios.
    weight: np.ndarray


def ratios(elements: list[Element], nodes: list[Node], reasons: frozenset[str]) -> Ratios:
    """The paths' ratios over the nodes that no element leaves out for one of ``reasons``."""
    out, owner, linked, weight = [False] * len(elements), [0] * len(elements), [False] * len(elements), [1.0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        out[i] = out[e.parent] or e.out in reasons
        owner[i] = owner[e.parent] or (i if e.tag in CONTENT else 0)
        linked[i] = linked[e.parent] or e.tag == "a"
        weight[i] = min(weight[e.parent], e.weight)
    kept = np.array([not out[x.element] for x in nodes], bool)
    size = np.array([len(SPACES.sub("", x.text)) for x in nodes], float)
    real = np.flatnonzero(kept & (size > 0))
    names: dict[tuple[str, int, float], int] = {}
    path = np.array([names.setdefault((elements[e].path, owner[e], weight[e]), len(names)) for e in (nodes[i].element for i in real)], np.int64)
    signs = np.array([len(PUNCTUATION.findall(nodes[i].text)) for i in real], float)
    links = np.array([size[i] * linked[nodes[i].element] for i in real])
    count = np.bincount(path)
    text = np.bincount(path, size[real])
    fused = text / count * (1 + np.bincount(path, signs) / count) * (1 - np.bincount(path, links) / text)
    return Ratios(real, path, fused, np.array([owner[nodes[i].element] for i in real], np.int64), np.array([w for _, _, w in names]))


def unwrapped(elements: list[Element], nodes: list[Node]) -> list[Element]:
    """The elements, without the marks and names of those that hold most of the page's ratios: they stand around the page.

    A form or role needs more than half of all ratios for that, a name ``LIFTS`` of them, as comments may outgrow a text.
    """
    if not any(e.out == "wrap" or e.weight < 1 for e in elements):
        return elements
    found = ratios(elements, nodes, LASTING)
    held = np.bincount([nodes[i].element for i in found.real], found.fused[found.path], len(elements)).tolist()
    total = sum(held)
    for i in range(len(elements) - 1, 0, -1):  # an element stands after its parent
        held[elements[i].parent] += held[i]
    return [
        e._replace(out="" if e.out == "wrap" and 2 * h > total else e.out, weight=1.0 if h >= LIFTS * total else e.weight)
        for e, h in zip(elements, held)
    ]


def content_mask(elements: list[Element], nodes: list[Node]) -> np.ndarray:
    """Which nodes are content. Nodes of equal ratios stand or fall together, as a path is content or it is not."""
    mask = np.zeros(len(nodes), bool)
    real, path, fused, owner, weight = ratios(unwrapped(elements, nodes), nodes, LASTING | {"wrap"})
    if not len(real):
        return mask
    ratio = (fused * weight)[path]
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / 2)
    padded = np.concatenate([np.zeros(REACH), ratio, np.zeros(REACH)])
    # A name counts again after smoothing, or its neighbours would make up for it.
    smooth = believed(np.convolve(padded, kernel / kernel.sum(), "valid"), ratio, owner) * weight[path]
    reached = np.bincount(path, smooth) / np.bincount(path)
    least = np.where(weight < 1, NAMED_LEAST * smooth.max(), min(SPREAD * smooth.std(), smooth.max()))
    mask[real[(reached >= least)[path]]] = True
    return mask


def believed(smooth: np.ndarray, ratio: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The smoothed ratios, weighed by what article and main elements hold of all ratios against the text outside of them.

    An element with odds under one is weighed down by their square; one with more lifts all its nodes, headings and short
    paragraphs too, towards the largest, and the text outside is weighed down by the square of the greatest odds.
    """
    mass = np.bincount(owner, ratio)
    if not owner.any():
        return smooth
    # Where nothing else has any text, an article is believed without text of its own ratio as well.
    odds = BELIEF * mass / mass[0] if mass[0] > 0 else np.full(len(mass), np.inf)
    odds[0] = 0
    most = odds.max()
    with np.errstate(divide="ignore"):
        lift = smooth.max() * np.maximum(0, 1 - 1 / odds)
    outside = min(1, 1 / most) ** 2 if most > 0 else 1.0
    weight = np.minimum(1, odds) ** 2
    weight[0], lift[0] = outside, 0
    return smooth * weight[owner] + lift[owner]


def main_text(page: str | None) -> str:
    """The content of a page: white space one space, blocks joined by one, nothing else changed."""
    if not page:
        return ""
    elements, nodes = parse(page)
    if not nodes:
        return ""
    out: list[str] = []
    broken = False
    for node, keep in zip(nodes, content_mask(elements, nodes)):
        broken |= node.opens or not keep
        if keep:
            out.append(f" {node.text}" if broken else node.text)
            broken = False
    return SPACES.sub(" ", "".join(out)).strip(" ")


def extract_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): the main text, empty for null and empty pages.

    Every page is read whole, on its own; repeated rows stay, no rows give no rows.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(main_text)

    return pages.withColumn(out, extract(F.col(quoted(page))))


def op5_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
