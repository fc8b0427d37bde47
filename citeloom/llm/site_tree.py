"""Main text of web pages by site style trees: pages of a host are merged into one tree, low-importance branches are removed.

A node of the tree is a path of block elements with their classes. Its presentation importance is the entropy of its child
sequences over the host's pages, the content importance of its leaves is one minus the mean entropy of their texts: what
looks and reads alike on every page is noise. A branch goes only if it and all nodes below it are of low importance. Elements whose tag, role or class names them as menus, adverts and the like are
noise whatever their entropy; a name that content may have too needs the branch to repeat on the host or to be mostly links. Pages that are equal throughout count once, so copies of one page do not make it a template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.url_templates import url_host
from citeloom.llm.words import pieces
from citeloom.session import at_most, broadcast_if, materialise

# Element and class names of HTML pages.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside nav "
    "header footer form fieldset figure figcaption blockquote pre address details summary hr dialog menu center hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
NOISE_TAGS = frozenset("nav aside footer form button select svg object canvas audio video menu dialog head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adsense adbox alert banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header hidden legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Names of this list that content has too.
EVERYDAY = frozenset("alert banner comment cookies discussion disclaimer form header legal menu notice notices promotion recommended related replies reply "
                     "respond search share sharing social sponsor subscription".split())
#: Names of holders: with a name of noise and nothing else they name furniture ("comment-list", "ad-slot").
HOLDERS = frozenset("area articles bar block body box container holder inner item items links list module outer pane panel posts row section "
                    "slot stories strip thread unit wrap wrapper zone".split())
#: Names of noise that do not decide by themselves even where they stand alone or with a holder's name.
UNSURE = frozenset("alert discussion form header hidden legal menu".split())
#: First words of names that speak of the page's layout, not of the element.
LAYOUT = frozenset("has no with without".split())
#: Elements that such a name decides on; running text, headings, tables and inline elements are none.
CONTAINERS = frozenset("div section ul ol dl li details fieldset".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hgroup".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)),
             "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}

MAX_DEPTH = 32
#: Ends the path of an element whose own texts are of low importance while elements below it are not.
OWN_TEXTS = "/"
#: Hosts broadcast with their noise branches up to this many; beyond it pages and hosts meet in a shuffled join.
BROADCAST_HOSTS = 50_000
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    path: str
    depth: int
    noise: bool
    main: bool
    named: tuple[Node, ...] = ()  # the nodes from the root to this one whose name alone does not decide
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    text: str
    noise: bool
    main: bool
    links: int
    named: tuple[Node, ...] = ()


def furniture(value: str, main: bool) -> bool:
    """Whether a class or id of ``value`` consists of names of noise and of holders only; outside an article a header does."""
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words - HOLDERS and words <= HOLDERS | NOISE_WORDS and not (words & UNSURE) or not main and name.lower() == "header":
            return True
    return False


def marked(tag: str, attrs: str, main: bool = False) -> tuple[str, bool, bool]:
    """The element's name in the tree (tag, classes and id without digits), whether its attributes name it as noise, and
    whether they hold a name that needs evidence: an everyday word, or inside an article (``main``) a word within a longer
    class or id. A class or id of a container that names furniture and nothing else decides everywhere. The ids of plain elements
    and sections come from their headings; only a section's whole id may decide."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, False, False
    label, noise, maybe = tag, False, False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + " ".join(sorted(re.sub(r"\d+", "", value).split()))[:80].replace("/", "")
            names = [[w.lower() for w in _WORDS.findall(n)] for n in value.split()]
            found = {w for n in names if n and n[0] not in LAYOUT for w in n} & NOISE_WORDS
            if not found or name == "id" and tag in PLAIN:
                continue
            headed = name == "id" and tag == "section"
            noise |= tag in CONTAINERS and not headed and furniture(value, main)
            noise |= bool((found if not main and not headed else found & set(value.lower().split())) - EVERYDAY)
            maybe |= not headed
        elif name == "role":
            noise |= value.lower() in NOISE_ROLES
        elif name == "style":
            noise |= "display:none" in value.replace(" ", "").lower()
        else:
            noise |= name == "hidden" or value.lower() == "true"
    inner = tag not in ("html", "body", "article", "main")
    return label, noise and inner, maybe and inner and not noise


class Page:
    """Blocks of a page in order, and the child sequence of each element, from one walk over the markup. Unclosed and
    misnested elements are closed as browsers do for the common cases; a cut tag at the end is markup, not text."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.sequences: set[tuple[str, str]] = set()
        self.stack = [Node("", "", 0, False, False)]
        self.held: list[str] = []
        self.in_link, self.link_chars = 0, 0
        self.walk(html)

    def flush(self) -> None:
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(top.path, text, top.noise, top.main, self.link_chars, top.named))
            self.held, self.link_chars = [], 0

    def pop(self) -> None:
        node = self.stack.pop()
        self.sequences.add((node.path, ">".join(node.children)))

    def push(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        label, noise, maybe = marked(tag, attrs, top.main)
        if not top.children or top.children[-1] != label:
            top.children.append(label)
        depth = top.depth + 1
        noise = noise or tag in NOISE_TAGS or tag == "header" and not top.main
        node = Node(tag, f"{top.path}/{label}" if depth <= MAX_DEPTH else top.path, depth, top.noise or noise, top.main or tag in ("article", "main"), top.named)
        if maybe and depth <= MAX_DEPTH:
            node.named += (node,)
        self.stack.append(node)

    def close_for(self, tag: str) -> None:
        if self.stack[-1].tag == "p":
            self.pop()
        own = CLOSED_BY.get(tag)
        if own:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in own[1]:
                    break
                if self.stack[i].tag == own[0] or {self.stack[i].tag, tag} in ({"dt", "dd"}, {"td", "th"}):
                    while len(self.stack) > i:
                        self.pop()
                    break

    def walk(self, html: str) -> None:
        at, n = 0, len(html)
        open_tags: dict[str, int] = {}
        while at < n:
            m = _MARKUP.search(html, at)
            if not m:
                self.held.append(html[at:])
                break
            if m.start() > at:
                text = html[at:m.start()]
                self.held.append(text)
                if self.in_link:
                    self.link_chars += len(text)
            at = m.end()
            closing, tag, attrs, end = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if not end:  # a stray quote or the end of the page inside a tag
                gt = html.find(">", at)
                if gt < 0:
                    break
                at = gt + 1
            if tag in RAW:
                if not closing:
                    end_tag = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
                    at = end_tag.end() if end_tag else n
                continue
            if tag == "br":
                self.held.append(" ")
            elif tag == "a":
                self.in_link = 0 if closing else 1
            elif tag in BLOCKS or tag in NOISE_TAGS:
                self.flush()
                if not closing:
                    if tag in BLOCKS:
                        self.close_for(tag)
                    if tag not in VOID and not attrs.rstrip().endswith("/"):
                        self.push(tag, attrs)
                else:
                    self.leave(tag)
            elif not closing and tag not in VOID and any(marked(tag, attrs, self.stack[-1].main)[1:]):
                self.flush()
                self.push(tag, attrs)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif closing and open_tags.get(tag):
                open_tags[tag] -= 1
                self.flush()
                self.leave(tag)
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def leave(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                break

    def digest(self) -> int:
        """Of all text without a name of noise: pages equal in it are copies."""
        return xxhash.xxh3_64_intdigest("\n".join(b.text for b in self.blocks if not b.noise and not b.named)) - 2**63


def protected(path: str) -> bool:
    """Elements that no entropy removes, neither their own nor that of a wrapper: the page, the article, and the article's plain
    elements."""
    tags = [re.split(r"[.#]", p)[0] for p in path.split("/")[1:]]
    if not tags or tags[-1] in ("html", "body", "article", "main"):
        return True
    return ("article" in tags or "main" in tags) and tags[-1] in PLAIN


def main_text(page: Page, low: frozenset[str]) -> str:
    """The page's text: blocks of its article or main element (of the whole page, if there is none) without noise by name and
    without the host's low-importance branches; if these hold all the text, they stay. Branches with a name that needs
    evidence go if they are mostly links or of low importance. Without an article, blocks that are mostly links go too."""
    size: dict[int, list[int]] = {}
    for b in page.blocks:
        for node in b.named:
            chars = size.setdefault(id(node), [0, 0])
            chars[0] += len(b.text)
            chars[1] += b.links

    def told(node: Node) -> bool:
        chars, links = size[id(node)]
        return 2 * links > chars or node.path in low

    named = [b for b in page.blocks if not b.noise and not any(map(told, b.named))]

    def falls(path: str) -> bool:
        if protected(path):
            return False
        if path + OWN_TEXTS in low:
            return True
        while path:
            if path in low and not protected(path):
                return True
            path = path.rpartition("/")[0]
        return False

    fallen = {path: falls(path) for path in {b.path for b in named}} if low else {}
    kept = [b for b in named if not fallen[b.path]] if low else named
    kept = [b for b in kept if b.main] or [b for b in named if b.main] or [b for b in kept if 2 * b.links <= len(b.text)] or kept or named
    return "\n\n".join(b.text for b in kept)


# -- Spark --------------------------------------------------------------------------------------

ROWS = "host string, path string, text boolean, feature long, page long"


def tree_rows(pages: DataFrame) -> DataFrame:
    """Per page, once each: the texts at each leaf path and the child sequence of each element path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            rows: set[tuple] = set()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html)
                own = page.digest()
                rows.update((host, b.path, True, xxhash.xxh3_64_intdigest(b.text) - 2**63, own) for b in page.blocks if not b.noise)
                rows.update((host, p, False, xxhash.xxh3_64_intdigest(s) - 2**63, own) for p, s in page.sequences if p)
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
                                                 names=["host", "path", "text", "feature", "page"])

    return map_arrow(pages.select("host", "html"), run, ROWS)


def importance(rows: DataFrame, *, gamma: float = 0.9) -> DataFrame:
    """(host, path, pages, importance, own, most) of each element node with text below.

    Presentation: the entropy of its child sequences, to the base of its number of pages. Content: one minus the mean entropy
    of the texts of all leaves below. The composite leans to presentation as the node has more variants (1 - gamma ^ variants).
    ``own`` is the content importance of the element's own texts (null without any), ``most`` the highest importance of the node,
    its own texts and all nodes below: a wrapper of many rare variants scores low whatever it holds.
    """
    seen = rows.groupBy("host", "path", "text", "feature").agg(F.count_distinct("page").cast("double").alias("k"))
    seen = materialise(seen, "features")
    forms = seen.filter(~F.col("text")).groupBy("host", "path").agg(
        F.sum("k").alias("pages"), F.count("*").alias("variants"), F.sum(F.col("k") * F.log("k")).alias("_klogk"))
    forms = forms.withColumn("_base", F.log(F.greatest("pages", F.lit(2.0)))).withColumn(
        "presentation", F.greatest((F.log("pages") - F.col("_klogk") / F.col("pages")) / F.col("_base"), F.lit(0.0)))
    leaves = seen.filter("text").groupBy("host", "path").agg(F.sum(F.log("k")).alias("_logk"), F.count("*").alias("_texts"))
    leaves = leaves.join(forms.select("host", "path", "_base"), ["host", "path"]).withColumn("_noise", F.col("_logk") / F.col("_base"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    below = leaves.select("host", F.explode(above).alias("path"), "_noise", "_texts").groupBy("host", "path").agg(
        (1 - F.least(F.sum("_noise") / F.sum("_texts"), F.lit(1.0))).alias("content"))
    lean = F.pow(F.lit(gamma), F.col("variants"))
    score = F.when(F.col("presentation") > 0, (1 - lean) * F.col("presentation") + lean * F.col("content")).otherwise(F.col("content"))
    nodes = forms.join(below, ["host", "path"]).select("host", "path", "pages", score.alias("importance")).join(
        leaves.select("host", "path", (1 - F.least(F.col("_noise") / F.col("_texts"), F.lit(1.0))).alias("own")), ["host", "path"], "left")
    most = nodes.select("host", F.explode(above).alias("path"), F.greatest("importance", "own").alias("_most")).groupBy("host", "path").agg(F.max("_most").alias("most"))
    return nodes.join(most, ["host", "path"])


def extract_text(pages: DataFrame, *, min_pages: int = 4, below: float = 0.3) -> DataFrame:
    """One row per page row: page_id, url, text and n_chars (code points).

    A branch is removed from the pages of a host if it stands on ``min_pages`` different pages or more and its importance and
    that of every node below it are under ``below``; if only its own texts are, these go alone. Character references are decoded, white space inside a block becomes one space, blocks are joined by two
    line breaks in page order. Null and empty html give an empty text; a null url has the host of urls without ``://``;
    repeated rows stay repeated and count once in the tree; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    nodes = importance(tree_rows(rows)).filter((F.col("pages") >= min_pages) & (F.col("importance") < below))
    nodes = nodes.withColumn("path", F.when(F.col("most") < below, F.col("path")).when(F.col("own") < below, F.concat("path", F.lit(OWN_TEXTS))))
    low = materialise(nodes.filter("path IS NOT NULL").groupBy("host").agg(F.collect_set("path").alias("low")), "low_branches")
    joined = rows.join(broadcast_if(low, at_most(low, BROADCAST_HOSTS)), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, ...], frozenset[str]] = {}
        for batch in pieces(batches, "html"):
            texts = []
            for html, paths in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
                key = tuple(paths or ())
                if key not in cache:
                    cache[key] = frozenset(key)
                    if len(cache) > 1000:
                        cache = {key: cache[key]}
                texts.append(main_text(Page(html), cache[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = map_arrow(joined.select("page_id", "url", "html", "low"), run, rows.select("page_id", "url").schema.add("text", "string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
