"""Operator 1: main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is a path of styles (tag and classes) from the root. For
each node the pages of the host give

* presentation importance: entropy of the styles of its children over the pages (a part that looks the same everywhere
  is a template), in units of log(number of pages), 1 for a single page;
* content importance of a text node: 1 - mean over its distinct texts of log(pages with the text) / log(pages);
* composite importance: a node with children mixes its presentation importance and its children's composite. A branch whose
  nodes all have low composite importance, and low content importance where they hold text, is noise.

Counts are Spark aggregates over (host, path, text or style, page); pages with the same bytes count once. One row per
host with its unimportant paths then meets the pages of the host, and these branches are removed from each page, inside labelled
parts too. Inside an ``article`` (``main``) pages with the same article (labelled) text but for its digits count once, so
copies of an article on one host stay and what different articles repeat goes.

What a page labels itself is evidence: scripts, styles, forms, menus, headers, footers, asides, hidden parts, and elements whose
class, id or role names a menu, advert, notice, comment and so on are never text. An ``article`` is text whatever its class says, unless
that names a reader's comment. On a page with text in an ``article`` or
``main``, text outside them is kept too, but its branch is noise below the higher bound ``LOW_OUTSIDE``. On hosts with too few
pages for statistics all blocks that are not so named stay.

Defined cases: null, empty or letterless html gives the empty text; broken markup is read leniently (unclosed elements end with
their parent, unknown end tags are ignored, a cut-off tag is dropped); a null url is a host of its own name ''; repeated
rows get equal results; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import map_batches, stored, table

#: A host needs so many different pages before its statistics remove anything; importance below LOW is noise (below LOW_OUTSIDE
#: beside a labelled part).
LEAST_PAGES, LOW, LOW_OUTSIDE, GAMMA = 4, 0.3, 0.5, 0.9
#: Unimportant paths (8 bytes each) that are broadcast at most, hosts counted as ten.
BROADCAST_PATHS = 2_000_000

_token = re.compile(
    r"<(?:!--(?:.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_attr = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_names, _digits = re.compile(r"[a-z]+"), re.compile(r"\d+")
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
                  "blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary center "
                  "menu dialog".split())
NEVER = frozenset("head nav footer aside form script style textarea title noscript iframe template select option button svg "
                  "canvas object audio video menu dialog label input fieldset datalist math".split())
#: What class, id and role call parts that are no text of an article.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
                  "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
                  "subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer copyright "
                  "comment comments reply replies respond disqus discussion share sharing social related recommended "
                  "recommendations teaser teasers widget widgets search toolbar pagination pager skip contentinfo complementary "
                  "dialog form".split())
#: Only outside an article: inside, these hold its title.
HEADERS = frozenset("header masthead topbar banner".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Element:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag, path, noise, main):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attr.finditer(raw)} if raw and not raw.isspace() else {}


def _words(attrs: dict[str, str]) -> set[str]:
    """The words of class, id and role. Names that are phrases (side-by-side, notice-of-award) say what a part is about, not its use."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split()
    words = (set(_names.findall(name)) for name in names)
    return set().union(*(w for w in words if not w & LINKING))


def _noisy(tag: str, attrs: dict[str, str], inside: int) -> bool:
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    names = _words(attrs)
    if tag == "article":  # the text itself, whatever its class, unless it is a reader's
        return bool(names & COMMENTS)
    return bool(names & NOISE) or not inside and bool(names & HEADERS)


#: Words that make a name a phrase, and what class, id and role call the articles of readers.
LINKING = frozenset("and as at by for from in of on or the to versus vs with".split())
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())


class Page:
    """Blocks (path of element, text, noise, main) of a page in order, and its elements in pre-order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Element, str]] = []
        root = Element("", "", False, 0)
        self.elements, self.stack, self.run = [root], [root], []
        at, size = 0, len(source)
        while at < size:
            m = _token.search(source, at)
            if m is None:
                self.add(source[at:])
                break
            if m.start() > at:
                self.add(source[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self.close(tag)
                continue
            if m["tag2"] and not source[m.start():m.end()].endswith(">"):
                break  # the page ends inside this tag
            self.open(tag, m["attrs"] or m["attrs2"] or "")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = end.start() if end else size
        self.flush()

    def block(self) -> Element:
        return next((e for e in reversed(self.stack) if e.tag in BLOCK), self.stack[0])

    def add(self, text: str) -> None:
        if not self.stack[-1].noise or self.block().noise:  # an inline part that is no text leaves its block whole
            self.run.append(text)

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            self.run = []
            if text:
                self.blocks.append((self.block(), text))

    def pop_to(self, index: int) -> None:
        if any(e.tag in BLOCK for e in self.stack[index:]):
            self.flush()
        del self.stack[index:]

    def open(self, tag: str, raw: str) -> None:
        stack = self.stack
        if tag in ("br", "td", "th"):
            self.run.append(" ")
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # a new block ends an open paragraph
                if stack[i].tag == "p":
                    self.pop_to(i)
                    break
                if stack[i].tag in BLOCK and stack[i].tag != "p":
                    break
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in LIMITS[tag]:
                    break
                if stack[i].tag in CLOSED_BY[tag]:
                    self.pop_to(i)
                    break
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        above = self.stack[-1]
        attrs = _attributes(raw)
        noise = _noisy(tag, attrs, above.main)
        main = max(above.main, 2 if tag == "article" else 1 if tag == "main" or attrs.get("role") == "main" else 0)
        style = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split()))
        element = Element(tag, f"{above.path}>{style}", above.noise or noise, main)
        above.children.append(style)
        self.elements.append(element)
        self.stack.append(element)

    def close(self, tag: str) -> None:
        inline = tag not in BLOCK
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                return
            if inline and self.stack[i].tag in BLOCK and tag not in NEVER:
                return


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def statistics(source: str) -> list[tuple[int, int, int, int, int]]:
    """(page, path, parent path, kind, value): kind 0 a text of the node, kind 1 the styles of its children. Hashed.

    The page is named by its bytes, for nodes in a labelled part by the text of that part.
    """
    page = Page(source)
    prints = (digest(source), *(digest(_digits.sub("", "\n".join(t for e, t in page.blocks if e.main >= k and not e.noise))) for k in (1, 2)))
    out = {(prints[e.main], digest(e.path), digest(e.path.rpartition(">")[0]), 0, digest(t)) for e, t in page.blocks}
    out |= {(prints[e.main], digest(e.path), digest(e.path.rpartition(">")[0]), 1, digest(" ".join(dict.fromkeys(e.children))))
            for e in page.elements if e.children}
    return sorted(out)


def main_text(source: str | None, unimportant: frozenset[int] = frozenset(), outside: frozenset[int] = frozenset()) -> str:
    """Text without the noise of the page and the paths ``unimportant``, beside a labelled part those of ``outside``."""
    if not source:
        return ""
    kept = [(e, t) for e, t in Page(source).blocks if not e.noise]
    if unimportant or outside:
        labelled = any(e.main for e, _ in kept)
        kept = [(e, t) for e, t in kept if digest(e.path) not in (outside if labelled and not e.main else unimportant)]
    return "\n".join(t for _, t in kept)


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, low, outside: the hashed paths of low importance of each host with enough different pages, by both bounds."""
    def run(batch):
        rows: list[list] = [[], [], [], [], [], []]
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for node in statistics(source):
                for column, value in zip(rows, (host, *node)):
                    column.append(value)
        names = ["host", "page", "path", "parent", "kind", "value"]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(r, pa.int64()) for r in rows[1:])], names=names)

    wanted = pages.filter(F.length(html_col) > 0).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = stored(map_batches(wanted, run, "host string, page long, path long, parent long, kind long, value long").distinct(), "style-nodes")
    counted = rows.groupBy("host", "path", "parent", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    uses = counted.groupBy("host", "path", "parent", "kind").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.avg(F.log("c")).alias("logc"))
    sizes = rows.filter(F.col("path") == digest("")).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    held = rows.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    nodes = uses.join(held, ["host", "path"]).join(sizes, "host").select("host", "path", "parent", "kind", "n", "clogc", "logc", "m")
    return nodes.groupBy("host").applyInArrow(_unimportant, "host string, low array<bigint>, outside array<bigint>")


def _unimportant(group: pa.Table) -> pa.Table:
    """Composite importance bottom-up over one host's merged tree (one row per path and kind)."""
    content, style, children, pages = {}, {}, {}, {}
    for r in group.select(["path", "parent", "kind", "n", "clogc", "logc", "m"]).to_pylist():
        logm = math.log(r["m"]) if r["m"] > 1 else 0
        pages[r["path"]] = r["m"]
        children.setdefault(r["parent"], set()).add(r["path"])
        if r["kind"] == 0:
            content[r["path"]] = 1 - min(1, r["logc"] / logm) if logm else 1.0
        else:  # -sum p log p over the styles, p = c / n
            style[r["path"]] = min(1, (math.log(r["n"]) - r["clogc"] / r["n"]) / logm) if logm else 1.0
    done: dict[int, float] = {}
    noisy: dict[float, dict[int, bool]] = {LOW: {}, LOW_OUTSIDE: {}}  # low itself, and all below
    for root in list(pages):
        stack = [root]
        while stack:
            node = stack[-1]
            if node in done:
                stack.pop()
                continue
            below = [c for c in children.get(node, ()) if c != node]
            todo = [c for c in below if c not in done and c not in stack]
            if todo:
                stack.extend(todo)
                continue
            stack.pop()
            parts = [(pages[c], done[c]) for c in below if c in done]
            if node in content:
                parts.append((pages[node], content[node]))
            inner = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else style.get(node, 1.0)
            share = GAMMA ** max(1, len(below))
            done[node] = (1 - share) * style[node] + share * inner if node in style and below else inner
            for bound, found in noisy.items():
                found[node] = (max(done[node], content.get(node, 0)) < bound and pages[node] >= LEAST_PAGES
                               and all(found.get(c, True) for c in below))
    low, outside = ([sorted(p for p, v in found.items() if v)] for found in noisy.values())
    return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "low": pa.array(low, pa.list_(pa.int64())),
                     "outside": pa.array(outside, pa.list_(pa.int64()))})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = stored(style_trees(pages, url_col, html_col).filter(F.size("outside") > 0).withColumnRenamed("host", "_llm_host"), "style-trees")
    if (trees.agg(F.sum(F.size("low") + F.size("outside") + 10)).first()[0] or 0) <= BROADCAST_PATHS:  # else the pages meet them by a shuffle on the host
        trees = F.broadcast(trees)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.join(trees, host_of(F.col("url")) == F.col("_llm_host"), "left").select("page_id", "url", "html", "low", "outside")

    def run(batch):
        texts = [main_text(h, frozenset(low or ()), frozenset(outside or ()))
                 for h, low, outside in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
