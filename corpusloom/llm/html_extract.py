"""Main-text extraction by wrapper induction.

Pages of a site that are made alike (the same set of tags) share a pivot: one of them, the same whatever the partitions.  Each page's
DOM tree is aligned with its pivot's by simple tree matching, so that text nodes of all pages meet in the pivot's slots.  Slots whose
texts repeat from body to body are template, and so is a text that holds a slot on most bodies; varying slots are content.
A page's text is what its varying slots hold in the main region, without the parts that no repetition gives away
because they vary as well: menus, headers, footers, sidebars, adverts, forms, scripts and reader comments, known by their
elements or by names that say nothing else.

Bodies, not pages, are counted, so that copies of an article aren't taken for template: the body of a page is the least hash of its
runs of words, one of ``KEYS`` such hashes, which near copies mostly share.  All counts are sums over (pivot, slot, text, body), partially
aggregated; no site's pages are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.groups import in_slices
from corpusloom.llm.dom import BLOCK, Matching, Node, deep_recursion, digest, parse, text_of
from corpusloom.llm.shingles import MinHash, shingle_sets
from corpusloom.sources.storage import Scratch

MIN_BODIES = 3  # different bodies that a template's text must repeat on
MIN_REPEAT = 3.0  # bodies for each text of a slot from which the slot is template
MIN_SHARE = 0.5  # of a slot's bodies, from which one text of it is template
KEYS, KEY_WORDS = 8, 3
BROADCAST_BYTES = 32 << 20

# Elements that aren't part of an article, roles that say so, and words of names; names made only of words of the
# last two lists, with one of the first of them, say so too.
DROPPED = frozenset(
    "nav header footer aside form button select input textarea script style noscript template iframe svg object embed canvas audio video dialog menu head title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment comments disqus replies "
    "footer header masthead newsletter subscribe signup login search pagination pager skip copyright legal widget widgets".split()
)
PLACES = frozenset(
    "site page main global top bottom left right upper lower inner outer side up sign bar box block list lists item items posts post buttons button links link area section "
    "container wrapper wrap content form panel unit slot reader user row col column group the and".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_TAGS = r"<([a-zA-Z][a-zA-Z0-9]*)"


@lru_cache(100_000)
def _named_junk(name: str) -> bool:
    words = [w for w in re.split(r"[-_]|(?<=[a-z])(?=[A-Z])|[0-9]+", name) if w]
    words = [w.lower() for w in words]
    return any(w in PARTS for w in words) and all(w in PARTS or w in PLACES for w in words)


def is_junk(node: Node) -> bool:
    """Whether an element is by its kind or name no part of an article."""
    if node.tag in DROPPED:
        return True
    a = node.attributes
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return any(map(_named_junk, f"{a.get('class', '')} {a.get('id', '')}".split()))


class Template:
    """A pivot's tree with its text nodes numbered, and what is known of them: template slots, and template texts of other slots."""

    def __init__(self, pivot: str, marks: list[tuple[int, int | None]] = (), matching: Matching | None = None):
        self.root, self.matching = parse(pivot), matching or Matching()
        self.slots: dict[int, int] = {}
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.tag == "#":
                self.slots[id(node)] = len(self.slots)
            todo += reversed(node.children)
        self.marks = set(marks)

    def filled(self, root: Node) -> list[tuple[Node, int]]:
        """A page's text nodes that align with a slot, and the slot."""
        with deep_recursion():
            return [(node, self.slots[id(slot)]) for node, slot in self.matching.texts(root, self.root)]

    def template_nodes(self, root: Node) -> set[int]:
        """The ids of a page's text nodes that are template."""
        if not self.marks:
            return set()
        return {id(node) for node, slot in self.filled(root) if (slot, None) in self.marks or (slot, digest(text_of(node))) in self.marks}


def main_regions(root: Node, template: Callable[[], set[int]]) -> list[Node]:
    """The outermost article elements, else main elements, that aren't in junk; else the deepest element with most of the varying text."""
    for wanted in (lambda n: n.tag == "article" or n.attributes.get("itemprop") == "articleBody", lambda n: n.tag == "main" or n.attributes.get("role") == "main"):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node is not root and node.tag != "#" and is_junk(node):
                continue
            if wanted(node):
                found.append(node)
            else:
                todo += reversed(node.children)
        if found:
            return found
    weights = _weights(root, template())
    node = root
    while True:
        inner = next((c for c in node.children if c.tag in BLOCK and c.tag not in HEADINGS and c.tag != "p" and weights.get(id(c), 0) > 0.8 * weights[id(node)]), None)
        if inner is None:
            return [node]
        node = inner


def _weights(root: Node, template: set[int]) -> dict[int, int]:
    """Characters of text under each element outside junk, links and template."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.tag != "a" and (node is root or node.tag == "#" or not is_junk(node)):
            todo += node.children
    weights: dict[int, int] = {}
    for node in reversed(order):
        if node.tag == "#":
            weights[id(node)] = 0 if id(node) in template else len(node.text.strip())
        else:
            weights[id(node)] = sum(weights.get(id(c), 0) for c in node.children) if node.tag != "a" and (node is root or not is_junk(node)) else 0
    return weights


def blocks_of(region: Node, template: set[int], article: bool) -> list[str]:
    """The texts of a region's blocks, in page order, without template; of an article's header, only headings."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        got = " ".join("".join(text).split())
        if got:
            out.append(got)
        text.clear()

    todo: list[tuple[str, Node]] = [("", child) for child in reversed(region.children)]
    while todo:
        step, node = todo.pop()
        if step == "flush":
            flush()
        elif node.tag == "#":
            if id(node) not in template:
                text.append(node.text)
        elif node.tag == "br":
            text.append(" ")
        elif node.tag == "header" and article and step != "title":
            flush()
            todo += [("title", c) for c in reversed(node.children) if c.tag in HEADINGS and not is_junk(c)]
        elif is_junk(node):
            if node.tag in BLOCK:
                flush()
        else:
            if node.tag in BLOCK:
                flush()
                todo.append(("flush", node))
            todo += [("", c) for c in reversed(node.children)]
    flush()
    return out


def main_text(page: str | None, template: Template | None = None) -> str:
    """The main text of a page, given the template of pages made like it."""
    if not page:
        return ""
    root = parse(page)
    constant = cache(lambda: template.template_nodes(root) if template else set())
    regions = main_regions(root, constant)
    article = any(r.tag in ("article", "main") or r.attributes.get("role") == "main" or "itemprop" in r.attributes for r in regions)
    got = [b for r in regions for b in blocks_of(r, constant(), article)]
    if not got and constant():  # where a page says nothing of its own, nothing can be told apart
        got = [b for r in regions for b in blocks_of(r, set(), article)]
    return "\n".join(got)


def pivots_of(rows: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(host, tags, pivot id) of all kinds of page that have a pivot, and (pivot, html).

    A kind is a site's pages with one set of tags; of each kind, the page with the least hash is a pivot.  Kinds of fewer than
    ``MIN_BODIES`` pages use the pivot of their site's commonest kind.
    """
    first = F.min(F.struct(F.xxhash64("html").alias("hash"), "html"))
    kinds = tables.write(rows.groupBy("host", "tags").agg(F.count(F.lit(1)).alias("n"), first.alias("first")), "kinds")
    best = F.max(F.struct("n", "tags"))
    hosts = kinds.groupBy("host").agg(F.sum("n").alias("all"), best.alias("best")).where(F.col("all") >= MIN_BODIES)
    own = F.when(F.col("n") >= MIN_BODIES, F.col("tags")).otherwise(F.col("best.tags"))
    chosen = kinds.select("host", "tags", "n").join(hosts, "host").select("host", "tags", F.xxhash64("host", own).alias("pivot"))
    chosen = tables.write(chosen, "chosen")
    pivots = kinds.select(F.xxhash64("host", "tags").alias("pivot"), F.col("first.html").alias("html")).join(chosen.select("pivot").distinct(), "pivot")
    return chosen, tables.write(pivots, "pivots")


class Pivots:
    """Templates for Python workers: sent to each executor once where they are small, else as columns of the rows."""

    def __init__(self, pivots: DataFrame, ddl: str):
        spark = pivots.sparkSession
        size = pivots.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        self.table, self.ddl = pivots, ddl
        self.sent = None
        if size <= BROADCAST_BYTES:
            self.sent = spark.sparkContext.broadcast({r["pivot"]: (r["html"], [(m["slot"], m["text"]) for m in r["marks"] or []]) for r in pivots.toLocalIterator()})

    def rows(self, pages: DataFrame) -> DataFrame:
        """``pages`` with a column ``given`` that is null where the template was sent."""
        if self.sent is not None:
            return pages.withColumn("given", F.lit(None).cast(self.ddl))
        given = self.table.select("pivot", F.struct("html", "marks").cast(self.ddl).alias("given"))
        return pages.join(given, "pivot", "left")

    def reader(self) -> Callable:
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
            known: dict[int, Template] = {}
            matching = Matching()

            def template(pivot: int | None, given: dict | None) -> Template | None:
                if pivot is None:
                    return None
                if pivot not in known:
                    if given is not None:
                        found = (given["html"], [(m["slot"], m["text"]) for m in given["marks"] or []])
                    else:
                        found = sent.value.get(pivot) if sent is not None else None
                    if len(known) > 500:
                        known.clear()
                    known[pivot] = Template(*found, matching) if found else None
                return known[pivot]

            for batch in in_slices(batches):
                columns = [batch.column(c).to_pylist() for c in ("html", "pivot", "given")]
                yield work(batch, [(page, template(pivot, given)) for page, pivot, given in zip(*columns)])

        return run


GIVEN = "struct<html:string,marks:array<struct<slot:int,text:bigint>>>"


def slot_marks(pages: DataFrame, pivots: DataFrame, tables: Scratch) -> DataFrame:
    """(pivot, marks): the template slots of each pivot, with text null, and the template texts of its other slots."""
    ship = Pivots(pivots.withColumn("marks", F.lit(None).cast("array<struct<slot:int,text:bigint>>")), GIVEN)
    reader = ship.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(KEYS, seed=3)

        def work(batch: pa.RecordBatch, pages: list) -> pa.RecordBatch:
            slots, texts, words = [], [], []
            for page, template in pages:
                filled = [(slot, text_of(node)) for node, slot in template.filled(parse(page))]
                slots.append([slot for slot, _ in filled])
                texts.append([digest(t) for _, t in filled])
                words.append(" ".join(t for _, t in filled))
            sets = [s if len(s) else np.zeros(1, np.uint64) for s in shingle_sets(words, KEY_WORDS)]
            keys = minhash.signatures(sets).astype(np.int64)
            columns = [batch.column("pivot"), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(slots, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["pivot", "keys", "slots", "texts"])

        yield from reader(batches, work)

    rows = ship.rows(pages.where("pivot is not null").select("pivot", "html")).mapInArrow(run, "pivot long, keys array<long>, slots array<int>, texts array<long>")
    rows = tables.write(rows, "slots")
    # The hash that tells the most bodies apart: another may have its least value in a text that all pages share.
    spread = rows.select("pivot", F.posexplode("keys").alias("k", "key")).distinct().groupBy("pivot", "k").agg(F.count(F.lit(1)).alias("n"))
    chosen = spread.groupBy("pivot").agg(F.max(F.struct("n", "k")).alias("top")).where(F.col("top.n") >= MIN_BODIES).select("pivot", F.col("top.k").alias("k"))
    chosen = tables.write(chosen, "chosen-keys")
    if chosen.count() * 24 <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    bodies = rows.join(chosen, "pivot").select("pivot", F.get("keys", "k").alias("body"), F.explode(F.arrays_zip("slots", "texts")).alias("s"))
    seen = bodies.select("pivot", F.col("s.slots").alias("slot"), F.col("s.texts").alias("text"), "body").distinct()
    by_text = tables.write(seen.groupBy("pivot", "slot", "text").agg(F.count(F.lit(1)).alias("bodies")), "by-text")
    by_slot = by_text.groupBy("pivot", "slot").agg(F.count(F.lit(1)).alias("texts"), F.sum("bodies").alias("all"))
    constant = (F.col("all") >= MIN_BODIES) & (F.col("all") >= MIN_REPEAT * F.col("texts"))
    common = by_text.where(F.col("bodies") >= MIN_BODIES).join(by_slot.where(~constant), ["pivot", "slot"]).where(F.col("bodies") >= MIN_SHARE * F.col("all"))
    marks = by_slot.where(constant).select("pivot", "slot", F.lit(None).cast("long").alias("text")).unionByName(common.select("pivot", "slot", "text"))
    return marks.groupBy("pivot").agg(F.collect_list(F.struct("slot", "text")).alias("marks"))  # two marks a slot of one page at most


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Blocks are joined by one line feed, white space in a block becomes one space.  A null or empty html gives an empty text.  A page whose
    URL is null or names no host, or whose site has fewer than ``MIN_BODIES`` different bodies, is extracted by elements and names
    alone.  Results don't depend on partitions or on the order of rows; repeated rows give repeated results, and count once as
    bodies.  Other columns are not read; an empty table gives no row.  Every executor holds the pivots, one page for each kind of page of a
    site, up to ``BROADCAST_BYTES``; beyond that they come with the rows.
    """
    tables = Scratch(pages.sparkSession, "op7")
    html = F.col(html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        F.nullif(F.lower(F.regexp_extract(F.col(url_col), _HOST, 1)), F.lit("")).alias("host"),
        F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(_TAGS), F.lit(1))))).alias("tags"),
    )
    named = rows.where("host is not null and html is not null and html != ''")
    chosen, pivots = pivots_of(named, tables)
    if chosen.count() * 60 <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    rows = rows.join(chosen, ["host", "tags"], "left")
    marks = tables.write(slot_marks(rows.where("html != ''"), pivots, tables), "marks")
    ship = Pivots(tables.write(pivots.join(marks, "pivot"), "marked"), GIVEN)
    reader = ship.reader()
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch, pages: list) -> pa.RecordBatch:
            texts = [main_text(page, template) for page, template in pages]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

        yield from reader(batches, work)

    tables.close(keep=("chosen", "marked"))
    return ship.rows(rows.select("page_id", "url", "html", "pivot")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
