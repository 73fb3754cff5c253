"""HTML extraction with removal of site templates.

Each page's element subtrees are hashed in two ways: the whole subtree, and for containers (elements that aren't of
running text) its slot, in which texts are masked, so that a menu with changing words recurs. Spark counts for each
host on how many pages a hash stands (a page, and of its copies one, counts once) and how much of their text it holds.
A hash on many pages that holds little of their text is a template: such subtrees are deleted. A slot on many pages
that holds much of it is content, and is gone through. So on a host of several pages the counts decide what of a
page's body is its main text.

Only on a page whose body doesn't recur (its host has too few pages to count) do names, classes and roles decide (see
`named`): there the text is that of the article, main element or else body, without what is named as something else. Class
names and ids count as whole words; `share-prices` is no share button. On a counted host they decide nothing, with one
exception: inside an article, whose parts are no template for being of one shape, counts can't tell a section from readers'
comments or an advert. There subtrees go that recur as a whole, unless they are running text, for sentences recur too;
elements of another kind by their tag (forms, asides and so on); and what both is labelled as readers' words or an advert
(`OTHERS`) and recurs in shape on the host's pages.

Counting is a partial aggregate by host and hash, so a hot host is spread. Verdicts, 9 bytes a hash, are broadcast
while there are at most BROADCAST, which is counted; beyond, each page gets those it holds by a join on its hashes,
in which pages are shuffled once.

Defined results: null html has the empty text; a null or strange url has the empty host (it's then a host of its own);
repeated pages give the same text each; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm.common import durable, slices
from csift.llm.htmltree import FLOW, Element, below, blocks, hashed, parse
from csift.llm.radix import salted_join

#: A template is on this many of a host's distinct pages, and on this part of them, and holds at most this part of their text.
MIN_PAGES = 5
MIN_SHARE = 0.1
MOST_TEXT = 0.3
BROADCAST = 1 << 21

#: Never text.
SILENT = frozenset("script style noscript template head title iframe object embed svg canvas audio video".split())
DROPPED = frozenset("nav aside form select button textarea input dialog menu footer".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget related recommended share sharing social newsletter subscribe signup login form "
    "comment comments reply replies disqus footer header masthead topbar toolbar pagination skip copyright".split()
)
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments reply replies disqus".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
UNKNOWN, TEMPLATE, CONTENT = 0, 1, 2


def labels(x: Element) -> set[str]:
    return {*x.attributes.get("class", "").lower().split(), x.attributes.get("id", "").lower()}


def labelled(x: Element) -> bool:
    return not LABELS.isdisjoint(labels(x))


def tagged(x: Element) -> bool:
    """Whether its tag, role or state say that an element isn't of the main text."""
    return x.name in DROPPED or x.attributes.get("role") in ROLES or "hidden" in x.attributes


def named(x: Element) -> bool:
    return tagged(x) or labelled(x)


def articles(order: list[Element]) -> list[Element]:
    found = [x for x in order if x.name == "article" and not labelled(x)] or [x for x in order if x.name == "main" or x.attributes.get("role") == "main"]
    nested = {id(y) for x in found for y in below(x)}
    return [x for x in found if id(x) not in nested]


def main_text(page: str, verdicts=None, names: bool = True) -> str:
    """The page's main text. verdicts: of an array of hashes what the host's counts say of each, nothing if it isn't
    given; without names the counts alone decide."""
    order = hashed(parse(page))
    whole = np.zeros(len(order), np.int8) if verdicts is None else verdicts(np.array([x.digest for x in order], np.int64))
    slots = np.zeros(len(order), np.int8) if verdicts is None else verdicts(np.array([x.slot for x in order], np.int64))
    said = {id(x): (w, s) for x, w, s in zip(order, whole.tolist(), slots.tolist())}
    body = next((x for x in order if x.name == "body"), order[0])
    found = articles(order)
    counted = said[id(body)][1] == CONTENT
    inner = found
    if not inner and counted:
        # no article is marked: the innermost containers that hold much of the text are one
        rich = [x for x in order if said[id(x)][1] == CONTENT and x not in (body, order[0]) and x.name != "html"]
        inner = [x for x in rich if not any(said[id(y)][1] == CONTENT for y in below(x))]
    inside = {id(y) for x in inner for y in below(x)}

    def skip(x: Element) -> bool:
        if x.name in SILENT:
            return True
        recurs, slot = said[id(x)]
        if id(x) in inside:
            if recurs == TEMPLATE and x.name not in FLOW or names and tagged(x):
                return True
            return names and (slot == TEMPLATE and not OTHERS.isdisjoint(labels(x)) if counted else labelled(x))
        if recurs == TEMPLATE or slot == TEMPLATE:
            return True
        return names and not counted and slot != CONTENT and (named(x) or x.name == "header")

    tops = [body] if counted or not names else found or [body]
    return "\n".join(text for x in tops for text in blocks(x, skip))


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_mark(host: str) -> np.int64:
    """Hashes of a host's pages are mixed with its own."""
    return np.int64(int.from_bytes(hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))


def page_hashes(pages: DataFrame) -> DataFrame:
    """_csift_host, _csift_page (digest of the html), chars and found: array of (hash, chars) of each distinct page of a host.

    Pages are hashed where they lie, so that hashes are shuffled to tell copies, not html. Running text of an article
    isn't hashed, for it stays whatever the counts are.
    """

    def hashes_of(text: str, mark: np.int64) -> tuple[list[dict], int]:
        order = hashed(parse(text))
        inside = {id(y) for x in articles(order) for y in below(x)}
        held: dict[int, int] = {}
        for x in order[1:]:
            if x.name not in FLOW:
                held[x.slot] = held.get(x.slot, 0) + x.chars
            if x.name not in FLOW or id(x) not in inside:
                held[x.digest] = held.get(x.digest, 0) + x.chars
        body = next((x for x in order if x.name == "body"), order[0])
        return [{"hash": int(np.int64(k) ^ mark), "chars": n} for k, n in sorted(held.items())], body.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1 << 20):
            made = [hashes_of(text or "", host_mark(host)) for host, text in zip(part.column("_csift_host").to_pylist(), part.column("html").to_pylist())]
            found = pa.array([x for x, _ in made], pa.list_(pa.struct([("hash", pa.int64()), ("chars", pa.int64())])))
            yield pa.record_batch([part.column("_csift_host"), part.column("_csift_page"), pa.array([n for _, n in made], pa.int64()), found], ["_csift_host", "_csift_page", "chars", "found"])

    rows = pages.select("_csift_host", "_csift_page", "html").mapInArrow(run, "_csift_host string, _csift_page binary, chars long, found array<struct<hash:long,chars:long>>")
    return rows.groupBy("_csift_host", "_csift_page").agg(F.first("chars").alias("chars"), F.first("found").alias("found"))


def verdicts_of(distinct: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_text: float = MOST_TEXT) -> DataFrame:
    """(hash, verdict) of hashes on at least min_pages of a host's distinct pages, but for those of which counts say nothing."""
    # hash null stands for the host itself, so that its number of pages comes with the counts
    each = distinct.select("_csift_host", F.col("chars").alias("of"), F.explode(F.concat("found", F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.col("chars"))))).alias("x"))
    counts = each.groupBy("_csift_host", F.col("x.hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.chars").alias("chars"), F.sum("of").alias("of"))
    counts = counts.filter(F.col("n") >= min_pages)
    pages = counts.filter("hash is null").select("_csift_host", F.col("n").alias("pages"))
    little = F.col("chars") <= most_text * F.col("of")
    verdict = F.when(~little, CONTENT).when(F.col("n") >= min_share * F.col("pages"), TEMPLATE)
    joined = salted_join(counts.filter("hash is not null"), pages, ["_csift_host"], "hash")
    return joined.withColumn("verdict", verdict.cast("byte")).filter("verdict is not null").select("hash", "verdict")


def looked_up(keys: np.ndarray, values: np.ndarray, mark: np.int64):
    """verdicts for `main_text`; keys are sorted."""

    def of(hashes: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(hashes), np.int8)
        wanted = hashes ^ mark
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (hashes != 0), values[at], np.int8(UNKNOWN))

    return of


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_text: float = MOST_TEXT, broadcast: int = BROADCAST, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_csift_host", host_column()).withColumn("_csift_page", F.unhex(F.sha2("html", 256)))
    distinct = durable(page_hashes(rows))
    found = durable(verdicts_of(distinct, min_pages, min_share, most_text))
    if found.count() <= broadcast:
        table = found.groupBy("hash").agg(F.max("verdict").alias("verdict")).toPandas().sort_values("hash")
        known = pages.sparkSession.sparkContext.broadcast((table["hash"].to_numpy(np.int64), table["verdict"].to_numpy(np.int8)))
        rows = rows.withColumn("_csift_held", F.lit(None).cast("array<struct<hash:long,verdict:byte>>"))
    else:
        known = None
        held = distinct.select("_csift_host", "_csift_page", F.explode("found.hash").alias("hash")).join(found, "hash")
        held = durable(held.groupBy("_csift_host", "_csift_page").agg(F.sort_array(F.collect_list(F.struct("hash", "verdict"))).alias("_csift_held")))
        rows = rows.join(held, ["_csift_host", "_csift_page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1 << 20):
            texts = []
            for host, text, held in zip(part.column("_csift_host").to_pylist(), part.column("html").to_pylist(), part.column("_csift_held").to_pylist()):
                if known is not None:
                    keys, values = known.value
                else:
                    keys, values = np.array([x["hash"] for x in held or ()], np.int64), np.array([x["verdict"] for x in held or ()], np.int8)
                texts.append(main_text(text, looked_up(keys, values, host_mark(host)), names))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "url", "html", "_csift_host", "_csift_held").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
