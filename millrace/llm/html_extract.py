"""Main text of web pages: what a page's tags mark, and what a host repeats on its pages.

1. Each page is cut into blocks of text in page order. A block is part of the article (inside ``article`` or
   ``main``), marked as something else (menus, headers, footers, sidebars, notices, adverts, forms, reader
   comments: by element, class, id or role), or unmarked. Scripts, styles and markup hold no text.
2. Host suffix array: the words outside articles form one stream per page. The suffixes of a host's streams
   are ordered to a depth of ``run`` words, which is all that "a common prefix of at least ``run`` words"
   needs; suffixes equal to that depth in two distinct streams of the host, and in at least ``share`` of them, are
   repeated there, and the words they begin with are covered. Copies of a page (equal streams) count once, so they
   don't cover each other, and passages that a few pages of a large host share stay. The order is kept by hash, so a host of any size is dealt over all tasks,
   and equal suffixes are combined before the shuffle.
3. The text is the article's blocks. A page without an article has its unmarked blocks instead, without the
   covered words: its unique runs.

The words of an article are never covered one by one: pages may well share an article, or a passage of it. Only a short
block (up to NOTICE characters) goes, and only whole: if all its words lie in repeated runs of the host's suffix order over
the short blocks of its distinct articles. There a suffix is repeated if it is in at least half of those articles, and in
LEAST of them; the first of the block must begin as many of them. It stays if the article would have no text left.

Defined results:

* null or empty html, or no text left: empty text, 0 characters; truncated html ends every open element;
* null URL: the page belongs to the host ''; repeated rows each keep their row, and don't make each other's
  text repeated (pages are told apart by their streams);
* character references are decoded once, white space (Unicode) in a block is one space, blocks are joined by one;
* an empty table gives an empty result; columns besides id, URL and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_IDS, materialise
from millrace.llm.url_filter import host_of
from millrace.llm.words import combine

#: Words of a run, and the share of a host's distinct streams (two at least) that a repeated run is in.
RUN, SHARE = 6, 0.1
ARTICLE, MARKED, UNMARKED = 0, 1, 2
#: A notice inside articles: its most characters, the share of a host's distinct articles that it is in, and the least number of them.
NOTICE, NOTICE_SHARE, LEAST = 400, 0.5, 5
#: Up to so many notices of pages are broadcast.
MOST_NOTICES = 100_000

#: Elements whose content is never text of the page.
RAW = "script style template noscript iframe object svg math textarea select button title".split()
#: Elements, and words in class, id or role, that mark what isn't the article.
MARKING = set("nav header footer aside form menu dialog head".split())
MARKING_WORDS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
BLOCK = set(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|<[a-zA-Z/!][^<]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _marks(tag: str, attributes: str) -> bool:
    if tag in MARKING:
        return True
    if "=" not in attributes:
        return False
    return any(w in MARKING_WORDS for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order: (zone, text), white space already one space, none empty."""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    marked, depth, articles = "", 0, 0  # the marking element, how deep it is nested in itself, open articles
    html = html or ""

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((MARKED if marked else ARTICLE if articles else UNMARKED, text))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if tag in BLOCK or tag == marked:
            flush()
        if marked:
            if marked == "p" and tag in BLOCK and tag != "br":
                marked = ""  # any block ends a paragraph
            elif tag == marked:
                depth += -1 if closing else 1
                marked = marked if depth else ""
            elif tag == "body" and marked == "head" or marked == "form" and tag in ("article", "main") and not closing:
                marked = ""  # an unclosed head, or a form around the whole page
            if marked or closing:
                if closing and tag in ("article", "main") and not marked:
                    articles = max(0, articles - 1)
                continue
        if closing:
            if tag in ("article", "main"):
                articles = max(0, articles - 1)
        elif tag not in VOID and not m[4].endswith("/") and _marks(tag, m[4]):
            flush()
            marked, depth = tag, 1
        elif tag in ("article", "main"):
            articles += 1
    parts.append(unescape(html[at:]))
    flush()
    return found


_BLOCKS = "array<struct<zone: int, start: int, text: string>>"


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """row_key, page_id, url, host, has_article, blocks (zone, place of the first word in the page's stream, text)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    cell = pa.list_(pa.struct([("zone", pa.int32()), ("start", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                has, lists = [], []
                for html in part.column("html").to_pylist():
                    start, out = 0, []
                    for zone, text in blocks_of(html):
                        out.append({"zone": zone, "start": start, "text": text})
                        start += 0 if zone == ARTICLE else text.count(" ") + 1
                    lists.append(out)
                    has.append(any(b["zone"] == ARTICLE for b in out))
                keys = pa.array(range(key, key + part.num_rows), pa.int64())
                key += part.num_rows
                yield pa.RecordBatch.from_arrays([keys, *(part.column(c) for c in ("page_id", "url", "host")), pa.array(has), pa.array(lists, cell)], ["row_key", "page_id", "url", "host", "has_article", "blocks"])

    return rows.mapInArrow(run, f"row_key long, page_id {kind}, url string, host string, has_article boolean, blocks {_BLOCKS}")


def stream_hash() -> Column:
    """The hash of the words outside articles; null if there are none."""
    outside = F.array_join(F.transform(F.filter("blocks", lambda b: b["zone"] != ARTICLE), lambda b: b["text"]), " ")
    return F.when(outside != "", F.xxhash64(outside))


def suffixes(rows: DataFrame, run: int) -> DataFrame:
    """Each suffix of each page's stream, cut to ``run`` words: host, suffix (its hash), page (its stream's hash), row_key, at, needed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, own, at = [], [], []
            for i, blocks in enumerate(batch.column("blocks").to_pylist()):
                words = [w for b in blocks if b["zone"] != ARTICLE for w in b["text"].split(" ")]
                if len(words) >= run:
                    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
                    n = len(h) - run + 1
                    hashes.append(combine([h[k : k + n] for k in range(run)]))
                    own.append(np.full(n, i))
                    at.append(np.arange(n, dtype=np.int32))
            if hashes:
                take = pa.array(np.concatenate(own))
                columns = [batch.column("host").take(take), pa.array(np.concatenate(hashes).view(np.int64)), batch.column("page").take(take), batch.column("row_key").take(take), pa.array(np.concatenate(at)), batch.column("needed").take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "suffix", "page", "row_key", "at", "needed"])

    streams = rows.select("host", stream_hash().alias("page"), "row_key", (~F.col("has_article")).alias("needed"), "blocks")
    return streams.mapInArrow(go, "host string, suffix long, page long, row_key long, at int, needed boolean")


def covered_words(rows: DataFrame, run: int, share: float = SHARE) -> DataFrame:
    """row_key, covered: the places of the words that lie in runs repeated on the host, for pages without an article."""
    all_suffixes = suffixes(rows, run)
    # Each stream counts once; both counts combine before their shuffles.
    once = all_suffixes.groupBy("host", "suffix", "page").agg(F.max("needed").alias("needed"))
    repeated = once.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("any")).where((F.col("n") > 1) & F.col("any"))
    # Only on hosts of many streams is the share more than two of them.
    streams = rows.select("host", stream_hash().alias("page")).where(F.col("page").isNotNull()).distinct()
    large = streams.groupBy("host").agg(F.count(F.lit(1)).alias("streams")).where(F.col("streams") * share > 2)
    repeated = repeated.join(large, "host", "left").where(F.col("n") >= F.coalesce(F.col("streams") * share, F.lit(2))).select("host", "suffix")
    hits = all_suffixes.where("needed").join(repeated, ["host", "suffix"]).select("row_key", F.explode(F.sequence(F.col("at"), F.col("at") + (run - 1))).alias("at"))
    return hits.groupBy("row_key").agg(F.collect_set("at").alias("covered"))


def block_suffixes(block: Column, run: int) -> Column:
    """The suffixes of a block, cut to ``run`` words: their hashes in order. One of fewer words ends where the block does, and only equals such."""
    words = F.split(block, " ")
    return F.transform(words, lambda _, i: F.xxhash64(F.array_join(F.slice(words, i + 1, F.lit(run)), " "), i + run > F.size(words)))


def notices(rows: DataFrame, run: int = RUN) -> DataFrame:
    """row_key, notices: the texts of the short blocks in the page's article that its host repeats in its distinct articles.

    A block is one if it begins with a suffix (to a depth of ``run`` words) with which short blocks begin in NOTICE_SHARE of those articles, and
    all its words lie in suffixes that such blocks hold in as many. The others, nearly all, have their first suffix ordered and no more.
    """
    inside = F.transform(F.filter("blocks", lambda b: b["zone"] == ARTICLE), lambda b: b["text"])
    # Copies of an article count once; hosts of fewer articles than LEAST have no notices.
    articles = rows.where("has_article").select("row_key", "host", F.xxhash64(F.array_join(inside, " ")).alias("article"), F.array_distinct(inside).alias("texts"))
    many = articles.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") >= LEAST)
    short = articles.select("row_key", "host", "article", F.posexplode(F.filter("texts", lambda t: F.length(t) <= NOTICE)).alias("place", "block"))

    def repeated(suffixes: DataFrame) -> DataFrame:
        once = suffixes.select("host", "suffix", "article").distinct().groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
        found = materialise(once.join(many, "host").where(F.col("n") >= F.col("articles") * NOTICE_SHARE).select("host", "suffix"), "repeated")
        return F.broadcast(found) if found.count() <= MOST_NOTICES else found

    first = F.split("block", " ", run + 1)
    # The same hash as that of a block's first suffix, without the others.
    begun = short.withColumn("suffix", F.xxhash64(F.array_join(F.slice(first, F.lit(1), F.lit(run)), " "), F.size(first) < run))
    likely = materialise(begun.join(repeated(begun), ["host", "suffix"]).select("row_key", "host", "article", "place", "block"), "likely")
    suffixes = likely.select("*", F.posexplode(block_suffixes(F.col("block"), run)).alias("at", "suffix"))
    hits = suffixes.join(repeated(suffixes), ["host", "suffix"]).groupBy("row_key", "place").agg(F.first("block").alias("block"), F.collect_set("at").alias("starts"))
    n = F.size(F.split("block", " "))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda at: F.sequence(at, F.least(at + run, n) - 1))))
    return hits.where(F.size(covered) == n).groupBy("row_key").agg(F.collect_set("block").alias("notices"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = materialise(parsed(pages, id_col, url_col, html_col), "blocks")
    none = F.array().cast("array<int>")

    def unique(block: Column) -> Column:
        kept = F.filter(F.split(block["text"], " "), lambda w, i: ~F.array_contains(F.coalesce("covered", none), i + block["start"]))
        return F.array_join(kept, " ")

    def told(rows: DataFrame, texts: Column) -> DataFrame:
        return rows.select("page_id", "url", F.array_join(texts, " ").alias("text"))

    # Pages with an article lose its notices; only the others meet the runs that their hosts repeat.
    gone = materialise(notices(rows, run), "gone")
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("notices"))).first()
    # Lists of a checked size are broadcast, so that texts stay where they are; more are shuffled with them.
    few = size[0] <= BROADCAST_IDS and (size[1] or 0) <= MOST_NOTICES
    own = rows.where("has_article").join(F.broadcast(gone) if few else gone, "row_key", "left")
    inside = F.transform(F.filter("blocks", lambda b: b["zone"] == ARTICLE), lambda b: b["text"])
    left = F.filter(inside, lambda t: ~F.array_contains("notices", t))
    article = told(own, F.when(F.col("notices").isNotNull() & (F.size(left) > 0), left).otherwise(inside))
    rest = rows.where("NOT has_article").join(covered_words(rows, run), "row_key", "left")
    others = told(rest, F.filter(F.transform(F.filter("blocks", lambda b: b["zone"] == UNMARKED), unique), lambda t: t != ""))
    return article.unionAll(others).withColumn("n_chars", F.length("text").cast("long"))
