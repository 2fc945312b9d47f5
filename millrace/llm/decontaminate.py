"""Benchmark decontamination by spaced-seed hashing.

A mask names the places of a window of words that count; the others are ignored, so a hash over the counted
places survives a substituted word at an ignored one. Hashes of all benchmark positions under all masks are
joined with those of the training texts; around each hit the words are compared place by place, and a
passage counts as leaked if a window of 16 words (or a whole item of 8 to 15 words) agrees in at least 80 %.

The three masks miss no such window: whichever three of 16 (two of 10, one of 8) words are replaced, one
mask finds five untouched places somewhere in it (tested exhaustively).

Training hashes are first tested against a bitmap of the benchmark's, of fixed size (2 MB), so almost only
hits leave the scan, each with the words around it; texts never travel. The benchmark's hashes are broadcast
up to a checked number, and joined by shuffle beyond it.

Defined results:

* words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so case, white space and
  punctuation don't hide a passage;
* one row per leaked (document, item): the best window, the earliest of equals;
* items of fewer than 8 words are evidence of nothing and never match; null or empty texts neither;
* repeated rows of a document are one in the result; repeated items each match under their id;
* an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy
from millrace.llm.words import ALPHANUMERIC, combine, slices, words

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
WINDOW, LEAST, SIMILARITY = 16, 8, 0.8
#: Words kept around a hit: every window that holds it lies within.
BEFORE, AROUND = WINDOW - 1, 2 * WINDOW
BITMAP_BITS = 24
#: So many benchmark hashes, of some 200 bytes each, are broadcast; more are joined by shuffle.
BROADCAST_HASHES = 200_000


def seeds(hashes: np.ndarray, row: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the places where it lies within a text, and its hashes there."""
    ends = np.cumsum(counts)[row] if len(row) else row
    for number, mask in enumerate(MASKS):
        span = mask[-1] + 1
        if len(hashes) < span:
            continue
        n = len(hashes) - span + 1
        total = np.full(n, number + 1, np.uint64)
        for i, place in enumerate(mask):
            total += hashes[place : place + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * (7919 * i + 1))
        at = np.flatnonzero(np.arange(n) + span <= ends[:n])
        yield at, combine([total[at]])


def context(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """The words around each place as 32-bit hashes; ``outside`` beyond the text [first, last)."""
    places = at[:, None] + np.arange(-BEFORE, AROUND - BEFORE)
    inside = (places >= first[:, None]) & (places < last[:, None])
    low = (hashes >> np.uint64(33)).astype(np.int32)
    return np.where(inside, low[np.clip(places, 0, max(len(low) - 1, 0))], np.int32(outside))


def seed_rows(texts: DataFrame, outside: int, bitmap: np.ndarray | None = None, least: int = 1) -> DataFrame:
    """id, text to hash, id, at (the place of the word), n (words of the text), around; only where the bitmap has the hash, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, row, _ = words(part.column("text"), ALPHANUMERIC)
                counts = np.bincount(row, minlength=part.num_rows)
                firsts = np.cumsum(counts) - counts
                for at, seed in seeds(hashes, row, counts):
                    keep = counts[row[at]] >= least
                    if shared is not None:
                        bit = seed >> np.uint64(64 - BITMAP_BITS)
                        keep &= (shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at, seed = at[keep], seed[keep]
                    if len(at):
                        own = row[at]
                        around = context(hashes, firsts[own], firsts[own] + counts[own], at, outside)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, around.size + 1, AROUND), pa.int32()), pa.array(around.ravel()))
                        columns = [pa.array(seed.view(np.int64)), part.column("id").take(pa.array(own)), pa.array((at - firsts[own]).astype(np.int32)), pa.array(counts[own].astype(np.int32)), lists]
                        yield pa.RecordBatch.from_arrays(columns, ["hash", "id", "at", "n", "around"])

    return texts.mapInArrow(tidy(run), f"hash long, id {kind}, at int, n int, around array<int>")


def bitmap_of(rows: DataFrame) -> np.ndarray:
    """The bitmap of the hashes' leading bits: 2^18 words at most, whatever the benchmark's size."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    cells = rows.select(F.shiftrightunsigned(bit, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for i, b in cells.groupBy("i").agg(F.bit_or("b").alias("b")).collect():
        out[i] = np.int64(b).view(np.uint64)
    return out


def best_windows(doc: np.ndarray, item: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's words, words that agree, first place) of the best window around each hit; 0 agree if none is good enough."""
    size = np.minimum(n, WINDOW)
    equal = doc == item
    start = BEFORE - at  # where the item begins in the context; may lie before it
    most, where = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        sums = np.concatenate([np.zeros((len(own), 1), np.int32), np.cumsum(equal[own], axis=1, dtype=np.int32)], axis=1)
        agree = sums[:, length:] - sums[:, :-length]
        begins = np.arange(agree.shape[1])
        fits = (begins >= start[own][:, None]) & (begins + length <= (start[own] + n[own])[:, None])
        agree = np.where(fits & (agree >= math.ceil(SIMILARITY * length - 1e-9)), agree, 0)
        where[own] = agree.argmax(axis=1)
        most[own] = agree.max(axis=1)
    return size.astype(np.int32), most, where


def verified(hits: DataFrame) -> DataFrame:
    """The hits whose surroundings hold a window that agrees: doc_id, item_id, n_words, n_equal, doc_word, item_word."""
    doc_kind, item_kind = dict(hits.dtypes)["doc_id"], dict(hits.dtypes)["item_id"]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), AROUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc_at, item_at, n = (batch.column(c).to_numpy() for c in ("doc_at", "item_at", "n"))
                size, most, where = best_windows(matrix(batch.column("doc")), matrix(batch.column("item")), item_at, n)
                good = np.flatnonzero(most > 0)
                take = lambda name: batch.column(name).take(pa.array(good))
                shift = (where - BEFORE)[good]
                numbers = [pa.array(x.astype(np.int32)) for x in (size[good], most[good], doc_at[good] + shift, item_at[good] + shift)]
                yield pa.RecordBatch.from_arrays([take("doc_id"), take("item_id"), *numbers], ["doc_id", "item_id", "n_words", "n_equal", "doc_word", "item_word"])

    return hits.mapInArrow(tidy(run), f"doc_id {doc_kind}, item_id {item_kind}, n_words int, n_equal int, doc_word int, item_word int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked passage: doc_id, item_id, n_words, n_equal, doc_word and item_word (the window's first words)."""
    items = seed_rows(benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")), outside=-1, least=LEAST)
    items = materialise(items, "seeds")
    seeded = seed_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), outside=-2, bitmap=bitmap_of(items))
    doc_side = seeded.select("hash", F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), F.col("around").alias("doc"))
    item_side = items.select("hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n", F.col("around").alias("item"))
    hits = doc_side.join(F.broadcast(item_side) if items.count() <= BROADCAST_HASHES else item_side, "hash")
    best = F.max(F.struct("n_equal", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"), "n_words")).alias("best")
    found = verified(hits).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.n_words", "best.n_equal", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))
