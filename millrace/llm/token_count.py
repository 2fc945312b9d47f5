"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. Each text is cut into pre-tokens as the tokenizer does it, and its pre-token frequencies are written once
   to the shared folder (one row per document).
2. The distinct pre-tokens, with the number of documents that hold each, are encoded once: a table of piece
   counts.
3. Per-document frequencies are joined with the piece counts and summed.

The join never deals a frequent pre-token to one task: the ``HEAD`` most frequent pre-tokens (a table of
bounded size, so broadcast) are joined on the map side and summed per document before any shuffle; only the
frequencies of the others travel to an equi-join.

Cutting: texts made of the plain characters of ``_PLAIN`` are cut by one compiled pattern, for which the
tokenizer's normaliser reduces to lower-casing (tested against it); any other text goes through the
tokenizer's own normaliser and pre-tokenizer. Added special tokens in a text count one token each, as the
library has it; they are counted beside the pre-tokens.

Defined results: null and empty texts have no bytes and no tokens; repeated rows each keep their row; an
empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: So many of the most frequent pre-tokens, of at most HEAD_BYTES bytes each, are broadcast: 16 MB of text at most.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Documents per Arrow record batch are cut to slices of so many, to bound a worker's memory.
SLICE = 256

# Texts of these characters alone: no white space but ASCII's, nothing below U+0250 that normalises to
# something else than its lower case, and no added token.
_PLAIN = r"[\t-\r -\x84\x86-\x9f\xa1-įı-ɏ]*"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Cutter:
    """Cuts texts into pre-tokens and counts their pieces, for a lower-casing BPE with word ends."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.plain = regex.compile(_PLAIN)
        self.pattern = regex.compile(_PATTERN)

    def cut(self, text: str) -> tuple[Counter[str], int]:
        """The text's pre-tokens with their frequencies, and the number of added tokens in it."""
        if self.plain.fullmatch(text) and not any(a in text for a in self.added):
            return Counter(self.pattern.findall(text.lower())), 0
        found: Counter[str] = Counter()
        parts = self.split.split(text) if self.split else [text]
        for part in parts[::2]:
            if part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                found.update(normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return found, len(parts) // 2

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Cutter(path)


_FREQUENCIES = "row_key long, doc_id long, n_bytes long, n_added long, words array<struct<w: string, f: int>>"


def frequencies(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: a key of its own, doc_id, n_bytes, its number of added tokens, and its pre-tokens with frequencies."""
    kind = pa.list_(pa.struct([("w", pa.string()), ("f", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, row = cutter(tokenizer).cut, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                offsets, words, counts, sizes, added = [0], [], [], [], []
                for text in part.column(1).to_pylist():
                    found, n_added = cut(text or "")
                    added.append(n_added)
                    words += found.keys()
                    counts += found.values()
                    offsets.append(len(words))
                    sizes.append(len((text or "").encode()))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int32())], ["w", "f"])
                keys = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(kind)
                yield pa.RecordBatch.from_arrays([keys, part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(added, pa.int64()), listed], ["row_key", "doc_id", "n_bytes", "n_added", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _FREQUENCIES)


def piece_counts(words: DataFrame, tokenizer: str) -> DataFrame:
    """w, docs to w, docs, n: each distinct pre-token is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = cutter(tokenizer).pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["w", "docs", "n"])

    return words.mapInArrow(run, "w string, docs long, n int")


def head_floor(counts: DataFrame, head: int) -> int:
    """The least document frequency of at most ``head`` pre-tokens, from a histogram of at most 512 cells."""
    cell = F.floor(8 * F.log2(F.col("docs"))).cast("int")
    cells = counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("docs")).collect()
    total, floor = 0, 1 << 62
    for _, n, docs in sorted(cells, reverse=True):
        total += n
        if total > head:
            break
        floor = docs
    return floor


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. tokenizer: a tokenizers .json file."""
    per_doc = materialise(frequencies(docs, tokenizer, id_col, text_col), "frequencies")
    distinct = per_doc.select(F.explode("words").alias("x")).groupBy(F.col("x.w").alias("w")).agg(F.count(F.lit(1)).alias("docs"))
    counts = materialise(piece_counts(distinct, tokenizer), "pieces")

    small = F.octet_length("w") <= HEAD_BYTES
    floor = head_floor(counts.where(small), head)
    in_head = small & (F.col("docs") >= F.lit(floor))
    top = F.broadcast(counts.where(in_head).select("w", "n"))
    rows = per_doc.select("row_key", F.explode("words").alias("x")).select("row_key", "x.w", "x.f")
    # What the head has counted collapses to one row per document before the shuffle. Its null word would meet
    # in one task, so the row's key stands for it, told from words by a column of its own.
    done = F.col("n").isNotNull()
    rest = F.when(done, F.col("row_key").cast("string")).otherwise(F.col("w"))
    partial = rows.join(top, "w", "left").groupBy("row_key", done.alias("head"), rest.alias("rest")).agg(F.sum("f").alias("f"), F.sum(F.col("f") * F.col("n")).alias("done"))
    tail = counts.where(~in_head).select(F.lit(False).alias("head"), F.col("w").alias("rest"), F.col("n").alias("m"))
    summed = partial.join(tail.hint("shuffle_hash"), ["head", "rest"], "left").groupBy("row_key").agg(F.sum(F.coalesce(F.col("done"), F.col("f") * F.col("m"))).alias("n_tokens"))
    total = per_doc.select("row_key", "doc_id", "n_bytes", "n_added").join(summed, "row_key", "left")
    tokens = (F.coalesce(F.col("n_tokens"), F.lit(0)) + F.col("n_added")).cast("long")
    return total.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
