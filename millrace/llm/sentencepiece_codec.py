"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

The model at hand merges pairs (BPE), so its scores are merge ranks, not log-probabilities: the segmentation
with the best sum of scores is not what the model says. The lattice's weights are therefore those of the
merge rule itself: an arc costs 0 if its piece may follow the piece before it (merging the two together
gives back just these two), minus infinity if not. The best path, the only one of finite weight, is the
library's segmentation.

* A text becomes a lattice of characters (a space mark in front, spaces as marks). A state at a place is the
  last piece before it and how far that reaches past the place.
* A document longer than ``chunk`` characters is cut into chunks. Each yields the max-plus transfer matrix
  from the states at its left edge to those at its right edge.
* Matrices are multiplied in groups of ``FAN`` neighbours, level by level, up to one per document; then the
  chosen states are handed down again. No task ever holds more than ``FAN`` matrices of a document.
* With its two edge states known, each chunk is traced back on its own.

No piece holds a mark behind another character, so between words every path meets in one state; words inside
a chunk are solved once and remembered by the worker. Shorter documents are one chunk with nothing at its edges.

Defined results: null and empty texts have no pieces and decode to empty text; a literal mark (U+2581) is
encoded as the space it looks like, as the library does; repeated rows each keep their row; an empty table
gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy

if TYPE_CHECKING:
    import pandas as pd

MARK = "▁"
CHUNK, FAN, SLICE = 32_768, 64, 256
#: Words and pairs of pieces that a worker remembers; then it starts anew.
REMEMBERED = 120_000
_WORDS = re.compile(r" *[^ ]+| +")

State = tuple[str, int]
Matrix = dict[tuple[State, State], float]
#: The state at the start of a text, and at its end: no piece reaches over.
EDGE: State = ("", 0)


class Codec:
    """A SentencePiece BPE model: its pieces, its merge rule, and what a worker has solved already."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(size)]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in range(size) if not special[i]}
        self.longest = max(map(len, self.score))
        self.solved: dict[str, array] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids = {self.model.id_to_piece(i): i for i in range(size)}
        self.plain = {p: self.ids[p] for p in self.score}

    # Words and whole chunks

    def word(self, text: str) -> array:
        """The ids of a word with the mark (or space) in front left out."""
        found = self.solved.get(text)
        if found is None:
            if len(self.solved) >= REMEMBERED:
                self.solved.clear()
            # The library gives an empty text no mark, but here a space stood in front of it.
            found = self.solved[text] = array("i", self.model.encode(text) if text else [self.ids[MARK]])
        return found

    def encode_marked(self, marked: str) -> array:
        """The ids of a text whose spaces are plain and which begins with the space in front of it."""
        out = array("i")
        if marked:
            words = marked[1:].split(" ")
            for w in words if all(words) else (x[1:] for x in _WORDS.findall(marked)):
                out.extend(self.word(w))
        return out

    # The lattice

    def merged(self, text: str) -> list[str]:
        """The merge rule: the pair of best score, leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """The weight of an arc: may ``right`` follow ``left``?"""
        if not left or (right[0] == MARK and left[-1] != MARK):
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def arcs(self, text: str, at: int, end: int) -> Iterator[str]:
        """The pieces that begin at a place; a character that no piece is stands for its bytes."""
        if at < end:
            yield text[at]
        for n in range(2, min(self.longest, end - at) + 1):
            if text[at : at + n] in self.score:
                yield text[at : at + n]

    def states(self, text: str, edge: int) -> list[State]:
        """The states at an edge: pieces that begin before it and end at or behind it.

        If a word begins a little before the edge, only what can follow from there; else all.
        """
        if edge == 0:
            return [EDGE]
        cut = self.cuts(text, 1, edge)
        if cut:
            reach = self.paths(text, {EDGE: 1}, cut[1], edge)
            return [(piece, at - edge) for at in range(edge, edge + self.longest) for piece in reach.get(at, ())]
        found = []
        for start in range(max(0, edge - self.longest), edge):
            found += [(p, start + len(p) - edge) for p in self.arcs(text, start, len(text)) if start + len(p) >= edge]
        return found

    def paths(self, text: str, froms: dict[State, int], start: int, end: int) -> dict[int, dict[str, int]]:
        """By place from ``start`` and last piece, the set (bits) of entry states with a path of weight 0 to it.

        Pieces begin before ``end``; those that reach over it are its exit states.
        """
        reach: dict[int, dict[str, int]] = defaultdict(dict)
        for (piece, over), bits in froms.items():
            reach[start + over][piece] = reach[start + over].get(piece, 0) | bits
        for at in range(start, end):
            for left, bits in list(reach.get(at, {}).items()):
                for right in self.arcs(text, at, len(text)):
                    if self.follows(left, right):
                        to = reach[at + len(right)]
                        to[right] = to.get(right, 0) | bits
        return reach

    def cuts(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and last place of a chunk where a word begins: a mark behind another character (or the text's start)."""
        places = [m.start() + 1 for m in re.finditer(f"[^{MARK}](?={MARK})", text[max(0, start - 1) : end])]
        places = [p + max(0, start - 1) for p in places if start <= p + max(0, start - 1) < end]
        if start == 0:
            places.insert(0, 0)
        return (places[0], places[-1]) if places else None

    def transfer(self, text: str, start: int, end: int) -> Matrix:
        """The matrix of the chunk [start, end) of ``text``, which holds what lies ``longest`` around it."""
        entries = self.states(text, start)
        cut = self.cuts(text, start, end)
        last = end == len(text)

        def exits(reach: dict[int, dict[str, int]]) -> Iterator[tuple[State, int]]:
            if last:
                bits = 0
                for b in reach.get(end, {}).values():
                    bits |= b
                yield EDGE, bits
            else:
                for at in range(end, end + self.longest):
                    yield from (((piece, at - end), bits) for piece, bits in reach.get(at, {}).items())

        bits = {s: 1 << i for i, s in enumerate(entries)}
        if cut is None:
            reached = list(exits(self.paths(text, bits, start, end)))
        else:
            # All paths meet where the first word begins, and set out again where the last one does.
            met = 0
            for b in (self.paths(text, bits, start, cut[0]) if start else {0: {"": 1}}).get(cut[0], {}).values():
                met |= b
            reached = [(s, met if b else 0) for s, b in exits(self.paths(text, {EDGE: 1}, cut[1], end))]
        return {(entry, leave): 0.0 for leave, b in reached for i, entry in enumerate(entries) if b >> i & 1}

    def trace(self, text: str, start: int, end: int, entry: State, leave: State) -> array:
        """The ids of the pieces that begin in the chunk, on the path between two states."""
        cut = self.cuts(text, start, end)
        goal = len(text) if leave == EDGE else end + leave[1]
        wanted = None if leave == EDGE else leave[0]
        if cut is None:
            return self.ids_of(self.back(text, entry, start, end, goal, wanted))
        out = self.ids_of(self.back(text, entry, start, cut[0], cut[0], None)) if start else array("i")
        out.extend(self.encode_marked(text[cut[0] : cut[1]].replace(MARK, " ")))
        out.extend(self.ids_of(self.back(text, EDGE, cut[1], end, goal, wanted)))
        return out

    def back(self, text: str, entry: State, start: int, end: int, goal: int, wanted: str | None) -> list[str]:
        reach = self.paths(text, {entry: 1}, start, end)
        first = start + entry[1]
        at, pieces = goal, []
        piece = wanted if wanted is not None else min(reach[at], default="")
        while at > first:
            pieces.append(piece)
            at -= len(piece)
            piece = next(left for left in sorted(reach[at]) if self.follows(left, piece) and (at > first or left == entry[0]))
        return pieces[::-1]

    def ids_of(self, pieces: list[str]) -> array:
        out = array("i")
        for p in pieces:
            found = self.plain.get(p)
            out.extend([found] if found is not None else [self.ids[f"<0x{b:02X}>"] for b in p.encode()])
        return out

    @property
    def spelled(self) -> pa.Array:
        """The bytes that each id stands for."""
        if not hasattr(self, "_spelled"):
            size = self.model.get_piece_size()
            spell = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else " ⁇ ".encode() if self.model.is_unknown(i) else self.model.id_to_piece(i).replace(MARK, " ").encode()
            self._spelled = pa.array([spell(i) for i in range(size)], pa.binary())
        return self._spelled

    def decode(self, lists: pa.Array) -> list[str]:
        """The texts that lists of ids stand for, without the space in front."""
        ids = pc.fill_null(lists, [])
        spans = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
        flat = self.spelled.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))])[spans]
        whole = flat.buffers()[2].to_pybytes() if flat.buffers()[2] is not None else b""
        return [whole[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices."""
    onward: dict[State, list[tuple[State, float]]] = defaultdict(list)
    for (middle, leave), w in b.items():
        onward[middle].append((leave, w))
    out: Matrix = {}
    for (entry, middle), w in a.items():
        for leave, v in onward.get(middle, ()):
            out[entry, leave] = max(out.get((entry, leave), -np.inf), w + v)
    return out


def choose(matrices: list[Matrix], entry: State, leave: State) -> list[State]:
    """The states between neighbours on the best path from ``entry`` to ``leave``."""
    forward = [{entry: 0.0}]
    for m in matrices:
        best: dict[State, float] = {}
        for (a, b), w in m.items():
            if a in forward[-1]:
                best[b] = max(best.get(b, -np.inf), forward[-1][a] + w)
        forward.append(best)
    states = [leave]
    for i in range(len(matrices) - 1, 0, -1):
        states.append(max((forward[i][a] + w, a) for (a, b), w in matrices[i].items() if b == states[-1] and a in forward[i])[1])
    return states[::-1][:-1]


_CELL = pa.struct([("entry", pa.string()), ("entry_over", pa.int32()), ("leave", pa.string()), ("leave_over", pa.int32()), ("w", pa.float64())])
_MATRIX = "array<struct<entry: string, entry_over: int, leave: string, leave_over: int, w: double>>"


def _pack(m: Matrix) -> list[dict]:
    return [{"entry": a[0], "entry_over": a[1], "leave": b[0], "leave_over": b[1], "w": w} for (a, b), w in m.items()]


def _unpack(cells: list[dict]) -> Matrix:
    return {((c["entry"], c["entry_over"]), (c["leave"], c["leave_over"])): c["w"] for c in cells}


def _row_keys(start: int, n: int) -> pa.Array:
    return pa.array(range(start, start + n), pa.int64())


def _encode_short(docs: DataFrame, model: str, round_trip: bool) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chunks", "ids", "round_trip"][: 4 if round_trip else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                flat, offsets, texts = array("i"), [0], []
                for text in part.column("text").to_pylist():
                    texts.append((text or "").replace(MARK, " "))
                    if text:
                        flat.extend(own.encode_marked(" " + texts[-1]))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                columns = [part.column("doc_id"), pa.array(np.ones(part.num_rows, np.int32)), ids]
                if round_trip:
                    columns.append(pa.array([a == b for a, b in zip(own.decode(ids), texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n_chunks int, ids array<int>" + ", round_trip boolean" * round_trip)


def _chunked(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """One row per chunk: its document's key, number, surroundings, and transfer matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                marked = MARK + text.replace(" ", MARK)
                for i, start in enumerate(range(0, len(marked), chunk)):
                    low, high = max(0, start - own.longest), min(len(marked), start + chunk + own.longest)
                    around, end = marked[low:high], min(start + chunk, len(marked)) - low
                    cells = _pack(own.transfer(around, start - low, end))
                    columns = [pa.array([key], pa.int64()), pa.array([i], pa.int64()), pa.array([around]), pa.array([start - low], pa.int32()), pa.array([end], pa.int32()), pa.array([cells], pa.list_(_CELL))]
                    yield pa.RecordBatch.from_arrays(columns, ["row_key", "i", "around", "start", "end", "m"])

    return giants.mapInArrow(tidy(run), f"row_key long, i long, around string, start int, end int, m {_MATRIX}")


def _combined(level: DataFrame) -> DataFrame:
    """FAN neighbours to one: row_key, i, m."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = rows.sort_values("i")
        total = _unpack(rows.m.iloc[0])
        for cells in rows.m.iloc[1:]:
            total = product(total, _unpack(cells))
        return pd.DataFrame({"row_key": [key[0]], "i": [key[1]], "m": [_pack(total)]})

    return level.groupBy("row_key", F.floor(F.col("i") / FAN).alias("g")).applyInPandas(run, f"row_key long, i long, m {_MATRIX}")


_STATES = "entry string, entry_over int, leave string, leave_over int"


def _handed_down(level: DataFrame, above: DataFrame) -> DataFrame:
    """The edge states of each row of ``level``, from those of the groups above."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = rows.sort_values("i")
        first = rows.iloc[0]
        entry, leave = (first.entry, int(first.entry_over)), (first.leave, int(first.leave_over))
        between = choose([_unpack(c) for c in rows.m], entry, leave)
        ends = [entry, *between, leave]
        out = pd.DataFrame({"row_key": key[0], "i": rows.i.to_numpy()})
        for name, at in (("entry", ends[:-1]), ("leave", ends[1:])):
            out[name], out[f"{name}_over"] = [s[0] for s in at], [s[1] for s in at]
        return out

    grouped = level.withColumn("g", F.floor(F.col("i") / FAN)).join(above.withColumnRenamed("i", "g"), ["row_key", "g"])
    return grouped.groupBy("row_key", "g").applyInPandas(run, f"row_key long, i long, {_STATES}")


def _traced(chunks: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                ids.append(own.trace(r["around"], r["start"], r["end"], (r["entry"], r["entry_over"]), (r["leave"], r["leave_over"])).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("i"), pa.array(ids, pa.list_(pa.int32()))], ["row_key", "i", "ids"])

    return chunks.mapInArrow(tidy(run), "row_key long, i long, ids array<int>")


def _encode_giants(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """row_key, n_chunks, ids of the rows of ``giants``, keyed when they were written."""
    chunks = materialise(_chunked(giants, model, chunk), "chunks")
    levels = [chunks.select("row_key", "i", "m")]
    most = chunks.agg(F.max("i")).first()[0]
    while most:
        levels.append(materialise(_combined(levels[-1]), "matrices"))
        most //= FAN
    edge = [F.lit(EDGE[0]).alias("entry"), F.lit(EDGE[1]).alias("entry_over"), F.lit(EDGE[0]).alias("leave"), F.lit(EDGE[1]).alias("leave_over")]
    states = levels[-1].select("row_key", "i", *edge)
    for level in reversed(levels[:-1]):
        states = materialise(_handed_down(level, states), "states")
    traced = _traced(chunks.drop("m").join(states, ["row_key", "i"]), model)
    whole = traced.groupBy("row_key").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    return whole.select("row_key", "n_chunks", F.flatten("parts.ids").alias("ids"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a key of their own; to be written before use, so that the keys stay."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_row_keys(key, batch.num_rows), *batch.columns], ["row_key", *batch.schema.names])
            key += batch.num_rows

    return rows.mapInArrow(tidy(run), f"row_key long, {fields}")


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, round_trip: bool = False) -> DataFrame:
    """One row per document: doc_id, n_chunks, ids; with ``round_trip`` also whether the ids decode to the text
    (marks as spaces). model: a SentencePiece BPE .model file."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    large = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    short = _encode_short(rows.where(~large), model, round_trip)
    giants = materialise(_numbered(rows.where(large)), "giants")
    if giants.isEmpty():
        return short
    ids = giants.join(_encode_giants(giants, model, chunk), "row_key").select("doc_id", "n_chunks", "ids", F.xxhash64(F.translate("text", MARK, " ")).alias("hash"))
    if round_trip:
        return short.unionByName(decode_documents(ids, model).select("doc_id", "n_chunks", "ids", (F.xxhash64("decoded") == F.col("hash")).alias("round_trip")))
    return short.unionByName(ids.drop("hash"))


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for, without the space in front."""
    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(model).decode
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = decode(part.column(ids_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(tidy(run), f"{fields}, `{out_col}` string")
