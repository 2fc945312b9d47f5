"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text's vector bundles (adds) its n-grams' vectors; a language's
prototype bundles the texts of the training fold, of which none outweighs the others by its length. A text gets the language whose prototype has the largest
cosine with it.

Texts are lower-cased letter by letter; every run of other characters is one boundary mark, with a vector of
its own. Letters below U+0250 have their own vectors, the others share ``OTHER`` vectors by code point.
Prototypes are sums of integers over all training rows, so they don't depend on the order of rows; they are
as many as there are languages, each ``dim`` long.

Defined results:

* null text, or one without a letter: ``und``, score 0;
* the score is the largest cosine, not below 0; ties go to the language first in alphabetical order;
* no training row: every text is ``und``;
* repeated rows count as often as they occur and each keep their row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, tidy

OWN, OTHER = 0x250, 1024
LETTERS = OWN + OTHER + 1
SLICE = 128
#: Characters whose n-grams are taken at once, and n-grams whose vectors are made at once: 16 MB of them.
PIECE, STEP = 1 << 20, 4096
#: No training text weighs more than so many n-grams; weights are kept in so many parts of one.
MOST, PARTS = 1000, 1024
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letter_ids() -> np.ndarray:
    """Of each code point the number of its lower-case letter; 0 if it isn't a letter."""
    ids = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            ids[cp] = 1 + (low if low < OWN else OWN + low % OTHER)
    return ids


@lru_cache(maxsize=4)
def _letter_vectors(dim: int, n: int, seed: int) -> list[np.ndarray]:
    """The letters' vectors, permuted for each of the n places."""
    own = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dim))
    return [np.roll(own, n - 1 - place, axis=1) for place in range(n)]


def ngram_counts(texts: list[str | None], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of the n-grams in each text; an n-gram is a number in base LETTERS.

    Runs of other characters, and the ends of texts, are one mark (0) each. The n-grams are the windows
    whose inner places all hold letters; a mark can only be the first or the last.
    """
    points = np.frombuffer((" " + " ".join(t or "" for t in texts) + " ").encode("utf-32-le", "replace"), "<u4")
    row = np.concatenate([[0], np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])])
    ids = _letter_ids()[points]
    keep = ids > 0
    keep[1:] |= ids[:-1] > 0  # the first mark of each run
    keep[:1] = True
    ids, row = ids[keep], row[keep]
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(ids) - n + 1, np.int64)
    inner = np.ones(len(code), bool)
    for place in range(n):
        part = ids[place : place + len(code)]
        code = code * LETTERS + part
        if 0 < place < n - 1:
            inner &= part > 0
    at = row[n // 2 : n // 2 + len(code)]
    pairs, count = np.unique(at[inner] * LETTERS**n + code[inner], return_counts=True)
    return pairs // LETTERS**n, pairs % LETTERS**n, count


def ngram_vectors(codes: np.ndarray, dim: int, n: int, seed: int) -> np.ndarray:
    vectors = _letter_vectors(dim, n, seed)
    out = np.ones((len(codes), dim), np.int8)
    for place in range(n):
        out *= vectors[place][codes // LETTERS ** (n - 1 - place) % LETTERS]
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of some PIECE characters: the number of each part's text, and the parts. Longer texts are cut at a space, which changes no n-gram, or where there is none within PIECE characters, there."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start, text = 0, text or ""
        while start < len(text):
            end = len(text)
            if end - start > PIECE:
                space = text.rfind(" ", start + 1, start + PIECE)
                end = space if space > start else start + PIECE
            owners.append(i)
            parts.append(text[start:end])
            size, start = size + end - start, end
            if size >= PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def all_counts(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``ngram_counts``, for texts of any length: what is held at once is a piece, and the distinct n-grams."""
    found = []
    for owners, parts in _pieces(texts):
        row, code, count = ngram_counts(parts, n)
        found.append((np.array(owners)[row] * LETTERS**n + code, count))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    count = np.bincount(at, np.concatenate([c for _, c in found]), len(pairs)).astype(np.int64)
    return pairs // LETTERS**n, pairs % LETTERS**n, count


def _steps(code: np.ndarray, dim: int, n: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For STEP distinct n-grams at a time: where ``code`` has them, which of them each is, and their vectors."""
    codes, at = np.unique(code, return_inverse=True)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(0, len(codes) + STEP, STEP))
    for k, start in enumerate(range(0, len(codes), STEP)):
        own = order[edges[k] : edges[k + 1]]
        yield own, at[own] - start, ngram_vectors(codes[start : start + STEP], dim, n, seed)


def text_vectors(texts: list[str | None], dim: int, n: int, seed: int) -> np.ndarray:
    """One bundled vector for each text; all 0 for a text without a letter."""
    row, code, count = all_counts(texts, n)
    total = np.zeros((len(texts), dim), np.float32)
    for own, at, vectors in _steps(code, dim, n, seed):
        weights = np.zeros((len(texts), len(vectors)), np.float32)
        weights[row[own], at] = count[own]
        total += weights @ vectors.astype(np.float32)
    return total


def prototypes(train: DataFrame, text_col: str, lang_col: str, dim: int, n: int, seed: int) -> dict[str, np.ndarray]:
    """The bundled vector of each language over all rows of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                langs = np.array(part.column(1).to_pylist(), object)
                row, code, count = all_counts(part.column(0).to_pylist(), n)
                # A text weighs as much as MOST n-grams at most, in whole parts.
                size = np.bincount(row, count, len(langs))[row] if len(row) else np.zeros(0)
                count = np.rint(PARTS * count * np.minimum(1, MOST / np.maximum(size, 1)))
                totals = {lang: np.zeros(dim) for lang in set(langs)}
                for own, at, vectors in _steps(code, dim, n, seed):
                    spoken = langs[row[own]]
                    for lang, total in totals.items():
                        mine = spoken == lang
                        total += np.bincount(at[mine], count[own][mine], len(vectors)) @ vectors.astype(np.float64)
                for lang, total in totals.items():
                    sums[lang] = sums.get(lang, 0) + np.rint(total).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(tidy(run), "lang string, v array<long>")
    cells = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, i, x in cells.toPandas().itertuples(index=False):
        found.setdefault(lang, np.zeros(dim))[i] = x
    return dict(sorted(found.items()))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 1024, n: int = 3, seed: int = 7, keep: bool = False
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, after all columns of ``docs`` (but any of these names) if ``keep`` is set.

    Learns from the rows that aren't held out and have a language.
    """
    train = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    known = prototypes(train, text_col, lang_col, dim, n, seed)
    names = [*known, UNDETERMINED]
    matrix = np.array([v / max(np.linalg.norm(v), 1e-9) for v in known.values()], np.float32).reshape(len(known), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                vectors = text_vectors(part.column("__text").to_pylist(), dim, n, seed)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = np.hstack([np.full((len(vectors), 1), -2.0), vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]])
                best = np.argmax(cosines, axis=1)
                none = (norms == 0) | (best == 0)
                score = np.where(none, 0.0, np.clip(cosines[np.arange(len(best)), best], 0, 1))
                pred = [names[-1] if u else names[b - 1] for u, b in zip(none, best, strict=True)]
                given = part.columns[: len(part.columns) - 1] if keep else part.columns[:2]
                columns = [*given, pa.array(pred, pa.string()), pa.array(score.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    if keep:
        docs = docs.drop("lang_pred", "score", "__text")
        rows = docs.withColumn("__text", F.col(text_col))
        given = docs.dtypes
    else:
        rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
        given = rows.dtypes[:2]
    fields = ", ".join(f"`{n}` {t}" for n, t in given)
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")
