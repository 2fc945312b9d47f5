"""Near-duplicate detection: MinHash banding, odd sketches, exact confirmation, connected components.

1. Each text's set of word n-grams (64-bit hashes) gives MinHash samples, band keys and an odd sketch: a
   bitmap that holds, for every place, the parity of the samples hashed to it. The XOR of two sketches is
   the sketch of the samples in which they differ, so its population count estimates a high similarity
   closely: J = 1 + m / (4 k) * ln(1 - 2 z / m). Equal sets are collapsed to their smallest id.
2. Each text is paired with the smallest id that comes first in one of its band buckets, not with all.
3. Pairs whose sizes or sketches rule the similarity out are dropped (the sketch bound lies ``margin`` below
   the threshold, some five standard deviations); the others are confirmed on the full sets.
4. Buckets that still hold members of different components pair these across components, first one pair
   for two components, then, within the join and under the same bounds, all; those are confirmed too. So no candidate link between different
   components is left untested, while members that are already linked are never paired.

With 32 bands of 6 rows a pair of similarity 0.8 shares no bucket with probability 6e-5, one of 0.85 with
3e-7, and most pairs have more than one path to each other.

Defined results:

* A-Z are lower-cased, words are runs of non-space; fewer words than ``size``: the whole sequence is one
  n-gram; null text or none: an empty set, linked with nothing;
* equal sets are linked; of a component the smallest id stays; repeated rows of one id are one document and
  each keep their row;
* a null id gets the component of the documents with its set, null if there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, only, tidy
from millrace.llm.components import link_buckets
from millrace.llm.words import SPACES, combine, mix, shingles, slices, words

BANDS, ROWS, BITS = 32, 6, 512
SAMPLES = BANDS * ROWS
CHUNK = 2048
MARGIN = 0.15

_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_A, _B = (_SEEDS[:SAMPLES] | np.uint64(1))[:, None], _SEEDS[SAMPLES:][:, None]
_BAND = np.arange(BANDS, dtype=np.uint64)


def minhash(items: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that isn't empty."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), CHUNK):
        np.minimum(low, (items[None, start : start + CHUNK] * _A + _B).min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    return combine([_BAND, *(rows[:, i] for i in range(ROWS))]).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    places = (mix(samples ^ _SEEDS[:SAMPLES]) % np.uint64(BITS)).astype(np.int64)
    parity = (np.bincount(places, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketch_bound(similarity: float, bits: int = BITS, samples: int = SAMPLES) -> int:
    """The largest population count of the XOR whose estimate is at least ``similarity``."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def features(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), digest of the set, keys (bands), sketch; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, row, _ = words(part.column("text"), SPACES)
                n, digests, keys, sketches = [], [], [], []
                for items in shingles(hashes, row, part.num_rows, size):
                    n.append(len(items))
                    if len(items):
                        samples = minhash(items)
                        digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                        keys.append(band_keys(samples))
                        sketches.append(odd_sketch(samples))
                    else:
                        digests.append(None)
                        keys.append(None)
                        sketches.append(None)
                longs = pa.list_(pa.int64())
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "keys", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, digest binary, keys array<long>, sketch array<long>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """id, text to id, items: the whole set of each text; of rows with one id, the largest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, row, _ = words(part.column("text"), SPACES)
                items = [s.view(np.int64) for s in shingles(hashes, row, part.num_rows, size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    return texts.mapInArrow(tidy(run), "id long, items array<long>").groupBy("id").agg(F.max_by("items", F.size("items")).alias("items"))


def _near(a: str, b: str, similarity: float, bound: int) -> Column:
    """Sizes and sketches of the two sides leave the similarity possible."""
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    z = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(BITS // 64)), start=F.lit(0))
    return (100 * small >= round(100 * similarity) * large) & (z <= bound)


def _alike(a: str, b: str, similarity: float) -> Column:
    """The full sets reach the similarity."""
    x, y = F.col(f"{a}items"), F.col(f"{b}items")
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= round(100 * similarity) * (F.size(x) + F.size(y) - both)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    bound = sketch_bound(similarity - MARGIN)
    rows = materialise(features(docs, size, id_col, text_col), "minhash")
    named = rows.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    groups = named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialise(groups, "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = link_buckets(
        nodes.select("id", F.explode("keys").alias("key")),
        nodes.select("id", "n", "sketch"),
        lambda a, b: _near(a, b, similarity, bound),
        lambda ids: full_sets(only(texts, ids, "id"), size),
        lambda a, b: _alike(a, b, similarity),
    )
    owner = nodes.select("digest", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    joined = rows.select("doc_id", "n", "digest").join(owner, "digest", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
