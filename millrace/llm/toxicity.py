"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is logistic in its words (hashed: each word and its prefixes of four and five
letters, so that inflected and compound forms share weight). A document's is the noisy-or of its
sentences': it is toxic unless every sentence is not. Only documents carry labels; the gradient of the
noisy-or shares a document's label out over its sentences. Afterwards the sentences that carry a score are
located by their place in the text.

Training takes at most ``max_per_class`` labelled documents of either label, those of smallest id hash, from
the training fold; scoring reads every document and whole text.

Defined results:

* null text, or one without a word: score 0, nothing located (the noisy-or of no sentence);
* a document without a label, or with a null label, is only scored; several labels of one document: the
  largest holds; labels of unknown documents are ignored;
* no labelled row: every score is 0; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out

BITS = 18
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Words whose weight a worker remembers; then it starts anew.
REMEMBERED = 500_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    parts = {word, word[:5] + "*", word[:4] + "*"}
    return [zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in sorted(parts)]


@dataclass
class Bags:
    """Documents as flat arrays: the features' sentence, the sentences' document."""

    feature: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    known: dict[str, list[int]] = {}
    feature, sentence, doc = [], [], []
    for d, text in enumerate(texts):
        for part in SENTENCE.findall((text or "").lower()):
            words = WORD.findall(part)
            if words:
                for w in words:
                    if (own := known.get(w)) is None:
                        own = known[w] = features(w)
                    feature += own
                    sentence += [len(doc)] * len(own)
                doc.append(d)
    return Bags(np.array(feature, np.int32), np.array(sentence, np.int32), np.array(doc, np.int64))


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 120, rate: float = 0.2, decay: float = 1e-3, signal: float = 4.5) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and the bias, by gradient descent (Adam) on the noisy-or likelihood."""
    b = bags(texts)
    n, y = len(texts), toxic.astype(bool)
    # Only features whose document counts differ between the labels, beyond chance, take part.
    pairs = np.unique(b.feature.astype(np.int64) * n + b.doc[b.sentence]) if len(b.feature) else np.zeros(0, np.int64)
    counts = np.bincount(pairs // max(n, 1), minlength=1 << BITS)
    marked = np.bincount(pairs // max(n, 1), y[pairs % max(n, 1)], minlength=1 << BITS)
    rate_of = y.mean() if n else 0.0
    used = np.abs(marked - counts * rate_of) >= signal * np.sqrt(counts * rate_of * (1 - rate_of) + 1e-9)
    used &= counts >= 3
    keep = used[b.feature]
    feature, sentence = b.feature[keep], b.sentence[keep]
    w, bias = np.zeros(1 << BITS), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y, 0.35 / max(y.sum(), 1), 0.65 / max((~y).sum(), 1))
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[feature], len(b.doc))
        none = np.bincount(b.doc, np.logaddexp(0, z), n)  # -log of the probability that no sentence is toxic
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        share = np.where(y, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0) * weight
        g = p * share[b.doc]
        grad = np.append(np.bincount(feature, g[sentence], len(w)) + decay * w * used, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias = min(bias - float(move[-1]), -3.0)
    return w, bias


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentences(self, text: str | None, known: dict[str, float]) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a word. known: words' weights, filled as it goes."""
        found = []
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter that grows when lower-cased would shift the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        for s in SENTENCE.finditer(low):
            words = WORD.findall(s[0])
            if words:
                z = self.bias
                for word in words:
                    if (own := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        own = known[word] = float(sum(self.weights[f] for f in features(word)))
                    z += own
                found.append((s.start(), s.end(), z))
        if not found:
            return []
        z = np.clip(np.array([x[2] for x in found]), -40, 40)
        return [(a, e, p) for (a, e, _), p in zip(found, (1 / (1 + np.exp(-z))).tolist(), strict=True)]


def noisy_or(probabilities: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-15)).sum())) if probabilities else 0.0


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 3000) -> ToxicityModel:
    """Learn from the labelled rows that aren't held out, at most ``max_per_class`` of either label."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    texts = docs.where(F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for label in (0, 1):
        # The ids are chosen before any text moves.
        ids = marked.where((F.col("label") == label) & ~held_out(F.col("doc_id"))).orderBy(*order).limit(max_per_class)
        chosen = ids if chosen is None else chosen.unionByName(ids)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).toPandas().sort_values("doc_id")
    if rows.label.nunique() < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -40.0)
    weights, bias = fit(rows.text.tolist(), rows.label.to_numpy() == 1)
    return ToxicityModel(weights.astype(np.float32), bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, offending (start, end, score of each sentence of 0.5 or more)."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                found = own.sentences(text.as_py(), known)
                scores.append(noisy_or([p for _, _, p in found]))
                spans.append([{"start": a, "end": e, "score": p} for a, e, p in found if p >= 0.5])
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted, pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start: int, end: int, score: double>>")
