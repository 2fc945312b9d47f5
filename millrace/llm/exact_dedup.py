"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and sorted by the text's SHA-256
digest. New rows are reduced to one candidate per digest (map-side combined), the candidates are
sort-merge anti-joined with the index on its bucketing, and what is left is appended. The index side isn't
shuffled. Spark sorts its buckets once more, in memory, since a bucket that was appended to is several sorted
files.

The query makes an index of its own on each run, which is empty at first: its anti-join drops nothing. The
tests ingest into a filled one.

Defined results:

* null text counts as empty; all empty or blank texts are one group;
* of equal texts, the one with the most code points in the original stays, then the smallest id; a null id
  comes after every other id;
* repeated rows (same id and text) are members of the group like any other;
* an empty table gives an empty result; columns besides id and text are ignored, whatever their names;
* texts that the index already held keep the representative it had.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ASCII_SPACE, shared_dir


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, ""), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A persistent index: table name, folder and bucket count."""

    name: str
    path: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, buckets: int | None = None, name: str | None = None) -> DigestIndex:
        """An empty index in the shared folder. buckets: as many as shuffle partitions unless given."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = name or f"digest_index_{uuid.uuid4().hex}"
        index = cls(name, f"{shared_dir(spark)}/{name}", buckets)
        index.attach(spark)
        return index

    def attach(self, spark: SparkSession) -> None:
        """Declare the table to the session's catalog; an index of an earlier session is found by its folder."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id BIGINT, keep_chars INT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the texts of ``docs`` that the index lacks; return the keyed rows: doc_id, n_chars, digest."""
        spark = docs.sparkSession
        keyed = docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
            digest(F.col(text_col)).alias("digest"),
        )
        candidates = best_of(keyed)
        known = self.read(spark).select("digest")
        fresh = candidates.join(known.hint("merge"), "digest", "left_anti")
        fresh.write.insertInto(self.name)
        spark.catalog.refreshTable(self.name)
        return keyed


def best_of(keyed: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size. Partial sums before the shuffle."""
    # max of (chars, has an id, smallest id): ids are negated without overflow by bitwise not.
    best = F.max(F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.col("doc_id")).alias("rank")))
    return keyed.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.bitwise_not(F.col("best.rank")).alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size"
    )


def assign(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """One row per document with the representative of its text.

    Both sides are shuffled by digest, so a digest with a large part of the rows is split by the
    skew-join rule of adaptive execution: its documents are dealt to several tasks, and the one index row
    goes to each.
    """
    # The index is read through a projection that hides its bucketing: a bucketed side can't be split.
    plain = index.select(F.concat(F.col("digest"), F.lit("").cast("binary")).alias("digest"), "keep_id", "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keyed.join(plain.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Ingest ``docs`` into ``index`` (a new one unless given) and return one row per document:
    doc_id, keep_id, group_size, kept, text_sha256. group_size is that of the batch which brought the text."""
    index = index or DigestIndex.create(docs.sparkSession)
    keyed = index.ingest(docs, id_col, text_col)
    return assign(keyed, index.read(docs.sparkSession))
