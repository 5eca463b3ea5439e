"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text (digest, keep_id, group_size), bucketed and
sorted by digest. New documents are reduced to one row per digest, those that the index holds
fall out in a sort-merge anti-join that does not shuffle the index, and the rest are appended.
The batch's digests then find their keepers in a second sort-merge join, for which the index stays
in place too, and the rows find theirs among those, as many as the batch has texts. Only digests
and ids are shuffled, never texts.

Texts are equal when identical after lower-casing A-Z. Of equal texts in one batch the row with
the largest doc_id stays; a text that an earlier batch has indexed keeps that batch's row.

Defined cases: a null text is the empty text; a null doc_id never stays if its group holds another
(in a group of null doc_ids only, keep_id is null and none is dropped); rows that repeat a doc_id
with its text are one document and share one verdict; group_size counts the rows of the batch that
brought the text; a very long text is hashed like any other; an empty table gives no row. Columns
of other names are not looked at by op4; keep_first carries them, and __key and __own are its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, saved, shared_path, text_of

BUCKETS = 64
BUCKET_ROWS = 4_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, in lower-case hex."""
    return F.sha2(F.encode(lower_az(text_of(text)), "UTF-8"), 256)


def buckets_for(n: int) -> int:
    """Buckets of an index that is to hold n texts."""
    return max(BUCKETS, -(-n // BUCKET_ROWS))


class DigestIndex:
    """A bucketed and sorted table of the digests seen so far, at a path that all executors share.

    An index opened again keeps the number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path or shared_path(spark, "digest-index")
        if path is None:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}-made")
        self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}-made").first().buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append rows (digest, keep_id, group_size), as many files as buckets."""
        rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.insertInto(self.name)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay for the next one."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id and digest of every row, computed once."""
    return saved(documents.select("doc_id", digest(F.col("text")).alias("digest")))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each digest, with the largest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def absent(groups: DataFrame, index: DigestIndex) -> DataFrame:
    """The groups whose digest the index lacks; the index is not shuffled."""
    return groups.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")


def new_groups(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row for each digest of rows that the index lacks, with the largest doc_id."""
    return absent(groups_of(rows), index)


def deduplicate(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row; the index gains the new texts."""
    rows = signatures(documents)
    groups = saved(groups_of(rows))
    index.add(absent(groups, index))
    found = saved(groups.select("digest").join(index.rows().hint("merge"), "digest"))
    # two plain shuffles: one digest with a third of all rows is split at run time
    met = rows.join(found, "digest")
    return met.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def against_new_index(documents: DataFrame) -> DataFrame:
    """deduplicate against an index that starts empty and is let go, as nothing is to follow."""
    index = DigestIndex(documents.sparkSession, buckets=buckets_for(documents.count()))
    verdicts = deduplicate(documents, index)
    index.close()
    return verdicts


def op4(documents: DataFrame) -> DataFrame:
    """Verdict on every row, against an index that starts empty."""
    return against_new_index(documents).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def document_key(documents: DataFrame) -> Column:
    """What tells one document of a table from another: its doc_id together with its text's digest."""
    return F.concat(F.coalesce(documents["doc_id"].cast("string"), F.lit("")), F.lit(":"), digest(documents["text"]))


def keep_first(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of documents that stay, with all their columns; repeats of a doc_id with its text go too.

    Rows are told apart by doc_id and digest, so a row stays by its own verdict alone.
    """
    verdicts = deduplicate(documents, index) if index else against_new_index(documents)
    kept = verdicts.where("kept")
    kept = kept.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest").alias("__key")).distinct()
    stay = documents.withColumn("__key", document_key(documents)).join(kept, "__key", "left_semi")
    # rows without an id are no repeats of each other
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return stay.withColumn("__own", own).dropDuplicates(["__key", "__own"]).drop("__key", "__own")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
