"""Exact deduplication against a persistent digest index; DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. Every batch is reduced to one row per digest (partial aggregation
first, so a hot text costs one row per task); a sort-merge anti-join with the index tells what is new, and both what is new and
what is known are appended as one row a digest and batch: (digest, n_cp, none, keep_id, n_rows, batch, new). Counts and the
row that stays are sums and minima over a digest's rows, read without a shuffle since a bucket holds whole digests. Texts never move: rows
are a digest, a length and ids.

A batch has a name. Rows that the index already has under that name don't count as known, and are not appended again, so a batch that is
repeated after a failure, before or after its append, gives the same result and leaves the same index.

Texts are equal when they agree after all of [\\x20\\x09-\\x0D] is deleted; null counts as empty. Of equal texts the
one with the most code points stays, then the smallest doc_id (a null id after all others), then one of the repeated rows.
Between batches: with keep='first' what an earlier batch kept stays, and equal rows of later ones are dropped in its favour, even
longer ones; with keep='best' the best row of all batches so far stays. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.skew import join_counted
from strandloom.session import materialise

SPACES = r"[\x20\x09-\x0D]"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, "").cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_cp, row_id) of every row, written once; whole texts are read here only."""
    n = F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return materialise(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), n.alias("n_cp")).withColumn("row_id", F.monotonically_increasing_id()), "digests")


def _rank() -> list[Column]:
    """What orders equal texts: the first one stays."""
    return [(-F.col("n_cp")).alias("n"), F.col("none"), F.col("keep_id")]


class DigestIndex:
    """The index as a table of the session's catalog, whose folder (the warehouse) driver and executors share."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def append(self, rows: DataFrame) -> None:
        """One file a bucket: rows are dealt as the buckets are."""
        rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add_digests(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of `rows` (id, digest, n_cp, row_id), a table that is read again, as a batch."""
        rows = rows.withColumnRenamed("id", "keep_id").withColumn("none", F.col("keep_id").isNull())
        reps = rows.groupBy("digest").agg(F.min(F.struct(*_rank())).alias("x"), F.count("*").alias("n_rows"))
        reps = reps.select("digest", (-F.col("x.n")).alias("n_cp"), "x.none", "x.keep_id", "n_rows", F.lit(batch).alias("batch"))
        reps = materialise(reps, "reps")
        index = self.read()
        if index is None:
            self.append(reps.withColumn("new", F.lit(True)))
            return
        others = index.where(F.col("batch") != batch).groupBy("digest").agg(F.lit(1).alias("one"))
        new = reps.join(others.hint("merge"), "digest", "left_anti").withColumn("new", F.lit(True))
        known = reps.join(others.hint("merge"), "digest", "left_semi").withColumn("new", F.lit(False))
        done = index.where(F.col("batch") == batch).select("digest")
        self.append(materialise(new.unionByName(known).join(done.hint("merge"), "digest", "left_anti"), "appended"))

    def view(self, keep: str = "best") -> DataFrame:
        """(digest, keep_id, keep_batch, group_size), one row a digest. With keep='first' the row that stays is that of the batch that found the digest new."""
        late = [(~F.col("new")).alias("late")] if keep == "first" else []
        per = self.read().groupBy("digest").agg(F.min(F.struct(*late, *_rank(), "batch")).alias("x"), F.sum("n_rows").alias("group_size"))
        return per.select("digest", "x.keep_id", F.col("x.batch").alias("keep_batch"), "group_size")

    def report(self, rows: DataFrame, keep: str = "best") -> DataFrame:
        """Per row of (id, digest, n_cp, row_id, batch): id, keep_id, group_size (rows with this text in all batches so far), kept, text_sha256."""
        # Which of repeated rows stays is told from these rows, since a repeated batch may number them anew.
        named = rows.withColumnRenamed("id", "keep_id").withColumn("none", F.col("keep_id").isNull())
        here = materialise(named.groupBy("digest", "batch").agg(F.min(F.struct(*_rank(), "row_id")).alias("x"), F.count("*").alias("n")).select("digest", "batch", "n", F.col("x.row_id").alias("keep_row")), "here")
        n = here.groupBy("digest").agg(F.sum("n").alias("n_here"))
        best = here.select("digest", F.col("batch").alias("keep_batch"), "keep_row")
        view = materialise(self.view(keep).join(n.hint("merge"), "digest").join(best.hint("merge"), ["digest", "keep_batch"], "left"), "view")
        out = join_counted(rows, view, ["digest"], "n_here", rows.count())
        return out.select("id", "keep_id", "group_size", F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, keep: str = "first") -> DataFrame:
        """Deduplicate docs among themselves and against the index, and add them as a batch. A batch without a name can't be told from its repetition.

        Per row: id, keep_id, group_size, kept, text_sha256.
        """
        batch = batch or uuid.uuid4().hex
        rows = digests(docs, id_col, text_col)
        self.add_digests(rows, batch)
        return self.report(rows.withColumn("batch", F.lit(batch)), keep).withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """A whole table, added to an index in `batches` batches by the hash of the id; what stays is the best row of all of them. The index is dropped in the end."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    rows = digests(docs)
    named = rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("string"))
    try:
        for i in range(batches):
            index.add_digests(named.where(F.col("batch") == str(i)).drop("batch"), str(i))
        return materialise(index.report(named), "exact").withColumnRenamed("id", "doc_id")
    finally:
        index.drop()


ORACLE = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN k USING (h)"""
