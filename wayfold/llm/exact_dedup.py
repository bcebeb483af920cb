"""Exact deduplication against a persistent digest index, in SQL functions only.

Texts are equal when they are identical without white space (space and U+0009 to
U+000D). The index is a warehouse table of digests, bucketed and sorted by them,
with the row that stands for each digest. New data is hashed once, reduced to
one row for each digest (in the tasks first, then after one shuffle of digests),
held against the index by a sort-merge anti-join, and what is new is appended.
Of equal new texts, the row with the most code points in the original text
stays, then the one with the smallest doc_id. A digest that the index holds
keeps its row: equal texts of later batches are dropped. A batch has an id: one
that runs again, after a failure, finds its own rows in the index, adds only
what is missing and gets the same result. An index has one writer at a time.

Marking moves digests and ids only. kept_documents() moves the texts of rows
that may have to go (and of as many more as hash like those), not the others.

Null texts count as empty, all equal. Very long texts are hashed whole. Of ties
in length the smallest doc_id stays; a null doc_id sorts before any other.
Repeated rows are equal texts: they are marked alike, and of those that stay
kept_documents() returns one. An empty table gives no rows. Other columns are
ignored by marking and kept as they are by kept_documents(), whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import stored

#: Digests with this share of a batch's rows or more: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
#: Bits of the filter of rows that may have to go: 16 MB, in rows of 32768 bits.
FILTER_BITS = 1 << 27


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def _print():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), points, the code points of the original, and
    print, a hash of the original that tells a doc_id's own texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(), "UTF-8"), 256)).alias("digest"), F.length(F.coalesce(F.col("text"), F.lit(""))).alias("points"), _print().alias("print"))


class DigestIndex:
    """A bucketed table `name` of (digest, keep_id, batch)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)

    def table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self._write(self.spark.createDataFrame([], "digest binary, keep_id long, batch string"))
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> DataFrame:
        """groups: a row for each digest of new data, with keep_id. Adds the
        digests that are new, marked with `batch`, and returns the whole index."""
        new = groups.select("digest", "keep_id").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self._write(new.withColumn("batch", F.lit(batch)))
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest of a batch: digest, group_size, and keep_id and
    keep_print of the row that stays among them."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").alias("keep_id"), F.col("print").alias("keep_print")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select("digest", "group_size", "b.keep_id", "b.keep_print")


def assign(rows: DataFrame, marks: DataFrame, total: int) -> DataFrame:
    """rows with the columns of marks of their digest. Digests with a large
    share of the rows, a bounded number, are broadcast; the others meet their
    rows in a sort-merge join."""
    least = max(2, int(total * HOT_SHARE))
    hot = marks.where(F.col("group_size") >= least)  # total / least rows at most
    names = [*rows.columns, *(c for c in marks.columns if c != "digest")]
    common = rows.join(F.broadcast(hot), "digest").select(names)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(marks.where(F.col("group_size") < least).hint("merge"), "digest").select(names)
    return common.unionByName(rest)


def _marked(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """digests(docs), and for each of them keep_id, keep_print, group_size and
    own: whether a row of this batch stays."""
    if index is not None and batch is None:
        raise ValueError("a batch that goes into an index needs an id, the same if it runs again")
    held = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    rows = stored(digests(docs))
    groups = stored(grouped(rows))
    known = held.append(groups, batch or "first").select("digest", F.col("keep_id").alias("stays"), (F.col("batch") == (batch or "first")).alias("own"))
    marks = stored(groups.join(known.hint("merge"), "digest").select("digest", F.col("stays").alias("keep_id"), "keep_print", "group_size", "own"))
    if index is None:
        held.drop()
    return rows, marks


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each of docs: doc_id, keep_id, group_size (its equals in this
    batch), kept, text_sha256. Without an index, one is made for this batch
    alone and dropped. Rows that repeat a doc_id with an equal text are one
    document and are marked alike."""
    rows, marks = _marked(docs, index, batch)
    kept = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return assign(rows.select("doc_id", "digest"), marks.drop("keep_print"), rows.count()).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _filter(keys: DataFrame) -> DataFrame:
    """keys: (doc_id, print). A filter of them as rows of 32768 bits: bucket and
    bits, FILTER_BITS / 32768 rows of 4 KB at most."""
    return keys.select(_bit("doc_id", "print").alias("at")).groupBy(F.expr("at DIV 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))


def _bit(doc_id: str, print_: str):
    return F.pmod(F.xxhash64(doc_id, print_), F.lit(FILTER_BITS))


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows, one."""
    rows, marks = _marked(docs, index, batch)
    stay = marks.where("own").select(F.struct(F.col("keep_id").alias("doc_id"), F.col("keep_print").alias("print")).alias("key"), F.lit(True).alias("stays"))
    keys = rows.groupBy(F.struct("doc_id", "print").alias("key")).agg(F.count("*").alias("n")).join(stay, "key", "left")
    doubt = _filter(keys.where("stays IS NULL OR n > 1").select("key.doc_id", "key.print"))
    free = "_" * (1 + max(map(len, docs.columns)))  # a prefix that no column has
    key, at, bucket, bits, rank = (free + c for c in ("key", "at", "bucket", "bits", "rank"))
    own = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), _print().alias("print")))
    own = own.withColumn(at, _bit(f"{key}.doc_id", f"{key}.print")).withColumn(bucket, F.expr(f"{at} DIV 32768"))
    own = own.join(F.broadcast(doubt.withColumnsRenamed({"bucket": bucket, "bits": bits})), bucket, "left")  # 16 MB at most
    byte = F.conv(F.hex(F.expr(f"substring({bits}, CAST({at} % 32768 DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    may_go = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({at} % 8 AS INT))")) != 0, F.lit(False))
    doubtful = own.where(may_go).join(stay.select(F.col("key").alias(key)).hint("merge"), key, "left_semi")
    one = doubtful.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(at))).where(f"{rank} = 1")
    return own.where(~may_go).select(docs.columns).unionAll(one.select(docs.columns))
