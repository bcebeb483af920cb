"""What several operators of this subpackage share: table access, words,
intermediate tables in the shared folder, and files shipped to executors."""

from __future__ import annotations

import re
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.tables import release, removed, shared_folder, stored  # noqa: F401

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts are handled in slices of about this many characters, so that what
#: Python holds at once is bounded by the slice or one text, whichever is larger.
SLICE_CHARS = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text and the named columns; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to the shared folder and hand it to every executor,
    also to those that join later; returns the name for shipped()."""
    name = f"{uuid.uuid4().hex}-{name}"  # an application's file names are distinct
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    for at in range(0, len(data), 1 << 22):
        out.write(bytearray(data[at : at + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(str(fs.makeQualified(target).toString()))
    return name


def shipped(name: str) -> str:
    return SparkFiles.get(name)


def slices(batch, column: str = "text"):
    """Row ranges of an Arrow batch with about SLICE_CHARS bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= SLICE_CHARS:
            yield start, i + 1 - start
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes) - start


_owner: list[str] = [""]
_memos: dict[str, object] = {}


def sole_memo(owner: str, clear) -> None:
    """Called where a task of an operator begins: a Python worker serves one
    operator after another, and what the others remembered is let go."""
    _memos[owner] = clear
    if _owner[0] != owner:
        for name, other in _memos.items():
            if name != owner:
                other()
        release()
        _owner[0] = owner
