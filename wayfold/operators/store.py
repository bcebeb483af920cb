"""Versioned snapshots: tables of a built graph in a folder, a manifest with
counts and content hashes, and a pointer that is moved last."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def content_hash(df: DataFrame) -> DataFrame:
    """rows and hash of a table, whatever the order of its rows: the sum and the
    exclusive or of its rows' hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0)).alias("sum"))


@dataclass
class Snapshot:
    path: str
    manifest: dict
    tables: dict[str, DataFrame]


def _pointer(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables under a new version, then the manifest, then the pointer;
    readers of the version before keep what they have."""
    version = f"{int(time.time())}-{uuid.uuid4().hex[:8]}"
    facts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
        r = content_hash(spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}")).first()
        facts[name] = {"rows": r["rows"], "hash": f"{r['xor']}:{r['sum']}", "schema": df.schema.json()}
    manifest = json.dumps({"format": FORMAT, "version": version, "tables": facts})
    fs, path = _pointer(spark, root)
    temp = path.suffix(f".{version}")
    out = fs.create(temp, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    # replaces the pointer in one step, so a reader finds the version before or this one
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    files = jvm.FileContext.getFileContext(fs.makeQualified(path).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(temp), fs.makeQualified(path), options)
    return version


def open_snapshot(spark: SparkSession, root: str, verify: bool = False) -> Snapshot:
    """The version that the pointer names; with verify, contents are held against
    the manifest."""
    from pyspark.sql.types import StructType

    text = "\n".join(r[0] for r in spark.read.text(f"{root}/CURRENT").collect())
    manifest = json.loads(text)
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']}")
    tables = {k: spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(f"{root}/{manifest['version']}/{k}") for k, v in manifest["tables"].items()}
    for name, df in tables.items() if verify else ():
        r = content_hash(df).first()
        if f"{r['xor']}:{r['sum']}" != manifest["tables"][name]["hash"]:
            raise ValueError(f"table {name} differs from the manifest")
    return Snapshot(f"{root}/{manifest['version']}", manifest, tables)


class Service:
    """An open snapshot with its health, and reload, which keeps the old one if
    the new one can't be opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.snapshot, self.loaded_at = open_snapshot(spark, root), time.time()

    def health(self) -> dict:
        return {"version": self.snapshot.manifest["version"], "loaded_at_unix": int(self.loaded_at), "counts": {k: v["rows"] for k, v in self.snapshot.manifest["tables"].items()}}

    def reload(self) -> bool:
        try:
            new = open_snapshot(self.spark, self.root)
        except Exception:
            return False
        self.snapshot, self.loaded_at = new, time.time()
        return True
