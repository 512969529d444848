"""Tables that become readable all at once: data is written aside, a manifest names it, and readers take only what is named.

    <path>/data/<commit>/<table>/part-*.parquet     written first, seen by nobody
    <path>/manifests/version=<n>/part-*.parquet     one small file; its appearance is the commit

A manifest holds, for every file of every table of the version, its name, size and number of rows, and each table's schema with a
hash. A writer that dies leaves data that no manifest names: readers go on with the version before. One writer at a time per path.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version int, commit string, table string, schema string, schema_hash string, file string, bytes long, rows long"


def _hash(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every file of every committed version; no row where nothing is committed."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
    return spark.createDataFrame([], _MANIFEST)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, table, files, rows, bytes`` of every committed table."""
    named = manifests(spark, path).groupBy("version", "table")
    return named.agg(F.count("file").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest committed version, 0 before the first."""
    return manifests(spark, path).agg(F.max("version")).first()[0] or 0


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, bytes, rows`` of a written folder; rows are counted from the files as they are."""
    there = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return there.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write all ``tables`` and commit them together; the new version's number.

    If any table fails, nothing is committed. A table without rows is committed without files.
    """
    mark, version = uuid.uuid4().hex, latest_version(spark, path) + 1
    named = []
    for name, df in tables.items():
        folder = f"{path}/data/{mark}/{name}"
        df.write.parquet(folder)
        # As it is read back: nothing is required to be not null.
        schema = spark.read.parquet(folder).schema
        about = [F.lit(v).alias(n) for n, v in (("version", version), ("commit", mark), ("table", name), ("schema", schema.json()), ("schema_hash", _hash(schema)))]
        found = _files(spark, folder)
        whole = spark.range(1).select(*about, F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("rows"))
        named.append(found.select(*about, "file", "bytes", "rows").unionByName(whole))
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    # One file: it is moved into place at the end of the job, whole or not at all.
    every.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/version={version}")
    return version


def read(spark: SparkSession, path: str, table: str, version: int | None = None, check: bool = False) -> DataFrame:
    """A committed table, from exactly the files its manifest names; the newest version unless one is given.

    The file names pass through the driver, as those of any file scan do. A manifest whose schema doesn't agree with its hash is
    refused; ``check`` also counts the rows again.
    """
    version = version or latest_version(spark, path)
    rows = manifests(spark, path).where((F.col("version") == version) & (F.col("table") == table)).select("schema", "schema_hash", "file", "rows").collect()
    if not rows:
        raise ValueError(f"no committed table {table!r} in version {version} of {path}")
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    if len({r["schema"] for r in rows}) > 1 or _hash(schema) != rows[0]["schema_hash"]:
        raise ValueError(f"the manifest of {table!r}, version {version}, disagrees with itself")
    files = sorted(r["file"] for r in rows if r["file"] is not None)
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    if check and (n := found.count()) != (told := sum(r["rows"] or 0 for r in rows)):
        raise ValueError(f"{table!r}, version {version}, has {n} rows, its manifest says {told}")
    return found


def once(df: DataFrame, path: str, table: str = "table") -> DataFrame:
    """The committed table at ``path``, committed from ``df`` only if there is none."""
    spark = df.sparkSession
    if not latest_version(spark, path):
        commit(spark, path, {table: df})
    return read(spark, path, table)
