"""A table of monthly folders with a log of commits.

A commit writes new versions of the months that its rows touch into a folder of its own, and then one
small JSON file, the manifest: which folder holds each month, which files the rows came from, and the
number of the commit. Manifests are numbered; a new one appears under its name at once, by a rename.
Readers follow the latest manifest, so they see all of a commit or nothing of it, and folders of an
attempt that failed belong to no manifest. The manifest grows with the calendar; file names are kept
per commit and compared as a table, not on the driver.

Every row carries ``ingest_seq``, the number of its commit: the row of the later commit wins a key.
One writer at a time: a second one that commits the same number is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_extreme_per_key
from ..session import write_table

SEQ, PART, LOG, DATA = "ingest_seq", "_month", "_log", "data"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _log_path(table: str, version: int) -> str:
    return f"{table.rstrip('/')}/{LOG}/{version:012d}.json"


def last_version(spark: SparkSession, table: str) -> int:
    """Number of the latest commit; 0 if there is none. A table that cannot be listed is an error."""
    fs, Path = _store(spark, table)
    if not fs.exists(Path(f"{table}/{LOG}")):
        return 0
    return max((int(s.getPath().getName()[:12]) for s in fs.listStatus(Path(f"{table}/{LOG}")) if s.getPath().getName().endswith(".json")
                and s.getPath().getName()[0].isdigit()), default=0)


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict:
    """{version, months: {month: folder}, columns} of a commit (None: the latest; 0: an empty table)."""
    version = last_version(spark, table) if version is None else version
    if version == 0:
        return {"version": 0, "months": {}, "schema": None}
    row = spark.read.text(_log_path(table, version), wholetext=True).first()
    return json.loads(row[0])


def read_table(spark: SparkSession, table: str, months: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
    """The table's rows as of a commit; with ``months`` only these months' folders are listed and read."""
    made = manifest(spark, table, version)
    if made["schema"] is None:
        raise FileNotFoundError(f"{table} has no commit")
    folders = [f for m, f in sorted(made["months"].items()) if months is None or m in months]
    if not folders:
        return spark.createDataFrame([], made["schema"])
    return spark.read.schema(made["schema"]).parquet(*[f"{table.rstrip('/')}/{DATA}/{f}" for f in folders])


def processed_files(spark: SparkSession, table: str) -> DataFrame:
    """(file) of every file that a commit has recorded."""
    if last_version(spark, table) == 0:
        return spark.createDataFrame([], "file string")
    logs = spark.read.schema("files array<string>").json(f"{table.rstrip('/')}/{LOG}")
    return logs.select(F.explode("files").alias("file"))


def commit(spark: SparkSession, table: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
           files: Sequence[str] = (), month_col: str = "month") -> int:
    """K5 sink: merge ``rows`` into the table and return the commit's number. Of rows that share a
    key the one of the latest commit stays, and within a commit the one with the largest ``order``.
    Only touched months are read and written anew; the manifest makes the result visible at once."""
    before = manifest(spark, table)
    version = before["version"] + 1
    fresh = rows.withColumn(SEQ, F.lit(version).cast("long"))
    columns = [c for c in fresh.columns if c not in order]
    fresh = write_table(keep_extreme_per_key(fresh, keys, [SEQ, *order]).select(*columns), "fresh")     # read for the months and for the rows
    touched = [r[0] for r in fresh.select(month_col).distinct().collect()]        # bounded by the calendar
    old = [m for m in touched if str(m) in before["months"]]
    if old:
        kept = read_table(spark, table, [str(m) for m in old])
        fresh = keep_extreme_per_key(kept.unionByName(fresh, allowMissingColumns=True), keys, [SEQ])
    # a folder name of its own: an attempt that failed never mixes with this one
    folder = f"{version:012d}-{uuid.uuid4().hex[:8]}"
    path = f"{table.rstrip('/')}/{DATA}/{folder}"
    name = F.coalesce(F.col(month_col).cast("string"), F.lit("none"))
    fresh.withColumn(PART, name).repartition(PART, F.xxhash64(*keys) % 8).write.partitionBy(PART).parquet(path)
    months = before["months"] | {("none" if m is None else str(m)): f"{folder}/{PART}={'none' if m is None else m}" for m in touched}
    publish(spark, table, {"version": version, "months": months, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema),
                           "files": list(files)})
    return version


def publish(spark: SparkSession, table: str, made: dict) -> None:
    """Write a manifest whole, then give it its name; refused if a commit has this number already."""
    fs, Path = _store(spark, table)
    final, draft = Path(_log_path(table, made["version"])), Path(f"{table.rstrip('/')}/{LOG}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"commit {made['version']} of {table} exists already: another writer was faster")


def expire(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete folders that none of the last ``keep`` manifests refers to, such as those of older
    versions and of failed attempts; returns how many. Older versions cannot be read afterwards; the
    manifests stay, since they hold the processed files."""
    last = last_version(spark, table)
    live = {f.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for f in manifest(spark, table, v)["months"].values()}
    fs, Path = _store(spark, table)
    gone = [s.getPath() for s in fs.listStatus(Path(f"{table.rstrip('/')}/{DATA}")) if s.getPath().getName() not in live]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
