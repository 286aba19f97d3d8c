"""Monthly ZIP fixtures written by Spark from table-derived rows, to any store that Spark can write.

Rows become lines, are partitioned by month and sorted; a task packs a month into one archive (member
``<stem>.csv``) and hands it over as one row, which Spark's text sink writes to a file of its own. A
ZIP archive ends with a zero byte (the length of its empty comment), which is left to the sink as
its line separator. The driver then names the files. A month's archive is held in memory: this is a
fixture writer, not part of the engine.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_bytes(member: str, body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, body)
    return out.getvalue()


def _packer(header_of: dict[str, list[str]], columns: list[str], sep: str):
    """Rows (month, line), months one after the other, to a row (month, archive) for each month."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m, batch.filter(pc.equal(batch.column(0), m)).column(1)) for batch in batches for m in pc.unique(batch.column(0)).to_pylist())
        for month, parts in itertools.groupby(rows, key=lambda r: r[0]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open(f"daily_quotas_{month}.csv", "w", force_zip64=True) as member:
                member.write((sep.join(header_of.get(month, columns)) + "\n").encode())
                for _, lines in parts:
                    member.write(("\n".join(lines.to_pylist()) + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([month]), pa.array([out.getvalue()[:-1]])], ["_month", "value"])

    return pack


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, its Path class) of ``path``."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, Path = file_system(spark, path)
    out = fs.create(Path(path))
    out.write(bytearray(data))
    out.close()


def write_monthly_zips(df: DataFrame, root: str, month_col: str, sort_cols: Sequence[str],
                       header_by_month: dict[str, list[str]] | None = None, sep: str = ";", months: Sequence[str] | None = None) -> None:
    """One ``daily_quotas_<month>.zip`` per month value below ``root``; ``header_by_month`` renames the
    header per month (same order). ``months`` are the month values, where they are known."""
    from ..session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    n = len(months) if months is not None else df.select(month_col).distinct().count()  # calendar-bounded
    data = df.withColumnRenamed(month_col, "_month").where(F.col("_month").isNotNull())
    cols = [c for c in data.columns if c != "_month"]
    line = F.to_csv(F.struct(*cols), {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    ordered = (data.select("_month", line.alias("_line"), *sort_cols).repartition(max(1, 2 * n), "_month")
               .sortWithinPartitions("_month", *sort_cols).select("_month", "_line"))
    packed = ordered.mapInArrow(_packer(header_by_month or {}, cols, sep), "_month string, value binary")
    (packed.select("_month", F.col("value").cast("string").alias("value")).write.partitionBy("_month")
     .option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(f"{root}/_made"))
    fs, Path = file_system(spark, root)
    for s in fs.globStatus(Path(f"{root}/_made/_month=*/part-*")):
        month = s.getPath().getParent().getName().split("=")[1]
        fs.rename(s.getPath(), Path(f"{root}/daily_quotas_{month}.zip"))


def month_key(date_str_col: str):
    return F.concat(F.substring(date_str_col, 1, 4), F.substring(date_str_col, 6, 2))
