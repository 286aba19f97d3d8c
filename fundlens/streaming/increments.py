"""Incremental monthly ingestion (X6: K5 + K6 as a stream).

New monthly files landing in a folder, ZIP archives or CSV files, are picked up by a file stream with
``trigger(availableNow=True)``, at most ``FILES_PER_BATCH`` in a batch, oldest first. A micro-batch
carries file names only: its files are read by the same header-mapped readers as the initial load,
filtered by the catalog, reduced to the row of the latest (file time, file, line) per key, and merged
into the table (``month_table``) by one commit.

What was processed outlives the application: the stream's progress lies beside the table, and each
commit records its files. A batch that is replayed, or a stream whose progress was lost, finds its
files there and changes nothing; a batch that failed before its commit left nothing visible. Of two
files that state the same key, the one that was ingested later wins, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digits_only, nan_to_null
from ..operators.dedupe import semi_join_catalog
from ..operators.normalize import lenient_timestamp
from ..session import write_table
from ..sources import month_table
from ..sources.files import pipeline_status, read_monthly_quotas, scan_csv_tree
from ..sources.records import decoded_name

FILES = "path string, modificationTime timestamp, length long, content binary"
KEYS = ("fund_cnpj", "report_date")
FILES_PER_BATCH = 1000


def _csv_quotas(spark: SparkSession, paths: Sequence[str], sep: str) -> DataFrame:
    rows, _ = scan_csv_tree(spark, list(paths), sep, glob="*")
    field = lambda name: F.try_element_at("fields", name)
    key = F.get(F.filter(F.map_keys("fields"), lambda c: F.lower(c).contains("cnpj")), 0)
    return rows.select(field(key).alias("CNPJ_FUNDO"), field(F.lit("DT_COMPTC")).alias("DT_COMPTC"),
                       field(F.lit("VL_QUOTA")).alias("VL_QUOTA"), decoded_name(F.col("file")).alias("file"), F.lit(None).cast("long").alias("line_no"))


def read_quota_files(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    """Canonical rows (fund_cnpj, report_date, quota_value, month, file, line_no) of monthly files;
    rows without id or date are dropped."""
    zips = [p for p in paths if p.lower().endswith(".zip")]
    texts = [p for p in paths if not p.lower().endswith(".zip")]
    parts = [read_monthly_quotas(spark, zips, sep)] * bool(zips) + [_csv_quotas(spark, texts, sep) for _ in texts[:1]]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (rows.select(digits_only("CNPJ_FUNDO").alias("fund_cnpj"), lenient_timestamp(F.col("DT_COMPTC")).cast("date").alias("report_date"),
                        nan_to_null(F.trim("VL_QUOTA").try_cast("double")).alias("quota_value"), "file", "line_no")
            .where((F.col("fund_cnpj") != "") & F.col("report_date").isNotNull())
            .withColumn("month", F.date_format("report_date", "yyyy-MM")))


def merge_batch(table_path: str, sep: str = ";", catalog: DataFrame | None = None, catalog_id_col: str = "CNPJ_FUNDO"):
    """The function that ingests one micro-batch (path, modificationTime) in one commit."""
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = month_table.processed_files(spark, table_path).distinct()
        new = batch.join(seen, batch["path"] == seen["file"], "left_anti").orderBy("modificationTime", "path")
        files = [(r.path, r.modificationTime) for r in new.collect()]     # at most one batch's names
        if not files:
            return
        rows = read_quota_files(spark, [p for p, _ in files], sep)
        if catalog is not None:
            rows = semi_join_catalog(rows, catalog, "fund_cnpj", catalog_id_col)
        arrived = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(files)], "_arrived long, _path string")   # the order of arrival
        rows = rows.join(F.broadcast(arrived), F.col("file") == F.col("_path"), "left")
        rows = write_table(rows.select("fund_cnpj", "report_date", "quota_value", "month", "_arrived", "line_no"), "increment")
        month_table.commit(spark, table_path, rows, KEYS, ("_arrived", "line_no"), [p for p, _ in files])

    return merge


def ingest_new_files(spark: SparkSession, landing: str, table_path: str, files_per_batch: int = FILES_PER_BATCH, **options) -> None:
    """Process every not-yet-seen ZIP or CSV file in ``landing`` into the table at ``table_path`` and
    stop; with ``catalog`` only rows of its funds."""
    stream = (spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
              .option("pathGlobFilter", "*.{zip,csv,CSV}").load(landing).select("path", "modificationTime"))
    (stream.writeStream.foreachBatch(merge_batch(table_path, **options)).option("checkpointLocation", f"{table_path.rstrip('/')}/_progress")
     .trigger(availableNow=True).start().awaitTermination())


def ingest_update(spark: SparkSession, landing: str, table_path: str, catalog: DataFrame | None = None, **options) -> DataFrame:
    """Ingest what is new and return the status row (S9) with the number of new records."""
    before = month_table.read_table(spark, table_path).count() if month_table.last_version(spark, table_path) else 0
    ingest_new_files(spark, landing, table_path, catalog=catalog, **options)
    return pipeline_status(month_table.read_table(spark, table_path), "fund_cnpj", "report_date", before)
