"""Sources and sinks.

Delimited files with different headers are read in two text scans (``records``):

* a light pass finds, per file, the charset (UTF-8 if every line is valid, else ISO-8859-1; S2), the
  header, and whether it can be read to its end; the one-row-per-file table is written, and only the
  distinct headers (typically a handful) and the names of unreadable files reach the driver;
* the data pass decodes each record with its file's charset and parses it with Spark's CSV parser
  under its file's header, quotes and quoted line breaks included. A record that repeats the header
  is no data. Records with more fields than the header are dropped, fewer are padded with NULL (S3);
  missing-value tokens become NULL. Fields are addressed by header name, so differing headers (S11)
  meet in one map.

The two passes agree by file name and text alone, so how files are packed into splits plays no part.
A file that cannot be read to its end is left out whole and reported with its reason
(``file_status``, ``file_report``).

Monthly ZIP archives are read once, by one task each (the format cannot be split; an archive is
held in memory, 2 GB at most): the member's checksum is verified over the whole stream before its
first line is handed out, so an archive counts whole or not at all.
"""

from __future__ import annotations

import csv
import io
import operator
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .records import n_fields, scan_records

# fixed values: the monthly file layout and the catalog columns
CATALOG_COLUMNS = ["CNPJ_FUNDO", "DENOM_SOCIAL", "SIT", "DT_REG", "DT_CONST", "CD_CVM", "DT_CANCEL",
                   "TP_FUNDO", "DT_INI_SIT"]
QUOTA_COLUMNS = ["DT_COMPTC", "VL_QUOTA"]


# fixed values: texts that stand for a missing value (the usual defaults of CSV readers)
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def file_status(spark: SparkSession, root: str | Sequence[str], glob: str = "*.[cC][sS][vV]*", sep: str = ";") -> DataFrame:
    """(file, size, n_records, status, reason) of every matching file: 'read', or 'failed' with the
    reason why none of its rows is kept. ``n_records`` does not count the header."""
    _, meta = scan_records(spark, root, glob, sep)
    good = F.col("reason").isNull()
    return meta.select("file", "size", F.when(good, F.col("n_lines") - 1).alias("n_records"),
                       F.when(good, "read").otherwise("failed").alias("status"), "reason")


def file_report(spark: SparkSession, root: str, glob: str = "*.[cC][sS][vV]*") -> DataFrame:
    """(files_found, files_read, files_failed, data_lines) of ``file_status``."""
    files = file_status(spark, root, glob)
    return files.agg(F.count(F.lit(1)).alias("files_found"), F.count_if(F.col("status") == "read").alias("files_read"),
                     F.count_if(F.col("status") == "failed").alias("files_failed"), F.sum("n_records").alias("data_lines"))


def header_names(header: str, sep: str = ";") -> list[str]:
    """The field names of a header line."""
    return [x.strip() for x in next(csv.reader([header], delimiter=sep), [])]


def parsed_records(lines: DataFrame, headers: Sequence[str], sep: str = ";") -> DataFrame:
    """S3: one (file, header, r0, r1, ...) row per data line; ``r<j>`` has the texts of the line's fields
    as c0, c1, ... if its header is ``headers[j]``, else it is NULL. Over-long lines are dropped, short
    lines padded with NULL."""
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    records, width = [], F.lit(0)
    for j, h in enumerate(headers):
        n = len(header_names(h, sep))
        record = F.from_csv("line", ", ".join(f"c{i} string" for i in range(n)), options)
        records.append(F.when(F.col("header") == h, record).alias(f"r{j}"))
        width = F.when(F.col("header") == h, n).otherwise(width)
    return lines.where(n_fields(F.col("line"), sep) <= width).select("file", "header", *records)


def text_or_null(value: Column) -> Column:
    """A field's text; NULL for a missing-value token."""
    return F.when(~F.trim(value).isin(*MISSING), value)


def parse_delimited(lines: DataFrame, headers: Sequence[str], sep: str = ";") -> DataFrame:
    """S3 + S11: one (file, header, map<header name, text>) row per data line; over-long lines
    dropped, short lines padded with NULL, missing-value tokens NULL. Repeated names: the first."""
    fields = F.lit(None)
    for j, h in enumerate(headers):
        names = header_names(h, sep)
        firsts = [i for i, n in enumerate(names) if n not in names[:i]]
        made = F.map_from_arrays(F.array(*[F.lit(names[i]) for i in firsts]), F.array(*[text_or_null(F.col(f"r{j}.c{i}")) for i in firsts]))
        fields = F.when(F.col("header") == h, made).otherwise(fields)
    return parsed_records(lines, headers, sep).select("file", "header", fields.alias("fields"))


def sample_per_file(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows per file (each with chance n / rows, only where rows > n). A row's number
    in [0, 1) is the beginning of the md5 of the seed and its fields' texts in the header's order,
    joined by ``|`` (missing: empty), so the choice depends on neither partitioning nor file names."""
    counts = df.groupBy("file").agg(F.count(F.lit(1)).alias("_rows"))
    texts = F.transform(F.map_values("fields"), lambda x: F.coalesce(x, F.lit("")))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.array_join(texts, "|"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    # a row per file, whose names Spark's listing holds on the driver anyway: the rows are not shuffled
    return df.join(F.broadcast(counts), "file").where((F.col("_rows") <= n) | (drawn < n / F.col("_rows"))).drop("_rows")


def scan_csv_tree(spark: SparkSession, root: str | Sequence[str], sep: str = ";", sample_size: int | None = None,
                  seed: int = 42, glob: str = "*.[cC][sS][vV]"):
    """(rows with a ``fields`` map and the source ``file``, distinct header lines). An
    empty tree, or one in which no file can be read, is an error."""
    lines, headers = scan_lines(spark, root, sep, glob)
    rows = parse_delimited(lines, headers, sep)
    return (sample_per_file(rows, sample_size, seed) if sample_size else rows), headers


def scan_lines(spark: SparkSession, root: str | Sequence[str], sep: str = ";", glob: str = "*.[cC][sS][vV]"):
    """(records of all readable files, distinct header lines); an error if there is no such file."""
    lines, meta = scan_records(spark, root, glob, sep)
    headers = sorted(r[0] for r in meta.where("reason IS NULL").select("header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"{root} holds no readable delimited file")
    return lines, headers


def columns_from_fields(rows: DataFrame, headers: Sequence[str], sep: str = ";") -> DataFrame:
    """Project the header-addressed fields to ordinary string columns (union by name over all
    headers; a name missing from a file is NULL)."""
    names = list(dict.fromkeys(c for h in headers for c in header_names(h, sep)))
    return rows.select("file", *[F.col("fields").getItem(c).alias(c) for c in names])


# ------------------------------------------------------------------ S5-S7: monthly ZIP files


BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, KeyError, NotImplementedError, RuntimeError, OSError)
ZIP_BATCH = 10_000


def _verified_member(path: str, content: bytes) -> tuple[zipfile.ZipFile, str]:
    """The archive and its member ``<stem>.csv``, read to its end once: raises if anything in it,
    checksum included, is wrong."""
    member = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".csv"
    archive = zipfile.ZipFile(io.BytesIO(content))
    with archive.open(member) as stream:
        while stream.read(1 << 20):
            pass
    return archive, member


def _unzip_lines(it: Iterator[pd.DataFrame], head_only: bool = False) -> Iterator[pd.DataFrame]:
    """Lines of verified members in batches; one row with a reason for an archive that is not."""
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                archive, member = _verified_member(path, content)
            except BROKEN as e:
                yield pd.DataFrame({"file": [path], "line_no": [-1], "line": [None], "reject": [f"{type(e).__name__}: {e}"]})
                continue
            with archive.open(member) as stream:
                lines = (raw.rstrip("\r\n") for raw in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=""))
                no, batch = 0, []
                for line in lines:
                    batch.append(line)
                    if len(batch) == ZIP_BATCH or head_only:
                        yield pd.DataFrame({"file": path, "line_no": range(no, no + len(batch)), "line": batch, "reject": None})
                        no, batch = no + len(batch), []
                        if head_only:
                            break
                if batch:
                    yield pd.DataFrame({"file": path, "line_no": range(no, no + len(batch)), "line": batch, "reject": None})


def _unzip_quotas(batches: Iterator[pa.RecordBatch], sep: str = ";") -> Iterator[pa.RecordBatch]:
    """Key, date and quota of the verified members that have these columns."""
    names, missing = ["CNPJ_FUNDO", *QUOTA_COLUMNS, "file", "line_no"], frozenset(MISSING)

    def made(cells, numbers):
        texts = [pa.array([None if c.strip() in missing else c for c in column], pa.string()) for column in zip(*cells)]
        return pa.RecordBatch.from_arrays([*texts, pa.array([path] * len(numbers)), pa.array(numbers, pa.int64())], names)

    for batch in batches:
        for path, content in ((p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1))):
            try:
                archive, member = _verified_member(path, content)
            except BROKEN:
                continue
            with archive.open(member) as stream:
                rows = csv.reader(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=""), delimiter=sep)
                header = [x.strip() for x in next(rows, [])]
                key = next((c for c in header if "cnpj" in c.lower()), None)
                if key is None or not set(QUOTA_COLUMNS) <= set(header):
                    continue
                at, width = [header.index(c) for c in (key, *QUOTA_COLUMNS)], len(header)
                pick, needed = operator.itemgetter(*at), max(at)
                cells, numbers = [], []
                for no, row in enumerate(rows, 1):
                    if 0 < len(row) <= width:
                        cells.append(pick(row) if len(row) > needed else tuple(row[i] if i < len(row) else "" for i in at))
                        numbers.append(no)
                    if len(cells) == ZIP_BATCH:
                        yield made(cells, numbers)
                        cells, numbers = [], []
                if cells:
                    yield made(cells, numbers)


def _archives(spark: SparkSession, root: str | Sequence[str], glob: str) -> DataFrame:
    ship_package(spark)  # the unzip functions run in the Python workers
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root).select("path", "content"))


def read_zip_lines(spark: SparkSession, root: str | Sequence[str], glob: str = "*.zip", head_only: bool = False) -> DataFrame:
    """Lines of ``<stem>.csv`` inside each ZIP (one task per archive, in batches), only the first
    with ``head_only``; an unreadable or damaged archive gives one row with a ``reject`` reason and
    no line."""
    return _archives(spark, root, glob).mapInPandas(lambda it: _unzip_lines(it, head_only),
                                                    "file string, line_no long, line string, reject string")


def key_column_of(header, sep: str = ";"):
    """The first header name containing 'cnpj' (case-insensitive), else NULL."""
    names = F.transform(F.split(header, sep), lambda x: F.trim(x))
    return F.get(F.filter(names, lambda x: F.lower(x).contains("cnpj")), 0)


def read_monthly_quotas(spark: SparkSession, root: str | Sequence[str], sep: str = ";", glob: str = "*.zip") -> DataFrame:
    """S5 -> S6 -> S7: (CNPJ_FUNDO, DT_COMPTC, VL_QUOTA, file, line_no) text columns, each archive
    read once. Archives that are damaged, or lack an id column or the quota columns, are skipped."""
    return _archives(spark, root, glob).mapInArrow(
        lambda it: _unzip_quotas(it, sep), "CNPJ_FUNDO string, DT_COMPTC string, VL_QUOTA string, file string, line_no long")


# ------------------------------------------------------------------ S8-S12


def read_catalog(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """ISO-8859-1, every column a string, only the known catalog columns that are present."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").csv(path)
    return df.select(*[c for c in CATALOG_COLUMNS if c in df.columns])


def pipeline_status(df: DataFrame, id_col: str = "CNPJ_FUNDO", date_col: str = "DT_COMPTC",
                    before_rows: int | None = None) -> DataFrame:
    """Total funds, total records, last processed date and (given the earlier row count) new
    records, from one aggregate."""
    out = df.agg(F.countDistinct(id_col).alias("total_funds"), F.count(F.lit(1)).alias("total_records"),
                 F.max(F.col(date_col).cast("date")).alias("last_processed_date"))
    if before_rows is not None:
        out = out.withColumn("new_records_count", F.col("total_records") - F.lit(before_rows))
    return out


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """S10 sink: refuses an empty frame; snappy parquet (a directory)."""
    if df.isEmpty():
        raise ValueError("nothing to write: the frame has no rows")
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S10 scan."""
    return spark.read.parquet(path)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a missing column is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, sep: str = ";", sample_csv_lines: int = 10,
              allow_full_csv: bool = False) -> str:
    """A full CSV only when the frame has at most ``sample_csv_lines`` rows or
    ``allow_full_csv``; the guard counts at most n + 1 rows."""
    if not allow_full_csv and df.limit(sample_csv_lines + 1).count() > sample_csv_lines:
        raise ValueError(f"Refusing to write full CSV (> {sample_csv_lines} rows); set allow_full_csv")
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_sample_csv(df: DataFrame, path: str, n: int = 10, order_by: Sequence[str] = (), sep: str = ";") -> str:
    """S12 sample: the first ``n`` rows by an explicit order (top-k, not a full sort)."""
    src = df.orderBy(*order_by) if order_by else df
    src.limit(n).coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path

