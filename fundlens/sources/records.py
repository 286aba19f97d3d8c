"""Records of delimited text files: which files can be read, and where their records begin.

**Probe.** One light pass reads every file to its end, tolerating errors, and compares the bytes of
its lines with its size; a compressed file is inflated to its end as well (its checksum decides). What
fails is tried once more, so a passing error of the store excludes nothing. A file that fails again is
left out whole, with the reason, and the data pass, which tolerates nothing, never opens it.

**Records.** A line break inside a quoted field does not end a record. Whether a line begins inside a
field depends on all lines before it, which may lie in other splits. But a line, and so a run of lines,
is a map from "begins outside / inside" to "ends outside / inside": a constant, the identity or a
change. Running maps have a closed form, the last constant and the parity of the changes since, so

* the light pass finds the files with a line that ends inside a field although it began outside; in
  all others every line is a record, and nothing is shuffled;
* the lines of these files are numbered within their splits, in the scan itself, the splits' maps are composed along each file (a window over a row per split), and every line learns how it
  begins, whatever the number of splits;
* a record's lines meet under the key (file, split of its first line, number there); the broken record
  at the end of a split so collects its rest from the splits after it.

A field that a quote opens and nothing closes makes its whole file unreadable, as for other readers.
A quote opens a field only at the field's beginning; elsewhere it is text. Line breaks inside fields
are read as "\\n".
"""

from __future__ import annotations

import bz2
import lzma
import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_table

COMPRESSED = r"(?i)\.(gz|bz2|xz|deflate)$"
LARGEST_VALUE = (1 << 31) - (1 << 20)        # a larger compressed file is judged by its lines alone
INFLATE_STEP = 1 << 20
LINES_OF_TASK = 2_000_000                    # of the files whose records reach over lines
OPEN_FIELD = "quoted field without end"


def read_lines(spark: SparkSession, root: str | Sequence[str], glob: str, tolerant: bool = False,
               without: Sequence[str] = ()) -> DataFrame:
    """(file, _size, _blk, _no, _raw): the lines of all matching files below ``root`` but those named
    in ``without``, which are pruned from the listing. ``_no`` ascends within a split of one scan."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n")
    lines = (reader.option("ignoreCorruptFiles", True) if tolerant else reader.option("ignoreCorruptFiles", False)).text(root)
    if without:
        lines = lines.where(~F.col("_metadata.file_path").isin(*without))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
                        F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_no"), F.col("value").alias("_raw"))


def decoded_name(file: Column) -> Column:
    """A file's plain name: the scans' names are URLs, in which a plus stands for itself."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def without_returns(lines: DataFrame) -> DataFrame:
    """A line for each "\\n", "\\r\\n" or "\\r"; ``_part`` numbers those of one raw line. Bytes that are no
    UTF-8 stay as they are: splitting goes by ISO-8859-1, which has a character for every byte."""
    raw = F.col("_raw")
    shorter = F.substr(raw.cast("binary"), F.lit(1), F.octet_length(raw) - 1).cast("string")
    cut = F.when(raw.endswith("\r"), shorter).otherwise(raw)
    inner = F.transform(F.split(F.decode(cut.cast("binary"), "ISO-8859-1"), "\r"), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    parts = F.when(cut.contains("\r"), inner).otherwise(F.array(cut))
    return lines.select("file", "_size", "_blk", "_no", F.octet_length("_raw").alias("_bytes"), F.posexplode(parts).alias("_part", "_raw"))


def ends_inside(line: Column, begins_inside: bool, sep: str) -> Column:
    """Whether the text's end lies in a quoted field (0 or 1). Between two separators, a quote at the
    beginning opens a field, and the first that is not doubled closes it."""
    closes = lambda p: F.replace(p, F.lit('""'), F.lit("")).contains('"')
    step = lambda inside, p: (F.when(inside == 1, F.when(closes(p), 0).otherwise(1))
                              .when(p.startswith('"') & ~closes(F.substr(p, F.lit(2))), 1).otherwise(0))
    pieces = F.split(line, _literal(sep))
    return F.when(~line.contains('"'), int(begins_inside)).otherwise(F.aggregate(pieces, F.lit(int(begins_inside)), step))


def n_fields(record: Column, sep: str) -> Column:
    """Number of a record's fields: separators inside quoted ones do not count."""
    plain = F.length(record) - F.length(F.replace(record, F.lit(sep), F.lit(""))) + 1
    closes = lambda p: F.replace(p, F.lit('""'), F.lit("")).contains('"')

    def step(s, p):
        inside = F.when(s["inside"] == 1, ~closes(p)).otherwise(p.startswith('"') & ~closes(F.substr(p, F.lit(2))))
        return F.struct(inside.cast("int").alias("inside"), (s["n"] + F.when(inside, 0).otherwise(1)).alias("n"))

    counted = F.aggregate(F.split(record, _literal(sep)), F.struct(F.lit(0).alias("inside"), F.lit(0).alias("n")), step)
    return F.when(~record.contains('"'), plain).otherwise(counted["n"])


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def _decoded(raw: Column, utf8: Column) -> Column:
    return F.when(utf8, raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))


# ------------------------------------------------------------------ probe


def listed_files(spark: SparkSession, root: str | Sequence[str], glob: str) -> DataFrame:
    """(file, size) of all matching files; no content is read. Scans pass empty files over, so these
    come from the listing's names, which Spark holds on the driver for any scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    sized = files.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    names = spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", n),) for n in files.inputFiles()], "file string")
    return names.join(sized, "file", "left").select("file", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def inflate_problem(name: str, content: bytes) -> str | None:
    """What is wrong with a compressed file, read to its end; nothing: None."""
    kinds: dict[str, Callable] = {"gz": lambda: zlib.decompressobj(31), "deflate": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
    make, rest = kinds[name.rsplit(".", 1)[-1].lower()], memoryview(content)
    try:
        while len(rest):
            stream, at = make(), 0
            while not stream.eof and at < len(rest):
                stream.decompress(rest[at:at + INFLATE_STEP])
                at += INFLATE_STEP
            if not stream.eof:
                return "the compressed stream is cut short"
            rest = rest[min(at, len(rest)) - len(stream.unused_data):]
    except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
        return f"{type(e).__name__}: {e}"
    return None


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([inflate_problem(file.as_py(), content.as_py())], pa.string())], ["file", "damage"])


def compressed_files(spark: SparkSession, root: str | Sequence[str], glob: str) -> DataFrame:
    """(file, damage) of the compressed files whose bytes could be read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .option("ignoreCorruptFiles", True).load(root).where(F.col("_metadata.file_path").rlike(COMPRESSED) & (F.col("length") < LARGEST_VALUE)))
    return files.select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(_inflated, "file string, damage string")


def light_pass(lines: DataFrame, sep: str) -> DataFrame:
    """One row per file: charset (UTF-8 if every line is valid), first line that is not blank, number
    of lines, bytes read, and whether a line that begins outside a field ends inside one."""
    first = F.when(F.trim("_raw") != "", F.struct("_blk", "_no", "_part"))
    meta = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("_raw")).alias("_utf8"), F.min_by("_raw", first).alias("_first"),
        F.count_if(F.trim("_raw") != "").alias("n_lines"), F.sum(F.when(F.col("_part") == 0, F.col("_bytes") + 1)).alias("_read"),
        F.max(ends_inside(F.col("_raw"), False, sep)).alias("_inside"))
    return meta.select("file", "_utf8", _decoded(F.col("_first"), F.col("_utf8")).alias("header"), "n_lines", "_read", (F.col("_inside") == 1).alias("broken"))


def _judged(spark: SparkSession, root, glob: str, sep: str) -> DataFrame:
    meta = light_pass(without_returns(read_lines(spark, root, glob, tolerant=True)), sep)
    both = listed_files(spark, root, glob).join(meta, "file", "left").join(compressed_files(spark, root, glob), "file", "left")
    packed, mark = F.col("file").rlike(COMPRESSED), 3            # a byte order mark is not part of the first line
    short = ~packed & ~(F.col("_read") - F.col("size")).isin(0, 1, -mark, 1 - mark)
    reason = (F.when(F.col("size") == 0, "empty file").when(packed & F.col("damage").isNotNull(), F.col("damage"))
              .when(F.col("n_lines").isNull(), "could not be read")
              .when(short, F.concat(F.lit("read "), F.col("_read").cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" bytes")))
              .when(F.col("n_lines") == 0, "no line"))
    return write_table(both.select("file", "size", "_utf8", "header", "n_lines", "broken", reason.alias("reason")), "file-probe")


def probe_files(spark: SparkSession, root: str | Sequence[str], glob: str = "*.[cC][sS][vV]", sep: str = ";") -> DataFrame:
    """One row per file (file, size, _utf8, header, n_lines, broken, reason), written; ``reason`` says
    why a file is left out. Files that fail for another reason than emptiness are tried once more."""
    meta = _judged(spark, root, glob, sep)
    again = failed_names(meta.where("reason <> 'empty file'"))
    if not again:
        return meta
    second = _judged(spark, [unquote(name) for name in again], "*", sep).withColumnRenamed("file", "f")
    tried = meta.join(second.select("f", *[F.col(c).alias(f"{c}_2") for c in meta.columns if c != "file"]), F.col("file") == F.col("f"), "left")
    return write_table(tried.select("file", *[F.when(F.col("f").isNotNull(), F.col(f"{c}_2")).otherwise(F.col(c)).alias(c) for c in meta.columns if c != "file"]), "file-probe")


def failed_names(meta: DataFrame) -> list[str]:
    """Names of the files left out. They are few beside the names of all files, which Spark's listing
    holds on the driver anyway."""
    return [r.file for r in meta.where("reason IS NOT NULL").select("file").collect()]


# ------------------------------------------------------------------ records


SPLIT = ["file", "_blk"]


def _carry_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running states of a scan's lines (file, _blk, _no, _part, _raw, _from0, _from1), which come in the
    order of their splits: for either way b a split may begin, the state after each line (``_after<b>``)
    and the number of records begun so far (``_k<b>``)."""
    split, held = None, None                              # the split at hand; (state, records) for b = 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (files[1:] != files[:-1]) | (blks[1:] != blks[:-1])]))
        ends = np.append(new[1:], len(blks))
        maps = [batch.column(i).to_numpy().astype(np.int64) for i in (5, 6)]
        out = {f"{n}{b}": np.empty(len(blks), np.int64) for n in ("after", "k") for b in (0, 1)}
        for lo, hi in zip(new, ends):
            name = (batch.column(0)[int(lo)].as_py(), int(blks[lo]))
            if name != split:
                split, held = name, [(0, 0), (1, 0)]
            zero, one = maps[0][lo:hi], maps[1][lo:hi]
            parity = np.cumsum((zero == 1) & (one == 0)) % 2
            at = np.maximum.accumulate(np.where(zero == one, np.arange(hi - lo), -1))       # the last constant so far
            for b in (0, 1):
                state, begun = held[b]
                after = np.where(at >= 0, zero[at] ^ parity[at] ^ parity, state ^ parity)
                begins = np.concatenate([[state], after[:-1]]) == 0
                out[f"after{b}"][lo:hi], out[f"k{b}"][lo:hi] = after, begun + np.cumsum(begins)
                held[b] = (int(after[-1]), int(begun + begins.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *(pa.array(v) for v in out.values())],
                                         ["file", "_blk", "_no", "_part", "_raw", "_after0", "_after1", "_k0", "_k1"])


def numbered_lines(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with what they know within their split: whether they begin a record, and the number of
    records begun so far, for either way the split may begin (0 outside, 1 inside a field). ``lines`` are
    a scan's rows in its order, which filters and broadcast joins keep: nothing is shuffled."""
    raw = F.col("_raw")
    mapped = lines.select("file", "_blk", "_no", "_part", raw.cast("binary").alias("_raw"), ends_inside(raw, False, sep).cast("long").alias("_from0"),
                          ends_inside(raw, True, sep).cast("long").alias("_from1"))
    made = mapped.mapInArrow(_carry_states, "file string, _blk long, _no long, _part int, _raw binary, _after0 long, _after1 long, _k0 long, _k1 long")
    return made.withColumn("_raw", F.col("_raw").cast("string"))


def split_states(numbered: DataFrame) -> DataFrame:
    """One row per split: how it begins and ends, and where the record that it begins with began."""
    last = F.struct("_no", "_part")
    splits = numbered.groupBy(*SPLIT).agg(*[F.max_by(f"_after{b}", last).alias(f"_to{b}") for b in (0, 1)], *[F.max(f"_k{b}").alias(f"_n{b}") for b in (0, 1)])
    order = Window.partitionBy("file").orderBy("_blk")
    until, before = (order.rowsBetween(Window.unboundedPreceding, e) for e in (Window.currentRow, -1))
    # the closed form again, along the file
    parity = F.sum(((F.col("_to0") == 1) & (F.col("_to1") == 0)).cast("int")).over(until) % 2
    fixed = F.when(F.col("_to0") == F.col("_to1"), F.col("_to0").bitwiseXOR(F.col("_parity")))
    splits = splits.withColumn("_parity", parity).withColumn("_end", F.coalesce(F.last(fixed, ignorenulls=True).over(until), F.lit(0)).bitwiseXOR(F.col("_parity")))
    splits = splits.withColumn("_begin", F.lag("_end", 1, 0).over(order)).withColumn("_n", F.when(F.col("_begin") == 0, F.col("_n0")).otherwise(F.col("_n1")))
    owner = F.last(F.when(F.col("_n") > 0, F.struct("_blk", "_n")), ignorenulls=True).over(before)
    return splits.withColumn("_owner", owner).select(*SPLIT, "_begin", "_end", F.col("_owner._blk").alias("_owner_blk"), F.col("_owner._n").alias("_owner_n"))


def whole_records(numbered: DataFrame, splits: DataFrame, tasks: int = 1) -> DataFrame:
    """(file, _blk, _k, _raw): the records, lines joined by line breaks; (_blk, _k) ascends in a file.
    Lines meet in ``tasks`` tasks at least, so that none has to spill them."""
    tasks = max(tasks, int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    k = F.when(F.col("_begin") == 0, F.col("_k0")).otherwise(F.col("_k1"))
    keyed = numbered.join(splits, SPLIT).withColumn("_k", k)
    rest = F.col("_k") == 0                                     # lines before the first record that begins in the split
    lines = F.array_sort(F.collect_list(F.struct(F.col("_blk").alias("b"), "_no", "_part", "_raw")))
    grouped = keyed.withColumns({"_at": F.when(rest, F.col("_owner_blk")).otherwise(F.col("_blk")),
                                 "_in": F.when(rest, F.col("_owner_n")).otherwise(F.col("_k"))})
    grouped = grouped.select("file", "_at", "_in", "_blk", "_no", "_part", "_raw").repartition(tasks, "file", "_at", "_in").groupBy("file", "_at", "_in")
    return grouped.agg(lines.alias("l")).select("file", F.col("_at").alias("_blk"), F.col("_in").alias("_k"),
                                                F.array_join(F.transform("l", lambda x: x["_raw"]), "\n").alias("_raw"))


def scan_records(spark: SparkSession, root: str | Sequence[str], glob: str, sep: str) -> tuple[DataFrame, DataFrame]:
    """(records, files): every record (file, header, line) of every readable file, blank ones and
    headers left out, and one row per file with the reason why it was left out (``probe_files``)."""
    meta = probe_files(spark, root, glob, sep)
    readable = meta.where("reason IS NULL")
    bad = failed_names(meta)
    lines = without_returns(read_lines(spark, root, glob, without=bad))
    broken = readable.where("broken").select("file")
    found = None
    if not broken.isEmpty():
        numbered = write_table(numbered_lines(lines.join(F.broadcast(broken), "file", "left_semi"), sep), "quoted-lines")
        splits = write_table(split_states(numbered), "splits")
        open_ = splits.groupBy("file").agg(F.max_by("_end", "_blk").alias("_end")).where("_end = 1").select("file")
        closed = numbered.join(open_, "file", "left_anti")
        found = write_table(whole_records(closed, splits, math.ceil(numbered.count() / LINES_OF_TASK)).where(F.trim("_raw") != ""), "records")
        heads = write_table(found.groupBy("file").agg(F.min_by("_raw", F.struct("_blk", "_k")).alias("_head"), F.count("*").alias("_n"))
                            .join(meta.select("file", "_utf8"), "file").select("file", "_n", _decoded(F.col("_head"), F.col("_utf8")).alias("_head")), "headers")
        named = meta.join(heads, "file", "left").join(open_.withColumn("_open", F.lit(True)), "file", "left")
        meta = write_table(named.select("file", "size", "_utf8", F.coalesce("_head", "header").alias("header"), F.coalesce("_n", "n_lines").alias("n_lines"), "broken",
                                        F.coalesce("reason", F.when(F.col("_open"), OPEN_FIELD)).alias("reason")), "file-probe")
        lines = lines.join(broken, "file", "left_anti")
    good = meta.where("reason IS NULL").select("file", "_utf8", "header")
    raw = lines.select("file", "_raw")
    raw = raw if found is None else raw.unionByName(found.select("file", "_raw"))
    rows = raw.where(F.trim("_raw") != "").join(good, "file").select("file", "header", _decoded(F.col("_raw"), F.col("_utf8")).alias("line"))
    return rows.where(F.col("line") != F.col("header")), meta
