"""Operator 13, token files: documents' token ids in patched frame-of-reference blocks.

A file is a run of segments, each a row of Spark's text sink that its end mark closes. All numbers are
little-endian. A segment holds

* the head: magic ``PFR1``, ids per block (u32), range number (u64: the task that wrote it, ranges of
  ids ascend), ids of that range before the segment (u64), documents (u32), ids (u64), blocks (u32),
  bytes of the names, of the blocks (u64 each), and the crc32 of all that follows (u32);
* the documents: number of ids (u64 each), length of the name (i32 each, -1: null), names in UTF-8;
* the index: the byte at which every block starts, and the end of the last (u64 each);
* the blocks: smallest id (u32), width (u8), exceptions (u32), the differences to the smallest id in
  ``width`` bits each, lowest bit first; then the places (u32 each) of those that need more bits, and
  their whole differences (u32 each).

A block's width is that of the difference at the percentile ``PERCENTILE``; larger ones are its
exceptions. The index leads to any block, and the documents' counts to any document, without the others.

Writing: documents are range-partitioned and sorted by id (null first), then by a hash of the text,
then by row, so that one id that many rows share is split over ranges too. Each task encodes its
range and hands out segments of about ``SEGMENT_IDS`` ids, ``FILE_SEGMENTS`` to a file; Spark's commit
keeps only the files of tasks that succeeded. Reading: Spark's binary source; a damaged segment raises.
A document's start is the ids of the ranges before its own (a sum by blocks of ranges) plus the ids
before it in its range, which the head of its segment holds.

Scale: one exchange of the texts. A task holds a slice of texts and one segment; the reader a file. A
document is never split over segments, so a segment may be as large as one document.

Defined cases: null and empty texts have only the end id; a null id sorts first and is read back null;
rows that share an id stay apart, in the order of their texts' hashes; an empty table gives no
documents; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, write_table
from .bpe import of_worker, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 256
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 16
RANGES_TOGETHER = 1000
MAGIC, CLOSING = b"PFR1", "\x00END\n"
HEAD = struct.Struct("<4sIQQIQIQQI")
BLOCK = np.dtype([("least", "<u4"), ("width", "u1"), ("patches", "<u4")])


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values in ``width`` bits each, a row of bytes for each row. Eight values fill ``width``
    bytes, so every byte is put together from those values of eight that reach into it."""
    rows, n = values.shape
    eights = np.pad(values, ((0, 0), (0, -n % 8))).reshape(rows, -1, 8)
    out = np.zeros((rows, eights.shape[1], width), np.uint8)
    for byte in range(width):
        for j in range(8 * byte // width, (8 * byte + 7) // width + 1):
            shift = 8 * byte - j * width
            value = eights[:, :, j]
            out[:, :, byte] |= (value >> np.uint32(shift) if shift >= 0 else value << np.uint32(-shift)).astype(np.uint8)
    return out.reshape(rows, -1)[:, :(n * width + 7) // 8]


def unpacked_bits(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` values of each row; a value lies in ``reach`` bytes from its first bit's on."""
    if not width:
        return np.zeros((len(rows), n), np.uint32)
    bits = np.arange(n) * width
    reach = (width + 14) // 8
    kind = np.uint32 if reach <= 4 else np.uint64
    held, out = np.pad(rows, ((0, 0), (0, reach))), np.zeros((len(rows), n), kind)
    for byte in range(reach):
        out |= np.take(held, (bits >> 3) + byte, axis=1).astype(kind) << kind(8 * byte)
    return ((out >> (bits & 7).astype(kind)) & kind((1 << width) - 1)).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS, percentile: int = PERCENTILE) -> list[bytes]:
    """The ids' blocks of ``block`` ids, the last with what is left."""
    ids = ids.astype("<u4")
    full = len(ids) // block
    out = _encode_rows(ids[:full * block].reshape(full, block), percentile) if full else []
    return out + _encode_rows(ids[full * block:].reshape(1, -1), percentile) if len(ids) > full * block else out


def _encode_rows(rows: np.ndarray, percentile: int) -> list[bytes]:
    n = rows.shape[1]
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    at = max(0, -(-n * percentile // 100) - 1)
    width = widths(np.partition(rest, at, axis=1)[:, at])
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    head = np.zeros(len(rows), BLOCK)
    head["least"], head["width"], head["patches"] = least, width, over.sum(axis=1)
    low = np.where(over, 0, rest)
    row, place = np.nonzero(over)
    places, values = place.astype("<u4").tobytes(), rest[over].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(row, minlength=len(rows)))).tolist()
    heads, size, out = head.tobytes(), BLOCK.itemsize, [b""] * len(rows)
    for w in np.unique(width).tolist():
        these = np.flatnonzero(width == w)
        for part in np.array_split(these, len(these) // 2048 + 1):
            bits = packed_bits(low[part], w)
            raw, step = bits.tobytes(), bits.shape[1]
            for k, i in enumerate(part.tolist()):
                s, e = ends[i - 1] if i else 0, ends[i]
                out[i] = heads[size * i:size * (i + 1)] + raw[step * k:step * (k + 1)] + places[s:e] + values[s:e]
    return out


def numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The little-endian u32 at each byte number of ``at``."""
    return data[at[:, None] + np.arange(4)].view("<u4")[:, 0]


def decode_blocks(raw: bytes, starts: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` ids of consecutive blocks of ``raw`` that begin at ``starts``, read together by width."""
    if not n:
        return np.zeros(0, "<u4")
    data = np.frombuffer(raw, np.uint8)
    head = data[starts[:, None] + np.arange(BLOCK.itemsize)].copy().view(BLOCK)[:, 0]
    counts = np.full(len(starts), block)
    counts[-1] = n - block * (len(starts) - 1)
    out = np.empty(n, "<u4")
    width = head["width"].astype(np.int64)
    bodies = starts + BLOCK.itemsize
    for w, c in {(int(w), int(c)) for w, c in zip(width, counts)}:
        these = np.flatnonzero((width == w) & (counts == c))
        size = (c * w + 7) // 8
        for part in np.array_split(these, len(these) // 2048 + 1):
            values = unpacked_bits(data[bodies[part][:, None] + np.arange(size)], w, c) + head["least"][part][:, None]
            out[(part * block)[:, None] + np.arange(c)] = values
    patches = head["patches"].astype(np.int64)
    of = np.repeat(np.arange(len(starts)), patches)                 # the block of each exception
    at = (bodies + (counts * width + 7) // 8)[of] + 4 * (np.arange(len(of)) - (np.cumsum(patches) - patches)[of])
    out[of * block + numbers(data, at)] = numbers(data, at + 4 * patches[of]) + head["least"][of]
    return out


def segment(names: list[str | None], counts: list[int], ids: np.ndarray, number: int, before: int,
            block: int = BLOCK_IDS, percentile: int = PERCENTILE) -> bytes:
    """A segment without its end mark."""
    raw = [b"" if x is None else x.encode() for x in names]
    blocks = encode_blocks(ids, block, percentile)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    text = b"".join(raw)
    body = b"".join([np.array(counts, "<u8").tobytes(), np.array([-1 if x is None else len(r) for x, r in zip(names, raw)], "<i4").tobytes(),
                     text, index.tobytes(), *blocks])
    return HEAD.pack(MAGIC, block, number, before, len(names), len(ids), len(blocks), len(text), int(index[-1]), zlib.crc32(body)) + body


def read_segments(raw: bytes) -> Iterator[tuple[int, int, list[str | None], np.ndarray, np.ndarray]]:
    """(range number, ids before, names, numbers of ids, ids) of every segment of a file."""
    at, closing = 0, CLOSING.encode()
    while at < len(raw):
        magic, block, number, before, docs, n, blocks, text, size, check = HEAD.unpack_from(raw, at)
        start = at + HEAD.size
        end = start + 12 * docs + text + 8 * (blocks + 1) + size
        if magic != MAGIC or raw[end:end + len(closing)] != closing or zlib.crc32(memoryview(raw)[start:end]) != check:
            raise ValueError(f"damaged segment at byte {at}")
        counts = np.frombuffer(raw, "<u8", docs, start).astype(np.int64)
        lengths = np.frombuffer(raw, "<i4", docs, start + 8 * docs)
        stops = np.cumsum(np.maximum(lengths, 0))
        names = raw[start + 12 * docs:start + 12 * docs + text]
        index = np.frombuffer(raw, "<u8", blocks + 1, start + 12 * docs + text).astype(np.int64)
        first = end - size
        yield (number, before, [None if k < 0 else names[e - k:e].decode() for k, e in zip(lengths.tolist(), stops.tolist())],
               counts, decode_blocks(raw, index[:-1] + first, n, block))
        at = end + len(closing)


def _writer(path: str, end_id: int, block: int, percentile: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, number, before = of_worker(path, False), TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0

        def made():
            nonlocal names, counts, ids, held, before
            out = segment(names, counts, np.concatenate(ids), number, before, block, percentile)
            names, counts, ids, before, held = [], [], [], before + held, 0
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["segment"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                flat, ends = bpe.encode(texts)
                for k, doc in enumerate(np.split(flat, ends[:-1])):
                    names.append(own[at + k])
                    counts.append(len(doc) + 1)
                    ids += [doc, np.array([end_id], "<u4")]
                    held += len(doc) + 1
                    if held >= segment_ids:
                        yield made()
        if names:
            yield made()
    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = END_ID, block: int = BLOCK_IDS, percentile: int = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the documents' token files to the folder ``path``, ids ascending."""
    import public_tokenizers

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("id", "text", *[k.alias(f"k{i}") for i, k in enumerate(keys[1:], 1)])
    ranged = keyed.repartitionByRange(keys[0], "k1", "k2").sortWithinPartitions(keys[0], "k1", "k2")
    (ranged.select(F.col("id").cast("string").alias("id"), "text")
     .mapInArrow(_writer(vocabulary or public_tokenizers.path(VOCABULARY), end_id, block, percentile, segment_ids), "segment binary")
     .select(F.col("segment").cast("string").alias("value"))          # the cast keeps the bytes as they are
     .write.option("lineSep", CLOSING).option("maxRecordsPerFile", FILE_SEGMENTS).text(path))


def _reader(of: Callable[[np.ndarray], object], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for number, before, names, counts, ids in read_segments(raw.as_py()):
                    ends = np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.string()), pa.array(np.full(len(names), number), pa.int64()),
                        pa.array(before + ends - counts), pa.array(counts),
                        pa.array([of(x) for x in np.split(ids, ends[:-1])], kind)], ["id", "range", "place", "n_tokens", "value"])
    return run


def _read(spark: SparkSession, path: str, of, kind: pa.DataType, sql: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(of, kind), f"id string, range long, place long, n_tokens long, value {sql}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, range, place in the range, n_tokens, tokens) of every document in the folder's files; a
    range's documents are in ascending order of place, and ranges ascend too."""
    return _read(spark, path, lambda ids: ids.astype(np.int64), pa.list_(pa.int64()), "array<long>").withColumnRenamed("value", "tokens")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "long").withColumnRenamed("value", "ids_crc32")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (written, one per document) with ``start``, the ids of all documents before."""
    ends = rows.groupBy("range").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n"))
    ends = ends.withColumn("lot", F.floor(F.col("range") / RANGES_TOGETHER))
    lots = ends.groupBy("lot").agg(F.sum("n").alias("n"))
    until = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)       # a row per thousand ranges
    lots = lots.select("lot", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("lot_start"))
    inside = Window.partitionBy("lot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("range_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(lots, "lot")
    return rows.join(ends.select("range", (F.col("lot_start") + F.col("range_start")).alias("first")), "range").withColumn("start", F.col("first") + F.col("place"))


def digest(docs: DataFrame) -> DataFrame:
    """Documents written to token files in the shared folder and read back."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    rows = write_table(read_checksums(spark, path), "token-rows")
    return with_starts(rows).select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "n_tokens", "ids_crc32")
