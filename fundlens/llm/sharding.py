"""Operator 1, sharding: a uniform shuffle with exact shard sizes by a hypergeometric
communication matrix.

The rows are written once with a row number, and cut into blocks of at most ``BLOCK_ROWS`` rows of
one input partition. For each block the matrix says how many of its rows every shard receives;
its rows are drawn one block after the other from the multivariate hypergeometric law, given what
room the shards have left, so that the shards end with sizes at most one apart and every
assignment of rows to shards is equally likely. Blocks are permuted locally, and each shard takes
its number of rows from the front of what remains. After the exchange the rows of a shard are
permuted again: a second hashed key deals them to chunks, counts of the chunks give every chunk's
offset, and a window over each chunk gives the slots.

Scale: the matrix has one row per block (a million input rows) and is the only thing the driver
sees, as counts. No window holds more than a block or a chunk, whatever key the rows share: rows
are dealt by position, not by key. Wide columns move once, in the join of the finished slots.
Built-in expressions only, apart from the driver's draw of the matrix.

Defined cases: nulls and repeated rows are rows like any others, each with its own slot; fewer
rows than shards leave shards empty; an empty table gives an empty result; columns of the input
keep their names, but for ``shard`` and ``slot``, which get an underscore in front.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import small_side
from .text import fresh, whole

BLOCK_ROWS = 1 << 20
CHUNK_ROWS = 1 << 19


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``, by inversion outwards from the mode:
    ratios of neighbouring probabilities need no large numbers, so any population is possible."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 40                               # beyond: less than 1e-25 of the mass
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weight = np.concatenate([fall[::-1], [1.0], rise])
    at = np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")
    return mode - len(fall) + int(min(at, len(weight) - 1))


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard: blocks in order draw from the room that is left."""
    rng, n = np.random.default_rng(seed), sum(blocks)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    rng.shuffle(room)
    out = []
    for size in blocks:
        row, rest, need = [], sum(room), size
        for s in range(shards):
            k = hypergeometric(rng, room[s], rest - room[s], need)
            rest, need = rest - room[s], need - k
            room[s] -= k
            row.append(k)
        out.append(row)
    return out


def assigned(rows: DataFrame, shards: int, seed: int, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` has one column ``r``: the row number (partition in the upper bits, position in the
    lower 33). Returns r, shard, slot."""
    spark = rows.sparkSession
    block = F.shiftrightunsigned("r", 33) * F.lit((1 << 33) // block_rows) + F.floor(
        F.col("r").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)
    rows = rows.withColumn("block", block.cast("long"))
    counts = {b: n for b, n in rows.groupBy("block").count().collect()}   # a row per million rows
    names = sorted(counts)
    matrix = communication_matrix([counts[b] for b in names], shards, seed)
    bounds = [(b, np.cumsum(m).tolist()) for b, m in zip(names, matrix)]
    deal = spark.createDataFrame(bounds, "b long, bound array<long>")
    # permute locally: the place within the block under a hashed key
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("r"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(key(1), "r"))
    local = rows.withColumn("place", place).join(small_side(deal), F.col("block") == F.col("b"))
    shard = F.size(F.filter("bound", lambda x: x < F.col("place")))
    # exchange, and permute again: chunks of a shard by the second key, slots within the chunk
    n_chunks = max(1, -(-sum(counts.values()) // (shards * chunk_rows)))
    second = key(2)
    # a chunk is a range of the second key, so chunks in order and keys in order agree
    chunk = F.floor((F.shiftrightunsigned(second, 11) / float(1 << 53)) * n_chunks).cast("int")
    sent = local.select("r", shard.cast("int").alias("shard"), second.alias("key"), chunk.alias("chunk"))
    sent = write_table(sent, "shards")
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sent.groupBy("shard", "chunk").count()
               .select(F.col("shard").alias("s"), F.col("chunk").alias("c"),
                       F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset")))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "r"))
    return (sent.withColumn("within", within)
            .join(small_side(write_table(offsets, "offsets")), (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
            .select("r", "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot")))


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 1, block_rows: int = BLOCK_ROWS,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0)."""
    for c in docs.columns:
        if c.lower() in ("shard", "slot"):
            docs = docs.withColumnRenamed(c, fresh(docs, "_" + c))
    r = fresh(docs, "_r")
    numbered = write_table(docs.withColumn(r, F.monotonically_increasing_id()), "rows")
    made = assigned(numbered.select(F.col(r).alias("r")), shards, seed, block_rows, chunk_rows)
    return numbered.join(made, F.col(r) == F.col("r")).drop(r, "r") if r != "r" else numbered.join(made, "r").drop("r")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 1) -> None:
    """The shuffled rows as Parquet, one folder per shard, rows in the order of their slots."""
    out = shuffle_to_shards(docs, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def digest(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    t = whole("text")
    narrow = docs.select("doc_id", F.when(F.col("text").isNull(), 1).otherwise(F.octet_length("text") + 1).cast("long").alias("size"),
                         crc32(t).alias("text_crc32"))
    out = shuffle_to_shards(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
