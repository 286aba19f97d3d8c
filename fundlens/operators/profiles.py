"""Counts, moments, distinct values and exact order statistics of many numeric columns at once.

A task packs its rows into runs: of ``RUN_ROWS`` rows, each column's sorted distinct values and how
often each occurs, as bytes in segments of ``SEGMENT`` values. The runs are written once, with their
counts and moments and a few of their values (chosen by a seed; they only place the cuts). Cuts part
every column's range into buckets of about ``BUCKET`` packed values; equal values share a bucket. One
scan counts the values of every bucket, which tells the bucket of each wanted rank and the rank within
it. One shuffle then brings a bucket's pieces together, and each is merged on its own: distinct values
add up over the buckets, and the ranks are read off. So a value is sorted once and moved once, as eight
bytes; a value that fills a column is one packed value a run; the driver holds a row per run and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, scratch_path, ship_package

RUN_ROWS = 1 << 19
SEGMENT = 1 << 13
BUCKET = 1 << 20
SAMPLES = 128                                    # values a bucket's length of a run gives for the cuts
GROUP_BYTES, BATCH_BYTES = 16 << 20, 16 << 20    # of segments, in a row group and on the way to a worker

# n and the columns up to sample are of the whole run, in the first segment of a column
_RUNS = ("column int, n long, nulls long, nans long, total double, squares double, lo double, hi double, packed long, "
         "sample binary, values binary, counts binary")
_PIECES = "bucket int, values binary, counts binary"
_COUNTS = "bucket int, n long"
_MERGED = "bucket int, uniques long, rank long, value double"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                                      [name for name, _ in fields])


def _distinct(v: np.ndarray) -> np.ndarray:
    """The place of the first of each value in sorted ``v`` (0.0 and -0.0 are one value)."""
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)


def _segments(column: int, of: pa.ChunkedArray, rng, segment: int, every: int) -> Iterator[tuple]:
    v = of.drop_null().to_numpy()
    n = len(v)
    with np.errstate(all="ignore"):              # infinite values make a NaN of squares, as in stddev_samp
        total = float(v.sum()) if n else None
        squares = float(((v - total / n) ** 2).sum()) if n else None
    real = np.sort(v[~np.isnan(v)])
    first = _distinct(real)
    values, counts = real[first], np.diff(np.append(first, len(real))).astype(np.int32)
    k = -(-len(values) // every)
    sample = values[((np.arange(k) + rng.random(k)) * (len(values) / max(k, 1))).astype(np.int64)]
    lo, hi = (float(values[0]), float(values[-1])) if len(values) else (None, None)
    head = (n, of.null_count, n - len(real), total, squares, lo, hi, len(values), sample.tobytes())
    for s in range(0, max(len(values), 1), segment):
        c = counts[s:s + segment]
        yield (column, *head, values[s:s + segment].tobytes(), c.tobytes() if (c != 1).any() else None)
        head = (None,) * len(head)


def _pack(run_rows: int, segment: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng, held, rows = np.random.default_rng(TaskContext.get().partitionId()), [], 0

        def packed():
            table = pa.Table.from_batches(held)
            for i in range(table.num_columns):
                yield _batch(_RUNS, [*_segments(i, table.column(i), rng, segment, every)])
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= run_rows:
                yield from packed()
                held, rows = [], 0
        if rows:
            yield from packed()
    return run


def _opened(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]):
    """Per segment: its column, values, counts (None: each once) and where the column's buckets begin and end."""
    for batch in batches:
        for row in range(batch.num_rows):
            column, values, counts = (batch.column(i)[row] for i in range(3))
            v = np.frombuffer(values.as_buffer(), np.float64)
            c = np.frombuffer(counts.as_buffer(), np.int32) if counts.is_valid else None
            column = column.as_py()
            yield column, v, c, np.concatenate([[0], np.searchsorted(v, cuts[column], "left"), [len(v)]])


def _count(cuts: list[np.ndarray], start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(start[-1], np.int64)
        for column, _, counts, at in _opened(batches, cuts):
            upto = at if counts is None else np.append(0, np.cumsum(counts, dtype=np.int64))[at]
            n[start[column]:start[column + 1]] += np.diff(upto)
        yield _batch(_COUNTS, [(int(b), int(n[b])) for b in np.flatnonzero(n)])
    return run


def _split(cuts: list[np.ndarray], start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, values, counts, at in _opened(batches, cuts):
            rows = []
            for j in np.flatnonzero(np.diff(at)):
                a, b = at[j], at[j + 1]
                rows.append((int(start[column] + j), values[a:b].tobytes(), None if counts is None else counts[a:b].tobytes()))
            yield _batch(_PIECES, rows)
    return run


def _merge(ranks: dict[int, list[int]]):
    """The distinct values of a bucket, and the values at the ranks (from 0, repeats counted) asked of it."""
    def run(key: tuple, piece: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [np.frombuffer(x.as_buffer(), np.float64) for x in piece["values"]]
        v = np.concatenate(parts)
        rows = []
        if bucket in ranks:
            counts = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.ones(len(p), np.int32)
                      for x, p in zip(piece["counts"], parts, strict=True)]
            order = np.argsort(v, kind="stable")
            v, upto = v[order], np.cumsum(np.concatenate(counts)[order], dtype=np.int64)
            rows = [(bucket, None, r, float(v[np.searchsorted(upto, r, "right")])) for r in ranks[bucket]]
        else:
            v.sort()
        return pa.Table.from_batches([_batch(_MERGED, [(bucket, len(_distinct(v)), None, None), *rows])])
    return run


def _cuts(sample: np.ndarray, packed: int, bucket: int) -> np.ndarray:
    """Values that part a column into buckets of about ``bucket`` packed values (the first of each but the first)."""
    parts = -(-packed // bucket)
    if parts < 2:
        return np.zeros(0)
    return np.unique(np.sort(sample)[np.arange(1, parts) * len(sample) // parts])


def column_profiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], run_rows: int = RUN_ROWS,
                    segment: int = SEGMENT, bucket: int = BUCKET) -> list[dict]:
    """Per column, values taken as doubles: ``rows``, ``n`` (not NULL), ``mean``, ``std`` (ddof 1; NULL for one
    value or an infinite one), ``min`` and ``max`` (NaN above all), ``unique`` (a NaN is a value) and ``quantiles``
    (linear between neighbours, NaN left out). What has no value is None."""
    if not cols:
        return []
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "runs")
    every = max(1, bucket // SAMPLES)
    (df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
       .mapInArrow(_pack(run_rows, segment, every), _RUNS)
       .write.option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(path))
    written = spark.read.schema(_RUNS).parquet(path)
    runs: list[list] = [[] for _ in cols]
    for r in written.where("n IS NOT NULL").drop("values", "counts").collect():     # a row per run and column
        runs[r["column"]].append(r)

    cuts = [_cuts(np.concatenate([np.zeros(0), *(np.frombuffer(r["sample"], np.float64) for r in of)]),
                  sum(r["packed"] for r in of), bucket) for of in runs]
    start = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    segments = written.select("column", "values", "counts")
    sizes = np.zeros(start[-1], np.int64)
    with arrow_batches(spark, BATCH_BYTES):
        counted = segments.mapInArrow(_count(cuts, start), _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for r in counted:
        sizes[r["bucket"]] = r["n"]
    places = [_places(sizes[start[i]:start[i + 1]], probs) for i in range(len(cols))]
    ranks: dict[int, list[int]] = {}
    for i, at in enumerate(places):
        for b, rank in {x for *two, _ in at for x in two}:
            ranks.setdefault(int(start[i] + b), []).append(rank)

    tasks = max(spark.sparkContext.defaultParallelism, int(start[-1]) // 4)         # a handful of buckets each
    with arrow_batches(spark, BATCH_BYTES):
        merged = (segments.mapInArrow(_split(cuts, start), _PIECES).repartition(tasks, "bucket")
                  .groupBy("bucket").applyInArrow(_merge(ranks), _MERGED).collect())    # a row per bucket and rank
    unique = np.zeros(start[-1], np.int64)
    value = {}
    for r in merged:
        if r["rank"] is None:
            unique[r["bucket"]] = r["uniques"]
        else:
            value[(r["bucket"], r["rank"])] = r["value"]
    out = []
    for i, of in enumerate(runs):
        q = [_between(value[(start[i] + a[0], a[1])], value[(start[i] + b[0], b[1])], frac) for a, b, frac in places[i]]
        nans = sum(r["nans"] for r in of)
        out.append(_moments(of) | {"unique": int(unique[start[i]:start[i + 1]].sum()) + (nans > 0), "quantiles": q or [None] * len(probs)})
    return out


def _places(sizes: np.ndarray, probs: Sequence[float]) -> list[tuple]:
    """Per probability: bucket and rank within it of the values below and above, and how far between them."""
    upto = np.cumsum(sizes)
    n = int(upto[-1])

    def place(rank):
        b = int(np.searchsorted(upto, rank, "right"))
        return b, int(rank - (upto[b] - sizes[b]))
    out = []
    for h in ((n - 1) * p for p in probs) if n else ():
        below = math.floor(h)
        frac = h - below
        out.append((place(below), place(below + 1 if frac > 0 and below + 1 < n else below), frac))
    return out


def _between(a: float, b: float, frac: float) -> float:
    return a + (b - a) * frac if a != b else a


def _moments(runs: list) -> dict:
    n, nans = sum(r["n"] for r in runs), sum(r["nans"] for r in runs)
    filled = [r for r in runs if r["n"]]
    size, total, squares = (np.array([r[c] for r in filled], float) for c in ("n", "total", "squares"))
    std = mean = None
    if n:
        with np.errstate(all="ignore"):
            mean = float(total.sum() / n)
            spread = float((squares + size * (total / size - mean) ** 2).sum())
        std = math.sqrt(spread / (n - 1)) if n > 1 and not math.isnan(spread) else None
    lows, highs = ([r[c] for r in filled if r[c] is not None] for c in ("lo", "hi"))
    return {"rows": n + sum(r["nulls"] for r in runs), "n": n, "mean": mean, "std": std,
            "min": min(lows) if lows else math.nan if nans else None, "max": math.nan if nans else max(highs) if highs else None}
