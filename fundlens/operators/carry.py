"""Last known value carried along an order, without a window over the order (V9).

The rows are range-partitioned and sorted by the order. Each task fills its own range in one pass; a
row before the first known value of its range stays open. The last value of every range is a row of a
small table, an exclusive prefix over the ranges gives each range what it begins with, and the open
rows take it. So one file, or the whole table, may be one sequence: no task holds more than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import ship_package, write_table


def _fill(column: int, group: int, names: list[str]):
    """Adds the number of the range, of the row in it, and whether the row's group began in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, last, known, began = TaskContext.get().partitionId(), 0, None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = np.array(batch.column(group).to_pylist(), object)
            new = np.append(last is not None and groups[0] != last, groups[1:] != groups[:-1])
            if last is None or new[0]:
                known = None
            # the place of the last known value of the row's group in this batch, or -1
            valid = batch.column(column).is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(valid, np.arange(n), -1))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            at = np.where(at >= first, at, -1)
            filled = batch.column(column).take(pa.array(np.where(at >= 0, at, 0), mask=at < 0))
            head = (np.cumsum(new) == 0) & (at < 0)                  # the group of the batch before goes on
            if known is not None and head.any():
                filled = pa.concat_arrays([pa.array([known] * int(head.sum()), filled.type), filled.slice(int(head.sum()))])
            started = np.cumsum(new) > 0
            inside = pa.array(np.where(started | began, 1, 0))
            began, last = began or bool(started[-1]), groups[-1]
            known = filled[n - 1].as_py()
            columns = [filled if i == column else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part)), pa.array(np.arange(number, number + n)), inside], names)
            number += n
    return run


def carry(df: DataFrame, column: str, order_cols: Sequence[str], partition_cols: Sequence[str] = (), backward: bool = False) -> DataFrame:
    """``df`` with NULLs of ``column`` replaced by the last value before them (``backward``: the first
    after them) in the order of ``order_cols`` (NULL first) within ``partition_cols``. Rows that share
    their place in the order are taken by a hash of all columns."""
    ship_package(df.sparkSession)
    group = F.coalesce(F.to_json(F.struct(*partition_cols)), F.lit("")) if partition_cols else F.lit("")
    keyed = df.select(*df.columns, group.alias("_group"), F.xxhash64(*df.columns).alias("_tie"))
    keys = [F.col("_group"), *[F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order_cols],
            F.col("_tie").desc() if backward else F.col("_tie").asc()]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    schema = StructType([*ordered.schema.fields[:-1], StructField("_group", StringType()), *(StructField(c, LongType()) for c in ("_part", "_row", "_began"))])
    filled = write_table(ordered.mapInArrow(_fill(df.columns.index(column), len(df.columns), schema.names), schema), "carried")
    ends = filled.groupBy("_part").agg(F.max_by(F.struct("_group", F.col(column).alias("value")), "_row").alias("end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)       # a row per range
    starts = ends.select(F.col("_part").alias("_p"), F.last(F.when(F.col("end.value").isNotNull(), F.col("end")), ignorenulls=True).over(before).alias("_start"))
    open_ = F.col(column).isNull() & (F.col("_began") == 0) & (F.col("_group") == F.col("_start._group"))
    out = filled.join(F.broadcast(starts), F.col("_part") == F.col("_p"), "left")     # a row per task of the sort
    return out.withColumn(column, F.when(open_, F.col("_start.value")).otherwise(F.col(column))).select(*df.columns)
