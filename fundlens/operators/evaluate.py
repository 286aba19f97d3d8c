"""Cluster evaluation and stability.

Exact Euclidean silhouette is quadratic in the points; it is computed without emitting pairs:
points are cut into blocks of ``block_rows`` to ``LARGER`` times as many; every unordered pair of blocks
is one group, which returns, per point of either block, the distance sums to each cluster of the other.
Group size is bounded regardless of cluster skew; the output is points x blocks x clusters rows, summed
by a map-side-combined ``groupBy``. Labelings of the same points share their distances.

The 1-D Wasserstein distance is exact and distributed: pooled distinct values are range-partitioned
and scanned in order with prefix counts carried between partitions.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import ship_package, write_table

BLOCK_ROWS = 2048
LARGER = 8            # times ``block_rows``: the largest block, and the least number of larger blocks
RANGE_ROWS = 500_000  # values of a range of W1
SUMS_HELD = 1 << 22   # sums of a block pair (points x labels) that larger blocks may hold


def _as_array(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("_x", F.col(features).cast(ArrayType(DoubleType())))
    return df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))


TILE = (256, 2048)   # pairs whose distances are held at once
NEAR = 1e-3          # squared distances below this share of the squared norms come from differences


def _from_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((np.subtract.outer(a[:, j], b[:, j]) ** 2 for j in range(a.shape[1])), np.zeros((len(a), len(b))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of a tile by one product of matrices. Where this cancels (points that are close
    for their size, or of mixed scales) they come from the coordinates' own differences."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    square = np.column_stack([-2 * a, na, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), nb]).T
    i, j = np.nonzero(square <= np.add.outer(NEAR * na, NEAR * nb))
    if len(i) > square.size // 16:
        square = _from_differences(a, b)
    elif len(i):
        square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(square)


def _points(part: pa.Table):
    """(ids, coordinates, (row, labeling, label) of every label) of a block."""
    x, labels = part.column("_x").combine_chunks(), part.column("_labels").combine_chunks()
    if x.null_count:
        raise ValueError("a point has no coordinates")
    lists = np.repeat(np.arange(len(labels)), pc.list_value_length(labels).to_numpy(zero_copy_only=False))
    cfg, lab = (pc.struct_field(labels.flatten(), n).to_numpy(zero_copy_only=False) for n in ("cfg", "lab"))
    return part.column("_id").combine_chunks(), x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1), (lists, cfg, lab)


def _members(n: int, labels) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (labeling, label) pairs, and how often each row has which."""
    rows, cfg, lab = labels
    pairs, index = np.unique(np.stack([cfg, lab]), axis=1, return_inverse=True)
    member = np.zeros((n, pairs.shape[1]))
    np.add.at(member, (rows, index.ravel()), 1.0)
    return pairs, member


def _sum_rows(ids: pa.Array, own, pairs: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row per label of a point and label of the other side in the same labeling."""
    rows, cfg, _ = own
    parts = []
    for c in np.unique(cfg):
        mine, slots = rows[cfg == c], np.flatnonzero(pairs[0] == c)
        at = np.repeat(mine, len(slots))
        parts.append(pa.table({"_id": ids.take(pa.array(at)), "_cfg": pa.array(np.full(len(at), c, np.int32)), "_other": pa.array(np.tile(pairs[1][slots], len(mine))),
                               "_sum": pa.array(sums[np.ix_(mine, slots)].ravel()), "_cnt": pa.array(np.tile(counts[slots].astype(np.int64), len(mine)))}))
    return pa.concat_tables(parts)


def _pair_sums(key: tuple, group: pa.Table, by: Sequence[str]) -> pa.Table:
    """Both sides' sums of one block pair; side 2 marks a block paired with itself."""
    side = group.column("_side").to_numpy()
    itself = bool((side == 2).any())
    first, second = (group.filter(pa.array(side != other)) for other in (1, 0))
    if not first.num_rows or not second.num_rows:
        return _keyed(_KEYLESS.empty_table(), key, by)
    (ids_a, a, own_a), (ids_b, b, own_b) = _points(first), _points(second)
    centre = b.mean(0)
    a, b = a - centre, b - centre
    (pairs_a, member_a), (pairs_b, member_b) = _members(len(a), own_a), _members(len(b), own_b)
    sums_a, sums_b = np.zeros((len(a), pairs_b.shape[1])), np.zeros((len(b), pairs_a.shape[1]))
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            at, of = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            dist = _distances(a[at], b[of])
            sums_a[at] += dist @ member_b[of]
            if not itself:
                sums_b[of] += dist.T @ member_a[at]
    out = [_sum_rows(ids_a, own_a, pairs_b, sums_a, member_b.sum(0))]
    if not itself:
        out.append(_sum_rows(ids_b, own_b, pairs_a, sums_b, member_a.sum(0)))
    return _keyed(pa.concat_tables(out), key, by)


_KEYLESS = pa.schema([("_id", pa.string()), ("_cfg", pa.int32()), ("_other", pa.int64()), ("_sum", pa.float64()), ("_cnt", pa.int64())])


def _keyed(table: pa.Table, key: tuple, by: Sequence[str]) -> pa.Table:
    for i, c in enumerate(by):
        table = table.add_column(i, c, pa.array([key[i].as_py()] * table.num_rows, key[i].type))
    return table


def silhouette_samples(df: DataFrame, label_col: str, features: Sequence[str] | str, id_col: str,
                       by: Sequence[str] = (), block_rows: int = BLOCK_ROWS, labelings: Sequence[str] = ()) -> DataFrame:
    """M5 per point: s = (b - a) / max(a, b); 0 for a point alone in its cluster; NULL when the
    group has fewer than two clusters. ``by`` evaluates independent groups (e.g. datasets).

    ``labelings`` are those of ``by`` that tell labelings of the same points apart: rows that agree in
    id, coordinates and the rest of ``by`` are one point with several labels, whose distances are
    computed once."""
    by, labelings = list(by), list(labelings)
    space = [c for c in by if c not in labelings]
    spark = df.sparkSession
    ship_package(spark)
    pts = _as_array(df, features).select(*by, F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("long").alias("_lab"), "_x")
    pts = pts.where(F.col("_lab").isNotNull())
    if labelings:
        found = pts.select(*labelings).distinct().collect()           # a row per labeling
        names = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "_cfg int, " + ", ".join(f"`n{i}` {t}" for i, (_, t) in enumerate(_types(pts, labelings))))
        same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"n{i}")) for i, c in enumerate(labelings)])
        pts = pts.join(F.broadcast(names), same).drop(*[f"n{i}" for i in range(len(labelings))])
    else:
        pts = pts.withColumn("_cfg", F.lit(0))
    sizes = pts.groupBy(*space, "_cfg").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_lab").alias("g"))
    sizes = sizes.groupBy(*space).agg(F.max("n").alias("n"), F.sum("g").alias("g")).agg(F.max("n").alias("n"), F.max("g").alias("g")).first()
    n_max, slots = sizes["n"] or 0, sizes["g"] or 1
    # larger blocks once there are enough of them to share out: a point is sent to every block
    block = min(LARGER * block_rows, max(block_rows, SUMS_HELD // slots))
    nb = max(1, math.ceil(n_max / block), min(LARGER, math.ceil(n_max / block_rows)))
    label = F.struct(F.col("_cfg").alias("cfg"), F.col("_lab").alias("lab"))
    points = (pts.groupBy(*space, "_id", "_x").agg(F.collect_list(label).alias("_labels")) if labelings
              else pts.select(*space, "_id", "_x", F.array(label).alias("_labels")))
    points = points.withColumn("_blk", F.pmod(F.xxhash64(F.col("_id"), F.col("_x")), F.lit(nb)).cast("int"))
    # every unordered pair of blocks is one group: a point goes once to each pair its block is in
    own = F.col("_blk")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda o: F.struct(
        F.least(o, own).alias("i"), F.greatest(o, own).alias("j"),
        F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side")))).alias("_p")
    paired = points.select(*space, "_id", "_labels", "_x", pair).select(
        *space, "_id", "_labels", "_x", F.col("_p.i").alias("_bi"), F.col("_p.j").alias("_bj"), F.col("_p.side").alias("_side"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in _types(pts, space)),
                        "_id string", "_cfg int", "_other long", "_sum double", "_cnt long"])
    # a group costs many times its rows' bytes: as many tasks as groups, which are too small to be merged
    groups = nb * (nb + 1) // 2
    paired = paired.repartition(min(2000, max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))), *space, "_bi", "_bj")
    sums = paired.groupBy(*space, "_bi", "_bj").applyInArrow(lambda key, group: _pair_sums(key, group, space), schema=schema)
    per = sums.groupBy(*space, "_id", "_cfg", "_other").agg(F.sum("_sum").alias("_s"), F.sum("_cnt").alias("_c"))
    own = pts.select(*by, "_cfg", "_id", "_lab")
    stats = per.join(own, on=[*space, "_cfg", "_id"]).groupBy(*by, "_id", "_lab").agg(
        F.max(F.when(F.col("_other") == F.col("_lab"), F.col("_s"))).alias("_own_sum"),
        F.max(F.when(F.col("_other") == F.col("_lab"), F.col("_c"))).alias("_own_n"),
        F.min(F.when(F.col("_other") != F.col("_lab"), F.col("_s") / F.col("_c"))).alias("_b"))
    ncl = pts.groupBy(*by).agg(F.countDistinct("_lab").alias("_groups"))
    if by:
        stats = stats.join(ncl, on=by)
    else:
        stats = stats.withColumn("_groups", F.lit(ncl.first()[0]))
    a = F.col("_own_sum") / (F.col("_own_n") - 1)
    s = (F.when(F.col("_groups") < 2, F.lit(None).cast("double"))
         .when(F.col("_own_n") <= 1, F.lit(0.0))
         .when(F.greatest(a, F.col("_b")) > 0, (F.col("_b") - a) / F.greatest(a, F.col("_b")))
         .otherwise(F.lit(0.0)))  # all distances 0: the point is on the border
    return stats.select(*by, F.col("_id").alias(id_col), F.col("_lab").alias(label_col), s.alias("silhouette"))


def _types(df: DataFrame, cols: Sequence[str]):
    t = dict(df.dtypes)
    return [(c, t[c]) for c in cols]


def silhouette(df: DataFrame, label_col: str, features: Sequence[str] | str, id_col: str,
               by: Sequence[str] = (), block_rows: int = BLOCK_ROWS, method: str = "exact", labelings: Sequence[str] = ()) -> DataFrame:
    """M5: mean silhouette per ``by`` group (one row without ``by``; ``labelings`` as above). ``method="squared"`` uses the
    O(n) squared-Euclidean ``ClusteringEvaluator`` (a different metric, for very large n)."""
    by = list(by)
    if method == "squared":
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.feature import VectorAssembler

        if not isinstance(features, str):
            df = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
            vcol = "_v"
        else:
            from pyspark.ml.functions import array_to_vector

            df, vcol = df.withColumn("_v", array_to_vector(features)), "_v"
        ev = ClusteringEvaluator(featuresCol=vcol, predictionCol=label_col)
        if by:
            raise ValueError("method='squared' evaluates one group; filter per group")
        return df.sparkSession.createDataFrame([(float(ev.evaluate(df)),)], "silhouette_score double")
    s = silhouette_samples(df, label_col, features, id_col, by, block_rows, labelings)
    return s.groupBy(*by).agg(F.avg("silhouette").alias("silhouette_score"))


def calinski_harabasz(df: DataFrame, label_col: str, features: Sequence[str] | str,
                      by: Sequence[str] = ()) -> DataFrame:
    """M6: between / within dispersion ratio, each over its degrees of freedom; NULL (the reference
    gives -inf) with fewer than two clusters. Two passes: centroids, then squared deviations."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by = list(by)
    x = _as_array(df, features).where(F.col(label_col).isNotNull()).select(*by, F.col(label_col).alias("_l"), "_x")
    # one row per label; vectors are summed map-side, so a hot label is no hot key
    cent = write_table(x.groupBy(*by, "_l").agg(
        vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("_ck"), F.count(F.lit(1)).alias("_nk")), "centroids")
    square = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0),
                                      lambda t, d: t + d)
    centre = cent.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector("_ck"), F.col("_nk").cast("double"))).alias("_c"),
                                   F.sum("_nk").alias("_n"), F.count(F.lit(1)).alias("_k"))
    if by:
        between = cent.join(centre, by)
        within = x.join(cent, [*by, "_l"])
    else:
        between, within = cent.crossJoin(F.broadcast(centre)), x.join(cent, "_l")  # one-row side
    between = between.groupBy(*by).agg(F.sum(F.col("_nk") * square(F.col("_ck"), F.col("_c"))).alias("_b"),
                                       F.first("_n").alias("_n"), F.first("_k").alias("_k"))
    within = within.groupBy(*by).agg(F.sum(square(F.col("_x"), F.col("_ck"))).alias("_w"))
    j = between.join(within, by) if by else between.crossJoin(F.broadcast(within))
    ch = F.when((F.col("_k") < 2) | (F.col("_n") <= F.col("_k")), F.lit(None).cast("double")).otherwise(
        F.when(F.col("_w") == 0, F.lit(1.0)).otherwise(
            (F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))))
    return j.select(*by, ch.alias("calinski_harabasz"))


def evaluate_clusters(raw: DataFrame, transformed: DataFrame, look_features: Sequence[str],
                      key: str = "fund_cnpj", pred_col: str = "pred", by: Sequence[str] = ("dataset",),
                      block_rows: int = BLOCK_ROWS, labelings: Sequence[str] = ()) -> DataFrame:
    """M4: per (``by``, pred) the mean of the raw look features and the cluster size, plus the
    silhouette of each ``by`` group over the transformed features (NULL for a single cluster).

    ``transformed`` has the features as columns or as one array column. Several labelings are
    evaluated in one pass by stacking them with their names among ``by``."""
    by = list(by)
    means = raw.groupBy(*by, pred_col).agg(
        *[F.avg(c).alias(c) for c in look_features], F.count(F.lit(1)).alias("cluster_size"))
    t = transformed if pred_col in transformed.columns else \
        transformed.join(raw.select(key, *by, pred_col), [key, *by])
    tcols = [c for c in t.columns if c not in (key, *by, pred_col)]
    features = tcols[0] if len(tcols) == 1 and dict(t.dtypes)[tcols[0]].startswith("array") else tcols
    return means.join(silhouette(t, pred_col, features, key, by=by, block_rows=block_rows, labelings=labelings), by, "left")


# ------------------------------------------------------------------ M8: exact 1-D Wasserstein


def wasserstein_1d(u: DataFrame, v: DataFrame, value_col: str, by: Sequence[str] = (),
                   partitions: int | None = None) -> DataFrame:
    """M8: W1 between the empirical distributions of ``value_col`` in ``u`` and ``v`` per ``by``
    group: sum over consecutive pooled distinct values of |F_u - F_v| * gap. NULL for a group that one
    side lacks.

    Pooled values are range-partitioned, so a large group lies in many ranges. Each piece (a group in
    a range) is summed up by a row; prefix sums of these rows along a group give what a piece begins
    with, and running counts inside the piece do the rest. No window holds more than a piece."""
    by = list(by)
    spark = u.sparkSession
    side = lambda d, cu, cv: d.select(*by, F.col(value_col).cast("double").alias("_v"), F.lit(cu).alias("_cu"), F.lit(cv).alias("_cv"))
    # written, since the ranges' bounds take a pass of their own; their number follows the rows
    rows = write_table(side(u, 1, 0).unionByName(side(v, 0, 1)).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "w1-values")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    pooled = rows.groupBy(*by, "_v").agg(F.sum("_cu").alias("_cu"), F.sum("_cv").alias("_cv"))
    keys = by or ["_g"]
    pooled = pooled if by else pooled.withColumn("_g", F.lit("all"))
    pooled = pooled.withColumn("_k", F.to_json(F.struct(*keys)))
    ranged = write_table(pooled.repartitionByRange(n, "_k", "_v").select("_k", "_v", "_cu", "_cv", F.spark_partition_id().alias("_pid")), "w1-ranges")
    pieces = ranged.groupBy("_k", "_pid").agg(F.sum("_cu").alias("_su"), F.sum("_cv").alias("_sv"), F.min("_v").alias("_first"))
    along, group = Window.partitionBy("_k").orderBy("_pid"), Window.partitionBy("_k")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_k", "_pid", F.lead("_first").over(along).alias("_next"),
                           *[F.coalesce(F.sum(f"_s{x}").over(before), F.lit(0)).alias(f"_b{x}") for x in "uv"],
                           *[F.sum(f"_s{x}").over(group).alias(f"_t{x}") for x in "uv"])
    inside = Window.partitionBy("_k", "_pid").orderBy("_v")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ranges meet in as many tasks as there are: no task's sort grows with the rows
    rows = ranged.repartition(n, "_k", "_pid").select("_k", "_pid", "_v", F.lead("_v").over(inside).alias("_n"), *[F.sum(f"_c{x}").over(until).alias(f"_r{x}") for x in "uv"])
    share = lambda x: F.try_divide(F.col(f"_b{x}") + F.col(f"_r{x}"), F.col(f"_t{x}"))
    gap = F.coalesce("_n", "_next") - F.col("_v")
    w = rows.join(pieces, ["_k", "_pid"]).groupBy("_k").agg(
        F.sum(F.coalesce(F.abs(share("u") - share("v")) * gap, F.lit(0.0))).alias("_w"), F.min(F.least("_tu", "_tv")).alias("_both"))
    out = w.select(F.from_json("_k", ", ".join(f"`{c}` {t}" for c, t in _types(pooled, keys))).alias("_s"),
                   F.when(F.col("_both") > 0, F.col("_w")).alias("wasserstein")).select("_s.*", "wasserstein")
    return out if by else out.drop("_g")


# ------------------------------------------------------------------ M10-M12 on experiment results

CONFIG = ["model", "n_clusters", "preprocessing"]


def best_by_silhouette(results: DataFrame, dataset: str = "validation") -> DataFrame:
    """Rows of ``dataset`` whose silhouette equals the maximum (all ties kept)."""
    r = results.where(F.col("dataset") == dataset)
    top = r.agg(F.max("silhouette_score").alias("_m"))
    return r.join(F.broadcast(top), F.col("silhouette_score") == F.col("_m")).drop("_m")  # one-row side


def select_config(results: DataFrame, dataset: str = "validation") -> DataFrame:
    """Every row (all datasets) of the first best configuration (score desc, then config asc)."""
    best = (results.where(F.col("dataset") == dataset)
            .orderBy(F.col("silhouette_score").desc_nulls_last(), *[F.col(c).asc() for c in CONFIG])
            .limit(1).select(*CONFIG))
    return results.join(F.broadcast(best), CONFIG, "left_semi")  # one-row side


def stability_report(config_rows: DataFrame, metrics: Sequence[str], base: str = "train",
                     others: Sequence[str] = ("test", "validation")) -> DataFrame:
    """Per metric W1(base, other) for each other dataset, one row per metric."""
    # at most k rows per dataset by construction: one pooled pass, counts of every dataset side by
    # side, cumulated along the distinct values of a feature
    names = [base, *others]
    long = config_rows.select("dataset", F.explode(F.array(*[
        F.struct(F.lit(m).alias("feature"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    ).select("dataset", "_m.feature", "_m.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    pooled = long.groupBy("feature", "value").agg(*[F.count_if(F.col("dataset") == n).alias(f"c_{i}") for i, n in enumerate(names)])
    along = Window.partitionBy("feature").orderBy("value")
    all_of = Window.partitionBy("feature")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    share = [(F.sum(f"c_{i}").over(upto) / F.sum(f"c_{i}").over(all_of)).alias(f"f_{i}") for i in range(len(names))]
    steps = pooled.select("feature", (F.lead("value").over(along) - F.col("value")).alias("gap"), *share)
    return steps.groupBy("feature").agg(*[
        F.sum(F.coalesce(F.abs(F.col("f_0") - F.col(f"f_{i}")) * F.col("gap"), F.lit(0.0)))
        .alias(f"{base}_vs_{'val' if o == 'validation' else o}_dist") for i, o in enumerate(others, 1)])
