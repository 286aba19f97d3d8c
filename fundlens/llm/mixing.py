"""Operator 8, mixing sources to target weights: Pareto order sampling.

A document's expected number of copies is its cell's target over its cell's size (a cell: a source
and a grade within it). The whole part of that number is allocated outright. The fractional part
is an inclusion probability, unequal between cells, and decides in a fixed-size sample per source:
documents are ranked by the odds of a hashed random number over the odds of their inclusion, and
the ranking is cut where the source's remaining words are reached.

Scale: targets come from one map-side combined count per cell. The cut is found without sorting a
source, however many rows it holds: words per (source, slice of the ranking) are summed along 256
slices, then along the 256 parts of the slice that the cut falls into, and only the rows of one
part are ordered. A cut per
source then decides every row on its own, so no text is shuffled; only rows tied at a cut that takes
some of them are counted, equal ones together. Built-in expressions only.

Defined cases: a null text has size 0 and takes no words; null is a source of its own, the last
one; a null id is allowed; rows equal in id, source and text are tied, and where the cut falls
among tied rows the wanted fraction of them is taken by a hash of the row's position; an empty
table gives an empty mix; a source without words has target 0; further columns pass through.
Random numbers depend on seed, id and text only, so reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import small_side
from .text import fresh, pinned, whole, words

WEIGHTS, CEILING = (5, 2, 1), 3
BUCKET_BITS, KEY_BITS = (8, 16), 52
GRADES = "CASE WHEN size >= 50 THEN 2 ELSE 1 END"   # longer documents are preferred two to one


def water_fill(groups: DataFrame, whole_col: Column, weight: Column, cap: Column, within: list[str]) -> Column:
    """Level ``t`` per partition ``within``: ``least(cap, t * weight)`` adds up to ``whole_col``.
    Resharing the excess of capped groups by weight ends at this level. Groups are ordered by
    ``cap / weight``; with all earlier ones capped, the first that stays under its cap sets it."""
    part = Window.partitionBy(*within)
    order = part.orderBy(cap / weight, "grade", "source").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    level = (whole_col - before(cap)) / (F.sum(weight).over(part) - before(weight))
    mine = part.orderBy(cap / weight, "grade", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(F.when(level * weight <= cap, level), ignorenulls=True).over(mine)


def cells(base: DataFrame) -> DataFrame:
    """One row per (source, grade): sizes, the source's target and the cell's expected copies."""
    c = base.groupBy("source", "grade").agg(F.sum("size").alias("cell_size"))
    s = c.groupBy("source").agg(F.sum("cell_size").alias("source_size")).withColumn("grade", F.lit(0))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * CEILING).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("t", water_fill(s, F.col("all"), F.col("weight"), F.col("cap"), []))
    s = s.select(F.col("source").alias("s"), "source_size",
                 F.least(F.col("cap").cast("double"), F.col("t") * F.col("weight")).alias("target"))
    c = c.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    c = c.withColumn("weight", F.col("cell_size") * F.col("grade")).withColumn("cap", F.col("cell_size") * CEILING)
    filled = c.where("cell_size > 0")
    filled = filled.withColumn("t", water_fill(filled, F.col("target"), F.col("weight"), F.col("cap"), ["source"]))
    rate = F.least(F.lit(float(CEILING)), F.coalesce(F.col("t"), F.lit(float(CEILING))) * F.col("grade"))
    filled = filled.withColumn("rate", rate)
    out = filled.unionByName(c.where("cell_size = 0").withColumn("t", F.lit(0.0)).withColumn("rate", F.lit(0.0)))
    out = out.withColumn("copies", F.floor("rate").cast("long")).withColumn("share", F.col("rate") - F.floor("rate"))
    every = Window.partitionBy("source")
    largest = Window.partitionBy("source").orderBy(F.col("cell_size").desc(), "grade").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    odds = F.when(F.col("share") > 0, F.col("share") / (1 - F.col("share")))
    return (out.withColumn("odds", odds)
            .withColumn("ref", F.first(F.col("odds"), ignorenulls=True).over(largest))
            .withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("copies") * F.col("cell_size")).over(every)))
            .select("source", "grade", "source_size", "target", "copies", "left", (F.col("ref") / F.col("odds")).alias("pull")))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, grades: str) -> DataFrame:
    """id, source, size, grade, tie (id and text as one string) and the hashed number ``u``."""
    t = whole(F.col(f"`{text_col}`"))
    tie = F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(t))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                      F.size(words(t)).cast("long").alias("size"), tie.alias("tie"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tie"))), 1, 13), 16, 10).cast("double")
    return out.withColumn("u", (u + 0.5) / float(1 << KEY_BITS)).withColumn("grade", F.expr(grades))


def ranked(rows: DataFrame, by_cell: DataFrame) -> DataFrame:
    """Rows with their cell's numbers and ``key``, the random odds over the inclusion odds as an
    integer of 52 bits (relative to the source's largest cell, which spreads keys evenly)."""
    c = by_cell.select(*[F.col(x).alias(f"c_{x}") for x in by_cell.columns])
    out = rows.join(small_side(c), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("grade") == F.col("c_grade")))
    y = F.col("u") / (1 - F.col("u")) * F.col("c_pull")
    key = F.least(F.floor(y / (1 + y) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long")
    return out.withColumn("key", key).withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS[-1]))


def cuts(base: DataFrame, by_cell: DataFrame) -> DataFrame:
    """Per source: the bucket of the cut, the last taken (key, tie) in it and the share of the rows
    tied there to take."""
    rows = ranked(base, by_cell).where("c_pull IS NOT NULL")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    b = None
    for bits in BUCKET_BITS:                               # the cut's slice, then its slice within that
        inside = rows.withColumn("start", F.lit(0)) if b is None else rows.join(
            small_side(b), F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("key", KEY_BITS - outer) == F.col("b_bucket"))
        ).withColumn("start", F.col("before"))
        g = (inside.withColumn("slice", F.shiftright("key", KEY_BITS - bits)).groupBy("source", "slice")
             .agg(F.sum("size").alias("w"), F.first("c_left").alias("left"), F.first("start").alias("start"))
             .withColumn("before", F.col("start") + F.coalesce(F.sum("w").over(upto), F.lit(0)))
             .where("before <= left AND left < before + w")
             .select(F.col("source").alias("b_source"), F.col("slice").alias("b_bucket"), "before", "left"))
        b, outer = write_table(g, "mixcuts"), bits
    tied = (rows.join(small_side(b), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
            .groupBy("source", "bucket", "key", "tie").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"),
                                                           F.first("size").alias("one"), F.first("before").alias("before"),
                                                           F.first("left").alias("left")))
    run = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("w").over(run), F.lit(0))
    room = F.when(F.col("one") > 0, F.floor((F.col("left") - F.col("at")) / F.col("one") + 0.5)).otherwise(F.col("n"))
    taken = tied.withColumn("at", at).withColumn("k", F.least(F.col("n").cast("double"), room.cast("double"))).where("k > 0")
    last = taken.groupBy("source").agg(F.max(F.struct("key", "tie", F.col("k").cast("long").alias("k"), "n")).alias("z"))
    return (b.join(last, F.col("b_source").eqNullSafe(F.col("source")), "left")
            .select(F.col("b_source"), F.col("b_bucket"), F.col("z.key").alias("z_key"), F.col("z.tie").alias("z_tie"),
                    F.col("z.k").alias("z_k"), F.col("z.n").alias("z_n")))


def mixed(rows: DataFrame, by_cell: DataFrame, cut: DataFrame) -> DataFrame:
    """Every row of ``rows`` with its number of copies: decided on its own, but for rows tied at a cut
    that takes only some of them."""
    r = ranked(rows, by_cell).join(small_side(cut), F.col("source").eqNullSafe(F.col("b_source")), "left")
    here = F.struct("key", "tie")
    edge = F.struct(F.col("z_key"), F.col("z_tie"))
    extra = (F.when(F.col("c_pull").isNull() | F.col("b_bucket").isNull(), 0)
             .when(F.col("bucket") < F.col("b_bucket"), 1).when(F.col("bucket") > F.col("b_bucket"), 0)
             .when(F.col("z_key").isNull(), 0).when(here <= edge, 1).otherwise(0))
    out = r.withColumn("n_copies", F.col("c_copies") + extra)
    if not cut.where("z_k < z_n").limit(1).count():
        return out
    tied = F.coalesce((here == edge) & (F.col("z_k") < F.col("z_n")) & F.col("c_pull").isNotNull(), F.lit(False))
    return out.where(~tied).unionByName(first_of_tied(out.where(tied).drop("n_copies")).withColumn("n_copies", F.col("c_copies") + F.col("first")).drop("first"))


def first_of_tied(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``, 1 for ``z_k`` of each source's rows in the order of a hash of all their
    columns, else 0. Rows equal in all columns cannot be told apart, so they are counted and divided
    by number; whatever the partitioning, the same table results. Sums by the hash's first bits keep
    any window small."""
    h, lot = F.xxhash64(*rows.columns), 12
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")).withColumn("h", h).withColumn("lot", F.shiftright("h", 64 - lot))
    equal = write_table(equal, "mixties")
    order = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    lots = equal.groupBy("source", "lot").agg(F.sum("m").alias("n")).withColumn("lot_start", F.coalesce(F.sum("n").over(order("lot")), F.lit(0)))
    lots = lots.select(F.col("source").alias("l_source"), F.col("lot").alias("l_lot"), "lot_start")
    inside = equal.withColumn("before", F.coalesce(F.sum("m").over(order("lot", "h")), F.lit(0)))
    placed = inside.join(lots, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("lot") == F.col("l_lot")))
    take = F.greatest(F.lit(0), F.least(F.col("m"), F.col("z_k") - F.col("lot_start") - F.col("before")))
    parts = F.explode(F.array(F.struct(F.lit(1).alias("first"), take.alias("n")), F.struct(F.lit(0).alias("first"), (F.col("m") - take).alias("n")))).alias("p")
    # as many rows as were counted, a thousand to a step, dealt over the tasks
    steps = placed.select(*rows.columns, parts).where("p.n > 0").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("p.n") - 1) / 1000))))
    dealt = steps.repartition(F.xxhash64("step", "tie"))
    again = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(1000).cast("long"), F.col("p.n") - F.col("step") * 1000).cast("int")))
    return dealt.select(*rows.columns, F.col("p.first").alias("first"), again.alias("again")).drop("again")


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 8, grades: str = GRADES):
    """(narrow rows, cells, cuts), each written once to the shared folder."""
    base = write_table(sized(docs, id_col, text_col, source_col, seed, grades), "mixrows")
    by_cell = write_table(cells(base), "mixcells")
    return base, by_cell, write_table(cuts(base, by_cell), "mixcut")


def digest(docs: DataFrame, seed: int = 8) -> DataFrame:
    base, by_cell, cut = plan(docs, seed=seed)
    return mixed(base, by_cell, cut).select(
        "doc_id", "size", F.col("c_source_size").alias("source_size"), F.col("c_target").alias("target"),
        (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 8, grades: str = GRADES) -> DataFrame:
    """The mix itself: ``docs``' columns, a row for each copy taken."""
    _, by_cell, cut = plan(docs, id_col, text_col, source_col, seed, grades)
    row = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns)])
    tagged = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"),
                         F.col(f"`{source_col}`").alias("src"))
    rows = sized_keeping(tagged, seed, grades)
    out = mixed(rows, by_cell, cut).where("n_copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"))
    return out.select(*[F.col("row")[f"f{i}"].alias(c) for i, c in enumerate(docs.columns)])


def sized_keeping(tagged: DataFrame, seed: int, grades: str) -> DataFrame:
    """``sized`` for rows that carry their whole record in ``row``."""
    t = whole("t")
    tie = F.concat_ws(":", F.coalesce(F.col("i").cast("string"), F.lit("")), F.md5(t))
    out = pinned(tagged, ["row"], source=F.col("src"), size=F.size(words(t)).cast("long"), tie=tie)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tie"))), 1, 13), 16, 10).cast("double")
    return out.withColumn("u", (u + 0.5) / float(1 << KEY_BITS)).withColumn("grade", F.expr(grades))


def oracle(seed: int = 8) -> str:
    """DuckDB SQL for ``digest``: the same hashed numbers, the ranking by one window per source."""
    w = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} " + " ".join(
        f"WHEN {i} THEN {x}" for i, x in enumerate(WEIGHTS)) + " END"
    order = "ORDER BY cap::DOUBLE / weight, grade, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    full = "ORDER BY cap::DOUBLE / weight, grade, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    k52 = f"{float(1 << KEY_BITS)!r}"
    return f"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                  lambda x: x <> ''))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS tie
           FROM documents),
r AS (SELECT *, {GRADES} AS grade, (('0x' || substr(md5('{seed}:' || tie), 1, 13))::BIGINT::DOUBLE + 0.5) / {k52} AS u FROM d),
c0 AS (SELECT source, grade, sum(size)::BIGINT AS cell_size FROM r GROUP BY ALL),
s0 AS (SELECT source, 0 AS grade, sum(cell_size)::BIGINT AS source_size, ({w})::BIGINT AS weight FROM c0 GROUP BY source),
s1 AS (SELECT *, source_size * {CEILING} AS cap, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER ({order}), 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER ({order}), 0))::DOUBLE AS lv FROM s1),
s AS (SELECT source, source_size, least(cap::DOUBLE, weight * first(CASE WHEN lv * weight <= cap THEN lv END IGNORE NULLS)
             OVER ({full})) AS target FROM s2),
c1 AS (SELECT c0.*, source_size, target, cell_size * c0.grade AS weight, cell_size * {CEILING} AS cap
       FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source WHERE cell_size > 0),
c2 AS (SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source {order}), 0)::DOUBLE)
              / (sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER (PARTITION BY source {order}), 0))::DOUBLE AS lv FROM c1),
c3 AS (SELECT *, least({CEILING}.0, grade * coalesce(first(CASE WHEN lv * weight <= cap THEN lv END IGNORE NULLS)
              OVER (PARTITION BY source {full}), {CEILING}.0)) AS rate FROM c2),
c4 AS (SELECT *, floor(rate)::BIGINT AS copies, rate - floor(rate) AS share FROM c3),
c5 AS (SELECT *, CASE WHEN share > 0 THEN share / (1 - share) END AS odds,
              greatest(0.0, target - sum(copies * cell_size) OVER (PARTITION BY source)) AS room FROM c4),
c AS (SELECT *, first(odds IGNORE NULLS) OVER (PARTITION BY source ORDER BY cell_size DESC, grade
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / odds AS pull FROM c5),
k AS (SELECT r.doc_id, r.source, r.size, r.tie, r.u, c.copies, c.room, c.pull, r.u / (1 - r.u) * c.pull AS y FROM r
      LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.grade = c.grade),
o AS (SELECT *, least(floor(y / (1 + y) * {k52}), {k52} - 1)::BIGINT AS key FROM k),
p AS (SELECT *, coalesce(sum(CASE WHEN pull IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, tie
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o)
SELECT p.doc_id, p.size, s.source_size, s.target, (n * p.size)::BIGINT AS taken, n::BIGINT AS n_copies FROM
 (SELECT *, coalesce(copies, 0) + CASE WHEN pull IS NOT NULL AND size > 0 AND pos + size / 2 <= room THEN 1
              WHEN pull IS NOT NULL AND size = 0 AND pos <= room THEN 1 ELSE 0 END AS n FROM p) p
JOIN s ON p.source IS NOT DISTINCT FROM s.source"""
