"""Values carried along an order."""

import random

from fundlens.operators.carry import carry
from fundlens.operators.normalize import fix_missing_id


def brute(rows, backward, grouped):
    out, last, group = {}, None, object()
    for g, t, v in sorted(rows, key=lambda r: (str(r[0]) if grouped else "", r[1] is not None, r[1] or 0), reverse=backward):
        if grouped and g != group:
            last, group = None, g
        last = v if v is not None else last
        out[g, t] = last
    return out


def test_carry_over_many_ranges_and_batches(spark):
    rng = random.Random(3)
    times = rng.sample(range(10, 10_000), 3000)
    rows = [(rng.choice("abc") if i % 3 else None, t, f"v{t}" if rng.random() < 0.02 else None) for i, t in enumerate(times)] + [("a", None, None), ("z", 5, None), ("y", 6, "only")]
    df = spark.createDataFrame(rows, "g string, t long, v string").repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for parts, batch in (("1", "10000"), ("40", "13"), ("300", "10000")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for backward in (False, True):
                for by in ((), ("g",)):
                    got = {(r.g, r.t): r.v for r in carry(df, "v", ["t"], by, backward).collect()}
                    if by:
                        assert len(got) == len(rows) and got == {**brute([r for r in rows if r[0] is not None], backward, True), **brute([r for r in rows if r[0] is None], backward, True)}
                    else:
                        assert got == brute(rows, backward, False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert carry(df.limit(0), "v", ["t"]).collect() == []


def test_fills_of_ids(spark):
    df = spark.createDataFrame([("f1", 1, None), ("f1", 2, "a"), ("f1", 3, ""), ("f2", 4, None), ("f2", 5, "b")], "source string, n int, fund_cnpj string")
    ids = lambda *a: [r.fund_cnpj for r in fix_missing_id(df, *a).orderBy("n").collect()]
    assert ids("fill_forward", ["n"]) == [None, "a", "a", "a", "b"]
    assert ids("fill_forward", ["n"], "fund_cnpj", ["source"]) == [None, "a", "a", None, "b"]
    assert ids("fill_backward", ["n"]) == ["a", "a", "b", "b", "b"]
    assert ids("drop") == ["a", "b"] and len(ids("other")) == 5


def test_id_by_cardinality_at_the_threshold(spark):
    """Exactly ``ratio`` of the rows is too few; one value more is enough, whatever the sketch says."""
    from fundlens.operators.normalize import infer_id_by_cardinality

    for n in (100, 20_000):
        at = int(0.9 * n)
        rows = spark.range(n).selectExpr("id % 7 AS num_a", f"if(id < {at}, id, 0) AS cod_b", f"if(id <= {at}, id, 0) AS c_id", "id AS id_late", "cast(null AS string) AS num_null")
        assert infer_id_by_cardinality(rows).columns == ["num_a", "cod_b", "fund_cnpj", "id_late", "num_null"]
        assert infer_id_by_cardinality(rows.select("num_a", "cod_b", "num_null")).columns == ["num_a", "cod_b", "num_null"]
    assert infer_id_by_cardinality(rows.limit(0)).columns == rows.columns
