import random

from pyspark.sql import functions as F

from corpora import CLASHING, corner_rows, make, same, sentence
from fundlens.llm import mixing, quality_rules


def test_ledger_matches_sql_on_corner_cases(spark, corners):
    same(quality_rules.digest(corners), quality_rules.oracle(), documents=corners)
    extra = make(spark, corner_rows(), CLASHING)
    same(quality_rules.digest(extra), quality_rules.oracle(), documents=corners)


def test_repeated_words_counts_the_union_of_windows(spark):
    rows = [(1, "a b c a b c a b c", None), (2, "a a a a", None), (3, "a b c d a b c", None), (4, "a b", None), (5, "a b c x a b c y c x a", None)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.ledger(make(spark, rows)).collect()}

    def brute(text):
        ws, seen = text.split(), {}
        for i in range(len(ws) - 2):
            seen.setdefault(tuple(ws[i:i + 3]), []).append(i)
        return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})
    assert got == {i: brute(t) for i, t, _ in rows}


def test_policies_and_ablation(spark):
    rng = random.Random(3)
    clean = [(i, sentence(rng, 120), "a") for i in range(5)]
    bad = [(10, "too short", "a"), (11, "spam spam " * 60, "a"), (12, " ".join(f"w{i}###" for i in range(90)), "a")]
    docs = make(spark, clean + bad, CLASHING)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]
    led = quality_rules.ledger(docs)
    cost = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality_rules.ablation(led, "v1").collect()}
    assert cost["few_words"] == (1, 1) and cost["symbols"] == (1, 1) and cost["repeated_words"][0] == 1
    assert quality_rules.digest(docs.limit(0)).collect() == []


def test_mix_matches_sql_on_corner_cases(spark, corners):
    once = corners.dropDuplicates()
    same(mixing.digest(once), mixing.oracle(), documents=once)
    extra = make(spark, corner_rows(), CLASHING)
    assert mixing.digest(extra).count() == corners.count()
    assert mixing.digest(corners.limit(0)).collect() == [] and mixing.mix(corners.limit(0)).collect() == []


def test_targets_and_ceiling(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 150 + ["tiny"] * 20 + [None] * 150)]
    out = mixing.digest(make(spark, rows)).withColumn("source", F.col("source_size")).collect()
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    target, left, open_ = {}, sum(size.values()), {"big": 5, "mid": 2, "tiny": 1, None: 5}
    while True:                                     # reshare what is above the ceiling, by weight
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    target |= share
    of = {i: s for i, _, s in rows}
    taken = {}
    for r in out:
        assert abs(r.target - target[of[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_mix_is_the_same_for_other_partitionings_and_counts_copies(spark):
    rows = corner_rows(7)
    docs = make(spark, rows, CLASHING).dropDuplicates()
    a = sorted(map(tuple, mixing.digest(docs.repartition(1)).collect()), key=repr)
    assert a == sorted(map(tuple, mixing.digest(docs.repartition(7)).collect()), key=repr)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r[-1] for r in a)


def test_tied_rows_are_cut_in_part(spark):
    """The cut takes as many of the tied rows as the target wants, whatever the partitioning."""
    rows = [(1, "same words here", "a")] * 3000 + [(2 + i, "other words here", "b") for i in range(3000)]
    docs = make(spark, rows)
    out = mixing.digest(docs.repartition(8)).collect()
    taken = sum(r.taken for r in out if r.doc_id == 1)
    assert abs(taken - [r.target for r in out if r.doc_id == 1][0]) <= 1.5
    assert {r.n_copies for r in out if r.doc_id == 1} == {1, 2} and len(out) == 6000
    plain = sorted(map(tuple, out))
    assert plain == sorted(map(tuple, mixing.digest(docs.repartition(7)).collect())) == sorted(map(tuple, mixing.digest(docs.coalesce(1)).collect()))
    # tied rows that other columns tell apart: the same ones are taken again
    told = spark.createDataFrame([(1, "same words here", None, "a", i % 900) for i in range(3000)] + [(2 + i, "other words here", None, "b", 0) for i in range(3000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    first, again = (sorted((r.doc_id, r.n_chars) for r in mixing.mix(told.repartition(n)).collect()) for n in (3, 8))
    assert first == again and abs(3 * sum(i == 1 for i, _ in first) - [r.target for r in out if r.doc_id == 1][0]) <= 1.5
