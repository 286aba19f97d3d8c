import zlib
from collections import Counter

import numpy as np

from corpora import CLASHING, corner_rows, make
from fundlens.llm import sharding


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in sizes)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_digest_on_corner_cases(spark, corners):
    rows = sharding.digest(corners).collect()
    check(rows, 16)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corner_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.digest(corners.limit(0)).collect() == []
    check(sharding.digest(corners.limit(5)).collect(), 16)


def test_small_blocks_and_chunks_keep_all_rows_and_columns(spark):
    docs = make(spark, corner_rows(), [c for c in CLASHING])
    out = sharding.shuffle_to_shards(docs.repartition(5), 4, block_rows=8, chunk_rows=4)
    assert out.columns == docs.columns + ["shard", "slot"]
    rows = out.collect()
    check(rows, 4)
    key = lambda r: repr((r.doc_id, r.text, r.source))
    assert Counter(map(key, rows)) == Counter(map(key, docs.collect()))


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    got = Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(20000))
    from math import comb
    for k in range(1, 7):
        assert abs(got[k] / 20000 - comb(7, k) * comb(5, 6 - k) / comb(12, 6)) < 0.02
    big = [sharding.hypergeometric(rng, 10**12, 10**12, 10**8) for _ in range(50)]
    assert abs(np.mean(big) - 5e7) < 5e3 and 2e3 < np.std(big) < 9e3
    assert sharding.hypergeometric(rng, 0, 9, 4) == 0 and sharding.hypergeometric(rng, 9, 0, 4) == 4


def test_matrix_margins():
    blocks = [5, 0, 17, 1, 40]
    m = sharding.communication_matrix(blocks, 6, 1)
    assert [sum(r) for r in m] == blocks
    cols = [sum(r[s] for r in m) for s in range(6)]
    assert sum(cols) == 63 and max(cols) - min(cols) <= 1


def test_uniform(spark):
    """Every row is as likely in every shard, and neighbours are not kept together."""
    docs = spark.range(40).select("id").repartition(4)
    hits, together = Counter(), 0
    for seed in range(8):
        rows = sharding.shuffle_to_shards(docs, 4, seed=seed, block_rows=8, chunk_rows=4).collect()
        shard = {r.id: r.shard for r in rows}
        hits.update((i % 4, s) for i, s in shard.items())
        together += sum(shard[i] == shard[i + 1] for i in range(39))
    assert all(abs(n - 20) < 18 for n in hits.values()) and len(hits) == 16
    assert abs(together / (8 * 39) - 9 / 39) < 0.1


def test_clashing_columns_are_kept_beside(spark):
    docs = make(spark, corner_rows()).selectExpr("*", "7 AS shard", "8 AS Slot", "9 AS _r", "10 AS s", "11 AS c", "12 AS key")
    out = sharding.shuffle_to_shards(docs, 4)
    assert out.columns == [*docs.columns[:5], "_shard", "_Slot", *docs.columns[7:], "shard", "slot"]
    got = out.collect()
    assert len(got) == docs.count() and {(r._shard, r._Slot) for r in got} == {(7, 8)} and {r.shard for r in got} == {0, 1, 2, 3}
