import random

from corpora import CLASHING, corner_rows, make, sentence
from fundlens.llm import token_counts as T


def brute(word, scores):
    w = T.MARK + word
    state = [(0.0, 0)]
    for i in range(1, len(w) + 1):
        n = len(w[i - 1].encode())
        options = [(state[i - 1][0] + n * T.BYTE_SCORE, -(state[i - 1][1] + n), 0)]
        options += [(state[j][0] + scores[w[j:i]], -(state[j][1] + 1), i - j) for j in range(i) if w[j:i] in scores]
        score, tokens, _ = max(options)
        state.append((score, -tokens))
    return state[-1][1]


def test_counts_match_brute_force(spark):
    scores = T.read_scores()
    rows = corner_rows() + [(i, t, "a") for i, t in enumerate(["the quick brown foxes", "naïve café 漢字 \U0001F600", "a" * 700, "x\u00a0y z", "The the THE"], 900)]
    docs = make(spark, rows, CLASHING)
    want = sorted(((i, len((t or "").encode().split()), sum(brute(w.decode(), scores) for w in (t or "").encode().split())) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in T.token_counts(docs.repartition(3)).collect()), key=repr) == want
    # forgetting words changes nothing
    assert sorted((tuple(r) for r in T.token_counts(docs, remembered=5).collect()), key=repr) == want
    assert T.token_counts(docs.limit(0)).collect() == []


def test_shared_prefixes_are_scored_once():
    trie = T.Trie({"▁a": -1.0, "b": -1.0})
    assert trie.counts(["▁ab", "▁abb", "▁abbb", "▁ab"]) == {"▁ab": 2, "▁abb": 3, "▁abbb": 4}
    assert trie.nodes == 5


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    """run() against the operators' rules applied by brute force."""
    import corpus_pipeline
    from test_jaccard_join import brute as components

    rng = random.Random(21)
    items = [(1, sentence(rng, 14)), (2, sentence(rng, 40))]
    rows = [(i, sentence(rng, rng.randrange(55, 140)), "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " extra", "a") for i in range(10)] + [(200, rows[3][1], "b"), (201, "too short", "b"), (202, None, None)]
    rows += [(300 + i, sentence(rng, 40) + " " + items[i % 2][1] + " " + sentence(rng, 40), "c") for i in range(6)]
    docs = make(spark, rows)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1] and len(r[1].split()) >= 50]
    first = {d for d, _, c in components(kept) if d == c}
    clean = {d for d, t, _ in kept if d in first and d < 300}
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in out} <= clean
    words = {d: len(t.split()) for d, t, _ in kept}
    total = sum(words[d] for d in clean)
    assert abs(sum(words[r.doc_id] for r in out) - total) < 3 * 140
    counts = [sum(r.shard == s for r in out) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in range(16))
    assert [n for n, _ in corpus_pipeline.STAGES] and out[0].asDict().keys() == {*docs.columns, "shard", "slot"}


def test_pipeline_on_corner_cases(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, clashing columns, an empty table."""
    import corpus_pipeline

    rng = random.Random(22)
    texts = [sentence(rng, 90) for _ in range(12)]
    rows = corner_rows() + [(None, texts[0], None), (None, texts[0] + " tail", "a"), (500, texts[0], "b"), (500, texts[1], "b")]
    rows += [(501, texts[2], "c")] * 3 + [(None, texts[3], "c")] * 2 + [(502, texts[1] + " tail", None)] + [(600 + i, t, "a") for i, t in enumerate(texts[4:])]
    spark.createDataFrame([(1, texts[4]), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clashing = (*CLASHING, "shard", "slot", "item_id")
    make(spark, rows, clashing).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {"_shard", "_slot", "shard", "slot", "item_id", *CLASHING} <= set(out.columns)
    got = out.collect()
    kept = {r.text for r in got}
    assert None not in kept and "" not in kept and texts[4] not in kept                 # no words, or a benchmark item
    assert texts[0] in kept and texts[0] + " tail" not in kept                          # the copy with an id stays
    assert texts[1] in kept and texts[1] + " tail" not in kept
    assert all(r["_shard"] == 1 and 0 <= r.shard < 16 for r in got)
    empty = tmp_path / "empty"
    make(spark, rows).limit(0).write.parquet(f"file://{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{empty}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{empty}")
    assert out.collect() == [] and {"shard", "slot", "doc_id"} <= set(out.columns)
