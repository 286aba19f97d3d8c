import random
import re

from corpora import CLASHING, corner_rows, make, sentence
from fundlens.llm import jaccard_join
from fundlens.llm.shingles import parity_sketch, sketch_distance

import numpy as np


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    """Sorted (doc_id, shingles, component) by comparing all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)), key=repr)


def family(rng, base, n, edits, first_id):
    out = []
    for i in range(n):
        ws = base.split()
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append((first_id + i, " ".join(ws), "a"))
    return out


def corpus(seed=11):
    rng = random.Random(seed)
    rows = corner_rows()
    rows += family(rng, sentence(rng, 150), 60, 5, 1000)           # around the threshold, and chains
    rows += family(rng, sentence(rng, 40), 25, 2, 2000)
    rows += family(rng, sentence(rng, 9), 25, 1, 3000)
    passage = sentence(rng, 60)
    rows += [(4000 + i, sentence(rng, 60) + " " + passage + " " + sentence(rng, 30), "b") for i in range(50)]
    rows += [(5000 + i, rows[70][1], "c") for i in range(30)]      # copies
    grown = sentence(rng, 100).split()
    rows += [(6000 + i, " ".join(grown[:100 - 4 * i]), "c") for i in range(12)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    rows = corpus()
    docs = make(spark, rows, CLASHING).repartition(6)
    want = brute(rows)
    assert got(jaccard_join.digest(docs)) == want
    # every shared segment is hot, and the comparison by blocks is used
    assert got(jaccard_join.digest(docs, small=1, block=16)) == want


def test_empty_table_and_filter(spark):
    rows = corpus()
    docs = make(spark, rows, CLASHING)
    assert jaccard_join.digest(docs.limit(0)).collect() == []
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    want = [(d, t) for (d, t, _), (c) in zip(rows, [dict((x[0], x[2]) for x in brute(rows)).get(r[0]) for r in rows]) if d == c or c is None]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_signatures_never_miss_a_pair():
    rng = np.random.default_rng(4)
    for n in [5, 6, 7, 9, 14, 33, 80, 200, 501]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, len(a) // 9 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, len(a) // 9 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            sig, who = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert len(np.intersect1d(sig[who == 0], sig[who == 1])) or (len(a) == both == len(b))
            assert sketch_distance(parity_sketch(a), parity_sketch(b)) <= len(a) + len(b) - 2 * both


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    base, other, third, fourth, lone = (sentence(rng, 60) for _ in range(5))
    near = lambda t, w: t + " " + w
    rows = [(1, base, "a"), (None, near(base, "x"), "a"), (None, lone, "a"), (None, "", "a"), (None, None, "a"),
            # an id with two texts: one a copy of document 1, the other first of its own group
            (7, near(base, "y"), "a"), (7, other, "a"), (9, near(other, "z"), "a"),
            # groups without ids, one of copies
            (None, third, "a"), (None, near(third, "x"), "b"), (None, near(third, "y"), "c"),
            (None, fourth, "a"), (None, fourth, "b"), (None, fourth, "b"), (20, sentence(rng, 30), "a"), (20, rows_text := sentence(rng, 31), "a"), (20, rows_text, "b")]
    docs = make(spark, rows, CLASHING)
    out = jaccard_join.one_of_each(docs.repartition(5))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    sure = [(d, t) for d, t, _ in rows if (d, t) in [(1, base), (None, lone), (None, ""), (None, None), (7, other)] or d == 20]
    groups = [[third, near(third, "x"), near(third, "y")], [fourth]]
    assert sorted((x for x in got if x[1] not in sum(groups, [])), key=repr) == sorted(sure, key=repr)
    for texts in groups:
        assert [d for d, t in got if t in texts] == [None]


def test_shared_and_null_ids_cost_no_more_than_distinct_ones(spark):
    """One id, or none, for every row: the rows of an id meet no other set of the id."""
    import time

    rng = random.Random(31)
    texts = [sentence(rng, 40) for _ in range(1200)]
    texts += [t + " tail" for t in texts[:600]]
    took = {}
    for name, of in (("warm", lambda i: i), ("distinct", lambda i: i), ("one", lambda i: 5), ("none", lambda i: None)):
        docs = make(spark, [(of(i), t, "a") for i, t in enumerate(texts)])
        start = time.perf_counter()
        got = jaccard_join.digest(docs).collect()
        took[name] = time.perf_counter() - start
        assert len(got) == 1800
        if name == "distinct":
            assert sum(r.component_id != r.doc_id for r in got) == 600
        elif name != "warm":
            assert {r.component_id for r in got} == {of(0)}
    assert max(took["one"], took["none"]) < 3 * took["distinct"] + 5
