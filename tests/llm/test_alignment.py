import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpora import CLASHING, corner_rows, make
from fundlens.llm import alignment as M
from fundlens.llm.bpe import byte_symbols
from test_token_files import odd_texts

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens():
    """Both libraries' tokens of a whole text, as (id, bytes)."""
    t = Tokenizer.from_file(public_tokenizers.path(M.A))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(M.B))
    byte = {c: b for b, c in enumerate(byte_symbols())}

    def b_bytes(i):
        p = s.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda x: [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + x, add_special_tokens=False).ids],
            lambda x: [(i, b_bytes(i)) for i in s.encode(x)])


def brute_groups(x, a_of, b_of):
    if not x:
        return []
    sides = [a_of(x), b_of(x)]
    if any(b"".join(r for _, r in side) != (" " + x).encode() for side in sides):
        return []
    ends = [list(np.cumsum([len(r) for _, r in side])) for side in sides]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    at = [[0, *(bisect_right(own, c) for c in cuts)] for own in ends]
    return [tuple([i for i, _ in side[own[k]:own[k + 1]]] for side, own in zip(sides, at)) for k in range(len(cuts))]


def brute(rows):
    a_of, b_of = tokens()
    memo = {t: brute_groups(t, a_of, b_of) for t in {r[1] for r in rows}}
    found = [memo[r[1]] for r in rows]
    links = [Counter((a, b) for x, y in gs for a in x for b in y) for gs in found]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (i, *_), gs, c in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(c.values()),
                    sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), unique=True), st.lists(st.integers(1, 60), unique=True), st.integers(1, 9))
def test_pieces_are_equal_and_give_the_groups(a, b, work):
    a, b = (np.array(sorted({*x, 61}), np.int64) for x in (a, b))
    at_a, at_b = M.diagonals(a, b, work)
    steps = (at_a + at_b)[1:] - (at_a + at_b)[:-1]
    assert (steps[:-1] == work).all() and steps[-1] <= work
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert at_a.tolist() == [sum(s == 0 for _, s in merged[:d]) for d in (at_a + at_b).tolist()]
    first_a, first_b = M.groups(a, b, work)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert first_a.tolist() == [0] + [a.tolist().index(c) + 1 for c in common[:-1]]
    assert first_b.tolist() == [0] + [b.tolist().index(c) + 1 for c in common[:-1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), unique=True, max_size=30), st.lists(st.integers(1, 40), unique=True, max_size=30))
def test_overlaps_are_the_tokens_that_share_bytes(a, b):
    a, b = (sorted({*x, 41}) for x in (a, b))
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
    assert list(zip(*(x.tolist() for x in M.overlaps(np.array(a), np.array(b), 0)))) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = corner_rows() + [(3000 + i, t, "z") for i, t in enumerate(odd_texts(rng, 150, 40))]
    # long runs without a space, a wide group, and texts that an encoding changes
    out += [(4000, "ab" * 900, "z"), (4001, "\n" * 300 + "x", "z"), (4002, "a▁b", "z"), (4003, "漢字" * 200 + " \U0001F600" * 50, "z"), (4004, "<s> </s> <0x41>", "z")]
    return out + [(None, "the quick brown fox", "z")] * 3


def test_documents_match_brute_force(spark, rows):
    docs, want = make(spark, rows, CLASHING), brute(rows)
    for table, options in ((docs.repartition(4), {}), (docs, {"hot": 40, "work": 7, "wide": 1}), (docs, {"hot": 0})):
        got = M.digest(table, **options)
        assert set(got.columns) == set(COLUMNS)
        assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == want
    assert M.digest(docs.limit(0)).collect() == []


def test_spans_are_those_of_the_libraries(spark, rows):
    a_of, b_of = tokens()
    for r in M.align(make(spark, rows), work=50).collect():
        text = {x[0]: x[1] for x in rows}.get(r.doc_id)
        if sum(x[0] == r.doc_id for x in rows) > 1 or r.doc_id is None:
            continue
        gs = brute_groups(text, a_of, b_of)
        assert (r.a_ids, r.b_ids) == ([i for x, _ in gs for i in x], [i for _, y in gs for i in y])
        assert (r.group_a, r.group_b) == ([len(x) for x, _ in gs], [len(y) for _, y in gs])
