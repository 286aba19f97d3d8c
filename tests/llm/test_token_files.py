import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpora import CLASHING, corner_rows, make
from fundlens.llm import bpe
from fundlens.llm import token_files as T

ODD = list("ab1. ,'\n\t  s") + ["<|endoftext|>", "  ", " \n", "\x1c", "é", "漢", "\U0001F600", "▁", "<s>", "'s", "'re", "İ", "́", "\0", "\x85", "٣", "ﬁ"]


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    return [t.encode(x or "", add_special_tokens=False).ids + [T.END_ID] for x in texts]


def odd_texts(rng, n, longest=25):
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(longest))) for _ in range(n)]


def split(found):
    return [x.tolist() for x in np.split(found[0], found[1][:-1])]


def test_parts_have_the_tokens_of_the_whole_text():
    path = public_tokenizers.path(T.VOCABULARY)
    whole, rng = Tokenizer.from_file(path), random.Random(5)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own, own_plain = bpe.ByteBPE(path, plain=False, remembered=7), bpe.ByteBPE(path, plain=True)
    sentences = bpe.SentenceBPE(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(200):
        texts = odd_texts(rng, 20)
        assert split(own.encode(texts)) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert split(own_plain.encode(texts, spaced=True)) == [e.ids for e in plain.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert split(sentences.encode(texts)) == sentences.model.encode(texts)
    # every character whose class the fast pattern decides
    text = [f"a{c}1 {c}{c} b{c} 1{c}.{c}\n{c}" for c in map(chr, range(ord(bpe.PLAIN)))]
    assert split(own.encode(text)) == [e.ids for e in whole.encode_batch(text, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300), st.just(7)), max_size=300), st.integers(1, 40), st.integers(1, 100))
def test_blocks_round_trip(ids, block, percentile):
    ids = np.array(ids, "<u4")
    blocks = T.encode_blocks(ids, block, percentile)
    assert len(blocks) == -(-len(ids) // block)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)[:-1]
    assert T.decode_blocks(b"".join(blocks), starts, len(ids), block).tolist() == ids.tolist()


def test_width_is_that_of_the_percentile():
    ids = np.array([10] * 90 + [11] * 9 + [10 + (1 << 20)], "<u4")
    head = np.frombuffer(T.encode_blocks(ids, 100, 90)[0][:9], T.BLOCK)[0]
    assert (head["least"], head["width"], head["patches"]) == (10, 0, 10)
    head = np.frombuffer(T.encode_blocks(ids, 100, 99)[0][:9], T.BLOCK)[0]
    assert (head["width"], head["patches"]) == (1, 1)


def test_damage_is_noticed():
    raw = T.segment(["a", None, ""], [2, 1, 3], np.arange(6), 4, 99) + T.CLOSING.encode()
    (number, before, names, counts, ids), = T.read_segments(raw)
    assert (number, before, names, counts.tolist(), ids.tolist()) == (4, 99, ["a", None, ""], [2, 1, 3], [0, 1, 2, 3, 4, 5])
    for at in (0, 60, len(raw) - 8, len(raw) - 1):
        with pytest.raises(ValueError):
            list(T.read_segments(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for (i, *_), ids in zip(order, library([t for _, t, *_ in order])):
        out.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_files_match_the_library(spark):
    """Distinct ids: every column. Shared ids: the rows lie in one run, in an order that reruns keep."""
    rng = random.Random(9)
    seen, rows = set(), []
    for r in corner_rows() + [(2000 + i, t, "z") for i, t in enumerate(odd_texts(rng, 300, 60))]:
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    docs = make(spark, rows, CLASHING)
    assert sorted(map(tuple, T.digest(docs.repartition(5)).collect()), key=lambda r: r[1]) == brute(rows)
    shared = make(spark, corner_rows() + [(8, f"text {i}", "q") for i in range(400)] + [(8, "same", "q")] * 400)
    found = sorted(map(tuple, T.digest(shared.repartition(3)).collect()), key=lambda r: r[1])
    assert found == sorted(map(tuple, T.digest(shared.repartition(6)).collect()), key=lambda r: r[1])
    assert sorted((str(i), n, c) for i, _, n, c in found) == sorted((str(i), n, c) for i, _, n, c in brute(corner_rows() + [(8, f"text {i}", "q") for i in range(400)] + [(8, "same", "q")] * 400))
    assert [s for _, s, _, _ in found] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in found])])[:-1].tolist()
    assert [i is not None and i for i, *_ in found] == sorted(i is not None and i for i, *_ in found)
    assert T.digest(docs.limit(0)).collect() == []


def test_small_segments_and_tokens(spark, tmp_path):
    rows = [(i, " ".join(["word", "two"] * (i % 40)), "a") for i in range(200)]
    path = f"file://{tmp_path}/tokens"
    T.write_tokens(make(spark, rows), path, block=16, percentile=50, segment_ids=100)
    read = {int(r.id): r.tokens for r in T.read_tokens(spark, path).collect()}
    assert read == dict(zip([r[0] for r in rows], library([r[1] for r in rows])))
    assert len(list((tmp_path / "tokens").glob("part-*"))) > 1


def test_numbers_of_every_width_are_packed_lowest_bit_first():
    rng = np.random.default_rng(2)
    for width in range(33):
        for n in (1, 7, 8, 9, 40):
            rows = rng.integers(0, 1 << width, (3, n), dtype=np.uint64).astype(np.uint32)
            rows[0] = (1 << width) - 1
            packed = T.packed_bits(rows, width)
            bits = (rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
            assert packed.tolist() == np.packbits(bits.astype(np.uint8).reshape(3, -1), axis=1, bitorder="little").tolist()
            assert T.unpacked_bits(packed, width, n).tolist() == rows.tolist()


def test_a_worker_learns_a_pre_token_once(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Task:
        def partitionId(self):
            return 3

    merged, path = [], public_tokenizers.path(T.VOCABULARY)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Task()))
    monkeypatch.setattr(bpe.ByteBPE, "merged", lambda self, words, of=bpe.ByteBPE.merged: merged.extend(words) or of(self, words))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array(["learnedonce and learnedonce, again", "learnedonce"])], ["id", "text"])
    files = [[r.column(0)[0].as_py() for r in T._writer(path, T.END_ID, 16, 90, 100)(iter([batch]))] for _ in range(2)]
    assert files[0] == files[1] and merged.count(" learnedonce") == 1 == merged.count("learnedonce")


def test_memory_keeps_no_more_than_its_size():
    memory, length = bpe.Memory(5), lambda words: [bytes([len(w)]) for w in words]
    for words in (["a", "bb", "a"], ["cccc", "bb", "d", "eee"], list("abcdefghi"), ["i", "zz", "i"]):
        assert memory.all(words, length) == length(words)
        assert len(memory.known) <= 5
