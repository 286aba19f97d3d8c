"""Operator 11, cross-tokenizer alignment: groups of the tokens of two vocabularies by merge paths.

Both encodings of a text cover the same bytes, so their tokens' ends are two ascending lists; where
both have an end, a group of tokens is complete. A slice of texts is cut into parts at places where
either encoding must begin a token (``bpe``), and the ends of its distinct parts are two long lists.
Diagonals of the merge path, ``WORK`` ends apart, are searched by bisection and divide the merge into
independent pieces of equal work, however long a part is. A piece emits its overlaps, the pairs of
tokens that share bytes, in merge order; overlaps that follow one another and share a token belong to
one group, within a piece and, stitched, from one piece's last to the next one's first. Texts take
the groups of their parts.

An id pair's count is the number of documents that hold it linked. Documents keep their distinct
linked pairs with their numbers of links; Spark counts the pairs (combined map-side), marks each A
id's highest count, and joins the counts back: the at most ``HOT`` most frequent pairs by broadcast,
which leaves only links of rare pairs to the shuffled join.

Scale: one pass over the texts, no text is shuffled. A task holds a slice of texts; a document's
tokens are in one task, as its row is. Groups with more than ``WIDE`` pairs count equal ids together.

Defined cases: null and empty texts, and those whose bytes an encoding changes (such as a word mark
in the text), have no tokens: zeros and an empty ``groups_sha256``; repeated rows and null ids are
documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .bpe import ByteBPE, SentenceBPE, cut_all, gathered, slices

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 4 << 20
WORK = 1 << 15
WIDE = 1 << 12
HOT = 1 << 20
ID_BITS = 20
SEPARATORS = (",", "|", ";")


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals 0, work, 2 work, ... and the last cross the merge path of two ascending
    lists (equal values: that of ``a`` first): how many of ``a`` and of ``b`` lie before each."""
    n = len(a) + len(b)
    d = np.append(np.arange(0, n, work), n)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)])
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``a``, place in ``b``) of tokens that overlap, in merge order, of one piece's
    ends; ``before`` is the end of the ``a`` token before the piece. Each end closes one pair, unless
    it is a ``b`` end at which an ``a`` token has ended already. A place past the piece is the first
    token of a later one."""
    above = np.searchsorted(b, a, side="left")            # an a end comes before an equal b end
    left = np.searchsorted(a, b, side="right")
    met = np.where(left > 0, a[np.maximum(left, 1) - 1] if len(a) else before, before) == b
    i, j = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    valid = np.ones(len(i), bool)
    at = np.arange(len(a)) + above
    i[at], j[at] = np.arange(len(a)), above
    at = np.arange(len(b)) + left
    i[at], j[at], valid[at] = left, np.arange(len(b)), ~met
    return i[valid], j[valid]


def groups(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """First token of every group in either list of ends, both ending at the same byte."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at_a, at_b = diagonals(a, b, work)
    firsts, last = [], (-1, -1)
    for i0, i1, j0, j1 in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist()):
        i, j = overlaps(a[i0:i1], b[j0:j1], int(a[i0 - 1]) if i0 else 0)
        if not len(i):
            continue
        i, j = i + i0, j + j0
        # a group begins where an overlap shares no token with the one before, in this piece or the last
        new = (np.diff(i, prepend=last[0]) > 0) & (np.diff(j, prepend=last[1]) > 0)
        firsts.append((i[new], j[new]))
        last = (int(i[-1]), int(j[-1]))
    return np.concatenate([x for x, _ in firsts]), np.concatenate([x for _, x in firsts])


def links(a_ids: np.ndarray, b_ids: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, wide: int = WIDE) -> tuple[np.ndarray, ...]:
    """(group, pair, links) of all pairs of ids in each group; ids are counted together in a group of
    more than ``wide`` pairs, else there is a row for each pair of tokens."""
    size_a, size_b = np.diff(first_a, append=len(a_ids)), np.diff(first_b, append=len(b_ids))
    number = size_a * size_b
    small = np.flatnonzero(number <= wide)
    group = np.repeat(small, number[small])
    ends = np.cumsum(number[small])
    rank = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - number[small], number[small])
    down, across = np.divmod(rank, size_b[group])
    pair = (a_ids[first_a[group] + down].astype(np.int64) << ID_BITS) | b_ids[first_b[group] + across]
    out = [(group, pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(number > wide).tolist():
        x, nx = np.unique(a_ids[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b_ids[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), ((x.astype(np.int64) << ID_BITS)[:, None] | y.astype(np.int64)).ravel(), (nx[:, None] * ny).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def spelled(vocabulary: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all entries one after the other, their ends)."""
    taken = vocabulary.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
    return np.frombuffer(taken.buffers()[2], np.uint8, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint8), ends[1:]


class Aligner:
    """Both encoders with their vocabularies' bytes, and the decimal ids with each separator."""

    def __init__(self, a_path: str, b_path: str, work: int = WORK, wide: int = WIDE):
        self.a, self.b, self.work, self.wide = ByteBPE(a_path, plain=True), SentenceBPE(b_path), work, wide
        self.bytes_a, self.bytes_b = (pa.array(e.vocabulary(), pa.large_binary()) for e in (self.a, self.b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        if self.ids > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than {1 << ID_BITS} entries")
        self.decimals = pa.array([f"{i}{s}".encode() for s in SEPARATORS for i in range(self.ids)], pa.large_binary())


class Slice:
    """A slice of texts, aligned. ``part`` numbers the parts of all kept texts in order, ``text`` the
    text of each; tokens ``a`` and ``b``, groups and links are those of the distinct parts."""

    def __init__(self, texts: list[str], by: Aligner):
        self.by, self.n = by, len(texts)
        part, words, ends = cut_all(texts, by.b.whole(texts))
        a, size_a = by.a.spaced(words)
        b, size_b = by.b.spaced(words)
        same = self.unchanged(words, (by.bytes_a, a, size_a), (by.bytes_b, b, size_b))
        text = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        good = np.array([bool(t) for t in texts], bool)
        good[text[~same[part]]] = False
        self.part, self.text = part[good[text]], text[good[text]]
        self.a, self.b = a[np.repeat(same, size_a)], b[np.repeat(same, size_b)]
        self.size_a, self.size_b = np.where(same, size_a, 0), np.where(same, size_b, 0)
        self.first_a, self.first_b = groups(spelled(by.bytes_a, self.a)[1], spelled(by.bytes_b, self.b)[1], by.work)
        self.group_a, self.group_b = np.diff(self.first_a, append=len(self.a)), np.diff(self.first_b, append=len(self.b))
        # both encodings end with a part, so no group reaches over two
        self.n_groups = np.diff(np.searchsorted(self.first_a, np.cumsum(self.size_a)), prepend=0)

    @staticmethod
    def unchanged(words: list[str], *sides) -> np.ndarray:
        """Parts whose tokens spell them, with the space in front, in either encoding."""
        raw = [b" " + w.encode() for w in words]
        joined, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)
        out = np.ones(len(words), bool)
        for vocabulary, ids, sizes in sides:
            data, stops = spelled(vocabulary, ids)
            last = np.concatenate([[0], stops])[np.cumsum(sizes)]
            if not (np.array_equal(last, ends) and np.array_equal(data, joined)):
                held = data.tobytes()
                out &= [held[s:e] == r for s, e, r in zip([0, *last.tolist()], last.tolist(), raw)]
        return out

    def per_text(self, of_part: np.ndarray) -> np.ndarray:
        """Sums of a number of the parts over each text."""
        return np.bincount(self.text, of_part[self.part], self.n).astype(np.int64)

    def lists(self, flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        """The texts' runs of a list that each part has ``sizes`` elements of."""
        values = gathered(self.part, flat, sizes)[0]
        offsets = np.concatenate([[0], np.cumsum(self.per_text(sizes))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, spelled ``a1,a2|b1;a3|b2,b3``."""
        of_a, of_b = np.repeat(np.arange(len(self.group_a)), self.group_a), np.repeat(np.arange(len(self.group_b)), self.group_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        code[np.arange(len(of_a)) + self.first_b[of_a]] = self.a + self.by.ids * last_a
        code[np.arange(len(of_b)) + (self.first_a + self.group_a)[of_b]] = self.b + 2 * self.by.ids * last_b
        data, stops = spelled(self.by.decimals, code)
        ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(self.size_a + self.size_b)])]
        spelt = pa.Array.from_buffers(pa.large_binary(), len(self.size_a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        data, stops = spelled(spelt, self.part)
        view, last = memoryview(data), np.concatenate([[0], stops])[np.cumsum(np.bincount(self.text, minlength=self.n))].tolist()
        return [hashlib.sha256(view[s:e - 1]).hexdigest() if e > s else "" for s, e in zip([0, *last], last)]

    def linked(self) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """(number of links, distinct linked pairs, links of each pair) of the texts."""
        group, pair, times = links(self.a, self.b, self.first_a, self.first_b, self.by.wide)
        order = np.argsort(group, kind="stable") if len(pair) and (times > 1).any() else slice(None)
        group, times = group[order], times[order]
        distinct, code = np.unique(pair[order], return_inverse=True)
        of_group = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        sizes = np.bincount(of_group[group], minlength=len(self.n_groups))
        keys = np.repeat(self.text, sizes[self.part]) * len(distinct) + gathered(self.part, code, sizes)[0]
        if isinstance(order, slice):                              # every link is one: count equal keys
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            total = np.diff(first, append=len(keys))
        else:
            by_key = np.argsort(keys, kind="stable")
            keys = keys[by_key]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            total = np.add.reduceat(gathered(self.part, times, sizes)[0][by_key], first) if len(first) else first
        text, which = np.divmod(keys[first], max(1, len(distinct)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n))]), pa.int32())
        return (np.bincount(text, total, self.n).astype(np.int64), pa.ListArray.from_arrays(offsets, pa.array(distinct[which])),
                pa.ListArray.from_arrays(offsets, pa.array(total)))


def _over(paths: tuple[str, str], work: int, wide: int, columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Aligner(*paths, work, wide)
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE):
                made = columns(Slice(texts, by))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *made.values()],
                                                 ["row", "doc_id", *made])
    return run


def _aligned(docs: DataFrame, columns, schema: str, id_col: str, text_col: str, paths, work: int, wide: int) -> DataFrame:
    import public_tokenizers

    paths = paths or (public_tokenizers.path(A), public_tokenizers.path(B))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_over(paths, work, wide, columns), f"row long, doc_id {kind}, {schema}")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None,
          work: int = WORK, wide: int = WIDE) -> DataFrame:
    """(row, doc_id, a_ids, b_ids, group_a, group_b) of every document: its tokens in either
    vocabulary, and how many of them each group takes, in order."""
    def columns(s: Slice) -> dict:
        kind = pa.int32()
        return {"a_ids": s.lists(s.a, s.size_a, kind), "b_ids": s.lists(s.b, s.size_b, kind),
                "group_a": s.lists(s.group_a, s.n_groups, kind), "group_b": s.lists(s.group_b, s.n_groups, kind)}

    return _aligned(docs, columns, "a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>", id_col, text_col, paths, work, wide)


def linked_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None,
                 work: int = WORK, wide: int = WIDE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document: its
    distinct linked pairs (A id shifted left by ``ID_BITS``, and B id) with their numbers of links."""
    def columns(s: Slice) -> dict:
        n_links, pairs, times = s.linked()
        return {"n_a": pa.array(s.per_text(s.size_a)), "n_b": pa.array(s.per_text(s.size_b)), "n_groups": pa.array(s.per_text(s.n_groups)),
                "n_links": pa.array(n_links), "groups_sha256": pa.array(s.digests()), "pairs": pairs, "times": times}

    return _aligned(docs, columns, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>",
                    id_col, text_col, paths, work, wide)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, docs, best) of every linked pair: how many documents hold it, and whether no other pair
    of its A id is held by more."""
    counts = write_table(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    first = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))      # a row per entry of the vocabulary
    joined = counts.withColumn("a", first).join(F.broadcast(most), "a")
    return write_table(joined.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "scored")


def frequent_from(counts: DataFrame, most: int = HOT) -> int:
    """The smallest power of two such that at most ``most`` pairs are in so many documents or more."""
    levels = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("docs")).alias("level")).agg(F.count("*").alias("n")).collect()}
    level, n = max(levels, default=0) + 1, 0
    while level and n + levels.get(level - 1, 0) <= most:
        level -= 1
        n += levels.get(level, 0)
    return 1 << level


def with_counts(linked: DataFrame, hot: int = HOT) -> DataFrame:
    """``linked`` (written) with ``n_best`` and ``count_sum``."""
    counts = pair_counts(linked)
    limit = frequent_from(counts, hot)
    pairs = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    scored = pairs.join(F.broadcast(counts.where(F.col("docs") >= limit)), F.col("pairs") == F.col("pair"), "left")
    if limit > 1:                                                   # rare pairs: few links, by a shuffled join
        rare = scored.where("pair IS NULL").select("row", "pairs", "times")
        rare = rare.join(counts.where(F.col("docs") < limit), F.col("pairs") == F.col("pair"))
        scored = scored.where("pair IS NOT NULL").unionByName(rare)
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (linked.drop("pairs", "times").join(sums, "row", "left")
            .withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}))


def digest(docs: DataFrame, hot: int = HOT, **options) -> DataFrame:
    linked = write_table(linked_pairs(docs, **options), "linked")
    return with_counts(linked, hot).drop("row")
