"""Operator 5, n-gram Jaccard join: universe partition and the pigeonhole principle.

Two sets with J >= 0.8 and at most U shingles each differ in at most H = 2U/9 of them. The universe
of shingle hashes is partitioned into m = H + 1 + spare segments, so at least 1 + spare segments
are equal in both sets; equal segments are found by joining segment hashes. Sizes are grouped in
bands (each upper bound 1.25 times the last), a set is indexed at its own band and, where a larger
partner can lie in it, at the next, so a pair always meets at the band of its larger set.

Cost-based allocation: empty segments are equal in very many sets and cost the most to join. A set
with at most ``spare`` of them leaves them all out: as 1 + spare segments of a pair are equal, one
that holds shingles is among them. A set with more keeps them. Costly segments that hold shingles
(more than ``SMALL`` sets share one: families of copies, common passages) are not paired off in
the first place. They first tie all their sets to one pivot, the set that is in most such segments,
which is linear in their number. Then
only sets that the verified links leave in different components are compared, in blocks, by parity
sketches: those differ in no more places than the sets do, so no link is lost.

Whatever remains is verified exactly: both whole texts are shingled again and 100 * intersection
>= 80 * union is tested. Shingles are 64-bit hashes throughout.

Scale: documents are read three times and shuffled once, narrowed to segment hashes of 6 bytes
(about 0.65 per shingle), dealt to as many buckets as the number of shingles asks for. Copies are
one set from the first step on (grouped with map-side combining). Hot segments are linear in their
sets, apart from the blocked comparison of what stays unconnected. Components are found by
alternating stars over written tables. Python runs in bounded batches under Spark's shuffles.

Defined cases: null or empty texts have the empty set and are linked with nothing; texts of fewer
than five words are one shingle; rows with equal sets are linked, whatever their ids, repeated
rows included; a component's id is its smallest non-null id, null if it has none; an empty table
gives an empty result; further columns are ignored by ``linked`` and returned by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import small_side
from .components import components
from .shingles import mix, parity_sketch, set_digests, shingle_sets, sketch_distance, text_chunks
from .text import fresh, whole

BUCKET_ROWS = 1_500_000          # segment hashes in a bucket, on average
SMALL = 12                       # sets sharing a segment that are paired off at once
BLOCK = 2048                     # sets in a block of the comparison by sketches
SEED = np.uint64(0xD6E8FEB86659FD93)
LOW48 = np.uint64((1 << 48) - 1)


def bands(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper bound, segments and spare segments of each size band, up to one that holds
    ``limit * 1.25``."""
    upper = [1]
    while upper[-1] < limit * 1.25 + 1:
        upper.append((upper[-1] + 1) * 5 // 4)
    u = np.array(upper, np.int64)
    differ = 2 * u // 9
    spare = np.where(differ > 0, (differ + 5) // 5 + 1, 0)
    return u, differ + 1 + spare, spare


def signatures(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment hashes of the sets and the index of the set each belongs to. Sets of fewer than four
    shingles link only with equal ones and have none at their own band."""
    n = np.diff(off)
    upper, segments, spares = bands(int(n.max(initial=1)))
    own = np.searchsorted(upper, n)
    sigs, owners = [], []
    for step in (0, 1):
        level = own + step
        m, spare = segments[level], spares[level]
        take = (n > 0) & (upper[level] >= 5) & ((step == 0) | (n * 5 // 4 > upper[own]))
        who = np.repeat(np.arange(len(n)), np.where(take, n, 0))
        if not len(who):
            continue
        flat = h[np.repeat(take, n)]
        seg = ((flat >> np.uint64(32)) * m[who].astype(np.uint64)) >> np.uint64(32)   # rises with the hash
        new = np.ones(len(flat), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(new)
        total, s, d = np.add.reduceat(mix(flat ^ SEED), at), seg[at], who[at]
        filled = np.bincount(d, minlength=len(n))
        many = np.flatnonzero(take & (m - filled > spare))
        if len(many):                                     # more empty segments than may be left out
            extra_s, extra_d = [], []
            for x in many:
                gone = np.setdiff1d(np.arange(m[x]), s[d == x].astype(np.int64))
                extra_s.append(gone.astype(np.uint64))
                extra_d.append(np.full(len(gone), x))
            total = np.concatenate([total, np.zeros(sum(map(len, extra_s)), np.uint64)])
            s, d = np.concatenate([s, *extra_s]), np.concatenate([d, *extra_d])
        sigs.append(mix(total + mix(s * np.uint64(2) + np.uint64(1) + (level[d].astype(np.uint64) << np.uint64(40)))))
        owners.append(d)
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, its hash -> id, hash, node (digest of the set, 0 if empty), n_shingles, parity sketch."""
    for batch in batches:
        for at, data, off in text_chunks(batch.column(1)):
            h, o = shingle_sets(data, off)
            node = set_digests(h, o).astype(np.int64)
            sketch = [parity_sketch(h[a:b]) if b > a else None for a, b in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(off) - 1) for c in (0, 2)), pa.array(node),
                                              pa.array(np.diff(o)), pa.array(sketch, pa.binary())],
                                             ["doc", "th", "node", "n", "sketch"])


def _index(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> a row per bucket and chunk: sets (node, size, number of hashes) and hashes."""
        seen: set[int] = set()
        for batch in batches:
            for _, data, off in text_chunks(batch.column(0)):
                h, o = shingle_sets(data, off)
                node, n = set_digests(h, o), np.diff(o)
                once = np.zeros(len(n), bool)
                for i, x in enumerate(node.tolist()):
                    once[i] = n[i] > 0 and x not in seen
                    seen.add(x)
                keep = np.repeat(once, n)
                h, n, node = h[keep], n[once], node[once]
                sig, who = signatures(h, np.concatenate([[0], np.cumsum(n)]))
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.lexsort((who, bucket))
                sig, who, bucket = sig[order], who[order], bucket[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))) if len(bucket) else []
                rows = []
                for a, b in zip(edge, [*edge[1:], len(bucket)]):
                    d, count = np.unique(who[a:b], return_counts=True)
                    six = (sig[a:b] & LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((int(bucket[a]), node[d].tobytes(), n[d].astype(np.uint32).tobytes(),
                                 count.astype(np.uint32).tobytes(), six.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows) if rows else [[]] * 5, [pa.int64()] + [pa.binary()] * 4)],
                    ["bucket", "nodes", "sizes", "counts", "sigs"])
    return run


def _match(small: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: pairs (a, b) of sets sharing a segment, or (segment, set) for shared segments of
        more than ``small`` sets."""
        get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        node, size = get("nodes", np.uint64), get("sizes", np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(node)), get("counts", np.uint32))
        six = get("sigs", np.uint8).reshape(-1, 6)
        sig = np.zeros((len(six), 8), np.uint8)
        sig[:, :6] = six
        sig = sig.view("<u8").ravel()
        order = np.lexsort((node[row], sig))
        sig, row = sig[order], row[order]
        who = node[row]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])     # copies come from several tasks
        sig, row, who = sig[new], row[new], who[new]
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        k = np.diff(np.append(at, len(sig)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in range(2, small + 1):
            first = at[k == g]
            i, j = np.triu_indices(g, 1)
            left.append((first[:, None] + i).ravel())
            right.append((first[:, None] + j).ravel())
        left, right = np.concatenate(left), np.concatenate(right)
        x, y = size[row[left]], size[row[right]]
        fits = 100 * np.minimum(x, y) >= 80 * np.maximum(x, y)
        pairs = np.unique(np.stack([who[left[fits]], who[right[fits]]], 1), axis=0)
        hot = np.repeat(k > small, k)
        bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(48)
        a = np.concatenate([pairs[:, 0], sig[hot] ^ bucket]).astype(np.int64)
        b = np.concatenate([pairs[:, 1], who[hot]]).astype(np.int64)
        return pa.table({"a": a, "b": b, "hot": np.arange(len(a)) >= len(pairs)})
    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow J >= 0.8."""
    for batch in batches:
        n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
        ok = [sketch_distance(x, y) <= s // 9 for x, y, s in zip(
            batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), n.tolist())]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _compare(table: pa.Table) -> pa.Table:
    """Two blocks of one hot segment: pairs of sets in different components that the sketches allow.
    Sketches are folded to one width, that of the smallest set; sets of a segment are of one band
    or of neighbouring ones."""
    side = table.column("side").to_numpy()
    node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
    sketch = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
    width = min(map(len, sketch))
    folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), 0) for x in sketch])
    i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)     # side 2: the block with itself
    out = [np.zeros((0, 2), np.int64)]
    for x in i:
        y = j[(label[j] != label[x]) & (100 * np.minimum(n[j], n[x]) >= 80 * np.maximum(n[j], n[x]))]
        if len(y):
            y = y[np.bitwise_count(folded[y] ^ folded[x]).sum(1) <= (n[y] + n[x]) // 9]
            out.append(np.stack([np.minimum(node[y], node[x]), np.maximum(node[y], node[x])], 1))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sets_of(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, off in text_chunks(texts):
        h, o = shingle_sets(data, off)
        out += [h[a:b] for a, b in zip(o[:-1], o[1:])]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts: those with 100 * intersection >= 80 * union."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ok = []
            for x, y in zip(_sets_of(part.column("t_a")), _sets_of(part.column("t_b"))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text: rows whose text has the set ``node`` (ids may repeat)."""
    for batch in batches:
        ok = []
        for _, data, off in text_chunks(batch.column("t")):
            ok.append(set_digests(*shingle_sets(data, off)).astype(np.int64))
        if ok:
            yield batch.filter(pc.equal(batch.column("node"), pa.array(np.concatenate(ok))))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, written: first by sketches, then by their whole texts."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")
    near = write_table(near.mapInArrow(_near, "a long, b long"), "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    # one member stands for its set; id and text hash find it, however many rows share its id
    wanted = write_table(wanted.join(classes, "node").select("node", F.col("first.doc").alias("r_doc"), F.col("first.th").alias("r_th")), "wanted")
    hashed = docs.withColumn("th", F.xxhash64(whole("t")))
    texts = hashed.join(small_side(wanted, 500_000), (F.col("th") == F.col("r_th")) & F.col("doc").eqNullSafe(F.col("r_doc"))).select("node", "t")
    texts = write_table(texts.mapInArrow(_own_text, "node long, t string").dropDuplicates(["node"]), "texts")
    of = lambda s: texts.select(F.col("node").alias(s), F.col("t").alias(f"t_{s}"))
    both = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "t_a", "t_b")
    return write_table(both.mapInArrow(_verify, "a long, b long"), "links")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Every row's id (``doc``), hash of its text (``th``), node (its set), n, the component's smallest
    id, and its first member (``first``: without an id or not, id, node, hash of the text)."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    id_type = docs.schema["doc"].dataType.simpleString()
    rows = docs.withColumn("th", F.xxhash64(whole("t"))).mapInArrow(_describe, f"doc {id_type}, th long, node long, n long, sketch binary")
    rows = write_table(rows, "sets")
    member = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "node", "th")
    classes = write_table(rows.where("n > 0").groupBy("node").agg(
        F.min("doc").alias("rep"), F.min(member).alias("first"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(shingles * 0.65) // BUCKET_ROWS)
    found = docs.select("t").mapInArrow(_index(buckets), "bucket long, nodes binary, sizes binary, counts binary, sigs binary")
    found = found.groupBy("bucket").applyInArrow(_match(small), "a long, b long, hot boolean")
    found = write_table(found, "candidates")
    hot = found.where("hot").select(F.col("a").alias("seg"), F.col("b").alias("node"))
    # the pivot is the set in most hot segments: the text that a family's copies were made from
    shared = hot.groupBy("node").agg(F.count(F.lit(1)).alias("in_hot"))
    pivots = hot.join(shared, "node").groupBy("seg").agg(F.max(F.struct("in_hot", "node"))["node"].alias("a"))
    stars = hot.join(pivots, "seg").where("a <> node").select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    pairs = found.where("NOT hot").select("a", "b").union(stars).distinct()
    links = _verified(pairs, classes, docs)
    label = components(links)
    # hot segments that the links so far leave in several components
    named = hot.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("seg").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    split = write_table(named.join(split.select("seg", "k"), "seg").select("seg", "k", "node", "label"), "split")
    if split.limit(1).count():
        parts = F.ceil(F.col("k") / block).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
            F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"),
            F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))).alias("x")
        dealt = (split.withColumn("parts", parts).withColumn("own", own).select("seg", "node", "label", meets)
                 .select("seg", "node", "label", "x.i", "x.j", "x.side").join(classes.select("node", "n", "sketch"), "node"))
        across = dealt.groupBy("seg", "i", "j").applyInArrow(_compare, "a long, b long").distinct()
        more = _verified(across, classes, docs)
        label = components(links.union(more))
    label = write_table(label, "labels")
    of_class = classes.select("node", "rep", "first").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = of_class.groupBy("label").agg(F.min("rep").alias("component"), F.min("first").alias("first"))
    of_class = write_table(of_class.select("node", "label").join(ids, "label").select("node", "component", "first"), "components")
    return rows.drop("sketch").join(of_class, "node", "left").withColumn(
        "component", F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component")))


def digest(docs: DataFrame, **options: int) -> DataFrame:
    return linked(docs, **options).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (null ids last; then by
    set and text). Rows that share this id and this text stay (they are one document, repeated); of
    rows without an id one stays, that with the smallest hash of all its columns. Documents without
    words all stay. Rows are told apart by id and hash of the text."""
    made = linked(docs, id_col, text_col).where("n > 0")
    first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    made = made.groupBy("doc", "th").agg(F.bool_or(first).alias("stays"), F.count(F.lit(1)).alias("copies"))
    doc, th = fresh(docs, "_doc"), fresh(docs, "_th")
    odd = made.where(~F.col("stays") | (F.col("doc").isNull() & (F.col("copies") > 1)))
    odd = write_table(odd.select(F.col("doc").alias(doc), F.col("th").alias(th), "stays"), "gone")
    own_th = F.xxhash64(whole(F.col(f"`{text_col}`").cast("string")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (own_th == F.col(th))
    out = docs.join(small_side(odd.select(doc, th), 500_000), same, "left_anti")
    again = odd.where("stays")
    if not again.limit(1).count():
        return out
    row = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns)])
    again = docs.where(F.col(f"`{id_col}`").isNull()).select(row.alias("row_"), own_th.alias("th_")).join(
        small_side(again.select(F.col(th).alias("th_")), 500_000), "th_", "left_semi")
    again = again.groupBy("th_").agg(F.min_by("row_", F.xxhash64(F.to_json("row_"))).alias("row_"))
    return out.unionByName(again.select(*[F.col("row_")[f"f{i}"].alias(c) for i, c in enumerate(docs.columns)]))
