"""Operator 4, benchmark decontamination by winnowing.

Fingerprints: of the hashes of all runs of K = 5 words, the smallest of every W = 6 neighbouring
ones is kept (the last one if equal). Any shared span of W + K - 1 = 10 words holds the same W
hashes on both sides, so both sides keep the same one: joining fingerprints finds every shared
10-word window. Each hit is then compared word by word and extended along its diagonal, by up to
five words either way (as far as a window through this fingerprint can reach); what reaches 10
words is a run of windows, and the union of these runs is exactly the set of hit words. An item of
fewer words is one window; its fingerprint is its smallest word hash (K = 1, W = its length), looked
up among all words of the documents.

Scale: one scan of the documents. Long texts are cut into overlapping pieces, so arrays stay short
and positions fit beside the hash in one long. Fingerprints meet the benchmark's in a broadcast
join only if a bounded count proves the benchmark's side small; else Spark shuffles both and splits
skewed hashes. Only hits and one narrow row per document are shuffled. Built-in expressions only.

Defined cases: null or empty texts have no words, no windows and no hits; a null item id is
written as an empty string; two items of one id count as one; rows equal in id and text get equal
results, one row each; empty tables on either side give no hits; further columns are ignored by
``scan`` and returned by ``decontaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import small_side
from .text import NOT_ALNUM, fresh, let, lower_ascii, pinned, whole, words

SPAN, K = 10, 5
W = SPAN - K + 1
PIECE = 2048                     # words that start in a piece; it holds SPAN - 1 more
POS_BITS = 12                    # 2 ** 12 > PIECE + SPAN


def pieces(df: DataFrame, keep: list[str], text: Column, first: dict[str, Column] | None = None) -> DataFrame:
    """``keep``, n_words, and a row for each piece: ``start`` and ``piece`` (words). A text without
    words has one empty piece."""
    tokens = pinned(df, keep, ws=words(lower_ascii(whole(text)), NOT_ALNUM))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(PIECE)),
                      lambda s: F.struct(s.alias("start"), F.slice("ws", s + 1, PIECE + SPAN - 1).alias("piece")))
    return tokens.select(*keep, F.size("ws").cast("long").alias("n_words"), F.inline(cut))


def fingerprints(piece: Column) -> Column:
    """Winnowed fingerprints of a piece: hash in the upper bits, below it the position counted
    backwards, so that the smallest value of a window is its smallest hash, the last one of those."""
    top = (1 << POS_BITS) - 1
    packed = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - (K - 1)), lambda i: F.xxhash64(
        F.slice(p, i, K)).bitwiseAND(F.lit(~top)).bitwiseOR(F.lit(top + 1).cast("long") - i))
    least = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (W - 1)),
                                                   lambda i: F.array_min(F.slice(h, i, W))))
    return F.when(F.size(piece) >= SPAN, let(piece, lambda p: let(packed(p), least))).otherwise(
        F.array().cast("array<bigint>"))


def place(v: Column) -> Column:
    """Position (from 0) of a fingerprint's first word in its piece."""
    top = (1 << POS_BITS) - 1
    return (F.lit(top) - v.bitwiseAND(F.lit(top))).cast("int")


def before(piece: Column, at: Column) -> Column:
    n = F.least(at, F.lit(SPAN - K))
    return F.reverse(F.slice(piece, at - n + 1, n))


def after(piece: Column, at: Column) -> Column:
    return F.slice(piece, at + K + 1, F.lit(SPAN - K))


def common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)),
               lambda e: let(F.array_position(e, False), lambda p: F.when(p == 0, F.size(e)).otherwise(p - 1).cast("int")))


def item_prints(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of long items (hash, item, the words around), and short items by their smallest
    word hash."""
    cut = pieces(items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                              F.col(f"`{text_col}`").alias("t")), ["item"], F.col("t"))
    cut = write_table(cut.where("n_words > 0"), "items")
    prints = cut.where(f"n_words >= {SPAN}").select("item", "piece", F.explode(fingerprints(F.col("piece"))).alias("v"))
    at = place(F.col("v"))
    long_ones = prints.select(F.shiftright("v", POS_BITS).alias("fp"), "item", F.slice("piece", at + 1, K).alias("i_gram"),
                              before(F.col("piece"), at).alias("i_before"), after(F.col("piece"), at).alias("i_after")).distinct()
    hashed = F.transform("piece", lambda w: F.xxhash64(w))
    short = (cut.where(f"n_words < {SPAN}")
             .select("item", F.col("piece").alias("i_words"), hashed.alias("h")).withColumn("word_hash", F.array_min("h"))
             .select("item", "i_words", "word_hash", (F.array_position("h", F.col("word_hash")) - 1).cast("int").alias("i_at")).distinct())
    return write_table(long_ones, "prints"), write_table(short, "short")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text") -> DataFrame:
    """Rows (doc, th, n_words, lo, hi, item): runs of hit words [lo, hi), and for every document row
    one row with a null item. ``th`` hashes the text."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(whole(F.col(f"`{text_col}`"))).alias("th"),
                       F.col(f"`{text_col}`").alias("t"))
    cut = pieces(base, ["doc", "th"], F.col("t"))
    long_ones, short = item_prints(items, item_id_col, item_text_col)
    # a null beside the first piece's fingerprints stands for the document itself
    marks = F.when(F.col("start") == 0, F.concat(F.array(F.lit(None).cast("long")), fingerprints(F.col("piece")))
                   ).otherwise(fingerprints(F.col("piece")))
    prints = cut.select("doc", "th", "n_words", "start", "piece", F.explode(marks).alias("v"))
    joined = prints.join(small_side(long_ones), F.shiftright("v", POS_BITS) == F.col("fp"), "left")
    joined = joined.where("v IS NULL OR item IS NOT NULL")
    at = place(F.col("v"))
    same = F.slice("piece", at + 1, K) == F.col("i_gram")
    spans = pinned(joined.withColumn("at", at), ["doc", "th", "n_words", "start", "item", "at", "v"],
                   left=F.when(same, common(before(F.col("piece"), F.col("at")), F.col("i_before"))),
                   right=F.when(same, common(after(F.col("piece"), F.col("at")), F.col("i_after"))))
    spans = spans.where(F.col("v").isNull() | (F.col("left") + F.col("right") + K >= SPAN)).select(
        "doc", "th", "n_words", (F.col("start") + F.col("at") - F.col("left")).alias("lo"),
        (F.col("start") + F.col("at") + K + F.col("right")).alias("hi"), "item")
    if short.limit(1).count() == 0:
        return spans
    each = cut.select("doc", "th", "n_words", "start", "piece", F.posexplode("piece").alias("p", "w"))
    found = each.join(small_side(short), F.xxhash64("w") == F.col("word_hash"))
    begin, n = F.col("p") - F.col("i_at"), F.size("i_words")
    # a piece's last SPAN - 1 words start windows of the next piece
    found = found.where((begin >= 0) & (begin < PIECE)).where(
        F.slice("piece", F.greatest(begin, F.lit(0)) + 1, n) == F.col("i_words"))
    return spans.unionByName(found.select("doc", "th", "n_words", (F.col("start") + begin).alias("lo"),
                                          (F.col("start") + begin + n).alias("hi"), "item"))


def scan(docs: DataFrame, items: DataFrame, **cols: str) -> DataFrame:
    """Per (doc, th): n_words, copies (rows of the input), n_hit, spans, item ids."""
    h = hits(docs, items, **cols)
    g = h.groupBy("doc", "th").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("item").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("lo", "hi")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], x["hi"]).alias("end")))["n"]
    return g.withColumn("n_hit", covered.cast("long"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    g = scan(docs, items)
    one_each = g.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return one_each.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                           F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                           (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols: str) -> DataFrame:
    """``docs`` without the documents that share a window with the benchmark."""
    bad = write_table(scan(docs, items, id_col=id_col, text_col=text_col, **cols).where("n_hit > 0").select("doc", "th"), "leaks")
    doc, th = fresh(docs, "_doc"), fresh(docs, "_th")
    bad = bad.select(F.col("doc").alias(doc), F.col("th").alias(th))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (F.xxhash64(whole(F.col(f"`{text_col}`"))) == F.col(th))
    return docs.join(small_side(bad), same, "left_anti")


def oracle() -> str:
    """DuckDB SQL for ``digest``: all windows as strings, no fingerprints."""
    ws = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ws} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {ws} AS ws FROM benchmark),
i AS (SELECT item, ws, least(len(ws), {SPAN}) AS l FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, l, array_to_string(ws[p:p + l - 1], ' ') AS win
       FROM (SELECT item, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM i)),
dw AS (SELECT rid, p, l, array_to_string(ws[p:p + l - 1], ' ') AS win
       FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM i) WHERE len(ws) >= l)),
h AS (SELECT rid, p, dw.l, item FROM dw JOIN iw USING (l, win)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""
