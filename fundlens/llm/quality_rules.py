"""Operator 9, quality rules: a bitmask ledger.

Every rule is evaluated once per document, over the whole text, and leaves one failure bit and its
measurements in the ledger. Policies are versioned bit masks applied afterwards: trying another
policy, or asking which documents a single rule costs (an ablation), is integer arithmetic on the
ledger and reads no text again. Built-in expressions only; one pass, no shuffle.

Defined cases: a null or empty text has no words and fails ``few_words``; a null id is kept as it
is; equal rows get equal ledger rows each; an empty table gives an empty ledger; other columns are
ignored by ``ledger`` and returned unchanged by ``keep``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, UPPER, fresh, grams, let, pinned, total, whole, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

# rule -> failing condition on the measurements; the bit is the rule's place in this list
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 50 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 60 * word_chars",
}
BIT = {rule: 1 << i for i, rule in enumerate(RULES)}

# version -> rules; a published version is never changed, a new one is added
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def repeated_words(ws: Column, k: int = 3) -> Column:
    """Number of words inside a window of ``k`` words that occurs twice or more in the same text
    (windows equal by 64-bit hash). Texts without a repeated window only pay for a hash set; the
    others sort (hash, position) and add up the union of their windows."""
    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        found = let(placed, lambda s: F.array_sort(F.array_compact(F.transform(
            s, lambda x, i: F.when((x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]), x["p"])))))
        # each window adds the words up to the next one's start, at most k; the last one all k
        width = lambda p: total(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)),
                                           lambda a, b: F.least(F.lit(k), b - a)))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(found, width)).otherwise(F.lit(0).cast("long"))

    return let(grams(ws, k), of_hashes)


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the measurements, each expression evaluated once."""
    t = whole(F.col(f"`{text_col}`"))
    a, b = fresh(docs, "_words"), fresh(docs, "_lines")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = pinned(docs.withColumn(fresh(docs, "_t"), t), keep + [fresh(docs, "_t")],
                  **{a: words(t, SPACE), b: lines})
    t, ws, ls = F.col(fresh(docs, "_t")), F.col(a), F.col(b)
    dropped = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    return pinned(step, keep, n_words=F.size(ws).cast("long"),
                  word_chars=F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
                  n_symbols=dropped(SYMBOLS),
                  n_dup_lines=(F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
                  n_repeat_words=let(ws, repeated_words),
                  n_lines=F.size(ls).cast("long"), n_upper=dropped(UPPER))


def fail_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(BIT[r])).otherwise(F.lit(0)) for r, cond in RULES.items()),
               F.lit(0)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``."""
    return measured(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), [id_col], text_col
                    ).withColumn("fail_bits", fail_bits())


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and documents that fail it alone (what
    dropping the rule would bring back). The ledger is first counted by bit pattern, at most
    2 ** rules rows."""
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
                 F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone")))


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that ``policy`` accepts, with ``docs``' own columns."""
    box, renamed = fresh(docs, "_row"), fresh(docs, "_text")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(box),
                        F.col(f"`{text_col}`").alias(renamed))
    out = measured(boxed, [box], renamed).withColumn("fail_bits", fail_bits()).where(passes(policy))
    return out.select(*[F.col(box)[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The query's columns: base measurements, the base verdict and the policy's."""
    led = ledger(docs)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~passes("base")).alias("base_failed"),
                      (passes("base") & passes(policy)).alias("kept"), "n_lines", "n_upper", "fail_bits")


def oracle(policy: str = "v1") -> str:
    """DuckDB SQL for ``digest``: windows are compared as strings, not hashes."""
    bits = " + ".join(f"CASE WHEN {c} THEN {BIT[r]} ELSE 0 END" for r, c in RULES.items())
    upper = f"length(t) - length(translate(t, '{UPPER}', ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS win FROM g),
r AS (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM
      (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM k) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT q) AS c FROM r GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n.c, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, ({upper})::BIGINT AS n_upper
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask('base')}) <> 0 AS base_failed,
       (fail_bits & {mask('base')}) = 0 AND (fail_bits & {mask(policy)}) = 0 AS kept, n_lines, n_upper, fail_bits
FROM b"""
