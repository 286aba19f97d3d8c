"""Operator 2, URL filters: gradient-boosted trees on lexical features of the URL.

Rules decide the URLs they fit, the longest one first. These URLs are the labelled ones: a boosted
tree model learns from their lexical features (lengths, depth, digit ratio, entropy, parameter
counts, suffix statistics) and judges the URLs that no rule fits.

Suffix statistics (label counts by the host's last label, last two labels and the first path
segment) cover all labelled URLs. They are kept by hashed bucket, so the table is bounded by
construction (``BUCKETS * FOLDS`` rows for each kind) and may be broadcast. When learning, a URL's
statistics come from the other folds, so that its own label does not show in them. The model alone is fitted on a bounded sample of
distinct URLs: of each label the ``TRAIN_ROWS / 2`` with the smallest hashes, weighted back to the label's number of distinct URLs, so both
labels are always in the fit. Only (label, hash) of the distinct labelled URLs is shuffled; scoring is one pass without a shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by its features; repeated rows get equal verdicts; without labelled URLs of both kinds the
verdict is the only label there is, or ``allow``; an empty table gives an empty result; further
columns are ignored by ``judge`` and returned by ``allowed``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .text import let, lower_ascii, pinned, whole

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BUCKETS = 4096
TRAIN_ROWS = 20_000
FOLDS = 5
TREES, DEPTH = 20, 4
PRIOR = 5.0                                                  # weight of the overall rate in a suffix's rate
KINDS = ("last_label", "domain", "first_segment")
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
            "query_length", "hyphens", "secure", "slash_end", "fragment") + tuple(
                f"{k}_{m}" for k in KINDS for m in ("rate", "seen"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    def of(t):
        share = lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t)
        bits = F.transform(F.array_distinct(F.array_remove(F.split(t, ""), "")), lambda c: let(share(c), lambda p: -p * F.log2(p)))
        return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)
    return let(text, of)


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def lexical(pages: DataFrame, keep: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """``keep``, host, path, rule, label (the rule's verdict), lexical features and suffix buckets."""
    u = whole(F.col(f"`{url_col}`"))
    host, path = host_and_path(u)
    df = pinned(pages, keep, url_=u, host=host, path=path)
    u, host, path = F.col("url_"), F.col("host"), F.col("path")
    rule, label = fitting_rule(host, path, rules)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    suffix = {"last_label": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
              "first_segment": F.regexp_extract(path, r"^/([^/]*)", 1)}
    made = {
        "rule": rule, "label": label, "key": F.xxhash64(u), "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count_of(path, "/"), "labels": count_of(host, "."),
        "digit_ratio": count_of(u, "0123456789") / F.greatest(F.length(u), F.lit(1)), "entropy": entropy(u),
        "parameters": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1), "query_length": F.length(query),
        "hyphens": count_of(host, "-"), "secure": u.startswith("https:").cast("double"),
        "slash_end": path.endswith("/").cast("double"), "fragment": F.contains(u, F.lit("#")).cast("double"),
        **{f"{k}_bucket": F.pmod(F.xxhash64(s), F.lit(BUCKETS)).cast("int") for k, s in suffix.items()}}
    return pinned(df, keep + ["host", "path"], **made)


def fold() -> Column:
    return F.pmod(F.shiftright("key", 20), F.lit(FOLDS)).cast("int")


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(kind, bucket, fold, n, good) over all labelled URLs; at most ``BUCKETS * FOLDS`` rows a kind."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_bucket").alias("bucket")) for k in KINDS])).alias("s")
    return (rows.where("label IS NOT NULL").select("label", fold().alias("fold"), kinds)
            .groupBy("s.kind", "s.bucket", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "allow").alias("good")))


def with_statistics(rows: DataFrame, stats: DataFrame, overall: float, own: bool) -> DataFrame:
    """Rows with the rate of ``allow`` in their suffixes' buckets and how often these were seen;
    ``own``: in the other folds than the row's."""
    rows = rows.withColumn("fold", fold())
    for k in KINDS:
        mine = stats.where(F.col("kind") == k)
        per = mine.groupBy("bucket").agg(F.sum("n").alias("n_"), F.sum("good").alias("good_"))
        if own:
            out = mine.select("bucket", F.col("fold").alias("fold_"), F.col("n").alias("n_out"), F.col("good").alias("good_out"))
            every = per.select("bucket", "n_", "good_", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold_"))
            per = every.join(out, ["bucket", "fold_"], "left").select(
                F.col("bucket").alias(f"{k}_bucket"), F.col("fold_").alias("fold"),
                (F.col("n_") - F.coalesce("n_out", F.lit(0))).alias("n_"), (F.col("good_") - F.coalesce("good_out", F.lit(0))).alias("good_"))
        else:
            per = per.withColumnRenamed("bucket", f"{k}_bucket")
        rows = rows.join(F.broadcast(per), [f"{k}_bucket", *["fold"][:own]], "left")      # at most BUCKETS * FOLDS rows
        n, good = F.coalesce("n_", F.lit(0)), F.coalesce("good_", F.lit(0))
        rows = rows.withColumn(f"{k}_rate", (good + PRIOR * overall) / (n + PRIOR)).withColumn(f"{k}_seen", F.log1p(n)).drop("n_", "good_")
    return rows


def fit(rows: DataFrame, stats: DataFrame, train_rows: int = TRAIN_ROWS):
    """(model or None, overall rate of ``allow``)."""
    total = stats.where(F.col("kind") == KINDS[0]).agg(F.sum("n"), F.sum("good")).first()
    n, good = total[0] or 0, total[1] or 0
    if good in (0, n):
        return None, (good / n if n else 1.0)
    keys = write_table(rows.where("label IS NOT NULL").select("label", "key").distinct(), "keys")
    distinct = dict(keys.groupBy("label").count().collect())
    part = max(1, train_rows // 2)
    taken = [keys.where(F.col("label") == v).orderBy("key").limit(part).withColumn("weight", F.lit(max(1.0, m / part))) for v, m in sorted(distinct.items())]
    taken = write_table(reduce(DataFrame.union, taken), "taken")
    sample = rows.join(F.broadcast(taken), ["label", "key"]).dropDuplicates(["key"])                # at most TRAIN_ROWS rows
    sample = write_table(with_statistics(sample, stats, good / n, True).orderBy("key").select(
        *[F.col(f).cast("double") for f in FEATURES], (F.col("label") == "allow").cast("double").alias("y"), "weight"), "urls").coalesce(2)
    gbt = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=2, maxBins=32)
    return gbt.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample)), good / n


def judge(pages: DataFrame, keep: list[str], url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keep``, host, path, rule, verdict and the model's score (chance of ``allow``)."""
    rows = lexical(pages, keep, url_col, rules)
    stats = write_table(suffix_statistics(rows), "suffixes")
    model, overall = fit(rows, stats, train_rows)
    rows = with_statistics(rows, stats, overall, False)
    if model is None:
        rows = rows.withColumn("score", F.lit(float(overall)))
    else:
        rows = rows.select(*keep, "host", "path", "rule", "label", *[F.col(f).cast("double") for f in FEATURES])
        rows = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("label", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return rows.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "score")


def allowed(pages: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The pages whose URL is allowed, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(pages.columns)])
    out = judge(pages.select(row.alias("row_"), F.col(f"`{url_col}`").alias("u_")), ["row_"], "u_", **options)
    return out.where("verdict = 'allow'").select(*[F.col("row_")[f"f{i}"].alias(c) for i, c in enumerate(pages.columns)])


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), ["page_id"])
