"""Small corpora and comparisons shared by the tests."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves
CLASHING = ("doc", "node", "key", "size", "bucket", "row", "t", "th", "ws", "place", "label", "copies", "_words", "_r", "u", "block")


def make(spark, rows, extra=()):
    """documents from (doc_id, text, source), with further columns ``extra`` (all 1)."""
    data = [(i, t, None, s, None) + (1,) * len(extra) for i, t, s in rows]
    return spark.createDataFrame(data, ", ".join([COLUMNS, *(f"{c} int" for c in extra)]))


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corner_rows(seed=1):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties."""
    rng = random.Random(seed)
    long_text = sentence(rng, 9000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (None, "one two", "b"), (None, None, None),
            (4, long_text, "a"), (5, long_text + " tail", "b"), (6, "A b C", "b"), (7, "a B c", None)]
    rows += [(8, sentence(rng, 80), "c")] * 3 + [(9, "x " * 200, "c"), (10, "é ü 漢字 \U0001F600 ß", "c"), (10, "another text with this id", "c")]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 300)), "abc"[i % 3]) for i in range(60)]
    return rows


def duck(sql, **tables):
    """Rows of ``sql`` over pandas tables, columns in alphabetical order."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    out = con.sql(sql)
    cols = sorted(out.columns)
    return cols, plain([dict(zip(out.columns, r)) for r in out.fetchall()], cols)


def plain(rows, cols):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=repr)


def same(df, sql, **tables):
    """The DataFrame's rows are those of the SQL."""
    cols, want = duck(sql, **{k: arrow(v) for k, v in tables.items()})
    assert sorted(df.columns) == cols
    assert plain([r.asDict() for r in df.collect()], cols) == want


def arrow(df):
    import pyarrow as pa
    return df if isinstance(df, pa.Table) else df.toArrow()
