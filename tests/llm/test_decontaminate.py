import random

from corpora import CLASHING, corner_rows, make, same, sentence
from fundlens.llm import decontaminate


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted(seed=2):
    rng = random.Random(seed)
    items = [(i, sentence(rng, n, 300)) for i, n in enumerate((10, 11, 40, 64, 12, 25))]
    items += [(20, "short item of five words"), (21, "solo"), (22, None), (23, "  "), (None, sentence(rng, 30)), (24, items[2][1]), (20, "w1 w2")]
    docs = corner_rows()
    for n, (_, text) in enumerate(items):
        ws = (text or "").split()
        docs.append((500 + n, sentence(rng, 30) + " " + (text or "") + ", " + sentence(rng, 30), "a"))
        docs.append((600 + n, sentence(rng, 3000) + " " + " ".join(ws[3:14]).upper() + " " + sentence(rng, 20), "a"))
        docs.append((700 + n, " ".join(ws[:9]) + " zzz " + " ".join(ws[9:18]), "a"))
    # passages across the cut of a piece, repeated, and overlapping themselves
    docs += [(800 + d, sentence(rng, 2040 + d) + " " + items[2][1] + " " + sentence(rng, 50), "b") for d in range(0, 14)]
    docs += [(900, (items[0][1] + " ") * 5, "b"), (901, "same " * 60, "b")]
    return docs, items + [(30, "same " * 14), (31, "same " * 30)]


def test_matches_sql(spark):
    docs, items = planted()
    d, b = make(spark, docs, CLASHING), bench(spark, items)
    same(decontaminate.digest(d, b), decontaminate.oracle(), documents=make(spark, docs), benchmark=b)


def test_empty_sides(spark, corners):
    b = bench(spark, [(1, "a b")])
    same(decontaminate.digest(corners, b.limit(0)), decontaminate.oracle(), documents=corners, benchmark=b.limit(0))
    assert decontaminate.digest(corners.limit(0), b).collect() == []


def test_documents_without_hits_stay(spark):
    docs, items = planted()
    d, b = make(spark, docs, CLASHING), bench(spark, items)
    out = decontaminate.decontaminated(d, b)
    assert out.columns == d.columns
    bad = sum(r.contaminated for r in decontaminate.digest(d, b).collect())
    assert bad > 20 and out.count() == d.count() - bad
