import gzip
import hashlib

from corpora import CLASHING, same
from fundlens.llm import warc


def pages(spark, extra=()):
    body = "<p>" + "same text " * 40 + "</p>"
    rows = [(1, None), (2, ""), (3, "tiny"), (4, "tiny"), (None, "no id " * 40), (9, body), (5, body), (7, body), (5, body),
            (10, "é" * 50), (11, "é" * 50), (12, "é" * 49), (13, "é" * 49), (14, "x" * 300_000), (15, "WARC/1.1\r\n\r\n" * 30)]
    rows += [(100 + i, f"page {i} " * (i % 90)) for i in range(200)]
    return spark.createDataFrame([(i, "u", h) + (1,) * len(extra) for i, h in rows],
                                 ", ".join(["page_id long, url string, html string", *(f"{c} int" for c in extra)]))


def test_round_trip_matches_sql(spark):
    plain = pages(spark)
    same(warc.digest(pages(spark, CLASHING).repartition(3)), warc.ORACLE, pages=plain)
    assert warc.digest(plain.limit(0)).collect() == []


def test_written_files_are_gzip_members(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark).coalesce(1), path)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("*.txt")))
    text = gzip.decompress(raw)
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: revisit") == 3
    read = warc.read_archives(spark, path)
    assert warc.gaps(read).count() == 0
    found = read.where("page_id = '14'").first()
    assert bytes(found.payload) == b"x" * 300_000


def records(n):
    return [warc.page_record(str(i), hashlib.sha256(b"x" * i).hexdigest(), None, b"x" * i) for i in range(n)]


def ids(found):
    return [h["warc-record-id"][10:-1] for _, _, problem, h, _ in found if problem is None]


def test_salvage_recovers_all_but_the_damaged(spark):
    recs = records(60)
    for parts in ([gzip.compress(r, mtime=0) for r in recs], recs):
        at = [0]
        for p in parts:
            at.append(at[-1] + len(p))
        raw = bytearray(b"".join(parts))
        raw[at[11] - 8] ^= 0xFF                                          # damaged payload or checksum
        raw[at[30]:at[30] + 4] = b"JUNK"                              # no start
        raw = bytes(raw[:at[40]]) + b"some stray bytes" + bytes(raw[at[40]:at[59] + 20])   # inserted, cut short
        found = list(warc.salvage(raw))
        assert ids(found) == [str(i) for i in range(60) if i not in (10, 30, 59)]
        gaps = [(a, b) for a, b, problem, _, _ in found if problem]
        assert gaps == [(at[10], at[11]), (at[30], at[31]), (at[40], at[40] + 16), (at[59] + 16, len(raw))]
        spans = sorted((a, b) for a, b, *_ in found)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(raw)


def test_wrong_length_and_digest(spark):
    good = records(3)
    wrong = good[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    found = list(warc.salvage(good[0] + wrong + good[2]))
    assert ids(found) == ["0", "2"] and sum(x[2] is not None for x in found) == 1
    assert list(warc.salvage(b"")) == []
    assert [x[2] is None for x in warc.salvage(b"nothing here")] == [False]
