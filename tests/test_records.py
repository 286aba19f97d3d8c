"""Records with quoted line breaks, and files that cannot be read to their end."""

import bz2
import csv
import gzip
import io
import os
import random

import pytest

from fundlens.plans.load import load_raw
from fundlens.sources.files import columns_from_fields, file_report, file_status, scan_csv_tree


def fields(rng):
    """A field as written, quoted where it must be."""
    text = "".join(rng.choice(["a", "b", ";", "\n", '"', " ", "é", "\r\n"]) for _ in range(rng.randrange(6)))
    if any(c in text for c in ';\n\r"') or rng.random() < 0.2:
        return '"' + text.replace('"', '""') + '"', text
    return text, text


def one_file(rng, n, width=3):
    want, lines = [], ["ID;" + ";".join(f"C{i}" for i in range(width))]
    for i in range(n):
        made = [fields(rng) for _ in range(width)]
        lines.append(";".join([str(i), *(w for w, _ in made)]))
        want.append((str(i), *(None if t.strip(" ") == "" else t.replace("\r\n", "\n") for _, t in made)))
    return "\n".join(lines) + "\n", want


def parsed(spark, root, **options):
    rows, headers = scan_csv_tree(spark, str(root), **options)
    cols = columns_from_fields(rows, headers)
    return sorted((tuple(r)[1:] for r in cols.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def test_quoted_line_breaks_for_any_number_of_splits(spark, tmp_path, small_splits):
    rng = random.Random(8)
    want = []
    for name in "abc":
        text, rows = one_file(rng, 300)
        (tmp_path / f"{name}.csv").write_text(text, newline="")
        want += rows
    (tmp_path / "plain.csv").write_text("ID;C0;C1;C2\n9000;x;y;z\n")
    want = sorted([*want, ("9000", "x", "y", "z")], key=repr)
    assert parsed(spark, tmp_path) == want
    size = os.path.getsize(tmp_path / "a.csv")
    for splits in (1, 7, 50):
        small_splits(str(size // splits + 1))
        assert parsed(spark, tmp_path) == want


def test_splits_agree_with_a_csv_reader(spark, tmp_path, small_splits):
    """A record over many splits, and quotes inside fields that open nothing."""
    body = 'ID;C0\n1;"' + "\n".join(["long"] * 400) + '"\n2;5" pipe\n3;a"b;\n4;"x""y"\n5;""\n6;"end\n"\n'
    (tmp_path / "a.csv").write_text(body)
    want = [tuple(r[:2]) for r in csv.reader(io.StringIO(body), delimiter=";") if len(r) == 2][1:]
    want = sorted(((i, t or None) for i, t in want), key=repr)
    for size in ("64", "100000"):
        small_splits(size)
        assert parsed(spark, tmp_path) == want


def test_other_line_ends_and_quoted_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbf\r\n"ID";"C\r\n0"\r\n1;"x\r\ny"\r\n2;z\r\n')
    rows, (header,) = scan_csv_tree(spark, str(tmp_path))
    assert header == '"ID";"C\n0"'
    assert sorted(tuple(r)[1:] for r in columns_from_fields(rows, [header]).collect()) == [("1", "x\ny"), ("2", "z")]
    dos = tmp_path / "dos"
    dos.mkdir()
    (dos / "d.csv").write_bytes('ID;V\r\n1;São\r\n2;"ã\r\né"\r\n'.encode("latin-1"))
    (dos / "m.csv").write_bytes("ID;V\r3;São\r4;plain\r".encode("latin-1"))
    assert parsed(spark, dos) == [("1", "São"), ("2", "ã\né"), ("3", "São"), ("4", "plain")]
    mac = tmp_path / "mac"
    mac.mkdir()
    (mac / "m.csv").write_bytes(b"ID;V\r1;a\r2;b\r")
    assert parsed(spark, mac) == [("1", "a"), ("2", "b")]


def test_failed_files_are_left_out_whole(spark, tmp_path):
    good = "ID;V\n" + "".join(f"{i};{i * 7}\n" for i in range(50_000))
    packed = gzip.compress(good.encode())
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "good.csv.gz").write_bytes(packed + gzip.compress(b"50000;1\n"))
    (tmp_path / "good.csv.bz2").write_bytes(bz2.compress(b"ID;V\n60000;2\n"))
    (tmp_path / "cut.csv.gz").write_bytes(packed[:len(packed) // 2])
    (tmp_path / "wrong.csv.gz").write_bytes(packed[:-8] + bytes(8))
    (tmp_path / "n o+%.csv.gz").write_bytes(b"not a gzip file")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "blank.csv").write_bytes(b"\n \n\n")
    (tmp_path / "open.csv").write_text('ID;V\n70000;a\n70001;"no end\n70002;b\n')
    status = {os.path.basename(r.file): r for r in file_status(spark, str(tmp_path)).collect()}
    assert {n for n, r in status.items() if r.status == "read"} == {"good.csv", "good.csv.gz", "good.csv.bz2"}
    assert status["good.csv.gz"].n_records == 50_001 and status["cut.csv.gz"].n_records is None
    assert all(r.reason for n, r in status.items() if not n.startswith("good"))
    assert status["empty.csv"].reason == "empty file" and "cut short" in status["cut.csv.gz"].reason and "without end" in status["open.csv"].reason
    ids = sorted(int(i) for i, _ in parsed(spark, tmp_path, glob="*.csv*"))
    assert ids == sorted([*range(50_000), *range(50_000), 50_000, 60_000])
    assert tuple(file_report(spark, str(tmp_path)).first()) == (9, 3, 6, 50_000 + 50_001 + 1)
    assert load_raw(spark, str(tmp_path)).count() >= 0


def test_the_data_pass_tolerates_nothing(spark, tmp_path):
    """A file that breaks after the probe stops the job instead of losing rows."""
    rows = "ID;V\n" + "".join(f"{i};{i}\n" for i in range(50_000))
    path = tmp_path / "a.csv.gz"
    path.write_bytes(gzip.compress(rows.encode()))
    df, _ = scan_csv_tree(spark, str(tmp_path), glob="*.gz")
    path.write_bytes(path.read_bytes()[:60_000])
    with pytest.raises(Exception):
        df.count()


def test_sample_is_the_same_for_any_layout(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("ID;V\n" + "".join(f"{i};{i % 7}\n" for i in range(2000)))
    (tmp_path / "b.csv").write_text("ID;V\n" + "".join(f"{i};x\n" for i in range(5000, 5040)))
    first = parsed(spark, tmp_path, sample_size=100)
    assert 60 < sum(int(i) < 5000 for i, _ in first) < 150 and sum(int(i) >= 5000 for i, _ in first) == 40
    small_splits("2000")
    assert parsed(spark, tmp_path, sample_size=100) == first != parsed(spark, tmp_path, sample_size=100, seed=7)
