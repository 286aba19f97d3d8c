"""Incremental ingestion that outlives the application, its failures and its replays."""

import os
import subprocess
import sys
import time

import pytest

from fundlens.sources import month_table as T
from fundlens.streaming import increments as X

HEAD = "CNPJ_FUNDO;DT_COMPTC;VL_QUOTA\n"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
APPLICATION = """
import sys
from fundlens.session import local_session
from fundlens.streaming.increments import ingest_update
spark = local_session(cores=2, shuffle_partitions=2, driver_memory="1g")
print("RECORDS", *ingest_update(spark, sys.argv[1], sys.argv[2]).first())
spark.stop()
"""


def drop(folder, name, *rows, age=0):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"{f};{d};{q}\n" for f, d, q in rows))
    when = time.time() - age
    os.utime(folder / name, (when, when))


def rows_of(spark, table):
    return sorted((r.fund_cnpj, str(r.report_date), r.quota_value, r.ingest_seq) for r in T.read_table(spark, table).collect())


def test_two_applications(spark, tmp_path):
    """The second application ingests only what is new; a restatement in a folder that sorts before
    the first one's wins."""
    land, table = tmp_path / "landing", str(tmp_path / "table")
    drop(land / "z", "m1.csv", ("1", "2024-01-02", 1.0), ("2", "2024-02-01", 2.0))

    def run():
        env = {**os.environ, "PYTHONPATH": ROOT}
        out = subprocess.run([sys.executable, "-c", APPLICATION, str(land), table], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr[-3000:]
        return out.stdout.split("RECORDS ")[1].split("\n")[0]

    assert run() == "2 2 2024-02-01 2"
    drop(land / "a", "m0.csv", ("1", "2024-01-02", 9.0), ("3", "2024-03-01", 3.0))
    assert run() == "3 3 2024-03-01 1"
    assert rows_of(spark, table) == [("1", "2024-01-02", 9.0, 2), ("2", "2024-02-01", 2.0, 1), ("3", "2024-03-01", 3.0, 2)]
    assert T.last_version(spark, table) == 2
    X.ingest_new_files(spark, str(land), table)                      # a third one finds nothing to do
    assert T.last_version(spark, table) == 2


def test_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    land, table = tmp_path / "landing", str(tmp_path / "table")
    drop(land, "m1.csv", ("1", "2024-01-02", 1.0), ("1", "2024-02-01", 2.0))
    X.ingest_new_files(spark, str(land), table)
    before = rows_of(spark, table)
    drop(land, "m2.csv", ("1", "2024-01-02", 5.0), ("1", "2024-03-01", 6.0))
    plain = T.publish

    def broken(*args):
        raise OSError("the store does not answer")
    monkeypatch.setattr(T, "publish", broken)
    with pytest.raises(Exception):
        X.ingest_new_files(spark, str(land), table)
    assert rows_of(spark, table) == before                          # readers see none of it
    monkeypatch.setattr(T, "publish", plain)
    X.ingest_new_files(spark, str(land), table)                     # the batch comes again
    assert rows_of(spark, table) == [("1", "2024-01-02", 5.0, 2), ("1", "2024-02-01", 2.0, 1), ("1", "2024-03-01", 6.0, 2)]
    assert T.expire(spark, table, keep=1) >= 1                      # what the failure left behind
    assert len(rows_of(spark, table)) == 3


def test_replayed_batch_and_lost_progress(spark, tmp_path):
    land, table = tmp_path / "landing", str(tmp_path / "table")
    drop(land, "m1.csv", ("1", "2024-01-02", 1.0), ("1", "2024-01-02", 2.0))
    X.ingest_new_files(spark, str(land), table)
    batch = spark.read.format("binaryFile").load(str(land)).select("path", "modificationTime")
    X.merge_batch(table)(batch, 0)                                  # the same files once more
    assert T.last_version(spark, table) == 1 and [r[2] for r in rows_of(spark, table)] == [2.0]
    os.rename(os.path.join(table, "_progress"), os.path.join(table, "_lost"))
    drop(land, "m2.csv", ("4", "2024-04-02", 4.0))
    X.ingest_new_files(spark, str(land), table)                     # a new stream sees every file
    assert [r[0] for r in rows_of(spark, table)] == ["1", "4"] and T.last_version(spark, table) == 2


def test_two_tables_in_one_application(spark, tmp_path):
    land = tmp_path / "landing"
    drop(land, "m1.csv", ("1", "2024-01-02", 1.0))
    for name in ("one", "two"):
        status = X.ingest_update(spark, str(land), str(tmp_path / name)).first()
        assert (status.total_records, status.new_records_count) == (1, 1)


def test_later_file_wins_within_a_batch_and_over_small_batches(spark, tmp_path):
    land = tmp_path / "landing"
    drop(land, "b.csv", ("1", "2024-01-02", 1.0), age=300)
    drop(land, "c c+%.csv", ("1", "2024-01-02", 2.0), age=200)
    drop(land, "a.csv", ("1", "2024-01-02", 3.0), age=100)
    for name, size in (("one", 1000), ("two", 1)):
        X.ingest_new_files(spark, str(land), str(tmp_path / name), files_per_batch=size)
        assert [r[2] for r in rows_of(spark, str(tmp_path / name))] == [3.0]


def test_versions_and_months(spark, tmp_path):
    table, row = str(tmp_path / "t"), "fund_cnpj string, report_date date, quota_value double, month string"
    import datetime as dt

    def make(*rows):
        return spark.createDataFrame([(f, dt.date(2024, m, 1), q, f"2024-{m:02d}" if m < 12 else None) for f, m, q in rows], row)

    T.commit(spark, table, make(("a", 1, 1.0), ("a", 2, 2.0), ("a", 12, 7.0)), X.KEYS)
    T.commit(spark, table, make(("a", 2, 3.0), ("b", 2, 4.0)), X.KEYS)
    T.commit(spark, table, make(("a", 12, 8.0)), X.KEYS)
    assert [r[2] for r in rows_of(spark, table)] == [1.0, 3.0, 8.0, 4.0]
    assert sorted(r.quota_value for r in T.read_table(spark, table, version=1).collect()) == [1.0, 2.0, 7.0]
    assert sorted(r.quota_value for r in T.read_table(spark, table, ["2024-02"]).collect()) == [3.0, 4.0]
    with pytest.raises(RuntimeError):
        T.publish(spark, table, {"version": 3})
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, str(tmp_path / "none"))
