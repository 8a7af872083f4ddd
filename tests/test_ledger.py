import datetime as dt
import json
import os

import pytest

from archivemill.plans import ledger
from archivemill.streaming.incremental import mine_new_files
from tests.messages import message
from tests.test_archive import HELD, messages, packed, put


def entries(spark, folder):
    return {r.path[-10:-9]: (r.state, r.reason, r.tries) for r in ledger.current(spark, folder).collect()}


def test_a_broken_file_is_tried_a_stated_number_of_times(spark, tmp_path):
    source, out, book = tmp_path / "in ü%", str(tmp_path / "out"), str(tmp_path / "book")
    whole = packed(message(5, **HELD))
    put(source, "00", packed(message(1, **HELD)))
    put(source, "01", whole[:-4])
    put(source, "02", b"")  # not listed while it is empty
    batches = [ledger.mine_due(spark, str(source), out, book, most_tries=2) for _ in range(4)]
    assert batches == [1, 1, 0, 0]
    assert entries(spark, book) == {"0": ("mined", None, 1), "1": ("broken", "cut off", 2)}
    report = spark.read.text(out).where("kind = 'unusable'").collect()
    assert [json.loads(r.value)["reason"] for r in report] == ["cut off"]
    put(source, "01", whole)  # written anew: its tries start again
    put(source, "02", packed(message(6, **HELD)))
    assert ledger.mine_due(spark, str(source), out, book, most_tries=2) == 1
    assert entries(spark, book) == {"0": ("mined", None, 1), "1": ("mined", None, 1), "2": ("mined", None, 1)}
    assert messages(spark, out) == [("tweets", 1), ("tweets", 5), ("tweets", 6)]
    assert spark.read.text(out).where("kind = 'unusable'").isEmpty()


@pytest.mark.parametrize("stop", ["write_mined", "_end_batch"])
def test_a_run_that_fails_is_taken_up(spark, tmp_path, monkeypatch, stop):
    source, out, book = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "book")
    for i in range(4):
        put(source, f"0{i}", packed(message(i + 1, **HELD)))
    real, calls = getattr(ledger, stop), []

    def failing(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is gone")
        return real(*args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(ledger, stop, failing)
        with pytest.raises(RuntimeError):
            ledger.mine_due(spark, str(source), out, book, files_per_batch=2)
    os.remove(source / "2018" / "05" / "02" / "13" / "03.json.bz2")
    put(source, "07", packed(message(8, **HELD)))
    mine_new_files(spark, str(source), out, book)
    mine_new_files(spark, str(source), out, book)
    found = messages(spark, out)
    assert [m for m in found if m[1] != 4] == [("tweets", 1), ("tweets", 2), ("tweets", 3), ("tweets", 8)]
    assert len(found) == len(set(found)), "no line is doubled"
    states = {k: v[0] for k, v in entries(spark, book).items()}
    assert states.pop("3") in ("mined", "gone") and set(states.values()) == {"mined"}


def test_due_files_are_one_join(spark):
    schema = "path string, uri string, length bigint, time timestamp"
    at = dt.datetime(2018, 5, 2)
    files = spark.createDataFrame([(p, p, 5, at) for p in "abcdef"], schema)
    known = spark.createDataFrame(
        [("a", "a", 5, at, "mined", None, 1, "0"), ("b", "b", 4, at, "mined", None, 1, "0"), ("c", "c", 5, at, "broken", "x", 2, "0"),
         ("d", "d", 5, at, "broken", "x", 3, "0"), ("e", "e", 5, at, "gone", None, 1, "0"), ("z", "z", 5, at, "mined", None, 1, "0")],
        ledger.ENTRY,
    )
    assert sorted((r.path, r.tries) for r in ledger.due(files, known, 3).collect()) == [("b", 0), ("c", 2), ("f", 0)]
    assert ledger.due(files, known.limit(0), 3).count() == 6
