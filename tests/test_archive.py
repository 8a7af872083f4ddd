import bz2
import io
import json
import os
import shutil

import pytest

from archivemill.operators.mining import mine_read
from archivemill.plans.mine import mine_archive
from archivemill.plans.parse import mine_and_parse
from archivemill.schema import TABLES
from archivemill.sources import archive_source, unpacking
from archivemill.sources.archive import archive_lines, json_lines, mined_lines, read_archive, skipped_files
from archivemill.sources.tables import read_table
from archivemill.streaming.incremental import mine_new_files, stream_mining
from tests.messages import message

HELD = {"withheld_in_countries": ["TR"]}


def put(root, minute, data: bytes, hour="13"):
    folder = root / "2018" / "05" / "02" / hour
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{minute}.json.bz2").write_bytes(data)


def _second_block(packed: bytes) -> int:
    """Bit position of the second block's mark."""
    bits = bin(int.from_bytes(b"\1" + packed, "big"))[3:]
    mark = f"{0x314159265359:048b}"
    return bits.index(mark, bits.index(mark) + 1)


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    body = "".join(f'{{"n": {i}, "pad": "{i * 7919 % 10007}"}}\n' for i in range(20000)).encode()
    assert len(body) > 200_000
    packed = bz2.compress(body, 1)
    put(root, "00", packed)
    put(root, "01", packed[: len(packed) // 2])
    flipped = bytearray(packed)
    flipped[len(packed) // 2] ^= 0xFF
    put(root, "02", bytes(flipped))
    put(root, "03", bz2.compress(b'{"a": 1}\r\n') + bz2.compress(b'\n{"a": 2}\r{"a": 3}'), hour="14")
    put(root, "04", bz2.compress(b""), hour="14")
    two_blocks = packed
    put(root, "05", two_blocks[:-3])
    put(root, "06", two_blocks[: _second_block(two_blocks) // 8 + 3])
    put(root, "07", b"")
    (root / "2018" / "05" / "02" / "notes.txt").write_text("{}")
    return str(root)


def per_file(df):
    return {r.file[-16:-9]: (r["count"], r.n) for r in df.groupBy("file").agg(
        {"*": "count", "line": "max"}).withColumnsRenamed({"count(1)": "count", "max(line)": "n"}).collect()}


@pytest.mark.parametrize("direct", [True, False])
def test_broken_files_give_no_lines(spark, archive, direct):
    df = read_archive(spark, archive, direct=direct).where("reason IS NULL")
    assert {k: v[0] for k, v in per_file(df).items()} == {"2/13/00": 20000, "2/14/03": 3}
    rows = df.filter("file like '%14/03%'").orderBy("line").collect()
    assert [(r.line, r.value) for r in rows] == [(0, '{"a": 1}'), (2, '{"a": 2}'), (3, '{"a": 3}')]


def test_a_file_larger_than_what_is_held_gives_the_same_lines(spark, archive, monkeypatch):
    monkeypatch.setattr(unpacking, "HELD_BYTES", 1000)
    monkeypatch.setattr(unpacking, "STEP_BYTES", 700)
    monkeypatch.setattr(unpacking, "BLOCK_BYTES", 5000)
    for minute, count in (("13/00", 20000), ("13/01", 0), ("13/02", 0), ("13/06", 0), ("14/03", 3)):
        folder = f"{archive}/2018/05/02/{minute}.json.bz2"
        batches = [b.to_pylist()[0] for b in unpacking.unpacked("f", lambda folder=folder: open(folder, "rb"))]
        assert all(b["reason"] is None for b in batches) == (count > 0)
        found = []
        for b in batches if count else []:
            lines = b["text"].splitlines()
            assert b["first"] == len(found) or minute == "14/03"
            found += [line for line in lines if line]
        assert len(found) == count
        if minute == "13/00":
            assert [json.loads(line)["n"] for line in found] == list(range(20000))


def test_repetitive_text_is_streamed(spark, tmp_path):
    """A file whose text is more than fifty times as long."""
    line = json.dumps(message(1, text="x" * 1000)).encode() + b"\n"
    packed = bz2.compress(line * 20_000)
    assert len(line) * 20_000 > 50 * len(packed)
    put(tmp_path, "00", packed)
    found = archive_lines(spark, str(tmp_path)).agg({"line": "max", "block": "max", "*": "count"}).first()
    assert (found["max(line)"], found["count(1)"]) == (19_999, 20_000) and found["max(block)"] > 0


def test_line_ends_across_steps():
    steps = [b"a\r", b"\nb\r", b"c\n\n", b"d\r\n", b"\re"]
    whole = list(unpacking._whole_lines(iter(steps)))
    assert [line for step in whole for line in step.splitlines()] == b"".join(steps).splitlines()


def test_the_content_is_scanned_once_and_a_mining_run_has_no_shuffle_before_its_result(spark, archive):
    for direct, scan in ((True, "message_archive"), (False, "binaryFile")):
        plan = mine_read(read_archive(spark, archive, direct=direct))._jdf.queryExecution().executedPlan().toString()
        assert plan.count(scan) == 1 and "Exchange" not in plan and "Sort" not in plan


def test_skipped_files_are_listed(spark, archive):
    found = {r.path[-16:-9]: r.reason for r in skipped_files(spark, archive).collect()}
    cut = "cut off"
    listed = {"2/13/01": cut, "2/13/02": "damaged", "2/13/05": cut, "2/13/06": cut}
    assert found == {**listed, "2/13/07": "empty"}
    through_spark = read_archive(spark, archive, direct=False).where("reason IS NOT NULL").collect()
    assert {r.file[-16:-9]: r.reason for r in through_spark} == listed, "Spark lists no empty file"


def test_both_readers_give_the_same_lines(spark, archive):
    one, other = (read_archive(spark, archive, direct=d).where("reason IS NULL").drop("block") for d in (True, False))
    a, b = (sorted(map(tuple, d.drop("reason").collect())) for d in (one, other))
    assert a == b
    parts = [f"{archive}/2018/05/02/13/00.json.bz2", f"{archive}/2018/05/02/14"]
    assert archive_lines(spark, parts).count() == 20003


def test_files_are_dealt_by_size(tmp_path):
    files = [archive_source.File(1, f"{i:02}", 100 if i != 3 else 10_000) for i in range(8)]
    cost = archive_source.OPEN_BYTES + 100
    dealt = [s.paths for s in archive_source.shares(files, 2 * cost)]
    assert dealt == [["00", "01"], ["02"], ["03"], ["04", "05"], ["06", "07"]] and archive_source.shares([], 9) == []
    with pytest.raises(FileNotFoundError):
        archive_source.files_below([str(tmp_path / "none")])


def test_an_error_of_the_store_is_no_broken_file(tmp_path):
    class Failing(io.RawIOBase):
        def readable(self):
            return True

        def readinto(self, _):
            raise OSError("the disk is gone")

    raw = archive_source._Raw(__file__)
    raw.file.close()
    raw.file = Failing()
    with pytest.raises(archive_source.StoreError):
        list(unpacking.unpacked("f", lambda: raw))
    with pytest.raises(archive_source.StoreError):
        list(archive_source.read_files([str(tmp_path / "gone.bz2")]))


def test_a_stream_mines_files_as_they_appear(spark, tmp_path):
    root, folder, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def step():
        stream_mining(spark, str(root), folder, checkpoint).awaitTermination()
        lines = mined_lines(spark, folder)
        return sorted(json.loads(r.value)["id"] for r in lines.collect())

    put(root, "00", packed(message(1, **HELD), message(2)))
    whole = packed(message(5, **HELD))
    put(root, "01", whole[:-4])
    assert step() == [1] and step() == [1]
    put(root, "02", packed(message(3, **HELD)))
    put(root, "01", whole)  # now uploaded to its end
    assert step() == [1, 3, 5]
    report = spark.read.text(folder).where("kind = 'unusable'").collect()
    assert [json.loads(r.value)["reason"] for r in report] == ["cut off"]
    early = root / "2018" / "05" / "02" / "13" / "02.json.bz2"
    os.utime(early)  # a file written anew is read again
    assert step() == [1, 3, 3, 5]


def test_json_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "a.json.part").write_text('{"a": 0}\n')
    (tmp_path / "c.txt").write_text('{"a": 9}\n')
    rows = json_lines(spark, str(tmp_path)).orderBy("file", "block", "line").collect()
    assert [r.value for r in rows] == ['{"a": 0}', '{"a": 1}', '{"a": 2}']


def packed(*messages):
    return bz2.compress("\n".join(json.dumps(m) for m in messages).encode())


def mined(spark, folder):
    return sorted((r.kind, str(r.date), json.loads(r.value)["id"]) for r in spark.read.text(folder).collect())


def test_mine_an_archive_twice_appends(spark, tmp_path):
    put(tmp_path / "in", "00", packed(message(1, **HELD), {"id": 2, **HELD}, message(3)))
    out = str(tmp_path / "out")
    mine_archive(spark, str(tmp_path / "in"), out)
    once = [("messages", "2018-05-02", 2), ("tweets", "2018-05-02", 1)]
    assert mined(spark, out) == once
    mine_archive(spark, str(tmp_path / "in"), out)
    assert mined(spark, out) == sorted(once * 2)


def test_a_mining_run_lists_the_broken_files(spark, archive, tmp_path):
    mine_archive(spark, archive, str(tmp_path / "out"))
    rows = spark.read.text(str(tmp_path / "out")).where("kind = 'unusable'").collect()
    assert sorted(json.loads(r.value)["path"][-11:-9] for r in rows) == ["01", "02", "05", "06", "07"]


def test_new_files_are_mined_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(source, "00", packed(message(1, **HELD)))
    mine_new_files(spark, str(source), out, state)
    put(source, "01", packed({"id": 2, **HELD}))
    mine_new_files(spark, str(source), out, state)
    mine_new_files(spark, str(source), out, state)
    assert messages(spark, out) == [("messages", 2), ("tweets", 1)]


def messages(spark, folder):
    rows = spark.read.text(folder).where("kind != 'unusable'").collect()
    return sorted((r.kind, json.loads(r.value)["id"]) for r in rows)


def test_a_file_that_is_finished_later_is_mined_then(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    late = packed(message(5, **HELD))
    put(source, "00", packed(message(1, **HELD)))
    put(source, "02", late[:-9])
    for _ in range(3):
        mine_new_files(spark, str(source), out, state)
        assert messages(spark, out) == [("tweets", 1)]
        assert spark.read.text(out).where("kind = 'unusable'").count() == 1
    put(source, "02", late)
    for _ in range(2):
        mine_new_files(spark, str(source), out, state)
        assert messages(spark, out) == [("tweets", 1), ("tweets", 5)]
    assert spark.read.text(out).where("kind = 'unusable'").isEmpty()


def test_a_lost_checkpoint_overwrites_nothing(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    put(source, "00", packed(message(1, **HELD)))
    mine_new_files(spark, str(source), out, str(state))
    (source / "2018/05/02/13/00.json.bz2").unlink()
    put(source, "01", packed(message(2, **HELD)))
    shutil.rmtree(state)
    mine_new_files(spark, str(source), out, str(state))
    assert messages(spark, out) == [("tweets", 1), ("tweets", 2)]


def test_from_archive_to_tables(spark, tmp_path):
    """Mined output is what parsing reads; a second run of the same gives the same."""
    tags = {"hashtags": [{"text": "a"}], "urls": [], "user_mentions": []}
    put(tmp_path / "in", "00", packed(message(1, entities=tags, **HELD), message(2), message(3, retweeted_status=message(4, **HELD), **HELD)))
    put(tmp_path / "in", "01", packed({"id": 6, **HELD}, message(8, created_at=None), {"id": 9, **HELD}))
    found = []
    for run in ("a", "b"):
        mined_to, out = str(tmp_path / run / "mined"), str(tmp_path / run / "out")
        mine_and_parse(spark, str(tmp_path / "in"), mined_to, out)
        for row in spark.read.text(mined_to).collect():
            json.loads(row.value)
        tables = {t: read_table(spark, out, t, optional=True).collect() for t in TABLES}
        found.append({t: sorted(map(str, rows)) for t, rows in tables.items()})
        assert sorted(r.id for r in tables["tweet_metadata"]) == [1, 3, 4]
        assert [r.hashtag for r in tables["entities_hashtag"]] == ["a"] and len(tables["network_retweet"]) == 1
    assert found[0] == found[1]
