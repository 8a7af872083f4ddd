"""The registered archives: files of bounded size, however many lines a folder has."""

import pytest

import __spark_entry__ as entry
from archivemill import queries, session
from archivemill.sources import archive_source, unpacking
from archivemill.sources.archive import read_archive
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
ROWS = 50


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", ROWS)


@pytest.mark.parametrize("name", ["archive_broken_files", "mined_archive", "ledger_runs", "archive_roundtrip"])
def test_many_files_a_folder_give_the_same_rows(spark, small_tasks, name):
    found = difference(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert found is None, found


def test_no_file_holds_a_whole_folder(spark, small_tasks):
    read = read_archive(spark, queries._damaged_archive(spark, SF)).where("reason IS NULL")
    sizes = [r["count"] for r in read.groupBy("file").count().collect()]
    assert len(sizes) > queries._SLOTS and max(sizes) <= 2 * ROWS


def test_a_share_is_a_bounded_part_of_a_highly_compressed_archive():
    files = [archive_source.File(0, f"{i:02}", 5 * 2**20) for i in range(8)]  # some 100 MB of text each
    assert len(archive_source.shares(files, archive_source.SPLIT_BYTES)) == 8


def test_line_ends_are_made_line_feeds(tmp_path):
    import bz2

    path = tmp_path / "a.bz2"
    path.write_bytes(bz2.compress(b"a\r\nb\rc\n\r\nd\r"))
    rows = [b.to_pylist()[0] for b in unpacking.unpacked("f", lambda: open(path, "rb"))]
    assert "".join(r["text"] for r in rows) == "a\nb\nc\n\nd\n"
