import pytest

from archivemill.operators import flatten
from archivemill.operators.decode import POSITION
from archivemill.plans import store
from archivemill.plans.parse import tables
from archivemill.plans.staging import staged
from archivemill.plans.store import manifest, parse_more, publish, read_current, read_view, remove_unused
from archivemill.plans.views import VIEWS, build_views
from archivemill.schema import TABLES
from archivemill.sources.archive import json_lines
from tests.messages import deletion, message, user

HELD = {"withheld_in_countries": ["TR"]}


def contents(read):
    return {name: sorted(map(str, read(name).collect())) for name in TABLES}


def some(n, first=0):
    """Messages by few users, repeating each other, so that ids meet again; every other one is held back."""
    out = []
    for i in range(first, first + n):
        below = {"retweeted_status": message(1000 + i % 5, uid=7, text=f"seen {i}")} if i % 2 else HELD
        out.append(message(i % 17, uid=i % 4, user=user(i % 4, name=f"n{i}"), **below))
    return [*out, deletion(), "{"]


def test_runs_in_parts_equal_one_run(spark, lines, tmp_path):
    folder, frames = str(tmp_path / "store"), [lines(*part, block=i) for i, part in enumerate([some(10), some(12, 5)])]
    wanted = contents(tables(frames[0].union(frames[1])).__getitem__)
    for i in (1, 0, 1):  # the later ones first, and given twice
        parse_more(frames[i], folder, buckets=2)
    assert contents(lambda name: read_current(spark, folder, name)) == wanted


def test_a_run_touches_its_buckets_and_publishes_all_or_nothing(spark, lines, tmp_path, monkeypatch):
    folder, names = str(tmp_path / "store"), ("tweet_metadata", "tweet_text", "twitter_user")

    def now(version=None):
        return {name: sorted(map(str, read_current(spark, folder, name, version).collect())) for name in names}

    assert read_current(spark, folder, "tweet_text").collect() == []
    parse_more(lines(*some(40)), folder, buckets=16)
    first, before = manifest(spark, folder), now()
    real, calls = store.folded, []

    def failing(rows, name):
        calls.append(name)
        if len(calls) == 6:
            raise OSError("no space left")
        return real(rows, name)

    monkeypatch.setattr(store, "folded", failing)
    with pytest.raises(OSError):
        parse_more(lines(*some(4, 100)), folder)
    monkeypatch.undo()
    assert now() == before and manifest(spark, folder) == first
    with pytest.raises(RuntimeError):
        store.publish(spark, folder, first)  # another run was first

    assert parse_more(lines(message(3, text="again")), folder, buckets=4) == 2
    after = manifest(spark, folder)
    old, new = (state["tables"]["tweet_text"] for state in (first, after))
    assert after["buckets"] == 16 and len(old) > 5 and len([b for b in new if new[b] != old.get(b)]) == 1
    assert "again" in {r.text for r in read_current(spark, folder, "tweet_text").where("id = 3").collect()}
    assert now(version=1) == before != now()
    left = now()
    assert remove_unused(spark, folder) > 0 and remove_unused(spark, folder) == 0 and now() == left


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_rejects_name_their_lines(spark, tmp_path, split):
    source = tmp_path / "in"
    source.mkdir()
    texts = {}
    for name in ("a.json", "b.json"):
        body = ["{bad" if i % 7 == 3 else "" if i % 5 == 0 else '{"id": 1, "n": "' + "x" * (i % 40) + '"}' for i in range(60)]
        texts[name] = body
        (source / name).write_text("\n".join(body) + ("\n" if name == "a.json" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        stage = staged(flatten.everything(json_lines(spark, str(source), blanks=True)).select(*POSITION, "part", "text"), "lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (stage.select("file", "block").distinct().count() > 2) == (split == 64)
    found = sorted((r.file[-6:], r.line, r.value) for r in flatten.rejects(stage, split=True).collect())
    assert found == [(name, i, text) for name, body in texts.items() for i, text in enumerate(body) if text]


def tagged(mid, uid, *tags, **fields):
    entities = {"hashtags": [{"text": t} for t in tags], "urls": [], "user_mentions": []}
    return message(mid, uid=uid, entities=entities, **fields)


def test_views_follow_replaced_rows(spark, lines, tmp_path):
    """A message that changes hands takes its counts along; the former author's go, and so do buckets left empty."""
    folder = str(tmp_path / "store")
    late = "Thu May 02 10:00:00 +0000 2019"
    retweet = message(50, uid=3, retweeted_status=message(51, uid=9))
    parts = [
        [tagged(1, 7, "a", "b"), tagged(2, 7, "a"), tagged(3, 8, "a"), retweet],
        [tagged(1, 8, "a", "b", created_at=late), tagged(2, 8, "a", created_at=late)],
        [tagged(4, 7, "c"), deletion(), retweet],
    ]
    frames = [lines(*part, block=i) for i, part in enumerate(parts)]
    whole = frames[0]
    for i, frame in enumerate(frames):
        if i:
            whole = whole.union(frame)
        parse_more(frame, folder, buckets=32)
        wanted = build_views(tables(whole))
        for name in VIEWS:
            found = read_view(spark, folder, name)
            assert sorted(map(str, found.collect())) == sorted(map(str, wanted[name].collect())), (i, name)
    assert {r.author_id: r.tw_num for r in read_view(spark, folder, "view_user_stats").collect()} == {"7": 1, "8": 3, "3": 1, "9": 1}
    assert "7" in {r.author_id for r in read_view(spark, folder, "view_author_hashtag", version=1).collect()}
    assert "7" not in {r.author_id for r in read_view(spark, folder, "view_author_hashtag", version=2).collect()}

    state = manifest(spark, folder)  # as a store without counts
    bare = {"version": 4, "buckets": 32, "tables": {t: r for t, r in state["tables"].items() if t in TABLES}}
    publish(spark, folder, bare)
    parse_more(lines(tagged(5, 2, "d"), block=9), folder)
    wanted = build_views(tables(whole.union(lines(tagged(5, 2, "d"), block=9))))
    for name in VIEWS:
        assert sorted(map(str, read_view(spark, folder, name).collect())) == sorted(map(str, wanted[name].collect())), name
    assert remove_unused(spark, folder) > 0
    assert read_view(spark, folder, "view_user_stats").count() == wanted["view_user_stats"].count()
