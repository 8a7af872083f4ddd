import collections
import random
import re

from pyspark.sql import functions as F

from archivemill.llm import components as joining
from archivemill.llm import op4_chosen_path as op
from archivemill.llm.components import components
from tests.llm.conftest import prose


def brute(rows):
    """class, links and group of each row, by comparing all pairs."""
    low = {c: c + 32 for c in range(65, 91)}
    classes, sets, own = {}, {}, {}
    for key, text in sorted(rows):
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)))
        own[key] = classes.setdefault(words, key) if words else key
        if words and own[key] == key:
            sets[key] = {words[i : i + 5] for i in range(max(1, len(words) - 4))}
    links, root = collections.Counter(), {k: k for k in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (c, links[c], find(c)) for k, c in own.items()}


def corpus():
    pick, rows = random.Random(8), []
    passage = prose(77, 60)
    for i in range(120):
        rows.append((len(rows), prose(100 + i, pick.randrange(1, 150)) + ("\n" + passage if i % 3 == 0 else "")))
    big = prose(5, 200).split(" ")
    for _ in range(300):  # one large group of near copies, some of them equal
        words = list(big)
        for _ in range(pick.randrange(3)):
            words[pick.randrange(len(words))] = f"new{pick.randrange(40)}"
        rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "ONE two"), (len(rows) + 3, "one TWO")]


def test_links_and_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "SMALL", 40)  # so that nodes split and blocks meet
    monkeypatch.setattr(op, "BLOCK", 17)
    rows = corpus()
    found = op.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    wanted = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in found} == wanted


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string")
    wanted = brute(rows)
    kept = [r.doc_id for r in op.deduplicated(docs).collect()]
    assert sorted(kept) == sorted({g for _, _, g in wanted.values()})


def test_runs_follow_the_target():
    assert op.runs(recall=0.9) < op.runs(recall=0.99) < op.runs(depth=6, recall=0.99)


def near(n, seed=4):
    """Different texts, each a word or two from one of them; and a chain of texts that only neighbours are near to."""
    pick, base = random.Random(seed), prose(6, 240).split(" ")
    texts = set()
    while len(texts) < n:
        words = list(base)
        for _ in range(2):
            words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
        texts.add(" ".join(words))
    chain = [w for i in range(60) for w in prose(900 + i, 4).split()]
    return sorted(texts) + [" ".join(chain[i * 4 : i * 4 + 100]) for i in range(20)]


def test_rows_grow_with_the_texts_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(op, "SMALL", 32)
    monkeypatch.setattr(op, "BLOCK", 32)
    monkeypatch.setattr(joining, "HUB", 50)
    made = []
    original = op._links

    def links(rows, group, compare, counted):
        out = op.staged(original(rows, group, compare, counted), "made")
        made[-1][counted] = out.count()
        return out

    monkeypatch.setattr(op, "_links", links)
    for n in (120, 240):
        made.append({})
        rows = list(enumerate(near(n)))
        found = op.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in found} == brute(rows)
    for counted in (False, True):
        assert made[1][counted] <= 2.2 * made[0][counted]


def test_hubs_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(joining, "HUB", 20)
    rows = spark.range(100).select(F.when(F.col("id") < 70, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(100).select(F.col("id").alias("of"), (F.col("id") * 10).alias("x"))
    for most in (joining.MOST_HUBS, 0):
        monkeypatch.setattr(joining, "MOST_HUBS", most)
        found = joining.looked_up(rows, "k", table, "of").select("id", "x").collect()
        assert sorted(map(tuple, found)) == [(i, 10 if i < 70 else 10 * i) for i in range(100)]
    star = spark.createDataFrame([(5, i) for i in range(6, 90)] + [(89, 300), (300, 301)], "a bigint, b bigint")
    assert {r.root for r in components(star).collect()} == {5}


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 11), (5, 5), *[(i, i + 1) for i in range(20, 60)]]
    found = {r.v: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{i: 20 for i in range(20, 61)}}


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in op.similar(odd).collect()}
    assert (rows[5].class_id, rows[5].n_links, rows[5].group_id) == (4, 0, 4) and rows[7].class_id == 6
    assert rows[0].group_id == 0 and rows[None].group_id is None
    kept = op.deduplicated(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 6, 8, None]))
    assert op.similar(odd.limit(0)).count() == 0 and op.deduplicated(odd.limit(0)).count() == 0
