import collections
import itertools
import random
import zlib

from pyspark.sql import functions as F

from archivemill.llm.op1_sharding import HashTree, Shard, default_tree, place, shard_of
from archivemill.llm.op9_packing import boundaries, cell, pack
from archivemill.llm.shared import gapless, word_count


def test_shards_follow_weights_and_slots_have_no_gaps(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("tëxt").alias("text"))
    rows = place(docs, default_tree(8)).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law) == (6, zlib.crc32("tëxt".encode()), "key")
    assert sorted(slots) == list(range(8))
    for own in slots.values():
        assert sorted(own) == list(range(len(own))) and abs(len(own) - 2500) < 300


def test_an_added_shard_takes_rows_only_into_itself_again_and_again(spark):
    keys = spark.range(20_000)
    tree = default_tree(8)
    for n in range(8, 12):
        grown = tree.grown(1.5)
        moved = keys.select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), grown).alias("b")).where("a != b")
        assert {r.b for r in moved.select("b").distinct().collect()} == {n}
        share = 1.5 / (8 + 1.5 * (n - 7))
        assert abs(moved.count() / 20_000 - share) < 0.02
        tree = grown


def test_a_changed_weight_moves_rows_only_in_its_subtree(spark):
    base = [Shard(i, f"r{i // 4}", f"k{i // 2}", 1.0) for i in range(8)]
    heavier = [s if s.number != 5 else Shard(5, s.region, s.rack, 3.0) for s in base]
    keys = spark.range(5_000)
    pairs = keys.select(
        shard_of(F.col("id"), HashTree(tuple(base))).alias("a"), shard_of(F.col("id"), HashTree(tuple(heavier))).alias("b")
    ).where("a != b").distinct().collect()
    assert pairs and all(r.b // 4 == 1 for r in pairs), "moves end in the region that holds shard 5"
    assert all(not (r.a // 2 == 3 and r.b // 2 == 3) for r in pairs), "the other rack keeps its rows"


def test_odd_rows_are_placed(spark, odd):
    rows = place(odd, default_tree(3)).collect()
    assert len(rows) == odd.count()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["size"] for r in rows if r.doc_id in (0, 1)} == {1}
    assert place(odd.limit(0), default_tree()).count() == 0


def test_a_hot_key_is_numbered(spark):
    rows = spark.range(5_000).select(F.lit("g").alias("g"), F.lit(None).cast("int").alias("k"))
    assert [r.n for r in gapless(rows, "g", ["k"], "n", pieces=7).orderBy("n").collect()] == list(range(5_000))


def padding(cells, ends):
    return sum(next(e for e in ends if e >= end) * n - total for end, n, total in cells)


def test_boundaries_are_the_best_of_all():
    cells = [(1, 5, 5), (2, 1, 2), (5, 7, 35), (9, 2, 18), (10, 4, 40), (40, 1, 40)]
    for buckets in range(1, 8):
        found = boundaries(cells, buckets)
        ends = [c[0] for c in cells]
        best = min(
            padding(cells, list(chosen))
            for k in range(1, buckets + 1)
            for chosen in itertools.combinations(ends, min(k, len(ends)))
            if chosen[-1] == 40
        )
        assert len(found) <= buckets and padding(cells, found) == best
    assert boundaries([], 4) == []


def test_boundaries_of_many_lengths_are_those_of_the_plain_recursion():
    pick = random.Random(4)
    for _ in range(30):
        cells = [(e, n, e * n - pick.randrange(n)) for e, n in ((e, pick.randrange(1, 9)) for e in sorted(pick.sample(range(1, 400), 40)))]
        best = [0, *[None] * len(cells)]
        for buckets in range(1, 9):
            for j in range(len(cells), 0, -1):
                costs = [b + sum(cells[j - 1][0] * n - t for _, n, t in cells[i:j]) for i, b in enumerate(best[:j]) if b is not None]
                best[j] = min([c for c in [best[j], *costs] if c is not None])
            found = boundaries(cells, buckets)
            assert len(found) <= buckets and padding(cells, found) == best[-1]


def test_boundaries_are_lengths_that_occur(spark):
    lengths = [3, 7, 2000, 2001, 140_000, 300_001, 300_007]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, n bigint")
    rows = pack(docs, F.col("n"), buckets=3).collect()
    assert {r.bucket_length for r in rows} <= set(lengths) and max(r.bucket_length for r in rows) == 300_007


def test_cells_hold_their_lengths(spark):
    lengths = [0, 1, 1023, 1024, 1025, 2049, 131_072, 131_073, 131_585, 262_144, 262_145, 10**6, 10**9]
    rows = spark.createDataFrame([(x,) for x in lengths], "n bigint").select("n", cell(F.col("n")).alias("end")).collect()
    assert all(r.end >= r.n and (r.end - r.n <= r.n / 128 if r.n > 131_072 else r.end == r.n) for r in rows)


def test_batches_fit_the_budget(spark, odd):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.pmod(F.hash("id"), F.lit(900)) + 1).alias("n"))
    rows = pack(docs, F.col("n"), buckets=5, budget=2_000).collect()
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens + r.padding == r.bucket_length >= r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), own in batches.items():
        room = max(1, 2_000 // own[0].bucket_length)
        last = max(b for k, b in batches if k == bucket)
        assert len(own) == room if batch < last else len(own) <= room
        assert sorted(r.place for r in own) == list(range(len(own)))
    packed = pack(odd, word_count(odd["text"])).collect()
    assert len(packed) == odd.count() and max(r.n_tokens for r in packed) == 60_000
    assert pack(odd.limit(0), word_count(odd["text"])).count() == 0
