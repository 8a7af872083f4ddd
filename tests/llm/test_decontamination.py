import collections
import hashlib
import re

import numpy as np
import pytest

from archivemill.llm import op7_decontamination as op

SF = "/root/testdata/sf0.01"
LOW = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, benchmark):
    windows, lengths = collections.defaultdict(set), set()
    for item, text in benchmark:
        words = words_of(text)
        size = min(10, len(words))
        lengths.add(size)
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    out = []
    for key, text in docs:
        words, inside, items = words_of(text), set(), set()
        for size in lengths - {0}:
            for i in range(len(words) - size + 1):
                if (own := windows.get(tuple(words[i : i + size]))) is not None:
                    inside.update(range(i, i + size))
                    items |= own
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((key, len(words), len(inside), len(items), sha, bool(inside)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def found(docs, benchmark):
    return sorted((tuple(r) for r in op.contamination(docs, benchmark).select(*COLUMNS).collect()), key=str)


def test_the_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = rng.integers(0, 12, int(rng.integers(1, 9)))
        words = rng.integers(0, 4, counts.sum()).astype(np.uint64)
        index = op.Index.from_bytes(op.Index.build(words, counts).to_bytes())
        lengths = rng.integers(1, 4, 6)
        hashes = np.zeros((6, 4), np.uint64)
        for i, n in enumerate(lengths):
            hashes[i, 4 - n :] = rng.integers(0, 5, n)
        phrase, at = index.occurrences(op.Phrases(hashes, lengths, [["x"]] * 6))
        wanted = []
        for p, n in enumerate(lengths):
            for d, doc in enumerate(np.split(words, np.cumsum(counts)[:-1])):
                hit = [j for j in range(len(doc) - n + 1) if (doc[j : j + n] == hashes[p, 4 - n :]).all()]
                wanted += [(p, int(index.firsts[d]) + j) for j in hit]
        assert sorted(zip(phrase.tolist(), at.tolist(), strict=True)) == sorted(wanted)


@pytest.mark.parametrize("block", [1 << 22, 3_000])
def test_hits_are_those_of_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    benchmark = benchmark.union(spark.createDataFrame([(900, "of the"), (901, "..."), (902, None)], benchmark.schema))
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in benchmark.collect()])
    assert found(docs, benchmark) == wanted and any(r[5] for r in wanted)


def test_passages_are_cut_out(spark):
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA"
    texts = [f"Start here. {passage}; and the end", passage.upper(), "clean  text\n stays", f"{passage} x {passage}", None]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    left = {r.doc_id: r.text for r in op.cleaned(docs, benchmark).collect()}
    assert left == {0: "Start here. \n; and the end", 2: "clean  text\n stays", 3: "\n x \n", 4: None}
    again = spark.createDataFrame(list(left.items()), "doc_id int, text string")
    assert not any(r[5] for r in found(again, benchmark))


@pytest.mark.parametrize("block", [30, 200])
def test_blocks_cut_what_one_block_cuts(spark, monkeypatch, block):
    passages = [" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate([12, 10, 25, 40, 13])]
    passages.append("p0w11 after that come words from another item altogether so there")
    texts = [f"before it {p} behind it" for p in passages] + passages
    texts += [f"{passages[0]} after that come words", f"p3w1 p3w2 {passages[2]} p3w3 p3w4 p3w5 p3w6 p3w7 p3w8 p3w9 p3w10", "clean text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    one = sorted(op.cleaned(docs, benchmark).collect())
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    assert sum(1 for _ in op.phrase_blocks(benchmark)) > 1
    assert sorted(op.cleaned(docs, benchmark).collect()) == one
    hits = {r.doc_id: r.n_words - r.n_hit for r in op.contamination(docs, benchmark).collect()}
    left = {r.doc_id: len(words_of(r.text)) for r in one}
    assert {k: left.get(k, 0) for k in hits} == hits


def test_odd_rows(spark, odd):
    benchmark = odd.selectExpr("doc_id AS item_id", "text").where("doc_id IN (0, 1, 3, 6)")
    wanted = brute([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in benchmark.collect()])
    assert found(odd, benchmark) == wanted
    assert not any(r[5] for r in found(odd, benchmark.limit(0)))
    assert found(odd.limit(0), benchmark) == [] and op.cleaned(odd, benchmark).schema == odd.schema
