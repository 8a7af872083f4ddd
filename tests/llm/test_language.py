import collections
import json
import math
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from archivemill.llm import op5_ngram_trie as lm
from archivemill.llm import op6_token_counts as counts

SF = "/root/testdata/sf0.001"


def test_elias_fano_gets_and_finds():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 6), (1000, 1 << 40), (3000, 3000), (500, 1 << 63), (700, 1 << 64)):
        top = min(universe, (1 << 63) - 1)
        values = np.unique(rng.integers(0, top, n, dtype=np.int64).astype(np.uint64))
        coded = lm.EliasFano.of(values, universe)
        assert (coded.get(np.arange(len(values))) == values).all()
        wanted = np.r_[values, rng.integers(0, top, 300, dtype=np.int64).astype(np.uint64)]
        place = {v: i for i, v in enumerate(values.tolist())}
        assert coded.find(wanted).tolist() == [place.get(v, -1) for v in wanted.tolist()]
    repeated = np.sort(rng.integers(0, 50, 200)).astype(np.uint64)
    assert (lm.EliasFano.of(repeated, 50).get(np.arange(200)) == repeated).all()


def test_scores_are_those_of_the_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trie = lm.build(docs.where(~lm.held_out(docs["doc_id"])), ranges=5)
    low = {c: c + 32 for c in range(65, 91)}
    texts = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(low)), None] for r in docs.collect()}
    train = [w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    single, pairs, follow = collections.Counter(), collections.Counter(), collections.Counter()
    for words in train:
        single.update(words)
        pairs.update(zip(["<begin>", *words], words, strict=False))
    for a, _ in pairs:
        follow[a] += 1
    n, v = sum(single.values()), len(single)
    seen = {**single, "<begin>": len(train)}
    for r in lm.scores(docs, trie).collect():
        words = texts[r.doc_id]
        own = [(single[w] + 1) / (n + v + 1) for w in words]
        full = 0.0
        for a, b, p in zip(["<begin>", *words], words, own, strict=False):
            if a in seen:
                p = max(pairs[a, b] - lm.DISCOUNT, 0) / seen[a] + lm.DISCOUNT * follow[a] / seen[a] * p
            full += math.log10(p)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in single for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(map(math.log10, own)), rel_tol=1e-9)
        assert math.isclose(r.score, full, rel_tol=1e-3)


def test_odd_texts_are_scored(spark, odd):
    trie = lm.build(odd, ranges=3)
    rows = {r.doc_id: r for r in lm.scores(odd, trie).collect()}
    assert rows[0].n_tokens == rows[2].n_tokens == 1 and rows[4].n_tokens == 60_001
    assert lm.scores(odd.limit(0), trie).count() == 0
    empty = lm.build(odd.limit(0))
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in lm.scores(odd, empty).collect())


def test_token_counts_and_the_cache(spark, odd, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(900, "a<|endoftext|>b"), (901, "a<|endoftext|>b")], docs.schema))
    model = Tokenizer.from_file(path)
    wanted = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text, add_special_tokens=False))) for r in docs.collect()}
    for _ in range(2):  # the second time everything is in the cache
        found = counts.token_counts(docs, path, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == wanted
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == docs.select("text").distinct().count()
    counts.token_counts(odd, path, cache).collect()
    rows = {r.doc_id: r for r in counts.token_counts(odd, path, cache).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[4].n_tokens == rows[5].n_tokens > 60_000
    assert counts.token_counts(odd.limit(0), path, cache).count() == 0


def test_the_sentencepiece_model_has_its_own_counts(spark, tmp_path):
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None)], "doc_id bigint, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, path, cache).collect()}
    assert found == {1: len(model.encode("Hello  world")), 2: 0, 3: 0}


def test_a_digest_stored_twice_counts_once_and_no_column_is_lost(spark, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "c", 7, 8, 9)], "doc_id int, text string, _content int, _count int, content int")
    counts.token_counts(docs, path, cache).collect()
    stored = spark.read.parquet(cache).collect()
    spark.createDataFrame(stored, "content binary, n_tokens bigint, tokenizer string").write.mode("append").partitionBy("tokenizer").parquet(cache)
    again = counts.token_counts(docs, path, cache)
    assert again.columns == ["doc_id", "_content", "_count", "content", "n_bytes", "n_tokens"]
    assert sorted((r.doc_id, r["_content"], r["_count"], r.content) for r in again.collect()) == [(1, 7, 8, 9), (2, 7, 8, 9)]


def test_a_task_gives_the_library_each_word_once(monkeypatch):
    path, given = public_tokenizers.path("byte_bpe_50k.json"), []
    library = counts.counter(path)
    monkeypatch.setattr(counts, "counter", lambda _: lambda texts: given.extend(texts) or library(texts))
    long = "x" * 100
    texts = [f"the cat{i % 7} sat \n on <|endoftext|>the mat {long}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["content", "_text"])
    frames = list(counts._encode(path, counts.splits_at_space(path))(iter([batch, batch])))
    assert [x for f in frames for x in f.column("n_tokens").to_pylist()] == library(texts) * 2
    assert sum(map(len, given)) < 10 * len(texts[0])
    short = [w for w in given if long not in w]
    assert len(short) == len(set(short)) and f" {long}" in given


def test_counts_of_words_add_up_at_any_white_space(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, spaces = counts.counter(path), [chr(c) for c in (*range(33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    pick = random.Random(7)
    signs = [*spaces, *" \n" * 40, *"ab1!é中́²", "'s", "<|endoftext|>", "   ", "the"]
    texts = ["", " ", *spaces, *(f"!{s}!" for s in spaces), *(f"a{s} {s}b\n{s}" for s in spaces)]
    texts += ["".join(pick.choices(signs, k=pick.randrange(40))) for _ in range(2000)]
    monkeypatch.setattr(counts, "KEPT_WORDS", 500)  # the kept counts are dropped on the way
    by_words = counts._by_words(library)
    assert [by_words([t])[0] for t in texts] == library(texts)
    assert all("".join(counts.PARTS.findall(t)) == t for t in texts)


def test_only_tokenizers_that_split_at_space_are_given_words(tmp_path):
    form = json.loads(pathlib.Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    split, added = form["pre_tokenizer"], form["added_tokens"][0]

    def splits(**change):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({**form, **change}))
        return counts.splits_at_space(str(path))

    assert splits() and splits(added_tokens=[])
    assert not splits(normalizer={"type": "Lowercase"}) and not splits(pre_tokenizer=None)
    assert not splits(pre_tokenizer={**split, "add_prefix_space": True}) and not splits(pre_tokenizer={**split, "use_regex": False})
    assert not splits(added_tokens=[{**added, "content": "a b"}]) and not splits(added_tokens=[{**added, "rstrip": True}])
    assert not splits(model={**form["model"], "dropout": 0.1})
    assert not any(counts.splits_at_space(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
