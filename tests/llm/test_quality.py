import itertools
import re
import zlib

import numpy as np
import pyarrow as pa

from archivemill.llm import op2_quality_rules as rules
from archivemill.llm import op8_line_crf as crf
from archivemill.llm import tokens
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for own in windows.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def test_base_counts_and_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = rules.trusted_texts(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    ratios = rules.log_ratios(docs, trusted)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = rules.quality_rules(docs, ratios).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in rules.COUNTS) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= rules.THRESHOLD)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in rules.accepted(docs, ratios).collect()} == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d in kept for d, q in labels.items() if q == 1 and len(texts[d].split()) >= 10]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_the_ratio_is_the_mean_over_ngrams():
    ratios = np.random.default_rng(0).normal(size=50)
    part = next(tokens.slices(pa.array([prose(1, 40), "", "a b", prose(2, 30)])))
    words = part.words()
    found = rules.judge(part, ratios, 0.0)["llr"]
    edges = words.firsts()
    for i in range(4):
        own = words.hashes[edges[i] : edges[i + 1]]
        pairs = [tokens.chained([own[k : k + 1], own[k + 1 : k + 2]])[0] for k in range(len(own) - 1)]
        values = [ratios[int(h % np.uint64(50))] for h in [*own, *pairs]]
        assert np.isclose(found[i], np.mean(values) if values else 0.0)


def test_rules_on_odd_rows(spark, odd):
    ratios = rules.log_ratios(odd, odd.where("doc_id = 6"))
    rows = {r.doc_id: r for r in rules.quality_rules(odd, ratios).collect()}
    assert all(rows[i].base_failed and not rows[i].kept for i in (0, 1, 2, 3, 8, None))
    assert rules.accepted(odd, ratios).schema == odd.schema
    assert rules.quality_rules(odd.limit(0), ratios).count() == 0
    assert (rules.log_ratios(odd.limit(0), odd.limit(0)) == 0).all()


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    field = crf.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    owner = np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    x = rng.normal(size=(len(owner), 4))
    good, moves = field.marginals(x, owner)
    expected = np.zeros((2, 2))
    for chain in range(3):
        at = np.flatnonzero(owner == chain)
        total, mass = 0.0, np.zeros(len(at))
        pairs = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(at)):
            score = sum(x[i] @ field.weights for i, y in zip(at, path, strict=True) if y)
            score += sum(field.moves[a, b] for a, b in itertools.pairwise(path))
            weight = np.exp(score)
            total += weight
            mass += weight * np.array(path)
            for a, b in itertools.pairwise(path):
                pairs[a, b] += weight
        assert np.allclose(good[at], mass / total)
        expected += pairs / total
    assert np.allclose(moves, expected)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = crf.quality_scores(docs, crf.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 50 and sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95


def test_classifier_on_odd_rows(spark, odd):
    field = crf.train(odd, odd.selectExpr("doc_id", "1 AS quality").limit(0))
    rows = crf.quality_scores(odd, field).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 and r.predicted == 0 for r in rows if r.doc_id in (0, 1, 2, None))
    assert crf.accepted(odd, field).schema == odd.schema
    assert crf.quality_scores(odd.limit(0), field).count() == 0


def test_the_lines_of_the_sample_are_bounded_before_they_are_fetched(spark, monkeypatch):
    long = "\n".join(f"line {i} of a long text" for i in range(400))
    texts = [long] * 5 + [f"a line of {i}\nand one more" for i in range(30)] + ["", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, quality int")
    seen = {}
    monkeypatch.setattr(crf, "fit", lambda x, owner, good: seen.update(x=x, owner=owner, good=good))
    crf.train(docs, labels, most_lines=30)
    assert 0 < len(seen["x"]) == len(seen["owner"]) == len(seen["good"]) <= 30
    crf.train(docs, labels, most_lines=10**6)
    usable = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen["x"]) == sum(len([line for line in t.split("\n") if line.strip()]) for t in usable), "copies count each"
