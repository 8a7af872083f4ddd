import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from archivemill.llm import op13_collocations as op
from archivemill.llm import tokens

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, first=2000, share=100):
    """The phrases asked for, by counting every run of words."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = collections.Counter()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                covered[lang, words[i : i + k]] = max(a, covered[lang, words[i : i + k]])
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * covered[lang, words] >= share * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)
    )


def corpus(n=150, seed=5):
    pick = random.Random(seed)
    fixed = ["ab cd ef gh ij kl", "né ça va", "x y x y x y x", "san francisco bay"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(pick.randrange(80)):
            words.append(pick.choice(fixed) if pick.random() < 0.2 else f"W{pick.randrange(30)}")
            words.append(pick.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", " ! ", ":"]) if pick.random() < 0.3 else " ")
        rows.append((i, "".join(words), pick.choice(["en", "fr", None, "und"])))
    rows += rows[:40] * 3  # copies
    return [*rows, (900, None, "en"), (901, "", "en"), (902, " \t.\n", "de"), (903, "a " * 3000, "en"), (904, "one two", "de")]


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id int, text string, lang string, a int, owned int, chunk string")
    return sorted(map(tuple, op.collocations(frame, **kw).collect()))


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_phrases_are_those_of_all_runs(spark, monkeypatch, period):
    monkeypatch.setattr(op, "HELD", 500)  # so that sums are handed on at times
    rows = corpus()
    wanted = brute(rows, 12)
    assert len(wanted) > 60 and found(spark, rows, least=12, period=period) == wanted


def test_limits_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(op, "PHRASES", 20)
    monkeypatch.setattr(op, "AT_ONCE", 2000)
    monkeypatch.setattr(op, "HELD", 2)  # so that ranges are summed in parts
    rows = corpus(60, 8)
    assert found(spark, rows, least=9, first=7, share=80) == brute(rows, 9, 7, 80)
    assert found(spark, []) == [] and found(spark, rows[-5:]) == brute(rows[-5:], 100)


def test_chunks_own_every_word_once_and_share_their_ends():
    texts = [t or "" for _, t, _ in corpus(40)]
    part = next(tokens.slices(pa.array(texts)))
    words = part.words(op.WORD, lower=True)
    for period in (1, 5, 32):
        begins, own_end, end = op.chunked(words, period)
        assert np.concatenate([np.arange(a, b) for a, b in zip(begins, own_end, strict=True)]).tolist() == list(range(len(words)))
        assert all(words.owner[a] == words.owner[e - 1] and e - b <= op.OVERLAP for a, b, e in zip(begins, own_end, end, strict=True))
    again = next(tokens.slices(pa.array(["before it all " + texts[0]]))).words(op.WORD, lower=True)
    own = words.firsts()[1]
    shifted = {b - 3 for b in op.chunked(again, 5)[0].tolist()}
    assert {b for b in op.chunked(words, 5)[0].tolist() if 0 < b < own} <= shifted  # content alone decides


def test_numbers_are_packed_and_unpacked():
    for values in ([], [0, 0], [1, 255, 256], [1 << 40, 3]):
        numbers = np.array(values, np.uint64)
        assert op.unpacked(op.packed(numbers), len(values)).tolist() == values
    for bits in (32, 64):
        keys = np.unique(np.random.default_rng(1).integers(0, 1 << bits, 5000, dtype=np.uint64))
        got = [op._keys(r, data, bits) for r, _, _, data in op._by_range(keys, bits)]
        assert np.concatenate(got).tolist() == keys.tolist()


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**13, 10**15, 10**14, 3 * 10**13
    expr = "CAST((1000BD * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)"
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint").select(F.expr(expr).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)
