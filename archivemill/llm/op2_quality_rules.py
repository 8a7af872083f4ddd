"""Quality rules by the log-likelihood ratio of hashed n-grams.

Every text is a bag of words and word pairs hashed into buckets.  Two multinomials over
the buckets are counted, one over all texts and one over trusted ones, and a text's score
is the mean over its n-grams of ``ln p(trusted) - ln p(raw)``.  A text is kept when its
score reaches a fixed threshold; nothing is drawn at random.  Texts that are too short or
repeat themselves too much fail before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.tokens import Texts, Words

#: Buckets of the multinomials.
BUCKETS = 10_000
#: Mean log ratio an n-gram must reach.
THRESHOLD = -0.05
#: N-grams of the raw distribution added to the trusted ones for each bucket, so that a small trusted corpus says little.
PRIOR = 20
#: Base rules.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED_PERCENT = 20

_SYMBOL = tokens.table(lambda b: chr(b) in "#*$%&|<>")
_IN_LINE = tokens.table(lambda b: b != 0x0A)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(words: Words) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it."""
    at, grams = words.grams(WINDOW)
    keys = tokens.chained([grams, words.owner[at].astype(np.uint64)])
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(words.texts, np.int64)
    found = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.owner[inside], minlength=words.texts)


def _repeated_lines(texts: Texts) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    starts, ends = texts.spans(_IN_LINE)
    solid = np.concatenate([[0], np.cumsum(tokens.SPACED[texts.data], dtype=np.int64)])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    owner = texts.owner(starts)
    keys = tokens.chained([texts.hashes(starts, ends), owner.astype(np.uint64)])
    _, first = np.unique(keys, return_index=True)
    n = len(texts)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def base_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    lead = (texts.data & 0xC0) != 0x80
    return {
        "n_words": words.counts(),
        "word_chars": texts.per_text(lead & tokens.SPACED[texts.data]),
        "n_symbols": texts.per_text(_SYMBOL[texts.data]),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": _repeated_words(words),
    }


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and every pair of neighbouring words."""
    at, pairs = words.grams(2)
    owner = np.concatenate([words.owner, words.owner[at]])
    return owner, (np.concatenate([words.hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in tokens.slices(batch.column(0)):
                totals += np.bincount(features(texts.words(), buckets)[1], minlength=buckets)
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], names=["bucket", "n"])

    return run


def log_ratios(raw: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket ``ln p(trusted) - ln p(raw)``.

    One is added to every raw count, and ``PRIOR`` n-grams for each bucket, dealt like the raw
    ones, to the trusted counts.  Each task counts into one array of ``buckets`` numbers; those
    are what shuffles and what reaches the driver.  With no trusted text all ratios are 0.
    """

    def counted(docs: DataFrame, name: str) -> DataFrame:
        sums = docs.select(text).mapInArrow(_count(buckets), "bucket bigint, n bigint")
        return sums.select(F.lit(name).alias("corpus"), "bucket", "n")

    totals = {name: np.zeros(buckets) for name in ("raw", "trusted")}
    both = counted(raw, "raw").union(counted(trusted, "trusted"))
    for name, bucket, n in both.groupBy("corpus", "bucket").agg(F.sum("n").alias("n")).collect():
        totals[name][bucket] += n
    plain = (totals["raw"] + 1) / (totals["raw"].sum() + buckets)
    prior = PRIOR * buckets
    return np.log((totals["trusted"] + prior * plain) / (totals["trusted"].sum() + prior)) - np.log(plain)


def judge(texts: Texts, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    words = texts.words()
    out = base_counts(texts, words)
    owner, bucket = features(words, len(ratios))
    n = np.bincount(owner, minlength=len(texts))
    out["llr"] = np.bincount(owner, weights=ratios[bucket], minlength=len(texts)) / np.maximum(n, 1)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (
        100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"]
    )
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def trusted_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality") -> DataFrame:
    """The texts labelled good.  The labels are the side that is hashed."""
    marked = labels.where(F.col(good) == 1).select(key)
    return docs.join(marked.hint("shuffle_hash"), key, "left_semi")


def quality_rules(
    docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The verdict on every row: ``key``, the base counts, base_failed, kept and llr.

    Null and empty texts have no words and fail; repeated rows are judged alike; whole texts
    count, however long; an empty table gives no rows; other columns are not read.
    """
    columns = [*COUNTS, "base_failed", "kept", "llr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.slices(batch.column(1)):
                found = judge(texts, ratios, threshold)
                keys = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(found[c]) for c in columns)], names=[key, *columns])

    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {kinds}, base_failed boolean, kept boolean, llr double"
    return docs.select(key, text).mapInArrow(run, schema)


def accepted(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(texts, ratios, threshold)["kept"] for texts in tokens.slices(batch.column(place))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
