"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is an observation with features of its own and of its two
neighbours, and has one of two states, bad and good.  Forward-backward gives each line's
probability of being good; their mean, weighted by line length, is the document's score.
The field is fitted to documents whose label stands for all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.shared import staged
from archivemill.llm.tokens import Texts

#: Bound of the sample that the field is fitted to: documents, and lines of them together.
SAMPLE_DOCS = 3_000
SAMPLE_LINES = 60_000
#: A document is predicted good from this score on.
GOOD_FROM = 0.3

_IN_LINE = tokens.table(lambda b: b != 0x0A)
_CLASSES = {
    "symbols": tokens.table(lambda b: chr(b) in "#*$%&<>"),
    "pipes": tokens.table(lambda b: b == 0x7C),
    "exclaims": tokens.table(lambda b: b == 0x21),
    "upper": tokens.table(lambda b: 0x41 <= b <= 0x5A),
    "digits": tokens.table(lambda b: 0x30 <= b <= 0x39),
    "stops": tokens.table(lambda b: chr(b) in ".,;:?"),
    "other": tokens.table(lambda b: b < 0x80 and chr(b) in "\"'()[]{}@/\\^_`~=+-"),
}
OWN = [*_CLASSES, "word_length", "length", "same_as_before", "repeats_in_line", "repeated_line"]
#: Features of a line: a constant, its own, its neighbours', and whether it has them.
FEATURES = 1 + 3 * len(OWN) + 2


@dataclass
class Lines:
    """Lines with a word, in text order: their text, length and features."""

    owner: np.ndarray
    length: np.ndarray
    features: np.ndarray


def lines_of(texts: Texts) -> Lines:
    starts, ends = texts.spans(_IN_LINE)
    words = texts.words()
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    keep = last > first
    starts, ends, first, last = starts[keep], ends[keep], first[keep], last[keep]
    owner, length, n = texts.owner(starts), ends - starts, last - first

    def share(truth: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(truth, dtype=np.int64)])
        return (sums[high] - sums[low]) / np.maximum(of, 1)

    own = [share(inside[texts.data], starts, ends, length) for inside in _CLASSES.values()]
    own.append(np.minimum((length - n + 1) / n / 20, 2.0))
    own.append(np.log1p(length) / 8)
    before = np.zeros(len(words), bool)
    before[1:] = words.hashes[1:] == words.hashes[:-1]
    line_of_word = np.searchsorted(starts, words.starts, side="right") - 1
    before[1:] &= line_of_word[1:] == line_of_word[:-1]
    own.append(share(before, first, last, n))
    keys = tokens.chained([words.hashes, line_of_word.astype(np.uint64)])
    fresh = np.zeros(len(words), bool)
    fresh[np.unique(keys, return_index=True)[1]] = True
    own.append(1 - share(fresh, first, last, n))
    keys = tokens.chained([texts.hashes(starts, ends), owner.astype(np.uint64)])
    again = np.ones(len(starts), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    own.append(again.astype(np.float64))

    x = np.stack(own, axis=1) if len(starts) else np.zeros((0, len(OWN)))
    previous, following = np.zeros_like(x), np.zeros_like(x)
    joined = owner[1:] == owner[:-1]
    previous[1:][joined] = x[:-1][joined]
    following[:-1][joined] = x[1:][joined]
    has = np.zeros((len(x), 2))
    has[1:, 0], has[:-1, 1] = joined, joined
    return Lines(owner, length, np.hstack([np.ones((len(x), 1)), x, previous, following, has]))


@dataclass
class Field:
    """Weights of the features for the state good, and scores of the moves between states."""

    weights: np.ndarray
    moves: np.ndarray  # [from, to], 0 bad and 1 good

    def marginals(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good; the expected moves over all chains."""
        n = len(x)
        score = np.zeros((n, 2))
        score[:, 1] = x @ self.weights
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, n])
        order = np.argsort(-size, kind="stable")  # chains by length: at step t the first ones still run
        starts, size = starts[order], size[order]
        steps = int(size[0]) if n else 0
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        forward, backward = score.copy(), np.zeros((n, 2))
        for t in range(1, steps):
            at = starts[: running[t]] + t
            forward[at] += np.logaddexp(forward[at - 1, :1] + self.moves[0], forward[at - 1, 1:] + self.moves[1])
        for t in range(steps - 1, 0, -1):
            at = starts[: running[t]] + t
            ahead = backward[at] + score[at]
            backward[at - 1] = np.logaddexp(self.moves[:, 0] + ahead[:, :1], self.moves[:, 1] + ahead[:, 1:])
        both = forward + backward
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        later = np.setdiff1d(np.arange(n), starts)
        total = np.logaddexp(both[later, 0], both[later, 1])
        ahead = backward[later] + score[later]
        pairs = forward[later - 1][:, :, None] + self.moves + ahead[:, None, :] - total[:, None, None]
        return good, np.exp(pairs).sum(axis=0)


def fit(x: np.ndarray, owner: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.2) -> Field:
    """Maximum likelihood with a small penalty, by gradient steps over all lines.

    ``good``: per line, its document's label.  With no lines all weights are 0.
    """
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    if not len(x):
        return field
    joined = owner[1:] == owner[:-1]
    seen = np.array([[np.sum(joined & ~good[1:]), 0], [0, np.sum(joined & good[1:])]], dtype=np.float64)
    mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, rounds + 1):
        p, moves = field.marginals(x, owner)
        slope = np.r_[x.T @ (good - p), (seen - moves).ravel()] / len(x)
        slope -= 1e-5 * np.r_[field.weights, field.moves.ravel()]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        field.weights = field.weights + move[:FEATURES]
        field.moves = field.moves + move[FEATURES:].reshape(2, 2)
    return field


def held_out(key):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    most_docs: int = SAMPLE_DOCS, most_lines: int = SAMPLE_LINES,
) -> Field:
    """Fit the field to a sample of labelled documents, bounded by ``most_docs`` and ``most_lines``.

    The sample are the labelled keys with the smallest hash, less those held out and those
    without a key or label; where a key stands on several rows, their texts all count, up to ``most_docs`` texts.  Features are
    computed and stored by the tasks; the driver gets the documents' numbers of lines, then the features of the chosen ones.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    chosen = (
        usable.groupBy(key).agg(F.min(label).alias("_good"))
        .orderBy(F.xxhash64(key), key).limit(most_docs)
    )
    sample = docs.select(key, text).join(F.broadcast(chosen), key)  # most_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_pylist()
            for texts in tokens.slices(batch.column(0)):
                lines = lines_of(texts)
                edges = np.searchsorted(lines.owner, np.arange(len(texts) + 1))
                rows = [lines.features[a:b].astype(np.float32).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                mark = good[texts.first : texts.first + len(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark, pa.int32()), pa.array(rows, pa.binary()), pa.array(np.diff(edges))],
                    names=["good", "features", "n"],
                )

    found = sample.select(text, F.col("_good").cast("int")).mapInArrow(run, "good int, features binary, n bigint")
    stage = staged(found.withColumn("hash", F.xxhash64("features")), "line-features")
    order = stage.select("hash", "good", "n").orderBy("hash", "good").limit(most_docs).collect()  # three numbers a document
    total, chosen = 0, []
    for row in order:
        if total + row.n <= most_lines:
            total += row.n
            chosen.append(row)
    wanted = sorted({r.hash for r in chosen})
    lines = stage.where(F.col("hash").isin(wanted)).select("hash", "features").dropDuplicates(["hash"]).collect()  # most_lines
    features = {r.hash: np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in lines}
    x = [features[r.hash] for r in chosen]
    owner = [np.full(r.n, i) for i, r in enumerate(chosen)]
    good = [np.full(r.n, r.good == 1) for r in chosen]
    if not x:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, bool))
    return fit(np.concatenate(x).astype(np.float64), np.concatenate(owner), np.concatenate(good))


def score(texts: Texts, field: Field) -> np.ndarray:
    """Scores of documents from 0 to 1; 0 for a document without words."""
    lines = lines_of(texts)
    good, _ = field.marginals(lines.features, lines.owner)
    weight = np.bincount(lines.owner, weights=lines.length, minlength=len(texts))
    total = np.bincount(lines.owner, weights=good * lines.length, minlength=len(texts))
    return np.clip(total / np.maximum(weight, 1), 0.0, 1.0)


def quality_scores(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, held_out, score and predicted.

    Null and empty texts score 0; a null key is not held out; repeated rows score alike;
    whole texts count, however long; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.slices(batch.column(2)):
                keys = [batch.column(i).slice(texts.first, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(score(texts, field))], names=[key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(key, held_out(docs[key]).alias("_held_out"), text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))


def accepted(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted good, with all their columns, whatever their names."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [score(texts, field) >= GOOD_FROM for texts in tokens.slices(batch.column(place))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
