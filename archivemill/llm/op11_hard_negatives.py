"""Hard negatives by Strassen products of anchor and candidate tiles.

Vectors are quantised to whole numbers.  Anchors go out in chunks of bounded size; every task
multiplies each of its candidate tiles with the chunk, by Strassen's recursion on int64 tiles
padded with zeros, and keeps a heap of the best positives of each anchor.  The heaps of
tasks merge into the chunk's positives.  A second pass over the candidates keeps a heap of
negatives for the score window of each anchor and positive, merged the same way.  Both
heaps hold a fixed number of entries, so neither an anchor nor a hot label gathers rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivemill.llm.shared import stage_path

#: Rows and columns of a product; a side of at most LEAF is multiplied directly.
TILE = 1024
LEAF = 32
#: Bytes of the anchors that are sent to the tasks at once.
CHUNK_BYTES = 32 << 20

_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
_EXACT = 1 << 53


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product; in doubles where no sum can leave the whole numbers they hold."""
    top = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices in seven products of halves instead of eight.

    Odd sides are padded with a line of zeros.  Additions wrap modulo 2**64, so the result is
    exact wherever the true product fits 64 bits, whatever the sums in between.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h] = p1 + p4 - p5 + p7
    out[:i, h:] = p3 + p5
    out[i:, :h] = p2 + p4
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of many groups the first ``size`` entries by score (descending), then id; an entry counts once."""

    def __init__(self, groups: int, size: int):
        self.size = size
        self.scores = np.full((groups, size), _LEAST)
        self.ids = np.full((groups, size), _MOST)

    def admits(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which entries would come before a group's last one."""
        last = self.scores[group, -1]
        return (score > last) | ((score == last) & (row < self.ids[group, -1]))

    def push(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        wanted = self.admits(group, score, row)
        if not wanted.any():
            return
        group, score, row = group[wanted], score[wanted], row[wanted]
        touched = np.unique(group)
        group = np.r_[group, np.repeat(touched, self.size)]
        score = np.r_[score, self.scores[touched].ravel()]
        row = np.r_[row, self.ids[touched].ravel()]
        order = np.lexsort((row, ~score, group))  # ~ turns the order of all int64 around
        group, score, row = group[order], score[order], row[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (row[1:] != row[:-1])]
        new |= score == _LEAST  # empty places are no repeats of each other
        group, score, row = group[new], score[new], row[new]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        first = place < self.size
        self.scores[group[first], place[first]] = score[first]
        self.ids[group[first], place[first]] = row[first]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, score and id of everything held."""
        group, place = np.nonzero(self.scores != _LEAST)
        return group, self.scores[group, place], self.ids[group, place]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix; short lists are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _list(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column


class Anchors:
    """A chunk of anchors: ids, labels as places in the chunk's own list of labels, vectors."""

    def __init__(self, rows: pa.Table, width: int):
        self.ids = rows.column("id").to_numpy()
        labels = rows.column("label").combine_chunks()
        self.labels = pc.unique(labels)
        self.label = pc.index_in(labels, value_set=self.labels).to_numpy()
        self.vectors = _matrix(_list(rows.column("vector")), width)

    def label_of(self, column: pa.Array) -> np.ndarray:
        """The same places for candidates; -1 for labels that no anchor has."""
        return pc.index_in(column, value_set=self.labels).fill_null(-1).to_numpy(zero_copy_only=False)

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, labels and vectors (as columns) of candidates."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TILE:
                yield from self._cut(held)
                held, n = [], 0
        yield from self._cut(held)

    def _cut(self, held: list[pa.RecordBatch]):
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        for start in range(0, rows.num_rows, TILE):
            part = rows.slice(start, TILE).combine_chunks()
            vectors = _matrix(_list(part.column("vector")), self.vectors.shape[1])
            label = self.label_of(part.column("label").combine_chunks())
            yield part.column("id").to_numpy(), label, np.ascontiguousarray(vectors.T)


def _heap_batch(heaps: Heaps) -> pa.RecordBatch:
    """One row per group that holds entries: its number, scores and ids."""
    group, score, row = heaps.entries()
    number, starts = np.unique(group, return_index=True)
    offsets = pa.array(np.r_[starts, len(group)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(number.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(score)), pa.ListArray.from_arrays(offsets, pa.array(row))],
        names=["number", "score", "row"],
    )


_HEAP = "number bigint, score array<bigint>, row array<bigint>"


def _positives(sent, size: int):
    """The best rows of the same label, per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        heaps = Heaps(len(anchors.ids), size)
        for ids, label, vectors in anchors.tiles(batches):
            for one in np.unique(label[label >= 0]):
                mine, theirs = np.flatnonzero(anchors.label == one), np.flatnonzero(label == one)
                for start in range(0, len(mine), TILE):
                    part = mine[start : start + TILE]
                    score = strassen(anchors.vectors[part], vectors[:, theirs])
                    good = (score >= heaps.scores[part, -1][:, None]) & (anchors.ids[part][:, None] != ids[theirs][None, :])
                    a, c = np.nonzero(good)
                    heaps.push(part[a], score[a, c], ids[theirs[c]])
        yield _heap_batch(heaps)

    return run


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score s with low * p <= 100 * s <= high * p."""
    exact = positive.astype(object)
    least, most = -((-low * exact) // 100), (high * exact) // 100
    return least.astype(np.int64), most.astype(np.int64)


def _negatives(sent, size: int):
    """The first rows of another label in the window of each anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, least, most = sent.value  # windows: a row per anchor, a column per positive
        places = least.shape[1]
        heaps = Heaps(len(anchors.ids) * places, size)
        for ids, label, vectors in anchors.tiles(batches):
            for start in range(0, len(anchors.ids), TILE):
                part = np.arange(start, min(start + TILE, len(anchors.ids)))
                score = strassen(anchors.vectors[part], vectors)
                last = heaps.scores.reshape(-1, places, size)[part, :, -1]
                from_, to = np.maximum(least[part], last).min(axis=1), most[part].max(axis=1)
                good = (score >= from_[:, None]) & (score <= to[:, None]) & (anchors.label[part][:, None] != label[None, :])
                a, c = np.nonzero(good & (anchors.ids[part][:, None] != ids[None, :]))
                found, row, at = score[a, c], ids[c], part[a]
                for place in range(places):
                    inside = (found >= least[at, place]) & (found <= most[at, place])
                    heaps.push(at[inside] * places + place, found[inside], row[inside])
        yield _heap_batch(heaps)

    return run


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks in one: number, rank from 1, row, score."""
    entries = heaps.select("number", F.explode(F.arrays_zip("score", "row")).alias("e"))
    entries = entries.select("number", "e.score", "e.row").distinct()
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "row")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def quantised(rows: DataFrame, vec_id: str, vector: Column, label: Column) -> tuple[DataFrame, int]:
    """Rows that take part, as (id, label, vector of whole numbers), and the longest vector's length."""
    narrow = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
    present = narrow.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    width = present.agg(F.max(F.size("vector"))).first()[0] or 0
    bound = math.isqrt((1 << 62) // max(width, 1)) / 256
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(bound)))
    whole = F.transform("vector", lambda x: F.floor(x * 256).cast("bigint"))
    return present.where(F.coalesce(usable, F.lit(False))).select("id", "label", whole.alias("vector")), width


_OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives in the positive's score window.

    Scores are inner products of the vectors' components as floor(256 * x).  ``anchors`` says which rows are
    anchors.  Positives are the other rows of the anchor's label, negatives rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``; higher scores first, ties by
    smaller id.  Windows of negative scores are empty where low < high.

    Left out are rows whose id, label, vector or any component is null, or with a component that is not finite or
    so large that a product could leave 64 bits.  Shorter vectors count as followed by zeros; an empty one
    scores 0.  Equal rows count once; an anchor never takes a row with its own id.  Two different rows with one
    id are two rows.  No anchors, or an empty table, give no rows; other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    flagged = rows.where(F.coalesce(anchors, F.lit(False)))
    candidates, width = quantised(rows, vec_id, F.col(vector), label)
    own = quantised(flagged, vec_id, F.col(vector), label)[0].distinct()
    spark, out = rows.sparkSession, stage_path(rows.sparkSession, "hard-negatives")
    # An anchor's share of a chunk: its vector, and its heaps of both passes.
    each = 8 * width + 16 * positives * (1 + negatives)
    chunks = max(1, math.ceil(own.count() * each / chunk_bytes))
    for chunk in range(chunks):
        dealt = own if chunks == 1 else own.where(F.pmod(F.xxhash64("id", "vector"), F.lit(chunks)) == chunk)
        _mined(candidates, Anchors(dealt.toArrow(), width), positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(_OUT).parquet(out)


def _mined(candidates: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The rows of one chunk of anchors."""
    spark = candidates.sparkSession
    sent = spark.sparkContext.broadcast(anchors)  # at most chunk_bytes
    best = _merged(candidates.mapInArrow(_positives(sent, positives), _HEAP), positives).toArrow()  # positives x anchors of a chunk
    number, place = best.column("number").to_numpy(), best.column("rank").to_numpy() - 1
    ids = np.zeros((len(anchors.ids), positives), np.int64)
    scores = np.zeros_like(ids)
    least, most = np.full_like(ids, _MOST), np.full_like(ids, _LEAST)
    ids[number, place], scores[number, place] = best.column("row").to_numpy(), best.column("score").to_numpy()
    least[number, place], most[number, place] = window(scores[number, place], low, high)
    sent = spark.sparkContext.broadcast((anchors, least, most))
    found = _merged(candidates.mapInArrow(_negatives(sent, negatives), _HEAP), negatives)
    names = spark.sparkContext.broadcast((anchors.ids, ids, scores))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, positive_ids, positive_scores = names.value
        for batch in batches:
            a, p = np.divmod(batch.column("number").to_numpy(), positives)
            columns = [pa.array(anchor_ids[a]), pa.array(positive_ids[a, p]), batch.column("rank"), batch.column("row"), pa.array(positive_scores[a, p]), batch.column("score")]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.mapInArrow(named, _OUT)
