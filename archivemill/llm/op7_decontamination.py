"""Benchmark decontamination through an FM-index per training shard.

A shard is about a million words of whole texts.  Its index holds the Burrows-Wheeler
transform of the word sequence in a wavelet matrix, the number of smaller words before
each word, and every sixteenth suffix position.  All benchmark windows are searched backward
at once; the rows found are walked to sampled positions; and the spans of the occurrences
are merged inside each text.  The index does not depend on the benchmark.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.shared import staged

#: Words of a shard, as far as whole texts allow.  Sorting packs two ranks and a number of this size into 63 bits.
SHARD_WORDS = 1 << 20
#: Words of a window.
WINDOW = 10
#: Distance of the sampled suffix positions.
SAMPLED = 16
#: Benchmark words sent to the tasks at once; a larger benchmark is searched in blocks.
BLOCK_WORDS = 1 << 22

_GAP, _END = 1, 0  # symbols after a text and after the last one


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Numbers sorted by (major, minor, number)."""
    n = len(major)
    bits = max(int(n).bit_length(), 1)
    if 2 * max(int(major.max(initial=0)), int(minor.max(initial=0)), 1).bit_length() + bits <= 63:
        width = max(int(minor.max(initial=0)), 1).bit_length()
        packed = (((major << width) | minor) << bits) | np.arange(n)
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.lexsort((minor, major))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; only suffixes not yet told apart are sorted again."""
    n = len(symbols)
    order = _order(symbols, np.zeros(n, np.int64))

    def heads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]

    sorted_symbols = symbols[order]
    new = heads(sorted_symbols, sorted_symbols)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    step = 1
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of two or more
    while len(tied):
        suffixes = order[tied]
        after = suffixes + step
        minor = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        major = rank[suffixes]
        _, dense = np.unique(major, return_inverse=True)
        by = _order(dense, minor)
        suffixes, major, minor = suffixes[by], major[by], minor[by]
        order[tied] = suffixes
        new = heads(major, minor)
        rank[suffixes] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, truth: np.ndarray) -> Bits:
        packed = np.packbits(truth, bitorder="little")
        packed = np.r_[packed, np.zeros(8 + -len(packed) % 8, np.uint8)]
        words = packed.view(np.uint64)
        before = np.r_[0, np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)].astype(np.uint32)
        return cls(words, before)

    def ones(self, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & low)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


@dataclass
class Index:
    """An FM-index of a sequence of words; all arrays, so that it can be stored and mapped."""

    vocabulary: np.ndarray  # sorted word hashes; word i is symbol i + 2
    smaller: np.ndarray  # symbols smaller than each symbol
    levels: list[Bits]  # of the wavelet matrix, highest bit first
    zeros: np.ndarray  # zeros of each level
    marked: Bits  # rows whose suffix position is kept
    kept: np.ndarray
    firsts: np.ndarray  # where each text begins in the sequence, and the end
    n_words: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> Index:
        vocabulary, number = np.unique(hashes, return_inverse=True)
        firsts = np.r_[0, np.cumsum(counts + 1)]
        symbols = np.full(firsts[-1] + 1, _GAP, np.int64)
        symbols[-1] = _END
        inside = np.ones(firsts[-1], bool)
        inside[firsts[1:] - 1] = False
        symbols[:-1][inside] = number + 2
        order = suffix_array(symbols)
        row = symbols[order - 1]
        smaller = np.r_[0, np.cumsum(np.bincount(symbols, minlength=len(vocabulary) + 2))]
        levels, zeros = [], []
        for bit in reversed(range(max(int(len(vocabulary) + 1).bit_length(), 1))):
            one = (row >> bit) & 1 == 1
            levels.append(Bits.of(one))
            zeros.append(len(row) - int(one.sum()))
            row = np.concatenate([row[~one], row[one]])
        keep = order % SAMPLED == 0
        return cls(vocabulary, smaller, levels, np.array(zeros), Bits.of(keep), order[keep].astype(np.uint32), firsts, counts)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low = np.zeros_like(place)
        top = len(self.levels) - 1
        for i, bits in enumerate(self.levels):
            one = (symbol >> (top - i)) & 1 == 1
            a, b = bits.ones(low), bits.ones(place)
            low = np.where(one, self.zeros[i] + a, low - a)
            place = np.where(one, self.zeros[i] + b, place - b)
        return place - low

    def back(self, place: np.ndarray) -> np.ndarray:
        """The row of the suffix one position earlier."""
        symbol, at = np.zeros_like(place), place
        start = np.zeros_like(place)
        for i, bits in enumerate(self.levels):
            one, a, b = bits.at(at), bits.ones(start), bits.ones(at)
            start = np.where(one, self.zeros[i] + a, start - a)
            at = np.where(one, self.zeros[i] + b, at - b)
            symbol = symbol * 2 + one
        return self.smaller[symbol] + at - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases: hashes right-aligned in the columns of a matrix."""
        n = len(lengths)
        known = np.searchsorted(self.vocabulary, phrases)
        found = np.zeros(phrases.shape, bool)
        if len(self.vocabulary):
            found = self.vocabulary[np.minimum(known, len(self.vocabulary) - 1)] == phrases
        width = phrases.shape[1]
        need = np.arange(width)[None, :] >= width - lengths[:, None]
        live = np.flatnonzero((found | ~need).all(axis=1) & (lengths > 0))
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        high[live] = self.smaller[-1]
        for column in reversed(range(width)):
            at = live[need[live, column]]
            symbol = known[at, column] + 2
            low[at] = self.smaller[symbol] + self.rank(symbol, low[at])
            high[at] = self.smaller[symbol] + self.rank(symbol, high[at])
            live = live[high[live] > low[live]]
        high[np.setdiff1d(np.arange(n), live)] = 0
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of rows."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            there = self.marked.at(rows[todo])
            done = todo[there]
            out[done] = self.kept[self.marked.ones(rows[done])] + steps[done]
            todo = todo[~there]
            rows[todo] = self.back(rows[todo])
            steps[todo] += 1
        return out

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and position of every occurrence, by position."""
        low, high = self.search(phrases.hashes, phrases.lengths)
        size = high - low
        phrase = np.repeat(np.arange(len(size)), size)
        rows = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        at = self.locate(rows)
        order = np.argsort(at, kind="stable")
        return phrase[order], at[order]

    def spans(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences merged into spans of positions; spans never leave a text."""
        edge = np.zeros(int(self.firsts[-1]) + 2, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        inside = np.r_[False, np.cumsum(edge) > 0]
        return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"level{i}_{name}": getattr(b, name) for i, b in enumerate(self.levels) for name in ("words", "before")}
        np.savez(
            out, vocabulary=self.vocabulary, smaller=self.smaller, zeros=self.zeros, kept=self.kept, firsts=self.firsts,
            n_words=self.n_words, marked_words=self.marked.words, marked_before=self.marked.before, **arrays,
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, stored: bytes) -> Index:
        a = np.load(io.BytesIO(stored))
        levels = [Bits(a[f"level{i}_words"], a[f"level{i}_before"]) for i in range(len(a["zeros"]))]
        marked = Bits(a["marked_words"], a["marked_before"])
        return cls(a["vocabulary"], a["smaller"], levels, a["zeros"], marked, a["kept"], a["firsts"], a["n_words"])


@dataclass
class Phrases:
    """Distinct windows of benchmark items: hashes right-aligned, lengths, and their items."""

    hashes: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    more: bool = False  # whether another block follows


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in tokens.slices(batch.column(1)):
            words = texts.words(tokens.ALNUM, lower=True)
            edges = words.firsts()
            items, found, sizes = [], [], []
            for i in range(len(texts)):
                own = words.hashes[edges[i] : edges[i + 1]]
                if len(own):
                    views = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                    items += [batch.column(0)[texts.first + i].as_py()] * len(views)
                    found += [v.tobytes() for v in views]
                    sizes += [views.shape[1]] * len(views)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())],
                names=["item", "window", "n"],
            )


def phrase_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark's distinct windows, in blocks of about ``BLOCK_WORDS`` words."""
    rows = staged(
        benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), text)
        .mapInArrow(lambda batches: _windows(batches, window), "item string, window binary, n bigint")
        .groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items")),
        "phrases",
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        found = own.orderBy("window").collect()  # a block
        hashes = np.zeros((len(found), window), np.uint64)
        for i, row in enumerate(found):
            hashes[i, window - row.n :] = np.frombuffer(row.window, np.uint64)
        yield Phrases(hashes, np.array([r.n for r in found], np.int64), [list(r["items"]) for r in found], block + 1 < blocks)


@dataclass
class Shard:
    """Batches of whole rows, and the words of their texts."""

    batches: list[pa.RecordBatch]
    hashes: list[np.ndarray]
    counts: list[np.ndarray]
    starts: list[list[np.ndarray]]  # byte ranges of the words, per slice, if wanted
    ends: list[list[np.ndarray]]

    def index(self) -> Index:
        none = np.zeros(0, np.int64)
        return Index.build(np.concatenate([none.astype(np.uint64), *self.hashes]), np.concatenate([none, *self.counts]))


def shards(batches: Iterator[pa.RecordBatch], place: int, bytes_too: bool = False, most: int = SHARD_WORDS) -> Iterator[Shard]:
    """The rows of a task in shards of at most ``most`` words, or of one longer text."""
    held, size = Shard([], [], [], [], []), 0
    for batch in batches:
        for texts in tokens.slices(batch.column(place)):
            words = texts.words(tokens.ALNUM, lower=True)
            counts, edges = words.counts(), words.firsts()
            first = 0
            while first < len(texts):
                room = int(np.searchsorted(np.cumsum(counts[first:] + 1), most - size, side="right"))
                if not room and size:
                    yield held
                    held, size = Shard([], [], [], [], []), 0
                    continue
                last = first + max(room, 1)
                a, b = edges[first], edges[last]
                held.batches.append(batch.slice(texts.first + first, last - first))
                held.hashes.append(words.hashes[a:b])
                held.counts.append(counts[first:last])
                if bytes_too:
                    at = texts.offsets[first:last]
                    cut = range(first, last)
                    held.starts.append([words.starts[edges[i] : edges[i + 1]] - o for i, o in zip(cut, at, strict=True)])
                    held.ends.append([words.ends[edges[i] : edges[i + 1]] - o for i, o in zip(cut, at, strict=True)])
                size += int((counts[first:last] + 1).sum())
                first = last
    if held.batches:
        yield held


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: its name, the keys of its texts in order, and the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, 1):
            keys = pa.concat_arrays([b.column(0) for b in shard.batches])
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            index = shard.index().to_bytes()
            name = hashlib.sha256(str(keys).encode() + index).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), lists, pa.array([index], pa.binary())], names=["shard", "keys", "index"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"shard string, keys array<{kind}>, index binary")


def _hits(index: DataFrame, phrases, key_kind: str) -> DataFrame:
    """Per text of every shard: key, its number in the shard, n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Phrases = phrases.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column(1)[row].values
                shard = Index.from_bytes(batch.column(2)[row].as_py())
                phrase, at = shard.occurrences(wanted)
                first, last = shard.spans(at, wanted.lengths[phrase])
                span_of, hit_of = (np.searchsorted(shard.firsts, x, side="right") - 1 for x in (first, at))
                items = [set() for _ in range(len(keys))]
                for text, p in set(zip(hit_of.tolist(), phrase.tolist(), strict=True)):
                    items[text].update(wanted.items[p])
                spans = [[] for _ in range(len(keys))]
                for text, a, b in zip(span_of.tolist(), first.tolist(), last.tolist(), strict=True):
                    start = int(shard.firsts[text])
                    spans[text].append({"first": a - start, "last": b - start})
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * len(keys), pa.string()), keys, pa.array(np.arange(len(keys))), pa.array(shard.n_words), pa.array(spans, kind),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["shard", "key", "number", "n_words", "spans", "items"],
                )

    schema = f"shard string, key {key_kind}, number bigint, n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"
    return index.mapInArrow(run, schema)


def _hit_words(spans: Column) -> Column:
    """Words in spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["last"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_words, n_hit, n_items, items_sha256, contaminated and the spans hit.

    Spans are pairs of word numbers, the last one excluded.  Null and empty texts have no
    words and no hits; repeated rows come back each; a benchmark without words hits nothing;
    an empty table gives no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    index, hits = build_index(docs, key, text), []
    for block in phrase_blocks(benchmark):
        if hits or block.more:  # searched more than once: stored before
            index = index if hits else staged(index, "fm-index")
        hits.append(_hits(index, spark.sparkContext.broadcast(block), kind))
    found = hits[0]
    if len(hits) > 1:
        found = (
            reduce(DataFrame.union, hits).groupBy("shard", "number")
            .agg(
                F.first("key").alias("key"), F.first("n_words").alias("n_words"),
                F.flatten(F.collect_list("spans")).alias("spans"),
                F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            )
        )
    n_items = F.size("items").cast("long")
    return found.select(
        F.col("key").alias(key), "n_words", _hit_words(F.col("spans")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages, with all columns, whatever their names.

    A span is cut out of the text from its first word to its last, and one line feed stands
    for it; a text left without a word goes.  Texts without a hit stay byte for byte.
    Every block of a large benchmark is searched in the original words; the spans are cut once.
    """
    place, spark = docs.columns.index(text), docs.sparkSession
    blocks = [spark.sparkContext.broadcast(block) for block in phrase_blocks(benchmark)]
    return docs.mapInArrow(_cutter(blocks, place), docs.schema)


def _blocks(broadcasts: list) -> Iterator[Phrases]:
    """The blocks one after another; of several, each is let go before the next is loaded."""
    for one in broadcasts:
        yield one.value
        if len(broadcasts) > 1 and one._path is not None:  # read from its file again when wanted
            del one._value


def _cutter(blocks: list, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, place, bytes_too=True):
            index = shard.index()
            first = last = np.zeros(0, np.int64)
            for wanted in _blocks(blocks):
                phrase, at = index.occurrences(wanted)
                a, b = index.spans(at, wanted.lengths[phrase])
                first, last = index.spans(np.r_[first, a], np.r_[last - first, b - a])
            owner = np.searchsorted(index.firsts, first, side="right") - 1
            spans: dict[int, list[tuple[int, int]]] = {}
            for number, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
                start = int(index.firsts[number])
                spans.setdefault(number, []).append((a - start, b - start))
            number = 0
            for batch, starts, ends in zip(shard.batches, shard.starts, shard.ends, strict=True):
                own = {i: spans[number + i] for i in range(batch.num_rows) if number + i in spans}
                number += batch.num_rows
                yield _cut(batch, place, own, starts, ends) if own else batch

    return run


def _cut(batch: pa.RecordBatch, place: int, spans: dict, starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.RecordBatch:
    texts, keep = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
    for i, own in spans.items():
        data, at, parts = texts[i].encode(), 0, []
        for a, b in own:
            parts.append(data[at : starts[i][a]])
            at = int(ends[i][b - 1])
        parts.append(data[at:])
        texts[i] = b"\n".join(parts).decode()
        keep[i] = sum(b - a for a, b in own) < len(starts[i])
    columns = list(batch.columns)
    columns[place] = pa.array(texts, batch.schema.field(place).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
