"""Language-model scores from an Elias-Fano n-gram trie.

The first level of the trie are the words of the training texts, sorted by hash; the second
holds each word's successors.  A successor is kept relative to its context, as
``context * vocabulary + word``, so that a whole level is one increasing sequence; it is
Elias-Fano coded, and so are the pointers to where each context's successors begin.  Beside
the successors stand their discounted probabilities in 16-bit steps.  A query takes its
context's part of the sequence and looks for the successor there.

    P(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * (c(w) + 1) / (N + V + 1)

``n(v)`` are the distinct successors of v.  A level is a set of files, each of a range of words
(and a slice of their successors, so that no frequent word makes a large file).  Tasks build
the files from the shuffled counts of their range, and scoring tasks map them into memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.plans.staging import staging_root

#: What is taken from the count of every pair seen.
DISCOUNT = 0.75
#: Steps of a stored probability's negative decimal logarithm.
STEP = 4096
#: Rows for each range of words.
RANGE_ROWS = 8_000
#: Slices of a range's successors.
SLICES = 4
#: Tokens that are counted or scored at once, as far as whole texts allow.
BLOCK = 1 << 18

#: Hash of the token that ends every text.
END = np.uint64(0x5851F42D4C957F2D)


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth one in each 64-bit word."""
    place, left, rest = np.zeros(len(words), np.int64), words.copy(), nth.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(left & np.uint64((1 << width) - 1)).astype(np.int64)
        up = rest >= low
        rest = np.where(up, rest - low, rest)
        left = np.where(up, left >> np.uint64(width), left)
        place += up * width
    return place


@dataclass
class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary."""

    size: int
    width: int  # low bits of a number
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # ones before each word of ``high``
    zeros: np.ndarray  # zeros before it

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max((universe // max(n, 1)).bit_length() - 1, 0)
        values = values.astype(np.uint64)
        top = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        length = (universe >> width) + n + 2
        bits = np.zeros((length // 64 + 1) * 64, bool)
        bits[top + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high[:-1]), dtype=np.int64)]
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            kept = values & np.uint64((1 << width) - 1)
            word, shift = np.divmod(np.arange(n, dtype=np.int64) * width, 64)
            np.bitwise_or.at(low, word, kept << shift.astype(np.uint64))
            over = np.flatnonzero(shift + width > 64)
            np.bitwise_or.at(low, word[over] + 1, kept[over] >> (64 - shift[over]).astype(np.uint64))
        return cls(n, width, low, high, ones, 64 * np.arange(len(high)) - ones)

    def _low(self, at: np.ndarray) -> np.ndarray:
        word, shift = np.divmod(at * self.width, 64)
        shift = shift.astype(np.uint64)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | over) & np.uint64((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at places of the sequence."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        place = 64 * word + _select(self.high[word], at - self.ones[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def _upto(self, top: np.ndarray) -> np.ndarray:
        """How many numbers have a high part of at most ``top`` (-1: none)."""
        out, some = np.zeros(len(top), np.int64), np.flatnonzero(top >= 0)
        nth = top[some]
        word = np.searchsorted(self.zeros, nth, side="right") - 1
        out[some] = 64 * word + _select(~self.high[word], nth - self.zeros[word]) - nth
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of numbers in the sequence; -1 where there is none.

        The numbers with the wanted high part are neighbours, and a frequent context has many
        of them: they are halved until the successor is found.
        """
        top = (wanted >> np.uint64(self.width)).astype(np.int64)
        low = wanted & np.uint64((1 << self.width) - 1)
        first, last = self._upto(top - 1), self._upto(top)
        end, live = last.copy(), np.flatnonzero(first < last)
        while len(live):
            middle = (first[live] + last[live]) >> 1
            less = self._low(middle) < low[live]
            first[live] = np.where(less, middle + 1, first[live])
            last[live] = np.where(less, last[live], middle)
            live = live[first[live] < last[live]]
        found, here = np.full(len(wanted), -1), np.flatnonzero(first < end)
        same = here[self._low(first[here]) == low[here]]
        found[same] = first[same]
        return found

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        shape = np.array([self.size, self.width])
        return {f"{name}_{k}": v for k, v in (("shape", shape), ("low", self.low), ("high", self.high), ("ones", self.ones), ("zeros", self.zeros))}

    @classmethod
    def stored(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        size, width = (int(x) for x in a[f"{name}_shape"])
        return cls(size, width, *(a[f"{name}_{k}"] for k in ("low", "high", "ones", "zeros")))


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays.  A second attempt of a task replaces the first one's file whole."""
    store, place = stores.FileSystem.from_uri(path)
    fields = [pa.field(k, pa.large_binary(), metadata={"dtype": v.dtype.str}) for k, v in arrays.items()]
    values = [pa.array([np.ascontiguousarray(v).tobytes()], pa.large_binary()) for v in arrays.values()]
    part = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out, pa.ipc.new_file(out, pa.schema(fields)) as file:
        file.write_batch(pa.RecordBatch.from_arrays(values, schema=pa.schema(fields)))
    store.move(part, place)


@lru_cache(maxsize=4096)
def read_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped where the store is a mounted folder, else read."""
    if urlparse(path).scheme in ("", "file"):
        source = pa.memory_map(urlparse(path).path)
    else:
        store, place = stores.FileSystem.from_uri(path)
        source = store.open_input_file(place)
    batch = pa.ipc.open_file(source).get_batch(0)
    out = {}
    for i, f in enumerate(batch.schema):
        _, edges, data = batch.column(i).buffers()  # a scalar would be a copy
        size = int(np.frombuffer(edges, np.int64, 2)[1])
        dtype = np.dtype(f.metadata[b"dtype"].decode())
        out[f.name] = np.frombuffer(data, dtype, size // dtype.itemsize) if size else np.zeros(0, dtype)
    return out


@dataclass
class Trie:
    """The files of a model and its totals; small, and sent with the tasks."""

    folder: str
    ranges: int
    slices: int = SLICES
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # id of each range's first word, and V
    tokens: int = 0
    texts: int = 0

    @property
    def words(self) -> int:
        return int(self.firsts[-1])

    @property
    def begin(self) -> int:
        """The context before a text's first token, after all words."""
        return self.words

    @property
    def step(self) -> int:
        return -(-(1 << 64) // self.ranges)

    def path(self, *parts: int) -> str:
        return f"{self.folder}/{'-'.join(f'{p:06d}' for p in parts)}.arrow"

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        if self.ranges == 1:
            return np.zeros(len(hashes), np.int64)
        return (hashes // np.uint64(self.step)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not in training) and counts of words with sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(self.range_of(hashes), np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(edges)):
            a, b = edges[r], edges[r + 1]
            if self.firsts[r + 1] == self.firsts[r]:
                continue
            level = read_arrays(self.path(r))
            at = EliasFano.stored(level, "words").find(hashes[a:b] - np.uint64(int(r) * self.step))
            known = at >= 0
            ids[a:b][known] = at[known] + self.firsts[r]
            counts[a:b][known] = level["counts"][at[known]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words with sorted ids."""
        out = np.zeros(len(ids), np.int64)
        edges = np.searchsorted(ids, self.firsts)
        for r in np.flatnonzero(np.diff(edges)):
            own = slice(edges[r], edges[r + 1])
            out[own] = read_arrays(self.path(r))["counts"][ids[own] - self.firsts[r]]
        return out

    def range_of_context(self, context: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.firsts, context, side="right") - 1, self.ranges - 1)

    def slice_of(self, word: np.ndarray) -> np.ndarray:
        return (tokens.mix(word.astype(np.uint64)) % np.uint64(self.slices)).astype(np.int64)

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Discounted probabilities of pairs of ids; 0 for pairs not in training."""
        out = np.zeros(len(context))
        part = self.range_of_context(context) * self.slices + self.slice_of(word)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.ranges * self.slices + 1))
        for p in np.flatnonzero(np.diff(edges)):
            own = order[edges[p] : edges[p + 1]]
            r = p // self.slices
            level = read_arrays(self.path(r, p % self.slices))
            relative = (context[own] - self.firsts[r]) * max(self.words, 1) + word[own]
            at = EliasFano.stored(level, "successors").find(relative.astype(np.uint64))
            known = at >= 0
            out[own[known]] = 10.0 ** (level["codes"][at[known]] / -float(STEP))
        return out

    def successors(self, context: np.ndarray) -> np.ndarray:
        """Numbers of distinct successors of sorted context ids."""
        out = np.zeros(len(context), np.int64)
        edges = np.searchsorted(self.range_of_context(context), np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(edges)):
            own = slice(edges[r], edges[r + 1])
            for s in range(self.slices):
                pointers = EliasFano.stored(read_arrays(self.path(r, s)), "pointers")
                at = context[own] - self.firsts[r]
                out[own] += (pointers.get(at + 1) - pointers.get(at)).astype(np.int64)
        return out


@dataclass
class Sequence:
    """The tokens of some texts, each text's end included."""

    hashes: np.ndarray
    owner: np.ndarray
    firsts: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], place: int, most: int = BLOCK) -> Iterator[tuple[list[pa.RecordBatch], Sequence]]:
    """The rows of a task with the tokens of their texts, some rows at a time."""

    def joined() -> Sequence:
        owner = np.concatenate(owners)
        return Sequence(np.concatenate(hashes), owner, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))

    held, hashes, owners, texts_held, size = [], [], [], 0, 0
    for batch in batches:
        for texts in tokens.slices(batch.column(place)):
            words = texts.words(lower=True)
            own = np.full(len(words) + len(texts), END)
            own[np.arange(len(words)) + words.owner] = words.hashes
            held.append(batch.slice(texts.first, len(texts)))
            hashes.append(own)
            owners.append(np.repeat(np.arange(len(texts)), words.counts() + 1) + texts_held)
            texts_held += len(texts)
            size += len(own)
            if size >= most:
                yield held, joined()
                held, hashes, owners, texts_held, size = [], [], [], 0, 0
    if held:
        yield held, joined()


def held_out(key: Column) -> Column:
    """Texts that the model does not learn from; a text with a null key is learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


_PART = "part bigint, n bigint, keys binary, counts binary, texts bigint"


def _pack(values: np.ndarray) -> bytes:
    """64-bit values, compressed byte plane by byte plane: the high planes are nearly empty."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(n)


def _parts(part: np.ndarray, keys: np.ndarray, counts: np.ndarray, texts: int) -> Iterator[pa.RecordBatch]:
    """Counted keys, sorted by part, as one row for each part."""
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    rows = [
        (int(part[a]), b - a, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b].astype(np.uint64)))
        for a, b in zip(edges, edges[1:], strict=False)
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()),
         pa.array([texts] + [0] * (len(rows) - 1), pa.int64())],
        names=["part", "n", "keys", "counts", "texts"],
    )


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(x.as_py(), n), dtype=np.uint64) for x, n in zip(table.column("keys"), sizes, strict=True)])
    counts = np.concatenate([_unpack(x.as_py(), n) for x, n in zip(table.column("counts"), sizes, strict=True)])
    distinct, number = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)


def _count_words(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, seq in _blocks(batches, 0):
            distinct, counts = np.unique(seq.hashes, return_counts=True)
            yield from _parts(trie.range_of(distinct), distinct, counts, len(seq.firsts))

    return run


def _write_words(trie: Trie):
    def run(table: pa.Table) -> pa.Table:
        r = table.column("part")[0].as_py()
        distinct, counts = _merged(table)
        words = EliasFano.of(distinct - np.uint64(r * trie.step), trie.step)
        write_arrays(trie.path(r), words.arrays("words") | {"counts": counts})
        texts = sum(table.column("texts").to_pylist())
        return pa.table({"part": [r], "words": [len(distinct)], "tokens": [int(counts.sum())], "texts": [texts]})

    return run


def _ids(trie: Trie, seq: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of all tokens, and the ids of what stands before them."""
    distinct, number = np.unique(seq.hashes, return_inverse=True)
    ids, counts = trie.lookup(distinct)
    ids, counts = ids[number], counts[number]
    context = np.r_[0, ids[:-1]]
    context[seq.firsts] = trie.begin
    return ids, counts, context


def _count_pairs(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, seq in _blocks(batches, 0):
            ids, _, context = _ids(trie, seq)
            pairs, counts = np.unique(context.astype(np.uint64) * np.uint64(trie.words) + ids.astype(np.uint64), return_counts=True)
            first, word = np.divmod(pairs.astype(np.int64), trie.words)
            part = trie.range_of_context(first) * trie.slices + trie.slice_of(word)
            order = np.argsort(part, kind="stable")
            yield from _parts(part[order], pairs[order], counts[order], 0)

    return run


def _write_pairs(trie: Trie):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        r = part // trie.slices
        pairs, counts = _merged(table)
        begin, end = int(trie.firsts[r]), int(trie.firsts[r + 1]) + (r == trie.ranges - 1)
        relative = pairs - np.uint64(begin * trie.words)
        context = (relative // np.uint64(trie.words)).astype(np.int64)
        seen = np.zeros(end - begin, np.int64)
        if trie.firsts[r + 1] > trie.firsts[r]:
            seen[: int(trie.firsts[r + 1]) - begin] = read_arrays(trie.path(r))["counts"]
        if r == trie.ranges - 1:
            seen[-1] = trie.texts
        codes = np.rint(-np.log10((counts - DISCOUNT) / seen[context]) * STEP)
        pointers = np.searchsorted(context, np.arange(end - begin + 1)).astype(np.uint64)
        arrays = EliasFano.of(relative, (end - begin) * trie.words + 1).arrays("successors")
        arrays |= EliasFano.of(pointers, len(pairs) + 1).arrays("pointers")
        write_arrays(trie.path(r, part % trie.slices), arrays | {"codes": np.minimum(codes, 65535).astype(np.uint16)})
        return pa.table({"part": [part], "pairs": [len(pairs)]})

    return run


def build(docs: DataFrame, text: str = "text", ranges: int | None = None, folder: str | None = None) -> Trie:
    """The trie of all texts of ``docs``, in files below ``folder`` (default: the shared folder).

    Words and pairs are counted in blocks of tokens; a block's counts go to the tasks of their
    ranges, which merge them and write the files.  The driver learns one row of totals for
    each range.
    """
    spark = docs.sparkSession
    ranges = ranges or max(1, -(-docs.count() // RANGE_ROWS))
    folder = folder or f"{staging_root(spark)}/trie-{uuid.uuid4().hex}"
    store, place = stores.FileSystem.from_uri(folder)
    store.create_dir(place)
    trie = Trie(folder, ranges)
    words = docs.select(text).mapInArrow(_count_words(trie), _PART)
    found = words.groupBy("part").applyInArrow(_write_words(trie), "part bigint, words bigint, tokens bigint, texts bigint").collect()
    sizes = np.zeros(ranges, np.int64)
    for row in found:
        sizes[row.part] = row.words
    trie.firsts = np.r_[0, np.cumsum(sizes)]
    trie.tokens, trie.texts = sum(r.tokens for r in found), sum(r.texts for r in found)
    if trie.words:
        pairs = docs.select(text).mapInArrow(_count_pairs(trie), _PART)
        every = spark.range(ranges * trie.slices).select(  # every file is written, also without a pair
            F.col("id").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"),
            F.lit(0).cast("long").alias("texts"),
        )
        pairs.union(every).groupBy("part").applyInArrow(_write_pairs(trie), "part bigint, pairs bigint").agg(F.sum("pairs")).collect()
    return trie


def _score(trie: Trie, seq: Sequence) -> dict[str, np.ndarray]:
    n = len(seq.firsts)
    if trie.words:
        ids, counts, context = _ids(trie, seq)
    else:
        ids = context = np.full(len(seq.hashes), -1)
        counts = np.zeros(len(seq.hashes), np.int64)
    single = (counts + 1) / (trie.tokens + trie.words + 1)
    distinct, number = np.unique(context, return_inverse=True)
    known = distinct >= 0
    left = np.ones(len(distinct))  # what the discount leaves to the single words
    if known.any():
        own = distinct[known]
        seen = np.full(len(own), trie.texts, np.float64)
        seen[own < trie.begin] = trie.counts_of(own[own < trie.begin])
        left[known] = DISCOUNT * trie.successors(own) / seen
    probability = left[number] * single
    both = np.flatnonzero((context >= 0) & (ids >= 0))
    if len(both):
        pairs, which = np.unique(context[both] * trie.words + ids[both], return_inverse=True)
        first, word = np.divmod(pairs, trie.words)
        probability[both] += trie.pairs(first, word)[which]
    total = lambda x: np.bincount(seq.owner, weights=x, minlength=n)
    return {
        "n_tokens": np.bincount(seq.owner, minlength=n), "n_known": np.bincount(seq.owner[counts > 0], minlength=n),
        "train_tokens": np.full(n, trie.tokens), "base_score": total(np.log10(single)), "score": total(np.log10(probability)),
    }


def scores(docs: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are scored as their end alone; a model of no texts gives every token
    the probability of an unseen one; repeated rows score alike; whole texts count; an empty
    table gives no rows; other columns are not read.
    """
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, seq in _blocks(batches, 2):
            found = _score(trie, seq)
            keys = [pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(found[c]) for c in columns)], names=[key, "held_out", *columns])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select(key, held_out(docs[key]).alias("_held_out"), text).mapInArrow(run, schema)
