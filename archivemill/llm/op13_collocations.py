"""Phrases that stick together, by prefix-free parsing.

A text's words are cut into chunks where the hash of the next four words says so; a chunk goes on for
four words into the next one, so every run of up to five words lies whole in the chunk that owns its first
word.  The distinct chunks and how often they occur are the dictionary, over which everything is counted:
a run of words counts in the chunk that owns it, as often as the chunk occurs.

Counting is by levels.  Tasks add up occurrences in 2**32 buckets by hash; buckets that reach the
least count set bits in a map of fixed size, which goes to the next level's tasks: longer runs
count only if all their pairs may be frequent.  Buckets only say what cannot be frequent.  The last
pass counts what is left by 64-bit hashes, and notes for each a chunk that has it, from which the phrase
is read.  Sums go out packed, a row per range of hashes and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.shared import staged
from archivemill.llm.tokens import Texts, Words

#: Words of the longest phrase, and what a chunk shares with the next.
LONGEST = 5
OVERLAP = LONGEST - 1
#: Words of a chunk, on average.
PERIOD = 32
#: Bits of the map; ranges of buckets that are added up together; occurrences a task adds up before it hands them on.
MAP_BITS = 27
RANGE_BITS = 10
RANGES = 1 << RANGE_BITS
HELD = 1 << 21
#: Bytes of chunks that a task works on at once, and phrases it holds before it hands them on.
AT_ONCE = 4 << 20
PHRASES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECE_END = tokens.table(lambda b: b in _ENDS)
WORD = tokens.table(lambda b: b not in _ENDS + b" \t")

_CHUNKS = "lang string, owned int, chunk string"
_COUNTS = "range int, keys binary, counts binary"


def _step(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs that are a word longer."""
    return tokens.chained([gram, word])


def chunked(words: Words, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each chunk, the word after its last own one, and the word after its last."""
    firsts = words.firsts()
    at, hashes = words.grams(OVERLAP)
    begins = np.unique(np.r_[firsts[:-1][words.counts() > 0], at[hashes % np.uint64(period) == 0]])
    if not len(begins):
        return begins, begins, begins
    text_end = firsts[words.owner[begins] + 1]
    own_end = np.minimum(np.r_[begins[1:], len(words)], text_end)
    return begins, own_end, np.minimum(own_end + OVERLAP, text_end)


def _parse(period: int):
    """Chunks of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.slices(batch.column(1)):
                words, raw = texts.words(WORD, lower=True), _LOWER[texts.data].tobytes()
                begins, own_end, end = chunked(words, period)
                spans = zip(words.starts[begins].tolist(), words.ends[end - 1].tolist(), strict=True)
                chunks = pa.array([raw[a:b] for a, b in spans], pa.binary()).cast(pa.string())
                lang = batch.column(0).take(pa.array(words.owner[begins] + texts.first))
                yield pa.RecordBatch.from_arrays([lang, pa.array((own_end - begins).astype(np.int32)), chunks], names=["lang", "owned", "chunk"])

    return run


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", period: int = PERIOD) -> DataFrame:
    """The distinct chunks of each language: lang, owned (words that begin in it), chunk, times."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = rows.where(F.col("text").isNotNull()).mapInArrow(_parse(period), _CHUNKS)
    return chunks.groupBy("lang", "owned", "chunk").agg(F.count(F.lit(1)).alias("times"))


class Grams:
    """Runs of words of some dictionary rows: hashes by length, and where runs begin that count."""

    def __init__(self, texts: Texts, lang: np.ndarray, owned: np.ndarray, times: np.ndarray):
        self.words = words = texts.words(WORD)
        n = len(words)
        place = np.arange(n) - words.firsts()[words.owner]
        self.own = place < owned[words.owner]
        self.times = times[words.owner]
        ended = np.cumsum(_PIECE_END[texts.data])[words.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (words.owner[1:] != words.owner[:-1]) | (ended[1:] != ended[:-1])
        begins = np.flatnonzero(new)
        self.reach = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n])) - np.arange(n)
        gram = _step(lang[words.owner], words.hashes)
        self.hashes = [gram]
        for size in range(2, LONGEST + 1):
            gram = _step(gram[: max(n - size + 1, 0)], words.hashes[size - 1 :])
            self.hashes.append(gram)

    def whole(self, size: int) -> np.ndarray:
        """Places where a run of that many words lies in one piece."""
        return self.reach[: len(self.hashes[size - 1])] >= size

    def starts(self, size: int, maybe: np.ndarray | None = None) -> np.ndarray:
        """Places of the runs that count; with a map, only those all of whose pairs are in it."""
        good = self.own[: len(self.hashes[size - 1])] & self.whole(size)
        if maybe is not None and size > 2:
            pair = marked(maybe, self.hashes[1])
            for k in range(size - 1):
                good = good & pair[k : k + len(good)]
        return np.flatnonzero(good)


def marked(maybe: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each hash."""
    bit = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (maybe[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Texts, pa.Table, Grams]]:
    """Rows with lang, owned, chunk and times, many batches at once; the texts are some of the table's."""

    def gathered():
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= AT_ONCE:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    for rows in gathered():
        if not rows.num_rows:
            continue
        names = rows.column("lang").combine_chunks().dictionary_encode()
        codes = next(tokens.slices(names.dictionary, limit=1 << 60))
        edges = codes.offsets
        lang = codes.hashes(edges[:-1], edges[1:])[names.indices.to_numpy()]
        owned, times = rows.column("owned").to_numpy(), rows.column("times").to_numpy()
        for texts in tokens.slices(rows.column("chunk"), limit=AT_ONCE):
            part = slice(texts.first, texts.first + len(texts))
            yield texts, rows, Grams(texts, lang[part], owned[part], times[part])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, without the planes that are zero: small ones compress well."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    used = 8 - int(np.argmax(planes[::-1].any(axis=1))) if planes.any() else 0
    return bytes([used]) + planes[:used].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[: data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Sorted distinct keys of so many bits, range by range: its number, bounds, and the packed gaps between keys."""
    shift = np.uint64(bits - RANGE_BITS)
    edges = np.searchsorted(keys >> shift, np.arange(RANGES + 1, dtype=np.uint64)).tolist()
    for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            gaps = np.diff(keys[a:b], prepend=np.uint64(r) << shift)
            yield r, a, b, np.uint32(b - a).tobytes() + packed(gaps)


def _keys(r: int, data: bytes, bits: int) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.cumsum(unpacked(data[4:], n)) + (np.uint64(r) << np.uint64(bits - RANGE_BITS))


def _handed_on(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sums by bucket, a row per range."""
    rows = [(r, gaps, packed(counts[a:b] - 1)) for r, a, b, gaps in _by_range(keys, 32)]
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["range", "keys", "counts"])


def _counted(sizes: range, sent=None):
    """Occurrences by bucket of the runs of the given lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, maybe = 0, sent.value if sent else None
        for _, _, grams in _grams(batches):
            for size in sizes:
                at = grams.starts(size, maybe)
                held.append((grams.hashes[size - 1][at] >> np.uint64(32), grams.times[at]))
                n += len(at)
            if n >= HELD:
                held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                yield _handed_on(*held.pop())
                n = 0
        if n:
            yield _handed_on(*_added(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _frequent(least: int):
    """The map's bytes of each range; rows come by range, and at most a range's buckets are held."""

    def bits(r: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _added(*map(np.concatenate, zip(*held, strict=True)))
        out = np.zeros((1 << MAP_BITS) // RANGES, bool)
        out[(keys[counts >= least] >> np.uint64(32 - MAP_BITS)).astype(np.int64) - r * len(out)] = True
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], names=["range", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = -1, [], 0
        for batch in batches:
            for r, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now and held:
                    yield bits(now, held)
                    held, n = [], 0
                now, own = r, _keys(r, keys, 32)
                held.append((own, unpacked(counts, len(own)).astype(np.int64) + 1))
                n += len(own)
                if n >= HELD:
                    held, n = [_added(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            yield bits(now, held)

    return run


def _map(chunks: DataFrame, sizes: range, least: int, sent=None) -> np.ndarray:
    """The bits of the runs that may occur often enough: 2**MAP_BITS of them, whatever the input."""
    sums = chunks.mapInArrow(_counted(sizes, sent), _COUNTS)
    ranges = sums.repartition("range").sortWithinPartitions("range").mapInArrow(_frequent(least), "range int, bits binary")
    width = (1 << MAP_BITS) // 8 // RANGES
    out = np.zeros(RANGES * width, np.uint8)
    for r, own in ranges.collect():
        out[r * width : (r + 1) * width] = np.frombuffer(own, np.uint8)
    return out


def _first(hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, their sums, and the first id of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts, ids = hashes[order], counts[order], ids[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], np.add.reduceat(counts, starts) if len(hashes) else counts, ids[starts]


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _first(*map(np.concatenate, zip(*held, strict=True)))


def _located(sent):
    """Counts by hash of the phrases that may be frequent, a row per range, each with the id of a chunk that owns one."""

    def rows(hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        found = [(r, gaps, packed(counts[a:b] - 1), ids[a:b].tobytes()) for r, a, b, gaps in _by_range(hashes, 64)]
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["range", "keys", "counts", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, held, n = sent.value, [], 0
        for texts, rows_, grams in _grams(batches):
            ids = rows_.column("id").to_numpy()[texts.first :][grams.words.owner]
            for size in range(1, LONGEST + 1):
                at = grams.starts(size, maybe)
                at = at[marked(maybe, grams.hashes[size - 1][at])]
                held.append((grams.hashes[size - 1][at], grams.times[at], ids[at]))
            held = [_joined(held)]
            if len(held[0][0]) >= PHRASES:
                yield rows(*held.pop())
        if held:
            yield rows(*held.pop())

    return run


def _summed(least: int):
    """Counts by hash of each range: of those that reach ``least``, or of all in parts where a range has very many."""

    def rows(held: list[tuple[np.ndarray, ...]], from_: int) -> pa.RecordBatch:
        hashes, counts, ids = _joined(held)
        good = counts >= from_
        return pa.RecordBatch.from_arrays([pa.array(hashes[good].view(np.int64)), pa.array(counts[good]), pa.array(ids[good])], names=["hash", "f", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, from_ = -1, [], 0, least
        for batch in batches:
            for r, keys, counts, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now and held:
                    yield rows(held, from_)
                    held, n, from_ = [], 0, least
                now, hashes = r, _keys(r, keys, 64)
                held.append((hashes, unpacked(counts, len(hashes)).astype(np.int64) + 1, np.frombuffer(ids, np.int64)))
                n += len(hashes)
                if n >= HELD:
                    held = [_joined(held)]
                    n = len(held[0][0])
                    if 2 * n >= HELD:
                        yield rows(held, 1)
                        held, n, from_ = [], 0, 1
        if held:
            yield rows(held, from_)

    return run


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that a chunk was noted for: rows (lang, owned, chunk, times, hash, f), the last two lists."""
    for texts, rows, grams in _grams(batches):
        part, words, raw = rows.slice(texts.first, len(texts)), grams.words, texts.data.tobytes()
        noted = part.column("hash").combine_chunks()
        wanted = noted.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(texts)), np.diff(noted.offsets.to_numpy()))
        counts, lang = part.column("f").combine_chunks().flatten().to_numpy(), part.column("lang").to_pylist()
        order = np.argsort(wanted, kind="stable")
        wanted, owner, counts, found = wanted[order], owner[order], counts[order], []
        for size in range(1, LONGEST + 1):
            at = grams.starts(size)
            hashes = grams.hashes[size - 1][at]
            # Rows with the same hash, if any, follow each other.
            low, high = np.searchsorted(wanted, hashes), np.searchsorted(wanted, hashes, side="right")
            for i in np.flatnonzero(high > low).tolist():
                for k in range(low[i], high[i]):
                    if owner[k] == words.owner[at[i]]:
                        spans = range(at[i], at[i] + size)
                        found.append((lang[owner[k]], size, b" ".join([raw[words.starts[j] : words.ends[j]] for j in spans]), int(counts[k])))
        columns = zip(*dict.fromkeys(found), strict=True) if found else ((), (), (), ())
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([arrays[0], arrays[1], arrays[2].cast(pa.string()), arrays[3]], names=["lang", "size", "phrase", "f"])


def frequent_phrases(chunks: DataFrame, least: int) -> DataFrame:
    """Every phrase of 1 to 5 words that occurs ``least`` times or more in its language: lang, size, phrase, f."""
    context = chunks.sparkSession.sparkContext
    pairs = _map(chunks, range(1, 3), least)
    longer = _map(chunks, range(3, LONGEST + 1), least, context.broadcast(pairs))
    named = chunks.withColumn("id", F.xxhash64("lang", "owned", "chunk"))
    sums = named.mapInArrow(_located(context.broadcast(pairs | longer)), "range int, keys binary, counts binary, ids binary")
    sums = sums.repartition("range").sortWithinPartitions("range").mapInArrow(_summed(least), "hash bigint, f bigint, id bigint")
    found = sums.groupBy("hash").agg(F.sum("f").alias("f"), F.min("id").alias("id")).where(F.col("f") >= least)
    noted = found.groupBy("id").agg(F.collect_list(F.struct("hash", "f")).alias("noted"))  # at most the phrases of a chunk
    told = named.join(noted, "id").select("lang", "owned", "chunk", "times", F.col("noted.hash").alias("hash"), F.col("noted.f").alias("f"))
    return told.mapInArrow(_spelt, "lang string, size int, phrase string, f bigint").distinct()


def _inside(words: Column, size: Column) -> Column:
    """All shorter runs of two words or more of a phrase, each once."""

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(size > n, runs)

    runs = [of(n) for n in range(2, LONGEST)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*runs))))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, first: int = 2000, share: int = 100, period: int = PERIOD
) -> DataFrame:
    """The ``first`` phrases of each language by how well they stick together: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs
    into words.  A phrase of 2 to 5 words that occurs a >= ``least`` times is cut where floor(1000 * a * n / (l * r)) is
    least (ties: after fewer words), l and r being the counts of the two parts and n the language's words.
    It is dropped if it lies inside a longer one with ``100 * f(longer) >= share * a``.  Order: score, a (both
    descending), phrase (by UTF-8 bytes).

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count each;
    whole texts count, however long; an empty table gives no rows; other columns are not read.
    """
    chunks = staged(dictionary(docs, text, lang, period), "chunks")
    found = staged(frequent_phrases(chunks, least), "phrases")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
    words = F.split("phrase", " ")
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    longer = phrases.where("size > 2").select("lang", F.explode(_inside(F.col("words"), F.col("size"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("tail", F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " "))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    counted = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    score = F.expr("CAST((1000BD * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    lowest = counted.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
