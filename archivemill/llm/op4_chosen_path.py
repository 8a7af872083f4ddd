"""Jaccard join of word shingles by chosen paths.

Each distinct text becomes a vector of minhash coordinates of its five-word shingles; a
coordinate and its value are a token, and two texts share a token with probability their
similarity.  A run splits the texts recursively: at a node every coordinate is chosen with
probability ``1 / (similarity * coordinates)`` by a hash of the node, and texts with the same
value there go to the same child.  Nodes with few texts are compared by brute force; large ones split
again, and what is still large at the last level is compared in pairs of blocks.  Runs
repeat as often as the target recall asks.

The comparison within nodes works on the vectors and only leads to groups of texts that may be
similar; a group is then compared exactly, every pair of it, on the shingles themselves.
Neither step hands on pairs: groups are cut into blocks, one task compares one block with all others of
its group, and gives a row for each text of its own block and the roots that it connects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivemill.llm import tokens
from archivemill.llm.components import components
from archivemill.llm.shared import staged
from archivemill.llm.tokens import Texts, Words

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
#: Levels of a run, and texts of a node that is not split further.
DEPTH = 3
SMALL = 256
#: Target for finding a pair of just the wanted similarity; see ``runs``.
RECALL = 0.99
#: Least share of equal coordinates of a pair that is compared exactly: over three standard deviations below 0.8.
LOOSE = 0.68
#: Texts of a block, and bytes of their shingles.
BLOCK = 128
BLOCK_BYTES = 8 << 20

_SEED = np.uint64(0x632BE59BD9B4E019)
_FACTORS = tokens.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _SEED) | np.uint64(1)


def runs(similarity: float = SIMILARITY, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs needed: a pair shares a chosen token at a level with expectation 1, level upon level."""
    found = 1.0
    for _ in range(depth):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def chosen(nodes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which coordinates each node splits on: a row of truths per node."""
    draws = tokens.mix(nodes[:, None] * _FACTORS[None, :] + _SEED)
    return draws < np.uint64(int(2.0**64 / (similarity * COORDINATES)))


def shingles(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle; a text of fewer words is one shingle."""
    at, grams = words.grams(SHINGLE)
    owner, counts, firsts = words.owner[at], words.counts(), words.firsts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = [tokens.chained([words.hashes[firsts[i] + k : firsts[i] + k + 1] for k in range(counts[i])])[0] for i in short]
        owner, grams = np.r_[owner, short], np.r_[grams, np.array(own, np.uint64)]
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    return owner, grams


def signs(words: Words) -> list[bytes | None]:
    """A 128-bit sign of each text's word sequence; None without words."""
    firsts = words.firsts()
    parts = []
    for salt in (_SEED, _FACTORS[0]):
        place = np.arange(len(words)) - firsts[words.owner]
        terms = tokens.mix(words.hashes + salt) * tokens.mix((place.astype(np.uint64) + np.uint64(1)) * salt)
        sums = np.r_[np.uint64(0), np.cumsum(tokens.mix(terms), dtype=np.uint64)]
        parts.append(sums[firsts[1:]] - sums[firsts[:-1]])
    both = np.stack(parts, axis=1)
    return [both[i].tobytes() if firsts[i + 1] > firsts[i] else None for i in range(words.texts)]


def vectors(owner: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Minhash values, a row of coordinates for each text that has a shingle."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros((len(starts), COORDINATES), np.uint64)
    for i in range(COORDINATES if len(starts) else 0):
        out[:, i] = np.minimum.reduceat(grams * _FACTORS[i], starts)
    return out


def _signed(key: str, first_nodes: np.ndarray):
    """Sign, low bytes of the vector, and the nodes of the first level, for each text."""
    run_of, coordinate = np.nonzero(chosen(first_nodes))
    at_first = tokens.chained([first_nodes[run_of], coordinate.astype(np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.slices(batch.column(1)):
                words = texts.words(lower=True)
                owner, grams = shingles(texts, words)
                values = vectors(owner, grams)
                token = values[:, coordinate]
                nodes = tokens.chained([np.broadcast_to(at_first, token.shape), token])
                has = np.zeros(len(texts), np.int64)
                has[np.unique(owner)] = 1
                row = np.cumsum(has) - 1
                low = (tokens.mix(values) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(signs(words), pa.binary()),
                     pa.array([low[row[i]].tobytes() if has[i] else None for i in range(len(texts))], pa.binary()),
                     pa.array([nodes[row[i]].view(np.int64) if has[i] else [] for i in range(len(texts))], pa.list_(pa.int64()))],
                    names=[key, "sign", "vector", "nodes"],
                )

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of rows (node, sign, vector)."""
    for batch in batches:
        node = batch.column(0).to_numpy().view(np.uint64)
        matrix = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        row, coordinate = np.nonzero(chosen(node))
        child = tokens.chained([node[row], coordinate.astype(np.uint64), matrix[row, coordinate].astype(np.uint64)])
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["node", "sign", "vector"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n is connected to by edges a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first columns, over the bounds of batches; rows come sorted."""
    held: list[pa.RecordBatch] = []

    def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
        return all(x.column(c)[i] == y.column(c)[j] for c in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in range(keys):
            values = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        new[0] = not held or not same(held[-1], held[-1].num_rows - 1, batch, 0)
        cuts = [*np.flatnonzero(new).tolist(), n]
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(rows: DataFrame, group: str, pieces, sign: str = "sign") -> DataFrame:
    """Rows dealt to blocks, one block of a group after the other: columns group, piece, pieces, sign, then the others."""
    others = [c for c in rows.columns if c not in (group, "pieces", sign)]
    dealt = rows.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.pmod(F.xxhash64(sign), F.col("pieces")).cast("int"))
    return dealt.select(group, "piece", "pieces", sign, *others).repartition(group, "piece").sortWithinPartitions(group, "piece", sign)


def _agreeing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which vectors of x and y agree enough."""
    a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, COORDINATES) for v in (x, y))
    return np.stack([(b == one).sum(axis=1) >= LOOSE * COORDINATES for one in a])


def _sharing(similarity: float):
    """Which shingle sets of x and y have the similarity, exactly."""

    def compare(x: list[bytes], y: list[bytes]) -> np.ndarray:
        sets = [[np.frombuffer(v, np.uint64) for v in part] for part in (x, y)]
        sizes = [np.array([len(v) for v in part]) for part in sets]
        both = np.intersect1d(np.unique(np.concatenate(sets[0])), np.unique(np.concatenate(sets[1])), assume_unique=True)
        sides = []
        for part, size in zip(sets, sizes, strict=True):
            token, owner = np.concatenate(part), np.repeat(np.arange(len(part)), size)
            number = np.searchsorted(both, token)
            shared = number < len(both)
            shared[shared] = both[number[shared]] == token[shared]
            order = np.argsort(number[shared], kind="stable")
            sides.append((number[shared][order], owner[shared][order]))
        common = np.zeros((len(x), len(y)), np.float32)
        for start in range(0, len(both), 4096):
            parts = []
            for (number, owner), part in zip(sides, sets, strict=True):
                at = slice(*np.searchsorted(number, [start, start + 4096]))
                tile = np.zeros((len(part), 4096), np.float32)
                tile[owner[at], number[at] - start] = 1
                parts.append(tile)
            common += parts[0] @ parts[1].T
        return common >= similarity * (sizes[0][:, None] + sizes[1][None, :] - common)

    return compare


_EDGES = "a binary, b binary, n bigint"
#: A whole block in a row: signs, the least linked text of the block by place, numbers of links, and the sets or vectors.
_BLOCKS = "node {kind}, piece int, pieces int, signs array<binary>, root array<int>, links array<bigint>, data array<binary>"


def _edges_batch(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "n"])


def _inside(compare):
    """One row per block, its texts compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            data = group.column(4).to_pylist()
            linked = np.triu(compare(data, data), 1)
            a, b = np.nonzero(linked)
            root, links = _roots(len(data), a, b), np.bincount(np.r_[a, b], minlength=len(data))
            cells = [group.column(i)[0].as_py() for i in range(3)] + [group.column(3).to_pylist(), root.tolist(), links.tolist(), data]
            kinds = [*(group.schema.types[:3]), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            names = ["node", "piece", "pieces", "signs", "root", "links", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return run


class _Joined:
    """Which roots are connected already."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, x: bytes, y: bytes) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _across(compare, counted: bool):
    """One block against the others of its group, its own row first: one row per text of the block that is linked
    to any, with the block's root and its number of links, and a row for each two roots that a later block connects.

    Where numbers are not asked for, roots are compared first, and texts whose roots are connected not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, joined, edges = None, _Joined(), []

        def finished():
            for sign, root, n in zip(own["signs"], own["root"], own["links"], strict=True):
                if n or own["signs"][root] != sign:
                    edges.append((sign, own["signs"][root], int(n)))
            return _edges_batch(edges)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["piece"] == row["own"]:
                    if own is not None:
                        yield finished()
                    own, joined, edges = row, _Joined(), []
                    own["links"] = np.array(own["links"])
                    continue
                later, mine = row["piece"] > own["piece"], np.array(own["root"])
                theirs = np.array(row["root"])

                def connect(linked, a, b, row=row):
                    for x, y in {(int(mine[a[i]]), int(theirs[b[j]])) for i, j in zip(*np.nonzero(linked), strict=True)}:
                        if joined.join(own["signs"][x], row["signs"][y]):
                            edges.append((own["signs"][x], row["signs"][y], 0))

                if counted:
                    everything = np.arange(len(mine)), np.arange(len(theirs))
                    linked = compare(own["data"], row["data"])
                    own["links"] += linked.sum(axis=1)
                    if later:
                        connect(linked, *everything)
                elif later:
                    tops = np.unique(mine), np.unique(theirs)
                    connect(compare(*([d[i] for i in t] for d, t in zip((own["data"], row["data"]), tops, strict=True))), *tops)
                    for x in tops[0]:
                        open_ = [y for y in tops[1] if joined.find(own["signs"][x]) != joined.find(row["signs"][y])]
                        a, b = np.flatnonzero(mine == x), np.flatnonzero(np.isin(theirs, open_))
                        if len(b):
                            connect(compare([own["data"][i] for i in a], [row["data"][j] for j in b]), a, b)
        if own is not None:
            yield finished()

    return run


def _links(rows: DataFrame, group: str, compare, counted: bool) -> DataFrame:
    """Edges between the linked texts of each group, and their numbers of links: a, b, n.

    ``rows``: group, piece, pieces, sign and a set or vector, by block (see ``_in_blocks``).  What goes between
    tasks are whole blocks, one row each; what comes out is in proportion to the texts and to the roots that meet.
    """
    kind = rows.schema[group].dataType.simpleString()
    blocks = rows.mapInArrow(_inside(compare), _BLOCKS.format(kind=kind))
    blocks = staged(blocks.where(F.expr("pieces > 1 OR exists(links, n -> n > 0)")), "blocks")
    sent = blocks.where("pieces > 1").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    sent = sent.withColumn("first", F.col("own") != F.col("piece"))
    if not counted:
        sent = sent.where("piece >= own").drop("links").withColumn("links", F.transform("root", lambda r: F.lit(0).cast("bigint")))
    dealt = sent.repartition("node", "own").sortWithinPartitions("node", "own", "first", "piece")
    texts = F.expr("inline(transform(arrays_zip(signs, root, links), t -> struct(t.signs AS a, signs[t.root] AS b, t.links AS n)))")
    single = blocks.where("pieces = 1").select(texts).where(F.col("n") > 0)
    return single.unionByName(dealt.mapInArrow(_across(compare, counted), _EDGES))


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in tokens.slices(batch.column(0)):
            words = texts.words(lower=True)
            owner, grams = shingles(texts, words)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(signs(words), pa.binary()), pa.array(sets, pa.binary())], names=["sign", "shingles"])


def _nodes_of_two(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two texts or more, with the node's number n."""
    counts = staged(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
    return rows.join(counts, "node")


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges between classes that met in a node and look alike."""
    wide = classes.select("sign", "vector")
    narrow = classes.select("sign", F.explode("nodes").alias("node"))
    level = staged(_nodes_of_two(narrow).join(wide, "sign").select("node", "sign", "vector", "n"), "level")
    small = []
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        small.append(level if last else level.where(F.col("n") <= SMALL))
        large = level.where(F.col("n") > SMALL)
        if last or large.isEmpty():
            break
        children = large.select("node", "sign", "vector").mapInArrow(_split, "node bigint, sign binary, vector binary")
        children = staged(children, "children")
        level = staged(_nodes_of_two(children).select("node", "sign", "vector", "n"), "level")
    rows = small[0]
    for other in small[1:]:
        rows = rows.union(other)
    blocks = _in_blocks(rows, "node", F.ceil(F.col("n") / SMALL)).select("node", "piece", "pieces", "sign", "vector")
    return _links(blocks, "node", _agreeing, counted=False)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members: ``key``, sign and class_id of every row; classes: sign, class_id, n_links, group_id and
    first, the sign that stands for the group).

    A class are the rows with the same words in the same order (A-Z lower-cased); class_id is its
    least key.  n_links counts the other classes with a similarity of at least ``similarity``;
    group_id is the least class_id among all classes connected by links.  The classes' table has
    those with a link only.
    """
    first = tokens.mix(np.arange(1, runs(similarity) + 1, dtype=np.uint64) * _FACTORS[1])
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, sign binary, vector binary, nodes array<bigint>"
    members = staged(docs.select(key, text).mapInArrow(_signed(key, first), schema), "signs")
    classes = staged(
        members.where(F.col("sign").isNotNull()).groupBy("sign")
        .agg(F.min(key).alias("class_id"), F.first("vector").alias("vector"), F.first("nodes").alias("nodes")),
        "classes",
    )
    maybe = components(_candidates(classes))
    sizes = staged(maybe.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    alike = staged(
        maybe.join(sizes, "root").join(classes.select(F.col("sign").alias("v"), "class_id"), "v")
        .select("root", "n", F.col("v").alias("sign"), "class_id"),
        "alike",
    )
    # One text of each class that may have a link is read again for its shingles.
    wanted = alike.select(F.col("class_id").alias("_wanted")).distinct().hint("shuffle_hash")
    texts = docs.where(F.length(text) > 0).select(key, text)
    texts = texts.join(wanted, texts[key].eqNullSafe(wanted["_wanted"]), "left_semi").select(text)
    sets = texts.mapInArrow(_with_shingles, "sign binary, shingles binary").groupBy("sign").agg(F.first("shingles").alias("shingles"))
    full = staged(alike.join(sets, "sign").select("root", "n", "sign", "shingles"), "sets")
    weight = staged(full.groupBy("root").agg(F.sum(F.length("shingles")).alias("bytes")), "weights")
    pieces = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    blocks = _in_blocks(full.join(weight, "root"), "root", pieces).select("root", "piece", "pieces", "sign", "shingles")
    links = staged(_links(blocks, "root", _sharing(similarity), counted=True), "links")
    groups = components(links)
    named = groups.join(classes.select(F.col("sign").alias("v"), "class_id"), "v")
    least = named.groupBy("root").agg(
        F.min("class_id").alias("group_id"), F.min_by("v", F.struct(F.col("class_id").isNull(), "class_id", "v")).alias("first")
    )
    counts = links.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n_links"))
    found = named.join(least, "root").join(counts, "v").select(F.col("v").alias("sign"), "first", "class_id", "n_links", "group_id")
    return members.select(key, "sign").join(classes.select("sign", "class_id"), "sign", "left"), staged(found, "linked")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, class_id, n_links and group_id.

    Texts without a word (null, empty, blank) are alike to nothing: their class and group are
    their own key.  Texts of one to four words are one shingle.  Repeated rows share a class;
    an empty table gives no rows; other columns are not read.
    """
    members, linked = near_classes(docs, key, text)
    rows = members.join(linked.select("sign", "n_links", "group_id"), "sign", "left")
    own = F.coalesce("class_id", key)
    return rows.select(key, own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", own).alias("group_id"))


def _tagged(place: int, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes | None] = []
            for texts in tokens.slices(batch.column(place)):
                found += signs(texts.words(lower=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema_names)

    return run


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all columns, whatever their names.

    It is the row with the least key of the group (ties: the least row as a whole).  Rows
    whose text has no word all stay.
    """
    names = docs.columns
    sign = "sign_" + "_".join(names)  # no column of docs has this name
    _, linked = near_classes(docs, key, text)
    rows = docs.mapInArrow(_tagged(names.index(text), [*names, sign]), T.StructType([*docs.schema.fields, T.StructField(sign, T.BinaryType())]))
    ordered = [c for c, kind in docs.dtypes if c != key and "map<" not in kind and kind != "variant"]
    order = F.struct(F.col(key).isNull(), F.col(key), *map(F.col, ordered))
    least = rows.where(F.col(sign).isNotNull()).groupBy(sign).agg(F.min_by(F.struct(*names), order).alias("row"))
    others = linked.where(F.col("sign") != F.col("first")).select(F.col("sign").alias(sign))
    kept = least.join(others, sign, "left_anti").select("row.*")
    return kept.union(rows.where(F.col(sign).isNull()).select(*names))
