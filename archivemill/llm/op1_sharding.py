"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's name, and the
smallest draw wins: a child gets its share by weight, and a change of one child's
weight moves rows only into or out of that child's subtree.

A shard added later takes part at the root under its own name, and a row it wins goes
straight to it.  All other rows descend as before, so an added shard takes rows only
into itself, whatever rack it is put in, and its share is exactly its weight's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm.shared import gapless, text_or_empty


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    number: int
    region: str
    rack: str
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        return (self.region, f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.number}")


@dataclass(frozen=True)
class HashTree:
    """Shards the tree was built with, and shards added since."""

    base: tuple[Shard, ...]
    added: tuple[Shard, ...] = ()

    def grown(self, weight: float = 1.0) -> HashTree:
        """One shard more, in the last region and rack."""
        last = self.base[-1]
        new = Shard(len(self.base) + len(self.added), last.region, last.rack, weight)
        return replace(self, added=(*self.added, new))


def default_tree(shards: int = 8) -> HashTree:
    """Shards of weight 1, two to a rack and two racks to a region."""
    return HashTree(tuple(Shard(i, f"region{i // 4}", f"rack{i // 2 % 2}") for i in range(shards)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """A draw from the exponential distribution of rate ``weight``."""
    top = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
    return -F.log((top + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(weight)


def _winner(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; the lesser value wins a tie."""
    if len(draws) == 1:
        return draws[0][1]
    pairs = [F.struct(draw.alias("draw"), value.alias("value")) for draw, value in draws]
    return F.array_min(F.array(*pairs))["value"]


def _descend(key: Column, shards: tuple[Shard, ...], level: int) -> list[tuple[Column, Column]]:
    """For each child at ``level`` its draw, and the shard that a row it wins ends in."""
    children = dict.fromkeys(s.path[level] for s in shards)
    out = []
    for name in children:
        below = tuple(s for s in shards if s.path[level] == name)
        ends = F.lit(below[0].number) if level == 2 else _winner(_descend(key, below, level + 1))
        out.append((_draw(key, name, sum(s.weight for s in below)), ends))
    return out


def shard_of(key: Column, tree: HashTree) -> Column:
    """The shard number of a key.  A null key hashes like a key of its own."""
    added = [(_draw(key, f"added/{s.number}", s.weight), F.lit(s.number)) for s in tree.added]
    return _winner([*_descend(key, tree.base, 0), *added])


def place(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with their shard, their slot in it, and their shard in the tree grown by one.

    Returns ``key``, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot
    (gapless in a shard from 0), grown_shard, region and rack.  A null text has size 1 and
    checksum 0; repeated rows each get a slot; an empty table gives no rows; other columns
    of ``docs`` are not read.
    """
    source, words = docs[key], text_or_empty(docs[text])
    rows = docs.select(
        source.alias(key),
        (F.octet_length(words) + 1).cast("long").alias("size"),
        F.crc32(words).alias("text_crc32"),
        shard_of(source, tree).alias("shard"),
        shard_of(source, tree.grown()).alias("grown_shard"),
    )
    where = {s.number: s for s in (*tree.base, *tree.added)}
    of = F.create_map(*(x for n, s in where.items() for x in (F.lit(n), F.struct(F.lit(s.region), F.lit(s.rack)))))
    return gapless(rows, "shard", [key], "slot").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        of[F.col("shard")]["col1"].alias("region"), of[F.col("shard")]["col2"].alias("rack"),
    )
