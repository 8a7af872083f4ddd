"""Packing by optimal length buckets.

The global histogram of lengths decides the bucket boundaries by dynamic programming:
the boundaries that minimise the padding over all rows.  Inside a bucket every row is
padded to the boundary, and batches hold as many rows as the token budget allows.

The histogram is counted over all rows by every length up to 131,072 and, above that, in 256 steps to a
doubling, which bounds it to about 143,000 cells for any input.  A boundary is always the
largest length present in a cell, so no row is cut, and the boundaries are the best ones
unless rows are longer than 131,072.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm.shared import gapless, staged

FINE = 1 << 17
STEPS = 256


def cell(length: Column) -> Column:
    """The upper end of the grid cell that a length lies in."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(FINE)).cast("double") - 0.5)) - 8)
    return F.when(length <= FINE, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Boundaries of at most ``buckets`` buckets with the least padding.

    ``cells``: (upper end, rows, sum of lengths).  Ties go to the smaller boundary.  What a boundary after cell j costs on
    top of one after cell i is a line in j's upper end; ends and slopes are in order, so that the least of the
    lines is found in one walk along their lower envelope for each bucket.
    """
    cells = sorted(cells)
    n = len(cells)
    ends, count, total = [c[0] for c in cells], [0], [0]
    for _, rows, lengths in cells:
        count.append(count[-1] + rows)
        total.append(total[-1] + lengths)
    # least[j]: the least padding of the first j cells with the buckets used so far
    least: list[int | None] = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        after, cut = list(least), [-1] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # slope, height at 0, cell
        at = 0
        for j in range(1, n + 1):
            if least[j - 1] is not None:
                slope, height = -count[j - 1], least[j - 1] + total[j - 1]
                while len(lines) > at + 1:
                    (s1, h1, _), (s2, h2, _) = lines[-2:]
                    if (height - h1) * (s1 - s2) > (h2 - h1) * (s1 - slope):
                        break
                    lines.pop()
                lines.append((slope, height, j - 1))
            end = ends[j - 1]
            while at + 1 < len(lines) and lines[at + 1][0] * end + lines[at + 1][1] < lines[at][0] * end + lines[at][1]:
                at += 1
            cost = lines[at][0] * end + lines[at][1] + end * count[j] - total[j]
            if after[j] is None or cost < after[j]:
                after[j], cut[j] = cost, lines[at][2]
        least = after
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j > 0 and cut[j] >= 0:
            out.append(ends[j - 1])
            j = cut[j]
    return out[::-1]


def pack(docs: DataFrame, length: Column, key: str = "doc_id", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Every row of ``docs`` in a batch of its length bucket.

    ``length``: the tokens of a row, in whatever unit; the registered query and the pipeline count words.
    Returns ``key``, n_tokens, bucket (from 0), bucket_length, batch (from 0 in a bucket),
    place (from 0 in a batch) and padding.  A batch holds ``budget // bucket_length`` rows,
    and one row where the boundary is above the budget; only the last batch of a bucket is
    smaller.  A null length counts as 0; a bucket of length 0 holds ``budget`` rows a batch.
    Repeated rows and equal lengths each get a place; an empty table gives no rows; other
    columns are not read.
    """
    rows = staged(docs.select(docs[key].alias(key), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    histogram = (
        rows.groupBy("n_tokens").count()
        .groupBy(cell(F.col("n_tokens")))
        .agg(F.max("n_tokens").alias("end"), F.sum("count").alias("n"), F.sum(F.col("count") * F.col("n_tokens")).alias("total"))
        .select("end", "n", "total")
    )
    ends = boundaries([tuple(r) for r in histogram.collect()], buckets)  # bounded by the grid
    if not ends:
        return rows.select(
            key, "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"),
            *(F.lit(0).cast("long").alias(c) for c in ("batch", "place", "padding")),
        )
    bucket = sum((F.when(F.col("n_tokens") > end, 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    numbered = gapless(rows.withColumn("bucket", bucket), "bucket", ["n_tokens", key], "_slot")
    limit = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1).cast("long")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(limit, F.lit(1)))).cast("long")
    return numbered.select(
        key, "n_tokens", "bucket", limit.alias("bucket_length"),
        F.floor(F.col("_slot") / fits).cast("long").alias("batch"),
        (F.col("_slot") % fits).cast("long").alias("place"),
        (limit - F.col("n_tokens")).alias("padding"),
    )
