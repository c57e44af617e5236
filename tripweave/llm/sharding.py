"""Sharding: contiguous shards of the smallest possible largest size (DataFrame functions only).

Rows of equal text form one atomic group. The groups stand in the order of the
MD5 of their text; a shard is a run of neighbours in that order. The smallest
shard capacity that needs at most `shards` runs is found by binary search, each
try being checked greedily, and the cuts are then made at that capacity. A cut
is a key, so a row's shard follows from its own text and `shards - 1` literals:
no join, and no task holds a group.

Defined results: null text is the empty text; repeated rows are rows of one
group; an empty table gives an empty result; a shard may be empty when groups
are large; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, materialize

#: Key prefixes (hex digits) whose sizes the driver holds: 16**3 sums, whatever the input.
BUCKET_DIGITS = 3
#: Groups that the driver may hold when the search has narrowed to them.
LAST_GROUPS = 20_000


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def group_key(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


class _Prefix:
    """Ends of groups in key order: where the greedy check looks up its cuts."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total, self.known = ends, total, {}

    def last_end(self, most: int) -> int:
        """The largest end of a group that is at most `most` (0: none)."""
        if most >= self.total:
            return self.total
        if most not in self.known:
            found = self.ends.where(F.col("g_end") <= F.lit(most).cast("long")).agg(F.max("g_end")).first()[0]
            self.known[most] = found or 0
        return self.known[most]


def _greedy(last_end, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of the first shards - 1 greedy runs of `capacity`, then what the last run reaches."""
    cuts, at = [], 0
    for _ in range(shards):
        at = last_end(at + capacity) if at < total else total
        cuts.append(at)
    return cuts


def plan_cuts(docs: DataFrame, shards: int, text: str = "text") -> tuple[int, list[str]]:
    """(capacity, the last group key of each of the shards but the last)."""
    rows = docs.select(row_size(F.col(text)).alias("g_size"), group_key(F.col(text)).alias("g_key"))
    groups = rows.groupBy("g_key").agg(F.sum("g_size").alias("g_size"))
    groups = materialize(groups.withColumn("g_bucket", F.substring("g_key", 1, BUCKET_DIGITS)), "shard-groups")
    buckets = groups.groupBy("g_bucket").agg(F.sum("g_size").alias("s"), F.max("g_size").alias("m")).collect()
    if not buckets:
        return 0, [""] * (shards - 1)
    buckets.sort(key=lambda b: b.g_bucket)  # 16**BUCKET_DIGITS at most
    total, largest = sum(b.s for b in buckets), max(b.m for b in buckets)
    starts, at = [], 0
    for b in buckets:
        starts.append((b.g_bucket, at))
        at += b.s
    offsets = docs.sparkSession.createDataFrame(starts, "g_bucket string, g_start long")
    w = Window.partitionBy("g_bucket").orderBy("g_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = groups.join(F.broadcast(offsets), "g_bucket").select(
        "g_key", (F.col("g_start") + F.sum("g_size").over(w)).alias("g_end")
    )
    ends = materialize(ends.repartitionByRange("g_end").sortWithinPartitions("g_end"), "shard-ends")

    prefix = _Prefix(ends, total)
    fits = lambda last_end, c: _greedy(last_end, total, c, shards)[-1] >= total
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest  # greedy with this capacity puts total / shards into each run
    last_end, small = prefix.last_end, False
    while low < high:
        if not small:
            # Cuts only grow with the capacity: they lie between those of `low` and of `high`.
            spans = list(zip(_greedy(last_end, total, low, shards), _greedy(last_end, total, high, shards), strict=True))
            between = F.lit(False)
            for a, b in spans:
                between |= F.col("g_end").between(F.lit(a).cast("long"), F.lit(b).cast("long"))
            near = ends.where(between).select("g_end").limit(LAST_GROUPS + 1).collect()
            if len(near) <= LAST_GROUPS:
                import bisect

                held = sorted({0, total, *(r.g_end for r in near)})
                last_end, small = (lambda most, h=held: h[bisect.bisect_right(h, most) - 1]), True
        middle = (low + high) // 2
        if fits(last_end, middle):
            high = middle
        else:
            low = middle + 1
    cuts = _greedy(last_end, total, low, shards)[:-1]
    keys = {r.g_end: r.g_key for r in ends.where(F.col("g_end").isin([int(c) for c in cuts])).collect()}
    out = [keys.get(c, "") for c in cuts]
    discard(groups)
    discard(ends)
    return low, out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Slots follow (cell, id), a cell being the first digits of the id's MD5: the
    cells are of like size even if a third of all rows has one text."""
    _, keys = plan_cuts(docs, shards, text)
    body = F.coalesce(F.col(text), F.lit(""))
    key = group_key(F.col(text))
    number = F.lit(0)
    for k in keys:
        number = number + (key > F.lit(k)).cast("int")
    cell_digits = 3
    rows = docs.select(
        F.col(id_col).alias("s_id"),
        row_size(F.col(text)).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        number.cast("int").alias("shard"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, cell_digits).alias("cell"),
    )
    cells = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))  # shards * 16**cell_digits rows
    inside = Window.partitionBy("shard", "cell").orderBy("s_id", "size", "text_crc32")
    placed = rows.withColumn("r", F.row_number().over(inside)).join(
        F.broadcast(cells.select("shard", "cell", "first_slot")), ["shard", "cell"]
    )
    return placed.select(
        F.col("s_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first_slot") + F.col("r") - 1).alias("slot")
    )
