"""N-gram Jaccard join: universe partitioning and the pigeonhole principle, exact.

Each text is its set of word shingles; equal sets are one class. Size bands part
the sets. Two sets of at most u shingles whose Jaccard similarity reaches the
threshold differ in at most H(u) elements. For a band up to u the hash universe
is cut into segments: e segments that must be equal and d segments that may
differ by one element, with e + 2 d = H(u) + 1 + SPARE. As H(u) differences can't
spoil them all, two similar sets agree in some segment: its signature (for the d
segments also those of its one-deletion neighbourhood) is the key of the index.
How many segments of each kind a band gets is chosen by cost: signatures to
shuffle plus expected chance agreements. As SPARE segments more than one agree,
that many empty ones of a set aren't indexed, and a set that shares fewer keys
than the rest of them with others has no partner: sets and keys that chance has
brought together go before any set is looked at.

A set indexes its own band and, if a larger partner can lie there, the next.
Components are found in rounds over what is still apart. The hub of a key is the
set that meets most others over all its keys. First each set is compared with
the one hub with which it shares most keys, and the links found are contracted;
then, in keys that still hold several components, with its other hubs. Sets in
keys that still do, the hubs aside (a passage that many texts share fills whole segments) are
parted to the end, one element a segment: two sets that share x elements share
one of the n - x + 1 rarest of either, so that what a passage has in common is
left out, and sets of unlike components that share a rare one are compared. So
a group of many like texts makes comparisons in proportion to its size. Unlike
texts put together from the same passages share rare elements and don't connect:
their comparisons can grow with the square of their number (no pair is left out
but those whose ends are already connected). Pairs pass a filter
of counts by part of the hash range, then the exact comparison.

A set is kept as the 64-bit hashes of its shingles, and n_shingles counts those:
unlike shingles of one text coincide with a chance of about n^2 / 2^65. Sets are
taken as equal by 128-bit keys.

Defined results: null and blank texts have no shingles, are linked with nothing
and are their own component; texts with fewer words than a shingle are one
shingle; repeated rows and texts share a component; an empty table gives an
empty result; rows without an id get a null component.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Segments that agree beyond the one that must: a tenth of the differences, and at least so many.
SPARE = 2
#: Weight of a chance agreement against a signature, in the cost of an allocation.
CHANCE = 1000
#: Ids up to which those of the sets to verify go to every task (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, from the hashes of its words."""
    if not len(w):
        return w
    if len(w) < n:
        n = len(w)
    m = len(w) - n + 1
    acc = np.full(m, n, np.uint64)
    for k in range(n):
        acc = mix(acc * _M2 + w[k : k + m])
    return np.unique(acc)


@lru_cache(maxsize=None)
def bands(percent: int) -> list[int]:
    """Upper sizes of the bands; a partner of a set lies in its own band or a neighbouring one."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 10_000 // (percent * percent)))
    return out


def most_differences(size: int, percent: int) -> int:
    """Elements in which two sets of at most `size` can differ if the threshold is reached."""
    return (100 - percent) * 2 * size // (100 + percent)


@lru_cache(maxsize=None)
def allocation(size: int, percent: int) -> tuple[int, int, int]:
    """(segments, those of them with one-deletion neighbourhood, spare) of the band up to `size`, by cost.

    Cost of a set: its signatures, and for each the chance that unlike sets agree
    in it, which falls with the number of elements that it covers."""
    differences = most_differences(size, percent)
    best = None
    for spare in (0, max(SPARE, differences // 10)):
        need = differences + 1 + spare
        for d in sorted({0, 1, 2, need // 4, need // 2}):
            if 2 * d > need:
                continue
            m = need - d
            each = size / m
            chance = CHANCE / (1 + spare / (2 if d else 1))  # so many keys must agree
            cost = (m - d) * (1 + chance * math.exp(-each)) + d * (1 + each) * (1 + chance * math.exp(-max(0.0, each - 1)))
            cost += 0.0 if spare else (m - d) * chance * math.exp(-each)  # empty segments are indexed
            if best is None or cost < best[0]:
                best = (cost, (m, d, spare))
    return best[1]


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set, over its own band and, where a larger partner can lie there, the next."""
    return keys_of(elements, percent)[0]


def keys_of(elements: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(signatures, how many of them any similar set shares at least)."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64), 0
    limits = bands(percent)
    own = int(np.searchsorted(limits, n))
    joined = [own] + [own + 1] * (100 * n >= percent * (limits[own] + 1))
    value, place = mix(elements), mix(elements, _M2) >> np.uint64(24)
    out, least = [], n + 1
    for band in joined:
        m, d, spare = allocation(limits[band], percent)
        at = (place % np.uint64(m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)))
        counts = np.bincount(at, minlength=m)
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts]
        name = mix(np.arange(m, dtype=np.uint64) + np.uint64((band * int(_M1)) % 2**64))
        keys = mix(total + name, _M2)
        empty = counts == 0
        empty[:d] = False
        left_out = int(empty.sum()) if empty.sum() <= spare else 0
        out.append(keys[~empty] if left_out else keys)
        agree = spare + 1 - left_out  # by weight: a segment that may differ by one element weighs two
        least = min(least, -(-agree // 2) if d else agree)
        if d:
            inside = order[at[order] < d]
            seg = at[inside]
            out.append(mix(total[seg] - value[inside] + name[seg], _M2))
    return np.unique(np.concatenate(out)), least


#: Bytes of text that a task hashes at once; a longer text is hashed alone.
CHUNK = 1 << 21
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class _Weights:
    """A pseudo-random odd multiplier for each place in a word, as many as the longest word so far needs."""

    table = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            cls.table = mix(mix(np.arange(max(256, n), dtype=np.uint64) + _M1), _M2) | np.uint64(1)
        return cls.table


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of several texts, number of words up to each text's end); data: their UTF-8 bytes, text k at ends[k] to ends[k + 1]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    ink = ~_BLANK[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= ink[cuts]  # words end with their text
    stops[cuts - 1] |= ink[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    length = last - first
    upto = np.cumsum(length)
    at = np.arange(upto[-1]) - np.repeat(upto - length, length)
    terms = _LOWER[data[ink]] * _Weights.of(int(length.max()))[at]
    hashes = mix(np.add.reduceat(terms, upto - length) + length.astype(np.uint64) * _M2)
    return hashes, np.searchsorted(first, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of each text, as shingles() of its words; word windows are hashed for all texts at once."""
    hashes, upto = word_hashes(data, ends)
    m = max(0, len(hashes) - n + 1)
    acc = np.full(m, n, np.uint64)
    for k in range(n if m else 0):
        acc = mix(acc * _M2 + hashes[k : k + m])
    return [np.unique(acc[a : b - n + 1]) if b - a >= n else shingles(hashes[a:b], n) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _map_sets(docs: DataFrame, n: int, function, schema: str, id_col: str, text: str) -> DataFrame:
    """function(ids, sets) -> numpy arrays or lists per column of `schema`, for some rows at a time."""
    named = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    empty = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(empty)
        for batch in batches:
            column, ids = batch.column(1).cast(pa.large_string()), batch.column(0).to_pylist()
            _, offsets, values = column.buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(ids) + 1]
            data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK, "right")) - 1)
                sets = shingle_sets(data[ends[low] : ends[high]], ends[low : high + 1] - ends[low], n)
                out = function(ids[low:high], sets)
                low = high
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return named.mapInArrow(run, empty)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set."""
    both = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _M3, _M2).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(s))
    return tuple(_signed(both))


def index(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """d, size, k1, k2, need and sigs: each row's id, the size and key of its set, the keys that a similar set shares, and its index keys.

    A set that a slice of rows has twice is indexed once, rows without an id not at all (no keys in the other rows)."""

    def work(ids, sets):
        import pyarrow as pa

        keys, sigs, needs, seen = [], [], [], set()
        for i, s in zip(ids, sets, strict=True):
            k = _set_key(s)
            keys.append(k)
            known = i is None or k in seen
            own, need = (np.zeros(0, np.uint64), 0) if known else keys_of(s, percent)
            sigs.append(own)
            needs.append(need)
            if not known:
                seen.add(k)
        ends = np.concatenate(([0], np.cumsum(list(map(len, sigs)))))
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs).view(np.int64)))
        return ids, list(map(len, sets)), [k[0] for k in keys], [k[1] for k in keys], needs, flat

    return _map_sets(docs, n, work, "d long, size long, k1 long, k2 long, need int, sigs array<long>", id_col, text)


#: Parts of the hash range in which the elements of a set are counted, up to 255 in each: few for a first look, more for long texts.
PARTS, FINE_PARTS = 64, 1024
def _sets(docs: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """d, s (the set), parts and fine (its elements in each part of the hash range)."""

    def counted(sets, parts):
        import pyarrow as pa

        shift = np.uint64(65 - parts.bit_length())
        counts = [np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=parts), 255) - 128 for s in sets]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * parts, pa.int32()), pa.array(np.concatenate(counts).astype(np.int8)))

    def work(ids, sets):
        import pyarrow as pa

        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(list(map(len, sets)))))
        return ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), counted(sets, PARTS), counted(sets, FINE_PARTS)

    return _map_sets(docs, n, work, "d long, s array<long>, parts array<tinyint>, fine array<tinyint>", id_col, text)


def _may_be_similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` that counts by part don't rule out: two sets differ by at least the sum of what their counts differ.

    Exact as a filter (counts cut off at 255 differ by no more than the counts),
    and the counts are some dozens of bytes where sets are kilobytes."""
    left = _apart(pairs, sets.select("d", "parts", F.size("s").alias("n")), percent)
    return materialize(_apart(left, sets.select("d", "fine", F.size("s").alias("n")), percent).select("a", "b"), "join-pairs")


def _apart(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda acc, x: acc + x)
    rows = pairs.join(counts.toDF("a", "pa", "na"), "a").join(counts.toDF("b", "pb", "nb"), "b").withColumn("apart", apart)
    return rows.where((100 + percent) * F.col("apart") <= (100 - percent) * (F.col("na") + F.col("nb"))).select(*pairs.columns)


def _of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `sets` that `pairs` name; only those are worth moving."""
    return sets.join(_ids(pairs.select(F.col("a").alias("d")).union(pairs.select("b"))), "d", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose sets reach the threshold."""
    pairs = materialize(pairs.select("a", "b"), "join-pairs")
    sets = _of(sets.select("d", "s"), pairs)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    rows = both.select("a", "b", shared.alias("x"), (F.size("sa") + F.size("sb")).alias("y"))
    return rows.where(100 * F.col("x") >= percent * (F.col("y") - F.col("x"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """d, c: each node of the links (a, b) and the least node that it reaches, by repeated minima with pointer jumping."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = materialize(both.toDF("d", "e"), "join-edges")
    label = materialize(edges.groupBy("d").agg(F.least(F.min("e"), F.first("d")).alias("c")), "join-labels")
    while True:
        near = edges.join(label.withColumnRenamed("d", "e"), "e").groupBy("d").agg(F.min("c").alias("n"))
        step = label.withColumnRenamed("c", "old").join(near, "d").select("d", "old", F.least("old", "n").alias("c"))
        known = label.select(F.col("d").alias("c"), F.col("c").alias("j"))
        new = materialize(step.join(known, "c", "left").select("d", F.least("c", "j").alias("c"), "old"), "join-labels")
        changed = new.where(F.col("c") != F.col("old")).limit(1).count()
        discard(label)
        label = new.drop("old")
        if not changed:
            discard(edges)
            return label


def _live(keys: DataFrame) -> DataFrame:
    """Of the keys (sig, d, c, size, need) those that hold several components, of sets that have as many of them as a similar set would share.

    Two similar sets of unlike components that weren't compared share all their
    common keys, so that neither loses one of them here. Discards `keys`."""
    for _ in range(2):
        apart = keys.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("sig")
        several = materialize(keys.join(apart, "sig", "left_semi"), "join-keys")
        enough = several.groupBy("d").agg(F.count("*").alias("k"), F.max("need").alias("least")).where("k >= least").select("d")
        left = materialize(several.join(enough, "d", "left_semi").select(*keys.columns), "join-keys")
        discard(keys)
        discard(several)
        keys = left
    return keys


class _Rounds:
    """What is still apart: keys (sig, d, c, size, need) that hold several components, with the component c of each set d."""

    def __init__(self, keys: DataFrame, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links = None
        self.labels = None  # d, c of the sets that some link has reached
        self.keys = keys

    def fits(self, a, b):
        """Sizes of which one set can be similar to the other."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def compare(self, pairs: DataFrame) -> None:
        """Verify the (a, b), and contract the components that the similar ones connect."""
        found = _similar(_may_be_similar(pairs, self.sets, self.percent), self.sets, self.percent)
        found = materialize(found, "join-links")
        self.links = found if self.links is None else self.links.union(found)
        if not found.limit(1).count():
            return
        label = lambda end: F.coalesce(f"{end}c", end)
        ends = found
        if self.labels is not None:  # links between components, named by their least ids
            for end in "ab":
                ends = ends.join(self.labels.toDF(end, f"{end}c"), end, "left")
            ends = ends.select(label("a").alias("a"), label("b").alias("b")).where("a != b")
        moved = components(ends)
        if self.labels is None:
            self.labels = moved
        else:
            again = self.labels.join(moved.toDF("c", "to"), "c", "left").select("d", F.coalesce("to", "c").alias("c"))
            fresh = moved.join(self.labels.select("d"), "d", "left_anti")
            self.labels = materialize(again.union(fresh), "join-labels")
        placed = self.keys.drop("c").join(self.labels, "d", "left").withColumn("c", F.coalesce("c", "d"))
        held, self.keys = self.keys, _live(materialize(placed.select("sig", "d", "c", "size", "need"), "join-keys"))
        discard(held)

    def leave(self, hubs: DataFrame) -> None:
        """Take the hubs out of their keys, once they have been compared with all other sets there."""
        rest = self.keys.join(hubs.select("sig", F.col("hub").alias("d")), ["sig", "d"], "left_anti")
        held, self.keys = self.keys, _live(materialize(rest.select("sig", "d", "c", "size", "need"), "join-keys"))
        discard(held)

    def hubs(self) -> tuple[DataFrame, DataFrame]:
        """(hub of each key, star): star has d, p, k, score: each set, a hub of its keys in another component, and the number of keys that the two share."""
        met = self.keys.groupBy("sig").agg(F.count("*").alias("m"))
        score = self.keys.join(met, "sig").groupBy("d").agg(F.sum("m").alias("score"))
        hub = materialize(self.keys.join(score, "d").groupBy("sig").agg(F.max(F.struct("score", "d", "size", "c")).alias("hub")), "join-hubs")
        star = self.keys.join(hub, "sig").where((F.col("c") != F.col("hub.c")) & self.fits(F.col("size"), F.col("hub.size")))
        star = star.groupBy("d", F.col("hub.d").alias("p")).agg(F.count("*").alias("k"), F.first("hub.score").alias("score"))
        return hub.select("sig", F.col("hub.d").alias("hub")), materialize(star, "join-stars")


    def rarest(self) -> DataFrame:
        """The (a, b) of unlike components that stand in some key and share one of the elements that are rarest among those sets.

        Of n elements the n - x + 1 rarest are looked at, x being what the two
        must share at their sizes; unique elements come first and meet nothing."""
        apart = self.keys.select("d", "c").distinct()
        held = self.sets.join(_ids(apart.select("d")), "d", "left_semi")
        every = held.select("d", F.size("s").alias("n"), F.explode("s").alias("e"))
        every = every.withColumn("e", F.col("e").bitwiseAND(0x7FFFFFFF).cast("int"))  # 31 bits will do to find candidates: equal elements stay equal
        met = materialize(every.groupBy("e").agg(F.count("*").alias("m")).where("m > 1"), "join-met")
        small = met.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        own = Window.partitionBy("d")
        shared = every.join(F.broadcast(met) if small else met, "e").withColumn("at", F.row_number().over(own.orderBy("m", "e"))).withColumn("held", F.count("*").over(own))
        place = (F.col("n") - F.col("held") + F.col("at")).alias("at")  # among all elements of the set
        rare = shared.select("e", "d", "n", place).where(100 * F.col("at") <= (100 - self.percent) * F.col("n") + 100)
        rare = materialize(rare.join(apart, "d"), "join-rare")
        discard(met)
        several = rare.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("e")
        rare = rare.join(several, "e", "left_semi")
        left, right = (rare.select("e", *(F.col(x).alias(x + end) for x in ("d", "n", "at", "c"))) for end in "ab")
        must = F.ceil(F.lit(self.percent) * (F.col("na") + F.col("nb")) / F.lit(100 + self.percent) - 1e-9)
        near = (F.col("ata") <= F.col("na") - must + 1) & (F.col("atb") <= F.col("nb") - must + 1)
        both = left.join(right, (left["e"] == right["e"]) & (F.col("da") < F.col("db")) & (F.col("ca") != F.col("cb")) & self.fits(F.col("na"), F.col("nb")) & near)
        return both.select(F.col("da").alias("a"), F.col("db").alias("b")).distinct()


def _ids(ids: DataFrame) -> DataFrame:
    """The distinct ids, with a broadcast hint if their number is within the bound."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _pair(df: DataFrame) -> DataFrame:
    return df.select(F.least("d", "p").alias("a"), F.greatest("d", "p").alias("b")).distinct()


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, keys, sets): d, size, k1, k2 of each row; k1, k2, rep, size of each set; sig, d, size of keys that several sets have; the sets of those."""
    indexed = materialize(index(docs, n, percent, id_col, text), "join-index")
    rows = materialize(indexed.drop("sigs", "need"), "join-members")
    classes = indexed.where((F.col("size") > 0) & F.col("d").isNotNull()).groupBy("k1", "k2").agg(F.min("d").alias("rep"), F.first("size").alias("size"), F.max("need").alias("need"))
    classes = materialize(classes, "join-classes")

    # Keys of one set only need no look: the least and the largest set of a key differ, or all are one.
    found = indexed.where(F.col("d").isNotNull()).select(F.explode("sigs").alias("sig"), "k1")
    several = found.groupBy("sig").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo != hi").select("sig")
    several = materialize(several, "join-several")
    shared = found.join(several, "sig", "left_semi").distinct()
    own = classes.select("k1", F.col("rep").alias("d"), F.col("rep").alias("c"), "size", "need")
    keys = materialize(shared.join(own, "k1").select("sig", "d", "c", "size", "need"), "join-keys")
    keys = _live(keys)
    discard(indexed)
    discard(several)

    asked = _ids(keys.select(F.col("d").alias("__op7_id")))
    wanted = docs.withColumn("__op7_id", F.col(id_col).cast("long")).join(asked, "__op7_id", "left_semi")
    sets = materialize(_sets(wanted, n, "__op7_id", text), "join-sets")
    return rows, classes, keys, sets


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): d, n_shingles and component_id of each row, and verified links (a, b) between classes, named by their least ids.

    The links are those that were needed to connect the components, not all
    there are; pairs() gives all."""
    rows, classes, keys, sets = _classes(docs, n, percent, id_col, text)
    at = _Rounds(keys, sets, percent)

    _, star = at.hubs()
    best = star.groupBy("d").agg(F.max(F.struct("k", "score", "p")).alias("x")).select("d", "x.p")
    at.compare(_pair(best))
    tried = _pair(best)

    hub, star = at.hubs()
    more = materialize(_pair(star).join(tried, ["a", "b"], "left_anti"), "join-pairs")
    at.compare(more)
    at.leave(hub)
    tried = tried.union(more)

    at.compare(at.rarest().join(tried, ["a", "b"], "left_anti"))

    label = at.labels
    if label is None:
        of_class = classes.select("k1", "k2", F.col("rep").alias("component_id"))
    else:
        of_class = classes.join(label.withColumnRenamed("d", "rep"), "rep", "left").select("k1", "k2", F.coalesce("c", "rep").alias("component_id"))
    out = rows.join(of_class, ["k1", "k2"], "left").select(
        "d", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("d")).alias("component_id")
    )
    discard(sets)
    return out, at.links


def pairs(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): d, rep and n_links (unlike texts that the row's text links with) of each row with words, and all linked classes (a, b) by their least ids.

    The output itself grows with the square of a group of unlike near copies;
    join() gives the components without it."""
    rows, classes, keys, sets = _classes(docs, n, percent, id_col, text)
    at = _Rounds(keys, sets, percent)
    links = materialize(_similar(_may_be_similar(at.rarest(), sets, percent), sets, percent), "join-links")
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    members = rows.where("d is not null").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).join(degree, "rep", "left")
    return members.select("d", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the least id of their component, all columns as they were; repeated rows of an id and text stay once, rows without an id all."""
    found, _ = join(docs, n, percent, id_col, text)
    keep = found.where(F.col("d") == F.col("component_id")).groupBy(F.col("d").alias("__op7_id")).agg((F.count("*") > 1).alias("__op7_again"))
    named = docs.withColumn("__op7_id", F.col(id_col).cast("long")).join(keep, "__op7_id")
    # Only the rows of repeated ids are dealt by their text.
    once, again = named.where(~F.col("__op7_again")), named.where("__op7_again").withColumn("__op7_text", F.sha2(text, 256))
    again = again.dropDuplicates(["__op7_id", "__op7_text"])
    return once.select(*docs.columns).union(again.select(*docs.columns)).union(docs.where(F.col(id_col).isNull()))
