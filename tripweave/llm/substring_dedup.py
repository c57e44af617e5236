"""Suffix-array dedup: bytes of long strings that stand more than once.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in
another document or the same one. Prefix polynomial hashes (mod 2**64) give the
hash of any substring in constant time.

1. Each LENGTH-byte window names its anchor: the least of its GRAM-byte hashes,
   the leftmost among equals. Equal windows have equal anchors at equal places,
   so windows of unlike anchors need no comparison. The windows of one anchor
   occurrence are neighbours; together they cover its context. Counting anchors
   and contexts settles nearly all: an anchor that occurs once has unique
   windows, a context that occurs twice has repeated ones.
2. Where one anchor has several contexts, one occurrence of each is compared: the
   suffixes that start at the anchor are sorted by merging, a comparison being a
   binary search for the longest common extension over the prefix hashes, whose
   result is verified on the bytes. Neighbours' extensions to the right and the
   hashes to the left, verified on the bytes, say which windows repeat.
3. Contexts of an anchor that are too many for one task are divided: the windows
   by how far they reach to the left, in halves, and the contexts of a half by the
   bytes that all its windows have in common, which are the longer the narrower
   the half. Equal parts of contexts are settled, parts that share their common
   bytes with few others are compared as in 2, and the rest is halved again, at
   last to single windows. A context takes part in a few divisions a level.

Whether two contexts are equal is told by a BLAKE2 digest of their bytes, not by
the polynomial hash, so that no collision removes a byte. Only contexts travel,
and of repeated ones one occurrence. Removal is judged on the input. Matches
never cross documents.

Defined results: null text is the empty text; texts below LENGTH bytes stay
whole; repeated rows remove each other's bytes; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize

LENGTH = 400
GRAM = 100
#: Distinct contexts that one task compares with each other; more are divided.
GROUP = 256
#: A key of more rows meets its count without a shuffle, so that it isn't one task's; there are at most HOT_KEYS of them.
HOT, HOT_KEYS = 1000, 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x):
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class Hashes:
    """Prefix polynomial hashes of a byte string."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _Powers.of(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=self.prefix[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of each substring of `length`."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]

    def at(self, start, end):
        """The hash of [start, end); also for arrays."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def least_of_each(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours (prefix and suffix minima of blocks)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def contexts(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows, anchor) of each anchor occurrence."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h = Hashes(data)
    grams = mix(h.windows(GRAM))
    low = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least_of_each(keys, LENGTH - GRAM + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((first, [len(anchor)])))
    a = anchor[first]
    whole = [digest(data[p : p + k + LENGTH - 1], q - p, k) for p, k, q in zip(first.tolist(), count.tolist(), a.tolist(), strict=True)]
    return grams[a], np.array(whole, np.int64).view(np.uint64), first, count, a


def digest(data: bytes, *numbers: int) -> int:
    """64 bits of the BLAKE2 digest of some bytes and numbers."""
    h = hashlib.blake2b(data, digest_size=8)
    h.update(struct.pack(f"{len(numbers)}q", *numbers))
    return int.from_bytes(h.digest(), "little", signed=True)


def halves(g: int, level: int, data: bytes, p: int, n: int, a: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """(group, digest, first window, windows, anchor, bytes) of the parts of a context at a level of division.

    Part j has the windows that reach j * width to (j + 1) * width - 1 bytes to
    the left of the anchor; its group is named by what they all cover."""
    width, out = 512 >> level, []
    for j in range((a - n + 1) // width, a // width + 1):
        low, high = j * width, min(j * width + width - 1, LENGTH - GRAM)
        x, y = max(low, a - n + 1), min(high, a)
        part = data[a - y : a - x + LENGTH]
        common = data[a - low : a - high + LENGTH]
        out.append((digest(common, g, level, j), digest(part, y, y - x), p + a - y, y - x + 1, y, part))
    return out


def extension(x: bytes, hx: Hashes, i: int, y: bytes, hy: Hashes, j: int) -> int:
    """Length of the longest common prefix of x[i:] and y[j:], by binary search, verified on the bytes."""
    low, high = 0, min(len(x) - i, len(y) - j)
    with np.errstate(over="ignore"):
        while low < high:
            mid = (low + high + 1) // 2
            if hx.at(i, i + mid) == hy.at(j, j + mid):
                low = mid
            else:
                high = mid - 1
    while x[i : i + low] != y[j : j + low]:  # a collision: unlike strings of one hash
        low -= 1
    return low


def sort_suffixes(texts: list[bytes], hashes: list[Hashes], at: list[int]) -> tuple[list[int], list[int]]:
    """(order, extensions of neighbours) of the suffixes texts[k][at[k]:], by mergesort."""

    def before(a: int, b: int) -> bool:
        n = extension(texts[a], hashes[a], at[a], texts[b], hashes[b], at[b])
        return texts[a][at[a] + n : at[a] + n + 1] <= texts[b][at[b] + n : at[b] + n + 1]

    runs = [[k] for k in range(len(texts))]
    while len(runs) > 1:
        merged = []
        for k in range(0, len(runs) - 1, 2):
            a, b, i, j, out = runs[k], runs[k + 1], 0, 0, []
            while i < len(a) and j < len(b):
                if before(a[i], b[j]):
                    out.append(a[i])
                    i += 1
                else:
                    out.append(b[j])
                    j += 1
            merged.append(out + a[i:] + b[j:])
        runs = merged + runs[len(merged) * 2 :]
    order = runs[0] if runs else []
    near = [extension(texts[a], hashes[a], at[a], texts[b], hashes[b], at[b]) for a, b in zip(order, order[1:], strict=False)]
    return order, near


def _same_left(texts: list[bytes], anchors: list[int], order: list[int], at: np.ndarray, same: np.ndarray) -> bool:
    """True if neighbours of equal keys have equal bytes to the left of their anchors."""
    row, own = np.nonzero(same)
    furthest: dict[tuple[int, int], int] = {}
    for x, y, reach in zip(at[row, own].tolist(), at[row + 1, own].tolist(), own.tolist(), strict=True):
        furthest[x, y] = max(reach, furthest.get((x, y), 0))
    for (x, y), reach in furthest.items():
        i, j = order[x], order[y]
        if texts[i][anchors[i] - reach : anchors[i]] != texts[j][anchors[j] - reach : anchors[j]]:
            return False
    return True


def repeated(texts: list[bytes], anchors: list[int], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, windows) of its windows that another context has too.

    The contexts have one anchor content, at anchors[k] in texts[k]; window w of
    texts[k] reaches anchors[k] - w bytes to the left of the anchor."""
    hashes = [Hashes(t) for t in texts]
    order, near = sort_suffixes(texts, hashes, anchors)
    left = max(anchors)
    lengths = np.arange(left + 1)  # bytes to the left of the anchor
    m = len(texts)
    run = np.zeros((m, left + 1), np.uint64)  # contexts whose windows go on equally to the right
    if m > 1:
        run[1:] = np.cumsum(np.array(near)[:, None] < (LENGTH - lengths)[None, :], axis=0)
    key = np.zeros((m, left + 1), np.uint64)
    there = np.zeros((m, left + 1), bool)
    for r, k in enumerate(order):
        size = anchors[k] + 1
        own = np.arange(size)
        key[r, :size] = mix(hashes[k].at(anchors[k] - own, np.full(size, anchors[k]))) * _M2 + run[r, :size]
        start = anchors[k] - own
        there[r, :size] = (start >= 0) & (start < counts[k])
    key[~there] = np.arange(int((~there).sum()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.argsort(key, axis=0, kind="stable")
    ordered = np.take_along_axis(key, at, 0)
    live = np.take_along_axis(there, at, 0)
    same = (ordered[1:] == ordered[:-1]) & live[1:] & live[:-1]
    if not _same_left(texts, anchors, [order[r] for r in range(m)], at, same):  # a collision: the bytes themselves are the keys
        seen: dict = {}
        for r, k in enumerate(order):
            for own in np.flatnonzero(there[r]).tolist():
                key[r, own] = seen.setdefault((own, int(run[r, own]), texts[k][anchors[k] - own : anchors[k]]), len(seen)) * 2
        at = np.argsort(key, axis=0, kind="stable")
        ordered, live = np.take_along_axis(key, at, 0), np.take_along_axis(there, at, 0)
        same = (ordered[1:] == ordered[:-1]) & live[1:] & live[:-1]
    hit = np.zeros((m, left + 1), bool)
    both = np.zeros((m, left + 1), bool)
    both[1:] |= same
    both[:-1] |= same
    np.put_along_axis(hit, at, both, 0)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for r, k in enumerate(order):
        windows = np.flatnonzero(hit[r, : anchors[k] + 1][::-1])  # window = anchor - bytes to its left
        if len(windows):
            cut = np.flatnonzero(np.diff(windows) != 1) + 1
            out[k] = [(int(w[0]), len(w)) for w in np.split(windows, cut)]
    return out


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """d, t (of the text, which tells rows of one id apart) and text."""
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def _with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """`rows` joined with `counts`, whose column `count` says how many of the rows have a key; both are tables of materialize()."""
    many = F.col(count) > max(HOT, rows.count() // HOT_KEYS)
    hot = counts.where(many)
    if hot.isEmpty():
        return rows.join(counts, keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(counts.where(~many), keys))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """d, t, runs: array of (first, windows) of the repeated windows, in bytes; texts without any are absent."""
    rows = _rows(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(ids, hashes, texts):
        out = [[], [], [], [], [], [], []]
        for d, t, x in zip(ids, hashes, texts, strict=True):
            h, c, first, count, a = contexts((x or "").encode("utf-8", "surrogatepass"))
            n = len(h)
            for column, values in zip(out, (h.view(np.int64).tolist(), c.view(np.int64).tolist(), [d] * n, [t] * n, first.tolist(), count.tolist(), (a - first).tolist()), strict=True):
                column += values
        return out

    kinds = f"d {kind}, t long, p int, n int, a int"
    every = materialize(map_rows(rows, find, f"h long, c long, {kinds}"), "dedup-anchors")
    often = materialize(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "dedup-often")
    some = materialize(_with_counts(every, often, ["h"], "k").drop("k"), "dedup-shared")
    discard(every)
    context = some.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("d", "t", "p", "n", "a")).alias("o"))
    context = materialize(context, "dedup-contexts")
    settled = [_with_counts(some, context.where("k > 1").select("h", "c", "k"), ["h", "c"], "k").select("d", "t", "p", "n")]

    many = materialize(context.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "dedup-many")
    open_ = _with_counts(context, many, ["h"], "m").select("h", "k", "m", "o.*")
    lists = open_.groupBy("d", "t").agg(F.collect_list(F.struct("h", "p", "n", "a", (F.col("m") > GROUP).alias("hot"), (F.col("k") == 1).alias("lone"))).alias("asked"))
    lists = lists.withColumnsRenamed({"d": "l_d", "t": "l_t"})
    with_text = rows.join(lists, rows["d"].eqNullSafe(lists["l_d"]) & (rows["t"] == lists["l_t"])).select("d", "t", "text", "asked")
    with_text = with_text.dropDuplicates(["d", "t"])  # repeated rows have one context each here

    def cut(ids, hashes, texts, asked):
        out = []
        for d, t, x, todo in zip(ids, hashes, texts, asked, strict=True):
            data = (x or "").encode("utf-8", "surrogatepass")
            out += [(q["h"], d, t, q["p"], q["n"], q["a"], q["lone"], q["hot"], data[q["p"] : q["p"] + q["n"] + LENGTH - 1]) for q in todo]
        return list(zip(*out, strict=True)) if out else None

    part = f"g long, {kinds}, lone boolean"
    parts = materialize(map_rows(with_text, cut, f"{part}, hot boolean, data binary", 256), "dedup-parts")
    few, used = [parts.where("not hot").drop("hot")], [often, some, context, many, parts]
    for level in range(1, 10):
        hot = parts.where("hot").drop("hot")
        if not hot.limit(1).count():
            break
        found, parts = _divide(hot, level, kinds)
        settled.append(found.where("lone and k > 1").select("d", "t", "p", "n"))
        few.append(parts.where("not hot").drop("hot"))
        used += [found, parts]
    grouped = few[0]
    for more in few[1:]:
        grouped = grouped.union(more)
    grouped = grouped.repartition("g").sortWithinPartitions("g")

    runs_type = parts.select("d", "t", "p", "n").schema

    def compare(batches):
        import pyarrow as pa

        held, last = [], None

        def flush():
            if len({r[1:4] for r in held}) < 2:
                return []
            found = repeated([r[7] for r in held], [r[5] for r in held], [r[4] for r in held])
            return [(r[1], r[2], r[3] + first, n) for r, runs in zip(held, found, strict=True) if r[6] for first, n in runs]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(runs_type)
        ready = []
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns), strict=True):
                    if row[0] != last and held:
                        ready += flush()
                        held = []
                    last = row[0]
                    held.append(row)
                if len(ready) > 4096:
                    yield batch_of(ready)
                    ready = []
        if held:
            ready += flush()
        if ready:
            yield batch_of(ready)

    compared = grouped.mapInArrow(compare, runs_type)
    runs = compared
    for more in settled:
        runs = runs.union(more)
    runs = materialize(runs.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("p", "n"))).alias("runs")), "dedup-runs")
    for x in used:
        discard(x)
    return runs


def _divide(hot: DataFrame, level: int, kinds: str) -> tuple[DataFrame, DataFrame]:
    """(found, parts) of one level of division.

    found: the lone parts that stand in their group more than once (k times).
    parts: one of each of the unlike parts of a group that has several and a
    lone one among them; `hot` are those of groups to be divided again."""

    def split(groups, ids, hashes, ps, ns, anchors, lone, datas):
        out = []
        for g, d, t, p, n, a, one, data in zip(groups, ids, hashes, ps, ns, anchors, lone, datas, strict=True):
            out += [(x[0], x[1], d, t, *x[2:5], one, x[5]) for x in halves(g, level, data, p, n, a)]
        return list(zip(*out, strict=True)) if out else None

    kids = materialize(map_rows(hot, split, f"g long, f long, {kinds}, lone boolean, data binary"), "dedup-halves")
    one = kids.groupBy("g", "f").agg(F.count("*").alias("k"), F.min(F.struct("d", "t", "p", "n", "a", "lone", "data")).alias("o"))
    one = materialize(one.select("g", "f", "k", "o.*"), "dedup-parts")
    again = _with_counts(kids, one.select("g", "f", "k").where("k > 1"), ["g", "f"], "k").where("lone").select("lone", "k", "d", "t", "p", "n")
    again = materialize(again, "dedup-settled")
    discard(kids)
    lone = F.col("lone") & (F.col("k") == 1)
    several = one.groupBy("g").agg(F.count("*").alias("m"), F.max(lone).alias("open")).where("m > 1 and open").select("g", "m")
    parts = _with_counts(one, materialize(several, "dedup-many"), ["g"], "m").select("g", "d", "t", "p", "n", "a", lone.alias("lone"), (F.col("m") > GROUP).alias("hot"), "data")
    parts = materialize(parts, "dedup-parts")
    discard(one)
    return again, parts


def _removed(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[list[int]] = []
    for r in runs:
        a, b = r["p"], r["p"] + r["n"] - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """`id_col`, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes), a row for each document."""
    found = spans(docs, id_col, text).withColumnsRenamed({"d": "r_d", "t": "r_t"})
    rows = _rows(docs, id_col, text)
    rows = rows.join(found, rows["d"].eqNullSafe(found["r_d"]) & (rows["t"] == found["r_t"]), "left").select("d", "text", "runs")

    def work(ids, texts, lists):
        out = []
        for d, x, runs in zip(ids, texts, lists, strict=True):
            data = (x or "").encode("utf-8", "surrogatepass")
            gone = _removed(runs) if runs else []
            at, kept = 0, []
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            row = (d, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest())
            out.append((*row, left) if with_bytes else row)
        return list(zip(*out, strict=True))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"d {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return map_rows(rows, work, schema).withColumnRenamed("d", id_col)
