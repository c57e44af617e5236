"""Phrase collocation mining: packed id n-grams, range-partitioned, radix-sorted and run-length counted.

Words are counted first; those that occur at least `least` times get ids, each
language its own, so that an id names its language too. A rarer word can stand
in no phrase that is frequent enough, so that pieces are broken there. Each
position of a piece gives one binary key of twelve bytes: its id and the two
that follow, 32 bits each, zero where the piece ends. Sorted keys hold the
counts of all lengths at once: a run of equal keys is a phrase of three words, a
run of equal first eight bytes one of two.

A task counts the keys of its texts by runs before anything is moved. Ranges of
keys are cut at quantiles of the keys of a sample of texts (RANGE_TEXTS, about;
it decides balance alone), and each range is sorted and counted by a task. A
frequent pair is cut like any other stretch of keys: a run of pairs that touches
the border of its range is added up afterwards.

The dictionary goes to the tasks only while it is within DICTIONARY words and
DICTIONARY_BYTES bytes, both counted; beyond that, words meet their ids in a join.

Scores are exact: counts below 10^15 are multiplied as decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is `und`,
together with a language of that name; repeated rows count again; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bounds of a dictionary that goes to every task; a larger one is joined.
DICTIONARY, DICTIONARY_BYTES = 600_000, 24_000_000
#: Texts whose keys give the bounds of the ranges, about, and keys taken of a text at most there.
RANGE_TEXTS, RANGE_KEYS = 4_000, 64
#: Keys in a range, about.
RANGE_SIZE = 1_000_000
#: Keys that a task gathers before it counts their runs.
GATHER = 1_000_000
#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 200_000
#: Parts of a language in the first round of ranking.
RANK_PARTS = 64

BREAK = b"\n"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9 + b" ")


def folded(text: str | None) -> bytes:
    """A-Z in lower case, every border of pieces a line feed, every border of words a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text."""
    return [[w for w in piece.split(b" ") if w] for piece in folded(text).split(BREAK)]


def _tokens(text: str | None) -> list[bytes]:
    """Words and breaks of a text in order; empty ones mean nothing."""
    return folded(text).replace(BREAK, b" \n ").split(b" ")


# --- keys ----------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first two ids as 64 bits, third id) for each position of `ids` that has a word; 0 breaks a piece."""
    ids = np.concatenate([ids, np.zeros(2, ids.dtype)]).astype(np.uint64)
    at = np.flatnonzero(ids[:-2])
    second = ids[at + 1]
    third = np.where(second > 0, ids[at + 2], 0)
    return (ids[at] << np.uint64(32)) | second, third.astype(np.uint32)


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The stable order of the keys (high, low), least digit of 16 bits first; digits that all keys share are left out."""
    digits = [(low >> np.uint32(s)).astype(np.uint16) for s in (0, 16)]
    digits += [(high >> np.uint64(s)).astype(np.uint16) for s in (0, 16, 32, 48)]
    order = None
    for d in digits:
        if len(d) and (d == d[0]).all():
            continue
        turn = np.argsort(d if order is None else d[order], kind="stable")  # of 16-bit numbers: a radix sort
        order = turn if order is None else order[turn]
    return np.arange(len(high)) if order is None else order


def runs(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs (`counts`: of each key given; else once)."""
    order = radix_order(high, low)
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(starts, len(high)))
    else:
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return high[starts], low[starts], total.astype(np.int64)


def to_binary(high: np.ndarray, low: np.ndarray) -> bytes:
    """Keys of twelve bytes each, high end first, so that their order is that of the bytes."""
    out = np.empty(len(high), np.dtype([("high", ">u8"), ("low", ">u4")]))
    out["high"], out["low"] = high, low
    return out.tobytes()


def from_binary(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(data, np.dtype([("high", ">u8"), ("low", ">u4")]))
    return keys["high"].astype(np.uint64), keys["low"].astype(np.uint32)


# --- words ---------------------------------------------------------------------------------


def word_counts(docs: DataFrame, least: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, word, count of the words that occur at least `least` times; lang, n of all word occurrences)."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("c", pa.int64())])
        held: dict[str, Counter] = {}

        def out():
            for language, found in held.items():
                rows = [*found.items(), (None, found.total())]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(language, Counter()).update(folded(t.as_py()).split())
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from out()
        yield from out()

    counted = docs.select(_lang(lang), F.col(text).alias("text")).mapInArrow(run, "lang string, word binary, c long")
    counted = counted.groupBy("lang", "word").agg(F.sum("c").alias("c")).where(F.col("word").isNull() | (F.col("c") >= least))
    counted = materialize(counted, "phrase-words")
    return counted.where("word is not null"), counted.where("word is null").select("lang", F.col("c").alias("n"))


def _lang(lang: str):
    return F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")


def dictionary(words: DataFrame) -> DataFrame:
    """The words with gapless ids from 1: counts by hash part, then a place within the part."""
    parted = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(4096)).cast("int"))
    sizes = parted.groupBy("part").agg(F.count("*").alias("m"))  # 4,096 rows at most
    starts = sizes.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return materialize(parted.join(F.broadcast(starts), "part").select("lang", "word", "c", (F.col("start") + place).alias("id")), "phrase-ids")


# --- n-grams -------------------------------------------------------------------------------


class _Held:
    """Keys of a task, counted by runs whenever GATHER of them are there, and handed on by range."""

    def __init__(self, bounds: bytes):
        self.bounds, self.ids, self.size = bounds, [], 0

    def add(self, ids: np.ndarray):
        self.ids += [ids, np.zeros(1, np.uint32)]
        self.size += len(ids)
        return self.out() if self.size >= GATHER else ()

    def out(self):
        """(range, keys, counts) of what is held."""
        if self.ids:
            high, low, n = runs(*pack(np.concatenate(self.ids)))
            self.ids, self.size = [], 0
            keys = to_binary(high, low)
            cuts = np.searchsorted(np.frombuffer(keys, "S12"), np.frombuffer(self.bounds, "S12"))
            ends = np.concatenate(([0], cuts, [len(high)]))
            for part in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[part], ends[part + 1]
                yield part, keys[12 * a : 12 * b], n[a:b].astype("<i8").tobytes()


_PARTS = "part int, keys binary, counts binary"


def _batch(rows: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"]
    )


def _packed(words: DataFrame) -> bytes:
    """lang, word and id of `words` in Arrow's stream format: what the driver holds and sends is a few bytes a word."""
    import pyarrow as pa

    found, sink = words.select("lang", "word", "id").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


_KNOWN: dict = {}


def _known(ids) -> dict[str, dict[bytes, int]]:
    """The ids by language and word of (name, broadcast of _packed()), built once in each Python worker."""
    import pyarrow as pa

    name, packed = ids
    if name not in _KNOWN:
        _KNOWN.clear()
        out: dict[str, dict[bytes, int]] = {}
        for batch in pa.ipc.open_stream(packed.value):
            for language, word, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.setdefault(language, {})[word] = number
        _KNOWN[name] = out
    return _KNOWN[name]


def _keys_by_broadcast(texts: DataFrame, ids, bounds) -> DataFrame:
    """The counted keys of all texts, the dictionary being with each task."""

    def run(batches):
        known, held = _known(ids), _Held(bounds.value)
        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                get, tokens = known.get(language, {}).get, _tokens(t.as_py())
                rows = list(held.add(np.array([get(w, 0) for w in tokens if w], np.uint32)))
                if rows:
                    yield _batch(rows)
        rows = list(held.out())
        if rows:
            yield _batch(rows)

    return texts.mapInArrow(run, _PARTS)


def _keys_by_join(texts: DataFrame, words: DataFrame, bounds) -> DataFrame:
    """The same with the words of a text meeting their ids in a join; only ids come back together."""
    spelt = F.udf(_tokens_of, "array<binary>")
    placed = texts.withColumn("doc", F.monotonically_increasing_id()).select("lang", "doc", F.posexplode(spelt("text")).alias("at", "word"))
    found = placed.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    lines = found.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))), lambda x: x["id"]).alias("ids"))

    def run(batches):
        held = _Held(bounds.value)
        for batch in batches:
            for ids in batch.column(0):
                rows = list(held.add(ids.values.to_numpy().astype(np.uint32)))
                if rows:
                    yield _batch(rows)
        rows = list(held.out())
        if rows:
            yield _batch(rows)

    return lines.select("ids").mapInArrow(run, _PARTS)


def _tokens_of(text: str | None) -> list[bytes]:
    return [w for w in _tokens(text) if w]


def _bounds(texts: DataFrame, ids, positions: int, rows: int) -> bytes:
    """Keys that cut the keys of a sample of texts into ranges of about equal weight, in order."""
    parts = -(-positions // RANGE_SIZE)
    if parts < 2:
        return b""
    chosen = texts.where(F.rand(7) <= RANGE_TEXTS / max(1, rows)).limit(2 * RANGE_TEXTS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            highs, lows = [], []
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                get = _known(ids).get(language, {}).get
                high, low = pack(np.array([get(w, 0) for w in _tokens(t.as_py()) if w], np.uint32))
                step = max(1, -(-len(high) // RANGE_KEYS))
                highs.append(high[step // 2 :: step])
                lows.append(low[step // 2 :: step])
            yield pa.RecordBatch.from_arrays([pa.array([to_binary(np.concatenate(highs), np.concatenate(lows))], pa.binary())], ["keys"])

    high, low = from_binary(b"".join(r.keys for r in chosen.mapInArrow(run, "keys binary").collect()))
    order = radix_order(high, low)
    cuts = order[np.linspace(0, len(order), parts + 1)[1:-1].astype(np.int64)] if len(order) else order
    return to_binary(*runs(high[cuts], low[cuts])[:2])


def grams(parts: DataFrame, least: int) -> DataFrame:
    """x, y, z (ids; z null in a pair) and a: the pairs and triples of ids that occur at least `least` times."""

    def run(frame):
        import pandas as pd

        keys = [from_binary(k) for k in frame["keys"]]
        high, low, n = runs(*(np.concatenate([k[i] for k in keys]) for i in (0, 1)), np.concatenate([np.frombuffer(c, "<i8") for c in frame["counts"]]))
        triple = np.flatnonzero((low > 0) & (n >= least))
        starts = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))) if len(high) else np.zeros(0, np.int64)
        pair, total = high[starts], np.add.reduceat(n, starts) if len(starts) else n
        border = np.zeros(len(pair), bool)
        border[:1] = border[-1:] = True
        keep = np.flatnonzero(((pair & np.uint64(0xFFFFFFFF)) > 0) & ((total >= least) | border))
        both = np.concatenate([high[triple], pair[keep]])
        return pd.DataFrame({
            "x": (both >> np.uint64(32)).astype(np.int64), "y": (both & np.uint64(0xFFFFFFFF)).astype(np.int64),
            "z": np.concatenate([low[triple].astype(np.int64), np.zeros(len(keep), np.int64)]), "a": np.concatenate([n[triple], total[keep]]),
        })

    counted = parts.groupBy("part").applyInPandas(run, "x long, y long, z long, a long")
    return counted.groupBy("x", "y", "z").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# --- scores --------------------------------------------------------------------------------


def _score(a: str, left: str, right: str):
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * 1000000BD) div ({wide(left)} * {wide(right)})")


def mine(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, lang: str = "lang", text: str = "text", dictionary_words: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` collocations of two and three words.

    A phrase that lies in a longer candidate with at least `share` percent of its count is left out."""
    words, totals = word_counts(docs, least, lang, text)
    known = dictionary(words)
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("c"), F.lit(0)).alias("positions")).first()
    texts, context = docs.select(_lang(lang), F.col(text).alias("text")), docs.sparkSession.sparkContext
    small = size.n <= dictionary_words and size.bytes <= DICTIONARY_BYTES
    # For the bounds alone the most frequent words do, if there are too many.
    sent = known if small else known.orderBy(F.desc("c"), "id").limit(min(dictionary_words, 100_000))
    ids = uuid.uuid4().hex, context.broadcast(_packed(sent))
    bounds = context.broadcast(_bounds(texts, ids, size.positions, texts.count()))
    parts = _keys_by_broadcast(texts, ids, bounds) if small else _keys_by_join(texts, known, bounds)
    found = materialize(grams(parts, least), "phrase-grams")

    pairs = found.where("z = 0").select("x", "y", F.col("a").alias("c"))
    triples = found.where("z > 0")
    inside = triples.select("x", "y", "a").union(triples.select(F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    kept = found.where("z = 0").join(inside, ["x", "y"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    first = triples.join(pairs.withColumnRenamed("c", "xy"), ["x", "y"])
    first = first.join(pairs.toDF("y", "z", "yz"), ["y", "z"])
    rows = kept.select("x", "y", "z", "a", F.lit(None).cast("long").alias("xy"), F.lit(None).cast("long").alias("yz")).unionByName(first.select("x", "y", "z", "a", "xy", "yz"))
    word = lambda c, out: known.select(F.col("id").alias(c), F.struct("lang", "word", "c").alias(out))
    rows = rows.join(word("x", "wx"), "x").join(word("y", "wy"), "y").join(word("z", "wz"), "z", "left")
    cut = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    rows = rows.select(
        F.col("wx.lang").alias("lang"), "a", F.concat_ws(" ", F.col("wx.word").cast("string"), F.col("wy.word").cast("string"), F.col("wz.word").cast("string")).alias("phrase"),
        F.when(F.col("z") == 0, cut(F.col("wx.c"), F.col("wy.c"))).otherwise(cut(F.col("wx.c"), F.col("yz"))).alias("one"),
        F.when(F.col("z") > 0, cut(F.col("xy"), F.col("wz.c"))).alias("two"),
    )
    rows = rows.withColumns({"s1": _score("a", "one.l", "one.r"), "s2": _score("a", "two.l", "two.r")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    rows = rows.select("lang", "phrase", "a", F.when(second, F.col("two")).otherwise(F.col("one")).alias("cut"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "score")
