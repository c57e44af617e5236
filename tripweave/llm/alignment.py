"""Cross-tokenizer alignment: id-striped dense count matrices over linked token pairs.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut a text
into groups; every token of one side in a group is linked with every token of
the other. A pair's count is the number of documents that hold it linked, and
the best partners of an id are the row maxima of the matrix of counts.

The matrix is dealt by rows: stripe s of STRIPES holds the ids that leave the
rest s, so that frequent ids, which stand together, are spread. The links of a
batch of documents are written once by stripe: the distinct pairs, the number of
documents of each, and which those are. Counting reads the first two alone:
`np.add.at` into the dense block of a stripe, of which the entries that aren't
zero and the row maxima go on. Scoring brings the links of a stripe together with its block
and yields sums by document, batch by batch. The links of a stripe are dealt
over several tasks by batch, each with a copy of the block, so that no task
grows with the corpus; all sides are streamed and only a block is held.

A text is aligned by its chunks: it is cut before each space between two
printable ASCII characters other than a space, where both tokenizers end a
token whatever stands around (one starts a new word with the space, the other
no piece crosses it; both are asserted on the files). A task aligns each
distinct chunk once and keeps it, within CHUNKS_HELD. Tokens of a text aren't used at all
if their bytes on either side differ from the text's.

Defined results: null and empty texts and texts that a tokenizer can't give back
have no tokens: zeros and an empty digest; repeated rows count as documents of
their own; an empty table gives an empty result; ids may be null; other columns
play no part.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Stripes of the matrix; a block has ids / STRIPES rows.
STRIPES = 64
#: Documents and code points in a batch, at most (a longer text is a batch of its own).
BATCH, BATCH_CHARS = 2048, 1_500_000
#: Chunks after which a task lets go of those that it hasn't met meanwhile, and the longest that it keeps (code points).
CHUNKS_HELD, CHUNK_KEPT = 120_000, 48
#: Pairs of a stripe that one task scores, about.
SCORED = 8_000_000

_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
MARK = "▁"


def chunks(text: str) -> list[str]:
    """The text with a space in front, cut before single spaces between printable ASCII characters; every chunk begins with a space."""
    first, *rest = _CUT.split(" " + text)
    return [first, *[" " + r for r in rest]]


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the one side, of the other) up to the end of each group, from the end offsets of the tokens of both.

    A token without bytes belongs to the group that ends where it does."""
    both = np.intersect1d(a, b)
    return np.searchsorted(a, both, "right"), np.searchsorted(b, both, "right")


class Aligner:
    """Two tokenizer files, the chunks aligned so far, and the alignment of texts."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its share of the cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=piece_file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        self.rows, self.columns = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        self.bytes_a = [b""] * self.rows
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [b""] * self.columns
        for i in range(self.columns):
            piece = self.b.id_to_piece(i)
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece crosses a word's mark: chunks are not independent")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # The text of each token as it stands within its group and at its end.
        self.spelt = [f"{i}{c}" for i in range(self.rows) for c in ",|"] + [f"{i}{c}" for i in range(self.columns) for c in ",;"]
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def align(self, chunk: str, a: list[int], b: list[int]) -> tuple | None:
        """(tokens of A, tokens of B, groups, links, text of the groups, packed pairs, links of each pair if they aren't one each) of a chunk; None if a side's bytes differ from it."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        raw = chunk.encode("utf-8", "surrogatepass")
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        at, to = groups(*(np.cumsum([len(x) for x in parts], dtype=np.int64) for parts in (parts_a, parts_b)))
        spelt, pairs, links, i, j = [], Counter(), 0, 0, 0
        for m, n in zip(at.tolist(), to.tolist(), strict=True):
            left, right = a[i:m], b[j:n]
            spelt.append(f"{','.join(map(str, left))}|{','.join(map(str, right))};")
            links += len(left) * len(right)
            many = Counter(right).items()
            for x, k in Counter(left).items():
                for y, l in many:
                    pairs[x * self.columns + y] += k * l
            i, j = m, n
        n = len(pairs)
        return len(a), len(b), len(at), links, "".join(spelt), np.fromiter(pairs.keys(), np.int64, n).tobytes(), np.fromiter(pairs.values(), np.int64, n).tobytes()

    def align_all(self, new: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """align() of many chunks at once: they are laid end to end, as both sides end where a chunk does."""
        if not new:
            return []
        count_a, count_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, count_a), (b, count_b)))
        size_a, size_b = self.size_a[ids_a], self.size_b[ids_b]
        raw = [c.encode("utf-8", "surrogatepass") for c in new]
        whole = np.fromiter(map(len, raw), np.int64, len(raw))
        sums = [np.diff(np.concatenate(([0], np.cumsum(s)))[np.concatenate(([0], np.cumsum(n)))]) for s, n in ((size_a, count_a), (size_b, count_b))]
        plain = bool((sums[0] == whole).all() and (sums[1] == whole).all() and size_a.all() and size_b.all())
        joined = b"".join(raw) if plain else b""
        plain = plain and all(b"".join(map(t.__getitem__, i.tolist())) == joined for t, i in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        if not plain:  # some chunk isn't given back: look at halves
            if len(new) == 1:
                return [self.align(new[0], a[0], b[0])]
            half = len(new) // 2
            return self.align_all(new[:half], a[:half], b[:half]) + self.align_all(new[half:], a[half:], b[half:])

        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        to = np.searchsorted(ends_b, ends_a)
        both = ends_b[to] == ends_a
        at, to = np.flatnonzero(both) + 1, to[both] + 1  # tokens up to the end of each group
        n_a, n_b = np.diff(at, prepend=0), np.diff(to, prepend=0)
        last_a, last_b = np.cumsum(count_a), np.cumsum(count_b)
        last_group = np.searchsorted(at, last_a) + 1
        links = np.diff(np.concatenate(([0], np.cumsum(n_a * n_b)))[last_group], prepend=0)
        heavy = links > 16 * (count_a + count_b) + 256  # their pairs are counted, not listed
        spread = np.where(np.repeat(heavy, np.diff(last_group, prepend=0)), 0, n_b)

        group_a, group_b = np.repeat(np.arange(len(at)), n_a), np.repeat(np.arange(len(at)), n_b)
        times = spread[group_a]
        total = np.cumsum(times)
        step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - times, times)
        pairs = np.repeat(ids_a, times) * self.columns + ids_b[np.repeat((to - n_b)[group_a], times) + step]
        last_pair = np.concatenate(([0], total))[last_a]

        flat = np.empty(len(ids_a) + len(ids_b), np.int64)
        end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        end_a[at - 1] = end_b[to - 1] = 1
        flat[np.arange(len(ids_a)) + (to - n_b)[group_a]] = 2 * ids_a + end_a
        flat[np.arange(len(ids_b)) + at[group_b]] = 2 * (self.rows + ids_b) + end_b
        spelt = list(map(self.spelt.__getitem__, flat.tolist()))
        packed, out, low, pair = pairs.tobytes(), [], 0, 0
        rows = zip(count_a.tolist(), count_b.tolist(), np.diff(last_group, prepend=0).tolist(), links.tolist(), (last_a + last_b).tolist(), last_pair.tolist(), heavy.tolist(), strict=True)
        for k, (x, y, g, l, high, to_pair, many) in enumerate(rows):
            out.append(self.align(new[k], a[k], b[k]) if many else (x, y, g, l, "".join(spelt[low:high]), packed[8 * pair : 8 * to_pair], b""))
            low, pair = high, to_pair
        return out

    def __call__(self, wanted: list[str]) -> list[tuple | None]:
        """The alignments of distinct chunks.

        Chunks of the last CHUNKS_HELD that were new, and of as many before them, are kept for later calls."""
        recent, older, new, got = self.recent, self.older, [], []
        for chunk in wanted:
            row = recent.get(chunk, _NONE)
            if row is _NONE:
                row = older.get(chunk, _NONE)
                if row is _NONE:
                    new.append(chunk)
                else:
                    recent[chunk] = row
            got.append(row)
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        made = []
        for k in range(0, len(new), 16_384):
            part = new[k : k + 16_384]
            a = [e.ids for e in encode(part, add_special_tokens=False)]
            made += self.align_all(part, a, self.b.encode([c[1:] for c in part], num_threads=1))
        recent.update((c, r) for c, r in zip(new, made, strict=True) if len(c) <= CHUNK_KEPT)
        if len(recent) > CHUNKS_HELD:
            self.older, self.recent = recent, {}
        rest = iter(made)
        return [next(rest) if row is _NONE else row for row in got]


_NONE = object()
_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(byte_file: str, piece_file: str) -> Aligner:
    """The two files and their known chunks, once in each Python worker."""
    key = (byte_file, piece_file)
    if key not in _LOADED:
        gc.disable()  # many small rows and no cycles
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


# --- one batch of documents ----------------------------------------------------------------

_LINKS = (
    "batch string, stripe int, n long, codes binary, docs binary, which binary, links binary, "
    "ids array<long>, nulls array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>"
)


_BLANK = (0, 0, 0, 0, "", b"", b"")


def _rows_of(aligner: Aligner, batch: str, ids: list, texts: list[str | None]):
    """The documents' own row (stripe -1) and a row for each stripe that their links have."""
    index: dict[str, int] = {}
    put = index.setdefault
    orders = [[put(c, len(index)) for c in chunks(t)] if t else [] for t in texts]
    rows = aligner(list(index))
    bad = np.array([r is None for r in rows], bool)
    x, y, g, l, spelt, code, link = zip(*[r or _BLANK for r in rows], strict=True) if rows else ((),) * 7
    n, k = len(ids), max(1, len(rows))
    sizes = np.fromiter(map(len, orders), np.int64, n)
    flat, doc = np.fromiter(chain.from_iterable(orders), np.int64, int(sizes.sum())), np.repeat(np.arange(n), sizes)
    lost = (sizes == 0) | (np.bincount(doc, weights=bad[flat], minlength=n) > 0)
    held, many = np.unique((doc * k + flat)[~lost[doc]], return_counts=True)  # the chunks of each document
    doc, chunk = np.divmod(held, k)
    total = lambda c: np.bincount(doc, weights=many * np.array(c, np.int64)[chunk], minlength=n).astype(np.int64).tolist() if rows else [0] * n
    shas = ["" if gone else hashlib.sha256("".join(map(spelt.__getitem__, order))[:-1].encode()).hexdigest() for gone, order in zip(lost.tolist(), orders, strict=True)]
    yield batch, -1, n, None, None, None, None, [i or 0 for i in ids], [i is None for i in ids], total(x), total(y), total(g), total(l), shas

    n_pairs = np.fromiter(map(len, code), np.int64, len(code)) // 8
    every, first = np.frombuffer(b"".join(code), np.int64), np.cumsum(n_pairs) - n_pairs
    times = n_pairs[chunk] if len(chunk) else chunk
    if not times.sum():
        return
    last = np.cumsum(times)
    take = np.repeat(first[chunk] - (last - times), times) + np.arange(last[-1])
    pairs, weight, doc = every[take], np.repeat(many, times), np.repeat(doc, times)
    if any(link):
        weight = weight * np.concatenate([np.frombuffer(w, np.int64) if w else np.ones(m, np.int64) for w, m in zip(link, n_pairs.tolist(), strict=True)])[take]
    a, b = np.divmod(pairs, aligner.columns)
    block = -(-aligner.rows // STRIPES) * aligner.columns
    place = ((a % STRIPES) * block + (a // STRIPES) * aligner.columns + b) * BATCH + doc  # stripe, place in its block, document
    order = np.argsort(place)
    place = place[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    link, place = np.add.reduceat(weight[order], starts), place[starts]
    place, doc = np.divmod(place, BATCH)
    stripe, within = np.divmod(place, block)
    ends = np.searchsorted(stripe, np.arange(STRIPES + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        lo, hi = ends[s], ends[s + 1]
        place = within[lo:hi]
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        docs = np.diff(np.append(starts, hi - lo))
        yield batch, s, int(hi - lo), place[starts].astype("<u4").tobytes(), docs.astype("<u2").tobytes(), doc[lo:hi].astype("<u2").tobytes(), _small(link[lo:hi]), *[None] * 7


def _small(n: np.ndarray) -> bytes:
    """Whole numbers in one byte each if all are below 256, else in eight, told apart by the length; no bytes if all are one."""
    if (n == 1).all():
        return b""
    return n.astype(np.uint8 if n.max() < 256 else "<i8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.ones(n, np.int64)
    return np.frombuffer(data, np.uint8 if len(data) == n else "<i8").astype(np.int64)


def links(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of all batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_LINKS))

    def run(batches):
        import uuid

        import pyarrow as pa

        aligner = loaded(byte_file, piece_file)

        def out(ids, texts):
            rows = list(zip(*_rows_of(aligner, uuid.uuid4().hex, ids, texts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if ids and (len(ids) >= BATCH or size + len(t or "") > BATCH_CHARS):
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield out(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _LINKS)


# --- the matrix ----------------------------------------------------------------------------


def counts(found: DataFrame, rows: int, columns: int) -> DataFrame:
    """stripe, codes and docs: places of each stripe's block that aren't zero, and their counts; row maxima follow from them.

    Blocks are dealt by stripe and filled as the rows come by."""
    height = -(-rows // STRIPES)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("stripe", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())])
        block, now = None, None

        def out():
            at = np.flatnonzero(block)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([block[at].astype("<u8").tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for stripe, codes, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != now:
                    if now is not None:
                        yield out()
                    now, block = stripe, np.zeros(height * columns, np.uint32)
                np.add.at(block, np.frombuffer(codes, "<u4"), np.frombuffer(docs, "<u2"))
        if now is not None:
            yield out()

    dealt = found.where("stripe >= 0").select("stripe", "codes", "docs").repartition(STRIPES, "stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(run, "stripe int, codes binary, docs binary")


def scores(found: DataFrame, matrix: DataFrame, rows: int, columns: int, tasks: int) -> DataFrame:
    """batch, n_best and sums (unsigned 64-bit numbers of each document of the batch) for each stripe that the batch has links in."""
    height = -(-rows // STRIPES)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("batch", pa.string()), ("best", pa.binary()), ("sums", pa.binary())])
        block = top = None
        for part in batches:
            out = []
            for batch, stripe, n, codes, docs, which, link in zip(*(part.column(c).to_pylist() for c in ("batch", "stripe", "n", "codes", "docs", "which", "links")), strict=True):
                at = np.frombuffer(codes, "<u4")
                if batch is None:  # the block comes before its links
                    if block is None:
                        block = np.zeros(height * columns, np.uint32)
                    block[:] = 0
                    block[at] = np.frombuffer(docs, "<u8")
                    top = block.reshape(height, columns).max(axis=1)
                    continue
                held = np.repeat(block[at].astype(np.int64), np.frombuffer(docs, "<u2"))
                best = np.repeat(block[at] == top[at // columns], np.frombuffer(docs, "<u2"))
                doc, link = np.frombuffer(which, "<u2"), _large(link, n)
                size = int(doc.max()) + 1
                n_best, sums = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(n_best, doc, link * best)
                np.add.at(sums, doc, link * held)
                out.append((batch, n_best.tobytes(), sums.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    none = F.lit(None)
    blocks = matrix.select(
        none.cast("string").alias("batch"), "stripe", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"),
        "codes", "docs", none.cast("binary").alias("which"), none.cast("binary").alias("links"),
    )
    own = found.where("stripe >= 0").select("batch", "stripe", F.pmod(F.xxhash64("batch"), F.lit(tasks)).cast("int").alias("share"), F.lit(1).alias("kind"), "n", "codes", "docs", "which", "links")
    dealt = blocks.unionByName(own).repartition(STRIPES * tasks, "stripe", "share").sortWithinPartitions("stripe", "share", "kind")
    return dealt.mapInArrow(run, "batch string, best binary, sums binary")


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each document."""
    sized = loaded(byte_file, piece_file)
    rows, columns = sized.rows, sized.columns
    found = materialize(links(docs, byte_file, piece_file, id_col, text), "align-links")
    pairs = found.where("stripe >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    matrix = materialize(counts(found, rows, columns), "align-counts")
    scored = scores(found, matrix, rows, columns, max(1, -(-pairs // (STRIPES * SCORED))))
    own = found.where("stripe < 0").select("batch", F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("sums"), "ids", "nulls", "n_a", "n_b", "n_groups", "n_links", "shas")
    lists = [c for c in own.columns if c not in scored.columns]
    both = own.unionByName(scored.select("*", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in lists]))

    def run(frame):
        import pandas as pd

        base = frame[frame["ids"].notna()].iloc[0]
        size = len(base["ids"])
        total = np.zeros((2, size), np.int64)
        for best, sums in zip(frame["best"], frame["sums"], strict=True):
            if best is not None:
                for k, data in enumerate((best, sums)):
                    part = np.frombuffer(data, np.int64)
                    total[k, : len(part)] += part
        ids = pd.arrays.IntegerArray(np.array(base["ids"], np.int64), np.array(base["nulls"], bool))
        return pd.DataFrame({"id": ids, **{c: base[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": total[0], "count_sum": total[1], "groups_sha256": base["shas"]})

    out = both.groupBy("batch").applyInPandas(run, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
