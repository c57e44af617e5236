"""Token ids in a binary format: canonical, length-limited Huffman codes.

Texts are encoded with a tokenizers file, an end id closes each document, and
the ids of all documents are counted. Package-merge gives code lengths of at
most MAX_BITS, from which the canonical codes follow; the lengths are all that
the codebook stores. Each document is a block of its own: it starts at a byte
and names the bit offset of every EVERY-th id, so that a reader can begin at any
block and decode its stretches side by side with one table look-up per id.

Block: b"HUF1", ids and checkpoints (both unsigned 32-bit, little-endian), the
checkpoints (unsigned 64-bit bit offsets into the stream), the stream (bits from
the high end of each byte, 4 zero bytes at its end).

The blocks stand in ascending order of the document id: files in the order of
their number, rows in the order of their position. Spark writes them as Parquet
rows, for executors share no other file system.

Defined results: null and empty texts are blocks of one end id; repeated rows
are blocks of their own (null ids come first); an empty table gives an empty
result; ids that occur nowhere have no code.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SLICE, discard, map_rows, materialize

MAX_BITS = 16
#: Ids between two checkpoints of a block.
EVERY = 512
MAGIC = b"HUF1"


# --- text to ids ---------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    Where the file's rules treat white space as nothing but a border, a text's
    ids are those of its words, and each distinct word is encoded once and kept.
    For words of Latin letters the file's normalizer and pre-tokenizer are a
    lower-casing and a pattern, so that only the pieces go to the model; any
    other word takes the library's whole path."""

    KEPT = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.words, self.pieces = {"": b""}, {}  # ids as little-endian unsigned 16-bit
        self.pattern = self._pattern(rules)
        if self.pattern is not None:
            import regex

            self.pattern = regex.compile(self.pattern)
            self.plain = regex.compile("[!-~¡-¬®-įı-ž]+")
            special = [t["content"] for t in rules["added_tokens"]]
            self.special = tuple({t[:2] for t in special})
            self.byte_chars = self._byte_chars()
            # A run of letters, then ASCII punctuation without an apostrophe: two pieces whatever the pattern's order.
            self.simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ž]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        self.tokenize = self.tokenizer.model.tokenize

    @staticmethod
    def _pattern(rules: dict) -> str | None:
        """The pre-tokenizer's pattern, if white space is but a border between words."""
        norm = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [p["type"] for p in pre]
        if norm != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or not pre[0]["invert"]:
            return None
        if pre[1]["add_prefix_space"] or pre[1]["use_regex"] or pre[0]["behavior"] != "Removed":
            return None
        return pre[0]["pattern"]["Regex"]

    @staticmethod
    def _byte_chars() -> list[str]:
        """The character that stands for each byte: itself if printable, else from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out, n = {b: chr(b) for b in shown}, 0
        for b in range(256):
            if b not in out:
                out[b] = chr(256 + n)
                n += 1
        return [out[b] for b in range(256)]

    def _word(self, word: str) -> bytes:
        if m := self.simple(word):
            letters, marks = m.groups()
            if marks[:2] not in self.special:
                return self._piece(letters.lower()) + self._piece(marks) if marks else self._piece(letters.lower())
        if not self.plain.fullmatch(word) or any(s in word for s in self.special):
            return self._whole(word)
        return b"".join(map(self._piece, self.pattern.findall(word.lower())))

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            chars = piece if piece.isascii() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            known = self.pieces[piece] = array("H", [t.id for t in self.tokenize(chars)]).tobytes()
        return known

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text, little-endian unsigned 16-bit."""
        if not text:
            return b""
        if self.pattern is None:
            return self._whole(text)
        for c in "\n\t\r\v\f":
            if c in text:
                text = text.replace(c, " ")
        parts = text.split(" ")
        words = self.words
        if len(words) > self.KEPT:
            words.clear()
            words[""] = b""
            self.pieces.clear()
        for w in set(parts).difference(words):
            words[w] = self._word(w)
        return b"".join(map(words.__getitem__, parts))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """d_id and ids (little-endian unsigned 16-bit, with the end id), a row for each document."""

    end = struct.pack("<H", end_id)

    def work(keys, texts):
        encode_one = encoder(path)
        return keys, [encode_one(t) + end for t in texts]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text)), work, f"d_id {kind}, ids binary")


# --- codes ---------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Optimal code length of each id, at most `most` bits (package-merge); ties by id."""
    order = sorted(counts, key=lambda i: (counts[i], i))
    n = len(order)
    if n < 2:
        return dict.fromkeys(order, 1)
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit into codes of {most} bits")
    leaves = np.array([counts[i] for i in order], float)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")  # leaves first among equals
        level = both[at]
        is_leaf.append(at < n)
    lengths, take = np.zeros(n, int), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return dict(zip(order, lengths.tolist(), strict=True))


class Codebook:
    """Canonical codes from the code lengths: by length, then id."""

    def __init__(self, lengths: dict[int, int]):
        size = max(lengths, default=0) + 1
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.uint64)
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.used = np.zeros(1 << MAX_BITS, np.int64)
        code, last = 0, 0
        for i in sorted(lengths, key=lambda i: (lengths[i], i)):
            bits = lengths[i]
            code <<= bits - last
            self.length[i], self.code[i] = bits, code
            low = code << (MAX_BITS - bits)
            self.symbol[low : low + (1 << (MAX_BITS - bits))] = i
            self.used[low : low + (1 << (MAX_BITS - bits))] = bits
            code, last = code + 1, bits

    def pack(self, documents: list[np.ndarray]) -> list[bytes]:
        """A block for each array of ids."""
        sizes = np.array([len(d) for d in documents], np.int64)
        ids = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        bits = self.length[ids]
        ends = np.cumsum(bits)
        first = np.cumsum(sizes) - sizes  # of each document
        total = np.concatenate(([0], ends))
        own = total[first + sizes] - total[first]  # bits of each document
        words = (own + 31) // 32 + 1
        base = (np.cumsum(words) - words) * 32  # bit at which its stream starts
        at = ends - bits + np.repeat(base - total[first], sizes)
        value = self.code[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
        summed = np.add.reduceat(value, new) if len(new) else value
        stream = np.zeros(int(words.sum()) + 1, np.uint64)
        stream[word[new]] += summed >> np.uint64(32)
        stream[word[new] + 1] += summed & np.uint64(0xFFFFFFFF)
        raw = stream.astype(">u4").tobytes()
        out = []
        for d in range(len(documents)):
            marks = at[first[d] : first[d] + sizes[d] : EVERY] - base[d]
            low = int(base[d]) // 8
            head = MAGIC + struct.pack("<II", int(sizes[d]), len(marks)) + marks.astype("<u8").tobytes()
            out.append(head + raw[low : low + int(words[d]) * 4])
        return out

    def unpack(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; all stretches between checkpoints are decoded side by side."""
        streams, starts, counts, sizes, low = [], [], [], [], 0
        for b in blocks:
            if b[:4] != MAGIC:
                raise ValueError("not a block of token ids")
            n, marks = struct.unpack_from("<II", b, 4)
            offsets = np.frombuffer(b, "<u8", marks, 12).astype(np.int64)
            stream = np.frombuffer(b, np.uint8, offset=12 + 8 * marks)
            streams.append(stream)
            starts.append(offsets + 8 * low)
            count = np.full(marks, EVERY, np.int64)
            if marks:
                count[-1] = n - EVERY * (marks - 1)
            counts.append(count)
            sizes.append(n)
            low += len(stream)
        if not blocks:
            return []
        raw = np.concatenate([*streams, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]  # 24 bits from each byte on
        at, count = np.concatenate(starts), np.concatenate(counts)
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        order = np.argsort(-count, kind="stable")
        at, first = at[order], first[order]
        left = np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), side="left")  # stretches that have a k-th id
        for k, n in enumerate(left.tolist()):
            p = at[:n]
            seen = (window[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
            out[first[:n] + k] = self.symbol[seen]
            p += self.used[seen]
        return np.split(out, np.cumsum(sizes)[:-1])


# --- files ---------------------------------------------------------------------------------


def count_ids(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has ids."""

    def count(batches):
        import pyarrow as pa

        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            column = batch.column(0)
            for k in range(0, len(column), SLICE):
                counts += np.bincount(np.frombuffer(b"".join(column.slice(k, SLICE).to_pylist()), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    partial = encoded.select("ids").mapInArrow(count, "id int, n long")
    return {r.id: r.n for r in partial.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> tuple[dict[int, int], DataFrame]:
    """(code length of each id, the files): file_no, position (ids before the block in its file), d_id, n_tokens, block."""
    encoded = materialize(encode(docs, path, end_id, id_col, text), "token-ids")
    lengths = code_lengths(count_ids(encoded))
    kind = encoded.schema["d_id"].dataType.simpleString()

    def code(keys, rows):
        book = codebook(lengths)
        ids = [np.frombuffer(r, "<u2").astype(np.int64) for r in rows]
        return keys, list(map(len, ids)), book.pack(ids)

    coded = map_rows(encoded, code, f"d_id {kind}, n_tokens long, block binary")
    ordered = coded.repartitionByRange("d_id").sortWithinPartitions("d_id", "n_tokens", "block")

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file_no, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), file_no), pa.int32()), pa.array(before, pa.int64()), *batch.columns],
                names=["file_no", "position", "d_id", "n_tokens", "block"],
            )

    files = materialize(ordered.mapInArrow(place, f"file_no int, position long, d_id {kind}, n_tokens long, block binary"), "token-files")
    discard(encoded)
    return lengths, files


_BOOKS: dict[int, Codebook] = {}


def codebook(lengths: dict[int, int]) -> Codebook:
    """The codebook, built once in each Python worker."""
    key = zlib.crc32(repr(sorted(lengths.items())).encode())
    if key not in _BOOKS:
        _BOOKS.clear()
        _BOOKS[key] = Codebook(lengths)
    return _BOOKS[key]


def read(files: DataFrame, lengths: dict[int, int], with_ids: bool = False) -> DataFrame:
    """d_id, start (ids of all blocks before), n_tokens and ids_crc32 (and ids), decoded from the blocks."""
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(totals), "file_no").select("d_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "block")
    kind = files.schema["d_id"].dataType.simpleString()

    def work(keys, starts, sizes, blocks):
        decoded = codebook(lengths).unpack(blocks)
        if [len(d) for d in decoded] != sizes:
            raise ValueError("a block holds another number of ids than its row says")
        out = [keys, starts, sizes, [zlib.crc32(d.astype("<u4").tobytes()) for d in decoded]]
        return [*out, [d.tolist() for d in decoded]] if with_ids else out

    return map_rows(placed, work, f"d_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
