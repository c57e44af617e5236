"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The vocabulary file gives pieces and their scores. A text is marked (a space
becomes the mark, one mark stands in front) and cut into units: a run of marks
with the code points up to the next mark. No piece crosses such a border, so
the best segmentation of a text is that of its units. The distinct units of a
task's rows are sorted, which lays out a trie: consecutive units share their
longest common prefix, and walking them in that order is the depth-first
traversal. The forward scores of the shared prefix are kept and only the rest
of a unit is searched. Code points without a piece become their UTF-8 bytes.

The search maximises the sum of the log-probabilities of the pieces (ties: the
longer last piece). A file's scores are taken for those, unless they are whole
numbers: then they are merge ranks, whose sum means nothing, and rank r gets the
probability that the law of Zipf and Mandelbrot gives it, 1 / (r + OFFSET) over
its sum for all ranks. Such ids are the likeliest segmentation, not the order of
merges, so that they may differ from a merging encoder's; decoding returns the
text exactly.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
#: Mandelbrot's offset of ranks.
OFFSET = 2.7
#: Score of a byte piece, below any other piece's, so that bytes are a last resort.
BYTE_SCORE = -1e6


class Vocabulary:
    """Pieces, scores and byte pieces of a vocabulary file."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], text_of: dict[int, bytes]):
        self.pieces, self.byte_ids, self.text_of = pieces, byte_ids, text_of
        self.endings: dict = {}  # trie of the reversed pieces; "" holds (id, score)
        for piece, found in pieces.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = found

    @staticmethod
    def load(path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, text_of, byte_ids = {}, {}, [-1] * 256
        scores = [model.get_score(i) for i in range(model.get_piece_size())]
        if all(s == int(s) for s in scores):  # merge ranks, from 0 down
            total = math.log(sum(1.0 / (r + OFFSET) for r in range(len(scores))))
            scores = [-math.log(OFFSET - s) - total for s in scores]
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = scores[i]
                if piece.strip(MARK) or len(piece) == 1:
                    pieces[piece] = (i, score)
                else:
                    pieces[piece] = (i, -float(len(piece)))  # runs of marks: rather one than many
                text_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a word's mark: units are not independent")
        return Vocabulary(pieces, byte_ids, text_of)

    def decode(self, ids) -> str:
        """The text of the ids, without the space of the first mark."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def units(text: str) -> list[str]:
    """The marked units of a text, in order."""
    if not text:
        return []
    out, held = [], ""
    for part in text.split(" "):
        held += MARK
        if part:
            out.append(held + part)
            held = ""
    if held:
        out.append(held)
    return out


def search(vocabulary: Vocabulary, sorted_units: list[str]) -> list[list[int]]:
    """The ids of each unit; the units come sorted and distinct.

    scores[k] is the best score of the first k code points of the current path
    in the trie, start[k] and ids[k] describe the last piece of that best."""
    endings, byte_ids = vocabulary.endings, vocabulary.byte_ids
    scores, start, ids = [0.0], [0], [()]
    out, last = [], ""
    for unit in sorted_units:
        n = len(unit)
        k, most = 0, min(n, len(last))
        while k < most and unit[k] == last[k]:
            k += 1
        del scores[k + 1 :], start[k + 1 :], ids[k + 1 :]
        for end in range(k + 1, n + 1):
            best, at, own = -1e300, -1, None
            node, begin = endings, end
            while begin:  # the pieces that end here, from the shortest
                begin -= 1
                node = node.get(unit[begin])
                if node is None:
                    break
                found = node.get("")
                if found is not None and scores[begin] + found[1] >= best:
                    best, at, own = scores[begin] + found[1], begin, found[0]
            if own is None:
                encoded = unit[end - 1].encode("utf-8", "surrogatepass")
                best, at, own = scores[end - 1] + BYTE_SCORE * len(encoded), end - 1, tuple(byte_ids[b] for b in encoded)
            scores.append(best)
            start.append(at)
            ids.append(own)
        last = unit
        back, end = [], n
        while end:
            own = ids[end]
            if isinstance(own, tuple):
                back += reversed(own)
            else:
                back.append(own)
            end = start[end]
        back.reverse()
        out.append(back)
    return out


#: Units whose ids a Python worker keeps for its next slices (some tens of MB).
KEPT_UNITS = 400_000


def encode_all(vocabulary: Vocabulary, texts: list[str | None], known: dict[str, list[int]] | None = None) -> list[list[int]]:
    """The ids of each text; each distinct unit of the texts that isn't in `known` is searched once."""
    known = {} if known is None else known
    if len(known) > KEPT_UNITS:
        known.clear()
    cut = [units(t or "") for t in texts]
    distinct = sorted(set().union(*cut).difference(known)) if cut else []
    known.update(zip(distinct, search(vocabulary, distinct), strict=True))
    return [list(chain.from_iterable(map(known.__getitem__, u))) for u in cut]


_LOADED: dict[str, tuple[Vocabulary, dict]] = {}


def loaded(path: str) -> tuple[Vocabulary, dict]:
    """The vocabulary of a file and the units known so far, once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = (Vocabulary.load(path), {})
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, ids (array<int>), n_ids and round_trip (decoding the ids gives the text), a row for each document."""

    def work(keys, texts):
        vocabulary, known = loaded(path)
        ids = encode_all(vocabulary, texts, known)
        same = [vocabulary.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
        return keys, ids, list(map(len, ids)), same

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col), F.col(text)), work, f"id {kind}, ids array<int>, n_ids long, round_trip boolean", 2048)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`id_col` and text, a row for each row of ids (null: the empty text)."""

    def work(keys, rows):
        vocabulary, _ = loaded(path)
        return keys, [vocabulary.decode(r or []) for r in rows]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded.select(F.col(id_col), F.col(ids)), work, f"id {kind}, text string").withColumnRenamed("id", id_col)
