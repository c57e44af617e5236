"""Alignment of tokenizers, near duplicates among vectors, phrases: against brute force, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, words_of
from tripweave.llm import alignment, embedding_dedup, phrases
from tripweave.llm.queries import tokenizer_path

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = ["x  two  spaces ", " \n tab\tand nbsp", "<|endoftext|> <s> </s> <unk> <0x41>", "emoji 🙂🙂 naïve ÀÉ œ", "it's we'll  I'd", "a" * 6000, "ab" * 4000, "1234567890 " * 300, "end ", " ", "▁mark", "a ▁ b", "日本語 テキスト", "x\u0000y", " em space", "-- ... !!\n\n\nx"]


# --- op11 ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*map(tokenizer_path, FILES))


def whole(aligner, text):
    """(ids of A, ids of B, groups) of a whole text; None if a side doesn't give it back."""
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    sides = [[t[i] for i in ids] for t, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
    cuts, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for c in cuts:
        m, n = i, j
        while m < len(a) and ends[0][m] <= c:
            m += 1
        while n < len(b) and ends[1][n] <= c:
            n += 1
        out.append((a[i:m], b[j:n]))
        i, j = m, n
    return a, b, out


def test_chunks_are_encoded_as_the_whole(aligner):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", " ", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "é", " ", "▁", "🙂", "-", "Hello"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text in texts:
        cut = alignment.chunks(text)
        assert "".join(cut) == " " + text and all(c.startswith(" ") for c in cut)
        want = whole(aligner, text)
        rows = aligner(list(dict.fromkeys(cut)))
        rows = dict(zip(dict.fromkeys(cut), rows))
        if want is None:
            assert None in rows.values()
            continue
        spelt = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want[2])
        assert "".join(rows[c][4] for c in cut)[:-1] == spelt
        assert (sum(rows[c][0] for c in cut), sum(rows[c][1] for c in cut), sum(rows[c][2] for c in cut)) == (len(want[0]), len(want[1]), len(want[2]))


def test_alignment_against_brute_force(spark, corpus, aligner):
    rows = [(i, t) for i, t in corpus] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (None, "no id here"), (5, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = alignment.align(df.repartition(5), *map(tokenizer_path, FILES))
    held = Counter()
    links = []
    for _, text in rows:
        found = whole(aligner, text) if text else None
        own = Counter((x, y) for p, q in found[2] for x in p for y in q) if found else Counter()
        links.append((found, own))
        held.update(own.keys())
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (i, _), (found, own) in zip(rows, links):
        if found is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        spelt = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found[2])
        want.append((
            i, len(found[0]), len(found[1]), len(found[2]), sum(own.values()), sum(m for p, m in own.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in own.items()),
            hashlib.sha256(spelt.encode()).hexdigest(),
        ))
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(w[7] == "" and w[0] is not None and w[0] >= 1000 for w in want)  # some text isn't given back


def test_alignment_of_an_empty_table(spark, empty):
    got = alignment.align(empty, *map(tokenizer_path, FILES))
    assert got.count() == 0 and got.columns[0] == "doc_id"


# --- op12 ----------------------------------------------------------------------------------


def plain_links(rows, threshold):
    """(n_links, component) of each row, all pairs compared."""
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    f32 = [np.array(v, np.float32).astype(np.float64) if ok else None for (_, v), ok in zip(rows, usable)]
    near = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and len(f32[a]) == len(f32[b]):
                x, y = f32[a], f32[b]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    label = {}
    for a in range(len(rows)):
        seen, stack = {a}, [a]
        while stack:
            k = stack.pop()
            for q in near[k] | {q for q in range(len(rows)) if usable[k] and rows[q][0] == rows[k][0] and usable[q]}:
                if q not in seen:
                    seen.add(q)
                    stack.append(q)
        label[a] = min(rows[k][0] for k in seen) if usable[a] else rows[a][0]
    return [(i, len(near[k]), label[k], label[k] == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 37])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    """Copies, near copies about the threshold, chains, odd values and lengths; small blocks make many tiles and boxes."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24)) * np.linspace(3, 0.2, 24)
    vectors = [base[rng.integers(40)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35]) for _ in range(300)]
    vectors += [vectors[0]] * 40 + [vectors[5] * 2.5] * 3
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-1.0, -2.0])]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (8, rows[9][1]), (909, [3e38] * 24), (910, [1e-38] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in (*CLASHING, "v", "key", "vec", "box", "label")})
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted(plain_links(rows, 0.95), key=repr)
    assert len(got) == len(rows) and sum(n for _, n, _, _ in got) > 2000
    none = [r for r in got if r[0] is None]
    assert none == [(None, 0, None, True)]


def test_vectors_at_the_threshold(spark):
    """A cosine of exactly 0.6 in double precision is found at 0.6, the next one above is not."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.n_links for r in embedding_dedup.near_duplicates(df, 0.6).orderBy("vec_id").collect()] == [1, 1, 0]
    assert [r.n_links for r in embedding_dedup.near_duplicates(df, math.nextafter(0.6, 1)).orderBy("vec_id").collect()] == [0, 0, 0]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).collect() == []
    unusable = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(unusable).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_tile_stops_early_and_loses_nothing():
    rng = np.random.default_rng(8)
    x, y = (embedding_dedup.unit(np.vstack([rng.normal(size=(700, 96)), np.tile(rng.normal(size=96), (50, 1)) + rng.normal(size=(50, 96)) * s])) for s in (0.1, 0.3))
    for t in (0.3, 0.6, 0.95):
        got = {(int(a), int(b)) for rows, cols, sums in embedding_dedup.tile(x, y, t) for a, b, s in zip(rows, cols, sums) if s >= t}
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ y.T >= t))}


# --- op13 ----------------------------------------------------------------------------------


def plain_phrases(rows, least, top=2000):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        own = count["und" if lang is None else lang]
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(upper)):
            w = re.findall("[^ \t]+", piece)
            total[lang if lang is not None else "und"] += len(w)
            for n in (1, 2, 3):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in count.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in held.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, x, y, total[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    vocabulary = ["the", "New", "YORK", "city", "é", "zürich", "日本", "a", "b", "c"]
    rows = []
    for k in range(160):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", "New York City " * 30), ("en", None), ("de", ""), ("fr", " . ; "), ("es", "one two"), ("en", "x" * 5000)] + [rows[3]] * 4
    return rows


@pytest.mark.parametrize(("held", "size"), [(600_000, 1_000_000), (600_000, 300), (0, 300)])
def test_phrases_against_plain_counts(spark, monkeypatch, held, size):
    """The dictionary with every task and in a join, one range of keys and many."""
    monkeypatch.setattr(phrases, "RANGE_SIZE", size)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in (*CLASHING, "word", "part", "a", "x", "y", "z", "rank")})
    got = sorted(tuple(r) for r in phrases.mine(df, dictionary_words=held).collect())
    assert got == plain_phrases(rows, 10) and {r[0] for r in got} >= {"en", "de", "und"}
    few = sorted(tuple(r) for r in phrases.mine(df, top=3, dictionary_words=held).collect())
    assert few == [r for r in plain_phrases(rows, 10) if r[1] <= 3]


def test_phrases_of_nothing(spark, empty):
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", "only once said")], "lang string, text string")).collect() == []


def test_phrase_scores_are_exact(spark):
    """Products far beyond 64 bits."""
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        a = rng.randint(1, 10**14)
        rows.append((a, rng.randint(a, 10**15 - 1), rng.randint(a, 10**15 - 1)))
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r.s for r in df.withColumn("s", phrases._score("a", "l", "r")).collect()] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_radix_runs():
    rng = np.random.default_rng(4)
    high, low = rng.integers(0, 3, 5000, dtype=np.uint64) << np.uint64(40) | rng.integers(0, 4, 5000, dtype=np.uint64), rng.integers(0, 70000, 5000, dtype=np.uint32) // 9000
    got = phrases.runs(high, low.astype(np.uint32))
    want = sorted(Counter(zip(high.tolist(), low.tolist())).items())
    assert list(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == want
    again = phrases.from_binary(phrases.to_binary(got[0], got[1]))
    assert (again[0] == got[0]).all() and (again[1] == got[1]).all()
