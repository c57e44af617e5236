"""The training-data operators against brute force on a small corpus, and on odd input."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words_of
from tripweave.llm import decontaminate, html_text, jaccard_join, pieces, pii, quality, sharding, substring_dedup, tokenfile, toxicity
from tripweave.llm.common import ASCII_LOWER
from tripweave.llm.queries import tokenizer_path

WORD = re.compile(r"[^ \t-\r]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in BASE.items() for m in p.finditer(text) if ok[k](m[0])]


def test_pii_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab1290.-@+ (1.2@4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []


def test_pii_disclosure(spark, empty):
    rows = [(i, f"the rare{i % 3} surname writes to ann{i % 3}@example.org from town{i % 3} today and row{i}", "en", "s", 1) for i in range(6)]
    rows += [(10 + i, f"the surname of today {i} is common", "en", "s", 1) for i in range(60)]
    rows += [(90, None, "en", "s", None), (91, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, empty.schema)
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    text = rows[0][1]
    found = {text[t["start"] : t["end"]] for t in got[0].terms}
    assert {"rare0", "town0"} <= found and not {"the", "today", "surname"} & found
    assert got[10].terms is None and got[90].n_email == 0 and len(got) == len(rows)
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert "@" not in clean[0] and "[EMAIL]" in clean[0] and "rare0" not in clean[0] and clean[10] == rows[6][1] and clean[90] is None


def test_pii_terms_at_any_distance(spark, empty):
    """A disclosing term goes wherever it stands: near the entity, far off, and in texts without the entity."""
    far = " ".join(f"of the filler{k}" for k in range(40))
    texts = [f"mail ann@example.org now {far} quixley said on day{i}" for i in range(4)] + ["quixley without an address"]
    texts += [f"common words {far} number {i}" for i in range(80)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert not any("quixley" in clean[i] for i in range(5)) and "filler39" in clean[0] and all(clean[i] == texts[i] for i in range(5, 85))
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert "quixley" in {texts[0][t["start"] : t["end"]] for t in got[0].terms} and [(t["start"], t["end"]) for t in got[4].terms] == [(0, 7)]


def test_pii_long_digits_and_letters(spark, empty):
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.base_spans("1" + "0" * 5000 + ".1.1.1") == []
    texts = [f"İpek ΟΔΟΣ writes to ann@example.org row{i}" for i in range(3)] + [f"plain words number {i}" for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert {"İpek", "ΟΔΟΣ", "writes", "to"} == {texts[0][t["start"] : t["end"]] for t in got[0].terms} and got[5].terms is None
    assert not any(w in r.text for r in pii.sanitize(df).where("doc_id < 3").collect() for w in ("İpek", "ΟΔΟΣ"))


@pytest.mark.parametrize("bound", [None, 0])
def test_pii_terms_against_brute_force(spark, docs, corpus, monkeypatch, bound):
    """All disclosing terms of the corpus with planted entities, by a dictionary and by a join."""
    if bound is not None:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    rows = [(i, None if t is None else f"{t} mail a{i % 9}@b.org" if i % 3 == 0 else t) for i, t in corpus]
    rows += [(1000 + i, t) for i, t in rows[:20]]  # copies count once
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    held, n_term, n_entity, n_pair, seen = {}, Counter(), Counter(), Counter(), set()
    for i, t in rows:
        base = plain_spans(t or "")
        entities = {f"{k}:{t[a:b].lower()}" if k in ("email", "ip") else f"{k}:{re.sub('[^0-9]', '', t[a:b])}" for k, a, b in base}
        held[i] = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", t or "") if not any(a < m.end() and m.start() < b for _, a, b in base)]
        words = {w for w, _, _ in held[i]}
        if (t or "") in seen:
            continue
        seen.add(t or "")
        n_term.update(words)
        n_entity.update(entities)
        n_pair.update((e, w) for e in entities for w in words)
    told = defaultdict(float)
    for (e, w), n in n_pair.items():
        if n >= pii.SUPPORT and n_term[w] <= n * 2**pii.MOST_BITS and n_entity[e] < len(seen):
            told[w] = max(told[w], np.log(len(seen) * n / (n_entity[e] * n_term[w])) / np.log(len(seen) / n_entity[e]))
    want = {i: [(a, b, bool(told[w] >= pii.REMOVE)) for w, a, b in held[i] if told.get(w, 0) >= pii.GENERALISE] for i, _ in rows}
    got = {r.doc_id: [(t["start"], t["end"], t["remove"]) for t in r.terms or []] for r in pii.spans(df).collect()}
    assert got == want and any(want.values())
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    for i, t in rows:
        assert clean[i] == pii.masked(t, [{"start": a, "end": b, "remove": r} for a, b, r in want[i]])


def test_pii_copies_disclose_nothing(spark, empty):
    """Two copies of a text aren't two documents that agree; two unlike texts are. Short names count like long ones."""
    plain = [(100 + i, f"plain words number {i} of many", "en", "s", 1) for i in range(60)]
    copies = [(i, "Li Bo writes ann@example.org tonight", "en", "s", 1) for i in range(4)]
    assert pii.disclosing(spark.createDataFrame(copies + plain, empty.schema)).count() == 0
    unlike = [(i, f"Li Bo writes ann@example.org tonight{i}", "en", "s", 1) for i in range(4)]
    got = pii.disclosing(spark.createDataFrame(unlike + copies + plain, empty.schema)).collect()
    assert {r.term for r in got} == {"li", "bo", "writes"} and {r.entity for r in got} == {"email:ann@example.org"}


def test_pii_of_many_entities_and_words(spark, empty):
    """3,000 addresses and 6,000 words that stand together twice are one pair of classes, not 18 million pairs."""
    text = " ".join(f"a{i}@example.org" for i in range(3000)) + " " + " ".join(f"word{i}" for i in range(6000))
    df = spark.createDataFrame([(0, text, "en", "s", 1), (1, text + " end", "en", "s", 1)] + [(i, f"plain {i}", "en", "s", 1) for i in range(2, 80)], empty.schema)
    got = {r.doc_id: len(r.terms or []) for r in pii.spans(df).collect()}
    assert got[0] == got[1] == 6000 and not any(got[i] for i in range(2, 80))


def test_suffix_dedup_of_one_anchor(spark, empty):
    """600 unlike contexts of one passage, just below and above the length of a repeated string."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    short, long = letters(390), letters(430)
    texts = [letters(300) + (short if i % 2 else long) + letters(300) for i in range(1200)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.dedup(df).collect()}
    counts = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    for i, t in enumerate(texts):
        gone = {q for p in range(len(t) - 399) if counts[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert got[i] == (len(gone), int(bool(gone))) and len(gone) == (0 if i % 2 else len(gone)) and (i % 2 or len(gone) >= 430)


def test_suffix_dedup(spark, docs, corpus):
    counts, data = Counter(), {i: (t or "").encode() for i, t in corpus}
    for b in data.values():
        counts.update(b[p : p + 400] for p in range(len(b) - 399))
    for group in (256, 1):  # by sorting, and by counting window hashes
        substring_dedup.GROUP, before = group, substring_dedup.GROUP
        got = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
        substring_dedup.GROUP = before
        for i, b in data.items():
            gone = bytearray(len(b))
            for p in range(len(b) - 399):
                if counts[b[p : p + 400]] > 1:
                    gone[p : p + 400] = b"\1" * 400
            kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
            assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
            assert got[i].n_spans == len(re.findall(b"\1+", bytes(gone)))


def test_suffix_dedup_of_one_common_string(spark, empty, monkeypatch):
    """A word repeated through 40 texts is one context with most of the rows: no task has them all, and the results stay."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = letters(500)
    texts = [letters(200) + "Anan " * rng.randint(150, 250) + letters(200) for _ in range(40)] + [letters(100) + passage + letters(100) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema).repartition(4, "doc_id")
    shares, write = [], substring_dedup.materialize

    def watched(table, name):
        if name == "dedup-shared":
            shares.append([r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()])
        return write(table, name)

    monkeypatch.setattr(substring_dedup, "materialize", watched)
    monkeypatch.setattr(substring_dedup, "HOT", 20, raising=False)
    monkeypatch.setattr(substring_dedup, "GROUP", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of size are joined
    try:
        got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    for i, t in enumerate(texts):
        gone = {q for p in range(len(t) - 399) if counts[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert got[i].n_removed == len(gone)
        assert got[i].kept_sha256 == hashlib.sha256("".join(c for q, c in enumerate(t) if q not in gone).encode()).hexdigest()
    assert max(shares[0]) < 0.6 * sum(shares[0])


def test_suffix_sort_is_a_sort():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 40))) for _ in range(40)]
    at = [rng.randint(0, 4) for _ in texts]
    order, near = substring_dedup.sort_suffixes(texts, [substring_dedup.Hashes(t) for t in texts], at)
    suffix = [texts[k][at[k] :] for k in order]
    assert suffix == sorted(suffix)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert near == [common(a, b) for a, b in zip(suffix, suffix[1:], strict=False)]


def test_pieces_best_score_and_round_trip(spark, docs, corpus):
    v = pieces.Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))

    def best(unit):
        score = [0.0] + [-1e300] * len(unit)
        for end in range(1, len(unit) + 1):
            options = [score[b] + v.pieces[unit[b:end]][1] for b in range(max(0, end - 16), end) if unit[b:end] in v.pieces]
            score[end] = max(options, default=score[end - 1] + pieces.BYTE_SCORE * len(unit[end - 1].encode()))
        return score[-1]

    scores = {i: s for i, s in v.pieces.values()}
    todo = sorted({"▁" + w for _, t in corpus if t for w in t.split()[:40]} | {"▁Größe", "▁naïve日本", "▁▁▁x", "▁"})
    for unit, ids in zip(todo, pieces.search(v, todo), strict=True):
        got = sum(scores.get(i, pieces.BYTE_SCORE) for i in ids)
        assert got == pytest.approx(best(unit)) and b"".join(v.text_of[i] for i in ids).decode() == unit.replace("▁", " ")
    for text in ("", " ", "  a  b ", "a\nb\t▁c", "日本 é́ \U0001f600", "x" * 5000):
        if "▁" not in text:  # the mark itself reads as a space
            assert v.decode(pieces.encode_all(v, [text])[0]) == text
    got = {r.doc_id: r for r in pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert all(r.round_trip for r in got.values()) and got[0].ids == [] and len(got) == len(corpus)


def test_pieces_against_the_library():
    """Of words in use nearly all are cut as the merging encoder does; ids are within a hundredth of its number."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model, v = SentencePieceProcessor(model_file=path), pieces.Vocabulary.load(path)
    text = "The search goes down the tree and keeps the scores of what the words have in common, so that no prefix is looked at twice. Some of these pieces are short and others are whole words of the language."
    ours, theirs = pieces.encode_all(v, [text])[0], model.encode(text)
    assert len(ours) <= 1.01 * len(theirs) and sum(a in theirs for a in ours) > 0.9 * len(ours)
    long = " ".join(f"word{i}" for i in range(60_000))
    assert v.decode(pieces.encode_all(v, [long])[0]) == long


PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu {i}</a></ul></nav><div class="ad">buy {i}</div>
<article><h1>Title {i}</h1><p><b>First   {i}&amp;co.<br><p>second {i} &lt;x&gt;</p></article><div id="comments"><p>reader {i}</p></div><footer>&copy; site</footer>"""


def test_html_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(12)] + [(20, None, None), (21, "http://b.example", ""), (22, "http://b.example", "<p>only <i>text"), (23, "x", "<!-- open"), (24, "http://a.example/1", "plain & simple")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[3] == "Title 3\n\nFirst 3&co.\n\nsecond 3 <x>" and len(got) == len(rows)
    assert got[20] == got[21] == got[23] == "" and "only text" in got[22] and got[24] == "plain & simple"
    template = html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).where("host = 'a.example'").first()
    tokens = [r["token"] for r in template["rows"]]
    assert any(t.endswith("/article") for t in tokens) and not any("menu 3" in t for t in tokens)
    assert html.unescape("&copy;") == "©" and html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BARE = """<html><body class="has-sidebar"><div class=a1><a href=/x{i}>go {i}</a> <a href=/y>more</a></div><div class=b2><p>Story {i} runs on with words of its own {i}{i} and more of them, as stories do.<p>Terms apply.<p>{far}</div><div class=c3><p>All rights kept by the house that prints this page, whatever it says above.</div></body></html>"""


def test_html_slots_of_the_template(spark):
    """Pages without telling names: what is main is read from the host's template; an empty template gives the whole page."""
    rows = [(i, f"//h/{i}", BARE.format(i=i, far=f"And so it went on, day {i}.")) for i in range(9)]
    rows += [(9, "//h/9", rows[0][2])] * 3  # equal pages count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    want = lambda i: f"Story {i} runs on with words of its own {i}{i} and more of them, as stories do.\n\nAnd so it went on, day {i}."
    assert all(r.by_template for r in got.values()) and all(got[i].text == want(i) for i in range(9)) and got[9].text == want(0)
    whole, by = html_text.main_text(rows[1][2], None)
    assert not by and "go 1" in whole and "All rights" in whole and "Terms apply." in whole
    # The classes, counted plainly.
    unlike = {h for _, _, h in rows}
    vectors = defaultdict(dict)
    for h in unlike:
        for token, x in html_text.tokens(h).items():
            vectors[token][h] = x[0]
    classes = defaultdict(set)
    for token, v in vectors.items():
        if 2 * len(v) >= len(unlike):
            classes[frozenset(v.items())].add(token)
    found = {r["token"] for r in html_text.templates(df).first()["rows"]}
    assert found == set().union(*(c for c in classes.values() if len(c) > 1))


def test_html_deep_and_open_markup():
    """Items without end tags, deep nesting, long pages, and labels on elements that enclose the main text."""
    rows = "".join(f"<tr><td>cell {i}<td>x" for i in range(300))
    text, _ = html_text.main_text(f"<body class='no-sidebar'><article class='category-social'><table>{rows}</table><dl>" + "<dt>t<dd>d" * 100 + "</dl></article>", None)
    assert text.count("cell") == 300 and text.count("d") == 100 and text.split("\n\n")[:3] == ["cell 0", "x", "cell 1"]
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert html_text.main_text(f"<main class=search>{deep}<p>" + "word " * 200_000 + "</main>", None)[0].startswith("core\n\nword word")
    assert html_text.main_text("<div class='sidebar'><article>teaser</article></div><article>real</article>", None)[0] == "real"


def test_huffman_round_trip_and_lengths():
    rng = np.random.default_rng(3)
    for counts in ({5: 3}, {1: 1, 2: 1}, {i: 2**i for i in range(40)}, {int(i): int(n) for i, n in enumerate(rng.integers(1, 10_000, 3000))}):
        lengths = tokenfile.code_lengths(counts)
        assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) <= 1
        book = tokenfile.Codebook(lengths)
        texts = [rng.choice(list(counts), size=n) for n in (0, 1, 511, 512, 513, 3000)]
        back = book.unpack(book.pack([t.astype(np.int64) for t in texts]))
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(texts, back, strict=True))
    # Without the limit in the way the lengths are Huffman's.
    import heapq

    counts = {i: int(n) for i, n in enumerate(rng.integers(1, 500, 200))}
    heap = [(n, i, 0) for i, n in counts.items()]
    heapq.heapify(heap)
    cost, k = 0, 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1, 0))
    assert sum(counts[i] * n for i, n in tokenfile.code_lengths(counts).items()) == cost


def test_token_file(spark, docs, corpus, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["Aé'S don't 12²3 ½x İŞ ß ǅ ﬁ \x1c a\x85b c <|endoftext|> x<|startoftext|>y日本 é ́a ΣΑΣ ς ­ q"]
    df = docs.union(spark.createDataFrame([(1000, odd[0], "en", "s", 1)], docs.schema))
    lengths, files = tokenfile.write(df, path)
    got = sorted(tokenfile.read(files, lengths, with_ids=True).collect())
    at = 0
    for r, (i, text) in zip(got, [*corpus, (1000, odd[0])], strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.d_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfile.read(*reversed(tokenfile.write(empty, path))).count() == 0


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def test_decontamination(spark, corpus, docs):
    rng = random.Random(4)
    long = dict(corpus)[len(corpus) - 1].split()
    items = [(0, " ".join(dict(corpus)[10].split()[3:14])), (1, " ".join(long[2000:2030])), (2, "never seen words in any of the texts"), (3, "one two three"), (4, None), (5, " ")]
    items += [(6 + k, " ".join(rng.sample(long, 12))) for k in range(3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d, q = shingle_sets(corpus, 5), shingle_sets(items, 5)
    want = {(i, j) for i in d for j in q if q[j] and len(d[i] & q[j]) >= 0.8 * len(q[j])}
    got = decontaminate.report(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i in d if i not in {a for a, _ in want}}


def test_decontamination_short_items(spark, corpus, docs):
    """Items of one to nine shingles in a long text are all found, and items without an id."""
    last, text = corpus[-1]
    w = text.split()
    items = [(k, " ".join(w[50 * k : 50 * k + 5 + k % 9])) for k in range(90)]
    bench = spark.createDataFrame([*items, (None, " ".join(w[4600:4640])), (None, " ".join(w[4700:4706]))], "item_id long, text string")
    got = [(r.item_id, r.n_item_shingles) for r in decontaminate.report(docs, bench).where(F.col("doc_id") == last).collect()]
    assert {i for i, _ in got} == {None, *range(90)} and sorted(n for i, n in got if i is None) == [2, 36] and len(got) == 92
    assert last not in {r.doc_id for r in decontaminate.clean(docs, bench.where("item_id is null")).collect()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, corpus, n, percent):
    sets = shingle_sets(corpus, n)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            x = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    rows, _ = jaccard_join.join(docs, n, percent)
    got = {r.d: (r.n_shingles, r.component_id) for r in rows.collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in sets}
    assert {r.doc_id for r in jaccard_join.one_of_each(docs, n, percent).collect()} == {i for i in sets if top(i) == i}


def test_jaccard_rows_without_id(spark, corpus, docs, empty):
    """Rows without an id, whatever the order of their keys, change no component of the others; repeated rows stay once."""
    rng, rows, i = random.Random(12), [], 0
    for _ in range(12):
        w = [f"v{rng.randint(0, 5000)}" for _ in range(100)]
        near = [" ".join([*w[:k], f"new{rng.random()}", *w[k + 1 :]]) for k in (0, 99, 50, 20, 70, 98, 1, 97)]
        rows += [(i, near[0]), (i + 1, near[1])] + [(None, t) for t in near[2:]] + [(None, near[0])]
        i += 2
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], empty.schema)
    got = {r.d: r.component_id for r in jaccard_join.join(df)[0].where("d is not null").collect()}
    assert got == {r.d: r.component_id for r in jaccard_join.join(df.where("doc_id is not null"))[0].collect()} == {k: k - k % 2 for k in range(24)}
    twice = df.where("doc_id < 4").union(df.where("doc_id < 4")).union(docs.where("doc_id = 0").withColumn("doc_id", F.lit(99).cast("long")))
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(twice).collect()) == [0, 2, 99]


def test_jaccard_groups_make_few_pairs(spark, empty, monkeypatch):
    """500 near copies of a text, and 300 unlike texts around one passage: comparisons follow the number of texts, all links are found."""
    rng = random.Random(15)
    base, passage = words_of(rng, 120, 9000).split(), words_of(rng, 60, 9000)
    texts = []
    for i in range(500):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(1, 3)):
            w[k] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    texts += [f"{words_of(rng, 20, 9000)} {passage} {words_of(rng, 20, 9000)}" for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    asked = []

    def counted(pairs, sets, percent, filtered=jaccard_join._may_be_similar):
        asked.append(pairs.count())
        return filtered(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_may_be_similar", counted)
    got = {r.d: r.component_id for r in jaccard_join.join(df)[0].collect()}
    assert sum(asked) < 5 * len(texts)
    sets, parent = shingle_sets(enumerate(texts), 4), list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    assert got == {i: top(i) for i in range(len(texts))} and sum(c == 0 for c in got.values()) > 300


def test_jaccard_all_pairs(spark, docs, corpus):
    """pairs() gives every link between unlike texts, and how many each row has."""
    sets = shingle_sets(corpus, 4)
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(frozenset(s), i)
    linked = {(a, b) for s, a in first.items() for r, b in first.items() if a < b and 100 * len(s & r) >= 85 * len(s | r)}
    members, links = jaccard_join.pairs(docs)
    assert {(r.a, r.b) for r in links.collect()} == linked and linked
    got = {r.d: (r.rep, r.n_links) for r in members.collect()}
    assert got == {i: (first[frozenset(s)], sum(first[frozenset(s)] in x for x in linked)) for i, s in sets.items() if s}


def test_jaccard_signatures_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(len(a) * rng.random() * 0.16)
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, size // 12)))).astype(np.uint64))))
        x = len(np.intersect1d(a, b))
        if len(b) and 100 * x >= 85 * (len(a) + len(b) - x):
            assert len(np.intersect1d(jaccard_join.signatures(a, 85), jaccard_join.signatures(b, 85)))


def toxic_docs(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(10, 60))]
        for _ in range(3 * bad):
            w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "zorgle", "zorglest"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(n, None, "en", "s", None), (n + 1, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, empty):
    docs, labels = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("zorg") for s in model.features.lexicon)
    rows = toxicity.score(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95 and len(rows) == 602
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 602
    raw, y = np.sort(np.random.default_rng(7).normal(size=50)), np.random.default_rng(8).integers(0, 2, 50)
    assert (np.diff(toxicity.Isotonic.fit(raw, y)(raw)) >= -1e-12).all()


def test_sharding_is_minimax(spark, docs, corpus, empty):
    for bound in (sharding.LAST_GROUPS, 3):  # all on the driver, and by look-ups
        sharding.LAST_GROUPS, before = bound, sharding.LAST_GROUPS
        got = sharding.shard(docs, 5).collect()
        sharding.LAST_GROUPS = before
        sizes = defaultdict(int)
        for _, t in corpus:
            sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
        ordered = [sizes[k] for k in sorted(sizes)]

        def runs(capacity, ordered=ordered):
            n, held = 1, 0
            for s in ordered:
                n, held = (n, held + s) if held + s <= capacity else (n + 1, s)
            return n

        best = next(c for c in range(max(ordered), sum(ordered) + 1) if runs(c) <= 5)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert max(sum(r.size for r in v) for v in by.values()) == best and len(got) == len(corpus)
        for v in by.values():
            assert sorted(r.slot for r in v) == list(range(len(v)))
        texts = dict(corpus)
        assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
        assert len({(texts[r.doc_id] or "", r.shard) for r in got}) == len({texts[r.doc_id] or "" for r in got})
    assert sharding.shard(empty).count() == 0


def test_quality_rules(spark, empty):
    rng = random.Random(9)
    good = ["\n".join(" ".join(f"word{rng.randint(0, 900)}" for _ in range(12)) + "." for _ in range(6)) for _ in range(60)]
    junk = ["\n".join(" | ".join(f"X{rng.randint(0, 900)}$$$" for _ in range(9)) for _ in range(6)) for _ in range(60)]
    texts = [*good, *junk, None, "", "too few words", "a b c d e " * 20]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    field = quality.fit_field(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    assert all(got[i].kept == (i < 60) for i in range(120)) and all(got[i].base_failed for i in range(120, 124))
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(hit), sum(map(len, w)))
    assert {r.doc_id for r in quality.keep(docs, field).collect()} == set(range(60))
    assert all(r.content for r in quality.line_labels(docs.limit(3), field).collect())
    assert quality.judge(docs, None).where("kept").count() == 120 and quality.judge(empty, field).count() == 0


def test_quality_lines_of_mixed_documents(spark, empty):
    """Line states are learnt from document labels: a text of both kinds gets both, and its share decides."""
    rng = random.Random(14)
    good = lambda: " ".join(f"word{rng.randint(0, 900)}" for _ in range(12)) + "."
    junk = lambda: " | ".join(f"X{rng.randint(0, 900)}$$$" for _ in range(9))
    texts, labels = [], []
    for i in range(200):
        n = rng.randint(1, 3)
        kinds = [i % 2] * 6 + [1 - i % 2] * n
        rng.shuffle(kinds)
        texts.append("\n".join(good() if k else junk() for k in kinds))
        labels.append((i, i % 2, 0))
    texts += ["\n".join([good(), good(), junk(), junk(), good(), good()]), "\n".join([junk(), junk(), junk(), good()]), "a # b\n\na # b\n \na | b\na # b" + " w$" * 9, "word. " * 150_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], empty.schema)
    field = quality.fit_field(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lines = defaultdict(list)
    for r in quality.line_labels(docs.where("doc_id in (200, 201)"), field).collect():
        lines[r.doc_id].append((r.line, r.content))
    assert [c for _, c in sorted(lines[200])] == [True, True, False, False, True, True] and [c for _, c in sorted(lines[201])] == [False, False, False, True]
    got = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    assert got[200].kept and not got[201].kept and all(got[i].kept == bool(i % 2) for i in range(200))
    assert sum(0.05 < got[i].content_share < 0.95 for i in range(200)) > 150
    assert (got[202].n_symbols, got[202].n_dup_lines) == (texts[202].count("#") + texts[202].count("|") + 9, 1) and got[203].base_failed
    for i, t in enumerate(texts):
        words = [WORD.findall(x) for x in t.split("\n")]
        held = [x for x, w in zip(t.split("\n"), words, strict=True) if w]
        assert got[i].n_dup_lines == len(held) - len(set(held)) and got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", t))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(10)
    field = quality.LineField(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
    for n in range(1, 9):
        x = rng.normal(size=(n, len(quality.FEATURES)))

        def value(path, x=x, n=n):
            return sum(x[t] @ field.weights for t in range(n) if path[t]) + sum(field.moves[path[t - 1], path[t]] for t in range(1, n))

        paths = [[b >> t & 1 for t in range(n)] for b in range(1 << n)]
        assert value(field.decode(x).tolist()) == pytest.approx(max(map(value, paths)))


def test_odd_columns_and_rows(spark, odd, empty):
    """Rows without an id, extra columns of clashing names and empty tables pass through each operator."""
    n = odd.count()
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    piece, word = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
    assert pii.spans(odd).count() == n and pii.sanitize(odd).columns == odd.columns and pii.sanitize(odd).count() == n
    assert substring_dedup.dedup(odd).count() == n and substring_dedup.dedup(empty).count() == 0
    assert pieces.encode(odd, piece).count() == n and pieces.encode(empty, piece).count() == 0
    assert tokenfile.read(*reversed(tokenfile.write(odd, word))).count() == n
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.report(empty, bench).count() == 0
    assert jaccard_join.join(odd)[0].count() == n and jaccard_join.one_of_each(odd).columns == odd.columns and jaccard_join.join(empty)[0].count() == 0
    assert sharding.shard(odd).count() == n and quality.judge(odd, None).count() == n and quality.keep(odd, None).columns == odd.columns
    assert pii.spans(empty).count() == 0


def test_odd_pages_scores_and_shards(spark, odd, docs, empty):
    """Null ids, clashing columns, repeated rows and empty tables in the operators that test_odd_columns_and_rows leaves out."""
    n = odd.count()
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(5)] + [(None, "http://a.example/x", PAGE.format(i=9)), (7, None, None)] * 2, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "key", "token", "rows", "text", "p_id", "p_html", "by_template")})
    got = html_text.extract(pages).collect()
    assert len(got) == 9 and sorted(r.text for r in got if r.page_id is None) == [got[0].text.replace(got[0].text[6], "9")] * 2
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels = labels.withColumns({c: F.lit("x") for c in ("text", "label", "l_id")})
    model, field = toxicity.fit(odd, labels), quality.fit_field(odd, labels)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert quality.judge(odd, field).count() == n and quality.keep(odd, field).columns == odd.columns
    placed = sharding.shard(odd, 3).collect()
    assert len(placed) == n and all(r.size >= 1 and 0 <= r.shard < 3 for r in placed)
    assert html_text.extract(pages.limit(0)).count() == 0 and toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<b><i><li>", "<ul><li><b>", "<p><b>", "<b></i>", "<a \"'", "<a '\"<b \"'", "<!--", "<script ", '<b class="' + "x" * 5000 + '">'])
def test_html_of_two_megabytes_of_broken_markup(unit):
    """Time in proportion to the page, whatever is left open."""
    import time

    page, began = unit * (2_000_000 // len(unit)), time.process_time()
    html_text.tokens(page)
    html_text.main_text(page, None)
    assert time.process_time() - began < 40


def test_html_template_text_is_left_out_whatever_its_raw_length(spark):
    """A line that all pages share goes, padded with white space and references or not; without the template it stays."""
    line = "Call us on weekdays" + " &#32;" * 80 + " from nine to five"
    page = lambda k: f"<html><body><div class=x><div class=y><p>{'words of the article number ' + str(k) + ' and more of it ' * 20}</p><div class=z>{line}</div></div><div class=q>Other {k} text</div></div></body></html>"
    df = spark.createDataFrame([(k, "http://h.example/x", page(k)) for k in range(6)], "page_id long, url string, html string")
    rows = html_text.extract(df).collect()
    assert all(r.by_template and "article number" in r.text and "weekdays" not in r.text for r in rows)
    assert "weekdays" in html_text.main_text(page(1), None)[0]
