"""PII: information-theoretic sanitisation.

Protected entities are the email addresses, IP addresses, payment cards and
phone numbers that patterns find. Terms that stand with an entity may give it
away even where it is masked. With N documents, df(e) that hold entity e, df(t)
that hold term t and n(e, t) that hold both, at any distance,

    pmi(e; t) = log(N n(e, t) / (df(e) df(t)))    and    ic(e) = log(N / df(e)),

and pmi / ic is the share of what is to be known about e that t reveals; what
stays unknown is -log2 P(e | t) bits, with P(e | t) = n(e, t) / df(t). A share
alone grows lax with the corpus (0.7 of the 17 bits of an entity in 2 of 250,000
documents leaves 5 bits: 34 candidates), so that both are asked for. Equal texts
are one document in all counts: copies alone disclose nothing. Each
occurrence of t in any document, with or without e, is removed from a share of
REMOVE for some entity on and generalised (to the shape of the term) from
GENERALISE on, if at most MOST_BITS stay unknown. All counts cover the whole
corpus; pairs seen in fewer than SUPPORT documents have no estimate, so that only
entities of SUPPORT documents or more are paired.

Entities, terms and counts come from one tokenizer. Counts are pre-aggregated in
each task before they are shuffled, so that an entity or a term in a third of all
rows is no hot group. Entities that stand in the same documents are one class,
and so are terms that do (an order-free digest of the documents tells), so that a
document of many entities and words that also stand together elsewhere makes one
pair of classes, not all pairs of their members.

Defined results: null text is the empty text, without spans; repeated rows are
documents of their own, with equal spans; an empty table gives an empty result;
an entity in every document has nothing to reveal.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

KINDS = ("email", "ip", "card", "phone")
#: Documents in which a pair must be seen.
SUPPORT = 2
#: Disclosure thresholds, as shares of the entity's information content.
GENERALISE, REMOVE = 0.7, 0.9
#: Bits that a disclosing term leaves unknown of the entity, at most: at 1 it is right in every second document.
MOST_BITS = 1.0
#: Disclosing terms and entities up to this number (some MB) go to every task; more are joined by shuffle.
BROADCAST_TERMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# Possessive runs and the look-behind change no match; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is all that its class holds before an @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no local part reaches over an @
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", *m.span()))
    out += cards
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(c for c in value if '0' <= c <= '9')}"


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms of the text, none that overlaps a span."""
    taken = sorted((a, b) for _, a, b in spans)
    out, k, until = [], 0, 0  # `until`: the furthest end of the spans that begin before the term's end
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            until = max(until, taken[k][1])
            k += 1
        if until <= a:
            out.append((m[0].lower(), a, b))
    return out


def _distinct_terms(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The terms of _terms(), once each."""
    if spans:
        return {w for w, _, _ in _terms(text, spans)}
    return {w.lower() for w in set(_TERM.findall(text))}


def _spread(small: DataFrame, bound: int) -> DataFrame:
    """`small` with a broadcast hint, if its number of rows is within the bound."""
    return F.broadcast(small) if small.limit(bound + 1).count() <= bound else small


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _unlike(docs: DataFrame, text: str) -> DataFrame:
    """`text` of the documents, equal ones once; only texts that stand more than once are moved."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).select(text, F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    again = materialize(rows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2"), "pii-again")
    again = _spread(again, BROADCAST_TERMS)
    once = rows.join(again, ["h1", "h2"], "left_anti")
    return once.unionByName(rows.join(again, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (a hash of the text), entities and, where there are some, the words (distinct terms); a row for each of `docs`."""

    def work(ids, texts):
        entities, terms = [], []
        for t in texts:
            spans = base_spans(t or "")
            entities.append(sorted({_entity(k, t[a:b]) for k, a, b in spans}))
            terms.append(sorted(_distinct_terms(t, spans)) if spans else [])
        return ids, entities, terms

    return map_rows(docs.select(F.xxhash64(text), F.col(text)), work, "doc long, entities array<string>, words array<string>")


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, n_term: the documents that hold each term (base spans aside), counted within the tasks first."""

    def work(texts):
        counts: Counter[str] = Counter()
        for t in texts:
            if t:
                counts.update(_distinct_terms(t, base_spans(t)))
        return list(counts), list(counts.values())

    parts = map_rows(docs.select(F.col(text)), work, "term string, n long", 8192)
    return parts.groupBy("term").agg(F.sum("n").alias("n_term"))


def _classed(rows: DataFrame, member: str, keep: list[str]) -> DataFrame:
    """`member`, `keep` and class: equal for members that stand in the same documents (and have equal `keep`)."""
    digest = (F.count("*").alias("c"), F.bit_xor("doc").alias("x"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s"))
    held = rows.groupBy(member, *keep).agg(*digest)
    return held.select(member, *keep, F.xxhash64("c", "x", "s", *keep).alias("class"))


def disclosing(docs: DataFrame, text: str = "text") -> DataFrame:
    """entity, term, share: the pairs whose share of disclosure is GENERALISE or more, with at most MOST_BITS unknown, counted over unlike texts."""
    unlike = _unlike(docs, text)
    found = materialize(find(unlike, text), "pii-found")
    total = found.count()
    held = found.where(F.size("entities") > 0)
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = materialize(entities.where((F.col("n_entity") >= SUPPORT) & (F.col("n_entity") < total)), "pii-entities")
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    # n(e, t) is at most df(e), so that a term in more than 2^MOST_BITS times the documents of any entity can't pass.
    rare = materialize(term_counts(unlike, text).where(F.col("n_term").between(SUPPORT, most * 2**MOST_BITS)), "pii-rare")
    named = materialize(held.select("doc", F.explode("entities").alias("entity")).join(_spread(entities, BROADCAST_TERMS), "entity"), "pii-named")
    held = held.join(_spread(named.select("doc").distinct(), BROADCAST_TERMS), "doc", "left_semi")
    worded = materialize(held.select("doc", F.explode("words").alias("term")).join(_spread(rare, BROADCAST_TERMS), "term"), "pii-worded")
    entity_class, term_class = materialize(_classed(named, "entity", ["n_entity"]), "pii-entity-class"), materialize(_classed(worded, "term", ["n_term"]), "pii-term-class")

    left = named.join(entity_class, ["entity", "n_entity"]).select("doc", F.col("class").alias("e"), "n_entity").distinct()
    right = worded.join(term_class, ["term", "n_term"]).select("doc", F.col("class").alias("t"), "n_term").distinct()
    pairs = left.join(right, "doc").where(F.col("n_term") <= F.col("n_entity") * 2**MOST_BITS).groupBy("e", "t", "n_entity", "n_term").agg(F.count("*").alias("n_pair"))
    share = F.log(F.lit(float(total)) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    told = (F.col("n_pair") >= SUPPORT) & (F.col("n_term") <= F.col("n_pair") * 2**MOST_BITS)
    pairs = materialize(pairs.where(told).withColumn("share", share).where(F.col("share") >= GENERALISE).select("e", "t", "share"), "pii-pairs")
    return pairs.join(entity_class.select(F.col("class").alias("e"), "entity"), "e").join(term_class.select(F.col("class").alias("t"), "term"), "t").select("entity", "term", "share")


def _known(docs: DataFrame, pairs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, dict[str, bool] | None]:
    """(rows, known): whether each disclosing term is removed, as one dictionary if their number is within the bound; else as the column __op1_known of the rows."""
    worst = materialize(pairs.groupBy("term").agg((F.max("share") >= REMOVE).alias("remove")), "pii-terms")
    known = worst.limit(BROADCAST_TERMS + 1).collect()
    if len(known) <= BROADCAST_TERMS:
        return docs.withColumn("__op1_known", F.lit(None).cast("map<string,boolean>")), {r["term"]: r["remove"] for r in known}

    def work(ids, hashes, texts):
        return ids, hashes, [sorted(_distinct_terms(t, base_spans(t))) if t else [] for t in texts]

    kind = docs.schema[id_col].dataType.simpleString()
    words = map_rows(docs.select(F.col(id_col), F.xxhash64(text), F.col(text)), work, f"k_id {kind}, k_hash long, terms array<string>")
    hits = words.select("k_id", "k_hash", F.explode("terms").alias("term")).join(worst, "term")
    hits = hits.groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("term", "remove")).alias("k_terms"))  # of one document's terms
    rows = docs.join(hits, docs[id_col].eqNullSafe(hits["k_id"]) & (F.xxhash64(docs[text]) == hits["k_hash"]), "left")
    return rows.withColumn("__op1_known", F.map_from_entries("k_terms")).select(*docs.columns, "__op1_known"), None


def term_spans(text: str, spans: list[tuple[str, int, int]], known: dict[str, bool]) -> list[dict]:
    """start, end and remove of each disclosing term of a text, by start."""
    if not known or known.keys().isdisjoint(_distinct_terms(text, spans)):
        return []
    return [{"start": a, "end": b, "remove": known[w]} for w, a, b in _terms(text, spans) if w in known]


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, the base counts, base_spans and terms (of the disclosing terms; null if there are none), a row for each document."""
    rows, known = _known(docs, disclosing(docs, text), id_col, text)

    def work(ids, texts, own):
        out = []
        for i, t, k in zip(ids, texts, own, strict=True):
            base = base_spans(t or "")
            counts = [sum(s[0] == kind for s in base) for kind in KINDS] if base else [0, 0, 0, 0]
            out.append((i, *counts, _listed(base), term_spans(t or "", base, dict(k or ()) if known is None else known) or None))
        return list(zip(*out, strict=True))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, terms array<struct<start:long,end:long,remove:boolean>>"
    return map_rows(rows.select(F.col(id_col), F.col(text), F.col("__op1_known")), work, schema).withColumnRenamed("id", id_col)


def masked(text: str | None, terms: list[dict] | None) -> str | None:
    """The text with [EMAIL] and so on for base spans; removed terms go, generalised ones become their shape."""
    if text is None:
        return None
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    for t in terms or []:
        word = text[t["start"] : t["end"]]
        shape = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
        cuts.append((t["start"], t["end"], "" if t["remove"] else shape))
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a >= at:
            out += [text[at:a], new]
            at = b
        else:  # overlapping base spans: nothing of either stays
            at = max(at, b)
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they were but for the sanitised text."""
    rows, known = _known(docs, disclosing(docs, text), id_col, text)

    @F.arrow_udf("string")
    def mask(texts, own):
        import pyarrow as pa

        out = []
        for t, k in zip(texts.to_pylist(), own.to_pylist(), strict=True):
            out.append(masked(t, term_spans(t, base_spans(t), dict(k or ()) if known is None else known)) if t else t)
        return pa.array(out, pa.string())

    return rows.withColumn(text, mask(F.col(text), F.col("__op1_known"))).select(*docs.columns)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
