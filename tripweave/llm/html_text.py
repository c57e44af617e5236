"""HTML extraction by equivalence classes of tokens.

A token is a tag in its role (its name, class and nearest enclosing elements)
or a short piece of text in its role. Its occurrence vector says how often each
page of a host has it; tokens with equal vectors form an equivalence class. A
class is valid if it has two tokens or more and stands in SUPPORT of the host's
pages or more and in LEAST_PAGES. The elements of valid classes that stand once
in a page are nested, each below the nearest of them that encloses it: the
host's template. The texts between their tags are its slots.

Which slots are main text is read from what they hold over all pages of the
host. From the root the search goes down as long as one element keeps DOMINANT
of the running text (text that isn't in links), so it ends at the element whose
slots hold the article. Of its slots those go that hold the same on all pages, that are
mostly links, or whose text is a token of the template itself. What varies and
runs but isn't the article (adverts, reader comments, forms inside it) can't be
told from its statistics: names of elements and words in their labels leave
those out, below the chosen element only.

Vectors are not gathered: an order-free digest of (page, count) and the number
of pages stand for them, which Spark pre-aggregates before it shuffles, so that
a host with a third of all pages is no hot group. Pages of a host that are equal
count once. A template has at most 1 / SUPPORT times the tokens of a page.

Defined results: null html is the empty page, with the empty text; pages without
an url share the host ""; repeated pages are extracted alike; an empty table
gives an empty result; broken markup never fails (an open comment or script
reaches to the end). A page whose host has no template (fewer than LEAST_PAGES
unlike pages) or that lacks the template's main element uses its own article or
main element, else all its text without what names and labels leave out;
by_template is false there.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SUPPORT = 0.5
#: Pages in which a class must stand at least: fewer show no template.
LEAST_PAGES = 3
SHORT_TEXT = 60
#: Elements of the role of a token, the innermost ones.
ROLE_DEPTH = 4
#: Characters of a label up to which it stands in roles itself; a longer one stands there as a digest.
LABEL = 120
#: Share of the running text that an element must keep for the search to go down to it.
DOMINANT = 0.6
#: Pages that stand more than once up to which their keys go to every task (some dozens of bytes each); more are joined by shuffle.
BROADCAST_PAGES = 200_000
#: Hosts up to which the templates go to every task; more are joined by shuffle.
BROADCAST_HOSTS = 5_000

#: Elements whose content is no markup, up to their end tag.
_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe)\b", re.I)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "svg", "iframe")}
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_EVENT = re.compile("[>\"']")
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("head title nav header footer aside form button select option textarea input label menu dialog iframe noscript object".split())
MAIN = ("article", "main")
#: Words in a class, id or role that mark what isn't main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies disqus respond search form pagination pager".split()
)
_PARTS = re.compile(r"[A-Za-z]+")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


#: Elements whose labels say what a page is, not what a part of it is.
WHOLE = frozenset(("html", "body", "article", "main"))
#: A new element of these ends the open ones of the second, up to the nearest of the third.
IMPLIED = {
    "p": (("p",), BLOCK - {"p"}), "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr", "td", "th"), frozenset(("table", "tbody", "thead", "tfoot"))), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
    "option": (("option",), frozenset(("select", "optgroup"))),
}


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, text of the attributes) of each piece of markup; comments, declarations and raw elements have no name.

    In time proportional to the page, whatever it holds. A tag ends at the next
    `>` outside of quotes. Where a scan for it fails, the opening quotes that it
    went through are remembered: a later scan that comes to one of them would go
    the same way."""
    last, failed, first_event, searched = page.rfind(">"), set(), -1, 0
    nothing = len(page)

    def tag_end(p: int) -> int:
        nonlocal first_event, searched
        if first_event < p or p < searched:  # else the event found last is the next one still
            m = _EVENT.search(page, p)
            first_event, searched = (m.start() if m else nothing), p
        path, e = [], first_event
        while e < nothing and page[e] != ">" and e not in failed:
            path.append(e)
            closing = page.find(page[e], e + 1)
            m = _EVENT.search(page, closing + 1) if closing >= 0 else None
            e = m.start() if m else nothing
        if e < nothing and page[e] == ">":
            return e
        failed.update(path)
        return -1

    at = page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = nothing if end < 0 else end + 3
            yield at, end, "", False, ""
        elif at < last:
            if page[at + 1] in "!?":
                end = page.find(">", at + 2) + 1
                yield at, end, "", False, ""
            elif m := _RAW.match(page, at):
                m = _RAW_END[m.group(1).lower()].search(page, page.find(">", m.end()) + 1)
                end = m.end() if m else nothing
                yield at, end, "", False, ""
            elif m := _NAME.match(page, at):
                end = tag_end(m.end()) + 1 or -1
                if end > 0:
                    yield at, end, m.group(2).lower(), m.group(1) != "", page[m.end() : end - 1]
        at = page.find("<", at + 1 if end < 0 else end)


class _Page:
    """The elements of a page in order (element 0 encloses all) and its pieces of text, each with its block and element."""

    __slots__ = ("names", "roles", "parents", "out", "texts")

    def __init__(self, page: str):
        self.names, self.roles, self.parents, self.out = [""], [""], [-1], [False]
        self.texts: list[tuple[int, str, int]] = []
        stack, block, at = [0], 0, 0
        open_: dict[str, list[int]] = {}  # the places in the stack of the open elements of each name

        def cut(k: int) -> None:
            """End the open elements from place k on."""
            while len(stack) > k:
                name = self.names[stack.pop()]
                open_[name].pop()
                if not open_[name]:
                    del open_[name]

        for start, end, name, closes, rest in markup(page):
            if start > at:
                self.texts.append((block, page[at:start], stack[-1]))
            at = end
            if not name:
                continue  # comment, script, declaration
            if name == "br":
                self.texts.append((block, " ", stack[-1]))
                continue
            block += name in BLOCK
            if closes:
                if name in open_:
                    cut(open_[name][-1])
                continue
            if name in IMPLIED:
                ends, until = IMPLIED[name]
                if any(e in open_ for e in ends):
                    limit = max((open_[u][-1] for u in (until if len(until) < len(open_) else open_) if u in until and u in open_), default=0)
                    over = [p[bisect_right(p, limit)] for e in ends if (p := open_.get(e)) and p[-1] > limit]
                    if over:
                        cut(min(over))
            label = " ".join(x for g in _LABEL.findall(rest) for x in g if x) if rest else ""
            marked = label != "" and name not in WHOLE and not MARKS.isdisjoint(w.lower() for w in _PARTS.findall(label))
            parent = stack[-1]
            role = "/".join([*filter(None, self.roles[parent].split("/")[1 - ROLE_DEPTH :]), f"{name}.{label if len(label) <= LABEL else _digest(label)}" if label else name])
            self.names.append(name)
            self.roles.append(role)
            self.parents.append(parent)
            self.out.append(name in LEFT_OUT or marked)
            if name not in VOID and not rest.endswith("/"):
                open_.setdefault(name, []).append(len(stack))
                stack.append(len(self.names) - 1)
        if at < len(page):
            self.texts.append((block, page[at:], stack[-1]))


def _clean(text: str) -> str:
    return " ".join((_html.unescape(text) if "&" in text else text).split())


def tokens(page: str | None) -> dict[str, tuple[int, int, int, str, int]]:
    """Token -> (occurrences in the page, characters of running text and of links below it, the element once in the page that encloses it, hash of all text below)."""
    walk = _Page(page or "")
    n = len(walk.names)
    counts = Counter(walk.roles[1:])
    running, links, inside = [0] * n, [0] * n, [""] * n
    held: list[list[str]] = [[] for _ in range(n)]
    linked, hidden = [False] * n, [False] * n
    for e in range(1, n):
        up = walk.parents[e]
        linked[e], hidden[e] = linked[up] or walk.names[e] == "a", hidden[up] or walk.out[e]
        inside[e] = walk.roles[up] if up and counts[walk.roles[up]] == 1 else inside[up]
    found: dict[str, tuple[int, int, int, str, int]] = {}
    for _, text, e in walk.texts:
        short = _clean(text)
        if not short:
            continue
        held[e].append(short)
        if linked[e]:
            links[e] += len(short)
        elif not hidden[e]:
            running[e] += len(short)
        if len(short) <= SHORT_TEXT:
            token = f"{walk.roles[e]}#{short}"
            found[token] = (found.get(token, (0,))[0] + 1, 0, 0, "", 0)
    for e in range(n - 1, 0, -1):  # what stands below an element stands below those around it
        up = walk.parents[e]
        running[up] += running[e]
        links[up] += links[e]
        if held[e]:
            held[up].append(_digest("\0".join(held[e])))
    for e in range(1, n):
        role = walk.roles[e]
        if counts[role] == 1:
            found[role] = (1, running[e], links[e], inside[e], zlib.crc32("\0".join(held[e]).encode("utf-8", "surrogatepass")))
        else:
            found[role] = (counts[role], 0, 0, "", 0)
    return found


def _digest(text: str) -> str:
    return f"{zlib.crc32(text.encode('utf-8', 'surrogatepass'))}:{len(text)}"


class Template:
    """What a host's valid classes say: the role of the main element, roles inside it to leave out, and texts of the template.

    rows: (token, whether it stands once a page, running text, links, enclosing token, whether it holds the same on all pages)."""

    def __init__(self, rows: list[tuple[str, bool, int, int, str, bool]]):
        self.texts = frozenset(r[0] for r in rows if "#" in r[0])
        once = {r[0]: r for r in rows if r[1] and "#" not in r[0]}
        below: dict[str, list[str]] = defaultdict(list)
        for token, row in once.items():
            below[row[4] if row[4] in once else ""].append(token)
        self.main, running = "", sum(once[t][2] for t in below[""])
        named = lambda t: t.rsplit("/", 1)[-1].split(".", 1)[0] in MAIN
        while below[self.main]:
            # Ties go to elements that are named as main text.
            best = max(below[self.main], key=lambda t: (once[t][2], named(t), t))
            if named(self.main) or not running or once[best][2] < DOMINANT * running:
                break
            self.main, running = best, once[best][2]
        self.spare = frozenset(t for t, r in once.items() if t != self.main and (r[5] or r[3] > 2 * r[2]))


def main_text(page: str | None, template: Template | None) -> tuple[str, bool]:
    """(main text of a page under its host's template, whether the template gave it)."""
    walk = _Page(page or "")
    n = len(walk.names)
    by_template = template is not None and template.main != "" and template.main in walk.roles
    if by_template:
        mains, spare, texts = {walk.roles.index(template.main)}, template.spare, template.texts
    else:
        spare, texts, hidden = frozenset(), frozenset(), [False] * n
        for e in range(1, n):
            hidden[e] = hidden[walk.parents[e]] or walk.out[e]
        own = [e for e in range(1, n) if walk.names[e] in MAIN]
        mains = set([e for e in own if not hidden[e]] or own) or {0}
    inside, out = [False] * n, [False] * n
    inside[0] = 0 in mains
    for e in range(1, n):
        up = walk.parents[e]
        inside[e] = e in mains or inside[up]
        out[e] = inside[up] and (out[up] or walk.out[e] or walk.roles[e] in spare)
    blocks: list[str] = []
    current, held = -1, []
    for block, text, e in walk.texts:
        if block != current:
            if held:
                blocks.append(" ".join("".join(held).split()))
            current, held = block, []
        if not inside[e] or out[e] or (texts and len(short := _clean(text)) <= SHORT_TEXT and f"{walk.roles[e]}#{short}" in texts):
            continue
        held.append(_html.unescape(text) if "&" in text else text)
    if held:
        blocks.append(" ".join("".join(held).split()))
    return "\n\n".join(b for b in blocks if b), by_template


def _unlike_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, key and html of the pages, equal ones of a host once; only those that stand more than once are dealt out."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("key"), F.col(html).alias("html"))
    again = materialize(rows.groupBy("host", "key").agg(F.count("*").alias("k")).where("k > 1").select("host", "key"), "html-again")
    again = F.broadcast(again) if again.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES else again
    return rows.join(again, ["host", "key"], "left_anti").union(rows.join(again, ["host", "key"], "left_semi").dropDuplicates(["host", "key"]))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and rows, the tokens of its valid classes as Template takes them."""

    def work(hosts, keys, htmls):
        out = []
        for host, key, page in zip(hosts, keys, htmls, strict=True):
            out += [(host, key, t, *x) for t, x in tokens(page).items()]
            out.append((host, key, "", 1, 0, 0, "", 0))
        return list(zip(*out, strict=True))

    found = map_rows(_unlike_pages(pages, url, html), work, "host string, key long, token string, n int, running long, links long, around string, content long")
    vectors = found.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("key", "n")).alias("digest"), F.sum(F.xxhash64("key", "n").cast("decimal(38,0)")).alias("total"),
        F.max("n").alias("most"), F.sum("running").alias("running"), F.sum("links").alias("links"), F.max("around").alias("around"),
        (F.min("content") == F.max("content")).alias("fixed"),
    )
    vectors = materialize(vectors, "html-vectors")
    sizes = materialize(vectors.where("token = '' and pages >= " + str(LEAST_PAGES)).select("host", F.col("pages").alias("host_pages")), "html-hosts")
    small = sizes.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    often = vectors.where("token != ''").join(F.broadcast(sizes) if small else sizes, "host").where(F.col("pages") >= F.greatest(SUPPORT * F.col("host_pages"), F.lit(LEAST_PAGES)))
    row = F.struct("token", (F.col("most") == 1).alias("once"), "running", "links", "around", "fixed")
    classes = often.groupBy("host", "pages", "digest", "total").agg(F.collect_list(row).alias("members")).where(F.size("members") >= 2)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("rows"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """`id_col`, `url`, text and by_template (whether the host's template gave it), a row for each page."""
    held = materialize(templates(pages, url, html), "html-templates")
    small = held.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.select(F.col(id_col).alias("p_id"), F.col(url).alias("p_url"), F.col(html).alias("p_html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(F.broadcast(held) if small else held, "host", "left").select("p_id", "p_url", "p_html", "host", F.to_json("rows").alias("rows"))

    def work(ids, urls, htmls, hosts, lists):
        known: dict[str, Template | None] = {}
        out = []
        for host, page, listed in zip(hosts, htmls, lists, strict=True):
            if host not in known:
                known[host] = Template([tuple(r.values()) for r in json.loads(listed)]) if listed else None
            out.append(main_text(page, known[host]))
        return ids, urls, [t for t, _ in out], [b for _, b in out]

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(rows, work, f"p_id {kind}, p_url string, text string, by_template boolean").withColumnsRenamed({"p_id": id_col, "p_url": url})
