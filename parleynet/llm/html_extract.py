"""Main text of web pages by nested equivalence classes of template tokens.

A page is a sequence of tokens: elements told apart by their path (a running hash of tags
and of the words of class, id and role), and texts told apart by their slot, the nearest
block element around them. Over the distinct pages of a host, tokens with the same
occurrence vector (how often they occur on each page) form a class. A class is valid if it
is ordered, its tokens coming in one cycle of the same order on every page, and nested, lying
in slots of a class that is larger or more frequent which are the same on every page; a
class that lies in several such slots is split by them, and a token that does has a role
in each. Valid classes nested in one another are the host's
template, and a slot of the template is
template itself where what it holds is: the same texts on the pages that have it, links,
or texts that come back on page after page. The other slots are open. From the root down,
the template's element that holds nine tenths of the open text is followed as long as
there is one: the open slots inside the last of them are the article.

Tags and names of elements are a prior only. What classes leave undecided (a form or
reader comments with texts of their own, a host of one page) goes by it, and a marked
article is taken as such where the classes find that most text of the open slots is in it.

An occurrence vector is never gathered: a token's pages are folded into 64 bits by
exclusive or of a hash of page and count, which adds up in any order and on any machine,
so a host with any share of the pages is no single task's work.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _text as T
from ._run import forget, saved

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup td th time tt u var wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LIMITS = frozenset("article aside body div footer header html main nav ol section table ul dl td th".split())
#: Element kinds by which the HTML standard marks what isn't the article, and the article.
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
ARTICLE_TAGS = frozenset(["article", "main"])
#: Words by which classes, ids and roles commonly name what isn't the article.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement alert announcement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent copyright disclaimer discussion disqus feedback footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Class maps and templates up to this size go to every task, so that no page moves; larger ones meet their pages by host and part.
SENT_BYTES, HOST_PARTS = 8 << 20, 64
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Prior:
    """What tags and names say before any page is compared with another."""

    def __init__(self, tags: frozenset[str] = ASIDE_TAGS, names: frozenset[str] = ASIDE_NAMES, marks: frozenset[str] = ARTICLE_TAGS):
        self.tags, self.names, self.marks = tags, names, marks
        self.headers = bool(tags)


PRIOR = Prior()
NO_PRIOR = Prior(frozenset(), frozenset(), frozenset())


@lru_cache(maxsize=1 << 16)
def _path(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode(), digest_size=8).digest(), "little", signed=True)


class Node:
    """An open element: its path and slot, whether it is shown, a link, and what the prior says of it. An element refers to nothing above it."""

    __slots__ = ("tag", "path", "up", "slot", "hidden", "aside", "article", "link", "header", "heading", "within")

    def __init__(self, tag: str, parent: Node | None, names: frozenset[str], prior: Prior, container: int | None = None):
        self.tag = tag
        self.up = parent.path if parent else 0
        self.path = _path(self.up, ".".join([tag, *sorted(names)]))
        self.slot = parent.slot if parent and tag in INLINE else self.path
        inside = parent is not None and parent.article
        known = tag not in ("html", "body", "main") and not names.isdisjoint(prior.names)
        self.article = inside or (tag in prior.marks and not known)
        # A header of the page is no text; in an article's own header its headings are.
        named = prior.headers and (tag == "header" or ("header" in names and tag not in HEADINGS))
        self.header = named or (parent is not None and parent.header and not (tag in HEADINGS and inside))
        self.hidden = (parent is not None and parent.hidden) or tag in RAW or "hidden!" in names
        self.aside = (parent is not None and parent.aside) or tag in prior.tags or known
        self.link = tag == "a" or (parent is not None and parent.link)
        self.heading = prior.headers and (tag in HEADINGS or (parent is not None and parent.heading))
        self.within = container is None or self.path == container or (parent is not None and parent.within)

    def out(self) -> bool:
        return self.hidden or self.aside or self.header


def events(page: str, prior: Prior = PRIOR, container: int | None = None) -> Iterator[tuple[str, Node, str]]:
    """('tag', element, ''), ('text', element, raw text) and ('break', element, '') in page order; elements left open are closed as the standard implies."""
    root = Node("#page", None, frozenset(), prior, container)
    stack, at = [root], 0
    while True:
        m = MARKUP.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, tag = bool(m[1] or m[4]), name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(x.tag not in INLINE for x in stack[k:]):
                        yield "break", stack[k - 1], ""
                    del stack[k:]
                    break
                if stack[k].tag in LIMITS and tag in INLINE | {"p"}:
                    break
            continue
        if (over := CLOSES.get(tag)) or tag in ENDS_PARAGRAPH:
            over = (over or frozenset()) | ({"p"} if tag in ENDS_PARAGRAPH else frozenset())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in over:
                    del stack[k:]
                    break
                if stack[k].tag in LIMITS:
                    break
        node = Node(tag, stack[-1], _names(m[3] or m[6] or ""), prior, container)
        yield "tag", node, ""
        if tag == "br" or tag in ("td", "th"):
            yield "text", stack[-1], " "
        elif tag not in INLINE:
            yield "break", node, ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    if at < len(page):
        yield "text", stack[-1], page[at:]


@lru_cache(maxsize=4096)
def _names(attributes: str) -> frozenset[str]:
    """Words of the attributes that name an element's part; `hidden!` if it isn't shown."""
    if not attributes:
        return frozenset()
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            out.add("hidden!")
        elif kind != "aria-hidden":
            out.update(x for x in re.split(r"[\s_-]+", value) if x and not x.isdigit())
    return frozenset(out)


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def text_token(slot: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot}\0{text}".encode(), digest_size=8).digest(), "big", signed=True)


ELEMENT, TEXT, PAGE = 0, 1, 2
UNMARKED, MARKED, OUT = 0, 1, 2
KEPT, LINKED, FIXED, BACK = 0, 1, 2, 3


def page_tokens(page: str, prior: Prior = PRIOR) -> dict[int, list]:
    """token: [kind, slot, times it occurs, characters, of which in links, what the prior says of the slot]; 0 is the page itself."""
    found: dict[int, list] = {0: [PAGE, 0, 1, 0, 0, 0]}
    for kind, node, raw in events(page, prior):
        if kind == "tag":
            found.setdefault(node.path, [ELEMENT, node.path, 0, 0, 0, 0])[2] += 1
        elif kind == "text" and not node.hidden and (text := squeeze(raw)):
            row = found.setdefault(text_token(node.slot, text), [TEXT, node.slot, 0, 0, 0, 0])
            row[2] += 1
            row[3] += len(text)
            row[4] += len(text) if node.link else 0
            row[5] = OUT if node.out() else MARKED if node.article else UNMARKED
    return found


def class_checks(page: str, class_of: dict[int, int], size: list[int], prior: Prior = PRIOR) -> tuple[list[tuple[int, bool, int]], dict[int, int], dict[int, int], dict[int, int]]:
    """What a page says of its host's classes.

    First (class, out of order here, its cycle's order) for each class on the page; then
    for each token the slots of the innermost open occurrences of larger classes around it,
    as one number; for each element of a class the next one around it (0: none); and the
    characters of texts in slots of no class, by the next element around them. class_of
    numbers the host's classes by token, larger and more frequent ones first, and size
    counts their tokens.
    """
    cycles: dict[int, list[int]] = {}
    inside: dict[int, set[int]] = {}
    at: dict[int, int] = {}
    slots: dict[int, set[int]] = {}
    bad: set[int] = set()
    stack: list[int] = []

    def step(token: int) -> None:
        c = class_of.get(token)
        if c is None or c in bad:
            return
        cycle, i = cycles.setdefault(c, []), at.get(c, 0)
        if i == len(cycle) < size[c] and token not in inside.setdefault(c, set()):
            cycle.append(token)
            inside[c].add(token)
        elif i >= len(cycle) or cycle[i] != token:
            bad.add(c)
            if i:
                stack.remove(c)
            return
        over = next((o for o in reversed(stack) if o < c), None)
        slots.setdefault(token, set()).add(hash((over, at[over])) if over is not None else 0)
        if i == 0:
            stack.append(c)
        at[c] = i + 1
        if i + 1 == size[c]:
            stack.remove(c)
            at[c] = 0

    near: dict[int, int] = {0: 0}
    around: dict[int, int] = {}
    loose: dict[int, int] = {}
    for kind, node, raw in events(page, prior):
        if node.path not in near:
            near[node.path] = node.path if node.path in class_of else near.get(node.up, 0)
        if kind == "tag":
            step(node.path)
            if node.path in class_of:
                around[node.path] = near.get(node.up, 0)
        elif kind == "text" and not node.hidden and (text := squeeze(raw)):
            step(text_token(node.slot, text))
            if node.slot not in class_of:
                loose[near.get(node.slot, 0)] = loose.get(near.get(node.slot, 0), 0) + len(text)
    return [(c, c in bad or at.get(c, 0) > 0, hash(tuple(cycle))) for c, cycle in cycles.items()], {t: hash(tuple(sorted(x))) for t, x in slots.items()}, around, loose


#: How far marked articles are trusted: not, where classes confirm them, or whole, whatever classes say of their parts.
DOUBTED, CONFIRMED, WHOLE = 0, 1, 2


class Template:
    """What a host's valid classes say of a page: the slots that are template, the element that holds the article (None: none does alone), and how far marked articles are it."""

    def __init__(self, slots: frozenset[int] = frozenset(), container: int | None = None, marked: int = CONFIRMED):
        self.slots, self.container, self.marked = slots, container, marked


def extract(page: str, template: Template | None = None, prior: Prior = PRIOR) -> str:
    """Blocks of the article in page order, joined by an empty line.

    With a template, the article is what its container holds (of the whole page where it
    has none: the marked articles, if it confirms them) and headings, without its slots;
    a slot inside a marked article that it confirms stays, and marked articles that are
    most of what it would take away stay whole. Without one (a host of one page) the prior
    alone decides: the marked articles, else all that isn't aside; so it does on a page of
    which the template leaves nothing, as that page is itself what the host's pages share,
    or of a layout of its own. Names of elements that would take away most of an unmarked
    page's text aren't believed there.
    """
    container = template.container if template else None
    parts: list[tuple[str, Node | None]] = [(raw, node if kind == "text" else None) for kind, node, raw in events(page, prior, container) if kind != "tag"]
    shown = [(raw, node) for raw, node in parts if node is None or not node.out()]
    marked = any(node is not None and node.article and raw.strip() for raw, node in shown)

    def kept(node: Node) -> bool:
        mine = template.marked != DOUBTED and node.article
        if marked and (template.marked == WHOLE or (container is None and template.marked == CONFIRMED)):
            return mine
        return (node.within or node.heading) and (mine or node.slot not in template.slots)

    if template is not None and (text := blocks((raw, node) for raw, node in shown if node is None or kept(node))):
        return text
    if not marked and prior.names:
        plain = [(raw, node) for kind, node, raw in events(page, Prior(prior.tags, frozenset(), prior.marks)) if kind != "tag" for node in [node if kind == "text" else None]]
        plain = [(raw, node) for raw, node in plain if node is None or not node.out()]
        size = lambda rows: sum(len(squeeze(raw)) for raw, node in rows if node is not None)
        if size(shown) * 2 < size(plain):
            shown = plain
    return blocks((raw, node) for raw, node in shown if node is None or node.article or not marked)


def blocks(parts: Iterator[tuple[str, Node | None]]) -> str:
    out: list[str] = []
    open_: list[str] = []
    for raw, node in [*parts, ("", None)]:
        if node is not None:
            open_.append(raw)
        elif open_:
            if block := squeeze("".join(open_)):
                out.append(block)
            open_ = []
    return "\n\n".join(out)


def host_of(url):
    """The url's host in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def content_digest(html):
    """Digest of what a page shows: its marked articles, or where it has none its text, without markup, scripts, styles and comments; links and session ids in attributes don't count.

    Pages of one article are copies of one another, whatever greets a visitor beside it.
    """
    marked = F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*)</\1\s*>", 2)
    html = F.when(F.length(F.trim(marked)) > 0, marked).otherwise(html)
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    return F.md5(F.trim(F.regexp_replace(bare, r"\s+", " ")).cast("binary"))


def each_with(pages: DataFrame, known: DataFrame, run: Callable[[Iterator[tuple[pa.RecordBatch, dict]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over batches of pages(host, html, ...), each with a dictionary that holds its hosts' payloads; known(host, payload binary).

    Payloads that are small together go to every task once. Beyond SENT_BYTES a host is
    dealt into HOST_PARTS parts, and each part gets its payload before its pages.
    """
    size = known.agg(F.sum(F.octet_length("payload") + F.octet_length("host"))).first()[0] or 0
    if size <= SENT_BYTES:
        sent = {r.host: bytes(r.payload) for r in known.collect()}
        return pages.mapInArrow(lambda batches: run((part, sent) for batch in batches for part in T.slices(batch, "html")), schema)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema if f.name != "host"}
    dealt = pages.withColumn("part", F.pmod(F.xxhash64("html"), F.lit(HOST_PARTS)).cast("int")).withColumn("payload", F.lit(None).cast("binary"))
    heads = known.select(*(F.col("host") if c == "host" else none[c] for c in pages.columns), F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))).alias("part"), "payload")
    rows = dealt.unionByName(heads).repartition("host", "part").sortWithinPartitions("host", "part", F.col("payload").isNull())

    columns = pages.columns
    host_at, payload_at = columns.index("host"), len(columns) + 1

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        held: dict[str, bytes] = {}
        for batch in batches:
            for part in T.slices(batch, "html"):
                hosts, payloads = part.column(host_at).to_pylist(), part.column(payload_at)
                cuts = [i for i in range(len(hosts)) if payloads[i].is_valid]
                for low, high in zip([0, *(i + 1 for i in cuts)], [*cuts, len(hosts)]):
                    if high > low:
                        yield part.slice(low, high - low).select(columns), held
                    if high < len(hosts):
                        held = {hosts[high]: payloads[high].as_py()}

    return rows.mapInArrow(lambda batches: run(met(batches)), schema)


def packed(numbers: Column) -> Column:
    """An array of 64-bit integers as bytes (big-endian)."""
    return F.unhex(F.concat_ws("", F.transform(numbers, lambda x: F.lpad(F.hex(x), 16, "0"))))


def unpacked(payload: bytes | None) -> list[int]:
    return [int(x) for x in np.frombuffer(payload or b"", dtype=">i8")]


def page_rows(pages: DataFrame, prior: Prior, held: int) -> DataFrame:
    """(host, token, kind, slot, n, vector, times, chars, linked, says) of pages(host, digest, html), summed within a task; copies of a page add nothing twice as each digest is one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, digest, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for token, (kind, slot, times, chars, linked, says) in page_tokens(page, prior).items():
                    seen = hashlib.blake2b(f"{digest}/{times}".encode(), digest_size=8).digest()
                    row = sums.setdefault((host, token), [kind, slot, 0, 0, 0, 0, 0, 0])
                    row[2] += 1
                    row[3] ^= int.from_bytes(seen, "little", signed=True)
                    row[4] += times
                    row[5] += chars
                    row[6] += linked
                    row[7] = max(row[7], says)
                if len(sums) > held:
                    yield part(sums)
                    sums = {}
        if sums:
            yield part(sums)

    names = ["host", "token", "kind", "slot", "n", "vector", "times", "chars", "linked", "says"]

    def part(sums: dict) -> pa.RecordBatch:
        columns = [[h for h, _ in sums], [t for _, t in sums], *([v[i] for v in sums.values()] for i in range(8))]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 9])], names)

    return pages.select("host", "digest", "html").mapInArrow(run, "host string, " + ", ".join(f"{c} long" for c in names[1:]))


def tokens_of(pages: DataFrame, prior: Prior = PRIOR, held: int = 200_000) -> DataFrame:
    """The page_rows of whole hosts, over their pages of distinct content."""
    distinct = pages.groupBy("host", content_digest(F.col("html")).alias("digest")).agg(F.min("html").alias("html"))
    sums = [F.sum(c).alias(c) for c in ("n", "times", "chars", "linked")]
    return page_rows(distinct, prior, held).groupBy("host", "token").agg(*(F.max(c).alias(c) for c in ("kind", "slot", "says")), F.bit_xor("vector").alias("vector"), *sums)


def classes_of(tokens: DataFrame, support_percent: int, min_class: int) -> DataFrame:
    """(host, token, kind, slot, n, times, chars, class, size): tokens of classes with enough tokens and pages (two, and support_percent of the host's).

    A host has at most 100 / support_percent times as many such tokens as an average page, whatever its number of pages.
    """
    hosts = tokens.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    kept = tokens.where(F.col("kind") != PAGE).join(hosts, "host").where((F.col("n") >= 2) & (F.col("n") * 100 >= F.col("pages") * support_percent))
    groups = kept.groupBy("host", "n", "vector").agg(F.count("*").alias("size"), F.min("token").alias("least")).where(F.col("size") >= min_class)
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("size"), "least")) - 1
    return kept.join(groups.withColumn("class", rank), ["host", "n", "vector"]).select("host", "token", "kind", "slot", "n", "times", "chars", "class", "size")


def nested(pages: DataFrame, classes: DataFrame, prior: Prior = PRIOR) -> tuple[DataFrame, DataFrame]:
    """Tokens of valid classes as (host, token, class, inside): a valid class is what of an ordered class lies in the same slots of larger ones on all pages (`inside` is their code); and (host, token, around, loose) of all classes' elements."""
    known = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "token", "size"))).alias("x"))
    known = known.select("host", packed(F.flatten(F.transform("x", lambda x: F.array(x["class"].cast("long"), x["token"], x["size"])))).alias("payload"))
    names = ["host", "class", "token", "bad", "o1", "o2", "p1", "p2", "around", "loose"]

    def run(parts: Iterator[tuple[pa.RecordBatch, dict]]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple[dict, list]] = {}
        source = None
        sums: dict[tuple[str, int], list] = {}
        trees: dict[tuple[str, int], list] = {}
        for part, payloads in parts:
            if payloads is not source:
                read, source = {}, payloads
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if host not in payloads:
                    continue
                if host not in read:
                    numbers = unpacked(payloads[host])
                    size = [0] * (max(numbers[::3]) + 1)
                    for c, n in zip(numbers[::3], numbers[2::3]):
                        size[c] = n
                    read[host] = dict(zip(numbers[1::3], numbers[::3])), size
                of = read[host][0]
                checks, slots, around, loose = class_checks(page, *read[host], prior)
                for c, bad, order in checks:
                    row = sums.setdefault((host, c), [bad, order, order])
                    row[:] = row[0] or bad, min(row[1], order), max(row[2], order)
                for token, slot in slots.items():
                    row = trees.setdefault((host, token), [of[token], slot, slot, None, 0])
                    row[1:3] = (slot, slot) if row[1] is None else (min(row[1], slot), max(row[2], slot))
                for token, over in around.items():
                    trees.setdefault((host, token), [of[token], None, None, None, 0])[3] = over
                for token, chars in loose.items():
                    trees.setdefault((host, token), [of.get(token), None, None, None, 0])[4] += chars
        rows = [(h, c, None, *v, None, None, None, 0) for (h, c), v in sums.items()] + [(h, c, t, False, None, None, p1, p2, over, chars) for (h, t), (c, p1, p2, over, chars) in trees.items()]
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "host string, class long, token long, bad boolean, o1 long, o2 long, p1 long, p2 long, around long, loose long"
    rows = each_with(pages.select("host", "html"), known, run, schema)
    rows = saved(rows.groupBy("host", "class", "token").agg(*(f(c).alias(c) for c, f in (("bad", F.max), ("o1", F.min), ("o2", F.max), ("p1", F.min), ("p2", F.max), ("around", F.max), ("loose", F.sum)))))
    ordered = rows.where("token IS NULL AND NOT bad AND o1 = o2").select("host", "class")
    single = rows.where("token IS NOT NULL")
    valid = single.where("p1 = p2").join(ordered, ["host", "class"]).select("host", "token", "class", F.col("p1").alias("inside"))
    return valid, single.select("host", "token", "around", "loose")


def container_of(nodes: list[tuple[int, int, int, bool]], share_percent: int) -> int | None:
    """The innermost element reached from the root by elements that each hold share_percent of the open text.

    nodes: (element, the next element around it, open characters of its own, whether it
    may hold an article: a valid one that each page with it has once). None if there is none.
    """
    own, inner = {}, {}
    for token, over, chars, may in nodes:
        own[token] = own.get(token, 0) + chars
        if token and token != over:
            inner.setdefault(over, []).append((token, may))
    order, held = [0], {}
    for token in order:  # parents first; an element has one parent
        order += [t for t, _ in inner.get(token, ())]
    for token in reversed(order):
        held[token] = own.get(token, 0) + sum(held[t] for t, _ in inner.get(token, ()))
    total, at, found = held[0], 0, None
    while total:
        # An element of no valid class is passed through.
        best = max(inner.get(at, ()), key=lambda t: held[t[0]], default=None)
        if best is None or held[best[0]] * 100 < total * share_percent:
            break
        at, may = best
        found = at if may else found
    return found


def template_slots(tokens: DataFrame, classes: DataFrame, valid: DataFrame, trees: DataFrame, shared_percent: int, link_percent: int, again: int, share_percent: int) -> DataFrame:
    """(host, marked, container, slots): slots of valid classes that are template, the element that holds the open text, and how far marked articles are it.

    CONFIRMED: most of the open text is in them. WHOLE: classes would take away most of
    their text as the same on other pages, so what varies beside it is no article.
    """
    texts = tokens.where(F.col("kind") == TEXT)
    slots = texts.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(F.col("chars") / F.col("times")).alias("once"), F.max("says").alias("says"))
    members = classes.join(valid.select("host", "token"), ["host", "token"])
    elements = members.where(F.col("kind") == ELEMENT).select("host", F.col("token").alias("slot"), F.col("n").alias("slot_pages"), (F.col("times") == F.col("n")).alias("single"))
    same = members.where(F.col("kind") == TEXT).join(elements, ["host", "slot"]).where(F.col("n") * 100 >= F.col("slot_pages") * shared_percent).groupBy("host", "slot").agg(F.sum("chars").alias("same"))
    x = slots.join(elements, ["host", "slot"], "left").join(same, ["host", "slot"], "left")
    fixed = F.coalesce(F.col("same") * 100 >= F.col("chars") * 90, F.lit(False))
    linked = F.col("linked") * 100 >= F.col("chars") * link_percent
    back = F.col("once") * again <= F.col("chars")
    x = x.withColumn("why", F.when(F.col("slot_pages").isNull(), KEPT).when(linked, LINKED).when(fixed, FIXED).when(back, BACK).otherwise(KEPT))
    size = lambda rule: F.sum(F.when(rule & (F.col("says") != OUT), F.col("chars")).otherwise(0))
    plain, mine = F.col("why") == KEPT, F.col("says") == MARKED
    sums = x.groupBy("host").agg(size(plain).alias("open"), size(F.col("why") == BACK).alias("returned"), size(plain & mine).alias("mine"), size(mine & F.col("why").isin(FIXED, BACK)).alias("lost"))
    # Texts that come back are template beside more text that doesn't; else they are copies of articles.
    x = x.join(sums, "host").withColumn("gone", F.when(F.col("why") == BACK, F.col("returned") <= F.col("open")).otherwise(F.col("why") != KEPT))
    open_ = ~F.col("gone") & (F.col("says") != OUT)
    confirmed = F.sum(F.when(open_ & mine, F.col("chars")).otherwise(0)) * 2 >= F.sum(F.when(open_, F.col("chars")).otherwise(0))
    marked = F.when(F.max("lost") > F.max("mine"), WHOLE).when(confirmed, CONFIRMED).otherwise(DOUBTED)
    found = x.groupBy("host").agg(marked.alias("marked"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("slot")))).alias("slots"))
    held = x.select("host", F.col("slot").alias("token"), F.when(open_, F.col("chars")).otherwise(0).alias("held"))
    single = elements.select("host", F.col("slot").alias("token"), "single")
    nodes = trees.join(held, ["host", "token"], "left").join(single, ["host", "token"], "left")
    node = F.struct("token", F.coalesce("around", F.lit(0)).alias("around"), (F.coalesce("held", F.lit(0)) + F.col("loose")).alias("chars"), F.coalesce("single", F.lit(False)).alias("may"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [container_of(sorted((n["token"], n["around"], n["chars"], n["may"]) for n in rows), share_percent) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, type=pa.int64())], ["host", "container"])

    inside = nodes.groupBy("host").agg(F.collect_list(node).alias("nodes")).mapInArrow(run, "host string, container long")
    return found.join(inside, "host")


def templates(pages: DataFrame, prior: Prior = PRIOR, support_percent: int = 1, min_class: int = 2, shared_percent: int = 80, link_percent: int = 60, again: int = 4, share_percent: int = 90) -> DataFrame:
    """(host, marked, container, slots) of each host with two pages of distinct content or more, from pages(host, html).

    A class counts from two pages, support_percent of the host's pages and min_class tokens
    on. A slot of a valid class is template if nine tenths of its text are texts that
    shared_percent of the pages with the slot have, if link_percent of it are links, or if
    its texts come back `again` times on average and such texts aren't most of the host's; the container holds share_percent of the
    open text. Hosts of one page have no template.
    """
    tokens = saved(tokens_of(pages, prior))
    classes = saved(classes_of(tokens, support_percent, min_class))
    valid, trees = nested(pages, classes, prior)
    found = saved(template_slots(tokens, classes, valid, trees, shared_percent, link_percent, again, share_percent))
    forget(tokens, classes)
    return found


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prior: Prior = PRIOR) -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    A null html is empty and gives the empty text; a null url, or one without a host, is of
    the host ''. Rows that repeat are returned as often. An empty table gives an empty
    result. Other columns are not looked at.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    known = templates(pages, prior).select("host", packed(F.concat(F.array(F.col("marked").cast("long"), F.coalesce("container", F.lit(0))), F.col("slots"))).alias("payload"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(parts: Iterator[tuple[pa.RecordBatch, dict]]) -> Iterator[pa.RecordBatch]:
        read: dict[str, Template | None] = {}
        source = None
        for rows, payloads in parts:
            if payloads is not source:
                read, source = {}, payloads
            texts = []
            for host, page in zip(rows.column(3).to_pylist(), rows.column(2).to_pylist()):
                if host not in read:
                    numbers = unpacked(payloads.get(host))
                    read[host] = Template(frozenset(numbers[2:]), numbers[1] or None, numbers[0]) if numbers else None
                texts.append(extract(page, read[host], prior))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    return each_with(pages.select("page_id", "url", "html", "host"), known, run, schema)


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
