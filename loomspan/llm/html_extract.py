"""Main text of web pages, with site templates found by counting element subtrees per host.

Pass 1 parses each page and hashes the subtree of every container element
(section, div, list, table, ...), inside and outside the article proper, with its
text; of containers outside that are mostly links also the shape, without text.
Spark counts, per host, in how many different pages a subtree occurs (copies of a
page count once); what recurs in ``MIN_PAGES`` pages is template, however many
pages the host has.  The host is part of the 64-bit hash, so that no host, however
large, is one key; the recurring hashes are broadcast if they are few and joined
to the pages' own hashes if not.

Pass 2 parses again and writes the text of the page without template subtrees
and without elements that are no article by their nature: menus, footers, asides,
forms, scripts, what is hidden, or what has such a role.  If the page has an article
or main element, only what is inside counts.  Article and main elements, what encloses
one, and paragraphs that stand in them directly are never template: an article that
many pages carry is still an article.

Adverts, consent bars and reader comments differ from page to page and may stand
inside the article, so no count finds them: blocks whose class or id begins or ends
with such a word (ad-slot, user-comments, cookie-bar) go.  Names of page parts (sidebar,
menu, notice, related, ...) decide only where there is no article element around them: inside an article a menu may
be a restaurant's.

Parsing follows HTML's rules where they change the text: raw-text elements,
comments, unclosed paragraphs and list items, tags cut off by the end of the
page, character references with or without semicolon.

Defined results: null or empty html gives an empty text; a null url is a host
of its own (""); repeated rows are extracted each.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import materialise

MIN_PAGES = 5
IN_MEMORY = 1 << 20  # hashes that are broadcast; more are joined

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title|math|object|select)\b(?P<rawattr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:(?<=/)>|>.*?(?:</(?P=raw)[^>]*+>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "head", "summary", "figcaption"}
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
_CONTAINER = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
_NEVER = frozenset("aside button datalist dialog footer form head input menu nav audio video canvas".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# fixed values: first or last words of names of blocks that are no article wherever they stand, and words that turn a name round
_NO_TEXT = frozenset("ad ads advert adverts advertisement advertisements adsense adsbygoogle sponsored promo promos cookie cookies consent gdpr comment comments commentlist disqus".split())
_TURNED = frozenset("no not without has".split())
# fixed values: whole names of page parts, outside articles
_PAGE_PARTS = frozenset(
    "banner banners notice notices site-notice sidebar sidebars side-bar menu main-menu site-menu nav navbar navigation breadcrumb breadcrumbs footer site-footer page-footer "
    "site-header page-header masthead toolbar respond replies share sharing share-buttons social-share related related-posts related-articles "
    "newsletter newsletter-signup subscribe subscription popup modal pagination pager skip-link".split()
)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_BARRIERS = frozenset(("article", "main", "body", "table"))
_THROUGH = frozenset(("article", "main", "body", "html", "section", "div"))
_LINKS = 0.6  # share of its text that makes a container mostly links
_SPACE = re.compile(r"\s+")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


class _Element:
    __slots__ = ("tag", "drop", "inside", "hash", "shape", "last", "mark", "links", "size", "article")

    def __init__(self, tag: str, names: str, drop: bool, inside: bool, mark: int):
        self.tag, self.drop, self.inside, self.mark = tag, drop, inside, mark
        self.hash = xxhash.xxh64(tag.encode())
        self.shape, self.last = xxhash.xxh64(f"{tag} {names}".encode("utf-8", "replace")), 0
        self.links = self.size = 0
        self.article = False  # is or encloses an article or main element


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _says_no_text(name: str) -> bool:
    words = _WORD.findall(_CAMEL.sub("-", name).lower())
    return bool(words) and (words[0] in _NO_TEXT or words[-1] in _NO_TEXT) and _TURNED.isdisjoint(words)


def _dropped(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in _NEVER or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").strip().lower() in _ROLES or attrs.get("itemprop", "").lower() == "comment":
        return True
    if tag in ("body", "html", "main") or tag == "article" and not inside:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if tag in _BLOCK or tag == "ins":
        if any(_says_no_text(n) for n in names):
            return True
        return not inside and any(n.lower() in _PAGE_PARTS for n in names)
    return False


class _Sorted:
    """Membership in a sorted array: a set of Python numbers would take many times the memory."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __contains__(self, value: int) -> bool:
        at = int(np.searchsorted(self.values, value))
        return at < len(self.values) and int(self.values[at]) == value


def seed_of(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(url).encode("utf-8", "replace"))


def parse(page: str, templates: frozenset[int] | set[int] | _Sorted = frozenset(), seed: int = 0) -> tuple[str, list[int]]:
    """(main text, hashes of the container subtrees, each with the host's seed).

    Open elements are found by tag, never by going through all of them, so the time is linear in the page.
    """
    blocks: list[tuple[str, bool]] = []  # text, inside an article or main element
    held: list[str] = []
    found: list[int] = []
    stack = [_Element("#", "", False, False, 0)]
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    barriers: list[int] = []
    scopes: list[int] = []
    seen_article = False

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((text, stack[-1].inside))

    def say(text: str) -> None:
        top = stack[-1]
        if text and not top.drop:
            held.append(text)
        if text and not text.isspace():
            top.hash.update(b"t" + _SPACE.sub(" ", text).strip().encode("utf-8", "replace"))
            n = len(text.strip())
            top.size += n
            if any(e.tag == "a" for e in stack[-3:]):
                top.links += n

    def recurs(value: int) -> bool:
        value ^= seed
        signed = value - (1 << 64) if value >> 63 else value
        found.append(signed)
        return signed in templates

    def push(e: _Element) -> None:
        place = len(stack)
        stack.append(e)
        open_at.setdefault(e.tag, []).append(place)
        if e.tag in _BARRIERS:
            barriers.append(place)
        if e.tag in _SCOPE:
            scopes.append(place)

    def close() -> None:
        if stack[-1].tag in _BLOCK:
            flush()
        e = stack.pop()
        open_at[e.tag].pop()
        if e.tag in _BARRIERS:
            barriers.pop()
        if e.tag in _SCOPE:
            scopes.pop()
        value, shape = e.hash.intdigest(), e.shape.intdigest()
        top = stack[-1]
        top.hash.update(b"e" + value.to_bytes(8, "little"))
        if (e.tag in _BLOCK or e.tag == "a") and shape != top.last:  # one item of a list or ten: the same shape
            top.last = shape
            top.shape.update(shape.to_bytes(8, "little"))
        top.size += e.size
        top.links += e.links
        top.article |= e.article
        if e.tag in _CONTAINER and not e.article and e.size:
            gone = recurs(value)
            if not e.inside and e.links >= _LINKS * e.size:
                gone = recurs(xxhash.xxh64_intdigest(shape.to_bytes(8, "little"))) or gone
            menu = not e.inside and e.tag in ("ul", "ol") and e.links >= 0.9 * e.size
            if gone or menu:
                del blocks[e.mark :]

    def close_to(place: int) -> None:
        while len(stack) > place:
            close()

    def last(tags: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            place = last((tag,))
            if tag == "p" and not place:
                flush()
            elif place and (tag in _THROUGH or not barriers or barriers[-1] <= place):
                close_to(place)
            continue
        if tag in _CLOSES_P or tag in _SIBLING:
            also = _SIBLING.get(tag, ()) + (("p",) if tag in _CLOSES_P else ())
            again = True
            while again:
                place = last(also)
                again = place > (scopes[-1] if scopes else 0) and "p" in also and tag in _SIBLING
                if place > (scopes[-1] if scopes else 0):
                    close_to(place)
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            stack[-1].hash.update(tag.encode())
            continue
        raw = m.group("attr")
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        top = stack[-1]
        drop = top.drop or _dropped(tag, attrs, top.inside)
        core = tag in ("article", "main") or attrs.get("role", "").strip().lower() == "main"
        inside = top.inside or (core and not drop)
        seen_article |= inside
        if raw.endswith("/") and tag not in _BLOCK:
            continue
        push(_Element(tag, " ".join(sorted(f"{attrs.get('class', '')} {attrs.get('id', '')}".split())), drop, inside, len(blocks)))
        stack[-1].article = core and not drop
    if at < len(page):
        say(page[at:])
    close_to(1)
    flush()
    return "\n".join(t for t, inside in blocks if inside or not seen_article), found


def _pass1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            some = batch.slice(a, 500)
            prints, hashes = [], []
            for url, page in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                text, found = parse(page or "", seed=seed_of(url))
                prints.append(xxhash.xxh64(text.encode("utf-8", "replace")).intdigest() >> 1)
                hashes.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(prints, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["_key", "print", "hashes"])


def _key():
    """Of a page.  Pages that share one by chance get both pages' templates, of which only their own can match."""
    return F.xxhash64("url", "html").alias("_key")


def subtrees(pages: DataFrame) -> DataFrame:
    """_key, print (of the text), hashes (of the container subtrees and the host), a row for each page."""
    return pages.select(_key(), "url", "html").mapInArrow(_pass1, "_key long, print long, hashes array<long>")


def site_templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """h: the container subtrees that recur across their host's pages."""
    once = found.select("print", F.explode("hashes").alias("h")).distinct()
    return once.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages).select("h")


def _pass2(kept: list[str], known):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = _Sorted(known.value) if known is not None else None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                column = lambda c, some=some: some.column(some.schema.get_field_index(c))
                own = (everywhere if everywhere is not None else set(hashes or ()) for hashes in column("_hashes").to_pylist())
                texts = [parse(page or "", templates, seed_of(url))[0] for url, page, templates in zip(column("_url").to_pylist(), column("html").to_pylist(), own, strict=True)]
                out = [column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[*kept, "text", "n_chars"])

    return of


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, in_memory: int = IN_MEMORY) -> DataFrame:
    """The pages' columns but html, with text (main text) and n_chars (its code points)."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars", "_url", "_key", "_hashes")]
    found = materialise(subtrees(pages), "subtrees")
    templates = materialise(site_templates(found, min_pages), "templates")
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col("url").alias("_url"), "html", _key())
    known = None
    if templates.count() <= in_memory:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(templates.toArrow()["h"].to_numpy()))
        rows = rows.withColumn("_hashes", F.lit(None).cast("array<long>"))
    else:
        own = found.select("_key", F.explode("hashes").alias("h")).distinct().join(templates, "h").groupBy("_key").agg(F.collect_list("h").alias("_hashes"))
        rows = rows.join(own, "_key", "left")
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["text string, n_chars long"])
    return rows.select(*[F.col(f"`{c}`") for c in kept], "_url", "html", "_hashes").mapInArrow(_pass2(kept, known), schema)
