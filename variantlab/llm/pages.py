"""Main text of web pages: site templates are found by counting element subtrees per host, and removed.

A first scan hashes the subtrees of every page (menus, lists and their items, headers, footers,
notices, adverts, containers and blocks alike), counts in how many pages of the host each occurs, and
takes as templates those of at least LEAST pages, not all of them copies of one page, and a SHARE of
the host's pages.  There can be at most a page's mean number of subtrees divided by SHARE of them for
a host, so they are gathered by host.  Not counted are articles themselves, paragraphs, headings and
list items inside them (text that many articles share is still text), and what is over half of its
page's text (copies of an article under other menus).  A second scan deletes the templates; of what
didn't recur, markup that declares to be no article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) goes too, and the blocks left of the article, or
where there is none of the page, are joined.

A null html is empty and gives an empty text; a null url is a host of its own, the empty one, and is
returned as it is.  Long pages are read whole, in linear time.  Repeated rows and rows without page_id
are pages of their own.  An empty table gives an empty result; other columns, whatever their names,
are not read.  A host may hold a third of all pages: its counts are summed up before they are
shuffled, and the join back is a plain equi-join, which is split where it is skewed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.common import written

#: Fewest pages of a host that share a template subtree, and their least share of the host's pages.
LEAST, SHARE = 5, 0.02
#: Subtrees are hashed by a polynomial in the hashes of their texts, modulo a prime.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A1C2E4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*))(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?:^|\s)(hidden)(?=[\s=/]|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form button select option datalist template svg canvas object dialog menu audio video".split()) | _RAW
#: Of those and the headers, what may be a wrapper of the whole page.
_WRAPS = frozenset("form header".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that end an open paragraph, and what an element of a kind ends among its open siblings.
_ENDS_P = _BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SIBLING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table div section article main body".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter"
    " subscribe subscription share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comments comment disqus replies respond"
    " related recommended recommendations popup modal overlay widget masthead topbar toolbar pagination pager login signup search skip".split()
)
#: Words that only say where or what kind of box an element is: with them a name is still that of its other words.
_NEUTRAL = frozenset("site main page global top bottom left right upper lower primary secondary box bar block section container wrapper inner outer list area item items links link button buttons form".split())
#: Words that inside an article name a part of it.
_OWN = frozenset("alert notice notices banner search skip".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_PROSE = frozenset("p blockquote pre".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr".split())


@dataclass
class Element:
    name: str
    parent: int
    start: int  # first text chunk
    end: int = 0
    hidden: bool = False
    main: bool = False
    roles: bool = False  # a role attribute says that it is no article
    names: frozenset[str] = frozenset()  # listed words of whole class and id names, "header" among them
    dropped: bool = False
    root: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    chunks: list[str | None] = field(default_factory=list)  # None breaks a block
    owner: list[int] = field(default_factory=list)


def _named(name: str) -> set[str]:
    """The listed words of a class or id, if it says no more than them and where the element stands: `site-footer`, not `has-footer`."""
    words = set(re.split(r"[-_]+", name)) - _NEUTRAL
    return words if words and words <= _WORDS | {"header"} else set()


def _marks(rest: str) -> dict[str, object]:
    """What attributes say of an element."""
    out: dict[str, object] = {}
    names: set[str] = set()
    for name, a, b, c, hidden in _ATTRIBUTE.findall(rest):
        value, name = (a or b or c).lower(), name.lower()
        if hidden:
            out["hidden"] = True
        elif name == "role":
            out["roles"], out["main"] = value in _ROLES, value == "main"
        else:
            for word in value.split():
                names |= _named(word)
    return out | {"names": frozenset(names)} if names else out


def _judged(page: Page) -> None:
    """Sets `dropped` and `root`.  What holds an article or main part, or over half of the page's text, is not dropped for a name, role, form or header."""
    elements = page.elements
    n = len(elements)
    article = [e.name in ("article", "main") or e.main for e in elements]
    within = [False] * n  # another article: those are comments, or related ones
    for i, e in enumerate(elements):
        within[i] = e.parent >= 0 and (within[e.parent] or article[e.parent])
    holds = [False] * n
    for i in range(n - 1, -1, -1):
        if elements[i].parent >= 0:
            holds[elements[i].parent] |= holds[i] or (article[i] and not within[i])
    size = [0]
    for chunk in page.chunks:
        size.append(size[-1] + len(chunk.strip()) if chunk else size[-1])
    for i, e in enumerate(elements):
        above = elements[e.parent] if e.parent >= 0 else None
        inside = above is not None and above.root
        itself = (article[i] and not within[i]) or e.name in ("html", "body")
        furniture = e.name in _WRAPS and not (e.name == "header" and inside) or e.roles or bool(e.names - (_OWN | {"header"} if inside else set()))
        furniture = furniture and not itself and not holds[i] and 2 * (size[e.end] - size[e.start]) <= size[-1]
        e.dropped = (above is not None and above.dropped) or (e.name in _DROPPED and e.name not in _WRAPS) or (e.hidden and e.name not in ("html", "body")) or furniture
        e.root = not e.dropped and (inside or article[i])


def parse(source: str) -> Page:
    """Elements in page order with the text chunks that each spans."""
    page = Page()
    elements, chunks, owner = page.elements, page.chunks, page.owner
    open_: list[int] = []
    among: Counter = Counter()  # open elements by name: what isn't open is not looked for

    def shut(to: int) -> None:
        while len(open_) > to:
            e = elements[open_.pop()]
            among[e.name] -= 1
            e.end = len(chunks)
            if e.name in _BLOCK:
                chunks.append(None)
                owner.append(-1)

    def text(a: int, b: int) -> None:
        if a < b:
            chunks.append(entities.unescape(source[a:b]))
            owner.append(open_[-1] if open_ else -1)

    at = mark = 0
    while (at := source.find("<", at)) >= 0:
        m = _TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        text(mark, at)
        at = mark = m.end()
        name = m["name"] or m["name2"]
        if not name or not source[m.end() - 1 : m.end()] == ">":
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        name = name.lower()
        if m["end"] or m["end2"]:
            if among[name]:
                shut(next(i for i in range(len(open_) - 1, -1, -1) if elements[open_[i]].name == name))
            continue
        if name in _ENDS_P and among["p"]:
            for i in range(len(open_) - 1, -1, -1):
                if elements[open_[i]].name == "p":
                    shut(i)
                    break
                if elements[open_[i]].name in _LISTS:
                    break
        if name in _SIBLING and any(among[x] for x in _SIBLING[name]):
            for i in range(len(open_) - 1, -1, -1):
                if elements[open_[i]].name in _SIBLING[name]:
                    shut(i)
                    break
                if elements[open_[i]].name in _LISTS:
                    break
        if name == "br":
            text_at = open_[-1] if open_ else -1
            chunks.append(" ")
            owner.append(text_at)
        if name in _BLOCK:
            chunks.append(None)
            owner.append(-1)
        if name in _VOID:
            continue
        rest = (m["rest"] or m["rest2"] or "").strip()
        elements.append(Element(name, open_[-1] if open_ else -1, len(chunks), **(_marks(rest) if rest else {})))
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            elements[-1].end = len(chunks)
            at = end.start() if end else len(source)
            close = source.find(">", at)
            at = mark = close + 1 if end and close >= 0 else len(source)
            continue
        open_.append(len(elements) - 1)
        among[name] += 1
    text(mark, len(source))
    shut(0)
    _judged(page)
    return page


def subtrees(page: Page, counting: bool = False) -> dict[int, int]:
    """The hash of each element that may be a template: its name and the texts below it.

    counting: without those that are over half of the page's text.  Hashes of spans of texts are
    differences of one running polynomial, so the time is linear however deep elements are.
    """
    place, size, sums = [0], [0], [0]  # before each chunk: texts, characters, polynomial
    for chunk in page.chunks:
        words = " ".join(chunk.split()) if chunk else ""
        value = xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass")) if words else 0
        place.append(place[-1] + bool(words))
        size.append(size[-1] + len(words))
        sums.append((sums[-1] * _BASE + value + 1) % _PRIME if words else sums[-1])
    power = [1]
    for _ in range(place[-1]):
        power.append(power[-1] * _BASE % _PRIME)
    out = {}
    for i, e in enumerate(page.elements):
        inside = e.parent >= 0 and page.elements[e.parent].root
        kind = (e.name in _BLOCK or e.name in _DROPPED or e.dropped) and e.name not in ("html", "body", "head")
        own = size[e.end] - size[e.start]
        if kind and own and (inside or not e.root) and not (inside and e.root and e.name in _TEXTUAL) and not (counting and 2 * own > size[-1]):
            span = (sums[e.end] - sums[e.start] * power[place[e.end] - place[e.start]]) % _PRIME
            out[i] = xxhash.xxh64_intdigest(f"{e.name} {span} {own}".encode()) - (1 << 63)
    return out


def cleaned(page: Page, templates: set[int]) -> tuple[str, int]:
    """The text of articles (or main parts, or where there are none, or paragraphs outside them hold more, the whole body), one paragraph for each block, and the number of templates deleted."""
    known = {i for i, h in subtrees(page).items() if h in templates} if templates else set()
    gone, deleted = [], 0
    for i, e in enumerate(page.elements):
        above = e.parent >= 0 and gone[e.parent]
        deleted += i in known and not above
        gone.append(above or i in known)
    for i, e in enumerate(page.elements):  # what didn't recur, by its markup
        gone[i] |= e.dropped or (e.parent >= 0 and gone[e.parent])
    # articles are taken unless paragraphs outside them hold more, or where the page says which part is the main one
    rooted = any(e.root and not gone[i] for i, e in enumerate(page.elements))
    if rooted and not any((e.name == "main" or e.main) and not gone[i] for i, e in enumerate(page.elements)):
        inside = outside = 0
        prose: list[bool] = []
        for e in page.elements:
            prose.append(e.name in _PROSE or (e.parent >= 0 and prose[e.parent]))
        for chunk, o in zip(page.chunks, page.owner):
            if chunk and o >= 0 and not gone[o]:
                inside += len(chunk.strip()) if page.elements[o].root else 0
                outside += len(chunk.strip()) if prose[o] and not page.elements[o].root else 0
        rooted = inside >= outside
    blocks, held = [], []
    for chunk, o in zip([*page.chunks, None], [*page.owner, -1]):
        if chunk is None:
            words = " ".join("".join(held).split())
            held = []
            if words:
                blocks.append(words)
        elif o < 0:
            if not rooted:
                held.append(chunk)
        elif not gone[o] and (page.elements[o].root or not rooted):
            held.append(chunk)
    return "\n\n".join(blocks), deleted


def main_text(page: Page, templates: set[int]) -> str:
    return cleaned(page, templates)[0]


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, h, n, low, high: pages of the batch that hold a subtree, and the smallest and largest hash of their texts; h is null for the pages themselves."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(source or "")
            whole = xxhash.xxh64_intdigest("".join(c or " " for c in page.chunks).encode("utf-8", "surrogatepass")) - (1 << 63)
            for h in (None, *set(subtrees(page, counting=True).values())):
                row = seen.setdefault((host, h), [0, whole, whole])
                row[0] += 1
                row[1], row[2] = min(row[1], whole), max(row[2], whole)
        hosts, hashes = zip(*seen) if seen else ((), ())
        n, low, high = zip(*seen.values()) if seen else ((), (), ())
        columns = [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (hashes, n, low, high))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "h", "n", "low", "high"])


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host and `templates` (array of long), the subtrees that recur across many of the host's pages."""
    counts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_counted, "host string, h long, n long, low long, high long")
    counts = counts.groupBy("host", "h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    many = counts.where((F.col("n") >= least) & (F.col("low") < F.col("high")) | F.col("h").isNull())
    total = many.where("h is null").select("host", F.col("n").alias("pages"))
    return many.where("h is not null").join(total, "host").where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_list("h").alias("templates"))


def extracted(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page, and n_templates, the number of template subtrees deleted from it."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # as a table its size is known: small ones are broadcast, and beside a large one a hot host can be split
    known = written(templates(pages, least, share), "templates")
    joined = own.join(known, "host", "left").select("page_id", "url", "html", "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist())
            found = [cleaned(parse(source or ""), set(known or ())) for source, known in rows]
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "text", "n_chars", "n_templates"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_templates long")
