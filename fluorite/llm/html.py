"""Main text of web pages by site template removal.

Each element's subtree is hashed in the tasks that parse the pages; Spark counts, for each host, on how many pages with
different main text each hash occurs, and a second pass deletes the subtrees that recur across many pages of their host.
Copies of one article count once, so a widely copied article is no template. An element has up to two hashes:

* its content: tag, class and role names, text and children, without link targets, ids, white space and, but in prose, digits;
* its shape and place: the names alone, its own and those above it, runs of equal children counted once, so a menu counts
  by its kind of items. Only elements that the markup names as page furniture have it, and those outside the article
  whose text is all links: their text may differ from page to page.

Paragraphs, headings, list items and quotes inside an article are its own text, however often a passage recurs, and are
never deleted by content; nor is anything that holds them or the article.

Where counts don't decide (a host of few pages), what a page's markup names as menu, header, footer, sidebar, notice, advert,
form, script, style or reader comments goes by its name, and of a page with an article only that is taken.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.llm.common import attach, map_batches, stage

# HTML element names by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head script style noscript template title textarea nav footer aside form iframe svg canvas object button select dialog menu noembed noframes xmp audio video".split())
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address form fieldset legend details summary hgroup search center hr dialog menu".split()
)
#: Text elements that an article owns.
OWN_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre figcaption summary".split())
#: Of these, the ones that hold prose; their numbers count, as a text may differ from the next page's in these alone.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that name boilerplate.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert newsletter subscribe signup popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs comments comment reply respond disqus share sharing social related recommended footer masthead pagination pager widget toolbar "
    "complementary contentinfo skip login search".split()
)
#: Words that go with these in names and say nothing by themselves.
NEUTRAL = frozenset("box bar block area section list links link button buttons item items wrap wrapper container inner outer content body slot unit panel group posts post articles article stories row col top bottom left right main site page".split())
#: Ids are often made from a title: on text elements they don't count, and elsewhere all their words must name boilerplate.
ID_INSIDE = frozenset("div aside ul".split())
REMARKS = frozenset("comment comments respond disqus".split())
NAMED_OUTSIDE = NAMED | {"header", "top", "topbar"}

# A tag is read as the HTML standard's tokenizer does: a name goes to white space, "/", ">" or "=", and a quote begins a value
# only straight after "=". Nothing that is read is given back, so a page is read once whatever it holds. A tag that the page's
# end cuts off is no text.
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}?+)?+)*+)(?:>|\Z)", re.S)
ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
NAME = re.compile(r"[^A-Za-z]+")
LOOSE, SPACE = re.compile(r"[\d\s]+"), re.compile(r"\s+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: A subtree is a template if it recurs on so many pages of a host with different main text, and on this part of them;
#: a shape says less than content, so it takes a larger part.
MIN_PAGES, MIN_SHARE, MIN_SHAPE_SHARE = 5, 0.2, 0.5
#: Up to so many template hashes, 8 bytes each, go to all tasks as one sorted array; beyond it each page gets those that it holds.
MAX_BROADCAST_TEMPLATES = 2_000_000


#: Parts of an inline element that its parent's hash takes one by one.
MAX_PARTS = 64
#: Stack places kept besides those of tags: blocks, and elements that only some end tags reach beyond.
BLOCKS, BOUND = "<block>", "<bound>"
CROSSING = frozenset("body html main article section div".split())


@functools.cache
def _kinds_of_known(tag: str) -> tuple[str, ...]:
    return (tag, *([BLOCKS] if tag in BLOCK else []), *([BOUND] if tag in ("article", "main", "body") else []))


def _kinds(tag: str) -> tuple[str, ...]:
    return _kinds_of_known(tag) if tag in BLOCK or tag == "body" else (tag,)


#: Attributes of up to so many characters are often those of other elements, too; what they say is kept.
SHORT_ATTRIBUTES = 200


class _Open:
    """An element that isn't closed yet. parts: its text and children for the content hash; kinds: children's shapes."""

    __slots__ = ("tag", "name", "path", "drop", "main", "keep", "mark", "holds_main", "holds_own", "parts", "kinds", "linked", "prose", "bare", "links", "below")

    def __init__(self, tag, name, path, drop, main, keep, mark, linked, prose):
        self.tag, self.name, self.path, self.drop, self.main, self.keep, self.mark, self.linked, self.prose = tag, name, path, drop, main, keep, mark, linked, prose
        self.holds_main, self.holds_own, self.bare, self.links = False, keep, False, int(tag == "a")
        self.parts, self.kinds, self.below = [], [], None


def _number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


def element_name(tag: str, attrs: str) -> str:
    """Tag, classes and role in lower case, without digits; ids and all other attributes don't count."""
    if "=" not in attrs:
        return tag
    own = [(name.lower(), LOOSE.sub(" ", value.strip("\"'").lower()).split()) for name, value in ATTR.findall(attrs)]
    return ".".join([tag, *sorted({c for name, words in own if name in ("class", "role") for c in words})])


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names in ``value`` says boilerplate and nothing else: ``share-buttons`` does, ``related-work`` doesn't."""
    return any(own and own <= NAMED | NEUTRAL and own & NAMED for own in (set(NAME.split(n)) - {""} for n in value.split()))


def _boilerplate(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    found = [(name.lower(), value.strip("\"'").lower()) for name, value in ATTR.findall(attrs)]
    if tag in ("html", "body", "article", "main") and not any(name in ("class", "id", "role") and "comment" in value for name, value in found):
        return False
    for name, value in found:
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        if name == "id" and (in_main or tag in OWN_TEXT):
            own = set(NAME.split(value)) - {""}
            if own and (tag in ID_INSIDE and own <= NAMED or tag not in OWN_TEXT and own <= REMARKS):
                return True
        elif in_main and name in ("class", "role"):
            if tag not in OWN_TEXT and _names_boilerplate(value):
                return True
        elif name in ("class", "id", "role") and NAMED_OUTSIDE & set(NAME.split(value)):
            return True
    return False


def _described(tag: str, attrs: str, in_main: bool) -> tuple[bool, str]:
    return _boilerplate(tag, attrs, in_main), element_name(tag, attrs)


_known = functools.lru_cache(50_000)(_described)


def parse(page: str | None, is_template=None, site: str = "", lists: bool = True) -> tuple[str, list[int]]:
    """The main text of a page without its site's templates, and the hashes of the subtrees that could be some.

    ``is_template``: tells a template's hash, None for no templates; ``site`` is hashed into each of them. Hashes of content
    are even, those of shape odd. The main text is that of the page's articles, without one of its main element, else of
    its body. Blocks that have text are joined by line feeds. A null or empty page has neither text nor hashes.
    ``lists``: False leaves out all rules but the templates, to see what the counts alone delete.
    """
    text = page or ""
    stack: list[_Open] = []
    # Text in a block, whether a main element holds it and whether a named one does; None is a block's edge.
    pieces: list[tuple[str | None, bool, bool]] = []
    hashes: list[int] = []
    dropped = 0
    # Where the open elements of each tag, the blocks and the bounds of end tags are on the stack: no walk along it is needed.
    places: dict[str, list[int]] = defaultdict(list)

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def close(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            e = stack.pop()
            for kind in _kinds(e.tag):
                places[kind].pop()
            dropped -= e.drop
            # Inline elements go into their parents' hashes as they are; the shape of many children is hashed to stay short.
            block = e.tag in BLOCK or e.drop
            shape = f"{e.name}({','.join(e.kinds)})" if e.kinds else e.name
            if len(shape) > 200:
                shape = f"{_number(shape):x}"
            content = f"\x1e{_number(e.name, *e.parts):x}" if block and e.parts else ""
            if content and not e.holds_main:
                own = []
                if not e.holds_own:
                    own.append(_number(site, content) >> 2 << 1)
                if e.drop or not e.main and not e.bare and e.links > 1:
                    own.append(_number(site, e.path, shape) >> 2 << 1 | 1)
                hashes.extend(own)
                if is_template is not None and any(map(is_template, own)):
                    del pieces[e.mark :]
            if stack:
                up = stack[-1]
                if e.parts:
                    # An inline element of many parts goes up as one, so deep ones aren't copied again and again.
                    short = len(e.parts) <= MAX_PARTS
                    up.parts += [content] if block else ["\x1d" + e.name, *e.parts, "\x1d"] if short else [f"\x1d{_number(e.name, *e.parts):x}"]
                if not up.kinds or up.kinds[-1] != shape:
                    up.kinds.append(shape)
                up.bare, up.links, up.holds_own = up.bare or e.bare, up.links + e.links, up.holds_own or e.holds_own
                if (e.holds_main or e.tag in ("article", "main")) and not e.drop and not dropped:
                    up.holds_main = True
            if e.tag in BLOCK:
                pieces.append((None, False, False))

    def add(start: int, end: int) -> None:
        if end > start:
            own = text[start:end]
            pieces.append((own, bool(stack) and stack[-1].main, dropped > 0))
            if stack and (own := (SPACE if stack[-1].prose else LOOSE).sub("", own.lower())):
                stack[-1].parts.append(own)
                stack[-1].bare = stack[-1].bare or not stack[-1].linked

    at = 0
    while True:
        m = TOKEN.search(text, at)
        if m is None:
            add(at, len(text))
            break
        add(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            own = places.get(tag)
            if own and (tag in CROSSING or not (bounds := places[BOUND]) or own[-1] >= bounds[-1]):
                close(own[-1])
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((" ", bool(stack) and stack[-1].main, dropped > 0) if tag == "br" else (None, False, False))
            continue
        if tag in ENDS_P and (open_blocks := places[BLOCKS]) and stack[open_blocks[-1]].tag == "p":
            close(open_blocks[-1])
        if tag in ENDS_OWN and (k := last(*ENDS_OWN[tag])) > last("ul", "ol", "dl", "table", "select"):
            close(k)
        inside = bool(stack) and stack[-1].main
        main = inside or tag in ("article", "main") or 'role="main"' in m[3].lower()
        drop, name = (_known if len(m[3]) <= SHORT_ATTRIBUTES else _described)(tag, m[3], inside)
        if tag in BLOCK:
            pieces.append((None, False, False))
        up = stack[-1] if stack else None
        if up is not None and up.below is None:
            up.below = f"{_number(up.path, up.name):x}"
        path = up.below if up is not None else ""
        keep, linked, prose = inside and not dropped and not drop and tag in OWN_TEXT, tag == "a" or up is not None and up.linked, tag in PROSE or up is not None and up.prose
        for kind in _kinds(tag):
            places[kind].append(len(stack))
        stack.append(_Open(tag, name, path, drop, main, keep, len(pieces), linked, prose))
        dropped += drop
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            at = stop.start() if stop else len(text)
    close(0)
    if lists:
        pieces = [p for p in pieces if not p[2]]
    only_main = lists and any(own for piece, own, _ in pieces if piece and piece.strip())
    blocks: list[str] = []
    held: list[str] = []
    for piece, own, _ in [*pieces, (None, False, False)]:
        if piece is None:
            line = " ".join(html.unescape("".join(held)).split())
            if line:
                blocks.append(line)
            held = []
        elif own or not only_main:
            held.append(piece)
    return "\n".join(blocks), hashes


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_shape_share: float = MIN_SHAPE_SHARE) -> DataFrame:
    """host, h: hashes of subtrees that recur across the host's pages with different main text. Pages without a host have none."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            bodies, hashes = [], []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                body, found = parse(page, None, host)
                bodies.append(_number(body) >> 1)
                hashes.append(sorted(set(found)))
            return pa.RecordBatch.from_pydict({"host": b.column("host"), "body": pa.array(bodies, pa.int64()), "hashes": pa.array(hashes, pa.list_(pa.int64()))})

        return one

    parsed = stage(map_batches(_rows(pages).where("host <> ''").select("host", "html"), "host string, body long, hashes array<long>", make))
    # One row for each different main text of a host, then counts: partial sums go first, so a large host is no hot key.
    bodies = parsed.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    each = parsed.select("host", "body", F.explode("hashes").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    often = stage(each.where(F.col("n") >= min_pages))
    # A host that has more such hashes than others is attached without a shuffle.
    sizes = often.groupBy("host").agg(F.count("*").alias("n_hashes")).join(bodies, "host")
    share = F.when(F.col("h") % 2 == 0, min_share).otherwise(min_shape_share)
    return attach(often, sizes, ["host"], "n_hashes").where(F.col("n") >= share * F.col("n_pages")).select("host", "h")


def _own_hashes():
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(parse(page, None, host)[1])) for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)]
        return pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "host": b.column("host"), "h": pa.array(found, pa.list_(pa.int64()))})

    return one


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_shape_share: float = MIN_SHAPE_SHARE, lists: bool = True, max_broadcast: int = MAX_BROADCAST_TEMPLATES
) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text and n_chars.

    Null or empty html has an empty text; pages without a url or host are of no site, so only the markup's names count;
    repeated rows are extracted each; a page may have any length and any markup, its time grows with its length. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    rows = _rows(pages)
    templates = stage(host_templates(pages, min_pages, min_share, min_shape_share))
    if templates.count() <= max_broadcast:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(templates.select("h").toArrow()["h"].to_numpy()))
        rows = rows.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        # Each page gets its own hits: pages are numbered once, their hashes meet the templates, and few come back.
        shared, rows = None, stage(rows.withColumn("row_id", F.monotonically_increasing_id()))
        hits = map_batches(rows.where("host <> ''").select("row_id", "host", "html"), "row_id long, host string, h array<long>", _own_hashes)
        hits = hits.select("row_id", "host", F.explode("h").alias("h")).join(templates, ["host", "h"], "left_semi").groupBy("row_id").agg(F.collect_list("h").alias("own"))
        rows = rows.join(hits, "row_id", "left")

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            every = shared.value if shared else None
            texts = []
            for host, page, own in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("own").to_pylist(), strict=True):
                known = every if shared else np.sort(np.array(own or [], np.int64))
                found = lambda h: (k := int(known.searchsorted(h))) < len(known) and known[k] == h  # noqa: B023, E731
                texts.append(parse(page, found if len(known) else None, host, lists)[0])
            return pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

        return one

    return map_batches(rows.select("page_id", "url", "html", "host", "own"), "page_id long, url string, text string, n_chars long", make)
