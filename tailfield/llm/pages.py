"""Main text of web pages, by equivalence classes of tokens that share their occurrence vectors across a host's pages.

A token is a tag, a whole block or, outside articles, a word, together with its path of open elements. Its occurrence vector
has its count on each page of the host; tokens with equal vectors form a class. Classes on at least ``FREQUENT`` of the
host's pages with at least ``LARGE`` tokens are the host's template. On each page a class must come in the order of its
reference page, round after round, and its rounds must not cross those of another class; tokens that break this on more than
1 - ``FREQUENT`` of the pages leave the template. What is left between template tokens are the slots. A page's article is
the slots of its article elements or, without one, of its body, less menus, headers, footers, sidebars, notices, adverts,
forms and comments (by element, role, class and id; within articles, marks other than adverts and comments count only where
the template fills the block). Blocks that the template fills are no slots, within articles too: there, a
whole block must recur, and a heading goes only with the block below it. Pages that repeat one article must not lose it: if
the template fills more than half of the words of a page's articles, position decides and all their blocks are kept.

Vectors are kept as 64-bit hashes of page and count, joined by exclusive or, folded by task and before the shuffle, so a host with very many pages is never
gathered. Defined results: null and empty pages, and pages without an article's text, give an empty text; hosts with fewer
than ``PAGES`` pages have no template; broken markup is read leniently; very long pages are read whole; repeated rows are
pages of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.llm.store import stored
from tailfield.llm.urls import host_of

FREQUENT, LARGE, PAGES = 0.9, 2, 4
HELD = 200_000
BROADCAST_TOKENS = 200_000

# Element names and the words of roles, classes and ids that mark what is no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
LIMITS = frozenset("ul ol dl table body html article section div main aside nav header footer form td th".split())
OUTSIDE = frozenset("nav aside footer form script style head button select option label dialog menu input".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|menus?|nav|navbar|navigation|sidebar|"
    r"comments?|replies|disqus|footer|masthead|site-?header|share|sharing|social|related|breadcrumbs?|widgets?|popup|modal|newsletter|"
    r"subscribe|signup|login|search|pagination|pager|toolbar|skip)(?=$|[\s_-])", re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?(?:/|$)")


# Within articles these stand for themselves, as classes; other marks need the template to confirm them.
SURE = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|adsense|sponsor\w*|comments?|replies|disqus)(?=$|[\s_-])", re.IGNORECASE)
# Names that tell a state or a topic, not what the element is: "no-sidebar", "category-social".
_STATE = re.compile(r"(?:^|(?<=\s))(?:no|not|non|has|with|without|is|category|cat|tag|topic)[-_]\S*", re.IGNORECASE)


def _marked(name: str, classes: str, own_id: str) -> bool:
    """Whether class or id mark an element as no part of an article; ids of headings and longer ids of sections are anchors."""
    if name in ("html", "body", "main", "article"):
        return False
    said = _STATE.sub("", classes)
    if name != "section" and not re.fullmatch("h[1-6]", name):
        said += " " + _STATE.sub("", own_id)
    elif name == "section" and (m := MARKS.match(own_id)) and m.end() == len(own_id):
        return True
    return bool(MARKS.search(said))


class Element:
    """An open element: its path, and what it says about the text within.

    ``out`` is set by name and role, ``marked`` by class and id. A mark around all articles of a page does not count; a mark
    within an article needs the template's word, unless it is ``sure``.
    """

    __slots__ = ("article", "marked", "name", "out", "parent", "path", "said", "sure")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        self.name, self.parent, said = name, parent, ""
        role = item = classes = own_id = ""
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            key = m[1].lower()
            if key == "role":
                role = value.lower()
            elif key == "itemprop":
                item = value
            else:
                said += " " + value
                if key == "class":
                    classes += " " + value
                else:
                    own_id = value
        self.said = said
        within = parent is not None and parent.article
        named = name in ("article", "main") or role in ("main", "article") or item == "articleBody"
        self.article = within or named
        self.out = name in OUTSIDE or role in ROLES or (name == "header" and not within) or (parent is not None and parent.out)
        self.marked = not named and _marked(name, classes, own_id)
        self.sure = self.marked and bool(SURE.search(_STATE.sub("", classes)))
        self.path = f"{parent.path if parent else ''}/{name}{'.' + said.strip() if said else ''}"

    def marks(self) -> tuple[bool, bool, bool]:
        """Whether a mark stands outside articles above this element, a sure one within them, and another one within them."""
        around = sure = asked = False
        e: Element | None = self
        while e is not None:
            if e.marked:
                within = e.parent is not None and e.parent.article
                around |= not within
                sure |= within and e.sure
                asked |= within and not e.sure
            e = e.parent
        return around, sure, asked


def events(page: str) -> Iterator[tuple[str, Element, str]]:
    """("tag", element, "") at each start, ("text", element, text) and ("break", element, "") at a block's edge, in page order."""
    stack = [Element("html", "", None)]
    at, n = 0, len(page)
    while at < n:
        m = _PIECE.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield "text", stack[-1], page[at:end]
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if any(e.name in BLOCK for e in stack[k:]):
                        yield "break", stack[k - 1], ""
                    del stack[k:]
                    break
            continue
        if name in ("html", "body") and any(e.name == name for e in stack):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            continue
        closes = CLOSES.get(name, {"p"} if name in BLOCK else ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in closes:
                del stack[k:]
                break
            if stack[k].name in LIMITS and not (name in CLOSES and stack[k].name in ("td", "th") and name in ("tr", "td", "th")):
                break
        element = Element(name, m[3], stack[-1])
        if name in BLOCK:
            yield "break", element, ""
        yield "tag", element, ""
        if name in ("br", "td", "th"):
            yield "text", element if name != "br" else stack[-1], " "
        if name not in VOID:
            stack.append(element)


def _token(path: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{word}")


class Block:
    """The text between two block edges: its words with their paths, and where it stands.

    ``asked`` says that a mark within an article waits for the template's word.
    """

    __slots__ = ("asked", "heading", "inside", "path", "text", "words")

    def __init__(self, parts: list[tuple[Element, str]], inside: bool, asked: bool) -> None:
        self.inside, self.asked = inside, asked
        self.text = " ".join(html.unescape("".join(x for _, x in parts)).split())
        first = next((e for e, x in parts if x.strip()), parts[0][0])
        self.path = first.path
        self.heading = bool(_HEADING.search(first.path))
        self.words = [] if inside and not asked else [(e.path, w) for e, x in parts for w in html.unescape(x).split()]

    def token(self) -> tuple[str, str]:
        return self.path, "\n" + self.text


def blocks(page: str) -> Iterator[Block | Element]:
    """The page's start tags and its blocks of text that may belong to the article, in page order."""
    seen = list(events(page))
    marks: dict[Element, tuple[bool, bool, bool]] = {}
    bare = False
    for kind, element, text in seen:
        if kind == "text" and element not in marks:
            marks[element] = element.marks()
        bare = bare or (kind == "text" and element.article and not element.out and not any(marks[element][:2]) and bool(text.strip()))
    parts: list[tuple[Element, str]] = []
    state = (False, False)
    for kind, element, text in seen:
        if kind == "text":
            around, sure, asked = marks[element]
            # A mark around the page's only articles is about the layout.
            gone = element.out or sure or (around and (bare or not element.article))
            now = element.article, asked
        if parts and (kind == "break" or (kind == "text" and not gone and now != state)):
            block = Block(parts, *state)
            if block.text:
                yield block
            parts = []
        if kind == "tag":
            yield element
        elif kind == "text" and not gone:
            state = now
            parts.append((element, text))
    if parts and (block := Block(parts, *state)).text:
        yield block


def page_tokens(page: str) -> list[int]:
    """Hashes of the page's tokens in page order; within articles, blocks stand for their words."""
    out, known = [], {}
    for x in blocks(page):
        for token in [(x.path, "")] if isinstance(x, Element) else [*x.words, x.token()]:
            if token not in known:
                known[token] = _token(*token)
            out.append(known[token])
    return out


def misplaced(tokens: list[int], places: dict[int, tuple[int, int]], sizes: list[int]) -> set[int]:
    """Template tokens that break the order of their class on this page, or whose class crosses a larger one.

    ``places`` has each token's class and its rank there, ``sizes`` the number of tokens of each class.
    """
    seen: Counter = Counter()
    found = []
    by_class: dict[int, list[int]] = {}
    for token in tokens:
        if place := places.get(token):
            by_class.setdefault(place[0], []).append(len(found))
            found.append((token, place[0], seen[token], seen[token] * sizes[place[0]] + place[1]))
            seen[token] += 1
    out: set[int] = set()
    for at in by_class.values():
        # What is outside a longest increasing run of the expected ranks is out of order.
        ends: list[int] = []
        where: list[int] = []
        before: dict[int, int] = {}
        for k in at:
            n = bisect_left(ends, found[k][3])
            before[k] = where[n - 1] if n else -1
            ends[n:n + 1], where[n:n + 1] = [found[k][3]], [k]
        kept, k = set(), where[-1]
        while k >= 0:
            kept.add(k)
            k = before[k]
        out.update(found[k][0] for k in at if k not in kept)
    left = [x for x in found if x[0] not in out]
    last = {x[1:3]: k for k, x in enumerate(left)}
    stack: list[tuple[int, int]] = []
    crossed: set[int] = set()
    for k, (_, own, turn, _) in enumerate(left):
        if (own, turn) in stack:
            while stack[-1] != (own, turn):
                other = stack.pop()[0]
                crossed.add(other if sizes[other] <= sizes[own] else own)
        else:
            stack.append((own, turn))
        if last[own, turn] == k:
            stack.pop()
    return out | {token for token, (own, _) in places.items() if own in crossed} if crossed else out


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, joined by blank lines. ``template`` holds hashes of the host's template tokens."""
    found = [x for x in blocks(page) if isinstance(x, Block)]
    articles = any(x.inside for x in found)
    if articles:
        found = [x for x in found if x.inside]
    if template:
        filled = [_token(*x.token()) in template or (bool(x.words) and all(_token(*w) in template for w in x.words)) for x in found]
        if articles:
            for k in range(len(found) - 1, -1, -1):
                if found[k].heading and not found[k].asked:
                    filled[k] = filled[k] and k + 1 < len(found) and filled[k + 1]
            sizes = [0 if x.asked else len(x.text.split()) for x in found]
            if 2 * sum(n for n, gone in zip(sizes, filled, strict=True) if gone) > sum(sizes):
                filled = [x.asked and gone for x, gone in zip(found, filled, strict=True)]
        found = [x for x, gone in zip(found, filled, strict=True) if not gone]
    return "\n\n".join(x.text for x in found)


def _signed(xs) -> pa.Array:
    return pa.array([x - (1 << 64) if x >= 1 << 63 else x for x in xs], pa.int64())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host``, ``token``, ``pages``, ``vector`` (the exclusive or of hashes of page and count) and ``first``, folded.

    ``first`` has a hash of the least page in its upper bits and the token's place on that page in the lower 23.
    """
    held: dict[tuple[str, int], list[int]] = {}

    def folded() -> pa.RecordBatch:
        hosts, tokens = zip(*held, strict=True) if held else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), _signed(tokens), pa.array([v[0] for v in held.values()], pa.int64()), _signed([v[1] for v in held.values()]),
             pa.array([v[2] for v in held.values()], pa.int64())],
            ["host", "token", "pages", "vector", "first"],
        )

    for batch in batches:
        for host, key, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = xxhash.xxh64_intdigest(key) >> 24 << 23
            # A counter keeps the order in which its keys came.
            for at, (token, n) in enumerate(Counter(page_tokens(page or "")).items()):
                first = own | min(at, (1 << 23) - 1)
                found = held.setdefault((host, token), [0, 0, first])
                found[0] += 1
                found[1] ^= xxhash.xxh64_intdigest(f"{key}:{n}")
                found[2] = min(found[2], first)
            if len(held) >= HELD:
                yield folded()
                held = {}
    yield folded()


def _misplaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host``, ``token`` and on how many ``pages`` the token breaks the order or the nesting of the classes."""
    known: dict[str, tuple[dict[int, tuple[int, int]], list[int]]] = {}
    held: Counter = Counter()

    def folded() -> pa.RecordBatch:
        hosts, tokens = zip(*held, strict=True) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), _signed(tokens), pa.array(list(held.values()), pa.int64())], ["host", "token", "pages"])

    for batch in batches:
        for host, page, tokens, vectors in zip(*(batch.column(k) for k in range(4)), strict=True):
            name = host.as_py()
            if name not in known:
                if len(known) > 256:
                    known.clear()
                places, sizes, own = {}, [], None
                for token, vector in zip(tokens.as_py(), vectors.as_py(), strict=True):
                    if not sizes or vector != own:
                        own = vector
                        sizes.append(0)
                    places[token & ((1 << 64) - 1)] = len(sizes) - 1, sizes[-1]
                    sizes[-1] += 1
                known[name] = places, sizes
            held.update((name, token) for token in misplaced(page_tokens(page.as_py() or ""), *known[name]))
        if len(held) >= HELD:
            yield folded()
            held = Counter()
    yield folded()


def _with_templates(pages: DataFrame, found: DataFrame, how: str) -> DataFrame:
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return pages.join(F.broadcast(found) if size <= BROADCAST_TOKENS else found, "host", how)


def templates(pages: DataFrame) -> DataFrame:
    """``host`` and its template ``tokens``; at most what one page holds, divided by ``FREQUENT``, for each host."""
    rows = pages.select("host", F.xxhash64("page_id", "url", "html").cast("string").alias("key"), "html").where("host <> ''")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= PAGES)
    tokens = rows.mapInArrow(_vectors, "host string, token bigint, pages bigint, vector bigint, first bigint").groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.min("first").alias("first")
    )
    often = stored(tokens.join(counts, "host").where(F.col("pages") >= FREQUENT * F.col("all")).select("host", "token", "pages", "vector", "first", "all"))

    def large(own: DataFrame) -> DataFrame:
        sizes = own.groupBy("host", "pages", "vector").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE)
        return own.join(sizes, ["host", "pages", "vector"], "left_semi")

    classes = stored(large(often))
    ordered = F.array_sort(F.collect_list(F.struct("vector", "first", "token")))
    asked = stored(classes.groupBy("host").agg(ordered.alias("all")).select("host", F.col("all.token").alias("tokens"), F.col("all.vector").alias("vectors")))
    broken = _with_templates(rows.select("host", "html"), asked, "inner").select("host", "html", "tokens", "vectors").mapInArrow(
        _misplaced, "host string, token bigint, pages bigint"
    ).groupBy("host", "token").agg(F.sum("pages").alias("broken"))
    right = classes.join(broken, ["host", "token"], "left").where(F.coalesce("broken", F.lit(0)) <= (1 - FREQUENT) * F.col("all")).drop("broken")
    return large(stored(right)).groupBy("host").agg(F.collect_list("token").alias("tokens"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text``, the main text of each."""
    named = pages.withColumn("host", host_of(F.col("url")))
    found = stored(templates(named))
    joined = _with_templates(named, found, "left")

    @F.arrow_udf("string")
    def read(column: pa.Array, tokens: pa.Array) -> pa.Array:
        out, seen = [], {}
        for page, own in zip(column, tokens, strict=True):
            template: frozenset[int] = frozenset()
            if own.is_valid:
                values = own.values.to_numpy()
                key = values.tobytes()
                if key not in seen:
                    if len(seen) > 256:
                        seen.clear()
                    seen[key] = frozenset(x & ((1 << 64) - 1) for x in values.tolist())
                template = seen[key]
            out.append(main_text(page.as_py() or "", template))
        return pa.array(out, pa.string())

    return joined.withColumn("text", read(F.col("html"), F.col("tokens"))).drop("tokens", "host")


def html_extraction(pages: DataFrame) -> DataFrame:
    """One row per page: its main text and the text's length in code points."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
