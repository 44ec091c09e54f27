"""Main text of web pages: site templates go first, then what elements say they are.

Every block element of a page, menus, footers and the article's own parts alike, is a
subtree with two hashes: of its content (tags and text) and of its skeleton (the tags,
classes and attribute names around and in it, equal children folded). Spark counts both per
host over different pages. A subtree goes if its content recurs on many pages of the host,
or if its skeleton does and its kind holds, over the whole host, links or a few words beside
the running text. What is left then loses the elements that say by tag, role or class that
they are no part of an article.

The running text of a page is its ``article`` or ``main``; without one, it is the deepest
container with more than half of the words that are no links. Counted over the host, this
tells a kind of element that holds articles, which never goes as a template, from one that
stands beside them, however short a single article is.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize
from .url_filter import host

MIN_PAGES = 5
SALTS = 16
#: Lists of templates are broadcast if they have no more hashes than this together.
BROADCAST_HASHES = 1_000_000
#: A kind of element beside the running text is furniture by its skeleton if it has this many
#: words a page or fewer, and this share of the words of its pages or less.
FEW_WORDS = 40
SMALL_SHARE = 0.25

#: Fixed by HTML: elements whose content is no markup, elements without content, blocks.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the given containers.
ENDS = {
    **{t: (frozenset({"p"}), frozenset("div section article main td th li button body".split())) for t in BLOCK - {"br", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "head", "body"}},
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu dir".split())),
    "dd": (frozenset({"dd", "dt", "p"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements, roles and class words that are no part of an article.
DROP_TAGS = frozenset(
    "head nav header footer aside menu form script style noscript template button select option datalist textarea input label iframe svg math canvas object applet audio video map dialog search".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status".split())
DROP_WORDS = frozenset(
    "nav navbar navigation navigator menu submenu breadcrumb breadcrumbs masthead topbar toolbar header pageheader siteheader footer pagefooter sitefooter sidebar sidenav aside rail ad ads adbox adslot advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox subscribe subscription newsletter signup login share sharing sharebar social socials comment comments commentlist disqus replies reply respond related recommended recommendations recirculation trending pagination pager skiplink copyright disclaimer searchbox searchform form widget widgets".split()
)
DROP_STARTS = ("sidebar", "cookie", "newsletter", "navbar", "breadcrumb", "advert", "sponsor", "subscrib", "commentlist", "commentform", "commentsection")
NEGATORS = frozenset("has with no without after before in".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article center details dir div dl fieldset figure footer form header html body legend main menu nav ol section summary table tbody td th tr ul aside dialog search address blockquote".split())
ARTICLE_CONTAINERS = frozenset("div section ul ol dl table center figure details".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:"[^"]*+"|'[^']*+'|[^>"'])*+>|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WATCHED = ("class", "id", "role", "hidden", "style")
_DIGITS = re.compile(r"\d+")
_SUB = [("c", pa.int64()), ("s", pa.int64()), ("inner", pa.bool_()), ("h1", pa.bool_())]
_SLOT = [("s", pa.int64()), ("path", pa.int64()), ("n", pa.int64()), ("core", pa.int64()), ("within", pa.int64()), ("words", pa.int64()), ("links", pa.int64()), ("heads", pa.int64())]


class _Node:
    """An element. ``holds``: an article lies in it; ``inside``: it lies in one, or is one."""

    __slots__ = ("tag", "look", "up", "drop", "article", "holds", "inside", "gone", "top", "linked", "parts", "kids", "words", "links", "heads", "h1", "path", "digest", "slot", "own")

    def __init__(self, tag, look, up, drop, article):
        self.tag, self.look, self.up, self.drop, self.article = tag, look, up, drop, article
        self.holds, self.inside = article, article or up is not None and up.inside
        self.gone, self.top, self.linked = False, None, tag == "a" or up is not None and up.linked
        self.parts, self.kids, self.words, self.links, self.heads, self.h1 = [], {}, 0, 0, tag in HEADINGS, tag == "h1"
        self.path, self.digest, self.slot = up.path if up is not None else "", 0, 0
        self.own = tag in BLOCK and tag not in ("html", "body", "head")
        if self.own:
            self.path += ">" + look


def _attributes(rest: str) -> dict[str, str]:
    seen: dict[str, str] = {}
    if "=" in rest or "hidden" in rest:
        for name, value in _ATTR.findall(rest):
            name = name.lower()
            if name not in seen:
                seen[name] = html.unescape(value.strip("\"'")) if name in _WATCHED else ""
    return seen


def _look(tag: str, seen: dict[str, str]) -> str:
    """Tag, classes without numbers, and attribute names: equal for elements of one kind."""
    if not seen:
        return tag
    return f"{tag}.{'.'.join(sorted(set(_DIGITS.sub('', seen.get('class', '')).split())))}[{','.join(sorted(seen))}]"


def _dropped(tag: str, seen: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element goes by what it says it is, and whether it says it is the article."""
    role = seen.get("role", "").lower()
    words = [w.lower() for key in ("class", "id") for w in _WORD.findall(seen.get(key, ""))]
    named = any((w in DROP_WORDS or w.startswith(DROP_STARTS)) and (not i or words[i - 1] not in NEGATORS) for i, w in enumerate(words))
    hidden = "hidden" in seen or "display:none" in seen.get("style", "").replace(" ", "").lower()
    if tag in ("article", "main") or role in ("main", "article"):
        return named and tag == "article" or hidden, True
    if tag in ("html", "body"):
        return False, False
    own = tag in DROP_TAGS and not (tag == "header" and inside)
    return own or named or hidden or role in DROP_ROLES, False


def _read(page: str) -> tuple[_Node, list[_Node], list[tuple[_Node, str | None]]]:
    """The root, the elements (parents before children) and, in page order, the pieces of
    text with their elements; None ends a block."""
    root = _Node("", "", None, False, False)
    node, nodes, texts, at, end = root, [], [], 0, len(page)

    def text(piece):
        if piece:
            texts.append((node, html.unescape(piece) if "&" in piece else piece))

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        token, at = m.group(), m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                text(token[9:].removesuffix("]]>"))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            up = node
            while up is not None and up.tag != tag:
                up = None if tag not in BLOCK and up.tag in BLOCK else up.up
            if up is not None and up.up is not None:
                node = up.up
            if tag in BLOCK:
                texts.append((node, None))
            continue
        if tag in ENDS:
            ended, until = ENDS[tag]
            up = node
            while up is not None and up.tag not in until:
                if up.tag in ended:
                    node = up.up
                up = up.up
        if tag in BLOCK:
            texts.append((node, None))
        rest = token[1 + len(tag) :]
        if tag in VOID:
            continue
        seen = _attributes(rest)
        drop, article = _dropped(tag, seen, node.inside)
        child = _Node(tag, _look(tag, seen), node, drop, article)
        nodes.append(child)
        if article and not drop:
            up = node
            while up is not None and not up.holds:
                up.holds, up = True, up.up
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            at = close.end() if close else end
            continue
        if rest.endswith("/>") and tag in ("svg", "path", "math"):
            continue
        node = child

    return root, nodes, texts


def _by_roles(nodes: list[_Node], blocks: list[list[tuple[_Node, str]]]) -> list[str]:
    """What each block keeps by the roles of its elements."""
    for n in nodes:
        n.gone = n.up.gone or n.drop
        n.top = n.up.top if n.up.top is not None and (n.up.top.tag == "article" or not n.article or n.tag != "article") else n if n.article else None
    if not any(n.top is not None and not n.gone and not piece.isspace() for block in blocks for n, piece in block):
        # No article is left: an element around one stays, whatever it is called.
        for n in nodes:
            n.gone = n.up.gone or n.drop and (n.article or not n.holds)
    left = [[(n, piece) for n, piece in block if not n.gone] for block in blocks]
    tops = [next((n.top for n, _ in block if n.top is not None), None) for block in left]
    # Articles in a main part are its text unless they are the smaller part of it (teasers).
    sizes = [(top.tag, sum(len(p) for _, p in block if not p.isspace())) for top, block in zip(tops, left, strict=True) if top is not None]
    own, wide = sum(n for tag, n in sizes if tag == "article"), sum(n for _, n in sizes)
    if own and 2 * own >= wide:
        fits = [top is not None and top.tag == "article" for top in tops]
    else:
        fits = [top is not None or not wide for top in tops]
    return [" ".join("".join(p for _, p in block).split()) if fit else "" for fit, block in zip(fits, left, strict=True)]


def _core(root: _Node, nodes: list[_Node]) -> _Node | None:
    """Without an article: the deepest container with over half of the unlinked words; None if
    that is the whole page."""
    total, core = root.words - root.links, None
    for n in nodes:  # parents come before children, and only one child can hold over half
        if n.tag in CONTAINERS and 2 * (n.words - n.links) > total and (core is None or n.up is core or _under(n, core)):
            core = n if n.own else core
    return core


def _under(n: _Node, top: _Node) -> bool:
    while n is not None:
        if n is top:
            return True
        n = n.up
    return False


def parse(page: str) -> tuple[list[tuple[str, str, list[int], list[int]]], list[tuple], list[tuple], int, int]:
    """Blocks (text, text by roles, content and skeleton hashes of the elements around them),
    subtrees, kinds of elements, the number of words, and a hash of all these."""
    root, nodes, texts = _read(page)
    blocks: list[list[tuple[_Node, str]]] = []
    fresh = True
    for n, piece in texts:
        if piece is None:
            fresh = True
        elif fresh:
            blocks.append([(n, piece)])
            fresh = False
        else:
            blocks[-1].append((n, piece))
    roles = _by_roles(nodes, blocks)
    found = []
    for block, role in zip(blocks, roles, strict=True):
        joined = " ".join("".join(p for _, p in block).split())
        if joined:
            first = next(n for n, p in block if not p.isspace())
            found.append((first, joined, role))
            first.parts.append(joined)
            for n, piece in block:
                words = len(piece.split())
                n.words += words
                n.links += words if n.linked else 0
    for n in reversed(nodes):
        up = n.up
        up.words, up.links, up.heads, up.h1 = up.words + n.words, up.links + n.links, up.heads or n.heads, up.h1 or n.h1
        if n.own or n.tag == "a":
            # Children are seen last to first; equal ones are folded into the first seen.
            up.kids[f"{n.look}({''.join(n.kids)})"] = None
        else:
            up.kids.update(n.kids)
        if n.parts:
            n.digest = xxhash.xxh3_64_intdigest("\x1f".join([n.tag, *n.parts]))
            up.parts.append(str(n.digest))
    marked = any(n.article for n in nodes)
    core = None if marked else _core(root, nodes)
    around = set()
    while core is not None:
        around.add(id(core))
        core = core.up
    subtrees, kinds = {}, {}
    inside: dict[int, bool] = {}
    top = None if marked or not around else next((n for n in reversed(nodes) if id(n) in around), None)
    for n in nodes:
        if marked:
            holds, within = n.holds, n.inside and not n.article
        elif top is not None:
            holds, within = id(n) in around, n.up is top or inside.get(id(n.up), False)
        else:
            # The text lies in the page itself: containers stand beside it.
            holds, within = False, inside.get(id(n.up), False) or n.own and n.tag not in CONTAINERS and n.up.tag in ("", "html", "body")
        inside[id(n)] = within
        if not n.own or not n.parts:
            continue
        path = xxhash.xxh3_64_intdigest(n.path) >> 1
        n.slot = xxhash.xxh3_64_intdigest(f"{n.path}({''.join(n.kids)})") >> 1
        n.digest = xxhash.xxh3_64_intdigest(f"{n.digest} {n.slot}") >> 1
        inner = within and n.tag in ARTICLE_CONTAINERS
        if inner or not within:
            subtrees[n.digest] = (n.digest, n.slot, inner, n.h1)
        k = kinds.setdefault(n.slot, [n.slot, path, 0, 0, 0, 0, 0, 0])
        for i, more in enumerate((1, holds, within, n.words, n.links, n.heads), 2):
            k[i] += int(more)

    def hashes(n):
        contents, skeletons = [], []
        while n is not None:
            # What is, holds or makes up an article never goes, so its hashes needn't be kept.
            if n.slot and not (marked and (n.holds or inside[id(n)] and n.tag not in ARTICLE_CONTAINERS)):
                contents.append(n.digest)
                skeletons.append(n.slot)
            n = n.up
        return contents, skeletons

    out = [(joined, role, *hashes(n)) for n, joined, role in found]
    body = xxhash.xxh3_64_intdigest(repr(([b[0] for b in out], sorted(subtrees), sorted(kinds.values())))) >> 1
    return out, list(subtrees.values()), [tuple(k) for k in kinds.values()], root.words, body


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page: its host, blocks, subtrees, kinds of elements, words and a hash of them."""
    longs = pa.list_(pa.int64())
    block = pa.list_(pa.struct([("t", pa.string()), ("role", pa.string()), ("c", longs), ("s", longs)]))

    def structs(rows, fields):
        return pa.array([[dict(zip([f for f, _ in fields], r, strict=True)) for r in row] for row in rows], pa.list_(pa.struct(fields)))

    def run(batches):
        for b in batches:
            rows = [parse(h.as_py() or "") for h in b.column(3)]
            # Mostly a block is whole by its roles, or gone: the text is kept once.
            blocks = pa.array([[{"t": t, "role": None if r == t else r, "c": c, "s": s} for t, r, c, s in row[0]] for row in rows], block)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], blocks, structs([r[1] for r in rows], _SUB), structs([r[2] for r in rows], _SLOT), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["page_id", "url", "host", "blocks", "subtrees", "kinds", "words", "body"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(
        run,
        "page_id long, url string, host string, blocks array<struct<t: string, role: string, c: array<long>, s: array<long>>>, subtrees array<struct<c: long, s: long, inner: boolean, h1: boolean>>, "
        "kinds array<struct<s: long, path: long, n: long, core: long, within: long, words: long, links: long, heads: long>>, words long, body long",
    )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, contents, skeletons): the hashes that are templates of a host, from ``parsed``.

    Many pages are ``min_pages`` and the square root of the host's pages: on a large host,
    rotating boilerplate has a small share of them. Pages that are equal in content and
    skeleton count once, so copies of a page are no template. A list has at most that root
    times the subtrees of one page.

    A kind of element holds the text if half of its elements, or half of those on the same
    path, lie in, are or surround the running text of their page. Kinds that don't are
    templates if they are on many pages and hold links for half of their words (and no more
    than half of the words of their pages), or no heading and few words. Contents are
    templates if they are on many pages and their kind holds the text no more than half of
    the time, or they are a container inside the running text; with an ``h1`` in them, they
    must be on half of the host's pages.
    """
    once = pages.groupBy("host", "body").agg(F.first("subtrees").alias("subtrees"), F.first("kinds").alias("kinds"), F.first("words").alias("all_words"))
    size = once.groupBy("host").agg(F.count(F.lit(1)).alias("bodies"))
    many = (F.col("pages") >= min_pages) & (F.col("pages") * F.col("pages") >= F.col("bodies"))
    sums = [F.sum(x).alias(x) for x in ("n", "core", "within", "words", "links", "heads", "all_words")]
    kinds = once.select("host", "all_words", F.inline("kinds")).groupBy("host", "s", "path").agg(F.count(F.lit(1)).alias("pages"), *sums)
    paths = kinds.groupBy("host", "path").agg(F.sum("n").alias("path_n"), F.sum("core").alias("path_core"), F.sum("within").alias("path_within"))
    kinds = kinds.join(paths, ["host", "path"])
    text, path_text = F.col("core") + F.col("within"), F.col("path_core") + F.col("path_within")
    beside = (2 * text < F.col("n")) & (2 * path_text < F.col("path_n"))
    apart = (2 * text <= F.col("n")) & (2 * path_text <= F.col("path_n"))
    within = (2 * F.col("core") <= F.col("n")) & (2 * F.col("path_core") <= F.col("path_n"))
    kinds = kinds.select("host", "s", beside.alias("beside"), apart.alias("apart"), within.alias("free"), *(x for x in ("pages", "words", "links", "heads", "all_words")))
    menu = (2 * F.col("links") >= F.col("words")) & (2 * F.col("words") <= F.col("all_words"))
    short = (F.col("heads") == 0) & (F.col("words") <= FEW_WORDS * F.col("pages")) & (F.col("words") <= SMALL_SHARE * F.col("all_words"))
    skeletons = kinds.join(size, "host").where(many & F.col("beside") & (menu | short)).groupBy("host").agg(F.array_sort(F.collect_list("s")).alias("skeletons"))
    often = once.select("host", F.inline("subtrees")).groupBy("host", "s", "c").agg(F.count(F.lit(1)).alias("pages"), F.max("h1").alias("h1"), F.min("inner").alias("inner"))
    often = often.join(size, "host").where(many & (~F.col("h1") | (2 * F.col("pages") >= F.col("bodies"))))
    fit = often.join(kinds.select("host", "s", "apart", "free"), ["host", "s"]).where(F.col("apart") | F.col("inner") & F.col("free"))
    contents = fit.groupBy("host").agg(F.array_sort(F.collect_list("c")).alias("contents"))
    none = F.array().cast("array<long>")
    return contents.join(skeletons, "host", "full").select("host", F.coalesce("contents", none).alias("contents"), F.coalesce("skeletons", none).alias("skeletons"))


def main_text(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, by_content, by_skeleton, by_roles), one row per row of
    ``pages`` (page_id, url, html). The last three tell how many characters each step removed.

    A null or empty html, and a page that is all template, have the empty text. A null url
    has the empty host. Repeated rows repeat, ids are not interpreted, other columns are not
    read; an empty table gives an empty result. Nothing is cut.
    """
    found = materialize(spark, parsed(pages), "pages")
    gone = materialize(spark, templates(found, min_pages), "templates")
    slim = found.select("page_id", "url", "host", "body", "blocks")
    held = gone.agg(F.coalesce(F.sum(F.size("contents") + F.size("skeletons")), F.lit(0))).first()[0]
    if held <= BROADCAST_HASHES:
        watched = slim.join(F.broadcast(gone), "host", "left")
    else:
        # A host may hold a third of all pages: its pages spread over the salts.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        slim = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "body"), F.lit(SALTS)).cast("int"))
        watched = slim.join(gone.withColumn("salt", salts), ["host", "salt"], "left")
    none = F.array().cast("array<long>")
    # The host's list is gone through once per page, not once per block.
    for column, field in (("contents", "c"), ("skeletons", "s")):
        watched = watched.withColumn(column, F.array_intersect(F.flatten(f"blocks.{field}"), F.coalesce(column, none)))
    chars = lambda col: F.aggregate(col, F.lit(0).cast("long"), lambda n, b: n + F.length(b["t"]))
    first = watched.withColumn("after", F.filter("blocks", lambda b: ~F.arrays_overlap(b["c"], F.col("contents"))))
    second = first.withColumn("last", F.filter("after", lambda b: ~F.arrays_overlap(b["s"], F.col("skeletons"))))
    roles = F.filter(F.transform("last", lambda b: F.coalesce(b["role"], b["t"])), lambda t: t != "")
    out = second.withColumn("parts", roles)
    kept = F.aggregate("parts", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    out = out.withColumn("text", F.array_join("parts", " "))
    return out.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
        (chars("blocks") - chars("after")).alias("by_content"), (chars("after") - chars("last")).alias("by_skeleton"), (chars("last") - kept).alias("by_roles"),
    )
