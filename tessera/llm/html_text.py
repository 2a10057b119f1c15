"""Main text of web pages, with site templates removed by counting subtrees per host.

First pass: each page is parsed and the subtrees that could be template (blocks outside the article, and blocks
without prose inside it) are hashed by tag, text and children. Spark counts on how many different pages of a host each hash
occurs, where pages of the same main text are one page (mirrors, ?utm= and ?page= variants, copies); those on at least ``min_pages`` are its templates, however large the host is.

Second pass: each page is parsed again with those of its host's templates that it holds. Template subtrees are deleted, then elements that
are never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments), by
element, role and class names. A name counts as a whole: ``ad-slot`` and ``comment-list`` go, ``has-sidebar`` and ``social-science`` say nothing. An element that frames a
page does not go if it holds over half of the prose. What remains of the articles (all of a page's) is cut into blocks, white space within a block becomes
one space, blocks are joined by a line break. Paragraphs and headings of an article are never template, since passages and whole
articles recur on a host too, unless a box with a weak name (notice, promo) recurs; neither is a subtree with over half of the page's remaining text. Ties do not arise: a subtree recurs or not.

The templates are joined to the pages' subtrees by host and hash: broadcast while they are at most ``BROADCAST_HASHES``,
else through a shuffle in which every template is dealt to ``SALTS`` keys. No row holds more than one page's subtrees.

Defined results: null and empty pages have no text; a null url is the host ''; unclosed and stray tags are closed as
browsers do in the common cases; a page of any depth or length is read in one linear pass; repeated rows repeat; only the named
columns are read (a clashing name gets underscores); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, map_columns

MIN_PAGES, SALTS = 5, 16
#: Templates (a host and 8 bytes each) up to which their table is broadcast.
BROADCAST_HASHES = 1_000_000

#: A tag after its "<". Quotes count only after "=", and nothing is tried twice: a page is read in one linear pass.
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dt", "dd", "figcaption", "caption"}
_BLOCK = _PROSE | {"address", "article", "aside", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "main", "td", "th", "li", "button", "aside", "nav", "form", "blockquote", "footer", "header"}
_NEVER = _RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "template", "svg", "canvas", "object", "audio", "video", "map", "math"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: A class or id name gives an element away if all its parts are words of these lists and one is of the first three: of adverts and reader comments, of the
#: page's frame, or weak ones, which articles use for text of their own, too.
_APART = set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit dfp sponsor sponsors sponsored comment comments commentlist disqus replies reply respond".split())
_FRAME = set("sidebar sidebars menu menus menubar nav navbar navigation breadcrumb breadcrumbs footer masthead header cookie cookies consent gdpr newsletter subscribe subscription signup login paywall share sharing sharebar toolbar pagination pager related recommended recommendations popup modal".split())
_WEAK = set("promo promos promotion banner notice notices notification notifications alert alerts overlay rail social widget widgets skip".split())
_NEUTRAL = set("area bar block bottom box btn button buttons col column container content div group holder icon icons id inner item items js left link links list main mobile outer page panel primary right row secondary section site slot space sub sticky text title top unit wrap wrapper zone global desktop".split())
#: Parts that may stand beside those of adverts and comments only.
_OF_ARTICLES = set("post article entry story reader readers user thread form google banner sidebar header footer".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NAME_BEGINS = re.compile("/?[a-zA-Z]")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """nodes: all elements in the order in which they begin, the page itself first, so children follow their parents."""

    nodes: list[Node]
    text_size: dict[Node, int]
    prose_size: dict[Node, int]

    @property
    def root(self) -> Node:
        return self.nodes[0]


class _Open:
    """The stack of open elements, with the depths at which each tag and each block is open."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.blocks = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The depth of the innermost open element with one of the tags, or -1."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)


def parse(html: str | None) -> Page:
    """A tree of nodes and text (strings, references still encoded). Depth is not bounded; a tag that never ends takes the rest, as in browsers."""
    root = Node("#page")
    nodes, opened = [root], _Open(root)
    at, text = 0, html or ""
    while at < len(text):
        begin = text.find("<", at)
        if begin != at:
            opened.stack[-1].children.append(text[at : begin if begin >= 0 else len(text)])
            if begin < 0:
                break
        if text.startswith("<!--", begin):
            end = text.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(text)
            continue
        if text[begin + 1 : begin + 2] in ("!", "?"):
            end = text.find(">", begin)
            at = end + 1 if end >= 0 else len(text)
            continue
        if not _NAME_BEGINS.match(text, begin + 1):
            opened.stack[-1].children.append("<")
            at = begin + 1
            continue
        m = _TAG.match(text, begin + 1)
        if not m:
            break
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            depth = opened.last((tag,))
            if depth > 0 and (tag in _BLOCK or depth > opened.blocks[-1]):
                opened.close(depth)  # a stray end of an inline element does not close the block around it
            continue
        if tag in _BLOCK:
            _close(opened, {"p"}, _SCOPE)
        if tag in _CLOSES:
            _close(opened, _CLOSES[tag], {"table", "ul", "ol", "dl", "select"})
        node = Node(tag, m.group(3))
        nodes.append(node)
        opened.stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in _VOID and not node.attributes.endswith("/"):
            opened.push(node)
    sizes: dict[Node, int] = {}
    prose: dict[Node, int] = {}
    for node in reversed(nodes):
        sizes[node] = sum(len(c) if isinstance(c, str) else sizes[c] for c in node.children)
        prose[node] = sizes[node] if node.tag in _PROSE else sum(prose[c] for c in node.children if isinstance(c, Node))
    return Page(nodes, sizes, prose)


def _close(opened: _Open, tags: set[str], scope: set[str]) -> None:
    """Close the innermost open element with one of the tags, unless one of the scope lies within it."""
    depth = opened.last(tags)
    if depth > opened.last(scope):
        opened.close(depth)


def _name_kind(name: str) -> str:
    """"apart", "frame", "weak", or nothing for a name that is a text's own."""
    parts = {p.lower() for p in _NAME_PARTS.findall(name) if not p.isdigit()}
    if parts & _APART and parts <= _APART | _NEUTRAL | _OF_ARTICLES | _FRAME | _WEAK:
        return "apart"
    if parts & _FRAME and parts <= _FRAME | _NEUTRAL | _WEAK:
        return "frame"
    return "weak" if parts & _WEAK and parts <= _WEAK | _NEUTRAL else ""


def kind_of(node: Node) -> str:
    """How an element's markup says that it is no article text.

    "never": scripts, menus, footers, asides, what is hidden; "apart": adverts and comments; "frame" and "weak": by names, and tags that some pages
    wrap around everything. Nothing: it may be text.
    """
    if node.tag in _NEVER:
        return "frame" if node.tag in ("form", "header") else "never"
    found = ""
    if not node.attributes or node.attributes.isspace():
        return found
    for m in _ATTRIBUTE.finditer(node.attributes):
        name, value = (m.group(1) or "hidden").lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return "never"
        if name == "role" and value.lower() in _ROLES:
            found = found or "frame"
        if name in ("class", "id") and node.tag not in ("html", "body", "main"):
            kinds = {_name_kind(x) for x in value.split()}
            found = next((k for k in ("apart", "frame", "weak") if k in kinds or k == found), "")
    return found


def removed(page: Page, node: Node, inside: bool, whole: int) -> bool:
    """Whether an element goes by its markup. ``whole``: the prose of the page, or of its articles if ``inside`` one.

    What frames a page or has a weak name stays if it holds over half of that prose; inside an article, a weak name takes nothing that holds prose (only a
    recurring one goes), and neither a header with the title nor a paragraph goes by a name.
    """
    kind = kind_of(node)
    if kind in ("", "never"):
        return kind == "never"
    if inside and node.tag == "header" and any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children):
        return False
    if inside and node.tag in _PROSE:
        return False
    if kind == "apart":
        return True
    if kind == "weak" and inside:
        return not page.prose_size[node]
    return 2 * page.prose_size[node] <= whole or not whole


def content_roots(page: Page) -> tuple[list[Node], bool]:
    """The articles, else the main elements, else the page; and whether they are one of the first two. Nested ones are part of the outer."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [page.root]
    while todo:
        node = todo.pop()
        if node.tag in found and kind_of(node) not in ("never", "apart"):
            found[node.tag].append(node)
        if node is page.root or (node.tag != "article" and not (node.tag != "header" and removed(page, node, False, page.prose_size[page.root]))):
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    if found["article"]:
        return found["article"], True
    inner = set()
    for node in page.nodes:
        if node.tag == "main" and node in found["main"] and node not in inner:
            inner |= {c for c in _below(node) if c.tag == "main"}
    mains = [m for m in found["main"] if m not in inner]
    return (mains, True) if mains else ([page.root], False)


def _below(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                out.append(c)
                todo.append(c)
    return out


def subtree_digests(page: Page) -> dict[Node, tuple[int, bool]]:
    """Each subtree's hash by tag, text and children (not attributes), and whether it holds prose."""
    import xxhash

    out: dict[Node, tuple[int, bool]] = {}
    for node in reversed(page.nodes):
        parts, prose = [node.tag], node.tag in _PROSE
        for c in node.children:
            if isinstance(c, str):
                parts.append(" ".join(unescape(c).split()))
            else:
                digest, below = out[c]
                parts.append(f"<{digest}>")
                prose = prose or below
        value = xxhash.xxh64_intdigest("\x00".join(parts), 0)
        out[node] = value - ((value >> 63) << 64), prose
    return out


def template_candidates(page: Page) -> dict[Node, int]:
    """Node -> hash, for the subtrees that could be template.

    Inside an article: blocks without prose or with a weak name. Elsewhere: every block but those around an article.
    """
    roots, inside = content_roots(page)
    digests = subtree_digests(page)
    within = {n for r in roots for n in _below(r)} if inside else set()
    around = set(roots)
    for node in reversed(page.nodes):
        if node not in around and any(c in around for c in node.children if isinstance(c, Node)):
            around.add(node)
    return {n: digests[n][0] for n in page.nodes if n.tag in _BLOCK and n.tag not in ("html", "body") and n not in around and not (n in within and digests[n][1] and (n.tag in _PROSE or kind_of(n) != "weak"))}


def main_text(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The articles' blocks, joined by line breaks."""
    return text_of(parse(html), templates)


def text_of(page: Page, templates: frozenset[int] = frozenset()) -> str:
    """``main_text`` of a parsed page."""
    roots, inside = content_roots(page)
    hashes = template_candidates(page) if templates else {}
    half, whole = sum(page.text_size[r] for r in roots) / 2, sum(page.prose_size[r] for r in roots)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if block := " ".join(unescape("".join(run)).split()):
            blocks.append(block)
        run.clear()

    todo: list = [x for r in reversed(roots) for x in (None, *reversed(r.children), None)]  # None: a block's edge
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag == "br":
            run.append(" ")
        elif removed(page, c, inside, whole) or (hashes.get(c) in templates and page.text_size[c] <= half):
            if c.tag in _BLOCK:
                flush()
        elif c.tag in _BLOCK:
            todo += [None, *reversed(c.children), None]
        else:
            todo += reversed(c.children)
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_key(html_col: str) -> Column:
    """Pages of a host with the same markup hold the same subtrees."""
    return F.xxhash64(F.col(html_col).cast("string"))


def page_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, body, hashes): one row per page, with the subtrees that could be template."""

    def start():
        import xxhash

        def work(htmls):
            bodies, hashes = [], []
            for html in htmls:
                page = parse(html)
                hashes.append(list(set(template_candidates(page).values())))
                bodies.append(xxhash.xxh64_intdigest(text_of(page).encode()) - (1 << 63))
            return [bodies, hashes]

        return work

    rows = pages.select(host_of(F.col(url_col)).alias("host"), _page_key(html_col).alias("page"), F.col(html_col).cast("string").alias("html"))
    return map_columns(rows, ["html"], [("body", "long", pa.int64()), ("hashes", "array<long>", pa.list_(pa.int64()))], start, drop=("html",))


def _each(found: DataFrame) -> DataFrame:
    return found.select("host", "page", "body", F.explode("hashes").alias("hash"))


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, body, hash): the subtrees of each page that could be template."""
    return _each(page_subtrees(pages, url_col, html_col))


def site_templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash): the subtrees that recur across many different pages of a host."""
    return found.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, keep_html: bool = True) -> tuple[DataFrame, str]:
    """The rows with their main text; also returns the new column's name."""
    found = _each(checkpointed(page_subtrees(pages, url_col, html_col)))
    templates = checkpointed(site_templates(found, min_pages))
    if templates.count() <= BROADCAST_HASHES:
        held = found.join(F.broadcast(templates), ["host", "hash"])
    else:
        dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = found.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(dealt, ["host", "hash", "salt"])
    host, page, hashes, name = (fresh_name(pages, x) for x in ("host", "page", "hashes", "text"))
    held = held.groupBy("host", "page").agg(F.collect_set("hash").alias(hashes)).withColumnsRenamed({"host": host, "page": page})
    joined = pages.withColumn(host, host_of(F.col(url_col))).withColumn(page, _page_key(html_col)).join(held, [host, page], "left").drop(host, page)

    def start():
        sets: dict[tuple[int, ...], frozenset[int]] = {}

        def work(htmls, known):
            out = []
            for html, mine in zip(htmls, known, strict=True):
                key = tuple(mine or ())
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = frozenset(key)
                out.append(main_text(html, sets[key]))
            return [out]

        return work

    return map_columns(joined, [html_col, hashes], [(name, "string", pa.string())], start, drop=(hashes, *(() if keep_html else (html_col,)))), name


def op3_site_templates(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html"), keep_html=False)[0].select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
