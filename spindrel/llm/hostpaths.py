"""HTML main-text extraction by consensus host paths.

First pass: every page's containers are scored by the prose they hold; the best one is widened to the highest ancestor
that adds article text, and the page votes with its generalised path (tags with classes, digits folded). Votes are
added up per host in Spark. Second pass: every page is extracted again at its host's winning path; a page that lacks
it, or whose host has no path, falls back to its own best container.

Tags, roles and hiding attributes say for certain that an element is no article text. Class and id words are weaker
evidence: a name made of furniture words only (`share-bar`) takes the element out, unless it turns out to be the page's
container; a name with other words in it (`side-by-side`) counts only where the element is mostly links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import BROADCAST_ROWS, attach, release, staged

#: Elements without an end tag, elements whose content is not markup, blocks, elements that stay in a head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base link meta title style script noscript template".split())
#: Blocks that don't close an open paragraph.
INSIDE_P = frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
#: A start tag closes an open element of the first list, up to the nearest of the second.
SIBLINGS = {
    "li": ("li", "ul ol menu"),
    "dd": ("dd dt", "dl"),
    "dt": ("dd dt", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
    "thead": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select"),
}
_SIBLINGS = {tag: (a.split(), b.split()) for tag, (a, b) in SIBLINGS.items()}
CELLS = ("td", "th", "table", "caption")
#: Elements and roles that are never article text.
DROPPED = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map nav aside footer button input select textarea label fieldset dialog menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip note".split())
#: Words of names: adverts, comments and what only screen readers see; other page furniture; words that say nothing.
NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored comment comments commentlist disqus invisible".split())
FURNITURE = frozenset(
    "banner promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side footer respond reply replies discussion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip legal copyright toc tags byline meta search".split()
)
FILLER = frozenset(
    "list lists box boxes block blocks section area wrapper wrap container slot site page post posts entry article button buttons bar links link top bottom left right item items unit inner outer group title heading text content body global main primary secondary mobile desktop sticky fixed user reader readers icon icons count form module panel row col column holder us the of".split()
)
UNSEEN = frozenset("sr-only visually-hidden screen-reader-text hidden".split())
#: Words of names that speak for an article.
ARTICLE = frozenset("article post entry content story main".split())
CONTAINERS = frozenset("#root article main section div td body blockquote form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|([!?/]))")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]*)))?)?")
_COMMENT_END = re.compile(r"--!?>|$")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_NUMBER = re.compile(r"\d+")
_SIGNS = re.compile(r"[\W_]+")

#: What is known of an element: kept; kept unless it is mostly links; furniture by name; never article text.
KEPT, DOUBT, WEAK, GONE = 0, 1, 2, 3


class Node:
    __slots__ = ("children", "header", "kind", "links", "marked", "parent", "prose", "step", "tag", "text", "zone")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag = self.step = tag
        self.parent, self.kind, self.header, self.marked = parent, KEPT, tag == "header", tag in ("article", "main")
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """A tree of elements and undecoded text, by the tag and attribute rules of HTML; unclosed, crossed and stray tags
    are tolerated. The time grows with the page, not with its depth."""
    root = Node("#root", None)
    stack, open_ = [root], {}  # open elements, and the depths of those with each tag
    blocks_open: list[int] = [0]

    def depth(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            open_[tag].pop()
            if tag in BLOCK:
                blocks_open.pop()

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            _add_text(stack, cut, open_, page[at:])
            break
        if found.start() > at:
            _add_text(stack, cut, open_, page[at : found.start()])
        at = found.end()
        if found[3]:  # a comment, a declaration, or what HTML takes for a comment
            if page.startswith("--", at) and found[3] == "!":
                at = at + 3 if page.startswith("-->", at) else at + 4 if page.startswith("--->", at) else _COMMENT_END.search(page, at + 2).end()
            else:
                close = page.find(">", at)
                at = end if close < 0 else close + 1
            continue
        tag, attributes, closed = found[2].lower(), None, False
        while at < end and page[at] != ">":
            part = _ATTRIBUTE.match(page, at)
            if part.end() == at:
                at += 1
                continue
            if part[1]:
                attributes = attributes or {}
                attributes.setdefault(part[1].lower(), part[2] or part[3] or part[4] or "")
                closed = False
            else:
                closed = page[part.end() - 1] == "/"
            at = part.end()
        at += 1
        if found[1]:
            here = depth((tag,))
            if here and (blocks_open[-1] <= here if tag not in BLOCK else tag in CELLS or here > depth(CELLS) or tag in ("tr", "tbody", "thead", "tfoot", "body", "html")):
                cut(here)
            continue
        if "head" in open_ and open_["head"] and tag not in HEAD and tag != "head":
            cut(open_["head"][-1])
        if tag in BLOCK and tag not in INSIDE_P:
            paragraph = depth(("p",))
            if paragraph and paragraph > depth(("td", "th", "table", "button", "caption")):
                cut(paragraph)
        if tag in _SIBLINGS:
            tags, bounds = _SIBLINGS[tag]
            bound = depth(bounds)
            lowest = min((d for t in tags for d in open_.get(t, ())[-1:] if d > bound), default=0)
            if lowest:
                cut(lowest)
        node = Node(tag, stack[-1])
        _describe(node, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            close = -1 if stop is None else page.find(">", stop.start())
            at = end if close < 0 else close + 1
        elif tag not in VOID and not closed:
            open_.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks_open.append(len(stack))
            stack.append(node)
    return root


def _add_text(stack: list[Node], cut, open_: dict, text: str) -> None:
    if open_.get("head") and not text.isspace():
        cut(open_["head"][-1])
    stack[-1].children.append(text)


def _named(names: str) -> tuple[int, bool, bool]:
    """What class and id names say: (kind, whether the element is a header, whether it is an article)."""
    kind, header, article = KEPT, False, False
    for name in names.split():
        if name.lower() in UNSEEN:
            return GONE, False, False
        parts = {p.lower() for p in _PARTS.findall(name)}
        header |= bool(parts & {"header", "masthead"}) and parts <= FILLER | FURNITURE | {"header", "masthead"}
        article |= bool(parts & ARTICLE) and not parts & (NEVER | FURNITURE)
        if parts & NEVER:
            kind = max(kind, GONE if parts <= NEVER | FURNITURE | FILLER else DOUBT)
        elif parts & FURNITURE:
            kind = max(kind, WEAK if parts <= FURNITURE | FILLER else DOUBT)
    return kind, header, article


def _describe(node: Node, attributes: dict[str, str] | None) -> None:
    """Sets the generalised step and what is known of the element."""
    tag = node.tag
    if not attributes:
        node.kind = GONE if tag in DROPPED else WEAK if tag == "form" else KEPT
        return
    found = {k: entities.unescape(v) for k, v in attributes.items()}
    names = found.get("class", "")
    node.step = ".".join([tag, *sorted({_NUMBER.sub("#", c) for c in names.split()})]).replace("/", "|")
    role = found.get("role", "").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(found.get("style", ""))
    if tag in DROPPED or hidden or role in ROLES:
        node.kind = GONE
        return
    kind, header, article = _named(f"{names} {found.get('id', '')}") if tag not in ("html", "body") and tag not in HEADINGS else (KEPT, False, False)
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        kind, article = (GONE if kind == GONE else KEPT), True
    node.kind = max(kind, WEAK) if (tag == "form" or role == "form") and kind != GONE else kind
    node.header |= header
    node.marked |= article


def measure(root: Node) -> list[Node]:
    """Sets zone, text and links (characters outside and inside of links) and prose of all nodes but those that are
    gone; returns them in page order.

    The zone is WEAK below and at furniture, else KEPT. What is furniture counts for itself, not for what is around it.
    A container's prose is that of its own blocks, half that of the blocks of containers in it, a quarter of those of
    containers in these, less links; each character belongs to its nearest block. Of a header, only headings count.
    """
    order: list[Node] = []
    stack: list[tuple[Node, bool, bool, int]] = [(root, False, False, KEPT)]
    while stack:
        x, linked, header, zone = stack.pop()
        order.append(x)
        linked = linked or x.tag == "a"
        header = (header or x.header) and x.tag not in HEADINGS
        x.zone = max(zone, WEAK if x.kind == WEAK else KEPT)
        own = 0 if header else sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.text, x.links, x.prose = (0, own, 0.0) if linked else (own, 0, 0.0)
        for c in reversed(x.children):
            if not isinstance(c, str) and c.kind != GONE:
                stack.append((c, linked, header, x.zone))
    holder: dict[int, Node | None] = {id(root): None}  # the nearest container around each node, within its zone
    for x in order[1:]:
        up = x.parent
        holder[id(x)] = None if x.kind == WEAK else up if up.tag in CONTAINERS else holder[id(up)]
    near = {id(x): [x.text, x.links] for x in order}  # characters whose nearest block this is
    for x in reversed(order[1:]):
        if x.kind != WEAK and not (x.kind == DOUBT and x.links > x.text):
            x.parent.text += x.text
            x.parent.links += x.links
            if x.tag not in BLOCK:
                text, links = near.pop(id(x))
                near[id(x.parent)][0] += text
                near[id(x.parent)][1] += links
    for x in order:
        text, links = near.get(id(x), (0, 0))
        box, share = (x if x.tag in CONTAINERS else holder[id(x)]), 1.0
        while text > 2 * links and box is not None and share >= 0.25:
            box.prose += share * (text - 2 * links)
            box, share = holder[id(box)], share / 2
    for x in order:
        x.prose *= 2.0 if x.tag == "article" else 1.6 if x.tag == "main" else 1.0
    return order


def best(root: Node) -> Node | None:
    """The container with the most prose, the first in page order among equals, or the highest one around it that adds
    article text: more than two characters outside of links for each one inside. The body itself is never climbed to.

    Furniture by name is passed over, unless what is left has neither an article's name nor a main heading and holds
    less than half the prose of the furniture.
    """
    order = [x for x in measure(root) if x.tag in CONTAINERS and x.prose > 0]
    if not order:
        return None
    clean = max((x for x in order if x.zone == KEPT), key=lambda x: x.prose, default=None)
    node = max(order, key=lambda x: x.prose)
    if clean is not None and (clean.prose * 2 >= node.prose or _is_article(clean)):
        node = clean
    x, text, links = node.parent, node.text, node.links
    while x is not None and x.parent is not None and x.tag not in ("html", "body") and x.zone == node.zone:
        if x.kind != WEAK and x.text - text > 2 * (x.links - links):
            node, text, links = x, x.text, x.links
        x = x.parent
    return node


def _is_article(node: Node) -> bool:
    x: Node | None = node
    while x is not None:
        if x.marked:
            return True
        x = x.parent
    return bool(_headings([node], ("h1",)))


def _headings(nodes: list[Node], tags: tuple[str, ...]) -> list[Node]:
    """Headings below the nodes, in page order, that aren't furniture."""
    out, stack = [], list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x.tag in tags:
            out.append(x)
        stack += [c for c in reversed(x.children) if not isinstance(c, str) and c.kind < WEAK]
    return out


def blocks(node: Node) -> list[tuple[str, int, int]]:
    """(text, letters and digits outside of links, links) of the node's blocks in page order; of a header only the
    headings stay."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, len(_SIGNS.sub("", text)) - sum(len(_SIGNS.sub("", entities.unescape(x))) for x in linked), links))
        linked.clear()
        links = 0

    stack: list[tuple[Node | str | None, bool, bool]] = [(node, False, False)]
    while stack:
        x, in_header, in_link = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not in_header:
                held.append(x)
                if in_link:
                    linked.append(x)
        elif x is node or x.kind == KEPT or (x.kind == DOUBT and x.links <= x.text):
            if x.header and x is not node:
                in_header = True
            elif x.tag in HEADINGS:
                in_header = False
            if x.tag in BLOCK:
                flush()
                stack.append((None, False, False))
            elif x.tag == "br":
                held.append(" ")
            elif x.tag == "a":
                in_link = True
                links += 1
            stack += [(c, in_header, in_link) for c in reversed(x.children)]
    flush()
    return out


def path_of(node: Node) -> str:
    """Steps from the body down; html and body are left out."""
    steps = []
    while node.parent is not None:
        if node.tag not in ("html", "body"):
            steps.append(node.step)
        node = node.parent
    return "/".join(reversed(steps))


def at_path(root: Node, path: str) -> list[Node]:
    """The nodes with this path that hold an article's part, in page order, measured.

    Of several nodes, those that are mostly links are left out; and if their last step has no class, so are those with
    less than a quarter of the prose of the best. What is left out must leave something.
    """
    steps = path.split("/")
    out: list[Node] = []
    stack = [(root, 0)]
    while stack:
        x, n = stack.pop()
        if x.parent is not None and x.tag not in ("html", "body"):
            if x.step != steps[n]:
                continue
            n += 1
            if n == len(steps):
                out.append(x)
                continue
        stack += [(c, n) for c in reversed(x.children) if not isinstance(c, str) and c.kind != GONE]
    if len(out) > 1:
        bar = max(x.text for x in out) / 4 if "." not in steps[-1] else 0
        out = [x for x in out if x.text > 2 * x.links and x.text >= bar] or out
    return out


def _trimmed(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without a run of three links or more at either end."""

    def cut(rows: list) -> int:
        n = links = 0
        for text, outside, number in rows:
            if 5 * outside > len(text) or not number:
                break
            n, links = n + 1, links + number
        return n if links >= 3 and n < len(rows) else 0

    first = cut(found)
    return found[first : len(found) - cut(found[first:][::-1])]


def _heading_before(root: Node, nodes: list[Node]) -> list[Node]:
    """The page's one main heading, if it stands before the nodes and they have none of their own."""
    if any(_headings([x], ("h1", "h2")) for x in nodes):
        return []
    inside = {id(x) for x in nodes}
    found, stack = [], [(root, False)]
    while stack:
        x, header = stack.pop()
        if id(x) in inside:
            break
        if x.tag == "h1" and not header:
            found.append(x)
        stack += [(c, header or x.header) for c in reversed(x.children) if not isinstance(c, str) and c.kind < WEAK]
    return found if len(found) == 1 else []


def extract(page: str | None, path: str | None) -> str:
    """The main text of a page at its host's path; without it, or if nothing is there, at the path of the page's own
    best container."""
    if not page:
        return ""
    root = parse(page)
    own = best(root)  # measures the page
    for way in (path, path_of(own) if own is not None else None):
        nodes = at_path(root, way) if way else []
        text = _text_of(root, nodes)
        if text:
            return text
    return _text_of(root, [own if own is not None else root])


def _text_of(root: Node, nodes: list[Node]) -> str:
    found = [b for x in nodes for b in blocks(x)]
    if not found:
        return ""
    if not all(_is_article(x) for x in nodes):
        found = _trimmed(found)
    found = [b for x in _heading_before(root, nodes) for b in blocks(x)] + found
    return "\n".join(text for text, _, _ in found)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of the task's pages: host, path (empty without a container below the body), number of pages."""
    count: dict[tuple[str, str], int] = {}
    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            node = best(parse(page)) if page else None
            path = path_of(node) if node is not None else ""
            count[host, path] = count.get((host, path), 0) + 1
            if len(count) > 100_000:
                yield _counted(count)
                count = {}
    if count:
        yield _counted(count)
    release()


def _counted(count: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in count]), pa.array([p for _, p in count]), pa.array(count.values(), pa.int64())], names=["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
    release()


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path, pages: the path with most votes of each host, the longest and then the first by name among equals;
    empty where no page of the host has one."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    votes = rows.mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    top = F.max(F.struct((F.col("path") != "").alias("some"), "votes", F.length("path").alias("n"), "path"))
    return votes.groupBy("host").agg(top.alias("top"), F.sum("votes").alias("pages")).select("host", F.col("top.path").alias("path"), "pages")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text holds the blocks of the page's main container, one a line. A null or empty html gives an empty text; a null
    or hostless url votes under the empty host. Rows that repeat a page or an id each vote and get their row. A page is
    parsed whole, whatever its length and depth. Other columns are not read. Most hosts agree on one path: only those
    that don't are joined, broadcast if they are few enough, else with the pages of the largest hosts left in place.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    winners = staged(winning_paths(rows), "host-paths")
    common = winners.where("path <> ''").groupBy("path").count().orderBy(F.desc("count"), "path").limit(1).collect()
    usual = common[0]["path"] if common else ""
    other = winners.where(F.col("path") != usual)
    placed = rows.withColumn("host", host_of(F.col("url")))
    if other.count() <= BROADCAST_ROWS:
        placed = placed.join(F.broadcast(other.select("host", "path")), "host", "left")
    else:
        placed = attach(placed, other, "host", "pages", rows.count())
    return placed.select("page_id", "url", "html", F.coalesce("path", F.lit(usual)).alias("path")).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
