"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Every element has a density: characters
per tag, adjusted for the share of both that lies in links. The container whose
children's densities add up to most is the heart of the article. The least
density of what it lies in, up to the body, is the threshold: the other parts of
the page that reach it belong to the article too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import few_rows, ship

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
# The rest of a tag; a greater-than sign in quotes does not end it.
_REST = re.compile(r"((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Names of elements and of attributes' words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset(
    "article blockquote body center details div dl figure main ol section table tbody td tr ul".split()
)
_LEFT_OUT = frozenset("aside button canvas dialog footer head label legend menu nav audio video object".split())
_CLOSES = {
    **{name: frozenset(["p"]) for name in _BLOCK - {"body", "html"}},
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "option": frozenset(["option"]),
}
_ENDED = frozenset("p li dt dd tr td th option".split())
_SCOPE = frozenset("table ul ol dl div section article main body html td th blockquote".split())
# What an element without its end tag ends at, as no such element can hold it.
_BEYOND = rf"<(?:{'|'.join(sorted(_BLOCK))}|input|select|textarea|svg)(?=[\s/>])"
_FOREIGN = re.compile(r"<(?:foreignobject|desc|title)(?=[\s/>])", re.I)
# "has-sidebar" says that something else is the sidebar.
_MENTION = re.compile(r"(?<![^\s_-])(?:has|no|with|without)[_-]\S*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_EDGE = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
_OTHER = re.compile(
    _EDGE.format(
        r"nav|navbar|navigation|menu|masthead|footer|sidebar|aside|ad|ads|adv|advert\w*|sponsor\w*|cookies?|consent|gdpr|"
        r"popup|modal|overlay|newsletter|subscri\w*|related|recommend\w*|comments?|commentlist|disqus|respond|"
        r"repl(?:y|ies)|breadcrumbs?|pagination|pager|login|signup|toolbar|skip|hidden"
    ),
    re.I,
)
# Words that stand for a part of a page as well as for what a page is about.
_PERHAPS = re.compile(_EDGE.format(r"header|banner|promo\w*|notices?|share|sharing|social|discussion|widgets?"), re.I)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())


class _Node:
    __slots__ = ("name", "parent", "children", "skip", "chars", "tags", "link_chars", "link_tags", "density", "sum", "blocks", "heart", "named", "inside", "near")

    def __init__(self, name: str, parent: _Node | None, skip: bool) -> None:
        self.name, self.parent, self.skip = name, parent, skip
        self.children: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.blocks = 0
        self.density = self.sum = 0.0
        self.heart: _Node | None = None
        self.named = 0  # 1: perhaps something else than the article, by class, id or as a form; 2: surely
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        # Itself or the next element above that a tag can end without saying so, or that keeps it from that.
        self.near: _Node | None = self if name in _ENDED or name in _SCOPE else parent.near if parent else None


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    body = _tree(page)
    _judge_names(body)
    _weigh(_order(body), body)
    return "\n\n".join(block for part in _article(body) for block in _blocks(part))


def _order(body: _Node) -> list[_Node]:
    """The elements of a page that count, outer ones first."""
    order = [body]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, _Node) and not c.skip)
    return order


def _tags(page: str, jump: list[int]) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of each tag; comments and the like have no name.

    One pass, whatever the markup: a tag whose quotes are never closed ends, as
    all later ones do, at the next greater-than sign; without one the rest is
    text. The reader may set ``jump[0]`` to go on from there.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        name, slash, attributes = "", "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            end = len(page) if end == 2 else end
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
        elif match := _NAME.match(page, start + 1):
            slash, name = match[1], match[2].lower()
            rest = _REST.match(page, match.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.find(">", match.end()) + 1
            attributes = page[match.end() : end - 1]
        else:
            at = start + 1
            continue
        if not end:
            return
        jump[0] = end
        yield start, end, slash, name, attributes
        at = jump[0]


def _tree(page: str) -> _Node:
    root = node = _Node("body", None, False)
    missing: set[str] = set()
    open_ = _Open()
    jump, at = [0], 0
    for start, end, slash, name, attributes in _tags(page, jump):
        if start > at:
            node.children.append(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            node = open_.close(node, name)
            continue
        if name in _RAW:
            if not (name == "svg" and attributes.endswith("/")):
                at = jump[0] = _end(page, name, at, missing)
            continue
        if name in ("html", "body"):
            continue
        if name == "br":
            node.children.append("\n")
            continue
        if name == "hr":
            node.children.append(_Node("hr", node, False))
            continue
        if name in _VOID:
            continue
        if closes := _CLOSES.get(name):
            node = open_.up(node, _implied(node, closes))
        node.children.append(child := _Node(name, node, _is_other(name, attributes, node)))
        child.named = max(_named(attributes), name == "form")
        if not attributes.endswith("/"):
            node = open_.enter(child)
    if at < len(page):
        node.children.append(page[at:])
    return root


class _Open:
    """Which elements are open, so that an end tag without its start costs nothing."""

    def __init__(self) -> None:
        self.blocks: Counter[str] = Counter()
        self.lines: list[Counter[str]] = [Counter()]  # elements within lines, by the block that holds them

    def enter(self, node: _Node) -> _Node:
        if node.name in _BLOCK:
            self.blocks[node.name] += 1
            self.lines.append(Counter())
        else:
            self.lines[-1][node.name] += 1
        return node

    def up(self, node: _Node, to: _Node) -> _Node:
        """Leave the elements from ``node`` up to below ``to``."""
        while node is not to:
            if node.name in _BLOCK:
                self.blocks[node.name] -= 1
                self.lines.pop()
            else:
                self.lines[-1][node.name] -= 1
            node = node.parent
        return node

    def close(self, node: _Node, name: str) -> _Node:
        """Back to the parent of the open element of that name, if there is one; lines do not end blocks."""
        if not (self.blocks if name in _BLOCK else self.lines[-1])[name]:
            return node
        up = node
        while up.name != name:
            up = up.parent
        return self.up(node, up.parent)


def _end(page: str, name: str, at: int, missing: set[str]) -> int:
    """Where the content of an element ends of which nothing is read.

    Scripts and the like without an end tag reach to the end of the page, as in
    browsers; a form field, title or drawing ends where a block begins.
    ``missing`` keeps the names that have no end tag from here on.
    """
    stop = len(page)
    if name in ("title", "svg", "select"):
        first = re.compile(rf"(</{name}\s*>)|{_BEYOND}", re.I).search(page, at)
        if first is None:
            return stop
        if first[1]:
            return first.end()
        stop = first.start()
        if name != "svg" or first[0].lower() != "<svg" and not _FOREIGN.search(page, at, stop):
            return stop
    end = None if name in missing else re.compile(rf"</{name}\s*>", re.I).search(page, at)
    if end:
        return end.end()
    missing.add(name)
    # These two may hold any block; without an end tag they are left open.
    return at if name in ("noscript", "template") else stop


def _judge_names(body: _Node) -> None:
    """Leave out the parts of the page that class or id name something else, and forms.

    A name counts less than what is there. If such parts alone hold article or
    main elements, these parts stay. What is perhaps something else stays if the
    heart of the rest of the page lies in it, a form only if it holds prose. What
    surely is stays if the heart of the whole page lies in it and no part of the
    page outside reaches the threshold.
    """
    order = _order(body)
    holds: set[_Node] = set()
    outside = False
    free = {body: True}  # whether nothing above is named
    for node in order[1:]:
        up = node.parent
        free[node] = free[up] and not (up.named and up.name not in ("article", "main"))
        if node.name in ("article", "main") and not node.named:
            holds.add(node)
            outside = outside or free[node]
    for node in reversed(order):
        if node in holds and node.parent is not None:
            holds.add(node.parent)
    named = [n for n in order if n.named and n.name not in ("article", "main") and (outside or n not in holds)]
    if not named:
        return
    surely = [n for n in named if n.named == 2]
    if surely:
        _weigh(order, body)
        path = list(_path(body.heart)) if body.heart else []
        kept = {n for n in path if n.named == 2}
        if kept:
            top = next(n for n in reversed(path) if n in kept)
            least = min(n.density for n in path)
            # Does the method find an article beside the part that holds the heart?
            beside = any(n.density >= least and n.density for n in _beside(body, top, set(path)))
            kept = set() if beside else kept
        for node in surely:
            node.skip = node not in kept
    _weigh(_order(body), body)
    kept = set(_path(body.heart)) if body.heart else set()
    for node in named:
        if node.named == 1:
            node.skip = node not in kept or node.name == "form" and not any(n.name in _PROSE for n in _order(node))


def _beside(body: _Node, part: _Node, path: set[_Node]) -> Iterator[_Node]:
    """The elements outside ``part``, as far as they are not named themselves."""
    todo = [body]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, _Node) and not child.skip and child is not part and child.named < 2:
                if child not in path:
                    yield child
                todo.append(child)


def _implied(node: _Node, closes: frozenset[str]) -> _Node:
    """Where a new element stands that ends others without saying so, such as a paragraph."""
    up, out = node.near, node
    while up is not None and up.parent is not None:
        if up.name in closes:
            out = up.parent
        elif up.name in _SCOPE:
            break
        up = up.parent.near
    return out


def _is_other(name: str, attributes: str, parent: _Node) -> bool:
    """Whether an element is something other than the article by its name or attributes."""
    if name in _LEFT_OUT or name == "header" and not parent.inside:
        return True
    if not attributes or name in ("article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in _ROLES or key == "hidden":
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(attributes: str) -> int:
    """Whether class or id name something other than an article: 0 no, 1 perhaps, 2 surely."""
    found = 0
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        if key.lower() in ("class", "id"):
            value = _MENTION.sub(" ", value.strip("\"'"))
            found = max(found, 2 if _OTHER.search(value) else 1 if _PERHAPS.search(value) else 0)
    return found


def _weigh(order: list[_Node], body: _Node) -> None:
    """Densities of all elements, their sums over children, and the container of the largest sum in each."""
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = node.blocks = 0
        node.density = node.sum = 0.0
        node.heart = None
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.blocks += node.blocks + (node.name in _BLOCK)
    links = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        node.density = _density(node, links)
        if node.name in _CONTAINER and node.chars and (node.heart is None or node.sum >= node.heart.sum):
            node.heart = node
        if node.parent is not None:
            up = node.parent
            up.sum += node.density
            if node.heart and (up.heart is None or node.heart.sum >= up.heart.sum):
                up.heart = node.heart


def _density(node: _Node, links: float) -> float:
    chars, tags = node.chars, max(node.tags, 1)
    if not chars:
        return 0.0
    linked, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(chars - node.link_chars, 1)
    base = math.log(chars / plain * node.link_chars + links * chars + math.e)
    return chars / tags * max(math.log(chars / linked * tags / link_tags) / math.log(base + 1.0), 0.0)


def _article(body: _Node) -> list[_Node]:
    """The parts of the article in page order.

    The threshold is the least density on the way from the heart up to the body.
    If the heart lies in an article element, this and all others that reach the
    threshold are taken. Else the page is searched from the main element down, or
    from the body: of a part that reaches the threshold its own heart is taken as
    a whole, and what lies around that as far as it reaches the threshold.
    """
    best = body.heart
    if best is None:
        return []
    path = list(_path(best))
    links = body.link_chars / max(body.chars, 1)
    outer = next((n for n in reversed(path) if n.name == "article"), None)
    if outer is not None:
        least = min(n.density for n in path)
        return [n for n in _outermost(body, "article") if n is outer or n.chars and n.density >= least]
    root = next((n for n in reversed(path) if n.name == "main"), body)
    if best is body:
        return _prose(body, links)
    if best is root:
        return [root]
    path = path[: path.index(root) + 1]
    least = min(node.density for node in path[1:])
    above, hearts, parts = set(path[1:]), {best}, []
    stack: list[_Node] = [root]
    while stack:
        node = stack.pop()
        reaches = node.chars and node.density >= least
        if reaches and node not in above and node not in hearts and node.heart not in (None, node):
            hearts.add(node.heart)
            for up in _path(node.heart.parent):
                above.add(up)
                if up is node:
                    break
        if node in hearts or reaches and node not in above:
            parts.append(node)
        elif node in above or node.blocks:
            stack.extend(reversed(list(_pieces(node, above, links))))
    return parts


def _outermost(body: _Node, name: str) -> Iterator[_Node]:
    """The elements of a name in page order that lie in no other of that name."""
    todo = [body]
    while todo:
        node = todo.pop()
        if node.name == name:
            yield node
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, _Node) and not c.skip)


def _prose(body: _Node, links: float) -> list[_Node]:
    """Of paragraphs that lie in the body itself: from the first dense piece to the last.

    Dense is what has half the density of the average character, or more;
    paragraphs and headings next to the first and the last go with them. In
    between, what has more links than text of its own is left out.
    """
    pieces = [p for p in _pieces(body, set(), links) if p.chars]
    least = sum(p.density * p.chars for p in pieces) / (2 * max(body.chars, 1))
    dense = [i for i, p in enumerate(pieces) if p.density >= least]
    if not dense:
        return []
    first, last = dense[0], dense[-1]
    plain = [p.name in _PROSE and 2 * p.link_chars <= p.chars for p in pieces]
    while first and plain[first - 1]:
        first -= 1
    while last + 1 < len(pieces) and plain[last + 1]:
        last += 1
    return [p for p in pieces[first : last + 1] if p.density >= least or 2 * p.link_chars <= p.chars]


def _pieces(node: _Node, above: set[_Node], links: float) -> Iterator[_Node]:
    """The elements in a node; text and elements within lines that follow each other are one."""
    run: list[_Node | str] = []
    for child in [*node.children, None]:
        if isinstance(child, str) or child and (child.skip or not (child.name in _BLOCK or child.blocks or child in above)):
            run.append(child)
            continue
        if run:
            line = _Node("p", node, False)
            line.children = run
            for c in run:
                if isinstance(c, str):
                    line.chars += len("".join(c.split()))
                elif not c.skip:
                    line.chars += c.chars
                    line.tags += c.tags + 1
                    line.link_chars += c.link_chars
                    line.link_tags += c.link_tags
            line.density = _density(line, links)
            yield line
            run = []
        if child is not None:
            yield child


def _path(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _blocks(article: _Node) -> Iterator[str]:
    held: list[str] = []

    def flush() -> Iterator[str]:
        if text := " ".join(html.unescape("".join(held)).split()):
            yield text
        held.clear()

    stack: list[tuple[_Node, int]] = [(article, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.name in _BLOCK:
            yield from flush()
        for i in range(i, len(node.children)):
            child = node.children[i]
            if isinstance(child, str):
                held.append(child)
            elif not child.skip:
                stack.append((node, i + 1))
                stack.append((child, 0))
                break
        else:
            if node.name in _BLOCK:
                yield from flush()
    yield from flush()


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each of ``pages``.

    A null, empty or text-free page gives an empty text, an empty table no row.
    Equal pages give equal texts, and repeated rows stay. Equal sums are decided
    by page order, outer element first. Pages of any length are read whole, in
    time that grows with their length. Other columns are ignored.
    """
    ship(pages.sparkSession)
    read = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return read.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
