"""Main text of web pages by tree scoring.

Markup is read into a tree as browsers would (unclosed paragraphs, stray end tags and truncated pages included), and
subtrees that hold menus, adverts, notices, forms, code or reader comments by their tag, role or class are cut; a class
cuts nothing that has a name of main text beside it or most of the page's paragraphs in it. Each
paragraph's points, from its length and commas, go to all its ancestors, less with each level (wrappers that add no
paragraph are one level); a container's points are
discounted by the share of its text that is links. The best container is kept with siblings that score alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, spread

# Names of elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math xmp noembed noframes select canvas audio video".split())
CUT = frozenset("button label datalist output progress meter head map".split())
DOUBTED = frozenset("nav aside footer form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body".split())
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": set(), "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent
    cookie cookies copyright disqus dropdown footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices
    outbrain overlay pager pagination popup popular promo promoted promotion recommended related replies respond search share sharing shoutbox
    sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar trending widget widgets""".split()
)
GOOD = frozenset("article articlebody body content entry hentry main maincontent page post story text".split())
#: Of an element with one of these names, no share of the page's paragraphs makes main text.
NEVER = frozenset("comment comments commentlist consent cookie cookies disqus gdpr hidden replies respond".split())
#: What follows these in a class says what is beside the element, or isn't there.
MODIFIERS = frozenset("no not with without has".split())
MOST, LEAST_PARAGRAPHS = 0.75, 3
#: Parts of a name that say nothing of what an element holds.
PLAIN = frozenset("area box container form inner item items list outer section thread wrap wrapper".split())
#: Siblings of the best container are kept from this share of its points, or if they are prose: at most this share in links.
ALIKE, PROSE_LINKS = 0.2, 0.25

#: A quote opens a value behind an equals sign alone; `<!-->` is a whole comment.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_PART = re.compile(r"[A-Za-z]+")
_COMMA = re.compile("[,،、，]")
_SENTENCE = re.compile("[.!?…:;。！？；：][\"'”’»)\\]]*$")


class Node:
    __slots__ = ("children", "links", "parent", "points", "size", "tag", "names", "cut", "good", "role")

    def __init__(self, tag: str, parent: "Node | None", names: frozenset[str] = frozenset(), cut: bool = False, good: bool = False, role: bool = False) -> None:
        self.tag, self.parent, self.names, self.cut, self.good, self.role = tag, parent, names, cut, good, role
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0


def _attributes(text: str) -> tuple[frozenset[str], bool, bool, bool]:
    """Parts of class and id, whether an attribute alone cuts the element, whether a class or id names main text alone, and
    whether a role puts it in doubt."""
    if not text or "=" not in text and "hidden" not in text.lower():
        return frozenset(), False, False, False
    rest = _ATTRIBUTE.sub(" ", text).lower()
    names, good, role, cut = set(), False, False, bool(re.search(r"(?:^|[\s/])hidden(?:[\s/]|$)", re.sub(r"[\"'].*", "", rest, flags=re.S)))
    for name, *values in _ATTRIBUTE.findall(text):
        value, name = "".join(values), name.lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = [x.lower() for x in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one))]
                parts = parts[: next((i for i, x in enumerate(parts) if x in MODIFIERS), len(parts))]
                names.update(parts)
                good |= not GOOD.isdisjoint(parts) and NAMES.isdisjoint(parts)
        elif name == "hidden":
            cut = True
        elif name == "role":
            role |= value.strip().lower() in ROLES
        elif name == "aria-hidden":
            cut |= value.strip().lower() == "true"
        elif name == "style":
            cut |= "display:none" in value.replace(" ", "").lower()
    return frozenset(names), cut, good, role


def parse(text: str) -> Node:
    root = Node("#root", None)
    at, pos = root, 0

    def close(upto: Node) -> None:
        nonlocal at
        at = upto.parent or root

    while True:
        m = _TOKEN.search(text, pos)
        if (end := m.start() if m else len(text)) > pos:
            if at.tag not in ("table", "tbody", "tr") or text[pos:end].strip():
                at.children.append(html.unescape(text[pos:end]))
        if not m:
            return root
        pos = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, ending = tag.lower(), m[1]
        if ending:
            if tag == "br":
                at.children.append(Node("br", at))
                continue
            node = at
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag doesn't close blocks
                    node = root
                    break
                node = node.parent
            if node is not root:
                close(node)
            continue
        if text.endswith(m[0]) and pos == len(text) and not m[0].endswith(">"):
            return root  # the page ends inside a tag
        names, cut, good, role = _attributes(m[3] or "")
        if tag in RAW:
            if not m[0].endswith("/>") or tag in ("script", "style", "textarea", "title"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, pos)
                pos = stop.end() if stop else len(text)
            continue
        if tag in CLOSES_P:
            node = at
            while node is not root and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                close(node)
        if tag in CLOSED_BY_LIKE:
            node, found = at, None
            while node is not root and node.tag not in STOPS[tag]:
                if node.tag in CLOSED_BY_LIKE[tag]:
                    found = node
                node = node.parent
            if found:
                close(found)
        if tag in ("html", "body") and any(n.tag == tag for n in _up(at)):
            continue
        node = Node(tag, at, names, cut, good, role)
        at.children.append(node)
        if tag not in VOID and not m[0].endswith("/>") or tag in BLOCK - VOID:
            at = node


def _up(node: Node) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _is_cut(node: Node) -> bool:
    """What is no main text wherever it stands. What else may be none by its tag, role or name, _prune decides."""
    return node.cut or node.tag in CUT or node.tag == "article" and bool(node.names & {"comment", "comments", "ad", "advert", "promo"})


def _doubt(node: Node) -> str:
    """Why an element may be none of the main text: its tag (or role), its name, or one of NEVER; blank if nothing says so."""
    if node.tag in ("html", "body", "main", "article"):
        return ""
    in_article = lambda: any(n.tag in ("article", "main") for n in _up(node))  # noqa: E731  asked of headers alone: pages can be deep
    if node.tag in DOUBTED or node.role or node.tag == "header" and not in_article():
        return "tag"
    if node.tag == "header" or node.good:
        return ""
    if node.names & NAMES:
        return "never" if node.names & NEVER else "name"
    return "name" if "header" in node.names and not node.names & GOOD and not in_article() else ""


def _drop(root: Node, is_cut) -> list[Node]:
    """Cuts subtrees; the elements left, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not is_cut(c)]
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def _prune(root: Node) -> None:
    """Cuts elements that a tag, role or name makes doubtful, unless they hold the page's main text.

    One that holds at least three paragraphs and MOST of the points of all is spared if only its name is in doubt, and
    otherwise if it has a heading or article in it. Where no paragraph, article or heading is outside of all doubtful
    elements, the one of three paragraphs that says most for itself is spared, and the same is asked inside it; one that
    is named for comments, cookies or hidden things alone isn't.
    """
    order = _drop(root, _is_cut)
    doubts = {n: d for n in order if (d := _doubt(n))}
    if not doubts:
        return
    _measure(root)
    own: dict[Node, list[float]] = {}
    marked: set[Node] = set()
    for text, owner in blocks(root):
        if _is_paragraph(text, owner) and density(owner) < 0.5:
            held = own.setdefault(owner, [0, 0.0])
            held[0], held[1] = held[0] + 1, held[1] + _worth(text)
    alone = {n: list(x) for n, x in own.items()}
    for node in reversed(order):  # sums of subtrees
        if node.parent and node in own:
            held = own.setdefault(node.parent, [0, 0.0])
            held[0], held[1] = held[0] + own[node][0], held[1] + own[node][1]
        if node.parent and (node in marked or node.tag in ("h1", "main") or node.tag == "article" and not node.names & NEVER) and not node.names & NEVER:
            marked.add(node.parent)
    least = MOST * own[root][1] if root in own else 0.0
    spared = {n for n, d in doubts.items() if n in own and own[n][0] >= LEAST_PARAGRAPHS and own[n][1] >= least and (d == "name" or n in marked)}

    def within(start: Node) -> tuple[list[Node], bool]:
        """The next doubtful elements inside, and whether there is a paragraph, article or heading outside of them."""
        found, free, todo = [], False, [start]
        while todo:
            node = todo.pop()
            if node is not start and node in doubts and node not in spared:
                found.append(node)
                continue
            free |= node in alone or bool(node.size) and node.tag in ("article", "main", "h1")
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return found, free

    if alone:
        says = lambda n: (n in marked, bool(n.names & GOOD), own[n][1])
        outer, free = within(root)
        while not free:
            able = [n for n in outer if n in own and own[n][0] >= LEAST_PARAGRAPHS and (doubts[n] != "never" or n.names - NAMES - PLAIN or n in marked)]
            if not able:
                break
            best = max(able, key=says)
            spared.add(best)
            inner, free = within(best)
            outer = [n for n in outer if n is not best] + inner
    _drop(root, lambda n: n in doubts and n not in spared)
    menus = {n for n in spared if doubts[n] == "tag"}
    if menus:  # links that stand in them are still menus
        _measure(root)
        links = {c for n in menus for c in n.children if isinstance(c, Node) and c not in own and c.size and density(c) >= 0.5}
        _drop(root, lambda n: n in links)


def _is_paragraph(text: str, owner: Node) -> bool:
    return len(text) >= 25 and owner.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "#root")


def _worth(text: str) -> float:
    return 1 + len(_COMMA.findall(text)) + min(3, len(text) // 100)


def blocks(*nodes: Node) -> list[tuple[str, Node]]:
    """Texts of blocks in page order, white space made single blanks, with the block's element."""
    out: list[tuple[str, Node]] = []
    held: list[str] = []
    owner = nodes[0] if nodes else None

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append((text, owner))
        held.clear()

    todo: list = [(n, None) for n in reversed(nodes)]
    while todo:
        x, end = todo.pop()
        if end is not None:
            flush()
            owner = end
        elif isinstance(x, str):
            held.append(x)
        elif x.tag in ("br", "wbr"):
            held.append(" " if x.tag == "br" else "")
        elif x.tag in BLOCK or x in nodes:
            flush()
            todo.append((None, owner))
            owner = x
            todo += [(c, None) for c in reversed(x.children)]
        else:
            todo += [(c, None) for c in reversed(x.children)]
    flush()
    return out


def _measure(root: Node) -> None:
    """Characters of text, and those in links, of every element."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.size = own + sum(c.size for c in node.children if isinstance(c, Node))
        node.links = node.size if node.tag == "a" else sum(c.links for c in node.children if isinstance(c, Node))


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def candidates(root: Node) -> tuple[dict[Node, float], dict[Node, int]]:
    """Points by container, and its paragraphs: a paragraph's whole points to its parent, half to the next level, a third of a half and less above.

    A level ends where an ancestor has more paragraphs. An article, or a main element without one, is a container that the
    author marked: it gets whole points from any depth, and a start. Headings and blocks under 25 characters give none
    (they stay where the container stays). Of containers with equal points the first that got some is the best.
    """
    points: dict[Node, float] = {}
    found = []
    paragraphs: dict[Node, int] = {}
    for text, owner in blocks(root):
        if not _is_paragraph(text, owner):
            continue
        above = [n for n in _up(owner.parent if owner.tag in ("p", "pre", "blockquote", "li", "td", "dd") and owner.parent else owner) if n.tag not in ("#root", "html")]
        found.append((_worth(text), above))
        for node in above:
            paragraphs[node] = paragraphs.get(node, 0) + 1
    for own, above in found:
        level, marked = 0, False
        for below, node in zip([None, *above], above, strict=False):
            level += below is not None and paragraphs[node] > paragraphs[below]
            whole = node.tag == "article" or node.tag == "main" and not marked
            marked |= whole
            bonus = 0.0 if node in points else (25.0 if node.names & GOOD else 0.0) + (40.0 if whole else 0.0)
            points[node] = points.get(node, 0.0) + bonus + own / (1 if level == 0 or whole else 2 if level == 1 else level * 3)
    return {n: p * (1 - density(n)) for n, p in points.items()}, paragraphs


def _is_prose(node: Node) -> bool:
    """Few links, and of blocks that are sentences, or long, at least half the text."""
    if not node.size or density(node) >= PROSE_LINKS:
        return False
    texts = [t for t, _ in blocks(node)]
    said = sum(len(t) for t in texts if _SENTENCE.search(t) or len(t) > 80)
    return 2 * said >= sum(map(len, texts)) > 0


def extract(page: str | None) -> str:
    """Blocks of the main text joined by two line ends; empty for a page without text."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    _prune(root)
    _measure(root)
    points, paragraphs = candidates(root)
    if points:
        best = max(points, key=lambda n: points[n])
        least = ALIKE * points[best]
        kept = []
        for c in best.parent.children if best.parent else [best]:
            if c is best:
                kept.append(c)
            elif isinstance(c, Node):
                alike = points.get(c, 0.0) > 0 and (points[c] >= least or c.names and c.names == best.names)
                if alike or _is_prose(c) or c.tag == "h1":
                    kept.append(c)
        top = best  # siblings that score alike can lie beside the wrappers of the best
        while top.parent in paragraphs and paragraphs[top.parent] == paragraphs.get(best):
            top = top.parent
        if top is not best and top.parent:
            beside = [c is top or isinstance(c, Node) and points.get(c, 0.0) >= least for c in top.parent.children]
            at = next(i for i, c in enumerate(top.parent.children) if c is top)
            own = [c for c, x in zip(top.parent.children, beside, strict=True) if x]
            kept = [*own[: sum(beside[:at])], *kept, *own[sum(beside[:at]) + 1 :]]
        found = blocks(*kept)
    else:
        inner = [n for n in _all(root) if n.tag in ("article", "main")] or [n for n in _all(root) if n.tag == "body"] or [root]
        found = [(t, n) for t, n in blocks(inner[0]) if density(n) < 0.5]
    return "\n\n".join(t for t, _ in found)


def _all(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points). Null and empty pages have an empty text; repeated rows stay.

    Pages of any length are read whole, equal pages alike; no rows give none; other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return spread(rows).mapInArrow(judge, "id long, url string, text string, n_chars long")
