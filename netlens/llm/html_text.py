"""Main text of a web page by tree scoring.

Each paragraph gives points, by its length and its commas, to its container in full and to the
container above by half. A container's points are discounted by its link density. The container
with most points is kept; with it, of the article or main element that it stands in (or of the
smallest element that holds nearly all unlinked points), the headings and all blocks with few
links, and those siblings of that element that score well themselves or are plain paragraphs with
few links. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are left out before scoring, by element or by the words of class and id.

The words only mark candidates. A marked element stays if it is or holds an article or main
element, or holds most of the page's unlinked paragraph points (beside an article: in three or more
paragraphs); scoring discounts what stays beside an article. Forms, asides and headers are
candidates in the same way, always with three or more paragraphs: some pages stand in one form. The
controls in them go. Within an article only the points count. Comments go where an article has
other paragraphs, and beside one where any unmarked element has, whatever their points. If
nothing is left, the words do not count.

Every step is linear in the page, however deep its elements nest.

Within a block, white space becomes one space; blocks are joined by one line feed. A null, empty
or textless page gives the empty text. Page and url pass unchanged, repeated rows stay.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import map_batches

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "audio button canvas dialog embed footer head iframe input label legend math menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
#: Left out as well, but for one that holds the article.
CANDIDATES = frozenset("aside fieldset form header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
#: An open element of the left is closed by a start tag of the right.
CLOSES = {
    "p": BLOCK - {"body", "html"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: By tag: the open elements that its start closes.
CLOSED_BY = {tag: frozenset(k for k, v in CLOSES.items() if tag in v) for tag in frozenset().union(*CLOSES.values())}
#: Implied ends do not reach beyond these.
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
#: Words of class, id and role that mark what is no article text.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|related|replies|respond|"
    r"share|sharing|shoutbox|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Class, id or role of what readers say about an article.
COMMENTS = re.compile(
    r"(?:^|\s)(?:comments?(?:[_-](?:area|body|container|content|form|list|section|thread|wrap|wrapper))?|disqus(?:[_-]thread)?|"
    r"replies|respond|shoutbox)(?:$|\s)",
    re.IGNORECASE,
)
#: What a marked element's points count that stays beside an article, or for the lesser articles in it.
DISCOUNT = 0.5
#: Paragraphs that a marked element beside an article needs to stay for its points; an advert has one.
LEAST_PARAGRAPHS = 3
#: Share of the unlinked points that is nearly all of them.
NEARLY_ALL = 0.9
#: Elements that are part of the text that holds them.
PARTS = PARAGRAPH | frozenset("center dl dt details figure h1 h2 h3 h4 h5 h6 hgroup ol section table tbody tfoot th thead tr ul".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "words", "marked", "weight", "place")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, words: str = "", place: int = 0):
        self.tag, self.parent, self.dropped, self.place = tag, parent, dropped, place
        self.words = words  # of class, id and role, if they mark the element
        self.marked = bool(words) or tag in CANDIDATES
        self.weight = 1.0
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """The element tree of a page, with implied end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.nodes = [self.root]  # in page order
        self.open: Counter[str] = Counter()

    def up(self) -> list[int]:
        """Place of each node's parent; the root is its own."""
        return [0 if n.parent is None else n.parent.place for n in self.nodes]

    def _close(self, node: Node) -> None:
        """End all open elements up to and with ``node``."""
        last = node.parent
        while self.at is not last:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        closed = CLOSED_BY.get(tag, frozenset())
        if any(self.open[t] for t in closed):
            node = self.at
            while node.parent is not None and (node.tag == tag or node.tag not in SCOPE or node.tag in CLOSES):
                if node.tag in closed:
                    self._close(node)
                    break
                if node.tag in SCOPE:
                    break
                node = node.parent
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        dropped = self.at.dropped or tag in DROPPED or hidden
        child = Node(tag, self.at, dropped, words if words and BOILERPLATE.search(words) else "", len(self.nodes))
        self.at.children.append(child)
        self.nodes.append(child)
        if tag not in VOID:
            self.open[tag] += 1
            self.at = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in ("article", "main", "td", "th") and tag not in BLOCK:
                return
            node = node.parent
        if node.parent is not None:
            self._close(node)

    def handle_data(self, data):
        self.at.children.append(data)


def _blocks(top: Node) -> list[tuple[Node, str, int]]:
    """The text blocks below a node in page order: the block element, its text, letters in links."""
    found: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    owners = [top]  # the open block elements

    def end():
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((owners[-1], text, linked))
        parts.clear()
        linked = 0

    # (node, position in its children, inside a link); no recursion, pages may nest deeply
    stack: list[tuple[Node, int, bool]] = [(top, 0, False)]
    while stack:
        node, i, link = stack.pop()
        if i == len(node.children):
            if node is owners[-1]:
                end()
                owners.pop()
            continue
        stack.append((node, i + 1, link))
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
            linked += len(child.strip()) if link else 0
        elif child.tag == "br":
            parts.append(" ")
        elif not child.dropped:
            if child.tag in BLOCK:
                end()
                owners.append(child)
            stack.append((child, 0, link or child.tag == "a"))
    return found


def _containers(tree: Tree, up: list[int]) -> tuple[list[int], list[int]]:
    """For each node the element that holds it as a paragraph (a block that is no paragraph holds its
    own text), and the block element above it."""
    above, box = [0] * len(up), [0] * len(up)
    for i, n in enumerate(tree.nodes[1:], 1):
        above[i] = up[i] if tree.nodes[up[i]].tag in BLOCK or up[i] == 0 else above[up[i]]
        box[i] = box[above[i]] if n.tag in PARAGRAPH else i
    return box, above


def _score(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _drop_marked(tree: Tree) -> None:
    """Drop the elements that their words or tags mark, but those that hold the article."""
    if not any(n.marked and not n.dropped for n in tree.nodes):
        return
    up = tree.up()
    article, inside, comment, marked = ([False] * len(up) for _ in range(4))  # is one, or stands in one
    for i, n in enumerate(tree.nodes[1:], 1):
        article[i] = article[up[i]] or n.tag == "article"
        inside[i] = article[i] or inside[up[i]] or n.tag == "main"
        own = n.tag != "main" and (n.tag != "article" or article[up[i]]) and COMMENTS.search(n.words)
        comment[i] = comment[up[i]] or bool(own)
        marked[i] = marked[up[i]] or n.marked
    points, paragraphs = [0.0] * len(up), [0] * len(up)
    shown = told = other = False  # an article has text, or paragraphs, outside comments; unmarked elements have paragraphs
    for owner, text, linked in _blocks(tree.root):
        i = owner.place
        by_article = inside[i] and not comment[i]
        shown = shown or (by_article and not (marked[i] and owner.tag in CANDIDATES))
        if owner.tag not in HEADINGS:
            own_points = _score(text) * (1 - min(1.0, linked / len(text)))
            points[i] += own_points
            paragraphs[i] += 1
            told = told or (by_article and own_points > 0)
            other = other or (not marked[i] and own_points > 0)
    holds_main, holds_article = ([not n.dropped and n.tag == t for n in tree.nodes] for t in ("main", "article"))
    for i in range(len(up) - 1, 0, -1):
        points[up[i]] += points[i]
        paragraphs[up[i]] += paragraphs[i]
        if not tree.nodes[i].dropped:
            holds_main[up[i]] |= holds_main[i]
            holds_article[up[i]] |= holds_article[i]
    for i, n in enumerate(tree.nodes[1:], 1):
        n.dropped = n.dropped or n.parent.dropped
        n.weight = n.parent.weight
        if n.dropped or not n.marked or holds_main[i]:
            continue
        if comment[i] and (told or (other and not inside[i])):
            n.dropped = True
        elif n.tag != "article" and (not holds_article[i] or article[up[i]] or 2 * points[i] <= points[0]):
            enough = paragraphs[i] >= LEAST_PARAGRAPHS or (not shown and n.tag not in CANDIDATES)
            most = 2 * points[i] > points[0] and enough
            n.dropped = not most and (not holds_article[i] or article[up[i]])
            n.weight *= DISCOUNT if shown else 1


def _whole(best: Node, unlinked: list[float]) -> tuple[Node, bool]:
    """The element whose text ``best`` is part of, and whether it is an article or main element."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for tag in ("article", "main"):
        found = [n for n in above if n.tag == tag]
        if found:
            return found[-1], True
    for n in above:
        if n.tag in BLOCK and n.tag not in PARTS and unlinked[n.place] >= NEARLY_ALL * unlinked[0]:
            return n, False
    return above[-1], False


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes, up = tree.nodes, tree.up()
    hard = [n.dropped or n.tag in CANDIDATES for n in nodes]
    _drop_marked(tree)
    blocks = _blocks(tree.root)
    if not blocks:
        for n, dropped in zip(nodes, hard, strict=True):
            n.dropped = dropped
        blocks = _blocks(tree.root)
    if not blocks:
        return ""
    box, block_above = _containers(tree, up)
    points, letters, links, unlinked = ([0.0] * len(nodes) for _ in range(4))
    scored: dict[int, None] = {}  # in page order of the first paragraph
    for owner, text, linked in blocks:
        i = owner.place
        score = _score(text) * owner.weight
        letters[i] += len(text)
        links[i] += linked
        unlinked[i] += score * (1 - min(1.0, linked / len(text)))
        points[box[i]] += score
        scored.setdefault(box[i])
        if box[i]:
            points[block_above[box[i]]] += score / 2
            scored.setdefault(block_above[box[i]])
    for i in range(len(nodes) - 1, 0, -1):
        for sums in (letters, links, unlinked):
            sums[up[i]] += sums[i]

    def density(i: int) -> float:
        return min(1.0, links[i] / max(1.0, letters[i]))

    scores = {i: points[i] * (1 - density(i)) for i in scored}
    best = max(scores, key=lambda i: scores[i])  # the first in page order of equals
    whole, article = _whole(nodes[best], unlinked)
    kept = [False] * len(nodes)
    kept[best] = True
    least = max(10.0, 0.2 * scores[best])
    for child in whole.parent.children if whole.parent is not None else ():
        if not isinstance(child, Node) or child.dropped or not letters[child.place] or (child.marked and child.tag not in ("article", "main")):
            continue
        i = child.place
        prose = child.tag in PARAGRAPH and density(i) < 0.25 and (letters[i] > 80 or not article)
        heading = child.tag in (("h1", "h2") if article else HEADINGS)
        if child is not whole and (prose or heading or scores.get(i, 0) >= least):
            kept[i] = True
    in_whole = [n is whole for n in nodes]
    for i in range(1, len(nodes)):
        kept[i] = kept[i] or kept[up[i]]
        in_whole[i] = in_whole[i] or in_whole[up[i]]
    few = [(n.tag in HEADINGS or 2 * linked < len(text)) and in_whole[n.place] for n, text, linked in blocks]
    return "\n".join(text for (n, text, _), stays in zip(blocks, few, strict=True) if stays or kept[n.place])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""

    def step(batch: dict) -> dict:
        texts = [main_text(h) for h in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return map_batches(rows, "page_id long, url string, text string, n_chars long", lambda: step)
