"""Main text of web pages by tree scoring.

Paragraphs earn points for their length and commas and pass them to their ancestors, in full to the parent and in
falling shares above, discounted by the share of link text. The best container is kept together with its siblings that
hold content, and the siblings of the containers around it. Navigation, scripts and the like are never content. Forms,
footers and what role, class or id call advertising, comments, notices and so on is barred, but only while content is
left without it: where the page has hardly any, the barred element that holds most of it is let in.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from heapq import heappop, heappush
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import load, with_columns_from

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Never content, with all they hold.
DROPPED = RAW | frozenset("head nav button select option menu dialog svg math canvas object audio video map datalist".split())
#: Content only if there is hardly any without them.
BARRED = frozenset("footer aside form fieldset".split())
BLOCKS = BARRED | frozenset(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Tags that end an open one of the same group when they start, up to the element that bounds the group.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of class, id and role that mark what is not content; whole words between -, _ and spaces.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login "
    "share sharing social related recommended recommendations widget pagination pager toolbar masthead skip hidden complementary contentinfo search topbar".split()
)
#: Of these, words that layout wrappers around the content bear too; they don't count on an element with an article inside.
LAYOUT_WORDS = frozenset("nav navbar navigation menu sidebar footer banner promo share sharing social toolbar topbar search ads".split())
#: Words of what readers or advertisers wrote, or what covers the page: such an element is let in only if nothing else earns points.
NEVER_FIRST = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored comment comments disqus reply replies respond cookie cookies consent gdpr popup modal overlay subscribe newsletter signup login hidden".split())
#: Barred elements are let in while the rest of the page earns fewer points than this, and less than this share of theirs.
HARDLY_ANY, SMALL_SHARE = 4.0, 0.2
#: Siblings of containers further up than the best one's need so many points.
FAR_POINTS = 3.0
#: Before such a word: the page says that it has, or lacks, such a part; it isn't one.
PARTICLES = frozenset("no not has have with without".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z0-9]+")
LOWER_ASCII = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "score", "bad", "bar", "layout", "holds", "length", "linked", "points", "under", "out")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.score, self.points = tag, attrs, parent, [], 0.0, 0.0
        self.holds, self.length, self.linked = False, 0, 0  # whether an article is inside; characters of text, and of links
        words = marks(attrs) if attrs and tag not in ("html", "body") else frozenset()
        inline = tag not in BLOCKS
        self.bad = tag in DROPPED or inline and bool(words)
        #: 0 not barred, 1 barred, 2 barred and let in last.
        self.bar = 0 if inline else 2 if words & NEVER_FIRST else 1 if words or tag in BARRED else 0
        self.layout = not inline and words <= LAYOUT_WORDS and (bool(words) or tag == "form")
        self.under, self.out = None, False  # the nearest barred element around it, or itself; whether it is barred in the end


def marks(attrs: str) -> set[str]:
    """The words of class, id, role and the like that say that the element is not content."""
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            words = WORD.findall(value)
            found |= {w for before, w in zip(["", *words], words, strict=False) if w in BAD_WORDS and before not in PARTICLES}
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("hidden")
    return found


class Markup:
    """What a page holds, piece by piece, each character looked at a bounded number of times: closing quotes and ends
    that are not there are sought once only."""

    def __init__(self, html: str):
        self.html, self.absent = html, {}

    def find(self, what: str, at: int) -> int:
        """Like str.find, at places that never fall; -1 is remembered."""
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent[what] = True
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at ``at``: none within quotes counts. -1: none."""
        while (m := QUOTE_OR_END.search(self.html, at)) is not None:
            if m[0] == ">":
                return m.start()
            closing = self.find(m[0], m.end())
            if closing < 0:
                return -1
            at = closing + 1
        return -1

    def __iter__(self):
        """(start, end, closing, name, rest of the tag) of each tag; for comments and the like name is None and rest what
        they show. A < that begins none of these is text."""
        html, at, size = self.html, 0, len(self.html)
        no_end = False  # no tag that starts from here on is ended
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            nxt = html[at : at + 1]
            if html.startswith("!--", at):
                end = self.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                yield start, at, False, None, ""
            elif html.startswith("![CDATA[", at):
                end = self.find("]]>", start + 9)
                at = end + 3 if end >= 0 else size
                yield start, at, False, None, html[start + 9 : end if end >= 0 else size]
            elif nxt == "!" or nxt == "?":
                end = self.find(">", at)
                if end >= 0:
                    at = end + 1
                    yield start, at, False, None, ""
            elif not no_end and (m := NAME.match(html, at + (nxt == "/"))) is not None:
                end = self.tag_end(m.end())
                if end < 0:
                    no_end = self.find(">", m.end()) < 0
                    if not no_end:  # an open quote: the tag ends at the next > all the same
                        end = html.find(">", m.end())
                    else:
                        continue
                at = end + 1
                self.resume = at
                yield start, at, nxt == "/", m[0].lower(), html[m.end() : end]
                at = self.resume

    def after_raw(self, tag: str, at: int) -> int:
        """The place after the end tag of an element that holds no markup; the page's end where it has none."""
        lower = self.lower
        key = f"</{tag}"
        while key not in self.absent:
            found = lower.find(key, at)
            if found < 0:
                self.absent[key] = True
                break
            after = found + len(key)
            if after < len(lower) and (lower[after] in "/>" or lower[after].isspace()):
                end = self.find(">", after)
                return end + 1 if end >= 0 else len(lower)
            at = after
        return len(lower)

    @cached_property
    def lower(self) -> str:
        """The page in lower case, letter for letter."""
        low = self.html.lower()
        return low if len(low) == len(self.html) else self.html.translate(LOWER_ASCII)


def parse(html: str) -> Node:
    """A tree of elements and strings. Wrong nesting is mended the way browsers do for blocks: an end tag closes down to
    its element or is ignored, block starts end an open paragraph, items end the item before.

    ``open_`` counts the elements from the root to here by tag, so nothing is sought that isn't there.
    """
    root = here = Node("html", "", None)
    open_: Counter[str] = Counter()
    markup, last_end = Markup(html), 0

    def close(to: Node) -> Node:
        """Leaves the elements below ``to``."""
        up = here
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    for start, end, closing, tag, rest in markup:
        if start > last_end:
            here.kids.append(unescape(html[last_end:start]))
        last_end = end
        if tag is None:
            if rest:
                here.kids.append(rest)
            continue
        if closing:
            if open_[tag] > 0:
                up = here
                while up is not root and up.tag != tag and not (tag not in BLOCKS and up.tag in BLOCKS):
                    up = up.parent
                if up is not root and up.tag == tag:
                    here = close(up.parent)
            continue
        if tag in ("html", "body", "head") and tag == here.tag:
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            up = here
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "body"):
                up = up.parent
            if up.tag == "p":
                here = close(up.parent)
        if tag in SIBLINGS:
            group, bound = SIBLINGS[tag]
            if any(open_[x] > 0 for x in group):
                up, last = here, None
                while up is not root and up.tag not in bound:
                    last = up if up.tag in group else last
                    up = up.parent
                here = close(last.parent) if last is not None else here
        if tag == "body":
            here = close(root)
        node = Node(tag, rest, here)
        here.kids.append(node)
        if tag in CONTENT and not node.bar:
            up = here
            while up is not None and not up.holds:
                up.holds = True
                up.bar = 0 if up.layout else up.bar
                up = up.parent
        if tag in RAW:
            markup.resume = last_end = markup.after_raw(tag, end)
        elif tag not in VOID and not rest.endswith("/"):
            here = node
            open_[tag] += 1
    if last_end < len(html):
        here.kids.append(unescape(html[last_end:]))
    return root


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, characters of it in links) for each run of text, in page order; white space is
    collapsed. What is never content is left out."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = [0]

    def flush(owner: Node) -> None:
        if parts:
            if text := SPACE.sub(" ", "".join(parts)).strip():
                out.append((owner, text, min(linked[0], len(text))))
            parts.clear()
        linked[0] = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        at, k, owner, link = stack.pop()
        if k == len(at.kids):
            if at.tag in BLOCKS:
                flush(at)
            continue
        stack.append((at, k + 1, owner, link))
        kid = at.kids[k]
        if isinstance(kid, str):
            parts.append(kid)
            linked[0] += len(kid.strip()) if link else 0
        elif kid.bad:
            continue
        elif kid.tag == "br":
            parts.append(" ")
        elif kid.tag in BLOCKS:
            flush(owner)
            stack.append((kid, 0, kid, link))
        else:
            stack.append((kid, 0, owner, link or kid.tag == "a"))
    flush(node)
    return out


def in_order(root: Node) -> list[Node]:
    """root and the elements below it in page order, each before those inside it."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo += [k for k in reversed(out[-1].kids) if not isinstance(k, str)]
    return out


def bar_headers(nodes: list[Node]) -> None:
    """Headers that are not those of an article, section or main element are barred."""
    inside: set[int] = set()
    for n in nodes:
        if id(n.parent) in inside or n.tag in ("article", "section", "main"):
            inside.add(id(n))
        if n.tag == "header" and id(n.parent) not in inside:
            n.bar = n.bar or 1


def let_in(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Lets barred elements in while the page has hardly any content without them: of the outermost ones that with the most
    points inside, first in page order among equals, if the rest has less than a small share of them; those let in last
    only if nothing else earns points. What is barred inside stays so until its turn. A page with text in an article or main
    element that isn't barred has content. Sets ``out`` of all elements."""
    articles: set[int] = set()
    for n in nodes:
        n.under = n if n.bar else n.parent.under if n.parent is not None else None
        if n.under is None and (n.tag in CONTENT or id(n.parent) in articles):
            articles.add(id(n))
    own: dict[int, float] = Counter()  # points of an element that nothing within it bars
    for owner, text, linked in found:
        own[id(owner.under)] += points(owner, text, linked)
    barred = [n for n in nodes if n.bar]
    outer = lambda n: n.parent.under if n.parent is not None else None
    total = dict(own)
    below: dict[int, list[tuple[int, Node]]] = {}
    for n in reversed(barred):
        total[id(outer(n))] = total.get(id(outer(n)), 0.0) + total.get(id(n), 0.0)
    for place, n in enumerate(barred):
        below.setdefault(id(outer(n)), []).append((place, n))
    content = HARDLY_ANY if any(id(owner) in articles for owner, _, _ in found) else own[id(None)]
    heap: list[tuple] = []
    todo = below.get(id(None), [])
    while True:
        for place, n in todo:
            if total.get(id(n), 0.0) > 0:
                heappush(heap, (n.bar, -round(total[id(n)], 6), place, n))
        if not heap or content >= HARDLY_ANY or content > 0 and (heap[0][0] == 2 or content >= SMALL_SHARE * -heap[0][1]):
            break
        *_, n = heappop(heap)
        n.bar = 0
        content += own[id(n)]
        todo = below.get(id(n), [])
    for n in nodes:
        n.out = bool(n.bar) or n.parent is not None and n.parent.out


def points(owner: Node, text: str, linked: int) -> float:
    """Of a block: for its length and commas, less the share of link text. Headings earn none."""
    return 0.0 if owner.tag in HEADINGS else (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - linked / len(text))


def weigh(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Sets score, length, linked and points (of all that is inside) of all elements. A block's points go in full to its parent (a div keeps its own), half
    to the one above, and from there on two thirds of what the one below got."""
    first: dict[int, float] = {}  # points that arrive in full
    rest: dict[int, float] = {}  # and those that have been passed on
    for owner, text, linked in found:
        to = owner if owner.tag == "div" or owner.parent is None else owner.parent
        first[id(to)] = first.get(id(to), 0.0) + points(owner, text, linked)
        owner.points += points(owner, text, linked)
        owner.length += len(text)
        owner.linked += linked
    for n in reversed(nodes):
        full, shared = first.get(id(n), 0.0), rest.get(id(n), 0.0)
        n.score = full + shared
        if (up := n.parent) is not None:
            rest[id(up)] = rest.get(id(up), 0.0) + full / 2 + shared * 2 / 3
            up.length += n.length
            up.linked += n.linked
            up.points += n.points


def density(n: Node) -> float:
    return n.linked / max(1, n.length)


def content_of(best: Node) -> list[Node]:
    """The best container, its siblings that hold content, and those of the containers around it.

    Siblings next to it: with few links, and a fifth of its score, or a long paragraph, or a heading. Further up: with few
    links and enough points; around an article only such as hold an article.
    """
    kept, article = [best], best.tag in CONTENT
    least, far = max(1.0, 0.2 * best.score), max(FAR_POINTS, 0.2 * best.points)
    node = best
    while node.parent is not None:
        for kid in node.parent.kids:
            if isinstance(kid, str) or kid is node or kid.out or not kid.length or density(kid) >= 0.3:
                continue
            if node is best:
                wanted = kid.score >= least or kid.tag == "p" and kid.length >= 80 or not article and kid.tag in HEADINGS
            else:
                wanted = kid.points >= far and (not article or kid.holds or kid.tag in CONTENT)
            if wanted:
                kept.append(kid)
        node = node.parent
    return kept


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty for null, empty and textless pages, and for those
    of nothing but links, which are menus.

    Of containers with equal scores (to six digits) the first in page order is best, and the outer one of two within each
    other. If no block earns points, the blocks that aren't mostly links are the text. Takes time in proportion to the
    page's length, however deep or wrong its markup.
    """
    if not html:
        return ""
    root = parse(html)
    nodes = in_order(root)
    bar_headers(nodes)
    found = blocks(root)
    let_in(nodes, found)
    found = [b for b in found if not b[0].out]
    weigh(nodes, found)
    best = max(nodes, key=lambda n: round(n.score * (1 - density(n)), 6))
    unlinked = "\n\n".join(text for _, text, linked in found if 2 * linked < len(text))
    if best.score <= 0:
        return unlinked
    up = best
    while up is not None:  # an article or main element around the best container is what its author calls the content
        if up.tag in CONTENT:
            best = up
        up = up.parent
    if best.parent is None or best.tag == "body":
        kept = [k for k in best.kids if not isinstance(k, str) and density(k) < 0.5]
        inside = {id(best)} | {id(n) for k in kept for n in in_order(k)}
    else:
        inside = {id(n) for k in content_of(best) for n in in_order(k)}
    return "\n\n".join(text for owner, text, _ in found if id(owner) in inside)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df with ``text`` (the main text, empty if none) and ``n_chars`` (its code points); columns of these names are replaced."""

    def make():
        def work(pages):
            texts = [main_text(x) for x in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return with_columns_from(df, [html], T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), make, rows=64)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(load(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
