"""Main-text extraction from HTML by tree scoring."""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form script style textarea title noscript iframe template svg math button select option input label dialog menu object embed canvas audio video map xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption div section article main".split())
#: Opening one of these closes an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Opening a key closes an open element of its values, up to the nearest bound.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table div article section main body html nav aside header footer form".split())
# Words in class, id or role that mark what is not the article, and words that may stand beside them.
#: Never the article, however much text they hold.
CERTAIN = re.compile(r"ads?|advert\w*|adbox|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|comments?|disqus\w*|respond|replies|discussion|subscribe|subscription|newsletter|signup|login|hidden")
#: Not the article, unless next to nothing else on the page reads like one.
LIKELY = re.compile(r"banner|nav\w*|menu\w*|breadcrumbs?|pagination|pager|sidebar\w*|side|rail|widget\w*|footer\w*|foot|header|masthead|siteheader|pageheader|notices?|alert|overlay|toolbar|share\w*|sharing|social\w*|related\w*|recommend\w*|search\w*|printonly|skiplink|skip|complementary|contentinfo")
NEUTRAL = re.compile(
    r"site|page|left|right|top|bottom|main|global|primary|secondary|list|box|area|wrap|wrapper|container|inner|outer|block|section|bar|item|items|post|posts|article|articles|stories|links?|form|buttons?|btn|icons?|group|unit|slot|panel|pane|column|col|row|center|centre|fixed|sticky|mobile|desktop|small|large|body|head|title|text|message|msg|info|thread|count|reader|user|the|print|only|warning|media|more|tags?|you|might|like|also|email|mail|footer|bottombar|\d*"
)
#: In front of a word these say that the element has such a part, not that it is one.
HAVING = frozenset("has have with no without show hide enable enabled disable disabled is not".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of linked characters from which a sibling of the best container is a list of links.
LINKED = 0.5
#: Elements dropped however much text they hold.
SILENT = DROPPED - frozenset("nav header footer aside form dialog menu label".split())
#: A quote counts behind an equals sign alone; a comment may end at once.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element: its parts are texts and child elements in page order."""

    __slots__ = ("tag", "parent", "parts", "mark", "score", "chars", "linked", "prose", "back")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.parts: list = []
        self.score = 0.0
        self.chars = self.linked = self.prose = 0
        #: Chrome by name that came back for want of other prose.
        self.back = False

    @property
    def chrome(self) -> bool:
        return self.mark > 1


#: Marks: content, perhaps chrome (dropped if full of links), chrome unless it holds the page, and chrome.
KEEP, MAYBE, DROP, NEVER = range(4)


def _name_mark(value: str) -> int:
    """What the words of a class, id or role say. A compound counts in full only if all its words are chrome or neutral."""
    found = KEEP
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_:.]+", name) if w]
        certain, likely = [bool(CERTAIN.fullmatch(w)) for w in words], [bool(LIKELY.fullmatch(w)) for w in words]
        if not any(certain) and not any(likely) or HAVING.intersection(words):
            continue
        if all(c or k or NEUTRAL.fullmatch(w) for w, c, k in zip(words, certain, likely)) and not words[-1] in ("content", "article", "body", "text", "title"):
            found = max(found, NEVER if any(certain) else DROP)
        else:
            found = max(found, MAYBE)
    return found


def _mark(tag: str, attributes: str) -> int:
    if tag in SILENT:
        return NEVER
    found = DROP if tag in DROPPED else KEEP
    if not attributes or tag in ("html", "body"):
        return found
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return NEVER
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NEVER
        if name in ("class", "id", "role"):
            own = _name_mark(value)
            if tag in HEADINGS or tag in ("article", "main"):
                own = min(own, MAYBE if own < NEVER else DROP)
            found = max(found, own)
    return found


def parse(page: str) -> Node:
    """A tolerant tree of the page; unclosed elements end with their parent, a cut-off tag is dropped.

    Open elements lie on a stack with each tag's places on it, so every tag costs constant time beside the elements that it
    closes, however deep the page is.
    """
    root = Node("#root", None)
    stack, places, bounds = [root], {}, []

    def close(at: int) -> None:
        while len(stack) > at:
            gone = stack.pop().tag
            places[gone].pop()
            if bounds and bounds[-1] == len(stack):
                bounds.pop()

    def nearest(tags) -> int:
        """Place of the innermost open element of ``tags`` inside the innermost bound, or that bound itself; else 0."""
        at = max((places[t][-1] for t in tags if places.get(t)), default=0)
        return at if at and (not bounds or at >= bounds[-1]) else 0

    at = 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].parts.append(text)
        if not found:
            return root
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if found[1]:
            inner = tag in ("p", "li", "td", "th", "tr", "b", "i", "em", "strong", "a", "span")
            place = nearest((tag,)) if inner else (places.get(tag) or [0])[-1]
            if place:
                close(place)
            continue
        if tag in CLOSES_P and (place := nearest(("p",))):
            close(place)
        if tag in SIBLINGS and (place := nearest(SIBLINGS[tag])):
            close(place)
            if tag == "tr" and stack[-1].tag == "tr":
                close(len(stack) - 1)
        if tag in ("body", "html"):
            close((places.get("html") or [0])[0] + 1)
        node = Node(tag, stack[-1], _mark(tag, found[3]))
        stack[-1].parts.append(node)
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "path", "g", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(node)


def _weigh(root: Node) -> None:
    """Settle the marks by what the elements hold.

    Prose is text outside links. What is perhaps chrome goes if most of its text is links. Of dropped elements
    the one with most prose comes back, and then the next inside or beside it, while the kept ones hold less than a
    fifth of its prose: a layout may be named after its sidebar, and a form may hold the whole page.
    """
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.chars += n
                node.linked += n * linked
            elif part.mark < NEVER:
                stack.append((part, linked))
    for node in reversed(order):
        if node.mark == MAYBE and node.chars and node.linked > 0.5 * node.chars:
            node.mark = DROP
        node.prose = node.chars - node.linked
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked

    def split(top: Node) -> tuple[int, list[Node]]:
        """Prose below ``top`` outside dropped elements, and those."""
        total, gone, todo = top.prose, [], [p for p in top.parts if not isinstance(p, str)]
        for p in todo:
            total -= p.prose if p.mark < NEVER else 0
        while todo:
            node = todo.pop()
            if node.mark == DROP:
                gone.append(node)
            elif node.mark < DROP:
                inner = [p for p in node.parts if not isinstance(p, str)]
                total += node.prose - sum(p.prose for p in inner if p.mark < NEVER)
                todo.extend(inner)
        return total, gone

    kept, gone = split(root)
    heap = [(-g.prose, i, g) for i, g in enumerate(gone)]
    heapq.heapify(heap)
    turn = count(len(heap))
    while heap and heap[0][2].prose > 0 and kept < 0.2 * heap[0][2].prose:
        node = heapq.heappop(heap)[2]
        node.mark, node.back = KEEP, True
        more, inside = split(node)
        kept += more
        for g in inside:
            heapq.heappush(heap, (-g.prose, next(turn), g))
    for node in order:
        node.chars = node.linked = 0


def _measure(root: Node) -> list[Node]:
    """Set every kept element's characters and linked characters; elements in page order, chrome left out."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.chars += n
                node.linked += n * linked
        stack.extend((p, linked) for p in reversed(node.parts) if not isinstance(p, str) and not p.chrome)
    for node in reversed(order):
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text that belongs to a block itself: all but that of blocks inside."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.chrome and part.tag not in BLOCK:
            stack.extend(reversed(part.parts))
    return "".join(out)


def _score(order: list[Node]) -> Node | None:
    """Paragraphs pass points for length and commas to ancestors; the best container discounted by link density."""
    passed: dict[int, Node] = {}
    for node in order:
        if node.tag not in SCORED:
            continue
        text = _own_text(node).strip()
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 30)) * (1 - _density(node))
        up, share = node.parent, 1.0
        for depth in range(4):
            if not up:
                break
            up.score += points * share
            passed[id(up)] = up
            up, share = up.parent, 0.5 if depth == 0 else share * 0.6
    ranked = [(n.score * (1 - _density(n)) * (1.5 if n.tag in ("article", "main") else 1.0), -i, n) for i, n in enumerate(passed.values())]
    best = max(ranked, key=lambda r: r[:2])[2] if ranked else None
    # A page that names its article or main part says where the container ends.
    for tag in ("article", "main"):
        up, named = best, None
        while up:
            named, up = (up if up.tag == tag else named), up.parent
        if named:
            return named
    return best


def _roots(best: Node) -> list[Node]:
    """The best container and its siblings, in page order; only what is chrome by name or mostly links goes, however little a sibling holds.

    Headings stay whatever they link to.
    """
    if not best.parent or best.tag in ("#root", "html", "body"):
        return [best]
    told = [p for p in best.parent.parts if not isinstance(p, str) and not p.chrome and p.chars]
    return [p for p in told if p is best or not p.back and (p.tag in HEADINGS or _density(p) < LINKED)]


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order, white space folded, references decoded."""
    out, held = [], []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    end = object()
    stack: list = list(reversed(nodes))
    while stack:
        part = stack.pop()
        if part is end:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif part.chrome:
            held.append(" " if part.tag in BLOCK else "")
        elif part.tag == "br":
            held.append(" ")
        elif part.tag in BLOCK or part.tag == "#root":
            flush()
            stack.append(end)
            stack.extend(reversed(part.parts))
        else:
            stack.extend(reversed(part.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's text: one line per block. Empty for null, empty or text-free pages.

    Chrome is told by element, class, id and role, and weighed by what it holds (``_weigh``): a page that sits wholly in an
    element named like chrome keeps its text, one of links, notices, adverts or comments alone has none. Pages may be cut off
    anywhere, nested to any depth and of any length; nothing is capped and the time is in proportion to the page.
    """
    if not page:
        return ""
    root = parse(page)
    _weigh(root)
    order = _measure(root)
    best = _score(order)
    return "\n".join(_blocks(_roots(best) if best else order[:1]))


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) for every row; no shuffle.

    Repeated rows are extracted each, an empty table gives an empty result, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), sizes], names=[*keep, "text", "n_chars"])

    wanted = pages.select(*keep, F.col(html_col).alias("__html"))
    types = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in keep)
    return wanted.mapInArrow(run, f"{types}, text string, n_chars bigint")
