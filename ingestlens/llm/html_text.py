"""Main text of web pages by two passes of block rules.

The first pass decides every block from its link density, length and stop-word
density, by bounds that its place raises or lowers; the second gives undecided
blocks the class of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ingestlens.llm.common import table

#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    """a about all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    just like may more most much must my no not of on one only or other our out over she should so some such than that the their them
    then there these they this to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dem den der des die du durch ein eine einem einen einer er es für hat ich im in ist ja
    mit nach nicht noch nur oder sich sie sind so über um und uns unter von vor war was wenn wer wie wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou où par pas plus
    pour que qui sa sans se ses son sont sur tout un une vous y
    al algo como con cuando de del desde donde el ella ellos en entre era es esta este está fue ha hasta la las le lo los más me mi
    muy no nos o para pero por porque que se sin sobre su sus también te todo tu un una uno y ya""".split()
)
#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template head title iframe object embed svg canvas math audio video map datalist select button textarea".split())
#: Elements that end a block.
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements around the article.
FRAME = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Parts of class, id and role values that mark what is not the article.
ASIDE = re.compile(
    r"""(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe
    |nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|footer|foot|header|masthead|topbar|toolbar|widget
    |comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|login|signup|search|skip|complementary|contentinfo)(?=$|[-_\s\d])""",
    re.X | re.I,
)
#: Of these, what is never the article, however long and however much prose: reader comments and page footers.
COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|respond|replies|reply|footer|contentinfo)(?=$|[-_\s\d])", re.I)
NEVER = frozenset("nav footer aside menu dialog".split())
#: Class and id parts that name the article in spite of a word above (as ``header`` of an article).
ARTICLE = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|main|content)(?:[-_](?:body|text|content|header|title))?(?=$|\s)", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: What ends a tag, or begins a quoted value in it.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "select", "button", "object", "audio", "video", "canvas")}

#: First-pass bounds: link density from which a block is boilerplate; characters of a short and a long block; stop-word densities.
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.28
#: Stop-word density below which a block of middle length beside an article is no prose; where no article is marked it is half of STOP_LOW.
STOP_NONE = 0.1
#: Link density beyond which a block is a list of links wherever it stands.
MOSTLY = 0.8
#: Plain text that makes an article within an element believed against the element's own mark.
ENOUGH = 3 * LONG
#: The bounds by place: lower within the article, higher beside an article with most of the page's text.
BOUNDS = {
    "in": (LINKS, SHORT, SHORT, STOP_LOW / 2, STOP_LOW),
    "": (LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH),
    "beside": (LINKS / 2, SHORT, 2 * LONG, STOP_LOW, STOP_HIGH),
}


class Block:
    """One block: its text, and what the rules look at. ``node`` is the innermost marked element around it, -1 for none."""

    __slots__ = ("text", "linked", "place", "heading", "good", "node")

    def __init__(self, text: str, linked: int, node: int, heading: bool):
        self.text, self.linked, self.node, self.heading = text, linked, node, heading
        self.place, self.good = "", None


def _marks(name: str, attributes: str, within: bool) -> str | None:
    """What an element says of its content: ``never``, ``out``, ``in`` (``main`` if there is one such), ``gone`` (not displayed) or nothing.

    ``never`` is ``out`` that no length of text speaks against. ``within`` an
    article a header is its title's, and an article is a comment if it is named so.
    """
    values = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            values[m[1].lower()] = next((x for x in m.groups()[1:] if x is not None), "")
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return "gone"
    named = " ".join(v for k, v in values.items() if k in ("class", "id", "role"))
    never = bool(named) and name not in ("html", "body", "main") and COMMENTS.search(named) and not ARTICLE.search(named)
    if never:
        return "never"
    if name in ("article", "main") or values.get("role") in ("main", "article"):
        return "main" if "main" in (name, values.get("role")) else "in"
    if name == "header" and within:
        return None
    if name in FRAME:
        return "never" if name in NEVER else "out"
    if name in ("html", "body"):
        return None
    if named and ASIDE.search(named):
        return None if ARTICLE.search(named) else "out"
    return None


def _places(found: list[Block], nodes: list[tuple[int, str]]) -> None:
    """Sets ``place`` of every block: ``out`` if any element around says so, else ``in`` within the article, else nothing.

    ``nodes`` are the marked elements as (parent, mark), parents first. An
    ``out`` element is not believed if it holds the article: a <main>, half of
    all text in articles (more of it than a long block that is marked ``out``
    must have), or half of the page's text with no article elsewhere. A
    ``never`` element is, unless it holds a <main> or, so opened within it, half of all articles' text.
    """
    text = [0] * len(nodes)  # of each element: plain text
    article = [0] * len(nodes)  # plain text within articles, itself included
    main = [False] * len(nodes)  # whether a <main> with text is in it
    inner, inner_main = [0] * len(nodes), [False] * len(nodes)  # the same of what is opened within it
    total = articles = 0
    for b in found:
        total += len(b.text) - b.linked
        if b.node >= 0:
            text[b.node] += len(b.text) - b.linked
            main[b.node] = nodes[b.node][1] == "main" or main[b.node]
    for i in range(len(nodes) - 1, -1, -1):
        parent, mark = nodes[i]
        article[i] = text[i] if mark not in ("out", "never") else inner[i]
        main[i] |= inner_main[i] or mark == "main" and text[i] > 0
        if parent >= 0:
            text[parent] += text[i]
            inner[parent] += article[i]
            inner_main[parent] |= main[i]
        else:
            articles += article[i]
    state = []  # of each element: whether a believed mark says out, and whether one says in
    for i, (parent, mark) in enumerate(nodes):
        out, within = state[parent] if parent >= 0 else (False, False)
        if mark not in ("out", "never"):
            within = True
        elif not (inner_main[i] or 2 * inner[i] > articles and inner[i] >= ENOUGH or mark == "out" and 2 * text[i] > total and inner[i] == articles):
            out = True
        state.append((out, within))
    for b in found:
        out, within = state[b.node] if b.node >= 0 else (False, False)
        b.place = "out" if out else "in" if within else ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, each with white space as single spaces; nothing of unseen elements.

    One pass: no step looks at more than the innermost few open elements, and
    what is searched for in vain once is not searched for again.
    """
    found: list[Block] = []
    nodes: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str | None, int]] = []  # name, mark, and the node that was innermost outside
    opened: Counter = Counter()  # open elements by name
    node, hidden, within, headings, linked, links, at = -1, 0, 0, 0, 0, 0, 0
    length, last = len(page), {q: page.rfind(q) for q in "\"'"}
    unclosed: set[str] = set()

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text and not hidden:
            found.append(Block(text, min(linked, len(text)), node, headings > 0))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def close() -> str:
        nonlocal node, hidden, within, headings, links
        name, mark, node = stack.pop()
        opened[name] -= 1
        hidden -= mark == "gone"
        within -= mark in ("in", "main")
        headings -= name in HEADINGS
        links -= name == "a"
        return name

    def tag_end(start: int) -> tuple[int, int]:
        """Where the attributes end and where the tag does; a quote that is never closed is none."""
        here = start
        while m := _STOP.search(page, here):
            if m[1] is None:
                return m.start(), m.end()
            here = page.find(m[1], m.end()) + 1 if last[m[1]] >= m.end() else m.end()
        return length, length

    while at < length:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        stop, at = tag_end(at)
        attributes = page[m.end() : stop]
        if m[1]:
            if not opened[name]:
                if name == "p":
                    end()
                continue
            if name in BLOCK:
                end()
            while close() != name:
                pass
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in UNSEEN and not (name in ("head", "map")):
            if name in BLOCK or name == "iframe":
                end()
            if not attributes.rstrip().endswith("/") and name not in VOID:
                pattern = _CLOSE.get(name) or re.compile(rf"</{re.escape(name)}\s*>", re.I)
                closed = None if name in unclosed else pattern.search(page, at)
                if not closed:
                    unclosed.add(name)
                at = closed.end() if closed else length if name in ("script", "style", "textarea", "title") else at
            continue
        if name in BLOCK:
            end()
            closes = SELF_CLOSING.get(name, {"p"} if name != "body" else set())
            while stack and (stack[-1][0] in closes or stack[-1][0] in ("b", "i", "em", "strong", "span", "font", "u", "a", "small") and any(n in closes for n, _, _ in stack[-4:])):
                close()
        if name not in VOID:
            mark = _marks(name, attributes, within > 0)
            stack.append((name, mark, node))
            opened[name] += 1
            hidden += mark == "gone"
            within += mark in ("in", "main")
            headings += name in HEADINGS
            links += name == "a"
            if mark and mark != "gone":
                nodes.append((node, mark))
                node = len(nodes) - 1
    end()
    _places(found, nodes)
    return found


def _density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(found: list[Block]) -> None:
    """Sets ``good`` of every block."""
    plain = {where: sum(len(b.text) - b.linked for b in found if b.place == where) for where in ("in", "")}
    beside = "beside" if plain["in"] > plain[""] else ""
    for b in found:  # first pass
        if b.place == "out":  # what the marks exclude is excluded at any length
            b.good = False
            continue
        links, short, long, low, high = BOUNDS[b.place or beside]
        share = b.linked / max(1, len(b.text))
        # Within the article, and in long prose anywhere, a linked part does not speak against the rest.
        stop = _density(b.text)
        prose = share <= MOSTLY and stop >= (low if b.place == "in" else high) and (b.place == "in" or len(b.text) >= long)
        if share > links and not prose:
            b.good = None if b.place == "in" else False
        elif len(b.text) < short:
            b.good = None
        else:
            if stop >= low:
                b.good = True if len(b.text) >= long or beside == "" and stop >= high else None
            else:
                b.good = False if not b.place and not b.linked and stop < (STOP_NONE if beside else STOP_LOW / 2) and len(b.text) < LONG else None
    decided = [i for i, b in enumerate(found) if b.good is not None]
    for i, b in enumerate(found):  # second pass
        if b.good is not None:
            continue
        k = bisect_left(decided, i)
        sides = [j for j in (decided[k - 1] if k else None, decided[k] if k < len(decided) else None) if j is not None]
        # A neighbour in the same place counts before one elsewhere; the article and what stands beside it do not inherit from each other.
        same = [j for j in sides if found[j].place == b.place]
        if b.linked > LINKS * len(b.text) and b.place == "in":  # a reference stands between parts of the article; at its ends links are a menu
            b.good = len(same) == 2 and all(found[j].good for j in same)
            continue
        sides = same or ([] if b.place == "in" or beside and not b.heading else sides)
        if not sides and beside and not b.place:
            b.good = len(b.text) >= LONG and _density(b.text) >= STOP_HIGH
        elif not sides:
            b.good = _density(b.text) >= STOP_LOW or b.place == "in" and not b.linked
        elif len({found[j].good for j in sides}) == 1:
            b.good = found[sides[0]].good
        elif b.heading:
            b.good = found[sides[1]].good  # a heading goes with what it heads
        else:
            near_before, near_after = i - sides[0], sides[1] - i
            near = sides[0] if near_before < near_after else sides[1]
            b.good = found[near].good if near_before != near_after else _density(b.text) >= STOP_LOW
    if not any(b.good for b in found):  # no prose anywhere: what is neither linked nor marked is all the page has
        for b in found:
            b.good = b.place != "out" and not b.linked


def main_text(page: str | None) -> str:
    """The article's blocks, one per line."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.good)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, plus ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without main text, give an empty text.
    Repeated rows are extracted each. Columns with the result's names are
    replaced. Pages are independent: no exchange takes place.
    """
    base = pages.drop("text", "n_chars")
    names = [c for c in base.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in names), "text string, n_chars long"])
    return base.mapInArrow(run, schema)


def op9_block_rules(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
