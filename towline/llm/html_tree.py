"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, the nearest most; a container's points are
discounted by the share of its text that is in links. The best container is kept, with siblings that look like part of the
same text. Parts that a page's markup names as something else (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) give no points and are left out wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Classes of elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong"
    " sub sup time tt u var wbr rp rt ruby nobr blink link meta".split()
)
CLOSED_BY_BLOCK = "p"
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
SCOPES = set("html body article section main div table ul ol dl td th aside nav form blockquote header footer button".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Element kinds, roles and parts of class names or ids that are not main text.
NOT_TEXT = set(
    "nav footer aside form script style noscript template iframe svg canvas object button select textarea input label fieldset"
    " dialog menu head audio video".split()
)
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOT_TEXT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " sidebar sidebars aside breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentary reply"
    " replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination"
    " pager widget copyright disclaimer skip hidden teaser outbrain taboola".split()
)
COMMENT_NAMES = set("comment comments commentary reply replies respond discussion disqus ad ads advert advertisement sponsored hidden related teaser".split())
# Names that sections of a text bear too; inside an article or main element these and parts of longer names only raise a doubt.
DOUBTFUL_NAMES = set(
    "discussion commentary reply respond related recommended recommendations notice notices notification alert social share"
    " sharing promotion copyright disclaimer consent cookie cookies skip menu subscription head navigation"
    " aside banner overlay".split()
)
DOUBTFUL_LINKS = 0.33  # a doubtful element with a larger share of its text in links is left out
# Parts of a name that tell what an element is wherever they stand in it, inside an article too.
CERTAIN_PARTS = set(
    "advert adverts advertisement advertising sponsored sidebar sidebars breadcrumb breadcrumbs newsletter cookie cookies gdpr"
    " disqus outbrain taboola masthead navbar topbar toolbar pagination pager popup modal signup".split()
)
# Parts that tell it together with another part, or (LAST_PARTS) at the end of a name.
CERTAIN_PAIRS = {
    **dict.fromkeys(
        ("comment", "comments", "reply", "replies"),
        set("list area thread threads form respond section wrapper wrap box block body item author meta container feed count holder stream text entry user".split()),
    ),
    **dict.fromkeys(
        ("ad", "ads", "adv"),
        set("slot box unit units container banner wrapper wrap block space frame top bottom left right side inline label holder zone area rail leaderboard".split()),
    ),
    **dict.fromkeys(("share", "sharing", "social", "subscribe"), set("button buttons link links bar tools icon icons widget box media form".split())),
    **dict.fromkeys(("related", "recommended"), set("post posts article articles story stories news item items link links list box widget videos products".split())),
    **dict.fromkeys(("notice", "notices", "notification", "alert", "consent", "promo"), set("bar banner popup overlay".split())),
}
LAST_PARTS = {"comments", "ad", "ads"}
# Names of what stands with each of several comments: who, when, and an answer.
MARK_NAMES = set("author avatar user username reply time date timestamp posted permalink".split())
# Elements whose own text reads as text and not as a label or a button.
TEXT_TAGS = {"p", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADER_NAMES = {"header", "head", "top"}
TEXT_NAMES = set("article post entry story content main text body page title headline".split())


@dataclass
class Node:
    tag: str
    parent: int
    out: bool  # not main text, by itself or an ancestor
    in_text: bool  # inside an article or main element
    link: bool
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    doubt: bool = False  # named as something else, but inside an article or main element
    mark: bool = False  # says who wrote something or when, or answers it


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _certain(name: str) -> bool:
    """Whether a class or id can only mean something other than main text."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    if not parts:
        return False
    if parts[-1] in LAST_PARTS or parts == ["comment"]:
        return True
    return any(p in CERTAIN_PARTS or p in CERTAIN_PAIRS and not CERTAIN_PAIRS[p].isdisjoint(parts) for p in parts)


def _is_mark(tag: str, raw: str) -> bool:
    if tag == "time":
        return True
    if not raw:
        return False
    a = _attributes(raw)
    return not MARK_NAMES.isdisjoint(p.lower() for p in _NAME_PARTS.findall(f"{a.get('class', '')} {a.get('rel', '')}"))


def _is_out(tag: str, raw: str, in_text: bool) -> bool | None:
    """Whether an element is something other than main text; null if its own text must decide."""
    if tag in NOT_TEXT:
        return True
    if tag == "header" and not in_text:
        return True
    if not raw or tag in ("html", "body"):
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    # The id of a heading or an article is where links to it lead, made of its words.
    if any(map(_certain, f"{a.get('class', '')} {'' if tag in HEADINGS or tag == 'article' else a.get('id', '')}".split())):
        return True
    if in_text:
        whole = {w.lower() for w in f"{a.get('class', '')} {a.get('id', '')}".split()} - DOUBTFUL_NAMES
        if tag in ("article", "main"):
            return bool(whole & COMMENT_NAMES)
        if tag == "p" or tag in HEADINGS:
            return False
        if whole & NOT_TEXT_NAMES:
            return True
    names = {p.lower() for p in _NAME_PARTS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    if tag in ("article", "main"):
        return bool(names & COMMENT_NAMES)
    if names & HEADER_NAMES and not in_text and not names & TEXT_NAMES and tag not in HEADINGS:
        return True
    if in_text:
        return None if names & NOT_TEXT_NAMES and tag not in INLINE else False
    return bool(names & NOT_TEXT_NAMES)


def parse(source: str) -> Page:
    """Elements and text blocks of a page, whatever its markup; time grows with its length."""
    page = Page([Node("", -1, False, False, False)])
    nodes, stack = page.nodes, [0]
    pieces: list[str] = []
    state = {"link": 0, "chars": 0, "breaks": 0}

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            share = state["link"] / state["chars"] if state["chars"] else 0.0
            owner = stack[-1]
            while nodes[owner].tag in INLINE:
                owner = nodes[owner].parent
            page.blocks.append((owner, text, round(share * len(text))))
        pieces.clear()
        state["link"] = state["chars"] = state["breaks"] = 0

    def add(text: str) -> None:
        top = nodes[stack[-1]]
        if top.out or not text:
            return
        text = html.unescape(text) if "&" in text else text
        size = len(text) - text.count(" ") if not text.isspace() else 0
        if size:
            state["breaks"] = 0
        state["chars"] += size
        state["link"] += size if top.link else 0
        pieces.append(text)

    def close(names: tuple[str, ...], scopes: set[str]) -> bool:
        """Close the innermost open element of the names, unless one of the scopes comes first."""
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                if any(nodes[i].tag not in INLINE for i in stack[k:]):
                    flush()
                del stack[k:]
                return True
            if tag in scopes:
                return False
        return False

    at, end = 0, len(source)
    while at < end:
        m = _MARKUP.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, raw = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            blocks_stop = {t for t in SCOPES if t != tag} | {"p"} - {tag} if tag in INLINE else set()
            close((tag,), blocks_stop)
            continue
        if tag == "br":
            state["breaks"] += 1
            pieces.append(" ")
            if state["breaks"] == 2:
                flush()
            continue
        if tag not in INLINE:
            close((CLOSED_BY_BLOCK,), SCOPES)
            flush()
            if tag in CLOSES:
                while close(CLOSES[tag], SCOPES - set(CLOSES[tag])):
                    pass
        parent = nodes[stack[-1]]
        if tag in VOID:
            continue
        in_text = parent.in_text or tag in ("article", "main")
        out = parent.out or _is_out(tag, raw, parent.in_text)
        nodes.append(Node(tag, stack[-1], bool(out), in_text, parent.link or tag == "a", doubt=out is None, mark=_is_mark(tag, raw)))
        if tag == "a":
            parent.links += 1
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = found.end() if found else end
            continue
        if not (raw.rstrip().endswith("/") and tag in ("svg", "path")):
            stack.append(len(nodes) - 1)
    flush()
    return page


def _score(page: Page) -> None:
    """Points, characters and link characters of every element."""
    nodes = page.nodes
    for owner, text, link_chars in page.blocks:
        size = len(text)
        points = (1 + sum(map(text.count, ",،、，")) + min(size / 100, 3.0)) * (1 - link_chars / size) if size >= 25 else 0.0
        # A paragraph's own element passes its points on; text that stands in a container directly scores for it.
        node = owner if nodes[owner].tag in ("div", "section", "article", "main", "body", "td", "") else nodes[owner].parent
        level = 0
        while node >= 0 and points and level < 6:
            nodes[node].points += points / (1, 2, 6, 9, 12, 15)[level]
            node, level = nodes[node].parent, level + 1
        nodes[owner].chars += size
        nodes[owner].link_chars += link_chars
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = nodes[nodes[k].parent]
        up.chars += nodes[k].chars
        up.link_chars += nodes[k].link_chars
        up.links += nodes[k].links


def _read_as_text(page: Page) -> list[bool]:
    """Whether an element of doubtful name reads as a part of the text: it has paragraphs, headings, items or cells that are
    no links, and no two neighbours that each say who wrote them or when, as comments do."""
    nodes = page.nodes
    reads, marked, thread = ([False] * len(nodes) for _ in range(3))
    repeated = [0] * len(nodes)
    for owner, text, link_chars in page.blocks:
        if nodes[owner].tag in TEXT_TAGS and 3 * link_chars < len(text):
            reads[owner] = True
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        n, up = nodes[k], nodes[k].parent
        marked[k] |= n.mark
        thread[k] |= repeated[k] > 1
        if up >= 0:
            reads[up] |= reads[k]
            thread[up] |= thread[k]
            if marked[k]:
                marked[up] = True
                repeated[up] += n.tag not in INLINE
    return [r and not t for r, t in zip(reads, thread)]


def _density(n: Node) -> float:
    return n.link_chars / n.chars if n.chars else 0.0


def main_blocks(source: str) -> list[str]:
    """Blocks of main text in page order."""
    page = parse(source)
    nodes = page.nodes
    _score(page)
    values = [n.points * (1 - _density(n)) for n in nodes]
    best = max(range(len(nodes)), key=lambda k: (values[k], -k))
    kept: set[int] = set()
    if values[best] <= 0:  # nothing long enough to score
        named = [k for k, n in enumerate(nodes) if n.tag in ("article", "main") and not n.out and n.chars]
        kept = set(named) or {0}
    else:
        inside = best
        while inside > 0 and nodes[inside].tag not in ("article", "main"):
            inside = nodes[inside].parent
        if inside > 0:
            kept = {inside}
            parent = nodes[inside].parent
            for k, n in enumerate(nodes):
                # Beside it other articles, and inside a main element what heads or leads them.
                alike = n.tag == "article" or nodes[parent].in_text and (n.tag == "p" or n.tag in HEADINGS)
                if k and n.parent == parent and not n.out and n.chars and alike:
                    low = _density(n)
                    if n.tag in HEADINGS or n.chars > 80 and low < 0.25 or n.chars <= 80 and low == 0:
                        kept.add(k)
                elif k and n.parent == parent and not n.out and nodes[parent].in_text and values[k] >= max(10.0, 0.2 * values[inside]):
                    kept.add(k)
        else:
            kept = {best}
            for k, n in enumerate(nodes):
                if k and k != best and n.parent == nodes[best].parent and not n.out and n.chars:
                    low = _density(n)
                    if (
                        values[k] >= max(10.0, 0.2 * values[best])
                        or n.tag in HEADINGS
                        or n.tag == "p" and (n.chars > 80 and low < 0.25 or n.chars <= 80 and low == 0)
                    ):
                        kept.add(k)
    # From the top down: whether an element is in what is kept, and not in a list of links.
    taken, reads = [False] * len(nodes), _read_as_text(page)
    for k, n in enumerate(nodes):
        links = n.tag in ("ul", "ol", "div", "table", "section", "p") and n.links >= 3 and _density(n) > 0.66 and k not in kept
        other = n.doubt and (not reads[k] or _density(n) > DOUBTFUL_LINKS)
        taken[k] = (k in kept or n.parent >= 0 and taken[n.parent]) and not links and not other
    return [text for owner, text, _ in page.blocks if taken[owner]]


def main_text(source: str | None) -> str:
    """Main text of a page: its blocks joined by line feeds, white space in a block as one space. Empty for null."""
    return "\n".join(main_blocks(source)) if source else ""


def text_column(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return run.asNondeterministic()(source)  # evaluated once per row


def extract(df: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of the page in ``source`` and ``n_chars``, its code points.

    Null, empty and markup-only pages give an empty text; broken markup is read as far as it goes. Every row stands for
    itself, so repeated rows get equal texts. Existing columns of the two names are replaced.
    """
    return df.withColumn(text, text_column(F.col(source))).withColumn("n_chars", F.char_length(text).cast("long"))
