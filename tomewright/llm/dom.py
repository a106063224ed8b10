"""A tolerant HTML reader: block-level nodes in page order, their own text, and what is known of them."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is never shown as text of the page.
HIDDEN = frozenset("script style head title template noscript iframe object svg math canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Groups of tags, each with its own feature and its own parent-child potentials.
GROUPS = (
    ("html", "body"), ("main",), ("article",), ("section",), ("div", "center"), ("p",), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("nav",), ("header",), ("footer", "address"), ("aside",), ("form", "button", "input", "select", "option", "label", "fieldset", "textarea", "legend"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre", "figure", "figcaption", "details", "summary"), ("dialog",),
)
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
OTHER = len(GROUPS)
#: Words in class, id, role and label attributes that tell what an element is for.
HINTS = (
    ("content", r"article\w*|content|main|post|posts|entry|story|body|text|prose|paragraph"),
    ("nav", r"nav\w*|menu\w*|breadcrumbs?|crumbs?|pagination|pager|toc|tabs?|skip"),
    ("header", r"header|head|masthead|top|topbar|logo|branding|site"),
    ("footer", r"foot\w*|bottom|copyright|legal|contentinfo|colophon"),
    ("side", r"side\w*|aside|rail|widgets?|complementary|column"),
    ("ad", r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|commercial|dfp|outbrain|taboola"),
    ("notice", r"cookies?|consent|gdpr|notices?|notif\w*|alerts?|newsletter|subscribe|subscription|popup|modal|dialog|overlay|paywall|warning|privacy|disclaimer|toast"),
    ("comment", r"comments?|commentlist|repl(?:y|ies)|respond|disqus|discussion|reviews?|feedback|guestbook"),
    ("social", r"shar(?:e|ing)\w*|social\w*|follow|related|recommend\w*|more|trending|popular|tags?|author|byline|meta|bio"),
    ("form", r"forms?|search\w*|login|signin|signup|register|contact|survey|poll"),
    ("hidden", r"hidden|invisible|sr|none"),
)
_HINT = [re.compile(rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])") for _, p in HINTS]
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
#: A start tag ends these open elements, unless one of the stops lies between.
_LIST, _TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
CLOSES = {"li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "option": (frozenset(("option",)), frozenset(("select",))), "tr": (frozenset(("tr", "td", "th")), _TABLE), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table")))}
CLOSES |= {t: (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), _TABLE) for t in ("tbody", "thead", "tfoot")}
_P = (frozenset(("p",)), frozenset(("td", "th", "button", "table", "object", "caption")))
#: Start tags that end an svg or math element which has no end tag of its own.
_LEAVES = re.compile(r"<(?:article|aside|blockquote|body|center|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|ul)(?=[\s/>])", re.I)
_FOREIGN = frozenset(("svg", "math"))
#: Nodes below this depth become siblings of the one that is there, as in browsers.
DEEPEST = 512


@lru_cache(50_000)
def hints(attributes: str) -> int:
    """Bits of the hints that an attribute list gives."""
    found = 0
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            found |= (1 << 10) * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("hidden", "aria-hidden"):
            found |= (1 << 10) * (value.lower() != "false")
        else:
            words = _CAMEL.sub(" ", value).lower()
            if name == "role":
                words = {"navigation": "nav", "contentinfo": "footer", "complementary": "side", "alertdialog": "alert"}.get(words, words)
            for k, pattern in enumerate(_HINT):
                if pattern.search(words):
                    found |= 1 << k
    return found


#: Hints that make a node even of an inline element.
APART = sum(1 << k for k, (n, _) in enumerate(HINTS) if n in ("ad", "notice", "comment", "hidden"))


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where each element of a hidden kind ends, by the end of its start tag: nested ones are counted, those without an end left out."""
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>?", html, re.I):
        if not m[1]:
            if not (tag in _FOREIGN and m[0].endswith("/>")):
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def read(html: str, marks: list[str] | None = None) -> tuple[list[int], list[int], list[int], list[tuple[int, str, int]]]:
    """Parents, tag groups and hint bits of the nodes (node 0 is the page), and blocks (node, text, linked characters).

    Inline elements belong to the node around them. A block is the text of one node between two other nodes, with
    character references decoded and white space as it stands. ``marks`` gets
    the data-mark of each node but the page. Where an element stands is known by its tag, so that a page of any shape costs
    time in proportion to its length.
    """
    parent, group, bits, depth = [-1], [0], [0], [0]
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    hidden: dict[str, dict[int, int]] = {}
    blocks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the node each belongs to
    text: list[str] = []
    linked, links, at, size = 0, 0, 0, len(html)
    leave = -1  # where the next element stands that no svg holds

    def end_block():
        nonlocal linked
        if text:
            joined = "".join(text)
            if joined.strip():
                blocks.append((stack[-1][1], joined, linked))
            text.clear()
        linked = 0

    def close(upto: int):
        """Leave the open elements from ``upto`` on."""
        nonlocal links
        while len(stack) > upto:
            tag, node = stack[-1]
            if node != stack[-2][1]:
                end_block()
            links -= tag == "a"
            stack.pop()
            places[tag].pop()

    def open_element(tag: str, node: int):
        nonlocal links
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
        links += tag == "a"

    while at < size:
        m = _TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = end.end() if end else size
            if tag != "textarea":
                continue
        if tag in VOID or tag in HIDDEN:
            if tag == "br" or tag == "hr":
                text.append(" ")
            elif tag in HIDDEN and tag != "head" and not (tag in _FOREIGN and m[0].endswith("/>")):  # skip to its end; the head only holds what is hidden anyway
                if tag not in hidden:
                    hidden[tag] = _ends(html, tag)
                if at in hidden[tag]:
                    at = hidden[tag][at]
                elif tag in _FOREIGN:
                    if leave < at:
                        found_leave = _LEAVES.search(html, at)
                        leave = found_leave.start() if found_leave else size
                    at = leave if leave < size else at
            continue
        found = hints(m[3] or m[6] or "") if m[3] or m[6] else 0
        if tag in INLINE and not found & APART:
            open_element(tag, stack[-1][1])
            continue
        for ended, stops in (*((CLOSES[tag],) if tag in CLOSES else ()), *((_P,) if tag not in INLINE else ())):
            have = [p for t in ended if (p := places.get(t))]
            if have:
                stop = max((p[-1] for t in stops if (p := places.get(t))), default=0)
                lowest = min((p[k] for p in have if (k := bisect_right(p, stop)) < len(p)), default=0)
                if lowest:
                    close(lowest)
        end_block()
        if tag == "textarea":
            continue
        around = stack[-1][1]
        if depth[around] >= DEEPEST:
            around = parent[around]
        parent.append(around)
        depth.append(depth[around] + 1)
        group.append(GROUP.get(tag, OTHER))
        bits.append(found)
        if marks is not None:
            mark = re.search(r'data-mark="(\w+)"', m[3] or m[6] or "")
            marks.append(mark[1] if mark else "")
        open_element(tag, len(parent) - 1)
    close(1)
    end_block()
    return parent, group, bits, blocks
