"""HTML pages as text blocks with their place in the element tree, from any markup.

Text between two block-level tags is one leaf block. Inline tags are white space or
nothing; unclosed and misplaced tags are closed as browsers close them (a new paragraph
ends the last, an end tag closes what is open inside it, a stray one is passed over).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Element classes of HTML, fixed values.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
SPACED = frozenset("br img input wbr hr".split())
#: What an opening tag ends, if it is open and no boundary stands between.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "thead": ("thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
}
LISTS = frozenset("ul ol dl menu dir table select".split())
NO_PARAGRAPH_END = frozenset("button label legend option optgroup body html head".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_TOKENS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


#: Kinds of class, id and role words: the kind, and the beginnings of words that show it.
KINDS = {
    "ad": ("ad", "ads", "adv", "advert", "sponsor", "promo", "banner", "doubleclick"),
    "menu": ("nav", "navigation", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs", "toolbar"),
    "top": ("header", "masthead", "branding", "logo", "topbar"),
    "bottom": ("footer", "copyright", "legal", "contentinfo", "colophon"),
    "side": ("sidebar", "aside", "widget", "complementary", "rail", "related", "recommend", "popular", "trending", "teaser"),
    "notice": ("cookie", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "dialog", "paywall"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "register"),
    "talk": ("comment", "comments", "disqus", "respond", "reply", "replies", "discussion"),
    "share": ("share", "sharing", "social", "follow", "tweet", "like", "author", "byline", "meta", "tags"),
    "body": ("content", "article", "post", "entry", "story", "main", "body", "text", "prose"),
}
_SHORT = frozenset(("ad", "ads", "adv", "nav", "top", "toc"))
#: Elements and kinds whose text is not main text even inside an article.
APART = frozenset("nav header footer aside form button select menu dialog label legend fieldset option".split())
APART_KINDS = frozenset(("ad", "menu", "side", "notice", "form", "talk", "share", "bottom"))


@lru_cache(maxsize=1 << 14)
def kinds_of(words: str) -> frozenset[str]:
    """Kinds that the class, id and role words of an element show."""
    found = set()
    for word in words.replace("_", " ").replace("-", " ").split():
        for kind, stems in KINDS.items():
            if any(word == s or (s not in _SHORT and word.startswith(s)) for s in stems):
                found.add(kind)
    return frozenset(found)


class Place:
    """An open element with what its ancestors say, shared by all blocks below it.

    ``tags`` and ``kinds`` are the sets of all ancestors; a place that adds nothing holds its
    parent's set, so that deep pages cost one small object an element. ``part`` is the innermost
    element that sets text apart or opens main text, ``within`` the last other one around it,
    and ``marked`` whether the markup labels the text as main (None outside ``article`` and
    ``main``).
    """

    __slots__ = ("tag", "tags", "kinds", "part", "within", "marked")

    def __init__(self, tag: str, words: str, above: Place | None):
        own = kinds_of(words) if words else frozenset()
        tags, kinds = (above.tags, above.kinds) if above else (frozenset(), frozenset())
        self.tag = tag
        self.tags = tags if tag in tags else tags | {tag}
        self.kinds = kinds if own <= kinds else kinds | own
        self.part, self.within, self.marked = (above.part, above.within, above.marked) if above else ("none", "none", None)
        kind = min(own & APART_KINDS, default=None)
        main = tag in ("article", "main")
        if tag == "body":
            part = None  # class words of the whole page say nothing on a part of it
        elif kind:
            part = f"kind {kind}"
        elif tag in APART:
            part = tag
        else:
            part = "main" if main else "body" if "body" in own else None
        if part and part != self.part:
            self.part, self.within = part, self.part
        if main or self.marked is not None:
            self.marked = self.marked is not False and not (part and part not in ("main", "body"))

    @property
    def signs(self) -> tuple:
        return self.tags, self.kinds, self.tag, self.part, self.within


@dataclass
class Block:
    """A leaf block: its text, the characters of it inside links, and the element around it."""

    text: str
    linked: int
    place: Place | None


def _tag_end(html: str, at: int, no_more: dict[str, int]) -> int:
    """Where the tag opened at ``at`` ends, past quoted values; -1 if nowhere."""
    end = html.find(">", at)
    place = at
    while end >= 0:
        double, single = html.find('"', place, end), html.find("'", place, end)
        quotes = [q for q in (double, single) if q >= 0]
        if not quotes:
            return end
        first = min(quotes)
        if html[first - 1 : first] != "=" and html[place:first].rstrip()[-1:] != "=":
            place = first + 1
            continue
        mark = html[first]
        if no_more.get(mark, len(html) + 1) <= first + 1:
            return end
        close = html.find(mark, first + 1)
        if close < 0:  # an unclosed value: the tag ends at its first bracket
            no_more[mark] = first + 1
            return end
        place = close + 1
        if close > end:
            end = html.find(">", close)
    return -1


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in page order; blocks without text are left out."""
    out: list[Block] = []
    stack: list[Place] = []
    depths: dict[str, list[int]] = {}  # where the open elements of each name stand in the stack
    text: list[str] = []
    linked, in_link = 0, False
    no_more: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            clean = " ".join((unescape(joined) if "&" in joined else joined).split())
            if clean:
                out.append(Block(clean, min(linked, len(clean)), stack[-1] if stack else None))
            text.clear()
        linked = 0

    def innermost(names: tuple[str, ...] | frozenset[str]) -> int:
        return max((depths[name][-1] for name in names if depths.get(name)), default=-1)

    def close(names: tuple[str, ...], until: frozenset[str]) -> None:
        depth = innermost(names)
        if depth >= 0 and depth >= innermost(until):
            while len(stack) > depth:
                depths[stack.pop().tag].pop()

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            piece = html[at:start]
            text.append(piece)
            if in_link:
                linked += len(piece)
        if start == size:
            break
        follows = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if follows in ("!", "?"):
            end = html.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        closing = follows == "/"
        match = _NAME.match(html, start + 1 + closing)
        if not match:
            text.append("<")
            at = start + 1
            continue
        name = match[0].lower()
        end = _tag_end(html, match.end(), no_more)
        if end < 0:  # a tag that never ends takes the rest with it
            break
        at = end + 1
        if name == "a":
            in_link = not closing
        if closing:
            if name in BLOCK:
                flush()
                close((name,), frozenset())
                in_link = False
            continue
        if name in RAW:
            found = _RAW_END[name].search(html, at)
            at = size if found is None else html.find(">", found.end())
            at = size if at < 0 else min(at + 1, size)
            text.append(" ")
            continue
        if name in SPACED:
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        in_link = False
        if name not in NO_PARAGRAPH_END:
            close(("p",), frozenset(("button", "table", "td", "th", "caption")))
        if name in ENDS:
            close(ENDS[name], LISTS if name not in ("tr", "tbody", "tfoot", "thead") else frozenset(("table",)))
        if name not in VOID:
            attributes = html[match.end() : end]
            words = " ".join(a or b or c for a, b, c in _TOKENS.findall(attributes)).lower() if "=" in attributes else ""
            depths.setdefault(name, []).append(len(stack))
            stack.append(Place(name, words, stack[-1] if stack else None))
    flush()
    return out
