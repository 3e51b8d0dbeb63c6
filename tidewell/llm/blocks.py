"""Flat text blocks of an HTML page and their features."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_CLASSED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of the HTML standard: elements whose content is never page text, and text-level elements.
SILENT = {
    "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video",
    "textarea", "select", "title", "head", "annotation", "annotation-xml",
}
#: Of these, the ones whose content is no markup: without an end tag they reach to the end of the page.
RAW = {"script", "style", "textarea", "title"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr", "input",
    # a formula is part of its sentence
    "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup",
    "mover", "munder", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom",
    "merror", "menclose", "mfenced", "maction",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements around page furniture, and words of class, id and role values that tell it.
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
ARTICLE = {"article", "main"}
#: Furniture that may hold <article> elements of its own, such as comments and teasers; other marks end at an article.
HOLDS_ARTICLES = FURNITURE - {"header", "form"}
HOLDS_ARTICLES_WORDS = {"comment", "comments", "disqus", "related", "replies", "reply", "respond", "sidebar"}
#: Elements of one block, mostly; the next one ends them.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd"}
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_article", "in_furniture", "heading",
)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_density: float
    in_article: bool
    in_furniture: bool
    heading: bool


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """0 for none, 1 for furniture, 2 for furniture that an article inside does not leave."""
    # a header inside an article holds its title
    if name in FURNITURE and not (name == "header" and in_article):
        return 2 if name in HOLDS_ARTICLES else 1
    if name in ARTICLE or name in ("html", "body"):
        return 0
    for found in _CLASSED.finditer(attrs):
        for token in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(re.split(r"[^a-z]+", token))
            # "has-sidebar" speaks of something else
            if FURNITURE_WORDS & words and not {"has", "with", "no", "without"} & words:
                return 0 if in_article and name == "header" else 2 if HOLDS_ARTICLES_WORDS & words else 1
    return 0


def _count_words(part: str) -> int:
    part = re.sub(r"<(script|style)\b.*?</\1\b[^>]*>", " ", part, flags=re.S | re.I)
    return len(_TOKEN.sub(" ", part).split())


def _page_wide(page: str, at: int) -> bool:
    """Does the form whose start tag ends at ``at`` hold most of the page's words?"""
    stop = re.compile(r"</form\b", re.I).search(page, at)
    return 2 * _count_words(page[at : stop.start() if stop else len(page)]) > _count_words(page)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; tags, comments, scripts and styles are gone, references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, in an article, in furniture
    held: list[str] = []
    linked: list[str] = []
    state = {"link": False}

    def here() -> tuple[bool, int]:
        return stack[-1][1:] if stack else (False, 0)

    def close(heading: bool = False) -> None:
        words = unescape("".join(held)).split()
        if words:
            link_words = len(unescape("".join(linked)).split())
            in_article, furniture = here()
            found.append(Block(" ".join(words), len(words), link_words / len(words), in_article, furniture > 0, heading))
        held.clear()
        linked.clear()

    def text(piece: str) -> None:
        held.append(piece)
        if state["link"]:
            linked.append(piece + " ")

    at = 0
    while at < len(page):
        tag = _TOKEN.search(page, at)
        if tag is None:
            text(page[at:])
            break
        if tag.start() > at:
            text(page[at : tag.start()])
        at = tag.end()
        if tag["name"] is None:
            continue
        name, ends = tag["name"].lower(), bool(tag["end"])
        if name in SILENT and not ends:
            if name not in INLINE:
                close()
            if not tag["attrs"].endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if stop is None and name not in RAW:
                    continue
                at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            if name == "a":
                state["link"] = not ends
            elif name == "br":
                text(" ")
            continue
        close(heading=ends and name in ("h1", "h2", "h3", "h4", "h5", "h6"))
        state["link"] = False
        if ends:
            places = [i for i, s in enumerate(stack) if s[0] == name]
            if places:
                del stack[places[-1] :]
        elif name not in VOID:
            if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in LEAVES)):
                stack.pop()
            in_article, furniture = here()
            own = _furniture(name, tag["attrs"], in_article)
            if name == "form" and own and not in_article and _page_wide(page, at):
                own = 0
            left = not in_article and (name == "main" or (name == "article" and furniture < 2))
            marked = own if left else max(furniture, own)
            if name not in LEAVES or marked > furniture:
                stack.append((name, in_article or name in ARTICLE, marked))
    close()
    return found


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """One row of FEATURES per block; a missing neighbour has no words."""
    edge = Block("", 0, 0.0, False, False, False)
    padded = [edge, *found, edge]
    return [
        (
            b.words, b.link_density, a.words, a.link_density, c.words, c.link_density,
            float(b.in_article), float(b.in_furniture), float(b.heading),
        )
        for a, b, c in zip(padded, found, padded[2:], strict=False)
    ]
