"""Leaf blocks of a web page: the text between block-level tags, with its path of open tags.

The path leaves out inline tags that have no class, id or role of their own.
"""

from __future__ import annotations

import html as entities
import re

from rankweave.llm.html_tokens import end_of_element, tags as tags_of

#: HTML's names of elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li link main menu meta nav noframes noscript object ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template title textarea iframe noframes noembed xmp".split())
CLOSES_P = BLOCKS - frozenset("button label option select head html body".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "thead": ("tbody",), "tfoot": ("tbody",)}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def _label(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role."""
    if "=" not in attributes:
        return tag
    words = [w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([tag, *words])


def blocks(html: str) -> list[Block]:
    """All blocks that hold text, in page order; white space within one is a single space."""
    out: list[Block] = []
    tags: list[str] = []
    labels: list[str] = []
    parts: list[str] = []
    path: tuple[str, ...] | None = None
    in_link, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked, path
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, path or (), min(linked, len(text))))
            parts.clear()
        linked, path = 0, None

    def close(k: int) -> None:
        nonlocal in_link
        for t in tags[k:]:
            if t == "a":
                in_link -= 1
        del tags[k:], labels[k:]

    def last(names: tuple[str, ...], scopes: frozenset[str]) -> int:
        for k in range(len(tags) - 1, -1, -1):
            if tags[k] in names:
                return k
            if tags[k] in scopes:
                return -1
        return -1

    def text(piece: str) -> None:
        nonlocal path, linked
        if path is None and not piece.isspace():
            path = tuple(x for x in labels if x in BLOCKS or " " in x or "-" in x)
        parts.append(piece)
        if in_link:
            linked += len(piece.strip())

    found, jump = tags_of(html), None
    while True:
        try:
            begin, end, closing, tag, attributes = found.send(jump)
        except StopIteration:
            break
        jump = None
        if begin > at:
            text(html[at:begin])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCKS:
                flush()
            k = last((tag,), frozenset() if tag in SCOPES else SCOPES)
            if k >= 0:
                close(k)
            continue
        if tag in UNSEEN:
            if not attributes.endswith("/"):
                at = jump = end_of_element(html, tag, at)[1]
            if tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and (k := last(("p",), SCOPES)) >= 0:
                close(k)
            if tag in SIBLINGS and (k := last(SIBLINGS[tag], frozenset(("table", "ul", "ol", "dl", "select")))) >= 0:
                close(k)
        elif tag in ("br", "wbr"):
            parts.append("\n" if tag == "br" else "")
        if tag not in VOID and not attributes.endswith("/"):
            tags.append(tag)
            labels.append(_label(tag, attributes))
            if tag == "a":
                in_link += 1
    if at < len(html):
        text(html[at:])
    flush()
    return out
