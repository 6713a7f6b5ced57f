"""Tags of HTML in time linear in its length, whatever is left open in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*+))")
_COMMENT_END = re.compile(r"--!?>")
_QUOTED = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_MARK = re.compile(r"[>\"']")


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of each tag; comments and declarations have an empty name.

    What lies between them is text.  A comment that is not closed takes in the rest; quotes that are not
    closed are no quotes, so the next ``>`` ends the tag; without one, ``<`` is text.  By sending a position
    the caller makes the scan go on from there.
    """
    at, last, pairs = 0, html.rfind(">"), True
    dead: set[int] = set()  # quotes from which no end of a tag is reached

    def end_of(begin: int) -> int:
        nonlocal pairs
        if pairs:
            m = _QUOTED.match(html, begin)
            if m:
                return m.end()
            pairs = False  # from now on, no stretch is searched in vain twice
        at, passed = begin, []
        while m := _MARK.search(html, at):
            if m[0] == ">":
                return m.end()
            if m.start() in dead:
                break
            passed.append(m.start())
            at = html.find(m[0], m.end()) + 1
            if not at:
                break
        dead.update(passed)
        return html.find(">", begin) + 1

    while m := _START.search(html, at):
        begin = m.start()
        if m[1]:
            stop = _COMMENT_END.search(html, m.end())
            at = stop.end() if stop else len(html)
            found = (begin, at, False, "", "")
        elif m.end() > last:
            at = begin + 1
            continue
        elif m[2]:
            at = html.find(">", begin) + 1
            found = (begin, at, False, "", "")
        else:
            at = end_of(m.end())
            found = (begin, at, bool(m[3]), m[4].lower(), html[m.end() : at - 1])
        jump = yield found
        if jump is not None:
            at = jump


def end_of_element(html: str, name: str, at: int) -> tuple[int, int]:
    """Where the text of an element ends that holds no other tags, and where its end tag does."""
    m = _ENDS.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)).search(html, at)
    return (m.start(), m.end()) if m else (len(html), len(html))


_ENDS: dict[str, re.Pattern] = {}
