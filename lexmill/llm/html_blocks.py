"""DOM leaf blocks of a page, and their features.

A leaf block is a run of text between the boundaries of block-level elements, with the open
elements around it. Character references are decoded and white space becomes single spaces.

Pages are read in one sweep, as browsers read them: nothing that a page holds is an error, a tag
that nothing ends runs to the end of the page, as does a comment or a script, and every
declaration that is no comment ends at the next ``>``. The time is in proportion to the page.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Callable, Collection

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea".split())
#: Elements that a start tag of the same kind closes.
_CLOSES = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
#: Start tags that end an open paragraph.
_ENDS_P = BLOCK_TAGS - {"button", "label", "option", "select"}

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "linked", "tag", "around", "mark")

    def __init__(self, text: str, linked: int, tag: str, around: frozenset[str], mark: str | None):
        self.text, self.linked, self.tag, self.around, self.mark = text, linked, tag, around, mark


#: Elements whose content is no markup.
RAW_TAGS = frozenset(("script", "style"))
_TAG = re.compile(r"[^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_GAP = re.compile(r"[\s/]*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW_TAGS}
_ZEROS = re.compile(r"(&#[xX]?)0{8,}")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def decoded(text: str) -> str:
    """A text with its character references decoded; numbers beyond all characters are U+FFFD."""
    if "&" not in text:
        return text
    return _html.unescape(_LONG_REFERENCE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", text)))


class _Reader:
    """Collects blocks. ``mark`` is the value of the nearest ``data-main``, which labelled pages carry.

    With ``known``, elements and names that it has not are left out of what is around a block, so
    that this stays small however deep a page nests.
    """

    def __init__(self, marks: bool = False, known: Collection[str] | None = None):
        self.blocks: list[Block] = []
        self.marks, self.known = marks, known
        # (tag, block tag, features of it and those around it, mark)
        self.stack: list[tuple[str, str, frozenset[str], str | None]] = [("", "", frozenset(), None)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.hidden = 0

    def read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 == end:
                self.data(page[at:])
                break
            what = page[lt + 1]
            if what.isascii() and what.isalpha():
                self.data(page[at:lt])
                at = self.tag(page, lt)
            elif what in "/!?":
                self.data(page[at:lt])
                at = self.other(page, lt, what)
            else:
                self.data(page[at : lt + 1])
                at = lt + 1
        self.flush()

    def tag(self, page: str, lt: int) -> int:
        """Where the start tag at ``lt`` ends; an unfinished one is dropped with the rest of the page."""
        name = _TAG.match(page, lt + 1)
        at, attributes = name.end(), []
        while True:
            found = _ATTRIBUTE.match(page, at)
            if not found:
                break
            attributes.append((found[1].lower(), found[2]))
            at = found.end()
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return at
        tag = name[0].lower()
        self.start(tag, attributes)
        at += 1
        if tag in RAW_TAGS:
            close = _RAW_END[tag].search(page, at)
            return close.start() if close else len(page)
        return at

    def other(self, page: str, lt: int, what: str) -> int:
        """Where the end tag, comment, declaration or instruction at ``lt`` ends."""
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                return page.index(">", lt) + 1
            end = page.find("-->", lt + 4)
            return len(page) if end < 0 else end + 3
        end = page.find(">", lt)
        if end < 0:
            return len(page)
        name = _TAG.match(page, lt + 2)[0]
        if what == "/" and name[:1].isascii() and name[:1].isalpha():
            self.finish(name.lower())
        return end + 1

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, tag, around, mark = self.stack[-1]
                self.blocks.append(Block(text, min(self.linked, len(text)), tag, around, mark))
            self.parts, self.linked = [], 0

    def pop(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while True:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            self.hidden -= last in HIDDEN_TAGS
            if last == tag:
                return

    def start(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            return
        if tag in _CLOSES and self.stack[-1][0] == _CLOSES[tag]:
            self.pop(tag)
        elif tag in _ENDS_P and self.open["p"]:
            self.pop("p")
        above = self.stack[-1]
        around, mark = above[2], above[3]
        own = ["in=" + tag] if tag in BLOCK_TAGS else []
        for name, value in attributes:
            value = value[1:-1] if value and value[0] in "\"'" and value[-1] == value[0] and len(value) > 1 else value
            if name in ("class", "id", "role") and value:
                own += ["named=" + w.lower() for w in _WORD.findall(decoded(value))]
            elif self.marks and name == "data-main":
                mark = value
        new = {f for f in own if f not in around and (self.known is None or f in self.known)}
        self.stack.append((tag, tag if tag in BLOCK_TAGS else above[1], around | new if new else around, mark))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN_TAGS

    def finish(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        self.pop(tag)

    def data(self, text: str) -> None:
        if text and not self.hidden:
            text = decoded(text)
            self.parts.append(text)
            if self.open["a"] or self.open["button"]:
                self.linked += len(text.strip())


def blocks(html: str | None, marks: bool = False, known: Collection[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; null and empty pages have none."""
    if not html:
        return []
    reader = _Reader(marks, known)
    reader.read(html)
    return reader.blocks


_SCALE = (10, 25, 60, 140, 400)


def text_features(page: list[Block], k: int) -> list[str]:
    """What a block's text and place say, apart from the elements around it."""
    b = page[k]
    n = len(b.text)
    share = b.linked / n
    words = b.text.count(" ") + 1
    size = sum(n >= s for s in _SCALE)
    out = [
        f"tag={b.tag}",
        f"size={size}",
        f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.9 else 3}",
        f"stop={b.text[-1] in '.!?…:;”\"'}",
        f"words={min(words, 4) if words < 4 else 4 if words < 12 else 12}",
        f"tag={b.tag},size={size // 2}",
    ]
    if "©" in b.text:
        out.append("copyright")
    if k and page[k - 1].tag == b.tag:
        out.append("like=before")
    if k + 1 < len(page) and page[k + 1].tag == b.tag:
        out.append("like=after")
    return out


def features(page: list[Block], around: Callable[[frozenset[str]], object] = sorted) -> list[list[str]]:
    """All features of each block: the elements and names around it, and its text."""
    return [[*around(b.around), *text_features(page, k)] for k, b in enumerate(page)]
