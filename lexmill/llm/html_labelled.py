"""Labelled pages to train on: invented pages of many layouts whose elements say what is main text.

An element with ``data-main="1"`` holds main text, one with ``data-main="0"`` does not; the
nearest such element around a block gives its label.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "an be co da el fi go ha il jo ke lo mi na or pe qu ra so ti un ve wi xa yo ze für ción eau".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most))).capitalize()

    def sentences(self, most: int) -> str:
        return " ".join(self.phrase(1, 16) + self.r.choice("....?!") for _ in range(self.r.randint(1, most)))

    def attr(self, *names: str) -> str:
        name = self.r.choice(names)
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.phrase(1, 3)}</a></{tag}>' for _ in range(self.r.randint(3, 8)))

    def wrap(self, main: int, tag: str, names: tuple[str, ...], body: str) -> str:
        return f'<{tag}{self.attr(*names)} data-main="{main}">{body}</{tag}>'

    # what is not main text
    def nav(self) -> str:
        return self.wrap(0, self.r.choice(("nav", "nav", "div", "ul")), ("nav", "menu", "navbar", "main-menu", "breadcrumb", "", ""), f"<ul>{self.links()}</ul>")

    def header(self) -> str:
        body = f"<h2>{self.phrase(1, 4)}</h2>" if self.r.random() < 0.5 else f"<div>{self.phrase(1, 5)}</div>"
        return self.wrap(0, self.r.choice(("header", "header", "div")), ("header", "site-header", "masthead", "banner", "top"), body + (self.nav() if self.r.random() < 0.5 else f"<p>{self.phrase(2, 8)}</p>"))

    def footer(self) -> str:
        body = f"&copy; {self.word()}.example &middot; {self.sentences(3)}" if self.r.random() < 0.6 else f"<p>{self.sentences(2)}</p><ul>{self.links()}</ul>"
        return self.wrap(0, self.r.choice(("footer", "footer", "div")), ("footer", "site-footer", "bottom", "copyright"), body)

    def ad(self) -> str:
        body = self.r.choice((self.sentences(3), f"<p>{self.sentences(2)}</p>", f'<a href="/x">{self.phrase(2, 9)}</a>'))
        return self.wrap(0, self.r.choice(("div", "div", "aside", "section")), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-box"), body)

    def aside(self) -> str:
        body = self.r.choice((f"<h3>{self.phrase(1, 3)}</h3><ul>{self.links()}</ul>", f"<p>{self.sentences(3)}</p>", f"<h4>{self.phrase(1, 3)}</h4><p>{self.sentences(2)}</p>"))
        return self.wrap(0, self.r.choice(("aside", "aside", "div")), ("sidebar", "related", "widget", "side", "popular", "recommended", "trending"), body)

    def notice(self) -> str:
        body = f"<p>{self.sentences(3)}</p><button>{self.phrase(1, 2)}</button>" if self.r.random() < 0.6 else self.sentences(2)
        return self.wrap(0, self.r.choice(("div", "div", "section", "dialog")), ("cookie", "cookie-notice", "consent", "gdpr", "notice", "newsletter", "popup", "modal", "alert", "subscribe"), body)

    def form(self) -> str:
        return f'<form{self.attr("", "search", "login", "signup", "contact")} data-main="0"><label>{self.phrase(1, 3)}</label><input name="q"><select><option>{self.word()}</option><option>{self.word()}</option></select><p>{self.sentences(1)}</p><button>{self.phrase(1, 2)}</button></form>'

    def comments(self) -> str:
        item = lambda: self.r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.sentences(4)}</p></div>', f"<li><p>{self.word()}</p><p>{self.sentences(3)}</p></li>", f"<article><h4>{self.word()}</h4><p>{self.sentences(5)}</p></article>"))
        return self.wrap(0, self.r.choice(("section", "div", "ol", "aside")), ("comments", "comment-list", "responses", "replies", "discussion", "user-comments", "reader-comments"), f"<h3>{self.phrase(1, 3)}</h3>" + "".join(item() for _ in range(self.r.randint(1, 5))))

    def share(self) -> str:
        return self.wrap(0, "div", ("share", "social", "share-buttons", "tags", "toolbar"), self.links("span"))

    # main text
    def part(self) -> str:
        x = self.r.random()
        if x < 0.55:
            return f"<p>{self.sentences(7)}</p>"
        if x < 0.65:
            return f"<p>{self.r.choice((self.phrase(1, 3) + '.', self.phrase(1, 4)))}</p>"
        if x < 0.71:
            return f"<p><b>{self.sentences(3)}<br><p>{self.sentences(3)}</p>"
        if x < 0.78:
            return f"<h{(h := self.r.randint(2, 4))}>{self.phrase(1, 6)}</h{h}>"
        if x < 0.85:
            return "<ul>" + "".join(f"<li>{self.sentences(1)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if x < 0.89:
            return f"<blockquote><p>{self.sentences(3)}</p></blockquote>"
        if x < 0.92:
            return f"<pre>{self.phrase(3, 20)}</pre>"
        if x < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.phrase(1, 3)}</td><td>{self.phrase(1, 4)}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if x < 0.98:
            return f'<p>{self.phrase(2, 9)} <a href="/{self.word()}">{self.phrase(1, 3)}</a> {self.sentences(2)}</p>'
        return f"<div>{self.sentences(5)}</div>"

    def article(self) -> str:
        """The main text, in an element that says so, in one that does not, or in none at all."""
        if self.r.random() < 0.15:  # one paragraph is all
            parts, more = [f"<p>{self.sentences(5)}</p>"], []
        else:
            parts = [f"<h1>{self.phrase(1, 9)}{self.r.choice(('', '', '.'))}</h1>"] if self.r.random() < 0.8 else []
            if parts and self.r.random() < 0.2:
                parts = [f"<header>{parts[0]}<p>{self.phrase(3, 12)}</p></header>"]
            for _ in range(self.r.randint(1, 14)):
                parts.append(self.part())
                if self.r.random() < 0.05:
                    parts.append(self.r.choice((self.ad, self.share, self.aside))())
            more = [self.r.choice((self.comments, self.share, self.form))()] if self.r.random() < 0.12 else []
        x = self.r.random()
        if x < 0.42:
            return self.wrap(1, "article", ("", "", "post", "article", "entry"), "".join(parts + more))
        if x < 0.56:
            return self.wrap(1, "main", ("", "content", "main"), "".join(parts + more))
        if x < 0.72:
            return self.wrap(1, self.r.choice(("div", "div", "section")), ("content", "article-body", "post", "entry-content", "main-content", "story", "text"), "".join(parts + more))
        if x < 0.84:
            return self.wrap(1, self.r.choice(("div", "div", "section", "td")), ("",), "".join(parts))
        mark = lambda p: p if "data-main" in p else _OUTER.sub(r'<\1 data-main="1">', p)
        return "".join(map(mark, parts))

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.nav, self.ad, self.notice, self.form, self.aside) if r.random() < 0.45]
        after = [f() for f in (self.share, self.aside, self.ad, self.comments, self.form, self.notice, self.nav, self.footer) if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.15:
            before, after = [], []
        article = self.article()
        if article.startswith("<td"):
            before, after = [f"<table><tr><td>{''.join(before)}</td>"], [f"<td>{''.join(after)}</td></tr></table>"]
        body = "".join([*before, article, *after])
        if r.random() < 0.4:
            body = f'<div{self.attr("wrapper", "container", "page", "site", "")}>{body}</div>'
        end = "</body></html>" if r.random() < 0.85 else ""
        head = f'<head><meta charset="utf-8"><title data-main="0">{self.phrase(1, 8)}</title><style>p{{margin:0}}</style><script>var a="</p>";</script></head>' if r.random() < 0.7 else ""
        return f'<!DOCTYPE html><html>{head}<body data-main="0">{body}{end}'


#: Start tags of main text that stands in no element of its own.
_OUTER = re.compile(r"<(p|h[1-6]|ul|blockquote|pre|table|div|header)>")


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """``n`` labelled pages, the same for the same seed."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
