"""Labelled training pages: a seeded generator of page layouts whose blocks are known to be article or not.

Layouts vary in what the block features look at: containers of the article (or none), the
elements and class names of menus, notices, adverts, sidebars, forms and comments, lengths, links, and
broken markup. Words are invented; no page of any table is used.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "ba co de fi gu ha in jo ka le mo nu or pa qui re sa to un ver wi xe yo zu en er an th st ion ing ly é ß ü ñ ç".split()
_CONTAINERS = (
    "<article>", "<article>", "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">', '<div class="post-body">',
    '<section class="entry">', '<div class="article-text">', '<div id="story">', '<div class="page"><div class="text">', "<div>", "",
)


class Page:
    """A page under construction: its html and the labels (1: article) of its blocks in order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, n: int) -> str:
        styles: list[Callable[[str], str]] = [str.capitalize] * 8 + [str.upper, lambda s: s.replace(" ", "*** "), lambda s: s.replace(" ", " | "), lambda s: s.replace(" ", "&amp; ")]
        style = self.r.choice(styles)
        return " ".join(style(self.words(2, 18)) + self.r.choice(("." * 1, ".", "!", "", ".")) for _ in range(n))

    def block(self, open_: str, text: str, close: str, label: int) -> None:
        self.html.append(f"{open_}{text}{close}")
        self.labels.append(label)

    def links(self, tag: str = "li") -> None:
        for _ in range(self.r.randint(2, 8)):
            self.block(f'<{tag}><a href="/{self.word()}">', self.words(1, 3), f"</a></{tag}>", 0)

    def wrapped(self, choices: tuple[str, ...], body: Callable[[], None]) -> None:
        open_ = self.r.choice(choices)
        self.html.append(open_)
        body()
        self.html.append(f"</{open_[1:].split()[0].rstrip('>')}>")

    def plain(self, lo: int, hi: int, label: int, tags: tuple[str, ...] = ("p", "div")) -> None:
        for _ in range(self.r.randint(lo, hi)):
            tag = self.r.choice(tags)
            self.block(f"<{tag}>", self.sentences(self.r.randint(1, 3)), f"</{tag}>", label)

    # Parts that are no article.
    def menu(self) -> None:
        self.wrapped(("<nav>", "<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="nav">', '<div class="breadcrumbs">'), lambda: (self.html.append("<ul>"), self.links(), self.html.append("</ul>")))

    def head(self) -> None:
        self.wrapped(("<header>", '<div class="header">', '<div id="masthead">', '<div class="topbar">'), lambda: self.block(self.r.choice(("<h2>", "<div>", "<p>", "<h1>")), self.words(1, 8), "</div>", 0))

    def advert(self) -> None:
        self.wrapped(('<div class="ad">', '<div class="ad">', '<div class="advert">', '<div class="sponsored">', '<div class="promo-banner">', '<aside class="ads">'), lambda: (self.html.append(self.r.choice(("", "<p>"))), self.block("", self.sentences(self.r.randint(1, 3)), "", 0)))

    def notice(self) -> None:
        self.wrapped(('<div class="cookie-notice">', '<div id="consent">', '<div class="newsletter">', '<div class="alert" role="alert">', '<div class="popup">', '<section class="subscribe">'), lambda: self.plain(1, 2, 0))

    def sidebar(self) -> None:
        self.wrapped(("<aside>", '<div class="sidebar">', '<div id="related">', '<div class="widget">', '<aside class="rail">'), lambda: self.r.choice((lambda: self.plain(1, 3, 0), lambda: (self.html.append("<ul>"), self.links(), self.html.append("</ul>")), lambda: self.links("p")))())

    def form(self) -> None:
        self.wrapped(("<form>", '<form class="search">', '<form id="login">'), lambda: [self.block("<p>", f'{self.words(1, 8)} <input name="x">', "</p>", 0) for _ in range(self.r.randint(1, 3))])

    def comments(self) -> None:
        self.wrapped(('<div class="comments">', '<section id="comments">', '<section class="comment-list">', '<div id="disqus">', '<div class="discussion">', '<div class="reader-replies">'), lambda: self.plain(1, 6, 0, ("p", "div", "li")))

    def foot(self) -> None:
        self.wrapped(("<footer>", "<footer>", '<div class="footer">', '<div id="site-foot">', '<div class="copyright">'), lambda: self.block(self.r.choice(("", "<p>", "<div>")), self.r.choice(("&copy; ", "", "")) + self.words(1, 5) + self.r.choice((" &middot; ", " ", ". ")) + self.sentences(1), "", 0))

    def article(self) -> None:
        open_ = self.r.choice(_CONTAINERS)
        self.html.append(open_)
        if self.r.random() < 0.8:
            self.block("<h1>", self.words(2, 9), "</h1>", 1)
        inner = [self.advert, self.sidebar, self.form, self.notice]
        for _ in range(self.r.choice((1, 3, 5, 8, 12, 20))):
            x = self.r.random()
            if x < 0.62:
                self.block("<p>", self.sentences(self.r.choice((1, 1, 2, 4, 7))), "</p>", 1)
            elif x < 0.72:
                self.block("<p><b>", self.sentences(self.r.choice((1, 2))), "<br>", 1)
            elif x < 0.76:
                self.block(self.r.choice(("<h2>", "<h3>")), self.words(1, 7), self.r.choice(("</h2>", "</h3>")), 1)
            elif x < 0.80:
                self.html.append("<ul>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("<li>", self.words(1, 16), "</li>", 1)
                self.html.append("</ul>")
            elif x < 0.84:
                self.block("<blockquote>", self.sentences(2), "</blockquote>", 1)
            elif x < 0.87:
                self.block("<pre>", self.words(3, 20), "</pre>", 1)
            elif x < 0.91:
                self.block("<p>", f'{self.sentences(1)} <a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentences(1)}', "</p>", 1)
            elif x < 0.94:
                self.block("<p>", self.words(1, 3), "</p>", 1)
            elif open_:
                self.r.choice(inner)()
        if open_ and self.r.random() < 0.08:
            self.comments()
        for tag in reversed([t.split()[0].strip("<>") for t in open_.replace("><", ">|<").split("|") if t]):
            self.html.append(f"</{tag}>")

    def build(self) -> tuple[str, list[int]]:
        before = [p for p in (self.head, self.menu, self.advert, self.notice, self.form, self.sidebar) if self.r.random() < 0.45]
        after = [p for p in (self.sidebar, self.comments, self.advert, self.form, self.menu, self.notice) if self.r.random() < 0.35]
        self.r.shuffle(after)
        for part in (*before, self.article, *after, *([self.foot] if self.r.random() < 0.85 else [])):
            part()
        body = "".join(self.html)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='<p>';</script></head><body>{body}</body></html>", self.labels


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    return [Page(seed * 100_003 + i).build() for i in range(n)]
