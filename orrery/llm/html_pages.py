"""Labelled pages for the content model: layouts of many kinds, with the article marked.

Each page is written from parts of its own wording; ``data-label`` on an element says whether it and
what it holds, up to the next mark, is the article (1) or not (0). A fifth of the pages have no wrapper
around the article.
"""

from __future__ import annotations

import random

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()
#: Class and id names that sites give to what isn't the article, by kind.
NAMES = {
    "menu": ("nav", "menu", "navbar", "main-menu", "top-nav", "breadcrumb", "breadcrumbs", "navigation", "pagination", "toc"),
    "head": ("header", "site-header", "page-header", "masthead", "topbar", "banner", "branding", "logo"),
    "foot": ("footer", "site-footer", "page-footer", "bottom", "copyright", "legal", "colophon"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "tags", "archive", "right-col", "teaser", "more-stories"),
    "notice": ("notice", "cookie", "cookie-notice", "cookie-banner", "gdpr", "consent", "alert", "popup", "modal", "overlay", "paywall", "announcement", "subscribe-notice"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "adbox", "banner-ad", "promotion"),
    "form": ("form", "search", "search-form", "login", "signup", "newsletter", "subscribe", "contact-form"),
    "comments": ("comments", "comment-list", "comment", "disqus", "replies", "reader-comments", "discussion", "responses", "user-comments", "comment-section"),
    "share": ("share", "social", "social-links", "share-buttons", "follow", "byline-share", "print-links"),
}
CONTENT_NAMES = ("content", "article", "post", "entry", "entry-content", "article-body", "post-body", "story", "main", "main-content", "text", "body", "page-content", "post-content")


class Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.random
        return " ".join(r.choice(WORDS) for _ in range(r.randint(least, most)))

    def prose(self, most: int = 5) -> str:
        r = self.random
        text = " ".join(self.words(1, 18).capitalize() + r.choice(".....?!") for _ in range(r.randint(1, most)))
        return text if r.random() < 0.7 else r.choice(("<b>{}</b>", "<i>{}</i> " + self.prose(2), "<a href='/x'>" + self.words(1, 3) + "</a> {}", "{} <em>" + self.words(1, 2) + "</em>", "<b>{}<br>", "{}<br>" + self.prose(2), "<span>{}</span>")).format(text)

    def attribute(self, kind: str) -> str:
        r = self.random
        name = r.choice(NAMES[kind])
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1, 1)}"'))

    def links(self) -> str:
        r = self.random
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(r.randint(2, 8))]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)))()

    def other(self, kind: str) -> str:
        """A part that isn't the article, by an element of its own or a named division."""
        r = self.random
        body = {
            "menu": self.links,
            "head": lambda: r.choice((f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", f"<a href='/'>{self.words(1, 3)}</a>", f"<div class='logo'>{self.words(1, 2)}</div>{self.links()}", f"<p>{self.prose(2)}</p>")),
            "foot": lambda: r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(2)}", f"<p>{self.prose(2)}</p>{self.links()}", self.prose(1))),
            "side": lambda: r.choice((f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<h2>{self.words(1, 3)}</h2><p>{self.prose(3)}</p>", f"<p>{self.prose(2)}</p>", self.prose(2))),
            "notice": lambda: r.choice((f"<p>{self.prose(3)}</p><button>{self.words(1, 2)}</button>", self.prose(3), f"<p>{self.prose(2)}</p>")),
            "ad": lambda: r.choice((self.prose(3), f"<p>{self.prose(3)}</p>", f"<a href='http://x.example/'>{self.prose(1)}</a>", f"<h4>{self.words(2, 4)}</h4><p>{self.prose(2)}</p>")),
            "form": lambda: f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(0, 5)}</textarea><button>{self.words(1, 2)}</button>",
            "comments": lambda: f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + "".join(r.choice((f"<div class='comment'><b>{self.words(1, 2)}</b><p>{self.prose(3)}</p></div>", f"<li>{self.prose(3)}</li>", f"<p>{self.prose(4)}</p>", f"<article class='comment'><p>{self.prose(3)}</p></article>")) for _ in range(r.randint(1, 5))),
            "share": self.links,
        }[kind]()
        own = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if own and r.random() < 0.6:
            return f'<{own}{self.attribute(kind) if r.random() < 0.3 else ""} data-label="0">{body}</{own}>'
        tag = r.choice(("div", "div", "section", "ul" if body.startswith("<li") else "div"))
        return f'<{tag}{self.attribute(kind)} data-label="0">{body}</{tag}>'

    def block(self) -> str:
        r = self.random
        return r.choice((
            *[lambda: f"<p>{self.prose()}</p>"] * 6,
            lambda: f"<p>{self.prose()}", lambda: f"<h2>{self.words(1, 8)}</h2>", lambda: f"<blockquote><p>{self.prose()}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{self.prose(2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", lambda: f"<div>{self.prose()}</div>",
            lambda: f"<pre>{self.words(2, 12)}</pre>", lambda: f"<table><tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}</table>",
            lambda: f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>", lambda: f"<section><h3>{self.words(1, 5)}</h3><p>{self.prose()}</p></section>",
            lambda: f"<p>{self.words(1, 1).capitalize()}.</p>", self.formula, self.drawing,
        ))()

    def article(self) -> str:
        r = self.random
        blocks = [self.block() for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14)))]
        for kind in ("ad", "share", "form", "notice", "side", "comments", "menu"):
            if r.random() < 0.16:
                blocks.insert(len(blocks) if kind == "comments" else r.randint(0, len(blocks)), self.other(kind))
        title = f"<h1>{self.words(1, 9).capitalize()}</h1>"
        body = r.choice((title, title, f"<header>{title}</header>", "" if blocks else title)) + "".join(blocks)
        inner = lambda x: f'<div class="{r.choice(CONTENT_NAMES)}">{x}</div>'
        kind = r.random()
        if kind < 0.55:
            return f'<article data-label="1">{body}</article>'
        if kind < 0.65:
            return f'<article class="{r.choice(CONTENT_NAMES)}" data-label="1">{inner(body)}</article>'
        if kind < 0.8:
            return f'<main data-label="1">{body}</main>'
        return f'<div {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}" data-label="1">{body}</div>'

    def formula(self) -> str:
        return f"<p>{self.words(1, 4)} <math><mi>{self.words(1, 1)[:1]}</mi><mo>=</mo><mn>2</mn></math> {self.words(1, 4)}</p>"

    def drawing(self) -> str:
        return f"<figure><svg width=9><title>{self.words(1, 2)}</title><text x=1>{self.words(1, 4)}</text></svg><object data=x>{self.words(2, 6)}</object></figure>"

    def bare(self) -> str:
        """A page whose article has no wrapper of its own: blocks, or text alone, between the other parts or by itself."""
        r = self.random
        others = lambda kinds, p: [self.other(k) for k in kinds if r.random() < p]
        blocks = [self.block() for _ in range(r.choice((1, 2, 3, 5, 9)))]
        kind = r.random()
        if kind < 0.2:
            return f'<html data-label="1">{r.choice((self.prose(4), "".join(blocks), self.prose(1) + "".join(blocks)))}'
        title = f"<h1>{self.words(1, 8)}</h1>" if r.random() < 0.5 else ""
        before, after = others(("menu", "head", "ad", "notice", "form"), 0.3), others(("side", "share", "comments", "foot"), 0.3)
        inner = title + "".join(blocks)
        if kind < 0.45:
            wrapper = r.choice(("div", "section", "div class='wrapper'", "div id='page'", "table><tr><td"))
            inner = f'<{wrapper.split(">")[0]} data-label="1">{"<tr><td>" if ">" in wrapper else ""}{inner}</{wrapper.split()[0].split(">")[0]}>'
            return f'<html><body data-label="0">{"".join(before)}{inner}{"".join(after)}</body></html>'
        return f'<html><head><title>{self.words(1, 5)}</title></head><body data-label="1">{"".join(before)}{inner}{"".join(after)}</body></html>'

    def page(self) -> str:
        r = self.random
        if r.random() < 0.2:
            return self.bare()
        before = [self.other(k) for k in ("notice", "head", "menu", "ad", "form", "side", "share") if r.random() < 0.45]
        after = [self.other(k) for k in ("share", "ad", "side", "comments", "menu", "form", "notice", "foot", "foot") if r.random() < 0.4]
        middle = self.article() if r.random() < 0.96 else ""
        kind = r.random()
        if kind < 0.15:
            middle = f'<main data-label="0">{middle}{"".join(after[:1])}</main>'
            after = after[1:]
        elif kind < 0.3:
            middle = f'<div class="{r.choice(("container", "wrapper", "page", "layout", "row", "site"))}">{"".join(before)}{middle}{"".join(after)}</div>'
            before, after = [], []
        noscript = f"<noscript data-label='0'>{self.prose(1)}</noscript>" if r.random() < 0.1 else ""
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body data-label="0">{noscript}{"".join(before)}{middle}{"".join(after)}</body></html>'


def labelled_pages(n: int = 320, seed: int = 20) -> list[str]:
    return [Writer(seed * 100_003 + k).page() for k in range(n)]
