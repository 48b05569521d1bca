"""Labelled pages for the extractor: random layouts in the vocabulary of common
content systems.  Text that belongs to the article carries a mark which the
trainer reads and which never occurs in real pages."""

from __future__ import annotations

import random

MARK = "\ue000"

_MAIN = ["article", "div class='article'", "div class='post-content'", "div class='entry-content'", "div id='content'", "main", "div id='main-content'", "section class='story-body'", "div class='article-body'", "div itemprop='articleBody'", "div class='post'", "div role='main'", "div class='text'", "article class='post hentry'", "div class='content-area'", "section"]
_WRAP = ["div", "div class='container'", "div id='wrapper'", "div class='page'", "div class='row'", "div class='col-md-8'", "main", "section", "div id='page'", "div class='layout'"]
_OFF = {
    "nav": ["nav", "div class='nav'", "div id='menu'", "ul class='menu'", "div class='navbar'", "div role='navigation'", "div class='breadcrumbs'", "div class='pagination'", "nav class='site-navigation'", "div class='topnav'"],
    "header": ["header", "div id='header'", "div class='site-header'", "div class='masthead'", "div role='banner'", "div class='branding'"],
    "footer": ["footer", "div id='footer'", "div class='site-footer'", "div class='footer-widgets'", "div role='contentinfo'", "div class='copyright'", "div class='legal'"],
    "aside": ["aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related-posts'", "div class='recommended'", "section class='trending'", "aside class='related'", "div class='popular'"],
    "ad": ["div class='ad'", "div class='ads'", "div class='advert'", "div id='ad-top'", "div class='advertisement'", "div class='sponsored'", "div class='promo'", "div class='banner-ad'", "aside class='ad'", "div class='promotion'"],
    "notice": ["div class='cookie-banner'", "div id='cookie-notice'", "div class='notice'", "div class='alert'", "div class='consent'", "div class='gdpr'", "div class='warning'", "div class='popup'", "div class='modal'", "dialog", "div role='alert'", "div class='subscribe'", "div class='newsletter'", "div class='paywall'", "div class='disclaimer'"],
    "form": ["form", "form class='search'", "div class='search-form'", "div class='login'", "form id='signup'", "fieldset"],
    "comments": ["div class='comments'", "section id='comments'", "div class='comment-list'", "ol class='commentlist'", "div id='disqus_thread'", "section class='comments-area'", "div class='user-comments'", "div class='replies'", "div class='discussion'", "div class='reader-comments'", "section class='responses'"],
    "list": ["div", "ul", "p", "td", "section", "div class='list'", "div class='box'", "div class='block'"],
    "share": ["div class='share'", "ul class='social'", "div class='social-links'", "div class='sharing'", "div class='tags'", "div class='byline-tools'", "div class='author-bio'"],
}


def _tag(opening: str) -> str:
    return opening.split()[0]


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = "etaoinshrdlucmfwypvbgk"
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(200)]

    def text(self, low: int, high: int, stop: float = 0.12) -> str:
        r, out, start = self.rng, [], True
        for _ in range(r.randint(low, high)):
            w = r.choice(self.words)
            out.append((w.capitalize() if start else w) + ("." if r.random() < stop else "," if r.random() < 0.07 else ""))
            start = out[-1].endswith(".")
        return " ".join(out) + ("." if stop else "")

    def wrap(self, opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{_tag(opening)}>"

    def block(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.1:
            t = self.text(1, 9, 0)
            return f"<h{r.randint(2, 4)}>{MARK}{t}</h{r.randint(2, 4)}>"
        t = MARK + self.text(*r.choice([(1, 4), (2, 12), (10, 40), (30, 90), (30, 160)]))
        if r.random() < 0.15:
            t = t.replace(" ", f" <a href='/x'>{r.choice(self.words)}</a> ", 1)
        if kind < 0.8:
            return r.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<div>{t}</div>", f"<p class='{r.choice(['lead', 'intro', 'text', 'par'])}'>{t}</p>"])
        if kind < 0.88:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{MARK}{self.text(2, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.93:
            return f"<blockquote><p>{t}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.text(1, 4, 0)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<pre>{t}</pre>"

    def off(self, kind: str) -> str:
        r = self.rng
        opening = r.choice(_OFF[kind])
        if kind == "list":  # links without a word on what they are
            links = [f"<a href='/{r.choice(self.words)}'>{self.text(1, 6, 0)}</a>" for _ in range(r.randint(2, 9))]
            inner = "".join(f"<li>{x}</li>" for x in links) if _tag(opening) == "ul" else r.choice([" ", " | ", "<br>", ""]).join(links)
        elif kind in ("nav", "share"):
            links = [f"<a href='/{r.choice(self.words)}'>{self.text(1, 3, 0)}</a>" for _ in range(r.randint(2, 9))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 and _tag(opening) != "ul" else ("".join(f"<li>{x}</li>" for x in links) if _tag(opening) == "ul" else " | ".join(links))
        elif kind == "comments":
            inner = "".join(r.choice(["<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>", "<div class='comment-body'>{}</div>"]).format(self.text(3, 60)) for _ in range(r.randint(1, 6)))
            if r.random() < 0.5:
                inner = f"<h3>{self.text(1, 3, 0)}</h3>" + inner
        elif kind == "form":
            inner = f"<label>{self.text(1, 4, 0)}</label><input name='q'><textarea>{self.text(1, 3)}</textarea><button>{self.text(1, 2, 0)}</button>" + (f"<p>{self.text(3, 20)}</p>" if r.random() < 0.3 else "")
        elif kind == "aside":
            inner = f"<h3>{self.text(1, 3, 0)}</h3>" + r.choice([f"<p>{self.text(5, 60)}</p>", "<ul>" + "".join(f"<li><a href='#'>{self.text(2, 8, 0)}</a></li>" for _ in range(4)) + "</ul>", self.text(2, 30)])
        else:
            t = self.text(*r.choice([(1, 6), (4, 20), (10, 50)]))
            inner = r.choice([t, f"<p>{t}</p>", f"<p>{t}</p><p>{self.text(2, 20)}</p>", f"&copy; {t} &middot; <a href='/a'>{self.text(1, 2, 0)}</a>", f"<div><span>{t}</span></div>"])
        if kind in ("header", "footer") and r.random() < 0.3:
            inner += self.off(r.choice(["nav", "share", "form"]))
        if r.random() < 0.05:
            opening += " style='display:none'"
        return self.wrap(opening, inner)

    def page(self) -> str:
        r = self.rng
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.75:
            blocks.insert(0, f"<h1>{MARK}{self.text(2, 12, 0)}</h1>")
        for kind in ("ad", "aside", "share", "notice", "form", "comments"):
            if r.random() < 0.15:
                blocks.insert(len(blocks) if kind in ("comments", "share") else r.randint(0, len(blocks)), self.off(kind))
        bare = r.random() < 0.03
        main = "".join(blocks) if bare else self.wrap(r.choice(_MAIN) if r.random() < 0.85 else "div", "".join(blocks))
        for _ in range(r.choice([0, 0, 1, 2])):
            main = self.wrap(r.choice(_WRAP), main + "".join(self.off(k) for k in ("aside", "ad", "comments", "share", "list") if r.random() < 0.15))
        before = [self.off(k) for k in ("header", "nav", "notice", "ad", "form", "list") if r.random() < 0.45]
        after = [self.off(k) for k in ("comments", "aside", "share", "ad", "nav", "form", "list", "notice", "footer") if r.random() < 0.35]
        if r.random() < 0.3:
            r.shuffle(before)
        return f"<html><head><title>{self.text(1, 9, 0)}</title></head><body>" + "".join(before) + main + "".join(after) + r.choice(["</body></html>", ""])


def pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]
