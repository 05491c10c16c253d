"""Labelled pages for fitting the extraction model, built by rule: article text is marked, the rest is not."""

from __future__ import annotations

import random

from rankframe.llm.htmlmain import Page, TreeModel, fit, parse

MARK = "‡"
_SYLLABLES = "an be ci do en fa ge ha in ka le mo na or pe ra se ti un ve wo za tion ing er ly".split()
# How sites wrap an article, and what stands around and inside it.
ARTICLE = ["<article>", "<main>", "<main><article>", '<article class="post">', '<div class="post-content">', '<div id="content"><div class="entry">',
           '<section class="story">', '<div class="article-body">', '<div class="container"><div class="text">', '<div id="main">', "<div>", "<section>",
           '<div class="page"><article>', "<table><tr><td>", '<div id="main-content">', '<div role="main">']
MENUS = ["<nav><ul>", "<ul>", '<div class="menu"><ul>', '<header><nav><ul>', '<div id="navbar"><ul>', '<ul class="breadcrumb">', '<div class="related"><ul>',
         '<aside><ul>', '<div class="social-share"><ul>', '<div class="pagination"><ul>', "<menu>", '<div role="navigation"><ul>']
SENTENCES = ['<div class="ad">', '<div class="advert">', '<div id="cookie-banner">', '<div class="notice">', "<footer>", "<aside>", '<div class="sidebar">',
             "<header>", '<div class="newsletter">', '<div class="sponsored">', '<div role="banner">', '<div class="popup">', '<aside class="widget">',
             '<div id="footer">', '<div class="site-header">', '<section class="related">', '<div class="promo">', '<div class="alert">', '<div class="copyright">']
COMMENTS = ['<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="discussion">', '<section id="respond">']
COMMENT = ['<div class="comment">', "<p>", '<article class="comment">', '<li class="reply">', "<div>", "<li>"]


def _close(opened: str) -> str:
    return "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(opened[1:].split("<")))


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def prose(self, sentences: int, mark: str = "") -> str:
        """Sentences; one text in three has clutter, capitals or no stops, so that stops alone decide nothing."""
        kind = self.r.random()
        end = "." if kind > 0.33 else self.r.choice((".###", "***", "$$$", "!!", " |", ""))
        said = [self.words(self.r.randint(2, 22)).capitalize() + self.r.choice(("", ", " + self.words(3))) + mark + end for _ in range(sentences)]
        return " ".join(said).upper() if kind < 0.05 else " ".join(said)

    def menu(self) -> str:
        o = self.r.choice(MENUS)
        return o + "".join(f'<li><a href="/{i}">{self.words(self.r.randint(1, 3))}</a></li>' for i in range(self.r.randint(3, 9))) + _close(o)

    def aside(self) -> str:
        o, text = self.r.choice(SENTENCES), self.prose(self.r.randint(1, 4))
        shape = self.r.random()
        text = f"<p>{text}</p>" if shape < 0.3 else f"<h2>{self.words(2)}</h2><p>{text}</p><p>{self.prose(2)}</p>" if shape < 0.45 else text
        return o + text + self.r.choice(("", f' <a href="/">{self.words(2)}</a>')) + _close(o)

    def form(self) -> str:
        return f'<form action="/"><p>{self.prose(1)}</p><label>{self.words(2)}</label><input name="q"><button>{self.words(1)}</button></form>'

    def comments(self) -> str:
        o = self.r.choice(COMMENTS)
        body = "".join((c := self.r.choice(COMMENT)) + self.r.choice((f"{self.prose(self.r.randint(1, 6))}", f"<p>{self.prose(self.r.randint(1, 5))}</p>")) + _close(c)
                       for _ in range(self.r.randint(1, 6)))
        return o + self.r.choice(("", f"<h3>{self.words(2)}</h3>")) + body + _close(o)

    def block(self) -> str:
        kind, m = self.r.random(), MARK
        if kind < 0.7:
            return f"<p>{self.prose(self.r.randint(1, 9), m)}</p>"
        if kind < 0.76:
            return f"<p><b>{self.prose(self.r.randint(1, 6), m)}<br>"
        if kind < 0.83:
            return f"<h2>{self.words(self.r.randint(2, 7))}{m}</h2><p>{self.prose(3, m)}</p>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.prose(1, m)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{self.r.choice(('<p>', ''))}{self.prose(2, m)}</blockquote>"
        if kind < 0.94:
            return f"<pre>{self.words(9)}{m}</pre>"
        if kind < 0.96:
            return f"<table><tr><td>{self.words(3)}{m}</td><td>{self.prose(1, m)}</td></tr></table>"
        return f"<div>{self.prose(4, m)}</div>"

    def page(self) -> str:
        extra = [self.menu, self.aside, self.aside, self.form]
        around = lambda n: "".join(self.r.choice(extra)() for _ in range(self.r.randint(0, n)))
        o = self.r.choice(ARTICLE)
        title = f"<h1>{self.words(self.r.randint(1, 9))}{MARK}</h1>" if self.r.random() < 0.8 else ""
        blocks = [self.block() for _ in range(self.r.randint(1, 10))]
        if self.r.random() < 0.35:
            blocks.insert(self.r.randint(1, len(blocks)), self.r.choice(extra)())
        tail = self.comments() if self.r.random() < 0.4 else ""
        inside = self.r.random() < 0.3
        body = o + title + "".join(blocks) + (tail if inside else "") + _close(o) + ("" if inside else tail)
        return f"<html><head><title>{self.words(4)}</title></head><body>{around(4)}{body}{around(4)}</body></html>"


def labels_of(page: Page) -> list[int]:
    """1 for nodes whose own text is marked, and for others inside the page most of whose text is."""
    n = len(page.tag)
    own, total, marked = [0] * n, [0] * n, [0] * n
    for node, t in page.runs:
        total[node] += len(t)
        marked[node] += len(t) * (MARK in t)
        own[node] = 1 if MARK in t else own[node] or -1
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        marked[page.parent[i]] += marked[i]
    outer = ("#page", "html", "body")
    return [int(o > 0 if o else t not in outer and 2 * m > s) for o, t, m, s in zip(own, page.tag, marked, total)]


def labelled_pages(n: int, seed: int) -> tuple[list[Page], list[list[int]], list[str]]:
    w = _Writer(seed)
    sources = [w.page() for _ in range(n)]
    pages = [parse(s) for s in sources]
    return pages, [labels_of(p) for p in pages], sources


def trained(n: int = 500, seed: int = 11) -> TreeModel:
    pages, labels, _ = labelled_pages(n, seed)
    return fit(pages, labels)
