"""One pass over a page's parse events, filling flat records: table rows with their cells, labelled
blocks and links.  No tree is built, so a page of any nesting depth costs one walk; what makes a row
valid and what its cells mean is decided later, by Spark expressions over the records.

Per-page helper only: it runs inside a task on one page at a time.  An end tag closes the innermost
open element of its name and everything in it; void elements hold nothing; script and style bodies
are raw text.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}


class PageRecords(HTMLParser):
    """``rows``, ``blocks`` and ``links`` of one page.

    ``mark`` and ``key`` are classes of spans, ``block`` the class attribute of labelled blocks.
    Text is the stripped text pieces of an element, joined without a separator.
    """

    def __init__(self, mark: str, key: str, block: str):
        super().__init__(convert_charrefs=True)
        self.mark, self.key, self.block = mark, key, block
        self.rows, self.blocks, self.links = [], [], []
        self._stack, self._open = [], {}
        self._now = {"row": [], "cell": [], "block": [], "text": []}

    def handle_starttag(self, tag, attrs):
        given = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        opened = []
        if tag == "tr":
            opened.append(("row", {"entity": given.get("data-entity-id"), "cells": []}))
            self.rows.append(opened[0][1])
        elif tag == "td":
            cell = {"class": given.get("class", ""), "mark": None, "linked": False, "href": None, "link": [], "keys": []}
            for row in self._now["row"]:
                row["cells"].append(cell)
            opened.append(("cell", cell))
        elif tag == "div" and given.get("class") == self.block:
            opened.append(("block", {"label": None, "text": None}))
            self.blocks.append(opened[0][1])
        else:
            opened += [("text", pieces) for pieces in self._pieces(tag, given)]
        if tag == "a" and "href" in given:
            self.links.append(given["href"])
        if tag in VOID:
            return
        for kind, record in opened:
            self._now[kind].append(record)
        self._stack.append((tag, [kind for kind, _ in opened]))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pieces(self, tag, given):
        """The text lists that an element of this kind begins to fill."""
        found = []
        if tag == "a":
            for cell in self._now["cell"]:
                if not cell["linked"]:
                    cell["linked"], cell["href"] = True, given.get("href")
                    found.append(cell["link"])
        elif tag == "span":
            classes = given.get("class", "").split()
            for cell in self._now["cell"]:
                if self.mark in classes and cell["mark"] is None:
                    cell["mark"] = given["class"]
                if self.key in classes:
                    cell["keys"].append([])
                    found.append(cell["keys"][-1])
        elif tag in ("h4", "p"):
            field = "label" if tag == "h4" else "text"
            for block in self._now["block"]:
                if block[field] is None:
                    block[field] = []
                    found.append(block[field])
        return found

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if self._open.get(tag):
            while self._close() != tag:
                pass

    def _close(self):
        tag, kinds = self._stack.pop()
        for kind in kinds:
            self._now[kind].pop()
        self._open[tag] -= 1
        return tag

    def handle_data(self, data):
        piece = data.strip()
        if piece:
            for pieces in self._now["text"]:
                pieces.append(piece)


def page_records(html: str | None, mark: str, key: str, block: str) -> PageRecords:
    found = PageRecords(mark, key, block)
    if html:
        found.feed(html)
        found.close()
    return found
