"""The page scanner against a plain search, its time on broken pages, and text that must stay."""

import random
import time

import pytest

from rankframe.llm import htmlmain


def plain(source):
    """Tags by searching the pattern anew from each end on."""
    out, at = [], 0
    while m := htmlmain._TAG.search(source, at):
        out.append((m.start(), m.end(), m.group(1) or "", m.group(2) or "", m.group(3) or ""))
        at = m.end()
    return out


def scanned(source):
    out, at, scanner = [], 0, htmlmain.Scanner(source)
    while found := scanner.next(at):
        out.append(found)
        at = found[1]
    return out


def test_scanner_finds_the_tags_of_a_plain_search():
    r = random.Random(1)
    parts = ["<", ">", "'", '"', "/", "a", "p ", " b=", "<a href='x'>", "</p>", "<!--", "-->", "<!x", "<br/>", "< 3", "\n", "<?", "text "]
    for _ in range(20_000):
        source = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert scanned(source) == plain(source), source


@pytest.mark.parametrize("piece", ["<a href='x ", '<p class="', "<a<a", "<svg>", "<head>", "</script", "<script>'", "<!--", "<a b='\"> ", "<p <", "&amp;<", "<div>", "<svg></svg ", "<math>"])
def test_a_megabyte_of_it_takes_seconds_at_most(piece):
    for source in (piece * (1_000_000 // len(piece)), "<p>x</p>" + piece * (1_000_000 // len(piece)) + ">"):
        began = time.process_time()
        htmlmain.parse(source)
        assert time.process_time() - began < 8, piece


def said(source):
    return [t for _, t in htmlmain.parse(source).runs]


def test_text_that_stays():
    assert said("<p>a</p>if 3 < 4 then more text, then the end <br") == ["a", "if 3 < 4 then more text, then the end"]
    assert said("<p>1 <2 and x<y z</p>")[0].startswith("1 <2 and")
    assert said("<p>let <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math> be</p>") == ["let x=2n be"]
    assert said("a & b &lt;c&gt; <b>d</b>e") == ["a & b <c> de"]
    assert said("<p>x</p> tail without a tag") == ["x", "tail without a tag"]
    assert said("") == [] and said("<") == ["<"] and said("<!-- never ended <p>x") == []
