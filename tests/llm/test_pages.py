"""Page differencing: the reader, the alignment against the plain recursion, and pairs against brute force."""

from __future__ import annotations

import random
import re
from functools import cache

import pytest

from revlens.llm import pages
from revlens.sources.stages import StageStore

SCHEMA = "page_id bigint, url string, html string, text string, lines int, _host int, _gone int, place int"


def longest(left, right):
    @cache
    def at(i, j):
        if i == len(left) or j == len(right):
            return 0
        if left[i] == right[j]:
            return 1 + at(i + 1, j + 1)
        return max(at(i + 1, j), at(i, j + 1))

    return at(0, 0)


def test_the_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        left, right = ([rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(30))] for _ in range(2))
        found = pages.common_lines(left, right)
        assert all(left[i] == right[j] for i, j in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        assert len(found) == longest(tuple(left), tuple(right))
    wide = list(range(20_000))
    assert len(pages.common_lines(wide, wide[::-1])) == 1
    assert len(pages.common_lines([1, 2] * 9_000, [2, 1] * 9_000)) == 17_999


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b> c\n\t d<p>e&nbsp;f&#x41;&eacute;<br>g", ["ab c d", "e fAé g"]),
        ("<p>1 < 2 and 3 > 2</p><p title='a>b'>x</p>", ["1 < 2 and 3 > 2", "x"]),
        ("<title>T</title><style>p{}</style><script>var t='</p>';</script><p>x</p>", ["x"]),
        ("<nav><ul><li>menu</ul></nav><!-- <p>no</p> --><p>x</p><footer>f</footer>", ["x"]),
        ("<nav><ul><li>menu<article><p>x</p></article>", ["x"]),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</p></article>", ["Title", "x"]),
        ("<div class='ad-box'>buy</div><div id=cookie-notice>we</div><p>x</p>", ["x"]),
        ("<main class='has-sidebar'><p>x</p><aside>s</aside></main>", ["x"]),
        ("<article><p>story</p></article><section class='comments'><article><p>me too</p></article></section>", ["story"]),
        ("<p>text of the page</p><form><p>Name</p><button>Go</button></form>", ["text of the page"]),
        ("<form id=f><div><p>a whole page in a form</p></div></form>", ["a whole page in a form"]),
        ("<article><p>the story itself</p></article><div>see also</div>", ["the story itself"]),
        ("<div style='display: none'>x</div><div hidden>y</div><p>z</p>", ["z"]),
        ("<script>never closed <p>x</p>", []),
        ("<p>cut &am", ["cut &am"]),
        ("<p>cut</p><a href='", ["cut"]),
    ],
)
def test_lines_of_a_page(page, lines):
    assert pages.text_lines(page) == lines


def site():
    """Pages of three hosts: one template each, copies, versions of an article, one without a neighbour."""
    rng = random.Random(8)
    found = []
    for host in ("a.example", "B.example:80", "c.example"):
        template = [f"{host} top {rng.random()}", f"{host} share", f"{host} bottom"]
        for number in range(12):
            story = [f"story {host} {number} line {at} " + "word " * 20 for at in range(6)]
            if number in (3, 4):
                story = [f"story {host} 3 line {at} " + "word " * 20 for at in range(6)]
            body = "".join(f"<div>{line}</div>" for line in [*template[:2], *story, template[2]])
            found.append((len(found), f"https://{host}/news/{number // 6}/{number}?q=1#x", f"<html><body>{body}"))
    found += [(100, "https://alone.example/", "<p>alone</p>"), (101, None, "<p>no url</p>"), (102, "no host", "<p>y</p>")]
    found += [(103, "https://a.example/z", None), (None, "https://a.example/zz", ""), found[0], found[0]]
    found.append((104, "https://long.example/1", "<p>" + "long words " * 200_000 + "</p>"))
    return found


def expected(rows):
    """The rule of the docstring over all pages in one list."""

    def split(url):
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
        return (found[1].lower(), found[2]) if found else ("", "")

    lines = [pages.text_lines(page) for _, _, page in rows]
    first = {}
    for (_, url, _), held in zip(rows, lines, strict=True):
        host, path = split(url)
        if host and held:
            key = (host, tuple(held))
            first[key] = min(path, first.get(key, path))
    order = sorted((host, path, pages._content(list(held)), held) for (host, held), path in first.items())
    gone = {}
    for at, (host, path, _, held) in enumerate(order):
        sides = []
        for other in (at - 1, at + 1):
            if 0 <= other < len(order) and order[other][0] == host:
                low, high = min(at, other), max(at, other)
                sums = [[pages._sum_of(line) for line in order[side][3]] for side in (low, high)]
                mine = {pair[at != low] for pair in pages.common_lines(*sums)}
                if 2 * sum(len(held[place]) for place in mine) <= sum(map(len, held)):
                    sides.append((pages._together(path, order[other][1]), mine))
        nearest = [mine for near, mine in sides if near == max(near for near, _ in sides)]
        gone[host, held] = set.intersection(*nearest) if nearest else set()
    texts = []
    for (page_id, url, _), held in zip(rows, lines, strict=True):
        out = gone.get((split(url)[0], tuple(held)), set())
        texts.append((page_id, url, "\n\n".join(line for at, line in enumerate(held) if at not in out)))
    return texts


@pytest.mark.parametrize("bound", [pages.BROADCAST_BYTES, -1])
def test_shared_lines_go_from_every_page(spark, monkeypatch, bound):
    monkeypatch.setattr(pages, "BROADCAST_BYTES", bound)
    rows = site()
    frame = spark.createDataFrame([(*row, "x", 1, 2, 3, 4) for row in rows], SCHEMA).repartition(3)
    found = [tuple(row) for row in pages.main_texts(frame, StageStore(spark)).collect()]
    assert sorted(found, key=repr) == sorted(expected(rows), key=repr)
    texts = {page_id: text for page_id, _, text in found}
    assert "share" not in texts[1] and texts[1].count("story") == 6
    # two addresses of one page are no pair, and lose what their neighbours share with them
    assert texts[3] == texts[4] and texts[3].count("story") == 6 and "share" not in texts[3]
    assert texts[100] == "alone" and texts[101] == "no url" and texts[103] == "" and texts[None] == ""


def test_an_empty_table_gives_an_empty_result(spark):
    assert pages.main_texts(spark.createDataFrame([], SCHEMA), StageStore(spark)).collect() == []
