"""Extraction from pages without an article: all winning containers, not only the first; classes that mislead; deep pages."""

import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from wardstone.llm.html_extract import SHARE, Page, extract_pages, host_paths, longer, path_key

WORD = "plain words of a text "
FRAME = '<html><body><nav><a href="/">home</a></nav>{}<div class="footer">all rights</div></body></html>'


def block(size, mark):
    return (mark + " " + WORD * size)[: size].strip()


def split_page(i):
    return FRAME.format(f'<div class="content"><div class="lead"><p>{block(200, f"lead{i}")}</p></div><div class="body"><p>{block(2000, f"body{i}")}</p></div></div>')


def apart_page(i):
    return FRAME.format(f'<div class="lead"><p>{block(200, f"lead{i}")}</p></div><div class="text"><p>{block(2000, f"text{i}")}</p><ul><li>item{i}</ul></div><div class="tags"><a href="/t">t{i}</a></div>')


def other_page(i):
    return FRAME.format(f'<div class="content"><div class="body"><p>tiny{i}</p></div></div><div class="story"><p>{block(900, f"story{i}")}</p><p>{block(900, f"more{i}")}</p></div>')


def extract(spark, pages):
    rows = [(i, "http://h.example/" + str(i), p) for i, p in enumerate(pages)]
    got = {}
    for hosts in (20_000, 0):
        got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hosts=hosts).collect()}
    return got


def test_both_siblings_win(spark):
    got = extract(spark, [split_page(i) for i in range(20)])
    assert got == {i: block(200, f"lead{i}") + "\n\n" + block(2000, f"body{i}") for i in range(20)}
    got = extract(spark, [apart_page(i) for i in range(20)])  # right in the body, which is no container of theirs
    assert got == {i: f"{block(200, f'lead{i}')}\n\n{block(2000, f'text{i}')}\n\nitem{i}" for i in range(20)}


def test_second_template_of_a_host(spark):
    got = extract(spark, [*(split_page(i) for i in range(20)), other_page(20), "bare text " * 9])
    assert got[20] == f"tiny20\n\n{block(900, 'story20')}\n\n{block(900, 'more20')}"
    assert got[3] == block(200, "lead3") + "\n\n" + block(2000, "body3") and got[21] == ("bare text " * 9).strip()


def test_a_page_whose_winners_hold_little():
    assert Page(other_page(1)).text([path_key("html>body>div.content>div.body")]) == f"tiny1\n\n{block(900, 'story1')}\n\n{block(900, 'more1')}"
    many = FRAME.format('<div class="all">' + "".join(f'<div class="x{chr(97 + i)}"><p>{block(300, "part" + chr(97 + i))}</p></div>' for i in range(26)) + "</div>")
    assert Page(many).text([]) == "\n\n".join(block(300, "part" + chr(97 + i)) for i in range(26))


BODY = f"<p>{block(300, 'one')}</p><p>{block(400, 'two')}</p>"
TEXT = f"{block(300, 'one')}\n\n{block(400, 'two')}"


@pytest.mark.parametrize("name", ["comments-wrapper", "ad-container", "sidebar-wrapper", "post-comments", "share-buttons", "related-posts promo", "newsletter-box", "header-wrapper"])
def test_marked_parts_of_an_article_go(name):
    for outer in ("article", "div class=story"):
        page = f'<html><body><{outer}>{BODY}<div class="{name}"><p>Reader comment here, BUY NOW</p></div></{outer.split()[0]}></body></html>'
        assert Page(page).text([]) == TEXT


@pytest.mark.parametrize("page", [
    f'<article><section class="topic-social">{BODY}</section></article>', f'<div class="content skip-lazy">{BODY}</div>', f'<div class="page has-sidebar with-comments">{BODY}</div>',
    f'<div id="notice">{BODY}</div>', f'<body class="comments-open"><div class="entry">{BODY}</div>', f'<div class="tag-ads category-banner">{BODY}</div>',
    f'<div class="post">{BODY}</div><article class="comment"><p>Reader comment here</p></article><div class="comment-list"><p>{block(2000, "me too")}</p></div>',
])
def test_names_of_main_parts_mislead(page):
    assert Page(page).text([]) == TEXT


def test_a_title_and_a_short_lead_above_the_body():
    page = FRAME.format(f'<div class="top"><h1>The title</h1></div><div class="lead"><p>short lead</p></div><ul class="links"><li><a href="/a">elsewhere</a></ul><div class="body">{BODY}{BODY}</div>')
    assert Page(page).text([]) == f"The title\n\nshort lead\n\n{TEXT}\n\n{TEXT}"
    assert Page(f"<article><p>so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is {block(200, 'x')}</p></article>").text([]).startswith("so a+b is x")


def test_votes_equal_brute_force(spark):
    """Winning paths by counting each path's share over the pages of a host one by one."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        parts = "".join(f'<div class="{rng.choice("abcdef")}{rng.randint(0, 9)}"><p>{block(rng.choice([60, 300, 1500]), f"t{i}")}</p></div>' for _ in range(rng.randint(1, 5)))
        rows.append((i, f"http://h{i % 3}.example/{i}", FRAME.format(parts)))
    want: dict = defaultdict(lambda: defaultdict(list))
    for i, _, source in rows:
        for p, share in Page(source).votes().items():
            want[f"h{i % 3}.example"][p].append(round(share * 1_000_000))
    got = {r["host"]: list(r["paths"]) for r in host_paths(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for host, paths in want.items():
        fair = {p: sum(v) for p, v in paths.items() if sum(v) >= len(v) * int(SHARE * 1_000_000)}
        assert got[host] == sorted(fair, key=lambda p: (-fair[p], p))
    assert path_key("html>body>div.a") == longer(longer(longer(0, "html"), "body"), "div.a")


def test_deep_pages_take_linear_memory():
    """50,000 nested containers, in a process of its own so that its memory is its own."""
    run = """
import resource
from wardstone.llm.html_extract import Page
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
page = Page("<div class=c>" * 50_000 + "deep text" + "</i></li><li>x" * 1000)
assert page.text(list(page.votes())).startswith("deep text")
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2])
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 300
