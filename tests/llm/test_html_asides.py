"""What is hidden or aside by its attributes, within lines, and by other names; main text beside the winner."""

import pytest

from wardstone.llm.html_extract import Page

TEXT = "Plain words of a text that goes on, and on, for a while."


@pytest.mark.parametrize("tag", [
    'article title="The hidden valley"', 'article class="hidden sm:block"', "article data-x='a hidden gem'", "article data-note=\"display:none\"", "article data-class='comments'",
    'article data-hidden', 'article title="a > b hidden"',
])
def test_attribute_values_hide_nothing(tag):
    assert Page(f"<body><{tag}><p>{TEXT}</p></article></body>").text([]) == TEXT


@pytest.mark.parametrize("tag", ["hidden", "HIDDEN=''", 'style="color:red; Display : NONE"', "style='visibility:hidden'", 'aria-hidden="true"', "aria-hidden=true"])
def test_attributes_hide(tag):
    assert Page(f"<body><article><p>{TEXT}</p><p {tag}>unseen words</p><p>Seen <b {tag}>not seen</b>words.</p></article></body>").text([]) == f"{TEXT}\n\nSeen words."


@pytest.mark.parametrize("aside", ['<span class="share">Share this</span>', "<span hidden>secret</span>", "<button>Subscribe</button>", "<label>Mail</label>", '<a class="social-link" href="/x">Post it</a>'])
def test_asides_within_a_line(aside):
    assert Page(f"<body><article><p>{TEXT} {aside}</p>{aside}<p>Last words.</p></article></body>").text([]) == f"{TEXT}\n\nLast words."


@pytest.mark.parametrize("tag", ["section class='user-reviews'", "div id=discussion", "ul class=feedback-list", "div class='cta'", "ol class='commentlist'", "div class='reader-feedback'"])
def test_comments_and_calls_by_other_names(tag):
    name = tag.split()[0]
    assert Page(f"<body><article><p>{TEXT}</p></article><{tag}><p>So true, thank you.</p></{name}></body>").text([]) == TEXT
    assert Page(f"<body><article><p>{TEXT}</p><{tag}><p class=reply>So true, thank you.</p></{name}></article></body>").text([]) == TEXT


def test_a_short_part_beside_a_long_one():
    long = " ".join([TEXT] * 60)
    page = f'<body><nav><a href="/">home page link</a></nav><div class="a"><p>{long}</p></div><div class="b"><p>A short last part.</p></div><div class="tags"><a href="/t">one two three</a></div><div class=footer>all rights reserved</div></body>'
    assert Page(page).text([]) == f"{long}\n\nA short last part."
    article = f"<body><article><p>{long}</p></article><div><p>Words outside of it.</p></div></body>"
    assert Page(article).text([]) == long
