"""Main text: broken markup in linear time, names in any spelling, and a measure on made pages."""

import random
import time

import pytest

from tallywatch.llm import main_text

LONG = [
    "<a ", '<a "', "<!--", "</", "<p", "<a '\">", '<a href="x', "<div>", "</i>", "<p><b>", "<i><div></i>",
    "<!", "<![CDATA[", "< ", "&amp", "<a b=", "<td>", "<li>", "<script>",
]


@pytest.mark.parametrize("piece", LONG)
def test_a_megabyte_of_broken_markup_takes_linear_time(piece):
    """Ten times the page takes no more than some ten times as long; a quadratic one a hundred."""
    main_text.extract("<p>warm</p>")
    times = []
    for size in (100_000, 1_000_000):
        page = "<p>first words<i>" + piece * (size // len(piece))
        begin = time.process_time()
        main_text.extract(page)
        times.append(time.process_time() - begin)
    assert times[1] < 30 * times[0] + 0.5 and times[1] < 15


@pytest.mark.parametrize("page,text", [
    ("<p>one <a href='x>y'>two</a> three", "one two three"),
    ('<p title="a > b">in</p>', "in"),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<p>cut <a href=\"x", 'cut <a href="x'),
    ("<p>open <b", "open <b"),
    ("<p>one<!-- two", "one"),
    ("<p>one<?two", "one"),
    ("<p>one</ two>three", "onethree"),
    ("<p>one</>two", "onetwo"),
    ("<p class='x>bad quote</p><p>next one</p>", "bad quote\nnext one"),
])
def test_odd_markup(page, text):
    assert main_text.extract(page) == text


@pytest.mark.parametrize("name", [
    "cookie-banner", "cookieBanner", "CookieBanner", "site_cookie", "adSlot", "siteNavigation", "newsletterSignup",
])
def test_notices_go_however_they_are_spelled(name):
    body = "".join(f"<p>The article says much, and says it well, number {i}.</p>" for i in range(5))
    for kind in ("class", "id"):
        page = f"<article>{body}<div {kind}='{name}'>We value your choice, so click here.</div></article>"
        assert "choice" not in main_text.extract(page) and "number 4" in main_text.extract(page)


@pytest.mark.parametrize("name", ["shadow", "gradient", "adapt", "readable", "broadcast", "uploads", "headline"])
def test_words_within_other_words_are_no_names(name):
    body = "".join(f"<p>The article says much, and says it well, number {i}.</p>" for i in range(5))
    page = f"<article>{body}<div class='{name}'>This sentence is part of it, as any other.</div></article>"
    assert "part of it" in main_text.extract(page)


def made_page(rng):
    """A page and the text its maker calls the article."""
    word = lambda: rng.choice("river stone light market winter paper garden music letter harbour".split())

    def sentence(n):
        return " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ", then."])

    def links(n):
        return "".join(f"<li><a href='/{word()}'>{word().title()}</a></li>" for _ in range(n))

    blocks = [sentence(rng.randrange(12, 40)) for _ in range(rng.randrange(4, 12))]
    article = "".join(f"<p>{b}</p>" for b in blocks)
    if rng.random() < 0.4:
        head = sentence(3)
        blocks.insert(0, head)
        article = f"<h2>{head}</h2>" + article
    holder = rng.choice(["article", "main", "div class='post'", "div id='mainContent'", "section"])
    inside = rng.choice(["", f"<div class='{rng.choice(['shareButtons', 'social-share', 'adSlot'])}'>{sentence(4)}</div>"])
    notice = rng.choice(["", f"<div class='{rng.choice(['cookieBanner', 'cookie-notice'])}'><p>{sentence(9)}</p></div>"])
    side = rng.choice(["", f"<aside><h3>{sentence(2)}</h3><ul>{links(6)}</ul></aside>", f"<div id='sidebar'>{sentence(20)}</div>"])
    comments = rng.choice(["", "<div class='comments'>" + "".join(f"<p>{sentence(15)}</p>" for _ in range(4)) + "</div>"])
    page = (
        f"<html><head><title>{word()}</title><style>p {{}}</style></head><body><header><nav><ul>{links(7)}</ul></nav></header>"
        f"{notice}<div class='wrap'><{holder}>{article}{inside}</{holder.split()[0]}>{side}{comments}</div>"
        f"<form><input name='q'><button>{word()}</button></form><footer><p>{sentence(12)}</p></footer></body></html>"
    )
    return page, "\n".join(blocks)


def test_made_pages_give_their_articles():
    rng = random.Random(8)
    pages = [made_page(rng) for _ in range(300)]
    right = sum(main_text.extract(page) == text for page, text in pages)
    assert right >= 0.97 * len(pages)
