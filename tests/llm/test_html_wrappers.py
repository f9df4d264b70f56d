from __future__ import annotations

import random

import pytest

from attestra.llm import html

TEXT = "It is the case that all of this was in the text of the page and it has been for a long time now."
MORE = "And it was the end of the story that they had told to us in the house by the sea."
WRAPPERS = (
    'div class="content no-sidebar"', 'div class="post has-header"', 'div id="form-1"', 'div class="article-content with-sidebar"', 'section class="entry share"', 'div class="page-with-comments"',
    'article class="post has-related"', 'main class="ads-enabled"', 'article class="no-comments"', 'div class="layout-sidebar-right"', 'form action="/x"',
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_name_does_not_delete_the_article(wrapper):
    side = '<div class="sidebar"><p>It is what they have on the side of it and no more.</p></div>'
    page = f"<body><nav>Menu of the site</nav><{wrapper}><p>{TEXT}</p>{side}<p>{MORE}</p></{wrapper.split()[0]}><footer><p>{TEXT}</p></footer></body>"
    assert html.extract(page) == f"{TEXT}\n{MORE}"


@pytest.mark.parametrize("bad", ['div class="sidebar"', 'div id="comments"', 'section class="post-footer"', "form", 'article class="comment"', 'div class="newsletter-box"', 'div class="notice"', "aside", 'div role="banner"'])
def test_a_name_speaks_where_the_article_is_elsewhere(bad):
    other = "It was one of the things that they say to us in the notes and in the rest of it."
    page = f"<body><div><p>{TEXT}</p><p>{MORE}</p></div><{bad}><p>{other}</p></{bad.split()[0]}></body>"
    assert html.extract(page) == f"{TEXT}\n{MORE}"


def test_other_languages():
    japanese = "これは日本語の長い文章であり、記事の本文として十分な長さを持っています。" * 8
    italian = "Questo testo racconta cose viste tempo fa dentro case antiche lungo strade bianche sotto alberi vecchi mentre sera cala piano sopra campi vuoti dove nessuno passa mai senza fretta oppure senza ragione alcuna"
    for text in (japanese, italian):
        assert html.extract(f"<nav><a href=/>Menu</a></nav><div><p>{text}</p></div><footer>Foot</footer>") == text
    links = "".join(f"<li><a href=/{i}>{italian}</a>" for i in range(3))
    assert html.extract(f"<ul>{links}</ul>") == ""


def plain(page_blocks):
    """The two passes told plainly, on (kind, words, stop share, linked) of each block: good, bad or open, then the nearest decided ones."""
    first = []
    for words, stop, linked, heading in page_blocks:
        if linked > 0.5:
            first.append("bad")
        elif words < 8 or heading:
            first.append("open")
        elif stop >= 0.28 or (words >= 30 and stop >= 0.15):
            first.append("good")
        elif stop < 0.15 and words < 30:
            first.append("open")
        else:
            first.append("good" if stop >= 0.15 else "bad")
    if "good" not in first:
        first = ["good" if words >= 30 and linked <= 0.5 and not heading else x for x, (words, _, linked, heading) in zip(first, page_blocks, strict=True)]
    keep = []
    for i, x in enumerate(first):
        if x == "open":
            before = next(((i - j, first[j]) for j in range(i - 1, -1, -1) if first[j] != "open"), None)
            after = next(((j - i, first[j]) for j in range(i + 1, len(first)) if first[j] != "open"), None)
            if before is None and after is None:
                x = "good"
            elif before and after and before[1] == after[1]:
                x = before[1]
            elif before is None or after and after[0] < before[0]:
                x = after[1]
            elif after is None or before[0] < after[0]:
                x = before[1]
            else:
                x = "good" if after[1] == "good" and page_blocks[i][3] else "bad"
        keep.append(x == "good")
    return keep


def test_two_passes_against_a_plain_model():
    """Pages made of paragraphs of known length, stop words and links, so that the model needs no parser; ties between neighbours included."""
    r = random.Random(11)
    for _ in range(300):
        page, said, facts = [], [], []
        for i in range(r.randint(1, 14)):
            n, share, linked, heading = r.choice([2, 5, 9, 20, 29, 30, 60]), r.choice([0, 0.1, 0.2, 0.5]), r.random() < 0.2, r.random() < 0.15
            stop = int(n * share)
            words = ["the"] * stop + [f"xy{i}q{j}" for j in range(n - stop)]
            r.shuffle(words)
            text = " ".join(words)
            tag = "h2" if heading else "p"
            page.append(f"<{tag}>" + (f"<a href=/>{text}</a>" if linked else text) + f"</{tag}>")
            said.append(text)
            facts.append((n, stop / n, float(linked), heading))
        assert html.extract("<div>" + "".join(page) + "</div>") == "\n".join(t for t, k in zip(said, plain(facts), strict=True) if k), facts


def test_a_very_long_page():
    page = "<div>" + f"<p>{TEXT}</p>" * 20_000 + "</div>"
    assert html.extract(page).count("\n") == 19_999
