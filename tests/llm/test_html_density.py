from __future__ import annotations

from attestra.llm import html

TEXT = "It is the case that all of this was in the text of the page and it has been for a long time now."
MORE = "And it was the end of the story that they had told to us in the house by the sea."


def test_text_outside_article_cards():
    cards = "".join(f"<article><h3><a href=/{i}>Some other title {i}</a></h3><p>Read it</p></article>" for i in range(3))
    assert html.extract(f"<div><p>{TEXT}</p><p>Short.</p><p>{MORE}</p></div>{cards}") == f"{TEXT}\nShort.\n{MORE}"


def test_links_inside_article_and_content():
    links = "<ul><li><a href=/1>One other title of ours</a><li><a href=/2>Two other titles of ours</a></ul>"
    for tag in ("article", "div class=content", "div role=main"):
        page = f"<nav>Menu</nav><{tag}><h1>Head</h1><p>{TEXT}</p>{links}</{tag.split()[0]}><footer>Foot</footer>"
        assert html.extract(page) == f"Head\n{TEXT}", tag


def test_prior_keeps_short_and_unknown_language():
    unknown = "lorem ipsum dolor amet " * 10
    assert html.extract(f"<nav>Menu</nav><article><p>{unknown}</p><p>Short.</p></article><footer>Foot</footer>") == f"{unknown.strip()}\nShort."
