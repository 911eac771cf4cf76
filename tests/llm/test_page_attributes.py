"""Pages whose attributes and class names only look like those of menus and adverts keep their articles."""

import pytest

from corpusloom.llm import html_text

A = "The first paragraph of the story has quite a number of plain words in it, so that it is clear."
B = "The second paragraph goes on with the story and has just as many plain words as the first one."
P = f"<p>{A}</p><p>{B}</p>"
PAGES = [
    f"<div style='overflow:hidden'>{P}</div>", f"<article style='overflow:hidden'>{P}</article>", f"<div data-x='hidden'>{P}</div>", f"<div data-id='content' data-role='navigation'>{P}</div>",
    f"<div class='elementor-widget'>{P}</div>", f"<article class='post hentry category-advertising tag-social'>{P}</article>", f"<form id='aspnetForm'><article>{P}</article></form>",
    f"<div class='ad-free'>{P}</div>", f"<div class='in-reply'>{P}</div>", f"<main class='search'>{P}</main>", f"<article class='widget'>{P}</article>", f"<div title=\"class='menu' hidden\">{P}</div>",
]


@pytest.mark.parametrize("page", PAGES)
def test_articles_stay(spark, page):
    tree = html_text.fit_tree(spark)
    assert html_text.main_text(f"<html><body>{page}</body></html>", tree) == f"{A} {B}"


def test_named_parts_still_go(spark):
    tree = html_text.fit_tree(spark)
    other = "<div hidden><p>gone one two three</p></div><div aria-hidden=true><p>gone too</p></div><form><label>Name</label><p>Send your mail</p></form><div role=navigation><p>menu</p></div><div class='ad-banner'>buy</div>"
    assert html_text.main_text(f"<html><body><article>{P}</article>{other}</body></html>", tree) == f"{A} {B}"
