"""Formulas and fallback texts are text of the article; what readers write under it is not."""

import pytest
from tessella.llm.html_diff import ARTICLE, decided, page_lines


def kept(page):
    lines, kinds = page_lines(page)
    return [x for x, k in zip(lines, decided(kinds, [len(x) for x in lines])) if k]


def test_formulas_and_fallback_texts_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data='a'>A chart of sales</object><video src='v'>A film of it</video><svg><text>no</text></svg></article>"
    assert kept(page) == ["Let x=2 be.", "A chart of salesA film of it"]
    assert page_lines(page)[1] == [ARTICLE, ARTICLE]


@pytest.mark.parametrize("name", ["reader-responses", "post_comments", "user-comments", "wp-discussion"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_what_readers_write_goes(name, attribute):
    assert kept(f"<article><p>The story.</p><section {attribute}='{name}'><p>Great story!</p></section></article>") == ["The story."]


@pytest.mark.parametrize("name", ["has-comments", "no-replies", "first-response-time", "commentary"])
def test_like_names_stay(name):
    assert kept(f"<article><div class='{name}'><p>The story.</p></div></article>") == ["The story."]
