"""HTML main text: heads without an end, sections named like furniture, names as evidence."""

import os

import pytest

from auditlake.llm import htmltext

SF = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.exists(SF):
        pytest.skip("no test data")
    return htmltext.fit(spark.read.parquet(SF))


BODY = "<p>The first words of the text, which go on for a while.</p><p>More words follow in a second block of text here.</p>"
TEXT = "The first words of the text, which go on for a while.\nMore words follow in a second block of text here."


@pytest.mark.parametrize("head", ["<head><title>t</title><body>", "<head><title>t</title><meta charset=utf-8>", "<head><style>p{}</style><div>", "<head></head>", "<head><title>t</title></head><body>"])
def test_the_head_ends_where_the_body_begins(model, head):
    assert htmltext.main_text(f"<html>{head}<article>{BODY}</article>", model) == TEXT


@pytest.mark.parametrize("name", ["form", "share", "search", "related", "notice", "menu", "ad"])
def test_sections_of_an_article_keep_their_text(model, name):
    page = f"<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1>{BODY}<section id='{name}'><h2>The {name} of verse</h2><p>A long paragraph about it with many words that belongs to the text.</p></section></article></body></html>"
    assert htmltext.main_text(page, model) == f"Head\n{TEXT}\nThe {name} of verse\nA long paragraph about it with many words that belongs to the text."


@pytest.mark.parametrize("piece", ["<div class='ad'>Buy this now and save a lot.</div>", "<div class=comments><p>A reader says this is nice.</p></div>", "<aside><p>See also these.</p></aside>", "<form><label>Name</label></form>", "<noscript>Enable scripts please.</noscript>", "<nav><a href=x>Next</a></nav>"])
@pytest.mark.parametrize("inside", [True, False])
def test_furniture_goes(model, piece, inside):
    page = f"<html><body><article>{BODY}{piece if inside else ''}</article>{'' if inside else piece}</body></html>"
    assert htmltext.main_text(page, model) == TEXT
