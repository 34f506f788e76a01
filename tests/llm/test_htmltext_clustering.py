"""Pages whose names, roles and tags tell nothing: the clustering of text-to-tag ratios has to find the article."""

import random
import time
import tracemalloc

import pytest

from quillspark.llm import htmltext

LONG = [f"Sentence {i} of this story goes on with many plain words, so that the line is a long one." for i in range(9)]
TEXT = "<h1>Headline</h1>" + "".join(f"<p>{x}</p>" for x in LONG) + "<ul><li>one</li><li>two</li></ul><p>Short end.</p>"
WANT = ["Headline", *LONG, "one", "two", "Short end."]


def menu(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 12)))
    return "".join(f"<div><a href='/{word()}/{word()}'>{word()} {word()}</a></div>" for _ in range(n))


PAGES = {
    "menu beside": f"<body><div class='x1'>{menu(60)}</div><div class='x2'>{TEXT}</div><div class='x3'>{menu(30, 2)}</div></body>",
    "menu inside": f"<body><div class='k'><div class='a1'>{menu(40)}</div>{TEXT}<div class='a2'>{menu(40, 3)}</div></div></body>",
    "flat body": f"<body>{menu(50)}{TEXT}<div>(c) somebody</div>{menu(20, 4)}</body>",
    "layout table": f"<body><table><tr><td>{menu(50)}</td><td>{TEXT}</td><td>{menu(50, 5)}</td></tr></table></body>",
    "notice and footer": f"<body><div class='q'><p>We store some data here.</p></div><div><div>{menu(45)}</div><div class='r'>{TEXT}</div></div><div>All rights with somebody</div></body>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_article_is_found_without_names(name):
    assert htmltext.main_text(PAGES[name]) == WANT
    assert htmltext.main_text(PAGES[name], hints=False) == WANT


@pytest.mark.parametrize("name", sorted(PAGES))
def test_without_clustering_other_text_stays(name):
    other = htmltext.main_text(PAGES[name], clustering=False)
    assert other != WANT and len(other) > len(WANT)


def test_hints_off_on_the_tables_pages(spark):
    """Most pages give the same article without any hint; without clustering far fewer do."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [htmltext.main_text(x) for x in pages]
    same = sum(htmltext.main_text(x, hints=False) == w for x, w in zip(pages, want))
    neither = sum(htmltext.main_text(x, hints=False, clustering=False) == w for x, w in zip(pages, want))
    assert same > 0.75 * len(pages) and same > neither + 0.15 * len(pages)


def test_links_in_the_text_stay():
    linked = "<p>A line of the story with <a href='/x'>a link</a> in the midst of its plain words and more.</p>"
    html = f"<body><div>{menu(20)}</div><div>{TEXT}{linked}<p><a href='/s'>Source</a></p></div></body>"
    assert htmltext.main_text(html) == [*WANT, "A line of the story with a link in the midst of its plain words and more.", "Source"]


@pytest.mark.parametrize("part", ["<div>text ", "<i><h1>text "])
def test_deep_nesting_takes_little_memory_and_time(part):
    began = time.monotonic()
    tracemalloc.start()
    try:
        htmltext.main_text(part * 100_000)
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()
    assert time.monotonic() - began < 60
