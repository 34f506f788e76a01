import pytest

from quillspark.llm import htmltext

LONG = [f"Sentence {i} of this story goes on with many plain words, so that the line is a long one." for i in range(8)]
TEXT = "".join(f"<p>{x}</p>" for x in LONG)
REPLY = "<p>A reader wrote a long reply that does not belong to the story, and it goes on for quite a while.</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post comments-open", "bg-navy", "layout with-nav", "page sidebar", "search-results", "main-header", "comments"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_stay(name, tag):
    html = f"<body><nav>Home</nav><div class='{name}'><{tag}>{TEXT}</{tag}></div><div class='comments'>{REPLY}</div></body>"
    assert htmltext.main_text(html) == LONG


@pytest.mark.parametrize("name", ["discussion", "feedback", "related", "notice", "search"])
def test_sections_of_an_article_stay(name):
    html = f"<body><article><div class='entry-header'><h1>Headline</h1></div>{TEXT}<section id='{name}'><h2 id='comments'>Part</h2><p>Short.</p></section></article></body>"
    assert htmltext.main_text(html) == ["Headline", *LONG, "Part", "Short."]


@pytest.mark.parametrize("name", ["ad", "comments", "comment-list", "post-comments", "main-nav", "leftnav", "pagination"])
def test_strong_names_go_inside_an_article_too(name):
    assert htmltext.main_text(f"<body><article>{TEXT}<div class='{name}'>{REPLY}</div></article></body>") == LONG
    assert htmltext.main_text(f"<body><article>{TEXT}</article><div class='{name}'>{REPLY * 30}</div></body>") == LONG


@pytest.mark.parametrize("name", ["sidebar", "related-posts", "site-footer", "cookie-notice", "newsletter-signup", "widget-area", "social"])
def test_regions_beside_the_text_go(name):
    for tag in ("article", "main", "div"):
        assert htmltext.main_text(f"<body><{tag}>{TEXT}</{tag}><div class='{name}'>{REPLY}</div></body>") == LONG
    # Articles of readers or teasers are not the article of the page.
    assert htmltext.main_text(f"<body><article>{TEXT}</article><div class='{name}'>{f'<article>{REPLY}</article>' * 4}</div></body>") == LONG


def test_form_around_the_page():
    search = "<form><p>Look for other words in here</p><input></form>"
    assert htmltext.main_text(f"<body><form id='aspnet'><div>{TEXT}</div><button>Send</button></form></body>") == LONG
    assert htmltext.main_text(f"<body><form><article>{TEXT}</article></form>{search}</body>") == LONG
    assert htmltext.main_text(f"<body><div>{TEXT}{search}</div></body>") == LONG
