from quillspark.llm import htmltext

ARTICLE = "".join(f"<p>Paragraph {i} of the story goes on with   many\nplain words &amp; one <b>bold</b> word, so it is long.</p>" for i in range(5))


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def expected():
    return "\n\n".join(f"Paragraph {i} of the story goes on with many plain words & one bold word, so it is long." for i in range(5))


def test_regions_around_the_article_go():
    around = [
        f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; x</footer>",
        f"<div class='menu'><a href='/'>A</a><a href='/b'>B</a></div><div id='content'>{ARTICLE}</div><aside>more to read here</aside>",
        f"<div class='ad'>Buy this thing now, it is cheap</div><main>{ARTICLE}</main><div class='comments'><p>I did not like this story at all, what a long comment it is.</p></div>",
        f"<script>var a = '<p>no</p>';</script><div class='cookie-notice'>We use cookies</div><div>{ARTICLE}</div><form><label>Name</label><input></form>",
        f"<header>Site</header><div><div>{ARTICLE}</div></div><div class='sidebar'><p>Other stories that you may read some other day</p></div>",
        f"<div class='topnav'><a href='/x'>X</a></div><section class='post'>{ARTICLE}</section><section id='commentlist'><p>A reader wrote a long reply that does not belong here.</p></section>",
        f"<div role='banner'>Name of the site</div><div class='col'>{ARTICLE}<div class='adbox'>An offer inside the text</div></div><p class='copyright'>All rights</p>",
        f"<table><tr><td class='leftnav'>A<br>B</td><td>{ARTICLE}</td></tr></table><dialog>Sign in</dialog>",
    ]
    for body in around:
        assert "\n\n".join(htmltext.main_text(page(body))) == expected()


def test_short_blocks_inside_the_article_stay():
    text = htmltext.main_text(page(f"<nav>x</nav><article><h1>Title</h1>{ARTICLE}<ul><li>one<li>two</ul></article>"))
    assert text[0] == "Title" and text[-2:] == ["one", "two"]


def test_broken_markup_and_empty_pages():
    for html in ("", "<", "<p", "plain text", "<p>a<p>b</div></div>", "&#x110000; &bogus; &#0;", "<!-- never closed", "<script>x", "a" * 100_000, "<div>" * 3000):
        assert isinstance(htmltext.main_text(html), list)


def test_rows_nulls_and_empty(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>")), (2, None, None), (None, "v", ""), (1, "u", page(f"<article>{ARTICLE}</article>"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract(df).collect())
    assert got == [(0, "", 0), (1, expected(), len(expected())), (1, expected(), len(expected())), (2, "", 0)]
    assert htmltext.extract(df.limit(0)).count() == 0
