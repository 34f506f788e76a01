import pytest

from quillspark.llm import htmltext

LONG = [f"Sentence {i} of this part goes on with many plain words, so that the line is a long one." for i in range(12)]
MENU = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='menu'><a href='/b'>B</a></div>"
BODIES = {
    "sections": (
        "<h1>Headline</h1><section>" + "".join(f"<p>{x}</p>" for x in LONG[:7]) + "</section><section><h2>Next</h2>" + "".join(f"<p>{x}</p>" for x in LONG[7:10]) + "</section>",
        ["Headline", *LONG[:7], "Next", *LONG[7:10]],
    ),
    "short second section": (
        "<h1>Headline</h1><section>" + "".join(f"<p>{x}</p>" for x in LONG) + "</section><section><p>Short end.</p></section>",
        ["Headline", *LONG, "Short end."],
    ),
    "list": (f"<h1>Soup</h1><p>{LONG[0]}</p><ul>" + "".join(f"<li>{x}</li>" for x in LONG[1:9]) + f"</ul><p>{LONG[9]}</p><p>Enjoy.</p>", ["Soup", *LONG[:10], "Enjoy."]),
    "table": ("<h1>Table</h1><p>In short.</p><table>" + "".join(f"<tr><td>{i}</td><td>{x}</td></tr>" for i, x in enumerate(LONG)) + f"</table><p>{LONG[0]}</p>", None),
    "pre": (f"<h1>Code</h1><p>{LONG[0]}</p><pre>" + "\n".join(LONG[1:9]) + f"</pre><p>{LONG[9]}</p>", ["Code", LONG[0], " ".join(LONG[1:9]), LONG[9]]),
}


@pytest.mark.parametrize("name", sorted(BODIES))
def test_whole_container_without_article(name):
    body, expected = BODIES[name]
    if expected is None:
        expected = ["Table", "In short.", *[y for i, x in enumerate(LONG) for y in (str(i), x)], LONG[0]]
    assert htmltext.main_text(f"<html><body>{MENU}<div id='content'>{body}</div><footer>x</footer></body></html>") == expected


def test_headline_before_the_container():
    inner = "".join(f"<p>{x}</p>" for x in LONG)
    assert htmltext.main_text(f"<body>{MENU}<div><h1>Headline</h1></div><div class='text'>{inner}</div></body>") == ["Headline", *LONG]
