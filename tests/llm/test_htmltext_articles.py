import numpy as np
import pytest

from edge import empty
from quillspark.llm import htmltext

LONG = [f"Sentence {i} of this part goes on with many plain words, so that the line is a long one." for i in range(10)]
PART = "".join(f"<p>{x}</p>" for x in LONG[:7])
REST = "".join(f"<p>{x}</p>" for x in LONG[7:])
FOOT = "<footer>All rights reserved</footer>"
PAGES = {
    "headline in main": (f"<main><h1>Title</h1><article>{PART}</article></main>", ["Title", *LONG[:7]]),
    "headline in body": (f"<h1>Title</h1><article>{PART}</article>", ["Title", *LONG[:7]]),
    "own headline stays alone": (f"<h1>Site</h1><article><h1>Title</h1>{PART}</article>", ["Title", *LONG[:7]]),
    "linked site name": (f"<h1><a href='/'>The Daily Site</a></h1><article>{PART}</article>", LONG[:7]),
    "section beside": (f"<main><article>{PART}</article><section>{REST}</section></main>", LONG),
    "teaser beside": (f"<main><article>{PART}</article><section><a href='/1'>More here</a> <a href='/2'>And here</a></section></main>", LONG[:7]),
    "article beside": (f"<main><article>{PART}</article><section><article><p>Other story.</p></article></section></main>", LONG[:7]),
    "comment list": (f"<article><h1>Title</h1>{PART}<h2>Comments</h2><ol><li>Nice one!</li><li>I do not agree.</li></ol></article>", ["Title", *LONG[:7]]),
    "comment section": (f"<div><h1>Title</h1>{PART}<section><h3>12 comments</h3><div>Nice.</div><div>No.</div></section></div>", ["Title", *LONG[:7]]),
    "chapter named comments": (f"<article>{PART}<h2>Comments</h2><ul><li>start with a sign</li></ul><h2>Names</h2>{REST}</article>", [*LONG[:7], "Comments", "start with a sign", "Names", *LONG[7:]]),
    "not displayed": (f"<article>{PART}<div style='color:red; display: none'>Hidden words.</div><p style='display:block'>Shown.</p></article>", [*LONG[:7], "Shown."]),
    "hidden until a script runs": (f"<div style='visibility:hidden'>{PART}</div>", LONG[:7]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    html, expected = PAGES[name]
    assert htmltext.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{html}{FOOT}</body></html>") == expected


def plain_threshold(ratios, sigma):
    """Smoothing as a weighted mean per line and two means by full passes, without numpy."""
    radius = max(1, int(3 * sigma))
    smooth = []
    for i in range(len(ratios)):
        weights = {j: 2.718281828459045 ** (-((i - j) ** 2) / (2 * sigma**2)) for j in range(max(0, i - radius), min(len(ratios), i + radius + 1))}
        smooth.append(sum(w * ratios[j] for j, w in weights.items()) / sum(weights.values()))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        if high - low < 1e-9:
            return smooth, low
        middle = (low + high) / 2
        below, above = [x for x in smooth if x <= middle], [x for x in smooth if x > middle]
        low, high = sum(below) / len(below), sum(above) / len(above)
    return smooth, (low + high) / 2


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.5])
def test_smoothing_and_threshold_equal_plain_ones(sigma):
    rng = np.random.Generator(np.random.PCG64(8))
    for n in (1, 2, 5, 40):
        ratios = np.where(rng.random(n) < 0.4, 4.0, 0.5) + rng.random(n)
        smooth, least = plain_threshold(ratios.tolist(), sigma)
        assert np.allclose(htmltext.smoothed(ratios, sigma), smooth) and htmltext.threshold(htmltext.smoothed(ratios, sigma)) == pytest.approx(least)


def test_repeated_rows_and_clashing_columns(spark):
    html = f"<article><h1>Title</h1>{PART}</article>"
    df = spark.createDataFrame([(1, "u", html, "a"), (1, "u", html, "a"), (None, None, None, None)], "page_id long, url string, html string, n_chars string")
    rows = htmltext.extract(df).collect()
    assert sorted(r.text for r in rows) == ["", *["\n\n".join(["Title", *LONG[:7]])] * 2]
    assert sorted(r.n_chars for r in rows) == sorted(len(r.text) for r in rows)
    assert htmltext.extract(empty(spark).selectExpr("doc_id page_id", "text url", "text html")).count() == 0
