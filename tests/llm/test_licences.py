import random
import re

from conftest import DATA
from edge import ROWS, edge, empty
from quillspark.llm import licences
from quillspark.llm.queries import op11_license_scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    ws = words(text)
    at = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_query_against_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op11_license_scans(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        # The tables hold declarations; nothing else in them covers a template.
        assert ("cc-by-nc" in r.labels.split(",")) == ("CC BY-NC" in docs[r.doc_id])
        assert bool(r.labels) == bool(re.search("licensed under|released under", docs[r.doc_id], re.I))


def test_edge_rows_and_empty(spark):
    got = licences.scan(edge(spark)).collect()
    assert len(got) == len(ROWS)
    texts = {(r[0], r[1]) for r in ROWS}
    assert {(r.doc_id, r.n_words, r.n_base) for r in got} == {(d, len(words(t)), 0) for d, t in texts}
    assert licences.scan(empty(spark)).count() == 0
    rows = [(1, "MIT License mit-license; Apache  License"), (2, "the mité license"), (3, "general public\nLICENSE"), (4, "mit"), (5, "license")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (3, 0, 4, "apache,mit"), 2: (0, None, None, ""), 3: (1, 0, 0, "gpl"), 4: (0, None, None, ""), 5: (0, None, None, "")}


def test_changed_and_surrounded_licences(spark):
    mit, bsd = licences.TEMPLATES["mit"][1], licences.TEMPLATES["bsd"][0]
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [
        (1, f"{filler} {mit} {filler}"),
        (2, mit.replace("Software", "Package").replace("free of charge", "gratis")),
        (3, f"{bsd}\n{filler}\n{mit}\n{bsd}"),
        (4, " ".join(reversed(mit.split()))),
        (5, " ".join(mit.split()[:30])),
        (6, " ".join(f"{w} {filler}" for w in re.split(r"(?<=,)", mit))),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "bsd,mit", 4: "", 5: "", 6: ""}
    size = len(words(mit))
    assert [(s.label, s.start, s.end, s.covered, s.template_words) for s in got[1].spans] == [("mit", 300, 300 + size, size, size)]
    assert [s.label for s in got[3].spans] == ["bsd", "mit", "bsd"] and all(s.covered == s.template_words for s in got[3].spans)
    assert 0.1 < got[5].score < 0.5 and got[4].score < 0.2


def test_automaton_against_plain_search():
    rng = random.Random(11)
    for _ in range(120):
        templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        automaton = licences.Automaton(templates)
        text = [rng.randrange(-1, 5) for _ in range(60)]
        text = [w if w < 4 else -1 for w in text]
        got = {p: (n, s) for p, n, s in automaton.statistics(text)}
        for p in range(len(text)):
            longest, places = 0, set()
            for length in range(1, p + 2):
                run = text[p + 1 - length : p + 1]
                at = {(k, e) for k, t in enumerate(templates) for e in range(length, len(t) + 1) if t[e - length : e] == run}
                if at:
                    longest, places = length, at
            assert got.get(p, (0, 0))[0] == longest
            if longest:
                ends = automaton.ends[got[p][1]]
                assert set(ends) == places and len(ends) == len(places)


def test_chains_against_all_pairs():
    """The best chain of a template covers as much as trying every pair of anchors finds."""
    rng = random.Random(5)
    for _ in range(200):
        ends = sorted(rng.sample(range(5, 60), rng.randrange(1, 9)))
        anchors, start = [], 0
        for e in ends:
            start = max(start, e - rng.randrange(3, 6))
            anchors.append((e, e - start, [(0, rng.randrange(6, 40))]))
        best = []
        for e, n, [(_, p)] in anchors:
            most = (n, e - n)
            for (f, _, [(_, q)]), (covered, s) in zip(anchors, best):
                cut = max(0, f - (e - n), q - (p - n))
                if f >= e - n - 7 and cut < n and f < e and q < p and p - n + cut - q <= 7 and covered + n - cut > most[0]:
                    most = (covered + n - cut, s)
            best.append(most)
        found = list(licences.chains(anchors, 7))
        assert max(f.covered for f in found) == max(c for c, _ in best)


def test_too_many_template_words(spark, monkeypatch):
    monkeypatch.setattr(licences, "MOST_WORDS", 10)
    try:
        licences.scan(edge(spark))
    except ValueError as e:
        assert "10 words" in str(e)
    else:
        raise AssertionError
