import random
import re

from pyspark.sql import functions as F

from conftest import DATA, assert_same
from edge import ROWS, edge, empty
from quillspark.llm import rules
from quillspark.llm.queries import ORACLES, op7_quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in rules.SYMBOLS for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_query_against_sql(spark, duck):
    assert_same(op7_quality_rules(spark, DATA), duck, ORACLES["op7_quality_rules"])


def test_counts_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op7_quality_rules(spark, DATA).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_edge_rows_and_empty(spark):
    rows = rules.apply_rules(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.document.text)
    assert rules.apply_rules(empty(spark)).count() == 0
    assert rules.kept_documents(edge(spark)).columns == edge(spark).columns
    assert {r.kept for r in rules.kept_documents(edge(spark)).select("kept").collect()} <= {"x"}


def test_windows_whose_hashes_agree(spark, monkeypatch):
    """Repeats are found by the words, at every length, also where nearly all hashes collide."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 90)))) for i in range(80)]
    docs += [(100, "w630076 x y q1 w995378 x y q2 w630076 x y q3"), (101, "w136773 x y q1 w6731918 x y q2 w136773 x y q3"), (102, " ".join(f"u{i}" for i in range(900)))]
    docs += [(103, " ".join(f"w{i % 7001}" for i in range(11_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    exact = {d: brute(t)[4] for d, t in docs}
    assert exact[100] == exact[101] == 6 and exact[102] == 0
    assert {r.document.doc_id: r.n_repeat_words for r in rules.apply_rules(df).collect()} == exact
    for bits in (8, 1):
        monkeypatch.setattr(rules, "_window_hash", lambda *ws, m=(1 << bits) - 1: F.xxhash64(*ws).bitwiseAND(F.lit(m)))
        assert {r.document.doc_id: r.n_repeat_words for r in rules.apply_rules(df).collect()} == exact


def test_texts_of_very_many_words(spark):
    docs = [(1000, " ".join(f"w{i % 700_001}" for i in range(1_100_000))), (1001, " ".join(f"w{i}" for i in range(1_060_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.document.doc_id: r.n_repeat_words for r in rules.apply_rules(df).collect()} == {d: brute(t)[4] for d, t in docs}


def test_no_user_function_runs(spark):
    plan = rules.apply_rules(edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
