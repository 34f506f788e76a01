import math
import random
import re
from collections import Counter

import numpy as np

from conftest import DATA, assert_same
from edge import edge, empty
from quillspark.llm import lexical
from quillspark.llm.queries import ORACLES, op13_ranked_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    count, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_against_sql(spark, duck):
    assert_same(op13_ranked_lexical_search(spark, DATA), duck, ORACLES["op13_ranked_lexical_search"])


def test_edge_rows_ties_and_blocks_of_items(spark):
    docs = [(r.doc_id, r.text) for r in edge(spark).collect()]
    items = [(1, "row phone SAME twice twice"), (2, None), (3, ""), (4, "nothing-that-stands-anywhere-x1y2"), (5, "Ünïcödé va؟ word3 stays"), (5, "quoted plain"), (None, "the row")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "'x' AS rank", "'x' AS block")
    for item_bytes in (lexical.ITEM_BYTES, 100):
        got = found(lexical.search(edge(spark), asked, item_bytes=item_bytes, doc_bytes=1 << 10))
        assert got == brute(docs, items)
    assert lexical.search(empty(spark), asked).count() == 0
    assert lexical.search(edge(spark), asked.limit(0)).collect() == []
    assert lexical.search(edge(spark), asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_equal_scores_take_the_lowest_ids(spark):
    rng = random.Random(3)
    docs = [(i, "common word" if i % 3 else " ".join(rng.choice(["common", "rare", "odd", "word"]) for _ in range(rng.randrange(1, 9)))) for i in rng.sample(range(3000), 900)]
    items = [(i, " ".join(rng.choice(["common", "rare", "odd", "word", "absent"]) for _ in range(4))) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    assert found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), doc_bytes=200)) == brute(docs, items)
    assert found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), most=2)) == brute(docs, items, 2)


def test_length_factors_beyond_64_bits():
    lengths = np.array([1, 10**9, 7])
    assert lexical.length_factors(lengths, 10**12, 10**15).tolist() == [25 + 75 * n * 10**12 // 10**15 for n in lengths.tolist()]
    assert lexical.length_factors(lengths, 10, 999).tolist() == [25 + 75 * n * 10 // 999 for n in lengths.tolist()]
