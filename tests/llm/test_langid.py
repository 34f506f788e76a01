import math
import random
from collections import Counter

import numpy as np

from edge import ROWS, edge, empty
from quillspark.llm import langid
from quillspark.llm.common import key_bound, sample_key
from quillspark.llm.queries import op5_language_id

M32 = 0xFFFFFFFF


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang", "text")
    rows = op5_language_id(spark, path).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows_and_empty(spark):
    rows = langid.classify(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3}
    assert langid.classify(empty(spark)).count() == 0


def test_far_texts_are_rejected(spark):
    rng = random.Random(1)
    words = {
        "en": "the quick brown fox jumps over lazy dog and runs away from that house with this other thing".split(),
        "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg von dem haus mit diesem".split(),
    }
    train = [(100 * k + i, " ".join(rng.choices(w, k=12)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(60)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "zzqx vvkj qqq xxk"), (2, "the lazy dog runs over the fox"), (3, "12 34 !!")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert rows[1].rejected and rows[2].lang_pred == "en" and not rows[2].rejected
    assert rows[3].lang_pred == "und" and rows[3].score == 0


def trigram_counts(text):
    """Counts of byte trigrams around letters, text by text, in plain Python."""
    code = [0, *[b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in text.lower().encode()], 0]
    counts = {}
    for a, b, c in zip(code, code[1:], code[2:]):
        if b and (a or c):
            h = (a * 0x9E3779B1 & M32) ^ (b * 0x85EBCA77 & M32) ^ (c * 0xC2B2AE3D & M32)
            h ^= h >> 15
            h = h * 0x2C1B3C6D & M32
            h ^= h >> 13
            counts[h % langid.SLOTS] = counts.get(h % langid.SLOTS, 0) + 1
    return counts


def brute_vectors(texts):
    """Unit TF-IDF vectors as dicts, and the weights of the slots."""
    counted = [trigram_counts(t) for t in texts]
    seen = Counter(s for c in counted for s in c)
    idf = {s: math.log((1 + len(texts)) / (1 + n)) + 1 for s, n in seen.items()}
    rare = math.log(1 + len(texts)) + 1
    return [unit({s: math.log1p(n) * idf[s] for s, n in c.items()}) for c in counted], lambda s: idf.get(s, rare)


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def test_nearest_centroids_against_brute_force(spark):
    """Every text of the training table is in the sample; centroids, languages and scores are computed again in plain Python."""
    rng = random.Random(8)
    letters = {"xx": "abcdef gh", "yy": "ghijkl mé", "zz": "qrstuv xß"}
    train = [(1000 * k + i, "".join(rng.choices(a, k=rng.randrange(30, 90))), lang) for k, (lang, a) in enumerate(letters.items()) for i in range(30)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(df, rows_per_lang=10**6)
    keys = {r.doc_id: r.k for r in df.select("doc_id", sample_key("lang", "doc_id").alias("k")).collect()}
    train.sort(key=lambda r: keys[r[0]])
    vectors, idf = brute_vectors([t for _, t, _ in train])
    pick = np.random.Generator(np.random.PCG64(13))
    centroids = []
    for lang in sorted(letters):
        own = [v for v, r in zip(vectors, train) if r[2] == lang]
        centre = [own[i] for i in pick.permutation(len(own))[:4]]
        for _ in range(8):
            groups = [[] for _ in centre]
            for v in own:
                groups[max(range(len(centre)), key=lambda k: (dot(v, centre[k]), -k))].append(v)
            centre = [unit({s: sum(v.get(s, 0.0) for v in g) / len(g) for s in {s for v in g for s in v}}) if g else c for g, c in zip(groups, centre)]
        centroids += [(lang, c) for c in centre if any(max(range(len(centre)), key=lambda k: dot(v, centre[k])) == centre.index(c) for v in own)]
    assert model.langs == [c[0] for c in centroids]
    asked = [(i, "".join(rng.choices("abcdefghijklmqrstuvé ß", k=60))) for i in range(40)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        v = unit({s: math.log1p(n) * idf(s) for s, n in trigram_counts(text).items()})
        best = max(centroids, key=lambda c: dot(v, c[1]))
        assert abs(got[i].score - dot(v, best[1])) < 2e-4
        assert got[i].lang_pred == best[0] or abs(dot(v, best[1]) - max(dot(v, c[1]) for c in centroids if c[0] == got[i].lang_pred)) < 1e-4


def test_many_languages_and_ties(spark):
    rng = random.Random(2)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(300)]
    rows = [(i * 10 + k, " ".join("".join(rng.choices(a, k=6)) for _ in range(20)), f"l{i:03}") for i, a in enumerate(alphabets) for k in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=600)
    assert set(model.langs) == {f"l{i:03}" for i in range(300)} and len(model.langs) <= 1200
    few = langid.fit(spark.createDataFrame(rows + [(9000 + k, rows[40][1], "l010") for k in range(3)] + [(9100, rows[1000][1], "l250")], "doc_id long, text string, lang string"), most_rows=20)
    assert set(few.langs) == {"l010", "l250", *[f"l{i:03}" for i in range(19) if i != 10]}
    same = [(i, "one and the same text for both", lang) for i, lang in enumerate(["b", "a", "c"])]
    tied = langid.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(same, "doc_id long, text string, lang string"), tied).collect()} == {"a"}


def test_sample_bounds_hold_at_any_size():
    for count in (10, 10**6, 10**10, 10**15):
        bound = key_bound(400, count)
        assert abs(bound / 2**63 - min(1, 400 / count)) <= 1e-6 * min(1, 400 / count)
    assert key_bound(1, 10**30, first=77) == 77 and key_bound(5, 0) == 2**63 - 1
