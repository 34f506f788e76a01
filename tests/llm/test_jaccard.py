import random
import re

from conftest import DATA
from edge import ROWS, edge, empty
from pyspark.sql import functions as F

from quillspark.llm import jaccard
from quillspark.llm.common import by_membership
from quillspark.llm.queries import op3_ngram_jaccard_join


def brute(docs, n=5, threshold=0.8):
    """id -> (copy_id, class_id, n_links) by comparing every pair of different sets."""
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[doc_id] = frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()
    by_set = {}
    for doc_id in sorted(sets):
        by_set.setdefault(sets[doc_id], doc_id)
    copy = {d: by_set[s] if s else d for d, s in sets.items()}
    heads = sorted({c for c in copy.values() if sets[c]})
    links, label = {h: set() for h in heads}, {h: h for h in heads}
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common * 10 >= 8 * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
    changed = True
    while changed:
        changed = False
        for a in heads:
            low = min([label[a], *(label[b] for b in links[a])])
            changed |= low < label[a]
            label[a] = low
    return {d: (c, label.get(c, c), len(links.get(c, ()))) for d, c in copy.items()}


def found(df):
    return {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in df.collect()}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    assert found(op3_ngram_jaccard_join(spark, DATA)) == want
    assert any(v[2] for v in want.values())


def test_large_groups_of_near_copies_are_cut_into_blocks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 5):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((i, " ".join(own)))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert found(jaccard.near_duplicates(df, block_docs=8)) == want
    assert found(jaccard.near_duplicates(df, block_shingles=700)) == want


def test_a_chain_of_collisions_is_not_compared_as_a_whole(spark):
    """Sparse links through one long chain: results equal all pairs, and blocks that share no bucket never meet."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for i in range(150):
        for _ in range(2):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        docs.append((i, " ".join(base)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(jaccard.near_duplicates(df, block_docs=4)) == brute(docs)


def test_edge_rows_and_empty(spark):
    rows = jaccard.near_duplicates(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].class_id == 1 and by_id[2].class_id == 2 and by_id[3].n_links == 0
    assert by_id[5].class_id == 5 and by_id[5].n_links == 0
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(120)]
    near = " ".join(words[:-1] + ["other"])
    text = " ".join(words)
    rows = [(5, text), (None, near), (7, "quite another text that stands here"), (7, near + " more"), (None, "alone and without an id at all"), (None, None), (8, text)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.copy_id), str(r.class_id), r.n_links) for r in got) == sorted(
        [("5", "5", "5", 2), ("None", "None", "5", 2), ("7", "7", "7", 0), ("7", "7", "5", 2), ("None", "None", "None", 0), ("None", "None", "None", 0), ("8", "5", "5", 2)]
    )
    left = jaccard.distinct_documents(spark.createDataFrame([*rows, (5, text)], "doc_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in [rows[0], rows[2], rows[4], rows[5]])


def test_bands_reach_the_recall():
    for threshold in (0.7, 0.8, 0.9):
        bands = jaccard.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**7) ** bands >= 0.999 > 1 - (1 - threshold**7) ** (bands - 1)


def test_membership_loses_no_row_and_its_two_sides_are_a_partition(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, str(i % 40) if i % 3 else None, i) for i in range(400)], "word long, bits string, n long")
    keys = rows.filter("n % 8 = 0").select("word", "bits")
    own = [F.col("word"), F.col("bits")]
    maybe = {r.n for r in by_membership(rows, [rows["word"], rows["bits"]], keys, own).collect()}
    surely_not = {r.n for r in by_membership(rows, [rows["word"], rows["bits"]], keys, own, "left_anti").collect()}
    wanted = {(r.word, r.bits) for r in keys.collect()}
    assert {r.n for r in rows.collect() if (r.word, r.bits) in wanted} <= maybe
    assert not maybe & surely_not and maybe | surely_not == set(range(400)) and surely_not
    assert not by_membership(rows, [rows["word"]], keys.limit(0), [F.col("word")]).count()
