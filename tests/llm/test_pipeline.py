"""The corpus pipeline: contracts between its stages, and each stage against brute force on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from conftest import DATA
from edge import CLASHES, ROWS, edge
from test_jaccard import brute as jaccard_brute
from test_packing import _whole
from test_pii import brute as pii_brute
from test_rules import brute as rules_brute


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in after}
            assert not any(rules_brute(r.text)[-1] for r in after)
            assert len(kept) > 0.5 * len(before)
        elif name == "ngram_jaccard_join":
            want = jaccard_brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {d for d, v in want.items() if v[1] == d}
        elif name == "pii":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert not any(pii_brute(r.text) for r in after)
            old = {r.doc_id: r.text for r in before}
            assert all(r.text == old[r.doc_id] for r in after if not any(c.isdigit() or c == "@" for c in old[r.doc_id]))
        elif name == "mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
            assert max(sum(r.doc_id == d for r in after) for d in {r.doc_id for r in after}) <= 2
        else:
            texts = {}
            for r in before:
                texts.setdefault(r.doc_id, r.text)
            once = {(r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in after}
            assert {r.doc_id for r in after} == set(texts) and len(once) <= len(after)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_edges_in_every_stage(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = edge(spark)
    early = stages["ngram_jaccard_join"](spark, docs, DATA)  # evaluated after all other calls: its tables outlive them
    got = {}
    for name, stage in stages.items():
        out = stage(spark, docs, DATA)
        got[name] = out.collect()
        if name != "packing":  # further columns stay as they are, whatever their names
            assert out.columns == docs.columns
            assert {r[c] for r in got[name] for c in CLASHES} <= {"x"}
        assert stage(spark, docs.limit(0), DATA).count() == 0
    ids = sorted({str(r[0]) for r in ROWS})
    assert {r.doc_id for r in got["quality_rules"]} <= {4}
    assert sorted(str(r.doc_id) for r in got["ngram_jaccard_join"]) == sorted(str(r.doc_id) for r in early.select("doc_id").collect()) == ids
    assert len(got["pii"]) == len(ROWS)
    assert {r.doc_id for r in got["mixing"]} <= {None, 4, 5, 6, 7, 8} and {r.source for r in got["mixing"]} >= {"a", "b"}
    assert {r.doc_id for r in got["packing"]} == {r[0] for r in ROWS}


def test_mixing_repeats_follow_the_taken_words(spark):
    from quillspark.llm import mixing

    docs = spark.createDataFrame([(i % 90 or None, f"{'w ' * (20 + i % 30)}{i % 90}", None, f"s{i % 3}", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).collect()
    got = mixing.mix(mixing.repeated(docs)).groupBy("source").agg({"size": "sum"}).collect()
    got = {r.source: r["sum(size)"] for r in got}
    assert mixing.repeated(docs).filter("doc_id IS NULL").count() > 0
    assert all(abs(got[r.source] - r["sum(taken)"]) < 0.15 * r["sum(taken)"] + 100 for r in taken)
