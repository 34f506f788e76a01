import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from edge import ROWS, edge, empty
from quillspark.llm import pii
from quillspark.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s[2] for s in sorted(spans))


@pytest.fixture(scope="module")
def model(spark):
    return pii.default_model(spark)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+-() ax_%\n", max_size=60) | st.text(alphabet="0159 -", max_size=60))
def test_patterns(text):
    assert pii.spans_text(pii.pattern_spans(text)) == brute(text)


def test_query_keeps_the_base(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op6_pii(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        kinds = re.findall("[a-z]+", base)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PATTERNS]
        assert set(base.split(",")) <= set(r.spans.split(","))


def test_the_network_adds_spans(spark):
    text = "please write to our office or call (212) 555-0187 today. " * 3
    df = spark.createDataFrame([(1, text), (2, "nothing personal stands in this text")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert rows[1].base_spans == "" and "phone:" in rows[1].spans
    assert "555-0187" not in rows[1].redacted and rows[2].spans == ""


def plain_emissions(model, codes):
    """Tag scores of one window, written from the equations of the LSTM."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = model.wh.shape[1]
    halves = []
    for d, order in enumerate((range(len(codes)), range(len(codes) - 1, -1, -1))):
        h, c, states = np.zeros(hidden), np.zeros(hidden), np.zeros((len(codes), hidden))
        for t in order:
            z = model.embed[codes[t]] @ model.wx[d] + h @ model.wh[d] + model.b[d]
            i, f, o = (sigmoid(z[k * hidden : (k + 1) * hidden]) for k in range(3))
            c = f * c + i * np.tanh(z[3 * hidden :])
            h = states[t] = o * np.tanh(c)
        halves.append(states)
    return np.concatenate(halves, axis=1) @ model.out + model.out_b


def test_emissions_equal_the_equations(model):
    codes = np.random.Generator(np.random.PCG64(4)).integers(0, pii.N_CHARS, (5, pii.WINDOW))
    assert np.allclose(pii.emissions(model, codes), [plain_emissions(model, c) for c in codes], atol=1e-3)


def test_emissions_of_large_weights_without_the_slow_tanh(model, monkeypatch):
    """Saturated gates, whose exponentials are infinite, equal the equations; numpy's tanh, most of the network's time, is not called."""
    codes = np.random.Generator(np.random.PCG64(6)).integers(0, pii.N_CHARS, (3, pii.WINDOW))
    large = model._replace(embed=model.embed * 40, b=model.b * 10)
    with np.errstate(over="ignore"):
        expected = [plain_emissions(large, c) for c in codes]
    monkeypatch.delattr(np, "tanh")
    assert np.allclose(pii.emissions(large, codes), expected, atol=1e-2)


def decoded_whole(model, text):
    """Every window over every character, averaged, and the plain best path over the whole text, with no constraint."""
    codes, total, seen = pii.char_codes(text), np.zeros((len(text), len(pii.TAGS))), np.zeros((len(text), 1))
    for at in pii.grid(len(text)):
        part = codes[at : at + pii.WINDOW]
        total[at : at + pii.WINDOW] += pii.emissions(model, np.pad(part, (0, pii.WINDOW - len(part)))[None])[0][: len(part)]
        seen[at : at + pii.WINDOW] += 1
    assert seen.all()
    score = total / seen
    best, back = score[0], []
    for t in range(1, len(text)):
        step = best[:, None] + model.trans
        back.append(step.argmax(0))
        best = step.max(0) + score[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return pii.path_spans(np.array(path[::-1]))


def test_decoding_equals_that_of_every_window(spark, model):
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts = [t for t in docs if t and len(t) < 6000][:120] + [t for t, _ in pii.labelled_samples(40, seed=77)] + ["x", "@", "7" * 200, "a" * 31 + "5", "b" * 100 + "1.2.3.4", "call 212-555-0187"]
    texts += ["@mail" * 200, "x" * 600 + "a.b@c.example", "no digit and no sign at all " * 40, "5", "é" * 300, "z" * (pii.WINDOW - 3) + "anna@post.example " + "y" * pii.STRIDE]
    assert pii.model_spans(model, texts) == [decoded_whole(model, t) for t in texts]
    assert pii.model_spans(model, texts[::-1]) == pii.model_spans(model, texts)[::-1]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.3, 4), st.lists(st.text(alphabet="0123456789@.+- ax\n", max_size=700), min_size=1, max_size=3))
def test_decoding_of_any_weights_equals_that_of_every_window(seed, scale, texts):
    """Stretches are bounds, not habits of one model: random transitions and outputs, so that spans start and end anywhere."""
    rng = np.random.Generator(np.random.PCG64(seed))
    fresh = pii._fresh(rng, 4, 3)
    outside = np.where(np.arange(len(pii.TAGS)) == 0, np.float32(scale), 0).astype(np.float32)
    random = fresh._replace(trans=(scale * rng.standard_normal(fresh.trans.shape)).astype(np.float32), out_b=outside, out=(scale * fresh.out).astype(np.float32))
    assert pii.model_spans(random, texts) == [decoded_whole(random, t) if t else [] for t in texts]


def test_stretches_leave_most_of_a_plain_text_out(model):
    text = "plain words stand here without any number at all, line by line. " * 200 + "call 212-555-0187 now. " + "and more plain words follow. " * 200
    own = pii.stretches(model, [pii.char_codes(text)])[0]
    at = text.index("212")
    assert any(a <= at and at + 12 <= b for a, b in own) and sum(b - a for a, b in own) < len(text) / 10


def test_long_stretches_are_decoded_in_chunks(model, monkeypatch):
    text = " ".join(t for t, _ in pii.labelled_samples(30, seed=11)).replace("a", "1")
    whole = pii.model_spans(model, [text])
    monkeypatch.setattr(pii, "CHUNK", 37)
    assert pii.model_spans(model, [text]) == whole == [decoded_whole(model, text)]


def test_the_network_alone_on_held_out_text(spark, model):
    """Exact spans of sentences that were not trained on, and spans of the tables' patterns that the network finds without the patterns."""
    held = pii.labelled_samples(300, seed=99)
    right = wanted = given = 0
    for (_, want), got in zip(held, pii.model_spans(model, [t for t, _ in held])):
        right, wanted, given = right + len(set(want) & set(got)), wanted + len(want), given + len(got)
    assert right / wanted > 0.85 and right / given > 0.85
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    base = [pii.pattern_spans(t) for t in docs]
    found = sum(any(g[2] == k and g[0] < b and a < g[1] for g in got) for spans, got in zip(base, pii.model_spans(model, docs)) for a, b, k in spans)
    assert found / sum(map(len, base)) > 0.9


def test_the_network_adds_what_the_patterns_miss(model):
    """Notations without a pattern: of each kind most are added, and look-alikes are not."""
    held = pii.labelled_samples(300, seed=123)
    missed = caught = 0
    for text, want in held:
        base, every = pii.text_spans(model, [text])[0]
        open_ = [s for s in want if all(s[1] <= a or b <= s[0] for a, b, _ in base)]
        missed += len(open_)
        caught += sum(any(a < s[1] and s[0] < b for a, b, _ in every) for s in open_)
    assert missed > 50 and caught / missed > 0.75
    assert pii.text_spans(model, ["version 1.2 of 2024-11-05, id 00FF 12:30, 1,000,000 and ²²² ٣٣٣"])[0][1] == []


def test_gradients_match_differences():
    rng = np.random.Generator(np.random.PCG64(2))
    model = pii.Model(*[w.astype(np.float64) for w in pii._fresh(rng, 4, 3)])
    codes = rng.integers(0, pii.N_CHARS, (2, 7))
    tags = rng.integers(0, len(pii.TAGS), (2, 7))
    _, grads = pii._gradients(model, codes, tags)
    for k, w in enumerate(model):
        for at in [tuple(int(rng.integers(n)) for n in w.shape) for _ in range(4)]:
            up, down = w.copy(), w.copy()
            up[at] += 1e-4
            down[at] -= 1e-4
            losses = [pii._gradients(model._replace(**{model._fields[k]: x}), codes, tags)[0] for x in (up, down)]
            assert abs((losses[0] - losses[1]) / 2e-4 - grads[k][at]) < 2e-2 * (1 + abs(grads[k][at]))


def test_edge_rows_and_empty(spark):
    df = edge(spark)
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(ROWS)
    clean = pii.redact(df)
    kept = clean.collect()
    assert clean.columns == df.columns and len(kept) == len(ROWS)
    assert {r.text for r in kept if r.doc_id == 1} == {None}
    assert pii.find_pii(empty(spark)).count() == 0
