"""Suggestion, assignment, revision, proof and term operators against plain Python."""

import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quillspark.operators import assign, match, revision, suggest, terms
from quillspark.plans import editorial


def bm25(questions, sections, most):
    bags = {q: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for q, t in questions}
    bags = {q: b for q, b in bags.items() if b}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    df = Counter(t for b in bags.values() for t in b)
    out = set()
    for s, text in sections:
        asked, scores = Counter(re.findall(r"[^\W_]+", (text or "").lower())), []
        for q, b in bags.items():
            shared = [t for t in asked if t in b]
            value = lambda t: math.floor(1e6 * math.log(1.0 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (b[t] * 2.2) / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)))  # noqa: B023, E731
            if shared:
                scores.append((-sum(asked[t] * value(t) for t in shared), q, len(shared)))
        out |= {(s, place, q, -score, k) for place, (score, q, k) in enumerate(sorted(scores)[:most], 1)}
    return out


def test_suggestions_with_a_term_that_every_question_holds(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "the", "the", "plan", "week", "night", "Rest", "exam", "été", "수능"])
    questions = [(i, " ".join(["the", *[word() for _ in range(rng.randrange(0, 12))]])) for i in range(1500)] + [(9001, None), (9002, "?!")]
    sections = [(i, " ".join(word() for _ in range(5))) for i in range(6)] + [(77, None), (78, "nothing that stands there x9"), (79, "the the the")]
    q, s = spark.createDataFrame(questions, "q long, t string").repartition(5), spark.createDataFrame(sections, "s long, d string")
    index = suggest.indexed(q, "q", "t")
    got = suggest.suggested(index, s, "s", "d", 7)
    assert {tuple(r) for r in got.collect()} == bm25(questions, sections, 7)
    assert index.frequencies.filter("df > 1000").count() == 1  # so the salted way was taken
    empty = suggest.indexed(q.limit(0), "q", "t")
    assert suggest.suggested(empty, s, "s", "d", 7).count() == 0 and suggest.suggested(index, s.limit(0), "s", "d", 7).count() == 0
    answers = spark.createDataFrame([(1, 3), (2, None), (3, 5), (4, 3)], "a int, q long")
    assert sorted(r.a for r in suggest.answering(answers, "q", spark.createDataFrame([(3, 1), (3, 2)], "question long, section int")).collect()) == [1, 4]


def deferred(pairs, most):
    """One proposal at a time."""
    wish = {}
    for e, s, rank, score in pairs:
        wish.setdefault(e, []).append((rank, s, score))
    queue, held = [(e, iter(sorted(w))) for e, w in sorted(wish.items())], {}
    while queue:
        e, rest = queue.pop()
        step = next(rest, None)
        if step is None:
            continue
        own = held.setdefault(step[1], [])
        own.append((-step[2], e, rest))
        own.sort(key=lambda x: x[:2])
        if len(own) > most:
            _, out, its = own.pop()
            queue.append((out, its))
    return {(e, s, -score) for s, own in held.items() for score, e, _ in own}


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_stable_and_equals_single_proposals(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for e in range(120):
        # A third of all essays like section 0 best.
        wish = rng.sample(range(1, 9), rng.randrange(1, 6)) + [0] * (e % 3 == 0)
        rng.shuffle(wish)
        pairs += [(e, s, 0 if s == 0 else rng.randrange(4), rng.randrange(6)) for s in wish]
    df = assign.candidate_pairs(spark.createDataFrame(pairs, "e long, s long, r long, p long"), "e", "s", F.col("r"), F.col("p"))
    most = rng.randrange(3, 12)
    got, rounds = assign.assigned(df, most)
    assert {(r.essay, r.section, r.score) for r in got.collect()} == deferred(pairs, most) and rounds > 1
    assert assign.blocking(df, got, most).count() == 0
    worst = got.filter("section <> 0")
    assert assign.blocking(df, worst, most).count() > 0
    assert max(r["count"] for r in got.groupBy("section").count().collect()) <= most and got.groupBy("essay").count().filter("count > 1").count() == 0


def test_assignment_without_pairs_places_or_values(spark):
    schema = "e long, s long, r long, p long"
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 0, 9), (1, 2, None, 1), (None, 1, 1, 1), (2, 1, 0, 9)], schema)
    pairs = assign.candidate_pairs(df, "e", "s", F.col("r"), F.col("p"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 1, 0, 9), (2, 1, 0, 9)]
    assert [tuple(r) for r in assign.assigned(pairs, 1)[0].collect()] == [(1, 1, 1, 9)]
    assert assign.assigned(pairs, 0)[0].count() == 0 and assign.assigned(pairs.limit(0), 3)[0].count() == 0


def test_a_query_of_assignment_is_stable(spark):
    pairs = editorial._pairs(spark, DATA)
    taken = editorial.stable_assignment(spark, DATA)
    assert assign.blocking(pairs, taken, editorial.ESSAYS).count() == 0


def test_longest_increasing_and_alignment():
    rng = random.Random(9)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(0, 11))]
        best = [1] * len(values)
        for i, v in enumerate(values):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
        found = revision.longest_increasing(values)
        assert len(found) == max(best, default=0) and found == sorted(found) and all(values[x] < values[y] for x, y in zip(found, found[1:]))
    for _ in range(300):
        a = rng.sample("abcdefghijkl", rng.randrange(0, 12))
        b = rng.sample("abcdefghijkl", rng.randrange(0, 12))
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
        assert len(revision.aligned(a, b)) == common[-1][-1]  # lines that differ: as many as can be kept


def test_hunks_cover_both_sides_and_rebuild_the_revision(spark):
    rng = random.Random(4)
    line = lambda: rng.choice(["x", "y", "", "same", f"own {rng.randrange(99)}"])
    old, new = [], []
    for i in range(150):
        a = [line() for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), line())
        old.append((i, "\n".join(a)))
        new.append((i, "\n".join(b) if b else None))
    old += [(2**60 + 1, "z"), (500, None), (501, "only before\nx"), (502, ""), (503, "a\nb\nc\nd\ne"), (504, "r\n" * 3000), (None, "lost")]
    new += [(500, "x"), (502, "y"), (503, "a\nb\nnew\nc\nd\ne"), (504, "r\n" * 2000 + "s\n" + "r\n" * 1000), (505, "only after")]
    before, after = spark.createDataFrame(old, "id long, t string"), spark.createDataFrame(new, "id long, t string")
    made = revision.hunks(before, after, "id", "t")
    by_key = {}
    for r in made.orderBy("key", "hunk").collect():
        by_key.setdefault(r.key, []).append(r)
    was, now = dict(old), dict(new)
    for key, parts in by_key.items():
        a, b = ([] if x.get(key) is None else x[key].split("\n") for x in (was, now))
        i = j = 0
        for r in parts:
            assert (r.before_at, r.after_at) == (i, j)
            if r.kind == "kept":
                assert a[i : i + r.before_n] == b[j : j + r.after_n]
            else:
                assert (r.before, r.after) == (a[i : i + r.before_n], b[j : j + r.after_n])
                assert r.kind == {(0, 1): "inserted", (1, 0): "deleted", (1, 1): "replaced"}[r.before_n > 0, r.after_n > 0]
            i, j = i + r.before_n, j + r.after_n
        assert (i, j) == (len(a), len(b)) and all(x.kind != y.kind for x, y in zip(parts, parts[1:]))
    assert [(r.kind, r.before_at, r.after) for r in by_key[503] if r.kind != "kept"] == [("inserted", 2, ["new"])]
    assert [r.kind for r in by_key[504]] == ["kept", "inserted", "kept"]
    rebuilt = {r.id: r.t for r in revision.applied(before, made, "id", "t").collect()}
    assert {k: v for k, v in rebuilt.items() if v is not None} == {k: v for k, v in new if v is not None}
    assert revision.hunks(before.limit(0), after.limit(0), "id", "t").count() == 0


def test_what_a_task_gathers_is_bounded_by_characters():
    """Texts of half a million characters that change wholly: each goes on before many more are read, and no batch holds more than a few."""
    taken = []

    def batches():
        for n in range(40):
            taken.append(n)
            text = [chr(97 + n % 26) * 1000 + str(i) for i in range(500)]
            yield pa.RecordBatch.from_pydict({"key": [str(n)], "before": ["\n".join(text)], "after": ["new"]})

    made = revision._hunks(batches())
    first = next(made)
    assert len(taken) < 10 and first.nbytes < 2 * revision.CHARS
    assert sum(len(b) for b in [first, *made]) == 40


def test_documents_of_one_batch_leave_in_bounded_parts():
    """Many changed documents arrive in one batch; their hunks leave in several, and Python objects never stand for the whole batch."""
    lines = [chr(97 + i % 26) * 200 for i in range(200)]
    old = ["\n".join(f"{n} {i} {x}" for i, x in enumerate(lines)) for n in range(400)]
    new = ["\n".join(x.split("\n")[:100]) + "\n" + "\n".join(x.split("\n")[100:]).upper() for x in old]
    batch = pa.RecordBatch.from_pydict({"key": [str(n) for n in range(400)], "before": old, "after": new})
    sizes, parts = [], {}
    tracemalloc.start()
    for made in revision._hunks(iter([batch])):
        sizes.append(made.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) > 1 and max(sizes) < 2 * revision.CHARS and peak < 8 * revision.CHARS < batch.nbytes
    for made in revision._hunks(iter([batch])):
        for key, kind, at, n, after in zip(*(made.column(c).to_pylist() for c in ("key", "kind", "before_at", "before_n", "after"))):
            parts.setdefault(int(key), []).extend(old[int(key)].split("\n")[at : at + n] if kind == "kept" else after)
    assert ["\n".join(parts[n]) for n in range(400)] == new


def test_registered_hunks_give_the_revision(spark):
    before, after = editorial._proofs(spark, DATA)
    made = editorial.revision_hunks(spark, DATA)
    assert {tuple(r) for r in revision.applied(before, made, "doc_id", "text").collect()} == {tuple(r) for r in after.collect()}


def test_originals_are_shuffled_once_to_rebuild_the_revision(spark):
    """Before, after and hunks: three shuffles, the first of them read twice."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = editorial.revision_applied(spark, DATA)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert (len(re.findall(r"[-:] Exchange ", plan)), plan.count("ReusedExchange [")) == (3, 1)


def report(old, new, least=0.5):
    """Sentences told apart one pair at a time."""
    out = set()
    cut = lambda t: [s for s in (x.strip(" ") for x in re.sub(r"([.!?])\s+", r"\1\n", t or "").split("\n")) if s]
    for key in old.keys() | new.keys():
        a, b = cut(old.get(key)), cut(new.get(key))
        kept = revision.aligned(a, b)
        out |= {(key, "kept", i, j) for i, j in kept}
        left, right = [i for i in range(len(a)) if i not in {x for x, _ in kept}], [j for j in range(len(b)) if j not in {y for _, y in kept}]
        for i in list(left):
            j = next((j for j in right if b[j] == a[i]), None)
            if j is not None:
                out.add((key, "moved", i, j))
                left.remove(i)
                right.remove(j)
        bag = lambda s: set(re.findall(r"[^\W_]+", s.lower()))
        rare = {t for t in set().union(*[bag(a[i]) for i in left], set()) if sum(t in bag(a[i]) for i in left) <= revision.RARE and sum(t in bag(b[j]) for j in right) <= revision.RARE}
        pairs = sorted((-len(bag(a[i]) & bag(b[j])) / len(bag(a[i]) | bag(b[j])), i, j) for i in left for j in right if bag(a[i]) & bag(b[j]) & rare)
        for less, i, j in pairs:
            if -less >= least and i in left and j in right:
                out.add((key, "changed", i, j))
                left.remove(i)
                right.remove(j)
        out |= {(key, "missing", i, None) for i in left} | {(key, "added", None, j) for j in right}
    return out


def test_sentences_told_apart(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    old, new = {}, {}
    for k in range(40):
        a = [" ".join(word() for _ in range(rng.randrange(1, 6))) + rng.choice(".!?") for _ in range(rng.randrange(0, 14))]
        b = [" ".join(word() if rng.random() < 0.2 else w for w in s[:-1].split()) + s[-1] if rng.random() < 0.4 else s for s in a if rng.random() > 0.1]
        if len(b) > 3:
            b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b))))
        old[k], new[k] = " ".join(a), "\n".join(b)
    # One document with very many sentences that share their words.
    old[99] = " ".join(f"it was seen n{i} by day d{i}." for i in range(900))
    new[99] = " ".join(f"it was seen n{i} by night d{i}." for i in range(900) if i % 90)
    old[100], old[101], new[102] = None, "Gone.", "Come!"
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, t string")
    got = {(r.key, r.kind, r.before_at, r.after_at) for r in revision.sentence_report(frame(old), frame(new), "id", "t").collect()}
    assert got == report(old, new)
    assert Counter(k for _, k, _, _ in got)["moved"] > 3 and sum(1 for x in got if x[:2] == (99, "changed")) == 890
    assert revision.sentence_report(frame(old).limit(0), frame(new).limit(0), "id", "t").count() == 0


def test_registered_report_against_plain_python(spark):
    before, after = editorial._proofs(spark, DATA)
    got = [(r.key, r.kind, r.before_at, r.after_at) for r in editorial.proof_report(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == report({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()})


def scanned(text, rules):
    at, out, hits = 0, [], []
    while at < len(text):
        term = max((t for t in rules if text.startswith(t, at)), key=len, default=None)
        if term:
            out.append(rules[term])
            hits.append((at, term, rules[term]))
            at += len(term)
        else:
            out.append(text[at])
            at += 1
    return "".join(out), hits


def test_terms_against_a_literal_scan(spark):
    rng = random.Random(6)
    rules = {"".join(rng.choice("ab가") for _ in range(rng.randrange(1, 6))): rng.choice(["", "X", "ab", "longer 가"]) for _ in range(60)} | {"🙂b": "smile", "스킬": "기술", "bcde": "1", "cd": "2", "abcdx": "3"}
    docs = [(i, "".join(rng.choice("ab가c 🙂") for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "스킬을 스스킬"), (503, "ab" * 20_000), (503, "ab" * 20_000), (None, "a🙂b"), (504, "abcdy abcdex bcdx"), (2**60 + 1, "b")]
    table = spark.createDataFrame([*rules.items(), (None, "n"), ("", "e"), ("스킬", "힣")], "term string, replacement string")
    df = spark.createDataFrame(docs, "id long, t string")
    done = terms.replaced(df, table, "id", "t")
    got = [(r.key, r.text, [tuple(h) for h in r.hits]) for r in done.collect()]
    assert sorted(got, key=repr) == sorted([(i, *scanned(t, rules)) if t is not None else (i, None, []) for i, t in docs], key=repr)
    hits = Counter((h[1]) for _, _, hs in got for h in hs)
    assert {(r.term, r.hits) for r in terms.used(done).collect()} == set(hits.items()) and terms.hit_log(done).count() == sum(hits.values())
    assert terms.replaced(df.limit(0), table, "id", "t").count() == 0
    assert {r.text for r in terms.replaced(df, table.limit(0), "id", "t").collect()} == {t for _, t in docs}


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_CHARS", 3)
    with pytest.raises(ValueError):
        terms.rule_list(spark.createDataFrame([("abc", "d")], "term string, replacement string"))


def test_prefix_narrowing_against_the_pairs(spark):
    rng = random.Random(12)
    value = lambda: rng.choice([None, "", "".join(rng.choice("ab대") for _ in range(rng.randrange(1, 8)))])
    people = [(i, rng.choice(["kim", "lee", "hot", "hot", "hot", None]), value()) for i in range(300)] + [(900, "one", "abc"), (901, "hot", "zyxw대"), (902, "lee", "q")]
    asked = [(i, rng.choice(["kim", "lee", "hot", "hot", "one", "none", None]), value()) for i in range(300)]
    asked += [(900, "hot", "zyxw"), (901, "lee", "aqa"), (902, "hot", "zyx"), (903, "hot", "xwv")]
    p = spark.createDataFrame(people, "person_id int, name string, univ string")
    r = spark.createDataFrame(asked, "row_id int, name string, own string")
    from quillspark.functions.scalars import same_university

    want = match.narrowed(r, p, same_university(F.col("own"), F.col("univ")), ["own"], ["univ"])
    got = match.narrowed_by_prefix(r, p, "own", "univ")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {x.how for x in got.collect()} == {"matched", "narrowed", "ambiguous", "unmatched"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
