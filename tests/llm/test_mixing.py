from collections import defaultdict

from conftest import DATA
from edge import ROWS, edge, empty
from pyspark.sql import functions as F

from quillspark.llm import mixing
from quillspark.llm.queries import op4_mixing


def targets(sizes: dict, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rate = (total - sum(capped.values())) / (sum(weight[s] for s in open_) or 1)
        over = [s for s in open_ if weight[s] * rate > most * sizes[s] + 1e-9]
        if not over:
            return capped | {s: weight[s] * rate for s in open_}
        capped |= {s: most * sizes[s] for s in over}


def check(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= (0.5 if target[s] < 512 else 64 + 0.001 * target[s])
        assert {r.source_size for r in rows if r.source == s} == {sizes[s]}


def test_query(spark):
    rows = op4_mixing(spark, DATA).collect()
    check(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_mixing(spark, DATA).collect()))


def test_a_source_with_most_rows(spark):
    docs = [(i, "w " * (i % 90), "s%d" % (i % 4) if i % 3 else "hot", None, None) for i in range(3000)]
    check(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long"), shard_words=5000).collect())


def test_blocks_against_brute_force(spark):
    """Every shard's line is laid out again, its blocks are cut and chosen one by one, and each document's words are counted."""
    docs = [(i, "w " * (i % 170), f"s{i % 3}") for i in range(900)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), shard_words=3000).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.source, r.shard].append(r)
    order = sorted({r.source for r in rows})
    keys = spark.createDataFrame([(order.index(s), n) for s, n in shards], "a long, b long").selectExpr("a", "b", "explode(sequence(0L, 99L)) AS k")
    hashes = {(order[r.a], r.b, r.k): r.h >> 26 for r in keys.selectExpr("*", "xxhash64(17, a, b, k) AS h").collect()}
    for key, own in shards.items():
        own.sort(key=lambda r: (r.order_hash, r.doc_id))
        line = [i for i, r in enumerate(own) for _ in range(r.size)]
        part = sum(r.part for r in own)
        n, whole = len(line) // 64, part // 64
        blocks = sorted(range(n), key=lambda b: (hashes[(*key, b)], b))
        taken = [x for b in blocks[:whole] for x in line[b * 64 : b * 64 + 64]]
        last = blocks[whole] if whole < n else n
        taken += line[last * 64 : last * 64 + part - whole * 64]
        assert [taken.count(i) for i in range(len(own))] == [r.part for r in own]
    assert len(shards) > 9


def test_blocks_are_chosen_as_if_at_random(spark):
    """Runs of chosen blocks are as many as chance makes them, whatever the number of blocks, and two seeds share the expected part."""
    sizes = [3, 24, 100, 327, 334, 436, 501, 504, 654, 668, 763, 872, 981, 1024, 2000]
    places = spark.createDataFrame([(n,) for n in sizes], "n long").selectExpr("n", "explode(sequence(0L, n - 1)) AS b")
    keys = defaultdict(dict)
    made = places.select("n", "b", *[mixing.block_key(s, F.lit(1), F.col("n"), F.col("b")).alias(f"k{s}") for s in (17, 18)])
    for r in made.collect():
        keys[r.n][r.b] = (r.k17, r.k18)
    for n in sizes:
        first, second = (set(sorted(range(n), key=lambda b: keys[n][b][s])[: n // 2]) for s in (0, 1))
        assert len({k[0] for k in keys[n].values()}) == n
        if n >= 100:
            runs = sum(b - 1 not in first for b in first)
            assert abs(runs - n / 4) < 5 * (n**0.5) / 4 and abs(len(first & second) - n / 4) < 5 * (n**0.5) / 4


def test_many_and_tiny_sources(spark):
    docs = [(i, "w " * (1 + i % 40), f"host{i % 700:04}") for i in range(1400)] + [(5000, "w " * 90_000, "host0001")]
    check(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect())
    few = spark.createDataFrame([(1, "one two three", "a"), (2, "w " * 5000, "b"), (3, "w " * 5000, "c")], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.mix(few).collect()}[1] == 6


def test_all_columns_stay(spark):
    df = edge(spark)
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.select("copy").distinct().collect()[0][0] == "x"
    assert mixing.repeated(empty(spark)).count() == 0


def test_edge_rows_and_empty(spark):
    rows = mixing.mix(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(empty(spark)).count() == 0


def test_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 1}
    df = spark.createDataFrame([("g", k, v, 37) for k, v in votes.items()], "g string, key string, vote long, seats int")
    seats = dict.fromkeys(votes, 0)
    for _ in range(37):
        seats[min(votes, key=lambda k: (-votes[k] / (2 * seats[k] + 1), k))] += 1
    assert {r.key: r.quota for r in mixing.sainte_lague(df, "seats", ["g"], ["key"]).collect()} == seats
