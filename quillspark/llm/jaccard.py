"""N-gram Jaccard join by MinHash banding.

1. Texts are hashed to sets of word n-grams; equal sets form one copy class, and
   one row stands for it.
2. MinHash signatures are cut into bands; the number of rows in a band and of bands
   follow from the similarity and the recall asked for. Representatives meet at
   equal band hashes; each bucket links its members to its lowest one, so links
   grow with members, not with pairs.
3. Connected buckets are candidate components. One within the block bound is one
   task. A larger one is cut into blocks of similar sizes of sets, and a representative
   goes only to the blocks that hold a bucket mate of it; a pair of blocks is a task.
   So the work follows the members of shared buckets, not the square of a component
   that a chain of chance collisions holds together, and no task holds an unbounded group.
4. A task verifies its pairs on the full n-gram sets, which are hashed once and dealt
   as sorted hashes, and returns one row per member: its links there and its local component.
5. Components over verified links are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import by_membership, mix, run_hashes, scratch, staged, text_slices, word_runs

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, rows: int = 7) -> int:
    """Bands of `rows` hashes that a pair at the threshold shares with probability `recall` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every text, with repeats, and n + 1 bounds by text.

    A text of 1 to n - 1 words has one shingle, all its words; one without words has none.
    """
    starts, ends, first = word_runs(data, offsets)
    words = run_hashes(data, starts, ends)
    count = np.diff(first)
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        shifted = words[k:] if k else words
        grams[: len(shifted)] = mix(grams[: len(shifted)] * np.uint64(3) + shifted + np.uint64(k))
    short = np.flatnonzero((count > 0) & (count < n))
    keep = np.ones(len(words), bool)
    last = first[1:]
    for k in range(1, n):  # windows that reach over the end of their text
        at = last[count >= k] - k
        keep[at] = False
    keep[first[:-1][short]] = True
    for i in short:
        h = np.zeros(1, np.uint64)
        for w in words[first[i] : first[i + 1]]:
            h = mix(h * np.uint64(5) + w + np.uint64(97))
        grams[first[i]] = h[0]
    bounds = np.concatenate(([0], np.cumsum(keep)))[first]
    return grams[keep], bounds


def _signatures(grams: np.ndarray, bounds: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Texts x hashes: the least of (a h + b) mod 2**32 over each text's shingles; texts without any get 0."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, len(seeds[0])), np.uint32)
    if len(filled):
        at = bounds[:-1][filled]
        low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        scratch, other = np.empty_like(low), np.empty_like(low)
        for i, (a, b) in enumerate(zip(*seeds)):
            np.multiply(low, a, out=scratch)
            np.right_shift(scratch, np.uint32(15), out=other)
            np.bitwise_xor(scratch, other, out=scratch)
            np.add(scratch, high, out=scratch)
            np.multiply(scratch, b, out=scratch)
            out[filled, i] = np.minimum.reduceat(scratch, at)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values by text, modulo 2**64: the same for equal sets in any order."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _describe(n: int, rows: int, bands: int):
    """Task code: doc_id, text_hash, text -> doc_id, text_hash, set_a, set_b, n_shingles, bands."""
    rng = np.random.Generator(np.random.PCG64(11))
    seeds = tuple(rng.integers(1, 2**32, rows * bands, dtype=np.uint32) | np.uint32(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                grams, bounds = shingle_sets(data, offsets, n)
                # Sort within texts to drop repeats: order by (text, hash).
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((grams, text))
                grams, text = grams[order], text[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
                grams, text = grams[new], text[new]
                bounds = np.searchsorted(text, np.arange(len(bounds)))
                counts = np.diff(bounds)
                keys = [_sums(mix(grams ^ _STEP), bounds), _sums(mix(grams + _STEP), bounds)]
                signature = _signatures(grams, bounds, seeds).astype(np.uint64).reshape(len(counts), bands, rows)
                band = np.zeros((len(counts), bands), np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(3) + signature[:, :, r])
                band = mix(band + np.arange(bands, dtype=np.uint64) * _STEP)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, last - first) for i in (0, 1)], *[pa.array(k.view(np.int64)) for k in keys], pa.array(counts.astype(np.int64)), listed],
                    ["doc_id", "text_hash", "set_a", "set_b", "n_shingles", "bands"],
                )

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): every node of `edges` (src, dst) with the lowest node that it is connected to. A node has a bounded number of edges as src.

    Each round lowers labels to the least among neighbours, then follows the label
    of the label, so paths shorten by half; the driver sees one count a round.
    Every round is a written table: a lost executor costs no more than that round.
    """
    # A node's targets hang on the lowest of them instead of on the node, so that nodes with the same targets share those edges.
    low = edges.groupBy("src").agg(F.min("dst").alias("low"), F.collect_set("dst").alias("all"))
    others = low.filter(F.size("all") > 1).select(F.col("low").alias("src"), F.explode("all").alias("dst")).filter("src <> dst").distinct()
    fewer = staged(low.select("src", F.col("low").alias("dst")).unionByName(others), f"{name}-fewer")
    both = staged(fewer.union(fewer.select("dst", "src")).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        jumped = staged(jumped, f"{name}-labels")
        labels = jumped.select("node", "label")
        if not jumped.filter("label <> old").limit(1).count():
            return labels


def _verified(group: list[tuple[int, int, np.ndarray]], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and local component of each member; group: (id, block, sorted shingles). Across blocks only pairs of both blocks count."""
    k = len(group)
    sizes = np.array([len(g[2]) for g in group])
    every = np.concatenate([g[2] for g in group])
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # shingles of one member add to no intersection
    owner, column = owner[shared], column[shared]
    common = np.zeros((k, k), np.float32)
    if len(column):
        fresh = np.ones(len(column), bool)
        fresh[1:] = column[1:] != column[:-1]
        column = np.cumsum(fresh) - 1
        width = max(256, (1 << 22) // k)
        for at in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            table = np.zeros((k, min(width, int(column[-1]) + 1 - at)), np.float32)
            table[owner[lo:hi], column[lo:hi] - at] = 1
            common += table @ table.T
    inter = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    # inter / union >= threshold, with the threshold as a fraction of integers
    top, bottom = float(threshold).as_integer_ratio() if threshold != round(threshold, 6) else (round(threshold * 1_000_000), 1_000_000)
    linked = (inter * bottom >= union * top) & (inter > 0)
    np.fill_diagonal(linked, False)
    if not same:
        block = np.array([g[1] for g in group])
        linked &= block[:, None] != block[None, :]
    label = np.arange(k)
    while True:
        near = np.where(linked, label[None, :], k).min(axis=1, initial=k)
        lower = np.minimum(label, near)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return linked.sum(axis=1), label


def _grams(n: int):
    """Task code: node, set_a, routes, text -> node, routes, grams (sorted hashes, 8 bytes each); each node once, whatever other text shares its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            nodes, wanted = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for first, last, data, offsets in text_slices(batch.column(3)):
                grams, bounds = shingle_sets(data, offsets, n)
                rows, made = [], []
                for i in range(first, last):
                    own = np.unique(grams[bounds[i - first] : bounds[i - first + 1]])
                    if nodes[i] not in done and _sums(mix(own ^ _STEP), np.array([0, len(own)])).view(np.int64)[0] == wanted[i]:
                        done.add(nodes[i])
                        rows.append(i)
                        made.append(own.tobytes())
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(made, pa.binary())], ["node", "routes", "grams"])

    return run


def _verify(threshold: float):
    """Task code over rows sorted by group: group, same, block, node, grams -> node, links, head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, same, group, out = None, True, {}, ([], [], [])

        def close() -> None:
            if len(group) > 1:
                members = [group[k] for k in sorted(group)]
                links, label = _verified(members, same, threshold)
                out[0].extend(g[0] for g in members)
                out[1].extend(links.tolist())
                out[2].extend(members[i][0] for i in label)
            group.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "head"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            keys, sames, blocks, nodes = (batch.column(i).to_pylist() for i in range(4))
            for i, grams in enumerate(batch.column(4)):
                if keys[i] != key:
                    close()
                    key, same = keys[i], sames[i]
                if nodes[i] not in group:
                    group[nodes[i]] = (nodes[i], blocks[i], np.frombuffer(grams.as_buffer(), np.uint64).copy())
            if len(out[0]) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def _routes(candidate: DataFrame, banded: DataFrame, sizes: DataFrame, threshold: float, block_docs: int, block_shingles: int) -> DataFrame:
    """node, routes: for every candidate the groups (group, same, block) in which it is compared.

    A pair of similar sets differs in size by the threshold at most, so blocks are
    cut inside size classes of that ratio, and only neighbouring classes meet.
    """
    sized = staged(candidate.join(sizes, "node").withColumn("class", F.floor(F.log(F.col("n_shingles")) / F.lit(-math.log(threshold))).cast("long")), "jaccard-sized")
    bound = lambda docs, shingles: F.greatest(F.ceil(docs / block_docs), F.ceil(shingles / block_shingles))
    parts = sized.groupBy("label", "class").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    whole = parts.groupBy("label").agg((bound(F.sum("docs"), F.sum("shingles")) > 1).alias("large"))
    cut = staged(parts.join(whole, "label").select("label", "class", "large", bound(F.col("docs"), F.col("shingles")).alias("n_blocks")), "jaccard-blocks")
    block = F.when(F.col("large"), F.col("class") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("n_blocks"))).otherwise(F.lit(0))
    placed = staged(sized.join(cut, ["label", "class"]).select("node", "label", "large", block.cast("long").alias("block")), "jaccard-placed")

    # Each bucket lists its blocks once; a representative gathers the different lists of its buckets, whose members it never meets one by one.
    inside = staged(banded.join(placed.filter("large").drop("large"), "node"), "jaccard-inside")
    there = inside.groupBy("band", "block").agg((F.count("*") > 1).alias("more")).groupBy("band").agg(F.sort_array(F.collect_list(F.struct("block", "more"))).alias("blocks"))
    met = inside.join(there, "band").groupBy("node", "label", "block").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    class_of = lambda c: F.shiftright(c, 32)
    own = F.col("block")
    wanted = F.filter("blocks", lambda x: (F.abs(class_of(x.block) - class_of(own)) <= 1) & ((x.block != own) | x.more))
    # A block meets itself in the group (block, block) and another block in (low, high).
    route = lambda other: F.struct(F.xxhash64("label", F.least(own, other), F.greatest(own, other)).alias("group"), (other == own).alias("same"), own.alias("block"))
    far = met.select("node", F.array_distinct(F.transform(wanted, lambda x: route(x.block))).alias("routes"))
    near = placed.filter("NOT large").select("node", F.array(route(own)).alias("routes"))
    return near.unionByName(far)


def _linked(
    docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, rows: int, block_docs: int, block_shingles: int
) -> DataFrame:
    """row, doc_id, text_hash, node, label, n_links of every row; label is the lowest node of the class, null where nothing is linked."""
    bands = bands_for(threshold, recall, rows)
    text = F.lower(F.col(text_col).cast("string"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, set_a long, set_b long, n_shingles long, bands array<bigint>"
    sets = ["set_a", "set_b", "n_shingles"]
    with scratch(docs.sparkSession) as keep:
        # Rows are numbered once, in the table that is written.
        described = staged(texts.mapInArrow(_describe(n, rows, bands), schema).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
        copied = staged(described.filter("n_shingles > 0").groupBy(*sets).agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "jaccard-copies")
        named = described.join(copied, sets, "left").withColumn("node", F.coalesce("first", "row"))
        own = F.when((F.col("row") == F.col("node")) & (F.col("n_shingles") > 0), F.col("bands"))
        member = keep(named.select("row", "doc_id", "text_hash", "n_shingles", "set_a", "node", own.alias("bands")), "jaccard-members")
    banded = member.select("node", F.explode("bands").alias("band"))
    member = member.drop("bands")
    heads = staged(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "jaccard-heads")
    # Most bands have one member, so they are told apart before the shuffle.
    banded = staged(by_membership(banded, [F.col("band")], heads, [F.col("band")]).join(heads, "band"), "jaccard-bands")
    edges = banded.filter("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
    candidate = components(edges, "jaccard-candidates")

    first = member.filter("row = node").select("node", "doc_id", "text_hash", "set_a", "n_shingles")
    routes = _routes(candidate, banded.drop("head"), first.select("node", "n_shingles"), threshold, block_docs, block_shingles)
    wanted = staged(first.drop("n_shingles").join(routes, "node"), "jaccard-wanted")
    key = [F.col("text_hash"), F.col("doc_id")]
    asked = by_membership(texts, key, wanted, key)
    same_text = (F.col("t.text_hash") == F.col("w.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    route = "routes array<struct<group: bigint, same: boolean, block: bigint>>"
    grams = asked.alias("t").join(wanted.alias("w"), same_text).select("w.node", "w.set_a", "w.routes", "t.text").mapInArrow(_grams(n), f"node long, {route}, grams binary")
    dealt = grams.select("node", "grams", F.explode("routes").alias("r")).select("r.group", "r.same", "r.block", "node", "grams")
    found = staged(
        dealt.repartition(_partitions(docs), "group").sortWithinPartitions("group").mapInArrow(_verify(threshold), "node long, links long, head long"), "jaccard-links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("n_links")).filter("n_links > 0")
    classes = components(found.filter("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")), "jaccard-classes")
    linked = staged(links.join(classes, "node", "left"), "jaccard-result")
    return member.join(linked, "node", "left").select("row", "doc_id", "text_hash", "n_shingles", "node", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    rows: int = 7,
    block_docs: int = 128,
    block_shingles: int = 250_000,
) -> DataFrame:
    """One row per row of `docs`: doc_id, copy_id, class_id, n_links.

    Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased whole text. copy_id is the
    lowest id with the same n-gram set; class_id the lowest id connected by links of
    Jaccard similarity >= threshold; n_links the number of different n-gram sets that
    the row's own is linked to. A text of fewer than n words has one n-gram, all
    its words. Null texts and texts without words link to nothing, not even to each
    other. Ids are integers and need not be unique: every row is compared with its own
    text. Null ids count as the highest, so they name a class only where no row of it
    has an id. Only id and text are read. Empty table: no rows.
    """
    with scratch(docs.sparkSession) as keep:
        every = keep(_linked(docs, id_col, text_col, n, threshold, recall, rows, block_docs, block_shingles), "jaccard-rows")
    joined = every.filter("n_shingles > 0")
    copies = joined.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n"))
    lowest = joined.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    ids = every.join(copies.filter("n > 1").drop("n"), "node", "left").join(lowest, "label", "left")
    return ids.select(
        "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"), "n_links"
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of `docs` without near copies: of each class the row with the lowest id stays (null ids last), with all its columns.

    Rows that repeat an id and a text are copies. Rows without words all stay. Empty table: no rows.
    """
    with scratch(docs.sparkSession) as keep:
        every = staged(_linked(docs, id_col, text_col, n, threshold, recall, 7, 128, 250_000), "jaccard-rows")
        of_class = every.filter("n_shingles > 0").withColumn("class", F.coalesce("label", "node"))
        lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        first = of_class.groupBy("class").agg(lowest, F.count("*").alias("n")).filter("n > 1").drop("n")
        texts = of_class.join(first, "class").groupBy("doc_id", "text_hash")
        judged = keep(texts.agg(F.max(F.col("row") == F.col("first.row")).alias("stays"), F.count("*").alias("n")), "jaccard-judged")
    columns = docs.columns
    text_hash = lambda d: F.xxhash64(F.lower(d[text_col].cast("string")))

    def without(rows: DataFrame, how: str, d: DataFrame) -> DataFrame:
        keys = d.select(F.col("doc_id").alias("_jaccard_id"), F.col("text_hash").alias("_jaccard_text"))
        same = (text_hash(rows) == keys["_jaccard_text"]) & rows[id_col].cast("long").eqNullSafe(keys["_jaccard_id"])
        return rows.join(keys, same, how)

    going = judged.filter("NOT stays")
    told = lambda how: by_membership(docs, [text_hash(docs), docs[id_col].cast("long")], going, [F.col("text_hash"), F.col("doc_id")], how)
    kept = told("left_anti").unionByName(without(told("left_semi"), "left_anti", going))
    again = judged.filter("stays AND n > 1")
    if not again.limit(1).count():  # no row repeats both an id and a text
        return kept
    once = without(kept, "left_semi", again).groupBy(docs[id_col].alias("id"), text_hash(docs).alias("hash")).agg(F.first(F.struct(*[docs[c] for c in columns])).alias("document"))
    return without(kept, "left_anti", again).unionByName(once.select("document.*"))


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
