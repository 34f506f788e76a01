"""Mixing sources to target weights, with DataFrame functions only.

Blocks of equal token counts are given to sources, and inside a source to its
shards, by Sainte-Lague's highest quotients (v / 1, v / 3, v / 5, ...). In each
shard the documents are laid end to end in a seeded order and the token line is cut
into blocks. A quota takes every block of its shard once a pass, and the blocks
that are left of it are those with the least seeded hashes of the shard's blocks. The
shard's row knows the hash up to which blocks are taken, so no block is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, running, scratch, staged


def words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """Place of a document in the seeded order; equal for rows of equal id and text."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def repeated(docs: DataFrame, seed: int = 17, **columns) -> DataFrame:
    """`docs` as often as the mix takes each: whole passes, and one more copy if the partial pass takes half of it or more.

    Rows of equal id, text and source repeat by their mean, rounded. Null ids match
    by their text; null and empty texts have no words and go. All columns stay, whatever
    their names. Empty table: no rows.
    """
    with scratch(docs.sparkSession) as keep:
        mixed = mix(docs, seed=seed, **columns)
        times = F.col("passes") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)
        copies = (
            mixed.withColumn("times", F.when(F.col("size") > 0, times).otherwise(0))
            .groupBy("doc_id", "source", "order_hash")
            .agg(F.round(F.avg("times")).cast("int").alias("times"))
            .filter("times > 0")
        )
        copies = keep(copies, "mix-copies")
    doc_id, text, source = (columns.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    same = (
        (order_hash(docs[doc_id], docs[text], seed) == copies["order_hash"])
        & docs[doc_id].eqNullSafe(copies["doc_id"])
        & docs[source].cast("string").eqNullSafe(copies["source"])
    )
    # One struct for all columns, so that none of them can clash with the working ones.
    rows = docs.join(copies, same).select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), F.explode(F.sequence(F.lit(1), copies["times"])).alias("nth"))
    return rows.select("document.*")


def capped_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add `target` to rows (source, source_size, weight, source_rank).

    Targets split `share` of all sizes by weight; none exceeds `most` times its
    source's size, and the excess goes to the others by weight. In order of cap /
    weight, the first source that its cap does not bind fixes the common rate. Sums
    before each source are made in parallel; one row of totals and one rate meet all sources.
    """
    ranked = sources.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = running(ranked, [F.col("ratio"), F.col("source_rank")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, "mix-caps")
    ordered = staged(ordered, "mix-ordered")
    totals = ordered.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("weights"))
    rate = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    rated = ordered.join(F.broadcast(totals)).withColumn("rate", rate).filter("rate <= ratio")
    first = rated.agg(F.min_by("rate", F.struct("ratio", "source_rank")).alias("rate"))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("rate", F.lit(float("inf"))))
    return ordered.join(F.broadcast(first)).withColumn("target", target).select(*sources.columns, "target")


def sainte_lague(votes: DataFrame, seats: str, group: list[str], key: list[str], vote: str = "vote", name: str | None = None) -> DataFrame:
    """Add `quota`: the seats of each row of `votes` among the rows of its group.

    `seats` is a column constant in a group. With n rows in the group, every row
    gets its share of seats, rounded, give or take share * 1.5 n / seats + 1: so
    the seats below that range are given at once, and only the quotients inside
    it, about 5 n in all, are put in order. Ties go to the lower key. Without a group
    all rows are one, put in order in parallel by way of a table called `name`; a
    group's rows are put in order in one task.
    """
    share = F.when(F.col("votes") > 0, F.col(vote) / F.col("votes")).otherwise(F.lit(0.0))
    slack = F.ceil(share * F.col("n_rows") * 1.5) + 2
    near = F.round(share * F.col(seats)).cast("long")
    based = lambda df: df.withColumn("base", F.greatest(F.lit(0).cast("long"), near - slack.cast("long"))).withColumn("top", near + slack.cast("long"))
    if group:
        whole = Window.partitionBy(*group)
        start = based(votes.withColumn("votes", F.sum(vote).over(whole)).withColumn("n_rows", F.count("*").over(whole)))
        start = start.withColumn("open", F.col(seats) - F.sum("base").over(whole))
    else:
        start = based(votes.join(F.broadcast(votes.agg(F.sum(vote).alias("votes"), F.count("*").alias("n_rows")))))
        start = start.join(F.broadcast(start.agg(F.sum("base").alias("bases")))).withColumn("open", F.col(seats) - F.col("bases"))
    quotients = start.withColumn("seat", F.explode(F.sequence("base", F.col("top")))).filter(F.col(vote) > 0)
    order = [(F.col(vote) / (2 * F.col("seat") + 1)).desc(), *[F.col(k) for k in key], F.col("seat")]
    if group:
        placed = quotients.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    else:
        few = quotients.select(*key, vote, "seat", "open")
        placed = running(few, order, {"place": F.lit(1)}, name or "quotients").withColumn("place", F.col("place") + 1)
    won = placed.groupBy(*group, *key).agg(F.sum(F.when(F.col("place") <= F.col("open"), 1).otherwise(0)).alias("won"))
    on = F.lit(True)
    for c in [*group, *key]:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return (
        start.alias("a")
        .join(won.alias("b"), on, "left")
        .select(*[f"a.{c}" for c in votes.columns], (F.col("a.base") + F.coalesce("b.won", F.lit(0))).alias("quota"))
    )


#: Low bits of a block's key: its number, so that keys never tie. A text has fewer blocks.
NUMBER_BITS = 26


def block_key(seed: int, source_rank: Column, shard: Column, block: Column) -> Column:
    """Place of a block in the seeded order of its shard's blocks: the high bits of a hash, then the number."""
    hashed = F.xxhash64(F.lit(seed), source_rank.cast("long"), shard.cast("long"), block.cast("long"))
    return F.shiftleft(F.shiftright(hashed, NUMBER_BITS), NUMBER_BITS) + block


#: Above the key of every block.
LAST = 2**63 - 1
#: Sources with fewer blocks have one block of their own target's size, for a rounded quota would be far from it.
LEAST_BLOCKS = 8
#: Shards of a group, and groups of a source at most.
FAN = 1024


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_words: int = 50_000,
    seed: int = 17,
) -> DataFrame:
    """Words that the mix takes of each document.

    Columns: doc_id, source, size, source_size, target, taken, shard, passes
    (whole repeats), part (words of the last, partial pass) and order_hash (of id
    and text). Sources go by code point, null last, with `weights` repeated along them.

    Shards have about `shard_words` words, more where a source would have over FAN**2
    shards. A source shares its blocks among groups of FAN shards, and a group among
    its shards, so no window sees more than a few thousand rows; windows over sources
    run in parallel. Documents only meet inside their shard. A source whose target
    is less than LEAST_BLOCKS blocks has one block of its target's words.
    Null text: size 0, nothing taken. Documents of size 0 take 0. Rows that share
    an id are separate. Only id, text and source are read. Empty table: no rows.
    """
    with scratch(docs.sparkSession) as keep:
        return _mixed(docs, id_col, text_col, source_col, weights, share, most, block_words, shard_words, seed, keep)


def _mixed(docs, id_col, text_col, source_col, weights, share, most, block_words, shard_words, seed, keep) -> DataFrame:
    sized = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            words(F.col(text_col)).alias("size"),
            order_hash(F.col(id_col), F.col(text_col), seed).alias("order_hash"),
        ),
        "mix-sizes",
    )
    zero = F.lit(0).cast("long")
    by_code_point = [F.col("source").isNull(), F.col("source")]
    sources = running(sized.groupBy("source").agg(F.sum("size").alias("source_size")), by_code_point, {"source_rank": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    vote = F.when(F.col("target") >= LEAST_BLOCKS * block_words, F.col("target")).otherwise(0.0)
    targets = staged(capped_targets(sources.withColumn("weight", weight), share, most).withColumn("vote", vote), "mix-targets")
    blocks = targets.agg(F.round(F.sum("vote") / block_words).cast("long").alias("blocks"))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") / shard_words), F.lit(FAN * FAN))).cast("long")
    quotas = sainte_lague(targets.join(F.broadcast(blocks)).withColumn("shards", shards), "blocks", [], ["source_rank"], name="mix-quotients")
    own_size = F.when(F.col("quota") > 0, F.lit(block_words)).otherwise(F.round("target")).cast("long")
    quotas = keep(
        quotas.select(
            "source", "source_rank", "source_size", "target", "shards", own_size.alias("block"),
            F.when(F.col("quota") > 0, F.col("quota")).otherwise((own_size > 0).cast("long")).alias("source_quota"),
        ),
        "mix-quotas",
    )

    dealt = sized.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select(
        "d.*", "q.source_rank", "q.source_size", "q.target", "q.source_quota", "q.block",
        F.pmod(F.col("d.order_hash"), F.col("q.shards")).alias("shard"),
    )
    filled = staged(
        dealt.groupBy("source_rank", "source_quota", "block", "shard").agg(F.sum("size").alias("shard_size")).withColumn("group", F.expr(f"shard div {FAN}")), "mix-filled"
    )
    groups = filled.groupBy("source_rank", "source_quota", "group").agg(F.sum("shard_size").alias("group_size"))
    group_quotas = sainte_lague(groups, "source_quota", ["source_rank"], ["group"], "group_size").select("source_rank", "group", F.col("quota").alias("group_quota"))
    in_group = filled.join(group_quotas, ["source_rank", "group"])
    numbers = F.sequence(zero, F.col("n_blocks") - 1)
    keys = F.sort_array(F.transform(numbers, lambda b: block_key(seed, F.col("source_rank"), F.col("shard"), b)))
    shard_quotas = keep(
        sainte_lague(in_group, "group_quota", ["source_rank", "group"], ["shard"], "shard_size")
        .withColumn("want", F.least(F.col("quota") * F.col("block"), (F.col("shard_size") * most).cast("long")))
        .withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("want div shard_size")).otherwise(zero))
        .withColumn("rest", F.col("want") - F.col("passes") * F.col("shard_size"))
        .withColumn("n_blocks", F.when(F.col("block") > 0, F.expr("shard_size div block")).otherwise(zero))
        .withColumn("whole", F.when(F.col("block") > 0, F.expr("rest div block")).otherwise(zero))
        # The key of the block that is taken in part: those below it are taken whole.
        .withColumn("bar", F.when(F.col("whole") < F.col("n_blocks"), F.element_at(keys, (F.col("whole") + 1).cast("int"))).otherwise(F.lit(LAST)))
        .select("source_rank", "shard", "shard_size", "passes", "rest", "n_blocks", "whole", "bar"),
        "mix-shards",
    )

    line = Window.partitionBy("source_rank", "shard").orderBy("order_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("from", F.coalesce(F.sum("size").over(line), zero))
        .join(shard_quotas, ["source_rank", "shard"])
        .withColumn("to", F.col("from") + F.col("size"))
    )
    # What is left of the line after whole blocks stands last.
    key = lambda b: F.when(b < F.col("n_blocks"), block_key(seed, F.col("source_rank"), F.col("shard"), b)).otherwise(F.lit(LAST))
    length = lambda b: F.least((b + 1) * F.col("block"), F.col("to"), "shard_size") - F.greatest(b * F.col("block"), "from")
    head = lambda b: F.greatest(zero, F.least(b * F.col("block") + F.col("rest") - F.col("whole") * F.col("block"), F.col("to")) - F.greatest(b * F.col("block"), "from"))
    own = F.sequence(F.expr("`from` div block"), F.expr("(`to` - 1) div block"))
    worth = lambda b: F.when(key(b) < F.col("bar"), length(b)).when(key(b) == F.col("bar"), F.least(length(b), head(b))).otherwise(zero)
    part = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(own, zero, lambda total, b: total + worth(b))).otherwise(zero)
    return placed.withColumn("part", part).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        "shard", F.col("passes").cast("long").alias("passes"), "part", "order_hash",
    )
