"""Matching records to people, with explicit ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import stable_id


def by_name_and_phone(rows: DataFrame, people: DataFrame) -> DataFrame:
    """rows (row_id, name, phone) + person_id, how ('phone', 'name', 'new', 'ambiguous').

    Name and phone together decide first (the last person by id of equal keys);
    else a name that one person alone has. Names of several people are not guessed.
    """
    exact = people.filter(F.coalesce("phone", F.lit("")) != "").groupBy("name", "phone").agg(F.max("person_id").alias("by_phone"))
    named = people.groupBy("name").agg(F.count("*").alias("candidates"), F.min("person_id").alias("by_name"))
    both = rows.join(exact, ["name", "phone"], "left").join(named, "name", "left")
    how = F.when(F.col("by_phone").isNotNull(), "phone").when(F.col("candidates") == 1, "name").when(F.col("candidates") > 1, "ambiguous").otherwise("new")
    person = F.coalesce("by_phone", F.when(F.col("candidates") == 1, F.col("by_name")))
    return both.select(*rows.columns, person.alias("person_id"), how.alias("how"))


def narrowed(rows: DataFrame, people: DataFrame, narrow: Column, own: list[str], theirs: list[str]) -> DataFrame:
    """row_id, person_id, how: by name; among several people, the one alone for whom `narrow` holds.

    `rows` has row_id, name and the columns `own`; `people` has person_id, name and the
    columns `theirs`; `narrow` compares the two. Names of one person are settled by
    a count. For the others only the distinct values of a name meet, with counts of
    the people behind them, so a name that very many rows and people share costs its
    values, not its pairs.
    """
    named = people.groupBy("name").agg(F.count("*").alias("n"), F.min("person_id").alias("any_one"))
    first = rows.join(named, "name", "left")
    values = people.groupBy("name", *theirs).agg(F.count("*").alias("_people"), F.min("person_id").alias("_least"))
    asked = first.filter("n > 1").select("name", *own).distinct()
    fitting = asked.join(values, "name").filter(F.coalesce(narrow, F.lit(False))).groupBy("name", *own).agg(F.sum("_people").alias("fits"), F.min("_least").alias("fitting"))
    same = F.col("a.name") == F.col("b.name")
    for c in own:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    n = F.coalesce("n", F.lit(0))
    how = F.when(n == 0, "unmatched").when(n == 1, "matched").when(F.col("fits") == 1, "narrowed").otherwise("ambiguous")
    person = F.when(n == 1, F.col("any_one")).when((n > 1) & (F.col("fits") == 1), F.col("fitting"))
    return first.alias("a").join(fitting.alias("b"), same, "left").select("row_id", person.alias("person_id"), how.alias("how"))


def grams(value: Column, most: int) -> Column:
    """The distinct substrings of 1 to `most` characters."""
    starts = F.sequence(F.lit(1), F.length(value))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(value) - i + 1)), lambda n: F.substring(value, i, n))))
    return F.when(F.length(value) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def narrowed_by_prefix(rows: DataFrame, people: DataFrame, own: str, theirs: str, width: int = 4) -> DataFrame:
    """row_id, person_id, how as from `narrowed`: among people of one name the one alone whose value holds the first `width` characters of the row's value, or the other way round.

    `rows` has row_id, name and `own`; `people` has person_id, name and `theirs`; empty and null values fit nobody.
    An index of substrings turns containment into equal keys, and no pair of a row and a person is made: people are counted
    per (name, substring) and per (name, prefix), the people that fit in both ways per both, and a row
    looks up its counts. Those are A + B - (A and B); a single person that fits is the least of A and B.
    """
    named = people.groupBy("name").agg(F.count("*").alias("n"), F.min("person_id").alias("any_one"))
    first = rows.join(named, "name", "left")
    head = lambda c: F.substring(c, 1, width)
    count = [F.sum("_people").alias("k"), F.min("_least").alias("least")]
    values = people.filter(F.col(theirs) != "").groupBy("name", F.col(theirs).alias("v")).agg(F.count("*").alias("_people"), F.min("person_id").alias("_least"))
    # A name that many people share has many substrings; each is a key of its own.
    holding = values.select("name", head(F.col("v")).alias("prefix"), F.explode(grams(F.col("v"), width)).alias("gram"), "_people", "_least")
    both = holding.groupBy("name", "gram", "prefix").agg(*count)
    by_gram = both.groupBy("name", "gram").agg(F.sum("k").alias("k"), F.min("least").alias("least"))
    by_prefix = values.groupBy("name", head(F.col("v")).alias("prefix")).agg(*count)
    asked = first.filter((F.col("n") > 1) & (F.col(own) != "")).select("name", F.col(own).alias("u")).distinct()
    a = asked.select("name", "u", head(F.col("u")).alias("gram")).join(by_gram, ["name", "gram"]).select("name", "u", "k", "least")
    parts = asked.select("name", "u", head(F.col("u")).alias("gram"), F.explode(grams(F.col("u"), width)).alias("prefix"))
    b = parts.join(by_prefix, ["name", "prefix"]).select("name", "u", "k", "least")
    twice = parts.join(both, ["name", "gram", "prefix"]).select("name", "u", (-F.col("k")).alias("k"), F.lit(None).cast(b.schema["least"].dataType).alias("least"))
    fitting = a.unionByName(b).unionByName(twice).groupBy("name", "u").agg(F.sum("k").alias("fits"), F.min("least").alias("fitting")).withColumnRenamed("name", "_name")
    found = first.join(fitting, (F.col("name") == F.col("_name")) & (F.col(own) == F.col("u")), "left")
    n = F.coalesce("n", F.lit(0))
    alone = (n > 1) & (F.col("fits") == 1)
    how = F.when(n == 0, "unmatched").when(n == 1, "matched").when(alone, "narrowed").otherwise("ambiguous")
    return found.select("row_id", F.when(n == 1, F.col("any_one")).when(alone, F.col("fitting")).alias("person_id"), how.alias("how"))


def by_cohort(rows: DataFrame, people: DataFrame, closed: int = 5) -> DataFrame:
    """row_id, person_id, how of rows (row_id, cohort, name) by the people of their cohort.

    One person of the name is matched, several are ambiguous; without one the row is new, but unmatched in the
    `closed` cohort, whose people are all known.
    """
    named = people.groupBy("cohort", "name").agg(F.count("*").alias("n"), F.min("person_id").alias("one"))
    both = rows.join(named, ["cohort", "name"], "left")
    how = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").when(F.col("cohort") == closed, "unmatched").otherwise("new")
    return both.select("row_id", F.when(F.col("n") == 1, F.col("one")).alias("person_id"), how.alias("how"))


def by_text(rows: DataFrame, questions: DataFrame, prefix: str = "question") -> DataFrame:
    """rows (cohort, text, …) + question_id, known: the question of the cohort with the very same text (the last by id), else a new id.

    Keys repeat, so the whole text decides; the new id follows from cohort and text, so rows of one new question share it.
    """
    known = questions.groupBy("cohort", "text").agg(F.max("question_id").alias("_found"))
    both = rows.join(known, ["cohort", "text"], "left")
    return both.select(*rows.columns, F.coalesce("_found", stable_id(prefix, F.col("cohort"), F.col("text"))).alias("question_id"), F.col("_found").isNotNull().alias("known"))


def fees(best: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, amount: fees by (cohort, name); among several people the unique one with the fee's phone, else all of them."""
    fee = best.select("cohort", "name", F.col("phone").alias("_phone"), "amount")
    same = (F.coalesce("_phone", F.lit("")) != "") & (F.col("_phone") == F.col("phone"))
    pairs = fee.join(people, ["cohort", "name"]).withColumn("_same", F.coalesce(same, F.lit(False)))
    counted = pairs.groupBy("cohort", "name").agg(F.count("*").alias("_n"), F.sum(F.col("_same").cast("int")).alias("_hits"))
    return pairs.join(counted, ["cohort", "name"]).filter((F.col("_n") == 1) | (F.col("_hits") != 1) | F.col("_same")).select("person_id", "amount")


def fees_applied(people: DataFrame, found: DataFrame) -> DataFrame:
    """`people` (person_id, fee, …) with the amounts of `found` (person_id, amount) as fees; who has none there keeps the old fee.

    A null amount changes nothing; of several amounts of a person the largest counts. Amounts of unknown people go nowhere.
    """
    new = found.groupBy(F.col("person_id").alias("_person")).agg(F.max("amount").alias("_new"))
    fee = F.coalesce("_new", "fee").alias("fee")
    return people.join(new, F.col("person_id") == F.col("_person"), "left").select(*[fee if c == "fee" else F.col(c) for c in people.columns])
