"""Wide form sheets: headers, column profiles and unpivoting.

A grid is a DataFrame of strings `_c0`, `_c1`, …; only its first two rows come to
the driver, to find the header and to build the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import blank_to_null, cohort_number, digits, joined, normal_name, question_key, score_field
from quillspark.operators.match import by_name_and_phone

URL = r"^https?://\S+"


def find_column(headers: list[str], needles: list[str], exact: bool = False, optional: bool = False) -> int | None:
    """Position of the leftmost header that holds (or is) any needle; the order of needles does not matter."""
    for at, cell in enumerate(headers):
        if any(cell == n if exact else n in cell for n in needles):
            return at
    if optional:
        return None
    raise KeyError(f"no column for {needles}")


def header_row(head: list[list[str]], required: list[str]) -> int:
    """0 or 1: the first of the two top rows that holds every required text in some cell."""
    for at, row in enumerate(head[:2]):
        if all(any(r in (cell or "") for cell in row) for r in required):
            return at
    raise KeyError(f"no header with {required}")


#: Header texts of the columns of a form sheet; those in the second table have to be the whole header.
HEADERS = {"name": ("이름",), "phone": ("전화번호",), "score": ("수기평1", "수기평"), "reviewer": ("평가자1", "평가자"), "note": ("비고1", "비고"), "cohort": ("재원 기수", "기수")}
EXACT_HEADERS = {"hall": ("관",), "class": ("반",)}
REQUIRED = ("이름", "관", "반")


def loaded(grid: DataFrame, people: DataFrame, cohort: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, answers, reviews) of a wide sheet: a grid of strings with their number in `_row`, and people (person_id, name, phone) to match.

    The header is in one of the two top rows, which come to the driver; everything below
    is one plan. Rows without a name are skipped. A row's person follows from name and
    phone; answers are the non-blank cells below headers that begin with [n-m], and reviews
    are the scores `n/comment` with reviewer and note. Columns that are optional and missing are null.
    """
    cells = [c for c in grid.columns if c != "_row"]
    head = [[r[c] for c in cells] for r in grid.filter("_row <= 1").orderBy("_row").collect()]
    at = header_row(head, list(REQUIRED))
    headers = [(x or "").replace("\n", " ").strip() for x in head[at]]
    where = {k: find_column(headers, list(v), optional=k != "name") for k, v in HEADERS.items()}
    where |= {k: find_column(headers, list(v), exact=True) for k, v in EXACT_HEADERS.items()}
    questions = {c: headers[i] for i, c in enumerate(cells) if headers[i].startswith("[")}
    cell = {k: F.trim(F.col(cells[i])) if i is not None else F.lit(None).cast("string") for k, i in where.items()}
    data = grid.filter(F.col("_row") > at).select(
        F.col("_row").alias("row_id"), normal_name(cell["name"]).alias("name"), digits(cell["phone"]).alias("phone"),
        cohort_number(cell["cohort"], F.lit(cohort)).alias("cohort"), *[cell[k].alias(k) for k in ("hall", "class", "score", "reviewer", "note")], *questions,
    )
    data = data.filter(F.coalesce("name", F.lit("")) != "")
    matched = by_name_and_phone(data.select("row_id", "name", "phone"), people).select("row_id", "person_id", "how")
    rows = data.drop("score", "reviewer", "note", *questions).join(matched, "row_id")
    named = data.select("row_id", *[F.col(c).alias(h) for c, h in questions.items()])
    long = answers(named, ["row_id"], list(questions.values())).select("row_id", question_key(F.col("question")).alias("question_key"), F.trim("answer").alias("answer"))
    scored = score_field(F.col("score"))
    slot = (F.col("reviewer"), scored["score"], joined(" / ", scored["comment"], F.col("note")))
    return rows, long.filter("question_key IS NOT NULL"), reviews(data, ["row_id"], [slot])


def share_matching(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """column, n, share: how many cells are not blank, and what share of these matches. One pass for all columns."""
    text = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    sums = df.agg(*[F.struct(F.count(text(c)).alias("n"), F.avg(text(c).rlike(pattern).cast("double")).alias("share")).alias(c) for c in columns])
    return sums.unpivot([], columns, "column", "s").select("column", "s.n", "s.share")


def wanted(rows: DataFrame, column: str, require: str | None = None, exclude: str | None = None, any_of: list[str] | None = None) -> DataFrame:
    """Rows whose `column` holds `require` and not `exclude`, and of which a column of `any_of` is not blank."""
    if require:
        rows = rows.filter(F.contains(F.coalesce(column, F.lit("")), F.lit(require)))
    if exclude:
        rows = rows.filter(~F.contains(F.coalesce(column, F.lit("")), F.lit(exclude)))
    if any_of:
        rows = rows.filter(F.coalesce(*[blank_to_null(F.col(c)) for c in any_of]).isNotNull())
    return rows


def answers(df: DataFrame, ids: list[str], questions: list[str]) -> DataFrame:
    """ids, question, answer: one row per non-blank cell of the question columns."""
    long = df.select(*ids, *[F.col(q).cast("string").alias(q) for q in questions]).unpivot(ids, questions, "question", "answer")
    return long.filter(F.trim("answer") != "")


def reviews(df: DataFrame, ids: list[str], slots: list[tuple[Column, Column, Column]]) -> DataFrame:
    """ids, slot, reviewer, score, note: reviewer triples as rows; a triple with no score, reviewer or note is dropped."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("slot"), r.alias("reviewer"), s.alias("score"), n.alias("note")) for i, (r, s, n) in enumerate(slots)])
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return df.select(*ids, F.inline(rows)).filter(~(F.col("score").isNull() & blank("reviewer") & blank("note")))
