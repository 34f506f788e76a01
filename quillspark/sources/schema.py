"""Explicit schemas of the entity tables and their constraints as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import validate

# --- fixed values: column lists and enumerations ---

SCHEMAS = {
    "authors": "id string NOT NULL, name string NOT NULL, cohort int, student_type string, hall string, class_name string, admission_score string, final_university string, ai_evaluation_grade string, manual_rating string, memo string, created_at string, updated_at string, phone string, sex string, birthdate string, korean_subject string, math_subject string, sci1_subject string, sci2_subject string, scholarship_amount bigint NOT NULL",
    "submissions": "id string NOT NULL, author_id string NOT NULL, source_type string, raw_text string, original_file_name string, status string, submitted_at string, created_at string, updated_at string, file_url string",
    "questions": "id string NOT NULL, cohort int NOT NULL, question_key string, question_text string NOT NULL, category string, sort_order int, is_active int, created_at string, updated_at string",
    "qna": "id string NOT NULL, author_id string NOT NULL, submission_id string, question_id string NOT NULL, answer_text string, created_at string, updated_at string",
    "evaluations": "id string NOT NULL, author_id string NOT NULL, submission_id string, evaluator_type string, total_score int, specificity_score int, authenticity_score int, narrative_score int, usefulness_score int, ai_suspicion_level string, ai_suspicion_reason string, evaluation_summary string, evidence string, created_at string",
    "articles": "id string NOT NULL, author_id string NOT NULL, submission_id string, title string, draft_content string, edited_content string, final_content string, article_status string, editor_name string, editor_note string, created_at string, updated_at string, published_at string",
    "activity_logs": "id string NOT NULL, entity_type string, entity_id string, action string NOT NULL, description string, actor string, created_at string",
    "projects": "id string NOT NULL, name string NOT NULL, year int, status string, created_by string, created_at string, updated_at string",
    "issues": "id string NOT NULL, project_id string NOT NULL, issue_number int, issue_label string, status string, created_at string, updated_at string",
    "toc_items": "id string NOT NULL, issue_id string NOT NULL, toc_order int, toc_number string, toc_title string, toc_content string, status string, created_at string, updated_at string",
    "selections": "id string NOT NULL, toc_id string NOT NULL, author_id string NOT NULL, submission_id string, evaluation_id string, selected_by_ai int, selected_by_user int, selection_reason string, created_at string, updated_at string",
}
STUDENT_TYPES = ("성적우수", "성적향상", "포레스트", "우선선발")
SEXES = ("남", "여")
SUBMISSION_STATES = ("received", "reviewing", "selected", "rejected", "archived")
ARTICLE_STATES = ("draft", "editing", "review", "final", "published", "archived")
SUSPICIONS = ("low", "medium", "high")
DEFAULTS = {
    "authors": {"scholarship_amount": 0},
    "submissions": {"source_type": "form", "status": "received"},
    "questions": {"sort_order": 0, "is_active": 1},
    "evaluations": {"evaluator_type": "ai"},
    "articles": {"article_status": "draft"},
    "activity_logs": {"actor": "system"},
}
#: child table, child column, parent table, action on deletion
FOREIGN_KEYS = (
    ("submissions", "author_id", "authors", "cascade"),
    ("qna", "author_id", "authors", "cascade"),
    ("qna", "submission_id", "submissions", "set null"),
    ("qna", "question_id", "questions", "restrict"),
    ("evaluations", "author_id", "authors", "cascade"),
    ("articles", "author_id", "authors", "cascade"),
    ("issues", "project_id", "projects", "cascade"),
    ("toc_items", "issue_id", "issues", "cascade"),
    ("selections", "toc_id", "toc_items", "cascade"),
)
UNIQUE = {**{t: ["id"] for t in SCHEMAS}, "selections": ["toc_id", "author_id"]}


def rules(table: str) -> dict[str, Column]:
    """Check constraints of a table; a null passes."""
    c = F.col
    return {
        "authors": {"cohort": c("cohort") >= 5, "student_type": c("student_type").isin(*STUDENT_TYPES), "sex": c("sex").isin(*SEXES)},
        "submissions": {"status": c("status").isin(*SUBMISSION_STATES)},
        "questions": {"cohort": c("cohort") >= 5, "is_active": c("is_active").isin(0, 1)},
        "evaluations": {
            "total_score": c("total_score").between(0, 100),
            **{s: c(s).between(0, 10) for s in ("specificity_score", "authenticity_score", "narrative_score", "usefulness_score")},
            "ai_suspicion_level": c("ai_suspicion_level").isin(*SUSPICIONS),
        },
        "articles": {"article_status": c("article_status").isin(*ARTICLE_STATES)},
        "selections": {"selected_by_ai": c("selected_by_ai").isin(0, 1), "selected_by_user": c("selected_by_user").isin(0, 1)},
    }.get(table, {})


def typed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, cast, with defaults for missing and null values; missing columns without one are null."""
    fields = {x.split()[0]: x.split()[1] for x in SCHEMAS[table].split(", ")}
    columns = []
    for name, kind in fields.items():
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        default = DEFAULTS.get(table, {}).get(name)
        columns.append((F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value).alias(name))
    return df.select(*columns)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, n of everything that breaks a constraint: checks, null keys, repeated keys and orphans."""
    out = None
    for name, df in tables.items():
        required = {f"{x.split()[0]} not null": F.col(x.split()[0]).isNotNull() for x in SCHEMAS[name].split(", ") if x.endswith("NOT NULL")}
        found = validate.violations(df, {**rules(name), **required})
        repeated = validate.duplicates(df, UNIQUE[name]).agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
        found = found.unionByName(repeated)
        for child, column, parent, _ in FOREIGN_KEYS:
            if child == name and parent in tables:
                lost = validate.orphans(df, tables[parent], column, "id").agg(F.count("*").alias("n"))
                found = found.unionByName(lost.select(F.lit(f"{column} in {parent}").alias("rule"), "n"))
        found = found.select(F.lit(name).alias("table"), "rule", "n")
        out = found if out is None else out.unionByName(found)
    return out.filter("n > 0")
