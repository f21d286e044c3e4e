"""Contract checks as rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import is_blank
from tessitura.operators.profile import NOT_SPACE


def pick_template(submission: DataFrame, templates: DataFrame, key: str = "ID") -> DataFrame:
    """The template (`template, ID`) sharing most ids with a file; ties and no match give the first, noted."""
    ids = submission.select(key).distinct().withColumn("_hit", F.col(key))
    counts = templates.join(ids, key, "left").groupBy("template").agg(
        F.count("*").alias("expected"), F.count("_hit").alias("overlap")
    )
    best = counts.orderBy(F.desc("overlap"), "template").limit(1)
    return best.withColumn("note", F.when(F.col("overlap") == 0, "ids match no template").otherwise("ok"))


def _text_facts(rows: DataFrame, text: str, side: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.regexp_count(t, F.lit(NOT_SPACE + "+"))
    letters = lambda p: F.sum(F.length(F.regexp_replace(t, f"[^{p}]+", ""))).cast("double")
    facts = {
        "rows": F.count("*"),
        "nulls": F.count_if(F.col(text).isNull()),
        "blanks": F.count_if(is_blank(t)),
        "max_words": F.max(w),
        "mean_words": F.avg(w),
        "bracketed": F.count_if(t.rlike(r"[\[\]<>]")),
        "commas": F.count_if(F.contains(t, F.lit(","))),
        "upper": letters(r"\p{Lu}") / F.greatest(F.lit(1.0), letters(r"\p{L}")),
    }
    one = rows.agg(*[c.cast("double").alias(k) for k, c in facts.items()])
    pairs = F.array(*[F.struct(F.lit(f"{side}_{k}").alias("fact"), F.col(k).alias("v")) for k in facts])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def _id_facts(submission: DataFrame, template: DataFrame, key: str, row_no: str) -> DataFrame:
    got = submission.groupBy(key).agg(F.count("*").alias("n"), F.min(row_no).alias("at"))
    want = template.select(key, F.col(row_no).alias("want_at"))
    joined = want.join(got, key, "full_outer")
    facts = {
        "missing": F.count_if(F.col("n").isNull()),
        "unexpected": F.count_if(F.col("want_at").isNull()),
        "duplicates": F.sum(F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0))),
        "moved": F.count_if(F.col("at") != F.col("want_at")),
        "expected": F.count("want_at"),
    }
    one = joined.agg(*[c.cast("double").alias(k) for k, c in facts.items()])
    pairs = F.array(*[F.struct(F.lit(f"id_{k}").alias("fact"), F.col(k).alias("v")) for k in facts])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def _unseen_chars(submission: DataFrame, refs: DataFrame, text: str, ref: str) -> DataFrame:
    chars = lambda df, c: df.select(F.explode(F.split(F.coalesce(F.col(c), F.lit("")), "")).alias("ch")).where("ch <> ''").distinct()
    unseen = chars(submission, text).join(chars(refs, ref), "ch", "left_anti")
    return unseen.agg(F.count("*").cast("double").alias("v")).select(F.lit("unseen_chars").alias("fact"), "v")


def validate_submission(
    submission: DataFrame, template: DataFrame, refs: DataFrame, key: str = "ID", text: str = "Target", ref: str = "ref", row_no: str = "row_no", columns: tuple[str, ...] | None = None
) -> DataFrame:
    """`rule, severity, value` for every broken rule of the file contract.

    Each side is read once; facts are gathered as rows and pivoted, and the rules
    are arithmetic on them. A file whose ids match none of the template's fails as such
    (`no_template`). Column names and order are checked where they are
    known, on the driver. Severity is FAIL or WARN.
    """
    facts = (
        _text_facts(submission, text, "sub")
        .unionByName(_text_facts(refs, ref, "ref"))
        .unionByName(_id_facts(submission, template, key, row_no))
        .unionByName(_unseen_chars(submission, refs, text, ref))
    )
    names = [f"sub_{k}" for k in ("rows", "nulls", "blanks", "max_words", "mean_words", "bracketed", "commas", "upper")]
    names += ["ref_mean_words", "ref_upper", "id_missing", "id_unexpected", "id_duplicates", "id_moved", "id_expected", "unseen_chars"]
    wide = facts.agg(*[F.max(F.when(F.col("fact") == n, F.col("v"))).alias(n) for n in names])
    f = {n: F.col(n) for n in names}
    no_set_error = (f["id_missing"] == 0) & (f["id_unexpected"] == 0)
    columns_ok = columns is None or list(columns) == [c for c in submission.columns if c != row_no]
    rules: list[tuple[str, str | Column, Column, Column]] = [
        ("columns", "FAIL", F.lit(0.0 if columns_ok else 1.0), F.lit(not columns_ok)),
        ("no_template", "FAIL", f["id_expected"], (f["id_expected"] > 0) & (f["id_missing"] == f["id_expected"])),
        ("row_count", "FAIL", f["sub_rows"] - f["id_expected"], f["sub_rows"] != f["id_expected"]),
        ("missing_ids", "FAIL", f["id_missing"], f["id_missing"] > 0),
        ("unexpected_ids", "FAIL", f["id_unexpected"], f["id_unexpected"] > 0),
        ("row_order", "WARN", f["id_moved"], no_set_error & (f["id_moved"] > 0)),
        ("duplicate_ids", "FAIL", f["id_duplicates"], f["id_duplicates"] > 0),
        ("nulls", "FAIL", f["sub_nulls"], f["sub_nulls"] > 0),
        ("blanks", F.when(100 * f["sub_blanks"] / f["sub_rows"] > 5, "FAIL").otherwise("WARN"), f["sub_blanks"], f["sub_blanks"] > 0),
        ("longest", "WARN", f["sub_max_words"], f["sub_max_words"] > 200),
        ("brackets", "WARN", f["sub_bracketed"], f["sub_bracketed"] > 0),
        ("commas", "WARN", f["sub_commas"], f["sub_commas"] > 0),
        ("upper_gap", "WARN", F.abs(f["sub_upper"] - f["ref_upper"]), F.abs(f["sub_upper"] - f["ref_upper"]) > 0.02),
        ("length_gap", "WARN", F.abs(f["sub_mean_words"] - f["ref_mean_words"]) / f["ref_mean_words"],
         F.abs(f["sub_mean_words"] - f["ref_mean_words"]) / f["ref_mean_words"] > 0.35),
        ("unseen_chars", "WARN", f["unseen_chars"], f["unseen_chars"] > 0),
    ]
    stacked = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), (F.lit(s) if isinstance(s, str) else s).alias("severity"), v.alias("value"), b.alias("broken"))
            for r, s, v, b in rules
        ]
    )
    return wide.select(F.explode(stacked).alias("x")).select("x.*").where("broken").drop("broken")


def expectations(facts: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """Check facts (`fact, v`) against rules `(name, fact, op, limit, severity)`: one row per rule.

    A fact that is absent breaks its rule.
    """
    ops = {">=": lambda v, x: v >= x, "<=": lambda v, x: v <= x, "==": lambda v, x: v == x, ">": lambda v, x: v > x, "<": lambda v, x: v < x}
    wide = facts.agg(*[F.max(F.when(F.col("fact") == n, F.col("v"))).alias(f"f{i}") for i, n in enumerate(r[1] for r in rules)])
    rows = []
    for i, (name, fact, op, limit, severity) in enumerate(rules):
        ok = F.coalesce(ops[op](F.col(f"f{i}"), F.lit(float(limit))), F.lit(False))
        rows.append(
            F.struct(
                F.lit(name).alias("rule"), F.lit(fact).alias("fact"), F.col(f"f{i}").cast("double").alias("value"),
                F.lit(float(limit)).alias("limit"), F.when(ok, "OK").otherwise(severity).alias("outcome"),
            )
        )
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def require(checked: DataFrame) -> None:
    """Stop on FAIL outcomes, naming every rule that broke; there is one row per rule."""
    broken = checked.where(F.col("outcome") == "FAIL").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['fact']}={r['value']} against {r['limit']}" for r in broken))
