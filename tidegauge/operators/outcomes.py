"""Outcomes: unresolved ones stay missing, cash ones are an explicit zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.returns import finite

# Actions that mean cash, texts of truth values, names of counts and error codes.
CASH = ("ABSTAIN", "CASH", "NO_ACTION")
TRUE, FALSE = ("1", "true", "yes"), ("0", "false", "no")


def resolution(c: Column) -> tuple[Column, Column]:
    """(resolved, valid) of a truth value or its text; anything else is invalid and unresolved."""
    text = F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return text.isin(*TRUE), text.isin(*TRUE, *FALSE)


def audit_outcomes(df: DataFrame, value: str = "net_return", resolved: str = "resolved", action: str = "action", keys: tuple[str, ...] = (), cash: tuple[str, ...] = CASH, tolerance: float = 1e-15) -> DataFrame:
    """Counts and errors of the whole table, or of each group of ``keys``; missing
    columns are reported, not raised."""
    missing = [c for c in (value, resolved, action) if c not in df.columns]
    if missing:
        return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.lit(False).alias("pass")).withColumns({"missing_columns": F.array(*map(F.lit, missing)), "errors": F.array(F.lit("missing_required_columns"))})
    done, valid = resolution(F.col(resolved))
    number = F.col(value).try_cast("double") if df.schema[value].dataType.simpleString() == "string" else F.col(value).cast("double")
    flagged = df.select(*keys, done.alias("done"), valid.alias("valid"), F.coalesce(F.upper(F.trim(F.col(action).cast("string"))), F.lit("")).isin(*[c.strip().upper() for c in cash]).alias("cash"), finite(number).alias("finite"), F.coalesce(finite(number) & (F.abs(number) > tolerance), F.lit(False)).alias("nonzero"))
    checks = {  # fixed values: count, error code and rule
        "invalid_resolution": ("invalid_resolution_value", "not valid"),
        "resolved_cash_nonfinite": ("resolved_cash_return_must_be_explicit_zero", "done and cash and not finite"),
        "resolved_cash_nonzero": ("resolved_cash_return_must_equal_zero", "done and cash and nonzero"),
        "resolved_position_nonfinite": ("resolved_position_return_must_be_finite", "done and not cash and not finite"),
        "unresolved_finite": ("unresolved_outcome_return_must_remain_missing", "not done and finite"),
    }
    counts = {"resolved_rows": "done", "unresolved_rows": "not done", "resolved_cash_rows": "done and cash"} | {f"{k}_count": c for k, (_, c) in checks.items()}
    found = flagged.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(F.expr(c)).alias(k) for k, c in counts.items()])
    errors = F.array_compact(F.array(*[F.when(F.col(f"{k}_count") > 0, code) for k, (code, _) in checks.items()]))
    return found.withColumn("errors", errors).withColumn("pass", F.size("errors") == 0)


def assert_outcomes(df: DataFrame, **how) -> DataFrame:
    if bad := audit_outcomes(df, **how).where("not pass").limit(1).collect():
        raise ValueError(f"outcomes break their rules: {bad[0].errors}")
    return df
