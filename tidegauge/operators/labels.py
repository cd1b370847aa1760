"""Learning evidence: labels, fits, ledgers and the verdict on them, by scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.clocks import strict_clock
from tidegauge.operators.returns import finite

RESOLVED = ("RESOLVED_MARKET", "RESOLVED_CASH")
OPEN = ("UNRESOLVED", "RIGHT_CENSORED", "UNKNOWN_SOURCE", "UNKNOWN_EXECUTION")


def _number(c: str) -> Column:
    return F.trim(F.col(c).cast("string")).try_cast("double")


def _codes(**conditions: Column) -> Column:
    """The names of the conditions that hold for any row of a group."""
    return F.array_compact(F.array(*[F.when(F.count_if(c) > 0, name) for name, c in conditions.items()]))


def _counts_map(role: str, n: str) -> Column:
    return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(n) > 0, F.struct(F.coalesce(role, F.lit("")), n)))))


def audit_label_support(labels: DataFrame, cutoff: str, required_roles: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Which roles have labels that could be seen before the cutoff."""
    resolved, number = F.col("status").isin(*RESOLVED), _number("value")
    sound = resolved & finite(number)
    late = strict_clock("available_at") >= strict_clock(F.lit(cutoff))
    role = F.coalesce("training_role", F.lit(""))
    flagged = labels.select(*keys, role.alias("role"), F.coalesce(resolved, F.lit(False)).alias("resolved"), F.coalesce(sound, F.lit(False)).alias("sound"), finite(number).alias("finite"), ((F.col("status") == "RESOLVED_CASH") & (number != 0)).alias("cash"), F.coalesce(late, F.lit(False)).alias("late"), strict_clock("available_at").isNull().alias("no_clock"))
    by_role = flagged.groupBy(*keys, "role").agg(
        F.count_if(F.expr("sound and not late")).alias("n"), F.count_if(F.expr("not resolved")).alias("unresolved"), F.count_if(F.expr("sound and late")).alias("late"),
        _codes(unresolved_label_has_numeric_return=F.expr("not resolved and finite"), resolved_label_missing_or_nonfinite=F.expr("resolved and not sound"), resolved_cash_not_zero=F.expr("sound and cash"), invalid_label_clock=F.expr("sound and no_clock")).alias("codes"),
    )
    total = by_role.groupBy(*keys).agg(_counts_map("role", "n").alias("observable_labels_by_role"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.coalesce(F.sum("late"), F.lit(0)).alias("not_yet_mature"), F.flatten(F.collect_list("codes")).alias("codes"))
    needed = F.array(*map(F.lit, required_roles)).cast("array<string>")
    unmet = F.transform(F.filter(needed, lambda r: ~F.array_contains(F.map_keys("observable_labels_by_role"), r)), lambda r: F.concat(F.lit("no_observable_label_support_for_role:"), r))
    extra = F.array(*([] if required_roles else [F.lit("required_roles_not_declared")])).cast("array<string>")
    return total.withColumn("blockers", F.array_sort(F.array_distinct(F.concat("codes", unmet, extra)))).drop("codes").withColumn("support_available", F.size("blockers") == 0)


def audit_labels(labels: DataFrame, contract: DataFrame | None = None) -> DataFrame:
    """Counts and codes of each scenario's label table (scenario, label_id, ...).

    ``contract``: (scenario, minimum_resolved_labels, minimum_resolved_market_labels).
    """
    number, resolved, open_ = _number("value"), F.col("status").isin(*RESOLVED), F.col("status").isin(*OPEN)
    once = labels.withColumns({"number": number, "resolved": F.coalesce(resolved, F.lit(False)), "open": F.coalesce(open_, F.lit(False)), "clock": strict_clock("available_at")}).groupBy("scenario", "label_id").agg(
        F.count("*").alias("n"), F.count_if(F.expr("status = 'RESOLVED_MARKET'")).alias("market"), F.count_if(F.expr("status = 'RESOLVED_CASH'")).alias("cash"), F.count_if("open").alias("unresolved"),
        _codes(resolved_label_missing_or_nonfinite=F.col("resolved") & ~finite("number"), resolved_cash_not_zero=F.expr("status = 'RESOLVED_CASH' and number <> 0"), unresolved_label_has_numeric_return=F.col("open") & finite("number"), unknown_label_status=~F.col("resolved") & ~F.col("open"), invalid_label_clock=F.col("resolved") & F.col("clock").isNull()).alias("codes"),
    )
    bad_id = F.coalesce(F.col("label_id"), F.lit("")) == ""
    found = once.groupBy("scenario").agg(F.sum("market").alias("resolved_market"), F.sum("cash").alias("resolved_cash"), F.sum("unresolved").alias("unresolved"), F.array_union(F.array_distinct(F.flatten(F.collect_set("codes"))), _codes(duplicate_or_empty_label_id=bad_id | (F.col("n") > 1))).alias("codes"))
    if contract is not None:
        found = found.join(contract, "scenario", "left")
        few = F.when(F.expr("resolved_market + resolved_cash < minimum_resolved_labels"), "insufficient_resolved_replay_evidence")
        few_market = F.when(F.expr("resolved_market < minimum_resolved_market_labels"), "insufficient_resolved_market_evidence")
        found = found.withColumn("codes", F.concat("codes", F.array_compact(F.array(few, few_market))))
    return found.select("scenario", "resolved_market", "resolved_cash", "unresolved", F.array_sort("codes").alias("codes"))


def training_rows(fits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each label that a fit consumed, with its flags.

    ``fits``: (scenario, fit_id, decision_at, training_label_ids, ...).  Labels are
    first reduced to one row for each id, so a popular label costs one row; the
    join may be split by Spark where a label is consumed very often.
    """
    one = labels.groupBy("scenario", "label_id").agg(F.max_by(F.struct("status", "available_at", "training_role"), F.struct("available_at", "status")).alias("label"))
    used = fits.select("scenario", "fit_id", "decision_at", F.explode("training_label_ids").alias("label_id"))
    joined = used.join(one, ["scenario", "label_id"], "left")
    known = F.coalesce(F.col("label.status").isin(*RESOLVED), F.lit(False))
    return joined.select(
        "scenario", "fit_id", "label_id", known.alias("counted"), (~known).alias("unknown"),
        (known & F.coalesce(strict_clock("label.available_at") >= strict_clock("decision_at"), F.lit(True))).alias("unobservable"),
        (known & (F.coalesce("label.training_role", F.lit("")) == "")).alias("no_role"),
        (known & (F.col("label.status") == "RESOLVED_MARKET")).alias("market"), F.coalesce("label.training_role", F.lit("")).alias("role"),
    )


def audit_fits(fits: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows, leaks and codes of each scenario's fits."""
    ids = F.coalesce("training_label_ids", F.array().cast("array<string>"))
    shape = fits.groupBy("scenario", "fit_id").agg(F.count("*").alias("n"), F.count_if((F.size(ids) == 0) | (F.size(ids) != F.size(F.array_distinct(ids))) | ~F.coalesce(F.col("fitted_rows") == F.size(ids), F.lit(False))).alias("bad"))
    shapes = shape.groupBy("scenario").agg(F.sum("n").alias("fit_count"), _codes(duplicate_fit_id=F.col("n") > 1, invalid_actual_fit_rows=F.col("bad") > 0).alias("codes"))
    by_role = training_rows(fits, labels).groupBy("scenario", "role").agg(F.count_if("counted").alias("n"), F.count_if("market").alias("market"), F.count_if("unknown").alias("unknown"), F.count_if("unobservable").alias("unobservable"), F.count_if("no_role").alias("no_role"))
    rows = by_role.groupBy("scenario").agg(F.sum("n").alias("training_rows"), F.sum("market").alias("market_training_rows"), F.sum("unknown").alias("unknown_labels"), F.sum("unobservable").alias("unobservable_labels"), _counts_map("role", "n").alias("training_rows_by_role"), _codes(fit_consumed_unknown_label=F.col("unknown") > 0, fit_consumed_unobservable_label=F.col("unobservable") > 0, missing_training_role=F.col("no_role") > 0).alias("row_codes"))
    joined = shapes.join(rows, "scenario", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("training_rows", "market_training_rows", "unknown_labels", "unobservable_labels")}
    none = F.array().cast("array<string>")
    return joined.withColumns(zero).withColumn("codes", F.array_sort(F.concat("codes", F.coalesce("row_codes", none)))).drop("row_codes")


def compare_maturity(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Blockers of scenarios whose counts by window (scenario, window, count) are not
    those of their own reference."""
    a, b = (x.groupBy("scenario", "window").agg(F.max("count").alias(n)) for x, n in ((expected, "want"), (observed, "have")))
    joined = a.withColumn("w", F.lit(1)).join(b.withColumn("h", F.lit(1)), ["scenario", "window"], "full_outer")
    each = joined.groupBy("scenario").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.count_if(~F.col("want").eqNullSafe(F.col("have"))).alias("off"))
    codes = F.array_compact(F.array(F.when(F.col("w").isNull() | F.col("h").isNull(), "scenario_coverage_mismatch"), F.when(F.col("w").isNotNull() & (F.col("off") > 0), F.concat("scenario", F.lit(":maturity_reference_mismatch")))))
    return each.select(F.explode(codes).alias("blocker")).distinct()


def audit_ledger(account: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Clocks that do not rise in file order (seq), values not finite, and rows that do
    not balance, of each ledger."""
    clock = strict_clock(F.col("observed_at").cast("string"))
    money = {c: F.col(c).cast("string").try_cast("double") for c in ("cash", "position_value", "equity")}
    rows = account.select(*keys, "seq", clock.alias("clock"), *[v.alias(c) for c, v in money.items()])
    rows = rows.withColumn("before", F.lag("clock").over(Window.partitionBy(*keys).orderBy("seq"))).withColumn("sound", finite("cash") & finite("position_value") & finite("equity"))
    off = F.abs(F.col("cash") + F.col("position_value") - F.col("equity")) > F.greatest(F.lit(0.01), F.abs("equity") * 1e-9)
    return rows.groupBy(*keys).agg(F.count("*").alias("account_rows"), F.count_if(F.col("clock") <= F.col("before")).alias("clock_not_increasing"), F.count_if(~F.col("sound")).alias("nonfinite_values"), F.count_if(F.col("sound") & off).alias("balance_mismatches"), F.count_if(F.col("clock").isNull()).alias("invalid_clocks"))


def readiness(contract: DataFrame, labels: DataFrame, fits: DataFrame, account: DataFrame, observed_maturity: DataFrame, expected_maturity: DataFrame) -> DataFrame:
    """The verdict on each scenario of the contract: (scenario, mode,
    required_training_roles, minimum_resolved_labels, minimum_resolved_market_labels)."""
    none = F.array().cast("array<string>")
    ledger = audit_ledger(account).select("scenario", "account_rows", F.array_compact(F.array(F.when(F.col("clock_not_increasing") > 0, "account_clock_not_increasing"), F.when(F.col("nonfinite_values") > 0, "nonfinite_account_value"), F.when(F.col("balance_mismatches") > 0, "account_balance_mismatch"), F.when(F.col("invalid_clocks") > 0, "invalid_account_clock"))).alias("ledger_codes"))
    minimums = contract.select("scenario", "minimum_resolved_labels", "minimum_resolved_market_labels")
    joined = contract.select("scenario", "mode", "required_training_roles").join(audit_labels(labels, minimums).withColumnRenamed("codes", "label_codes"), "scenario", "left").join(audit_fits(fits, labels).withColumnRenamed("codes", "fit_codes"), "scenario", "left").join(ledger, "scenario", "left")
    fit = F.col("mode") == "fit"
    roles = F.coalesce("required_training_roles", none)
    unmet = F.transform(F.filter(roles, lambda r: ~F.coalesce(F.array_contains(F.map_keys("training_rows_by_role"), r), F.lit(False))), lambda r: F.concat(F.lit("no_training_support_for_role:"), r))
    idle = (F.coalesce("fit_count", F.lit(0)) == 0) | (F.coalesce("training_rows", F.lit(0)) == 0) | (F.coalesce("market_training_rows", F.lit(0)) == 0)
    own = F.array_compact(F.array(F.when(fit & idle, "no_effective_learning"), F.when(fit & (F.size(roles) == 0), "missing_required_training_roles"), F.when(F.coalesce("account_rows", F.lit(0)) == 0, "empty_account_evidence"), F.when(~F.col("mode").isin("fit", "replay"), "invalid_readiness_mode")))
    codes = F.concat(F.coalesce("label_codes", none), F.coalesce("fit_codes", none), F.coalesce("ledger_codes", none), own, F.when(fit, unmet).otherwise(none))
    prefixed = F.transform(codes, lambda c: F.concat("scenario", F.lit(":"), c))
    mature = compare_maturity(expected_maturity, observed_maturity).where("blocker like '%:maturity_reference_mismatch'").select(F.regexp_extract("blocker", "^(.*):", 1).alias("scenario"), F.array("blocker").alias("mature"))
    out = joined.withColumn("own", prefixed).join(mature, "scenario", "left").withColumn("blockers", F.array_sort(F.array_distinct(F.concat("own", F.coalesce("mature", none)))))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("resolved_market", "resolved_cash", "unresolved", "fit_count", "training_rows", "market_training_rows", "account_rows")]
    return out.select("scenario", *counts, "blockers", (F.size("blockers") == 0).alias("ready"))
