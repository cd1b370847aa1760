"""Queries over the driver's tables, each with the SQL that must agree with it.

Figures that depend on the order of additions are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.jobs import inputs
from tidegauge.jobs.validation import sequential_validation
from tidegauge.operators import asof, calendar, crosssec, events, inference, labels, multiplicity, outcomes, packs, retention, returns, serial, snapshots, units, windows
from tidegauge.functions.clocks import strict_date
from tidegauge.functions.symbols import is_symbol6, normalize_symbol
from tidegauge.sources.tables import fresh_folder, scan_statistics, selected, table

HORIZONS = (20, 60, 90)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Figures rounded, dates as texts."""
    plain = {"double": lambda c: F.round(c, digits), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[plain.get(kind, F.col)(c).alias(c) for c, kind in df.dtypes])


def _windows(spark, sf):
    return windows.overlapping_windows(inputs.returns(spark, sf), HORIZONS)


def _membership(spark, sf, operator):
    members, dates = inputs.membership(spark, sf)
    return operator(members, dates, inputs.decisions(spark, sf), 45)


def _symbols(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("12345"), k), F.concat(F.lit("-"), k), F.concat(k, F.lit(".0")), F.concat(F.lit("SZ"), k, F.lit(".x9")), F.lit("NaN"), F.concat(k, F.lit(".5")), F.col("p_name")]
    raw = p.select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("raw"))
    out = raw.select("p_partkey", normalize_symbol(raw, "raw").alias("symbol"))
    return out.withColumn("exact", is_symbol6("symbol"))


def _features(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.when(F.col("p_size") % 7 == 0, "Lead-").otherwise(""), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")))
    catalog = p.select(F.col("p_brand").alias("dataset"), name.alias("column"))
    found = crosssec.audit_features(catalog)
    lists = {c: F.array_join(c, ",") for c in ("forbidden_features", "duplicate_features", "allowed_features")}
    return found.withColumns(lists)


def _tests(spark, sf):
    rows = table(spark, sf, "lineitem")
    p = F.when(F.col("l_linenumber") < 7, (F.col("l_discount") * 100 + F.col("l_tax") * 1000 + 1) / (F.col("l_quantity") * 100))
    tests = rows.select("l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("day"), p.alias("p_value"))
    return multiplicity.benjamini_hochberg(tests, ("l_returnflag", "day")).select("l_orderkey", "l_linenumber", "q_value")


def _support(spark, sf):
    found = labels.audit_label_support(inputs.labels(spark, sf), "2024-01-15T12:00:00+00:00", ["action", "wait", "hold"], ("scenario",))
    role = lambda r: F.coalesce(F.try_element_at("observable_labels_by_role", F.lit(r)), F.lit(0)).alias(f"role_{r or 'none'}")
    return found.select("scenario", role("action"), role("wait"), role(""), "unresolved", "not_yet_mature", F.array_join("blockers", ",").alias("blockers"))


def _fits(spark, sf):
    found = labels.audit_fits(inputs.fits(spark, sf), inputs.labels(spark, sf))
    return found.select("scenario", "fit_count", "training_rows", "market_training_rows", "unknown_labels", "unobservable_labels", F.array_join("codes", ",").alias("codes"))


def _maturity(spark, sf):
    e = table(spark, sf, "events")
    counts = lambda df: df.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scenario"), F.col("event_type").alias("window")).agg(F.count("*").alias("count"))
    return labels.compare_maturity(counts(e), counts(e.where("event_id % 97 <> 0")))


def _readiness(spark, sf):
    l = inputs.labels(spark, sf)  # noqa: E741
    contract = l.select("scenario").distinct().select("scenario", F.when(F.col("scenario") == "s3", "replay").otherwise("fit").alias("mode"), F.array(F.lit("action"), F.lit("hold")).alias("required_training_roles"), F.lit(10).alias("minimum_resolved_labels"), F.lit(10**9).alias("minimum_resolved_market_labels"))
    ledger = inputs.ledger(spark, sf).withColumn("scenario", F.concat(F.lit("s"), (F.substring("scenario", 2, 20).cast("long") % 2).cast("string")))
    counts = l.groupBy("scenario", F.col("status").alias("window")).agg(F.count("*").alias("count"))
    found = labels.readiness(contract, l, inputs.fits(spark, sf), ledger, counts, counts)
    return found.select("scenario", "resolved_market", "training_rows", "account_rows", "ready", F.array_join("blockers", ",").alias("blockers"))


def _hac(spark, sf):
    found = inference.newey_west(inputs.values(spark, sf), overlap_horizon=12)
    lags = {"first_autocorrelation": F.get("lag_autocorrelations", F.lit(0)), "sum_of_autocorrelations": F.aggregate("lag_autocorrelations", F.lit(0.0), lambda a, x: a + x)}
    return rounded(found.select("series", "nominal_observations", "hac_lag", (F.col("mean") * 1e6).alias("mean_e6"), (F.col("hac_long_run_variance") * 1e9).alias("lrv_e9"), "iid_t_stat", "hac_t_stat", "effective_observations",
                                "hac_two_sided_p_value", "hac_positive_one_sided_p_value", "hac_negative_one_sided_p_value", *[c.alias(n) for n, c in lags.items()]), 6)


def _hac_ratios(spark, sf):
    return rounded(inference.hac_ratios(inference.newey_west(inputs.values(spark, sf), overlap_horizon=12)), 6)


def _sizes(spark, sf):
    return inputs.values(spark, sf).groupBy("series").agg(F.count("*").alias("n"))


def _designs(spark, sf):
    """Blocks of 8, of a fifth and of all of each series."""
    lengths = F.explode(F.array(F.lit(8).cast("long"), F.floor(F.col("n") / 5), F.col("n"))).alias("block_length")
    found = _sizes(spark, sf).select("series", "n", lengths).withColumn("design", inference.block_design(F.col("n"), F.col("block_length")))
    return rounded(found.select("series", "n", "block_length", "design.effective_blocks", F.array_join("design.reasons", ",").alias("reasons")))


def _distributions(spark, sf):
    """Statistics of each supplier: discounts (few different ones), some without any, some all alike."""
    rows = table(spark, sf, "lineitem")
    value = F.when(F.col("l_suppkey") % 7 == 0, None).when(F.col("l_suppkey") % 5 == 0, 0.25).when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity")).otherwise(F.col("l_discount"))
    found = inference.audit_distribution(rows.select(F.col("l_suppkey").alias("series"), value.alias("value")))
    return rounded(found.withColumn("reasons", F.array_join("reasons", ",")))


def _ljung(spark, sf):
    v = inputs.values(spark, sf)
    sizes = v.groupBy("series").agg(F.count("*").alias("n")).withColumn("lags", serial.lag_limit(F.col("n"), 20))
    return rounded(serial.ljung_box(serial.autocorrelations(v, 20), sizes).select("series", "statistic", "degrees_of_freedom", "p_value"), 6)


def _bootstrap(spark, sf):
    v = inputs.values(spark, sf)
    found = inference.bootstrap_mean(v, v.select("series").distinct().withColumn("block_length", F.lit(8)))
    return found.withColumn("unavailable_reasons", F.array_join("unavailable_reasons", ","))


def _violations(spark, sf):
    """Returns of orders as texts: dates that repeat, that are none, and returns of less than everything."""
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 19 == 0, "1995-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    paid = F.when(F.col("o_orderkey") % 23 == 0, "none").when(F.col("o_orderkey") % 29 == 0, "-1.5").when(F.col("o_orderkey") % 31 == 0, "Infinity").otherwise("0.01")
    return returns.return_violations(o.select(F.col("o_custkey").alias("series"), date.alias("date"), paid.alias("net_return")))


def _strict_dates(spark, sf):
    o = table(spark, sf, "orders")
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("31"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", forms.alias("raw")).select("o_orderkey", "raw", strict_date("raw").cast("string").alias("date"))


def _memory(spark, sf):
    return serial.dependence_diagnostics(inputs.values(spark, sf))[1].drop("residual_memory")


def _validation(spark, sf):
    """The flagship: everything about each desk in one row."""
    r = sequential_validation(inputs.returns(spark, sf), (20, 60))["result"]
    window = lambda h: F.element_at(F.filter("window_summary", lambda w: w["horizon"] == h), 1)
    gained = F.element_at(F.filter("calendar_positive_fraction", lambda c: c["period_kind"] == "calendar_quarter"), 1)["positive_fraction"]
    full, inferred = F.col("full_period_metrics"), F.col("inference")
    return rounded(r.select(
        "series", "status", "date_min", "date_max", full["observations"].alias("observations"), *[full[c].alias(c) for c in ("total_return", "sharpe", "max_drawdown")], F.col("without_best_days.without_best_5").alias("without_best_5"),
        inferred["hac"]["hac_lag"].alias("hac_lag"), inferred["hac"]["hac_t_stat"].alias("hac_t_stat"), inferred["block_bootstrap"]["block_length"].alias("block_length"), inferred["confirmation_inference_available"].alias("confirmed"),
        "serial_dependence.linear_return_memory", "serial_dependence.volatility_memory", window(20)["window_count"].alias("windows_20"), window(20)["positive_window_fraction"].alias("gained_20"),
        window(60)["window_count"].alias("windows_60"), window(60)["worst_window_drawdown"].alias("worst_60"), gained.alias("gained_quarters"),
    ), 6)


def _panel(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("date"), normalize_symbol(rows, "l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_discount")


def _snapshot_change(spark, sf):
    p = _panel(spark, sf)
    old, new = p.where("date < '1997-01-01'"), p.where("date >= '1992-06-01' and not (date = '1995-03-01' and l_linenumber = 1)")
    return snapshots.difference(snapshots.date_digests(old), snapshots.date_digests(new))


def _frozen(spark, sf):
    """A snapshot, the same with what came later, and both read from the store by month."""
    p = _panel(spark, sf)
    say, out = {"universe": "suppliers", "price_basis": "discount", "frequency": "month", "availability": "ship date", "role": "panel"}, []
    store = fresh_folder(spark, "store")
    for step, rows in (("first", p.where("date < '1997-01-01'")), ("later", p)):
        done = snapshots.freeze(store, {"lineitem": rows}, say, salt=4)
        read = snapshots.read_snapshot(spark, store, done["snapshot_id"], verified=True)
        months = read.groupBy("date").agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("orders"))
        out.append(months.select(F.lit(step).alias("step"), "date", "rows", "orders", F.lit(done["objects"]).alias("objects"), F.lit(done["rows"]).alias("all_rows"), F.lit(done["reused_bytes"] > 0).alias("reused")))
    return out[0].unionByName(out[1])


def _snapshot_reads(spark, sf):
    """Some suppliers' rows of some months from a frozen panel, with what was opened for them."""
    say = {"universe": "suppliers", "price_basis": "discount", "frequency": "month", "availability": "ship date", "role": "panel"}
    store, dates, symbols = fresh_folder(spark, "store"), ["1995-03-01", "1996-07-01", "2050-01-01"], ["000001", "000007"]
    id = snapshots.freeze(store, {"lineitem": _panel(spark, sf)}, say)["snapshot_id"]
    rows = snapshots.read_snapshot(spark, store, id, columns=["date", "symbol", "l_discount"], dates=dates, symbols=symbols)
    return rows.crossJoin(snapshots.scan_summary(snapshots.scan_plan(spark, store, id, dates, symbols), 3, 5))  # one row on the right


def _selection(spark, sf):
    return selected(_panel(spark, sf), ["date", "symbol", "l_discount"], ["1995-03-01", "1996-07-01"], ["000001", "000007"])


def _scan(spark, sf):
    return scan_statistics(snapshots.date_digests(_panel(spark, sf)), ["1995-03-01", "1996-07-01"], 3, 5)


def _parts(spark, sf):
    return packs.plan_parts(inputs.artifacts(spark, sf), 64, 1 << 17).groupBy("part").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes")).select("part", "members", "bytes")


def _pack(spark, sf):
    """A planned pack with its contents, of which some are not what the catalog says."""
    d = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    held = d.select(F.col("source").alias("unit"), F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), "doc_id", text.alias("text"))
    planned = packs.plan_parts(held, 64, 1 << 17)
    content = F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit("."))).when(F.col("doc_id") % 41 == 0, F.concat(F.lit("x"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    return planned.withColumn("content", content.cast("binary")).drop("text")


def _member_errors(spark, sf):
    return packs.member_errors(_pack(spark, sf))


def _lookup(spark, sf):
    pack = _pack(spark, sf)
    wanted = inputs.artifacts(spark, sf).where("cast(name as long) % 17 = 0").select("unit", "kind", "name")
    return packs.lookup(pack, wanted, ["part", "member", "unit", "kind", "name", "bytes"])


def _receipts(spark, sf):
    a = inputs.artifacts(spark, sf).select("unit", "name", "sha256", "bytes")
    stated = a.where("cast(name as long) % 41 <> 0").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("name", F.when(F.col("bytes") % 53 == 0, F.lit("x")).otherwise(F.col("sha256"))))).alias("artifacts"))
    return packs.receipt_errors(stated, a.where("cast(name as long) % 43 <> 0"))


def _health(spark, sf):
    r = inputs.receipts(spark, sf)
    return events.delivery_health(r, r.where("cast(event_id as long) % 10 <> 0"), inputs.acks(spark, sf).where("line > 1"), inputs.NOW, timeout_s=inputs.TIMEOUT_S, claims=r.where("cast(event_id as long) % 20 = 0")).select("event_id", "status", "elapsed_s", "queued_to_ack_s", "within_slo", "repeats", "error")


def _clock(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts").cast("timestamp")).first()[0]


def _watchdog(spark, sf):
    beats = inputs.heartbeats(spark, sf)
    states = beats.groupBy("run_id").agg(F.max_by("status", "heartbeat_at").alias("status")).withColumn("blocker", F.when(F.col("status") == "failed", "dispatch_failed"))
    runs = beats.select("run_id").distinct()
    r = inputs.receipts(spark, sf)
    h = events.delivery_health(r, r, inputs.acks(spark, sf), inputs.NOW, timeout_s=inputs.TIMEOUT_S).withColumn("run_id", F.concat(F.lit("run"), F.col("target")))
    registered = runs.where("substring(run_id, 4) % 5 <> 0")
    return events.watchdog(registered, states, beats, h, F.lit(_clock(spark, sf)), runs.where("substring(run_id, 4) % 7 = 0"))


def _runs(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("succeeded")
    stages = e.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").cast("string").alias("stage"), state.alias("status"))
    return units.run_status(stages).select("run_id", "running", "succeeded", "failed", "execution_complete", "settled", F.array_join("blocking_stages", ",").alias("blocking_stages"))


def _work(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    plan = l.select(F.col("l_returnflag").alias("binding"), F.col("l_orderkey").alias("unit")).distinct()
    sealed = l.where("l_linestatus = 'F' and l_linenumber = 1").select(F.col("l_returnflag").alias("binding"), F.col("l_orderkey").alias("unit"))
    return units.units_to_do(plan, sealed)


def _batches(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    jobs = l.select(F.col("l_suppkey").alias("plan"), F.col("l_returnflag").alias("role"), F.when(F.col("l_linenumber") == 7, "failed").when(F.col("l_linestatus") == "O", "running").otherwise("succeeded").alias("status"), (F.col("l_partkey") % 2 == 0).alias("reused"))
    return units.batch_rollup(jobs)


def _progress(spark, sf):
    e = table(spark, sf, "events")
    return units.progress(e.select(F.col("user_id").alias("attempt"), F.col("event_id").alias("seq"), (F.col("event_id") % 50 - F.when(F.col("event_id") % 200 == 3, 10).otherwise(0)).alias("completed_units")))


def _closure(spark, sf):
    found, complete = retention.closure(inputs.edges(spark, sf), inputs.roots(spark, sf))
    if not complete:
        raise RuntimeError("the closure did not end")
    return found


def _conflicts(spark, sf):
    path = lambda *c: F.concat_ws("/", *c)
    p, n = table(spark, sf, "part"), F.col("p_size").cast("string")
    wanted = p.select(path(F.col("p_brand"), F.when(F.col("p_partkey") % 11 == 0, F.concat(n, F.lit("_latest"))).otherwise(n)).alias("path")).distinct()
    held = p.where("p_partkey % 13 = 0").select(path(F.col("p_brand"), n, F.lit("deep")).alias("path"))
    return retention.retirement_conflicts(wanted, held.union(p.where("p_brand like '%#1_'").select(path(F.col("p_brand"), F.lit("7"))).distinct()))


def _mentions(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    known = table(spark, sf, "part").select(F.regexp_extract("p_name", "^([A-Za-z0-9_.-]+)", 1).alias("name")).union(table(spark, sf, "nation").sparkSession.createDataFrame([("the",)], "name string"))
    return retention.references(d, known).groupBy("dst").agg(F.count("*").alias("documents"))


def _benchmark_ids(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    return events.published_once(e).select("event_id", "user_id", "event_type", "value")


QUERIES = {
    "path_metrics": lambda s, d: rounded(returns.path_metrics(inputs.returns(s, d)), 6),
    "without_best_days": lambda s, d: rounded(returns.without_best_days(inputs.returns(s, d))),
    "drawdown_curve": lambda s, d: rounded(returns.drawdowns(inputs.returns(s, d)).select("series", "date", "curve", "peak", "drawdown")),
    "overlapping_windows": lambda s, d: rounded(_windows(s, d).select("series", "horizon", "start_date", "end_date", "total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", F.struct("worst_day").alias("exact"), "win_rate"), 7).select("*", "exact.worst_day").drop("exact"),
    "window_summary": lambda s, d: rounded(windows.summarize_windows(_windows(s, d)), 6),
    "calendar_periods": lambda s, d: rounded(calendar.calendar_periods(inputs.returns(s, d)).select("series", "period_kind", "period", "start_date", "end_date", "observations", "total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "worst_day", "win_rate"), 6),
    "calendar_positive_fraction": lambda s, d: rounded(calendar.positive_fraction(calendar.calendar_periods(inputs.returns(s, d)))),
    "asof_membership": lambda s, d: rounded(asof.assert_no_future(_membership(s, d, asof.resolve_membership))),
    "asof_audit": lambda s, d: rounded(_membership(s, d, asof.audit_membership)),
    "normalized_symbols": _symbols,
    "feature_audit": _features,
    "rank_score": lambda s, d: rounded(crosssec.rank_score(inputs.panel(s, d)).select("l_orderkey", "l_linenumber", "score")),
    "rank_score_low": lambda s, d: rounded(crosssec.rank_score(inputs.panel(s, d), higher_is_better=False).select("l_orderkey", "l_linenumber", "score")),
    "benjamini_hochberg": _tests,
    "outcome_audit": lambda s, d: outcomes.audit_outcomes(inputs.outcomes(s, d), keys=("year",)).withColumn("errors", F.array_join("errors", ",")),
    "label_support": _support,
    "label_audit": lambda s, d: labels.audit_labels(inputs.labels(s, d)).withColumn("codes", F.array_join("codes", ",")),
    "fit_leakage": _fits,
    "scenario_maturity": _maturity,
    "ledger_audit": lambda s, d: labels.audit_ledger(inputs.ledger(s, d)),
    "readiness": _readiness,
    "newey_west": _hac,
    "hac_ratios": _hac_ratios,
    "block_designs": _designs,
    "distribution_audit": _distributions,
    "return_violations": _violations,
    "strict_dates": _strict_dates,
    "autocorrelations": lambda s, d: rounded(serial.autocorrelations(inputs.values(s, d), 20)),
    "ljung_box": _ljung,
    "partial_autocorrelations": lambda s, d: serial.partial_autocorrelation_rows(inputs.values(s, d), 20),
    "block_bootstrap": _bootstrap,
    "serial_memory": _memory,
    "sequential_validation": _validation,
    "snapshot_difference": _snapshot_change,
    "snapshot_store": _frozen,
    "snapshot_reads": _snapshot_reads,
    "selected_rows": _selection,
    "scan_statistics": _scan,
    "pack_parts": _parts,
    "pack_member_errors": _member_errors,
    "pack_lookup": _lookup,
    "pack_totals": lambda s, d: packs.catalog_totals(inputs.artifacts(s, d), ("kind",)),
    "receipt_errors": _receipts,
    "artifact_inventory": lambda s, d: packs.inventory(inputs.artifacts(s, d), ("unit",)),
    "delivery_health": _health,
    "first_acks": lambda s, d: events.first_acks(inputs.acks(s, d)),
    "pending_events": lambda s, d: events.pending(inputs.receipts(s, d), inputs.acks(s, d)).select("event_id", "target"),
    "published_once": _benchmark_ids,
    "heartbeat_health": lambda s, d: events.heartbeat_health(inputs.heartbeats(s, d), F.lit(_clock(s, d)), 86400.0).select("run_id", "status", "blocker"),
    "watchdog": _watchdog,
    "run_status": _runs,
    "units_to_do": _work,
    "batch_rollup": _batches,
    "progress": _progress,
    "retention_closure": _closure,
    "retirement_conflicts": _conflicts,
    "references": _mentions,
}

_METRICS = """select {keys}, count(*) as observations, product(1 + net_return) - 1 as total_return, avg(net_return) as mean, stddev_samp(net_return) as spread, min(net_return) as worst_day, max(net_return) as best_day,
    avg((net_return > 0)::int) as win_rate, min(date) as start_date, max(date) as end_date from {rows} group by {keys}"""
_FALL = """select {keys}, least(0, min(curve / peak - 1)) as max_drawdown from (select *, greatest(1, max(curve) over w) as peak from
    (select *, product(1 + net_return) over w as curve from {rows} window w as (partition by {keys} order by date)) window w as (partition by {keys} order by date)) group by {keys}"""
_WINDOWS = f"""with {inputs.INDEXED}, h(horizon) as (values (20), (60), (90)),
    x as (select e.series, h.horizon, e.idx as stop, e.date as end_date, i.date, i.net_return from i e join h on e.idx + 1 >= h.horizon join i on i.series = e.series and i.idx between e.idx - h.horizon + 1 and e.idx),
    c as (select *, product(1 + net_return) over w as curve from x window w as (partition by series, horizon, stop order by date)),
    p as (select *, greatest(1, max(curve) over (partition by series, horizon, stop order by date)) as peak from c),
    w as (select series, horizon::int as horizon, min(date) as start_date, max(date) as end_date, product(1 + net_return) - 1 as total_return, least(0, min(curve / peak - 1)) as max_drawdown,
          min(net_return) as worst_day, avg((net_return > 0)::int) as win_rate, case when min(net_return) < max(net_return) then stddev_samp(net_return) else 0 end * sqrt(252) as volatility, avg(net_return) / stddev_samp(net_return) * sqrt(252) as sharpe from p group by series, horizon, stop)"""
_CALENDAR = f"""with {inputs.RETURNS}, k as (select series, 'calendar_year' as period_kind, year(date)::varchar as period, date, net_return from r
    union all select series, 'calendar_quarter', year(date) || 'Q' || quarter(date), date, net_return from r),
    a as ({_METRICS.format(keys="series, period_kind, period", rows="k")}), f as ({_FALL.format(keys="series, period_kind, period", rows="k")})"""
_RANK = """with x as (select row_number() over () as row_id, l_orderkey, l_linenumber, l_shipdate::date as date, case when l_partkey % 17 > 0 then l_discount end as value from lineitem),
    k as (select *, rank() over (partition by date order by value {direction}) as r, count(*) over (partition by date, value) as ties, count(*) over (partition by date) as n from x where value is not null)
    select x.l_orderkey, x.l_linenumber, round(coalesce((k.r + (k.ties - 1) / 2) / k.n - 0.5, 0), 8) as score from x left join k using (row_id)"""
_LAGS = f"""with {inputs.VALUES}, m as (select series, count(*) as n, avg(value) as mean from v group by series),
    c as (select v.series, v.idx, v.value - m.mean as c from v join m using (series)),
    z as (select series, sum(c * c) as energy from c group by series),
    b as (select series, idx + lag as idx, lag, c from c, range(1, 61) t(lag)),
    g as (select a.series, b.lag, sum(a.c * b.c) as product from c a join b using (series, idx) group by all)"""
#: erfc for finite x of up to about 6; the terms are (2 x^2)^k / (1 * 3 * ... * (2 k + 1)).
_ERFC = "(1 - sign({x}) * (case when abs({x}) > 6 or {x} = 0 then abs(sign({x})) else 2 / sqrt(pi()) * abs({x}) * exp(-({x}) * ({x})) * list_sum(list_transform(range(220), lambda k: exp(k * ln(2 * ({x}) * ({x})) - (k + 1) * ln(2) - lgamma(k + 1.5::double) + ln(pi()) / 2))) end))"
_HAC = _LAGS + """, n as (select m.*, z.energy, least(n - 1, greatest({least}, floor(4 * pow(n / 100.0, 2 / 9::double))::bigint)) as lags from m join z using (series)),
        l as (select n.series, sum(2 * (1 - g.lag / (n.lags + 1)) * g.product / n.n) as weighed, sum(g.product / n.energy) as acf, max(g.product / n.energy) filter (g.lag = 1) as acf_1 from n join g on g.series = n.series and g.lag <= n.lags group by n.series),
        w as (select n.*, l.acf, l.acf_1, greatest(0, energy / n.n + coalesce(weighed, 0)) as lrv from n left join l using (series)),
        t as (select *, mean / sqrt(lrv / n) as t from w)"""
_MEMORY = f"""with {inputs.VALUES}, y as (select series, idx, unnest(['returns', 'absolute', 'squared']) as kind, unnest([value, abs(value), value * value]) as value from v),
    m as (select series, kind, count(*) as n, avg(value) as mean from y group by all), c as (select y.series, y.kind, y.idx, value - mean as c from y join m using (series, kind)), z as (select series, kind, sum(c * c) as energy from c group by all),
    b as (select series, kind, idx + lag as idx, lag, c from c, range(1, 21) t(lag)), g as (select a.series, a.kind, b.lag, sum(a.c * b.c) as product from c a join b using (series, kind, idx) group by all),
    x as (select series, kind, lag, n, product / energy as r from g join z using (series, kind) join m using (series, kind) where lag <= least(20, n // 4, n - 2)),
    p as (select *, {_ERFC.format(x="(abs(r) * sqrt(n) / sqrt(2))")} as p from x), k as (select *, row_number() over (partition by series, kind order by p) as place, count(*) over (partition by series, kind) as tests from p),
    l as (select series, kind, bool_or(p * tests / place <= 0.05) as any_lag, n * (n + 2) * sum(r * r / (n - lag)) / 2 as h from k group by series, kind, n),
    o as (select series, kind, any_lag or exp(-h) * list_sum(list_transform(range(10), lambda j: exp(j * ln(h) - lgamma(j + 1)))) <= 0.05 as memory from l)
    select series, bool_or(memory) filter (kind = 'returns') as linear_return_memory, bool_or(memory) filter (kind <> 'returns') as volatility_memory from o group by series"""
#: Documents in the order of a pack, and where each is put: part, members and bytes of the part with it.
_PACKED = """with recursive a as (select source as unit, lang as kind, doc_id::varchar as name, doc_id, coalesce(text, '') as text, strlen(coalesce(text, ''))::bigint as bytes from documents), b as (select *, row_number() over (order by unit, kind, name) as n from a),
        p(n, part, members, bytes) as (select n, 0::bigint, 1::bigint, bytes from b where n = 1 union all
            select b.n, case when p.members >= 64 or p.bytes + b.bytes > 131072 then p.part + 1 else p.part end, case when p.members >= 64 or p.bytes + b.bytes > 131072 then 1 else p.members + 1 end,
                case when p.members >= 64 or p.bytes + b.bytes > 131072 then b.bytes else p.bytes + b.bytes end from p join b on b.n = p.n + 1)"""
#: Rows of the panel, and what a selection of two months opens; a row's bytes are those of its JSON.
_SCANNED = """with p as (select strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') as date, repeat('0', greatest(0, 6 - len(l_suppkey::varchar))) || l_suppkey as symbol, l_orderkey, l_linenumber, l_discount from lineitem),
    d as (select date, sum(strlen('{"date":"","l_discount":,"l_linenumber":,"l_orderkey":,"symbol":""}') + strlen(date) + strlen(l_discount::varchar) + strlen(l_linenumber::varchar) + strlen(l_orderkey::varchar) + strlen(symbol))::bigint as bytes from p group by date),
    t as (select count(*) filter (date in ('1995-03-01', '1996-07-01')) as files_selected, count(*) as files_total, coalesce(sum(bytes) filter (date in ('1995-03-01', '1996-07-01')), 0)::bigint as bytes_selected, sum(bytes)::bigint as bytes_total, 3 as columns_selected, 5 as columns_total from d)"""
_HEALTH = """r as (select o_orderkey as k, o_custkey as target, o_orderdate::timestamp as queued from orders),
    f as (select l_orderkey as k, min(l_shipdate::timestamp) as acked, count(*) - 1 as repeats from lineitem where {lines} group by 1)"""

ORACLE_SQL = {
    "path_metrics": f"""with {inputs.RETURNS}, a as ({_METRICS.format(keys="series", rows="r")}), f as ({_FALL.format(keys="series", rows="r")})
        select series, observations, round(total_return, 6) as total_return, round(pow(1 + total_return, 252 / observations) - 1, 6) as annualized_return, round(spread * sqrt(252), 6) as annualized_volatility,
        round(mean / spread * sqrt(252), 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(worst_day, 6) as worst_day, round(win_rate, 6) as win_rate from a join f using (series)""",
    "without_best_days": f"""with {inputs.RETURNS}, k as (select *, row_number() over (partition by series order by net_return desc) as place from r)
        select series, {", ".join(f"round(product(1 + net_return) filter (place > {n}) - 1, 8) as without_best_{n}" for n in (1, 5, 10))} from k group by series""",
    "overlapping_windows": _WINDOWS + """ select series, horizon, start_date::varchar as start_date, end_date::varchar as end_date, round(total_return, 7) as total_return, round(pow(1 + total_return, 252 / horizon) - 1, 7) as annualized_return,
        round(volatility, 7) as annualized_volatility, round(sharpe, 7) as sharpe, round(max_drawdown, 7) as max_drawdown, worst_day, round(win_rate, 7) as win_rate from w""",
    "window_summary": _WINDOWS + """ select series, horizon, count(*) as window_count, round(avg((total_return > 0)::int), 6) as positive_window_fraction, round(avg(total_return), 6) as mean_total_return, round(quantile_cont(total_return, 0.5), 6) as median_total_return,
        round(min(total_return), 6) as minimum_total_return, round(quantile_cont(total_return, 0.1), 6) as p10_total_return, round(quantile_cont(total_return, 0.9), 6) as p90_total_return, round(max(total_return), 6) as maximum_total_return,
        round(quantile_cont(sharpe, 0.5), 6) as median_sharpe, round(min(max_drawdown), 6) as worst_window_drawdown, max(end_date)::varchar as latest_window_end_date, round(arg_max(total_return, end_date), 6) as latest_window_total_return from w group by series, horizon""",
    "calendar_periods": _CALENDAR + """ select series, period_kind, period, start_date::varchar as start_date, end_date::varchar as end_date, observations, round(total_return, 6) as total_return, round(pow(1 + total_return, 252 / observations) - 1, 6) as annualized_return,
        round(case when observations > 1 and worst_day < best_day then spread else 0 end * sqrt(252), 6) as annualized_volatility, round(case when observations > 1 and worst_day < best_day then mean / spread * sqrt(252) end, 6) as sharpe,
        round(max_drawdown, 6) as max_drawdown, round(worst_day, 6) as worst_day, round(win_rate, 6) as win_rate from a join f using (series, period_kind, period)""",
    "drawdown_curve": f"""with {inputs.RETURNS}, c as (select *, product(1 + net_return) over (partition by series order by date) as curve from r), p as (select *, greatest(1, max(curve) over (partition by series order by date)) as peak from c)
        select series, date::varchar as date, round(curve, 8) as curve, round(peak, 8) as peak, round(curve / peak - 1, 8) as drawdown from p""",
    "calendar_positive_fraction": _CALENDAR + " select series, period_kind, round(avg((total_return > 0)::int), 8) as positive_fraction from a group by series, period_kind",
    "asof_membership": f"with {inputs.MEMBERS} select h.date::varchar as date, m.symbol, m.snapshot_date::varchar as membership_snapshot_date, (h.date - m.snapshot_date)::int as membership_snapshot_age_days from h join m using (snapshot_date) where h.date - m.snapshot_date <= 45",
    "asof_audit": f"""with {inputs.MEMBERS}, n as (select snapshot_date, count(*) as n from m group by 1)
        select h.date::varchar as date, coalesce(h.date - h.snapshot_date <= 45, false) as covered, h.snapshot_date::varchar as snapshot_date, (h.date - h.snapshot_date)::int as snapshot_age_days, case when h.date - h.snapshot_date <= 45 then n.n else 0 end as membership_symbol_count,
        case when h.snapshot_date is null then 'before_first_snapshot' when h.date - h.snapshot_date > 45 then 'snapshot_too_old' else '' end as reason from h left join n using (snapshot_date)""",
    "normalized_symbols": """with x as (select p_partkey, p_partkey::varchar as k, p_name from part), y as (select p_partkey, case p_partkey % 8 when 0 then right(k, 6) when 1 then right('12345' || k, 6) when 2 then '-' || k when 3 then k
        when 4 then right(k || '9', 6) when 5 then null when 6 then right(k || '5', 6) else nullif(right(regexp_replace(p_name, '[^0-9]', '', 'g'), 6), '') end as s from x),
        z as (select p_partkey, case when s is null then '' when s like '-%' then '-' || repeat('0', greatest(0, 6 - len(s))) || s[2:] else repeat('0', greatest(0, 6 - len(s))) || s end as symbol from y)
        select p_partkey, symbol, regexp_matches(symbol, '^[0-9]{6}$') as exact from z""",
    "feature_audit": """with x as (select p_brand as dataset, (case when p_size % 7 = 0 then 'Lead-' else '' end) || replace(lower(p_type), ' ', '_') as name, count(*) as n from part group by 1, 2),
        y as (select *, name like 'Lead-%' as bad from x), z as (select dataset, sum(n)::bigint as feature_count, count(*) filter (bad) as forbidden_feature_count,
        coalesce(string_agg(name, ',' order by name) filter (bad), '') as forbidden_features, coalesce(string_agg(name, ',' order by name) filter (n > 1), '') as duplicate_features, coalesce(string_agg(name, ',' order by name) filter (not bad), '') as allowed_features from y group by dataset)
        select *, forbidden_features = '' and duplicate_features = '' as pass from z""",
    "rank_score": _RANK.format(direction="asc"),
    "rank_score_low": _RANK.format(direction="desc"),
    "benjamini_hochberg": """with x as (select row_number() over () as row_id, l_orderkey, l_linenumber, l_returnflag, l_shipdate::date as day, case when l_linenumber < 7 then (l_discount * 100 + l_tax * 1000 + 1) / (l_quantity * 100) end as p from lineitem),
        k as (select *, row_number() over w as n, count(*) over (partition by l_returnflag, day) as m from x where p is not null window w as (partition by l_returnflag, day order by p)),
        q as (select row_id, least(1, min(p * m / n) over (partition by l_returnflag, day order by n rows between current row and unbounded following)) as q from k)
        select x.l_orderkey, x.l_linenumber, q.q as q_value from x left join q using (row_id)""",
    "outcome_audit": """with x as (select year(l_shipdate)::int as year, l_returnflag in ('A', 'R') as cash, l_linestatus = 'F' as done, case when l_partkey % 5 = 0 then null when l_partkey % 3 = 0 then 0.0 else l_discount end as v from lineitem),
        y as (select year, count(*) as rows, count(*) filter (done) as resolved_rows, count(*) filter (not done) as unresolved_rows, count(*) filter (done and cash) as resolved_cash_rows, 0::bigint as invalid_resolution_count,
        count(*) filter (done and cash and v is null) as resolved_cash_nonfinite_count, count(*) filter (done and cash and abs(v) > 1e-15) as resolved_cash_nonzero_count, count(*) filter (done and not cash and v is null) as resolved_position_nonfinite_count, count(*) filter (not done and v is not null) as unresolved_finite_count from x group by year),
        z as (select *, concat_ws(',', case when resolved_cash_nonfinite_count > 0 then 'resolved_cash_return_must_be_explicit_zero' end, case when resolved_cash_nonzero_count > 0 then 'resolved_cash_return_must_equal_zero' end,
        case when resolved_position_nonfinite_count > 0 then 'resolved_position_return_must_be_finite' end, case when unresolved_finite_count > 0 then 'unresolved_outcome_return_must_remain_missing' end) as errors from y)
        select *, errors = '' as pass from z""",
    "label_support": f"""with {inputs.LABELS}, x as (select *, status <> 'UNRESOLVED' as resolved, available_at >= timestamp '2024-01-15 12:00:00' as late from l),
        y as (select scenario, count(*) filter (resolved and not late and role = 'action') as role_action, count(*) filter (resolved and not late and role = 'wait') as role_wait, count(*) filter (resolved and not late and role = '') as role_none,
        count(*) filter (not resolved)::bigint as unresolved, count(*) filter (resolved and late)::bigint as not_yet_mature, count(*) filter (status = 'RESOLVED_CASH' and value <> 0) as cash from x group by scenario)
        select scenario, role_action, role_wait, role_none, unresolved, not_yet_mature, concat_ws(',', case when role_action = 0 then 'no_observable_label_support_for_role:action' end, 'no_observable_label_support_for_role:hold',
        case when role_wait = 0 then 'no_observable_label_support_for_role:wait' end, case when cash > 0 then 'resolved_cash_not_zero' end) as blockers from y""",
    "label_audit": f"""with {inputs.LABELS} select scenario, count(*) filter (status = 'RESOLVED_MARKET') as resolved_market, count(*) filter (status = 'RESOLVED_CASH') as resolved_cash, count(*) filter (status = 'UNRESOLVED') as unresolved,
        case when count(*) filter (status = 'RESOLVED_CASH' and value <> 0) > 0 then 'resolved_cash_not_zero' else '' end as codes from l group by scenario""",
    "fit_leakage": f"""with {inputs.LABELS}, x as (select l.*, e.user_id, e.ts::date as day from events e join l on l.label_id = e.event_id::varchar),
        y as (select scenario, count(distinct (user_id, day)) as fit_count, count(*) filter (status <> 'UNRESOLVED') as training_rows, count(*) filter (status = 'RESOLVED_MARKET') as market_training_rows, count(*) filter (status = 'UNRESOLVED') as unknown_labels,
        count(*) filter (status <> 'UNRESOLVED' and available_at >= day + interval 12 hour) as unobservable_labels, count(*) filter (status <> 'UNRESOLVED' and role = '') as no_role from x group by scenario)
        select scenario, fit_count, training_rows, market_training_rows, unknown_labels, unobservable_labels, concat_ws(',', case when unknown_labels > 0 then 'fit_consumed_unknown_label' end, case when unobservable_labels > 0 then 'fit_consumed_unobservable_label' end, case when no_role > 0 then 'missing_training_role' end) as codes from y""",
    "readiness": f"""with {inputs.LABELS}, a as (select scenario, count(*) filter (status = 'RESOLVED_MARKET') as resolved_market, count(*) filter (status = 'RESOLVED_CASH') as resolved_cash, count(*) filter (status = 'RESOLVED_CASH' and value <> 0) as odd from l group by scenario),
        x as (select l.*, e.ts::date as day from events e join l on l.label_id = e.event_id::varchar),
        f as (select scenario, count(*) filter (status <> 'UNRESOLVED') as training_rows, count(*) filter (status = 'RESOLVED_MARKET') as market, count(*) filter (status = 'UNRESOLVED') as unknown, count(*) filter (status <> 'UNRESOLVED' and available_at >= day + interval 12 hour) as leaks,
            count(*) filter (status <> 'UNRESOLVED' and role = '') as no_role, count(*) filter (status <> 'UNRESOLVED' and role = 'action') as action from x group by scenario),
        g as (select 's' || user_id % 2 as scenario, count(*) as account_rows, count(*) filter (event_type = 'error') as bad, count(*) filter (clock <= before) as late
            from (select *, date_trunc('second', ts) as clock, lag(date_trunc('second', ts)) over (partition by user_id % 2 order by event_id) as before from events) group by 1),
        j as (select a.*, f.* exclude (scenario), coalesce(account_rows, 0) as account_rows, coalesce(bad, 0) as bad, coalesce(late, 0) as late from a join f using (scenario) left join g using (scenario)),
        c as (select scenario, unnest([case when odd > 0 then 'resolved_cash_not_zero' end, case when resolved_market + resolved_cash < 10 then 'insufficient_resolved_replay_evidence' end, 'insufficient_resolved_market_evidence', case when unknown > 0 then 'fit_consumed_unknown_label' end,
            case when leaks > 0 then 'fit_consumed_unobservable_label' end, case when no_role > 0 then 'missing_training_role' end, case when bad > 0 then 'account_balance_mismatch' end, case when late > 0 then 'account_clock_not_increasing' end, case when account_rows = 0 then 'empty_account_evidence' end,
            case when scenario <> 's3' and market = 0 then 'no_effective_learning' end, case when scenario <> 's3' and action = 0 then 'no_training_support_for_role:action' end, case when scenario <> 's3' then 'no_training_support_for_role:hold' end]) as code from j)
        select scenario, any_value(resolved_market) as resolved_market, any_value(training_rows) as training_rows, any_value(account_rows) as account_rows, false as ready, string_agg(scenario || ':' || code, ',' order by scenario || ':' || code) as blockers
        from j join c using (scenario) group by scenario""",
    "scenario_maturity": """with a as (select user_id, event_type, count(*) as n, count(*) filter (event_id % 97 <> 0) as m from events group by all), b as (select user_id, max(m) as any_left, bool_or(n <> m) as off from a group by user_id)
        select 'u' || user_id || ':maturity_reference_mismatch' as blocker from b where off union select 'scenario_coverage_mismatch' from b where any_left = 0""",
    "ledger_audit": """with x as (select 'u' || user_id as scenario, event_id, date_trunc('second', ts) as clock, event_type from events), y as (select *, lag(clock) over (partition by scenario order by event_id) as before from x)
        select scenario, count(*) as account_rows, count(*) filter (clock <= before) as clock_not_increasing, 0::bigint as nonfinite_values, count(*) filter (event_type = 'error') as balance_mismatches, count(*) filter (clock is null) as invalid_clocks from y group by scenario""",
    "newey_west": _HAC.replace("{least}", "11") + f""" select series, n as nominal_observations, lags as hac_lag, round(mean * 1e6, 6) as mean_e6, round(lrv * 1e9, 6) as lrv_e9, round(mean / sqrt(energy / (n - 1) / n), 6) as iid_t_stat, round(t, 6) as hac_t_stat,
        round(least(n, greatest(1, n * energy / (n - 1) / lrv)), 6) as effective_observations, round({_ERFC.format(x="(abs(t) / sqrt(2))")}, 6) as hac_two_sided_p_value, round({_ERFC.format(x="(t / sqrt(2))")} / 2, 6) as hac_positive_one_sided_p_value,
        round({_ERFC.format(x="(-t / sqrt(2))")} / 2, 6) as hac_negative_one_sided_p_value, round(acf_1, 6) as first_autocorrelation, round(acf, 6) as sum_of_autocorrelations from t""",
    "hac_ratios": _HAC.replace("{least}", "11") + " select series, round(t, 6) as hac_t_stat, round(mean / sqrt(lrv) * sqrt(252), 6) as hac_annualized_ratio from t",
    "block_designs": f"""with {inputs.VALUES}, n as (select series, count(*) as n from v group by series), x as (select series, n, unnest([8::bigint, n // 5, n]) as block_length from n),
        y as (select *, n / greatest(1, block_length) as blocks from x)
        select series, n, block_length, round(blocks, 8) as effective_blocks, concat_ws(',', case when n < 2 then 'fewer_than_two_observations' end, case when block_length >= n then 'block_length_not_smaller_than_sample' end, case when blocks < 4 then 'too_few_effective_blocks' end) as reasons from y""",
    "distribution_audit": """with x as (select l_suppkey as series, case when l_suppkey % 7 = 0 then null when l_suppkey % 5 = 0 then 0.25 when l_suppkey % 3 = 0 then l_quantity else l_discount end as v from lineitem),
        w as (select series, count(v) as n, max(v) - min(v) as span, pow(2, -52) * 64 * greatest(1, max(abs(v))) as tolerance from x group by series),
        d as (select series, count(distinct round_even(v / tolerance, 0)) as k from x join w using (series) group by series)
        select series, n as finite_statistics, k as unique_statistics, round(span, 8) as numeric_span, concat_ws(',', case when n = 0 then 'no_finite_bootstrap_statistics' end, case when span <= tolerance then 'numerically_degenerate_bootstrap_distribution' end,
        case when n > 0 and k < 20 then 'too_few_unique_bootstrap_statistics' end) as reasons from w join d using (series)""",
    "return_violations": """with x as (select o_custkey as series, case when o_orderkey % 19 = 0 then null else o_orderdate::date end as date, case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 0 then -1.5 when o_orderkey % 31 = 0 then 'inf'::double else 0.01 end as v from orders),
        y as (select series, date, count(*) as n, count(*) filter (date is null) as no_date, count(*) filter (v is null or isinf(v)) as no_return, count(*) filter (v <= -1) as below from x group by series, date),
        z as (select series, sum(no_date)::bigint as invalid_dates, sum(no_return)::bigint as nonfinite_returns, sum(below)::bigint as returns_at_most_minus_one, count(*) filter (date is not null and n > 1) as duplicate_dates from y group by series)
        select * from z where invalid_dates + nonfinite_returns + returns_at_most_minus_one + duplicate_dates > 0""",
    "strict_dates": """with x as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%-m-%-d') when 1 then strftime(o_orderdate, '%Y-%m-') || '31' else strftime(o_orderdate, '%Y-%m-%d') end as raw from orders)
        select o_orderkey, raw, case when regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(raw as date)::varchar end as date from x""",
    "autocorrelations": _LAGS + " select series, g.lag, round(g.product / z.energy, 8) as acf from g join z using (series) where lag <= 20",
    "ljung_box": _LAGS + """, q as (select series, m.n * (m.n + 2) * sum(pow(g.product / z.energy, 2) / (m.n - g.lag)) as q from g join z using (series) join m using (series) where lag <= 20 group by series, m.n)
        select series, round(q, 6) as statistic, 20::bigint as degrees_of_freedom, round(exp(-q / 2) * list_sum(list_transform(range(10), lambda k: exp(k * ln(q / 2) - lgamma(k + 1)))), 6) as p_value from q""",
    "serial_memory": _MEMORY,
    "sequential_validation": f"""with {inputs.RETURNS}, a as ({_METRICS.format(keys="series", rows="r")}), f as ({_FALL.format(keys="series", rows="r")}), e as ({_MEMORY}),
        d as (select series, product(1 + net_return) filter (place > 5) - 1 as without_best_5 from (select *, row_number() over (partition by series order by net_return desc) as place from r) group by series),
        h as ({_HAC.replace("{least}", "0")} select series, lags, t, n / (lags + 1) as blocks from t),
        k as ({_CALENDAR} select series, avg((total_return > 0)::int) as gained from a where period_kind = 'calendar_quarter' group by series),
        w as ({_WINDOWS} select series, count(*) filter (horizon = 20) as windows_20, avg((total_return > 0)::int) filter (horizon = 20) as gained_20, count(*) filter (horizon = 60) as windows_60, min(max_drawdown) filter (horizon = 60) as worst_60 from w group by series)
        select series, 'diagnostic_only_causal_signal_path_not_verified' as status, start_date::varchar as date_min, end_date::varchar as date_max, observations, round(total_return, 6) as total_return, round(mean / spread * sqrt(252), 6) as sharpe, round(max_drawdown, 6) as max_drawdown,
        round(without_best_5, 6) as without_best_5, lags as hac_lag, round(t, 6) as hac_t_stat, lags + 1 as block_length, blocks >= 4 as confirmed, linear_return_memory, volatility_memory, windows_20, round(gained_20, 6) as gained_20, windows_60, round(worst_60, 6) as worst_60, round(gained, 6) as gained_quarters
        from a join f using (series) join d using (series) join h using (series) join k using (series) join w using (series) join e using (series)""",
    "snapshot_difference": """with p as (select strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') as date, l_linenumber from lineitem), a as (select date, count(*) as n from p where date < '1997-01-01' group by 1),
        b as (select date, count(*) as n from p where date >= '1992-06-01' and not (date = '1995-03-01' and l_linenumber = 1) group by 1)
        select date, case when a.n is null then 'added' when b.n is null then 'removed' when a.n = b.n then 'reused' else 'changed' end as change from a full join b using (date)""",
    "snapshot_store": """with p as (select strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') as date, l_orderkey from lineitem),
        x as (select 'first' as step, * from p where date < '1997-01-01' union all select 'later' as step, * from p),
        t as (select step, count(distinct date)::bigint as objects, count(*)::bigint as all_rows from x group by step)
        select step, date, count(*) as rows, sum(l_orderkey)::bigint as orders, any_value(objects) as objects, any_value(all_rows) as all_rows, step = 'later' as reused from x join t using (step) group by step, date""",
    "selected_rows": "select strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') as date, lpad(l_suppkey::varchar, 6, '0') as symbol, l_discount from lineitem where strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') in ('1995-03-01', '1996-07-01') and l_suppkey in (1, 7)",
    "scan_statistics": _SCANNED + " select * from t",
    "snapshot_reads": _SCANNED + " select p.date, p.symbol, p.l_discount, t.* from p, t where p.date in ('1995-03-01', '1996-07-01') and p.symbol in ('000001', '000007')",
    "pack_parts": _PACKED + " select '000000-' || lpad(part::varchar, 12, '0') as part, max(members) as members, max(bytes)::bigint as bytes from p group by part",
    "pack_totals": "select lang as kind, count(*) as artifacts, count(distinct source) as units, sum(strlen(coalesce(text, '')))::bigint as logical_bytes from documents group by lang",
    "artifact_inventory": """with a as (select source as unit, strlen(coalesce(text, ''))::bigint as bytes, sha256(doc_id || '|' || sha256(coalesce(text, '')) || '|' || strlen(coalesce(text, ''))) as entry from documents)
        select unit, count(*) as artifacts, sum(bytes)::bigint as total_bytes, sha256(concat_ws('|', count(*), sum(('0x' || entry[1:15])::bigint), sum(('0x' || entry[16:30])::bigint), sum(('0x' || entry[31:45])::bigint), sum(('0x' || entry[46:60])::bigint))) as list_sha256 from a group by unit""",
    "pack_member_errors": _PACKED + " select unit, kind, name, '000000-' || lpad(part::varchar, 12, '0') as part, members::int as member from p join b using (n) where doc_id % 37 = 0 or (doc_id % 41 = 0 and text[1:1] <> 'x')",
    "pack_lookup": _PACKED + " select '000000-' || lpad(part::varchar, 12, '0') as part, members::int as member, unit, kind, name, b.bytes from p join b using (n) where doc_id % 17 = 0",
    "delivery_health": "with " + _HEALTH.format(lines="l_linenumber > 1") + f""", x as (select r.*, f.acked, f.repeats, r.queued + interval {inputs.TIMEOUT_S} second as due, r.k % 10 <> 0 as has, timestamp '{inputs.NOW}' as now_at from r left join f using (k)),
        y as (select *, case when not has then null when now_at < queued then 'delivery_clock_regression' when acked < queued or acked > now_at then 'delivery_ack_clock_invalid' end as error from x)
        select k::varchar as event_id, case when error is not null then null when not has then case when k % 20 = 0 then 'submission_uncertain' else 'not_submitted' end when acked is not null then case when acked > due then 'acknowledged_late' else 'acknowledged' end
        when now_at > due then 'acknowledgment_overdue' else 'awaiting_ack' end as status, case when has and error is null then epoch(now_at) - epoch(queued) end as elapsed_s, case when error is null and acked is not null and has then epoch(acked) - epoch(queued)
        when error is null and acked is not null then null end as queued_to_ack_s, case when error is null and acked is not null then case when has then acked <= due end end as within_slo, coalesce(repeats, 0) as repeats, error from y""",
    "first_acks": """with x as (select l_orderkey::varchar as event_id, l_shipdate::timestamp as acknowledged_at, l_linenumber as line from lineitem)
        select event_id, acknowledged_at, line, count(*) over (partition by event_id) - 1 as already_consumed from x qualify row_number() over (partition by event_id order by acknowledged_at, line) = 1""",
    "pending_events": "select o_orderkey::varchar as event_id, o_custkey::varchar as target from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "published_once": """select sha256('{"event_type":"' || event_type || '","user_id":' || user_id || ',"value":' || value || '}') as event_id, user_id, event_type, value from (select distinct user_id, event_type, value from events)""",
    "heartbeat_health": """with x as (select 'run' || user_id as run_id, case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' else 'running' end as status, ts from events),
        y as (select * from x qualify row_number() over (partition by run_id order by ts desc, status desc) = 1)
        select run_id, case when status = 'running' and (select max(ts) from events) - ts > interval 1 day then 'at_risk' else status end as status, case when status = 'running' and (select max(ts) from events) - ts > interval 1 day then 'controller_heartbeat_stale' end as blocker from y""",
    "run_status": """with x as (select 'run' || user_id as run_id, event_id::varchar as stage, case event_type when 'error' then 'failed' when 'view' then 'running' else 'succeeded' end as status from events)
        select run_id, count(*) filter (status = 'running') as running, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'failed') as failed, bool_and(status = 'succeeded') as execution_complete, not bool_or(status = 'running') as settled,
        coalesce(string_agg(stage, ',' order by stage) filter (status = 'failed'), '') as blocking_stages from x group by run_id""",
    "units_to_do": "select distinct l_returnflag as binding, l_orderkey as unit from lineitem where (l_returnflag, l_orderkey) not in (select (l_returnflag, l_orderkey) from lineitem where l_linestatus = 'F' and l_linenumber = 1)",
    "batch_rollup": """with x as (select l_suppkey as plan, l_returnflag as role, case when l_linenumber = 7 then 'failed' when l_linestatus = 'O' then 'running' else 'succeeded' end as status, l_partkey % 2 = 0 as reused from lineitem),
        y as (select plan, role, count(*) as total, count(*) filter (status = 'succeeded') as finished, count(*) filter (status = 'succeeded' and reused) as reused, count(*) filter (status = 'failed') as failed from x group by plan, role)
        select *, total - finished - failed as pending, finished = total as complete from y""",
    "progress": """with x as (select user_id as attempt, event_id as seq, event_id % 50 - case when event_id % 200 = 3 then 10 else 0 end as n from events), y as (select *, lag(n) over (partition by attempt order by seq) as before from x)
        select attempt, max(n) filter (n >= 0) as last_good, bool_or(n < coalesce(before, 0) or n < 0) as nonmonotonic_progress from y group by attempt""",
    "retention_closure": f"with recursive {inputs.EDGES} select node from c",
    "retirement_conflicts": """with w as (select distinct p_brand || '/' || p_size || case when p_partkey % 11 = 0 then '_latest' else '' end as path from part),
        h as (select distinct p_brand || '/' || p_size || '/deep' as path from part where p_partkey % 13 = 0 union select distinct p_brand || '/7' from part where p_brand like '%#1_')
        select distinct w.path, 'referenced_or_protected' as reason from w join h on w.path = h.path or starts_with(h.path, w.path || '/') or starts_with(w.path, h.path || '/') union all select path, 'canonical_latest_not_retirable' from w where path like '%\\_latest' escape '\\'""",
    "references": r"""with d as (select doc_id, coalesce(text, '') as text from documents), k as (select regexp_extract(p_name, '^([A-Za-z0-9_.-]+)', 1) as name from part union select 'the'),
        t as (select distinct doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_.-]+)')) as dst from d) select dst, count(*) as documents from t where dst in (select name from k) group by dst""",
    "receipt_errors": """with a as (select source as unit, doc_id::varchar as name, doc_id, sha256(coalesce(text, '')) as sha, strlen(coalesce(text, '')) as bytes from documents),
        s as (select unit, name, case when bytes % 53 = 0 then 'x' else sha end as stated from a where doc_id % 41 <> 0), h as (select unit, name, sha as held from a where doc_id % 43 <> 0),
        x as (select unit, name, case when held is null then 'not_in_catalog' when stated is null then 'not_in_receipt' when held <> stated then 'hash_mismatch' end as error from s full join h using (unit, name))
        select * from x where error is not null""",
    "watchdog": "with " + _HEALTH.format(lines="true") + f""", t as (select max(ts) as last from events),
        b as (select 'run' || user_id as run_id, user_id, case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' else 'running' end as status, ts from events qualify row_number() over (partition by user_id order by ts desc) = 1),
        e as (select 'run' || r.target as run_id, bool_or(f.acked < r.queued or f.acked > timestamp '{inputs.NOW}') as invalid, bool_or(f.acked is null and timestamp '{inputs.NOW}' > r.queued + interval {inputs.TIMEOUT_S} second) as overdue from r left join f using (k) group by 1),
        x as (select b.run_id, b.status, user_id % 7 = 0 as halted, case when user_id % 7 = 0 then null when status = 'failed' then 'dispatch_failed' when status = 'running' and (select last from t) - ts > interval 30 second then 'controller_heartbeat_stale'
            when e.overdue then 'delivery_acknowledgment_overdue' when e.invalid then 'invalid_delivery_evidence' end as blocker from b left join e using (run_id) where user_id % 5 <> 0)
        select run_id, case when halted then 'paused' when blocker is not null then 'at_risk' else status end as status, blocker from x""",
}
