import datetime as dt
import hashlib
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import asof, crosssec, labels, outcomes, packs, retention, snapshots, units
from tidegauge.sources import tables

D = dt.date


def test_membership(spark, tmp_path):
    members = spark.createDataFrame([(D(2026, 1, 2), "000001"), (D(2026, 1, 2), "000002"), (D(2026, 1, 6), "000002"), (D(2026, 1, 6), "000003")], "snapshot_date date, symbol string")
    headers = members.select("snapshot_date").distinct()
    decided = spark.createDataFrame([(D(2026, 1, d),) for d in (1, 2, 5, 6, 12)], "date date")
    audit = {r.date.day: r for r in asof.audit_membership(members, headers, decided, 4).collect()}
    assert audit[1].reason == "before_first_snapshot" and audit[12].reason == "snapshot_too_old" and audit[5].snapshot_age_days == 3 and audit[5].covered and audit[5].membership_symbol_count == 2
    found = asof.assert_no_future(asof.resolve_membership(members, headers, decided, 4))
    assert found.count() == 6
    with pytest.raises(ValueError):
        asof.resolve_membership(members, headers, decided, -1)
    with pytest.raises(ValueError):
        asof.audit_membership(members, headers.union(headers), decided, 4)
    with pytest.raises(ValueError):
        asof.assert_no_future(found.withColumn("membership_snapshot_date", F.date_add("date", 1)))
    # A snapshot without symbols covers; one of an earlier decade carries over.
    old = spark.createDataFrame([(D(2019, 12, 30),)], "snapshot_date date")
    row = asof.audit_membership(members.limit(0), old, spark.createDataFrame([(D(2020, 1, 2),)], "date date"), 4).first()
    assert row.covered and row.membership_symbol_count == 0
    (tmp_path / "dt=2026-01-02").mkdir()
    pq.write_table(pa.table({"symbol": ["1", "000002", "000002", "bad"], "other": [1, 2, 3, 4]}), tmp_path / "dt=2026-01-02/cs_norm.parquet")
    read, dates = tables.read_membership(spark, str(tmp_path))
    assert sorted(r.symbol for r in read.collect()) == ["000001", "000002"] and dates.count() == 1
    (tmp_path / "dt=2026-13-02").mkdir()
    pq.write_table(pa.table({"symbol": ["1"]}), tmp_path / "dt=2026-13-02/cs_norm.parquet")
    with pytest.raises(ValueError):
        tables.read_membership(spark, str(tmp_path))
    hashes = tables.file_digests(spark, str(tmp_path), "*.parquet").collect()
    assert len(hashes) == 2 and all(len(h.sha256) == 64 for h in hashes)
    # Files that are too large for a row are read in pieces, and hash alike.
    assert sorted(hashes) == sorted(tables.file_digests(spark, str(tmp_path), "*.parquet", whole=10).collect())
    assert [r.sha256 for r in dates.collect()] == [hashlib.sha256((tmp_path / "dt=2026-01-02/cs_norm.parquet").read_bytes()).hexdigest()]


def test_features(spark):
    names = ["ret_5d", "amount", "entry_open", "exit_price_latency_2m", "label_ret", "future_return", "target_weight", "cash_available_cny", "project_controllable_notional_cny", "Lead-x"]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert crosssec.allowed_features(df).columns == ["amount", "ret_5d"]
    with pytest.raises(ValueError):
        crosssec.assert_features(df)
    crosssec.assert_features(df.select("amount"))


def test_rank_score(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 3.0), ("d", 3.0), ("d", float("nan")), (None, 1.0), ("e", None)], "date string, value double")
    got = sorted((r.date or "", str(r.value), round(r.score, 6)) for r in crosssec.rank_score(df).collect())
    assert got == sorted([("d", "1.0", -0.25), ("d", "2.0", 0.0), ("d", "3.0", 0.375), ("d", "3.0", 0.375), ("d", "nan", 0.0), ("", "1.0", 0.0), ("e", "None", 0.0)])
    low = {r.value: r.score for r in crosssec.rank_score(df.where("date = 'd' and value < 9"), higher_is_better=False).collect()}
    assert low[1.0] == 0.5


def test_outcomes(spark):
    good = spark.createDataFrame([("CASH", True, 0.0), ("BUY", True, 0.012), ("BUY", False, None)], "action string, resolved boolean, net_return double")
    row = outcomes.audit_outcomes(good).first()
    assert row["pass"] and row.resolved_cash_rows == 1
    outcomes.assert_outcomes(good)
    bad = spark.createDataFrame([(" cash", "YES", None), ("BUY", "no", "0.0"), ("BUY", "maybe", None), ("BUY", "1", "inf")], "action string, resolved string, net_return string")
    assert outcomes.audit_outcomes(bad).first().errors == ["invalid_resolution_value", "resolved_cash_return_must_be_explicit_zero", "resolved_position_return_must_be_finite", "unresolved_outcome_return_must_remain_missing"]
    with pytest.raises(ValueError):
        outcomes.assert_outcomes(bad)
    assert outcomes.audit_outcomes(bad.drop("action")).first().missing_columns == ["action"]


LABEL = "scenario string, label_id string, status string, value string, available_at string, training_role string"


def test_label_support(spark):
    rows = spark.createDataFrame([("s", "1", "RESOLVED_MARKET", "0", "2026-08-14T15:00:00+08:00", "wait"), ("s", "2", "UNRESOLVED", None, None, "action"), ("s", "3", "RESOLVED_MARKET", "1", "2026-08-17T09:30:00+08:00", "action")], LABEL)
    row = labels.audit_label_support(rows, "2026-08-17T09:30:00+08:00", ["action"]).first()
    assert row.observable_labels_by_role == {"wait": 1} and row.unresolved == 1 and row.not_yet_mature == 1 and row.blockers == ["no_observable_label_support_for_role:action"]
    assert labels.audit_label_support(rows, "2026-08-18T00:00:00Z", []).first().blockers == ["required_roles_not_declared"]


def test_readiness(spark):
    rows = spark.createDataFrame([("s", "1", "RESOLVED_MARKET", "0.1", "2026-09-01T10:00:00+08:00", "act"), ("s", "2", "RESOLVED_CASH", "0", "2026-08-01T10:00:00+08:00", "act"), ("t", "1", "RESOLVED_MARKET", "1", "2026-08-01T10:00:00+08:00", "act")], LABEL)
    fits = spark.createDataFrame([("s", "f", "2026-09-01T09:59:00+08:00", ["1", "2", "9"], 3), ("t", "g", "2026-09-01T09:59:00+08:00", ["1"], 1)], "scenario string, fit_id string, decision_at string, training_label_ids array<string>, fitted_rows long")
    account = spark.createDataFrame([(x, i, f"2026-09-0{i}T00:00:00Z", "1", "2", e) for x, e in (("s", "4"), ("t", "3")) for i in (1, 2)], "scenario string, seq long, observed_at string, cash string, position_value string, equity string")
    contract = spark.createDataFrame([(x, "fit", ["act"], 1, 1) for x in "st"], "scenario string, mode string, required_training_roles array<string>, minimum_resolved_labels int, minimum_resolved_market_labels int")
    want = spark.createDataFrame([("s", "5", 4), ("t", "5", 4)], "scenario string, window string, count int")
    have = spark.createDataFrame([("s", "5", 4), ("t", "5", 4)], "scenario string, window string, count int")
    found = {r.scenario: r for r in labels.readiness(contract, rows, fits, account, have, want).collect()}
    assert found["s"].blockers == ["s:account_balance_mismatch", "s:fit_consumed_unknown_label", "s:fit_consumed_unobservable_label"] and found["s"].training_rows == 2
    assert found["t"].ready and found["t"].blockers == []
    off = have.withColumn("count", F.when(F.col("scenario") == "t", 3).otherwise(F.col("count")))
    assert [r.blocker for r in labels.compare_maturity(want, off).collect()] == ["t:maturity_reference_mismatch"]
    assert "scenario_coverage_mismatch" in [r.blocker for r in labels.compare_maturity(want, have.limit(1)).collect()]


def panel(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date string, x double, unused long")


def test_snapshots(spark, tmp_path):
    store, say = str(tmp_path / "store"), dict.fromkeys(snapshots.SEMANTICS, "stated")
    rows = [("300001", "2026-07-01", 1.0, 1), ("300002", "2026-07-01", float("nan"), 2), ("300001", "2026-07-02", 3.0, 3), ("300002", "2026-07-02", -0.0, 4)]
    first = snapshots.freeze(store, {"a": panel(spark, rows)}, say)
    assert first["rows"] == 4 and first["objects"] == 2 and not first["cache_hit"]
    again = snapshots.freeze(store, {"a": panel(spark, rows[::-1]).repartition(3)}, say)
    assert again["snapshot_id"] == first["snapshot_id"] and again["added_bytes"] == 0 and again["cache_hit"]
    other = snapshots.freeze(store, {"a": panel(spark, rows)}, say | {"price_basis": "other"})
    assert other["snapshot_id"] != first["snapshot_id"] and other["added_bytes"] == 0
    more = snapshots.freeze(store, {"a": panel(spark, [*rows, ("300001", "2026-07-03", 5.0, 5)])}, say)
    assert more["objects"] == 3 and more["reused_bytes"] > 0 and snapshots.read_snapshot(spark, store, first["snapshot_id"]).count() == 4
    manifest = snapshots.snapshot_manifest({"a": panel(spark, rows)}, say)[1]
    assert snapshots.verify(panel(spark, rows), manifest).count() == 0
    assert [r.date for r in snapshots.verify(panel(spark, [*rows[:3], ("300002", "2026-07-02", 9.0, 4)]), manifest).collect()] == ["2026-07-02"]
    read = tables.selected(snapshots.read_snapshot(spark, store, more["snapshot_id"]), ["symbol", "x"], ["2026-07-02"], ["300001"])
    assert [tuple(r) for r in read.collect()] == [("300001", 3.0)]
    assert tables.selected(panel(spark, rows), ["x"], []).count() == 0
    for bad in (dict(columns=[]), dict(columns=["x", "x"]), dict(columns=["y"]), dict(columns=["x"], dates=["2026-7-2"]), dict(columns=["x"], symbols=["1"])):
        with pytest.raises(ValueError):
            tables.selected(panel(spark, rows), **bad)
    assert snapshots.freeze(store, {"a": panel(spark, [])}, say)["rows"] == 0
    for sources, words in (({"a": panel(spark, [("1", None, 1.0, 1)])}, say), ({"a": panel(spark, rows), "b": panel(spark, rows).drop("x")}, say), ({"a": panel(spark, rows)}, say | {"role": " "})):
        with pytest.raises(ValueError):
            snapshots.freeze(store, sources, words)


def test_snapshot_store(spark, tmp_path):
    store, say = str(tmp_path / "store"), dict.fromkeys(snapshots.SEMANTICS, "stated")
    rows = [("300001", "2026-07-01", 1.0, 1), ("300002", "2026-07-02", float("nan"), 2), ("300002", "2026-07-02", -0.0, 2)]
    # Sources with the same content share objects and keep their rows.
    two = snapshots.freeze(store, {"a": panel(spark, rows), "b": panel(spark, rows[:1])}, say, salt=3)
    assert two["objects"] == 3 and two["rows"] == 4
    assert snapshots.read_snapshot(spark, store, two["snapshot_id"]).count() == 4
    assert [r.symbol for r in snapshots.read_snapshot(spark, store, two["snapshot_id"], "b").collect()] == ["300001"]
    # A later snapshot with one more column does not change what the old one reads.
    snapshots.freeze(store, {"a": panel(spark, rows).withColumn("more", F.lit(1))}, say)
    assert snapshots.read_snapshot(spark, store, two["snapshot_id"], verified=True).columns == ["symbol", "date", "x", "unused"]
    none = snapshots.freeze(store, {"a": panel(spark, [])}, say)
    assert snapshots.read_snapshot(spark, store, none["snapshot_id"], verified=True).count() == 0
    # A run that ended after its objects: the next one writes them again, once.
    extra = panel(spark, [("300003", "2026-07-03", 2.0, 3)])
    cut = snapshots.freeze(store, {"a": extra}, say)
    for lost in ("objects_index", "manifests", "snapshots"):
        shutil.rmtree(f"{store}/{lost}")
    again = snapshots.freeze(store, {"a": extra}, say)
    assert again["snapshot_id"] == cut["snapshot_id"] and snapshots.read_snapshot(spark, store, again["snapshot_id"], verified=True).count() == 1
    # Doubled and missing content is refused.
    (stored,) = (tmp_path / "store/objects").glob(f"*/_digest={snapshots.date_digests(extra).first().digest}")
    (file,) = stored.glob("*.parquet")
    shutil.copy(file, stored / "part-copy.parquet")
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, store, again["snapshot_id"], verified=True)
    shutil.rmtree(stored)
    assert [(r.date, r.found) for r in snapshots.stored_errors(spark, store, again["snapshot_id"]).collect()] == [("2026-07-03", None)]
    for bad in (lambda: snapshots.read_snapshot(spark, store, "unknown"), lambda: snapshots.freeze(store, {"a": extra.withColumn("_digest", F.lit(1))}, say)):
        with pytest.raises(ValueError):
            bad()


def test_snapshot_reads_open_what_the_manifest_names(spark, tmp_path):
    store, say = str(tmp_path / "store"), dict.fromkeys(snapshots.SEMANTICS, "stated")
    rows = [(f"{s:06d}", f"2026-07-{d:02d}", float(s + d), s) for d in range(1, 9) for s in (range(100) if d == 1 else (d, 50 + d))]
    id = snapshots.freeze(store, {"a": panel(spark, rows)}, say)["snapshot_id"]
    digest = {r.date: r.digest for r in snapshots.scan_plan(spark, store, id).collect()}

    def opened(**query):
        df = snapshots.read_snapshot(spark, store, id, **query)
        return sorted(tuple(r) for r in df.collect()), {f.split("_digest=")[1].split("/")[0] for f in df.inputFiles() if "_digest=" in f}

    got, files = opened(columns=["symbol", "x"], dates=["2026-07-02", "2026-07-03"], symbols=["000002", "000053"])
    assert got == [("000002", 4.0), ("000053", 56.0)] and files == {digest["2026-07-02"], digest["2026-07-03"]}
    # Objects that list their symbols, or know their ends, are left alone.
    got, files = opened(columns=["x"], dates=["2026-07-01", "2026-07-02", "2026-07-03"], symbols=["000052"])
    assert got == [(53.0,), (54.0,)] and files == {digest["2026-07-01"], digest["2026-07-02"]}
    got, files = opened(dates=["2026-07-01", "2026-07-04"], symbols=["000200"])
    assert got == [] and files == set()
    assert opened(dates=[]) == ([], set()) and opened(dates=["2026-07-01"], symbols=[])[0] == [] and len(opened(symbols=["000050"])[0]) == 1
    assert len(opened(dates=["2026-07-01"])[0]) == 100 and len(opened(dates=["2027-01-01"])[0]) == 0 and opened(columns=["x"])[0] == sorted((r[2],) for r in rows)
    row = snapshots.scan_summary(snapshots.scan_plan(spark, store, id, ["2026-07-01", "2026-07-02"], ["000052"]), 1, 4).first()
    assert (row.files_selected, row.files_total, row.columns_selected) == (2, 8, 1) and 0 < row.bytes_selected < row.bytes_total
    for bad in (dict(columns=["missing"]), dict(columns=[]), dict(dates=["2026-7-2"]), dict(symbols=["1"]), dict(columns=["x", "x"], dates=[])):
        with pytest.raises(ValueError):
            snapshots.read_snapshot(spark, store, id, **bad)
    # Only what is opened is verified.
    shutil.rmtree(next((tmp_path / "store/objects").glob(f"*/_digest={digest['2026-07-05']}")))
    assert snapshots.read_snapshot(spark, store, id, verified=True, dates=["2026-07-02"]).count() == 2
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, store, id, verified=True, dates=["2026-07-05"])


def test_packs(spark, tmp_path):
    rows = [(f"u{i % 2}", "json", f"n{i}", bytearray(f"content {i}".encode())) for i in range(6)]
    df = spark.createDataFrame(rows, "unit string, kind string, name string, content binary").withColumn("sha256", F.sha2("content", 256))
    catalog = packs.publish(df, str(tmp_path / "pack"), max_members=2)
    assert catalog.select("part").distinct().count() == 3
    pack = spark.read.parquet(str(tmp_path / "pack"))
    assert packs.member_errors(pack).count() == 0 and packs.member_errors(pack.withColumn("content", F.lit(b"x"))).count() == 6
    assert packs.total_errors(catalog, {"artifacts": 6, "units": 2, "logical_bytes": 54}) == [] and packs.total_errors(catalog, {"units": 3}) == ["units"]
    assert [r.name for r in packs.lookup(pack, df.where("name in ('n1', 'n4')")).collect()] in (["n1", "n4"], ["n4", "n1"])
    assert packs.plan_parts(catalog.select("unit", "kind", "name", "bytes"), 100, 20).select("part").distinct().count() == 3
    for bad in (df.withColumn("sha256", F.lit("0")), df.union(df), df.limit(0)):
        with pytest.raises(ValueError):
            packs.publish(bad, str(tmp_path / "other"))
    receipts = catalog.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("name", "sha256"))).alias("artifacts"))
    assert packs.receipt_errors(receipts, catalog).count() == 0
    assert {r.error for r in packs.receipt_errors(receipts.union(receipts), catalog.where("name <> 'n0'")).collect()} == {"not_in_catalog", "receipt_count"}
    stage = spark.createDataFrame([("s", f"a{i}", "h", i + 1) for i in range(200)], "stage string, name string, sha256 string, bytes long")
    a, b = packs.inventory(stage).first(), packs.inventory(stage.orderBy(F.desc("bytes"))).first()
    assert a.artifacts == 200 and a.total_bytes == 200 * 201 // 2 and a.list_sha256 == b.list_sha256


def test_units(spark):
    plan = spark.createDataFrame([("b", "u1"), ("b", "u2"), ("c", "u1")], "binding string, unit string")
    sealed = spark.createDataFrame([("b", "u1")], "binding string, unit string")
    assert units.units_to_do(plan, sealed).count() == 2 and units.units_reused(plan, sealed).count() == 1
    stages = spark.createDataFrame([("r", "a", "failed"), ("r", "b", "blocked"), ("r", "c", "succeeded"), ("q", "a", "succeeded")], "run_id string, stage string, status string")
    found = {r.run_id: r for r in units.run_status(stages).collect()}
    assert found["r"].blocking_stages == ["a", "b"] and not found["r"].execution_complete and found["r"].settled and found["q"].execution_complete
    log = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 1, 1), ("y", 2, 3)], "attempt string, seq int, completed_units int")
    got = {r.attempt: r for r in units.progress(log).collect()}
    assert got["x"].nonmonotonic_progress and got["x"].last_good == 2 and not got["y"].nonmonotonic_progress
    jobs = spark.createDataFrame([("p", "r", s, u) for s, u in (("succeeded", True),) * 3 + (("failed", False),)], "plan string, role string, status string, reused boolean")
    row = units.batch_rollup(jobs).first()
    assert (row.total, row.finished, row.reused, row.failed, row.pending, row.complete) == (4, 3, 3, 1, 0, False)


def test_retention(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    seen, complete = retention.closure(edges, roots)
    assert complete and sorted(r.node for r in seen.collect()) == ["a", "b", "c", "d"]
    assert not retention.closure(edges, roots, max_rounds=1)[1]
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)] + [(None, "z"), ("3", None)], "src string, dst string")
    seen, complete = retention.closure(chain, spark.createDataFrame([("0",), (None,)], "node string"))
    assert complete and sorted(int(r.node) for r in seen.collect()) == list(range(13))
    assert retention.closure(chain, roots.limit(0))[0].count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("closure_")]
    wanted = spark.createDataFrame([(p,) for p in ("w/a", "w/a/b/c", "w/z", "w/ab", "w/LATEST_x", "w/q_latest.json")], "path string")
    held = spark.createDataFrame([("w/a/b",)], "path string")
    bad = {(r.path, r.reason) for r in retention.retirement_conflicts(wanted, held).collect()}
    assert bad == {("w/a", "referenced_or_protected"), ("w/a/b/c", "referenced_or_protected"), ("w/LATEST_x", "canonical_latest_not_retirable"), ("w/q_latest.json", "canonical_latest_not_retirable")}
    assert sorted(r.path for r in retention.retirable(wanted, held).collect()) == ["w/ab", "w/z"]
    assert retention.retirable(wanted, held, complete=False).count() == 0
    docs = spark.createDataFrame([("d1", 'see "workspace_out/runs/r1/x.json"; and run r2.'), ("d2", "data_lake\\t\\f.parquet,")], "path string, text string")
    found = {tuple(r) for r in retention.references(docs, spark.createDataFrame([("r2.",)], "name string")).collect()}
    assert found == {("d1", "workspace_out/runs/r1/x.json"), ("d1", "r2."), ("d2", "data_lake/t/f.parquet")}


def test_evidence_files(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("﻿label_id,status,value,available_at,training_role\n1,RESOLVED_MARKET,0.1,2026-01-01T00:00:00Z,act\n", encoding="utf-8")
    (tmp_path / "fits.jsonl").write_text('{"fit_id":"f","decision_at":"2026-01-01T00:00:00Z","training_label_ids":["1"],"fitted_rows":1,"model":{"path":"p","sha256":"s"}}\n\n')
    (tmp_path / "account.csv").write_text("observed_at,cash,position_value,equity\n2026-01-01T00:00:00Z,1,2,3\n")
    (tmp_path / "returns.csv").write_text("when,ret\n2026-01-01,0.1\n")
    assert tables.read_labels(spark, str(tmp_path / "labels.csv")).first().label_id == "1"
    assert tables.read_fits(spark, str(tmp_path / "fits.jsonl")).first().training_label_ids == ["1"]
    assert tables.read_account(spark, str(tmp_path / "account.csv")).first().equity == "3"
    assert tables.read_returns_csv(spark, str(tmp_path / "returns.csv"), "when", "ret").first().net_return == "0.1"
