import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import models, outcomes, research, signals, validation
from tidemark.sources import archive, stores

HEADER = ",".join(validation.HEADER)
ROW = "ABC.US,D,{},000000,{},{},{},{},{},0"


def frame(spark, n=300, gap=None, jump=None, close=lambda i: 100.0 + i):
    day, rows = dt.date(2020, 1, 1), []
    for i in range(n):
        c = float(close(i))
        rows.append(("US:NYSE:STOCKS:ABC", "ABC", "NYSE", "stocks", day, day.year * 10000 + day.month * 100 + day.day, i + 2 + (gap is not None and i >= gap), c - 0.5, c + 1, c - 1, c, 1000.0 + i))
        day += dt.timedelta(days=40 if jump == i else 1)
    return spark.createDataFrame(rows, "instrument_id string, ticker string, exchange string, instrument_class string, date date, signal_date int, source_row_number long, open double, high double, low double, close double, volume double")


def test_features_and_guards(spark):
    f = ft.features(ft.segments(frame(spark)))
    r = {x["history_bars"]: x for x in f.collect()}
    assert abs(r[260]["return_252"] - ((100 + 259) / (100 + 7) - 1)) < 1e-12
    first = {"return_20": 21, "sma_distance_50": 50, "realized_vol_10": 11, "atr_14_pct": 14, "volume_ratio_20_prior": 21, "distance_to_prior_high_60": 61, "efficiency_ratio_20": 21, "range_ratio_5_20": 20, "realized_vol_ratio_10_60": 61, "gap_return": 2, "return_252": 253}
    for name, k in first.items():
        assert r[k - 1][name] is None and r[k][name] is not None, name


def test_prefix_and_segments(spark):
    bars = frame(spark, 120)
    full = {x["signal_date"]: x.asDict() for x in ft.features(ft.segments(bars)).collect()}
    for x in ft.features(ft.segments(bars.orderBy("date").limit(80))).collect():
        assert full[x["signal_date"]] == x.asDict()
    s = ft.segments(frame(spark, 80, gap=40, jump=60))
    assert s.agg(F.max("segment_id")).first()[0] == 2
    row = ft.segment_summary(s).first()
    assert (row["segments"], row["source_gap_resets"], row["calendar_gap_resets"]) == (3, 1, 1)


CASES = [
    ("20200102", "10,11,9,10.5,1000", None), ("20200103", "10,9,8,10,1000", "high_below_ohlc"), ("20200103", "10,11,9,10.5,8153.6931763407", None), ("20200103", "10,11,9,10,1", "duplicate_date"),
    ("20200102", "10,11,9,10,1", "non_increasing_date"), ("20210229", "10,11,9,10,1", "invalid_date"), ("20200104", "10,11,9,10,nan", "non_finite_volume"), ("20200104", "inf,11,9,10,1", "non_finite_ohlc"),
    ("20200104", "0,11,9,10,1", "non_positive_ohlc"), ("20200104", "10,11,9,10,-1", "negative_volume"), ("20200104", "10,12,11,10,1", "low_above_ohlc"), ("20200104", "1_0,11,9,10,1", None), ("20200105", "10__0,11,9,10,1", "parse_error"), ("99999999999", "10,11,9,10,1", "invalid_date"), ("20200106", "10,11,9,é,1", "parse_error"), (" 20200107\t", "1e999,11,9,10,1", "non_finite_ohlc"), ("20200104", "10,11,9,10", "wrong_column_count"),
]


def test_validation(spark):
    rows = [("data/daily/us/nyse stocks/abc.us.txt", i + 2, ROW.format(d, *v.split(",")[:4], v.split(",")[4]) if v.count(",") == 4 else f"ABC.US,D,{d},000000,{v},0") for i, (d, v, _) in enumerate(CASES)]
    rows += [("data/daily/us/nyse stocks/abc.us.txt", 90, "XYZ.US,D,20200109,000000,1,1,1,1,1,0"), ("data/daily/us/nyse stocks/abc.us.txt", 91, "ABC.US,W,20200109,000000,1,1,1,1,1,0"), ("data/daily/us/nyse stocks/abc.us.txt", 92, "ABC.US,D,20200109,090000,1,1,1,1,1,0"), ("data/daily/us/nyse stocks/abc.us.txt", 93, " \t"), ("data/daily/us/nyse stocks/abc.us.txt", 94, " ABC.US,D,20200109,000000,1,1,1,1,1,0")]
    v = validation.validate(validation.classify_paths(spark.createDataFrame(rows, "member string, row_number long, line string")))
    got = {r["row_number"]: r["reason"] for r in v.collect()}
    assert [got[i + 2] for i in range(len(CASES))] == [c[2] for c in CASES]
    assert [got[i] for i in (90, 91, 92, 94)] == ["ticker_mismatch", "non_daily_period", "unexpected_time", "ticker_mismatch"] and 93 not in got
    assert validation.load_valid(v).count() == 3
    with pytest.raises(Exception, match="invalid row"):
        validation.load_valid(v, "raise").collect()


def test_cents_of_lines_round_as_their_sql(spark, tmp_path):
    from tidemark.plans.queries import QUERIES

    rows = [(3, i, 1, 1, 1.0, p, dt.datetime(2020, 1, i)) for i, p in enumerate((1029.995, 1030.0, 12.345, 1.125), 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = [r["open_tens"] for r in QUERIES["load_valid"](spark, str(tmp_path)).orderBy("row_number").collect()]
    assert made == [102, 103, 1, 0]
    assert [r["min_close"] for r in QUERIES["member_summary"](spark, str(tmp_path)).collect()] == [1.13]


def test_paths(spark):
    df = spark.createDataFrame([("data/daily/us/NASDAQ etfs/2/_prn.us.txt",), ("data/daily/uk/x.txt",)], "member string")
    a, b = validation.classify_paths(df).orderBy("member").collect()[::-1]
    assert (a["ticker"], a["instrument_id"], b["instrument_id"]) == ("PRN", "US:NASDAQ:ETFS:PRN", None)


@pytest.fixture
def zipped(tmp_path):
    path = str(tmp_path / "a.zip")
    folder = "data/daily/us/nyse stocks"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{folder}/abc.us.txt", f"\ufeff{HEADER}\r\n{ROW.format(20200102, 10, 11, 9, 10, 5)}\r\n\r\n{ROW.format(20200103, 10, 11, 9, 20, 0)}\r\n{ROW.format(20200103, 10, 11, 9, 10, 5)}\n")
        z.writestr(f"{folder}/bad.us.txt", f"X{HEADER}\n{ROW.format(20200102, 10, 11, 9, 10, 5)}\n")
        z.writestr(f"{folder}/empty.us.txt", "")
        z.writestr(f"{folder}/head.us.txt", HEADER)
        z.writestr(zipfile.ZipInfo(f"{folder}/xyz.us.txt"), HEADER + "\n" + "\n".join(ROW.replace("ABC", "XYZ").format(20200101 + i, 10, 12, 9, 11, 5) for i in range(9)))
        z.writestr("readme.md", "x")
    return path


def test_zip(spark, zipped):
    inv = {r["member"].rpartition("/")[2]: r for r in archive.inventory(spark, zipped).collect()}
    assert len(inv) == 6 and inv["abc.us.txt"]["classified"] and not inv["readme.md"]["is_txt"] and inv["empty.us.txt"]["size"] == 0 and inv["xyz.us.txt"]["compressed_size"] == inv["xyz.us.txt"]["size"]
    lines = archive.read_zip(spark, zipped)
    assert {r["member"].rpartition("/")[2]: r["header_valid"] for r in archive.headers(lines).collect()} == {"abc.us.txt": True, "bad.us.txt": False, "head.us.txt": True, "xyz.us.txt": True}
    v = validation.validate(validation.classify_paths(archive.data_lines(lines)), "header_valid")
    assert sorted((r["row_number"], r["reason"]) for r in v.collect() if "abc" in r["member"]) == [(2, None), (4, "high_below_ohlc"), (5, None)]
    assert {r["reason"]: r["rows"] for r in validation.reason_histogram(v, archive.headers(lines)).collect()}["invalid_header"] == 2
    assert archive.read_zip(spark, zipped, only=["readme.md"]).collect()[0]["line"] is None


def test_archive_is_packed_by_tasks(spark, tmp_path, monkeypatch):
    """Lines don't pass through the driver, and reading validates in one pass."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **b: pytest.fail("lines pass through the driver"))
    rows = spark.range(3000).select(F.format_string("data/daily/us/nyse stocks/s%d.us.txt", F.col("id") % 7).alias("member"), (F.col("id") + 2).alias("row_number"), F.format_string("S,%d,\u00e9", "id").alias("line"))
    path = f"file://{tmp_path}/x/p.zip"
    archive.write_zip(rows.orderBy(F.rand(1)), path, HEADER, [("data/daily/us/nyse stocks/none.us.txt", []), ("readme.md", ["x"])])
    with zipfile.ZipFile(tmp_path / "x" / "p.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 9
        for k in range(7):
            assert z.read(f"data/daily/us/nyse stocks/s{k}.us.txt").decode().split("\n") == [HEADER, *(f"S,{i},\u00e9" for i in range(k, 3000, 7)), ""]
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["p.zip"]
    lines = archive.read_zip(spark, path)
    data = archive.data_lines(lines)
    assert data.count() == 3000 and data.filter("not header_valid").count() == 0
    assert data._jdf.queryExecution().executedPlan().toString().count("BatchScan") <= 1
    assert {r["member"].rpartition("/")[2]: r["header_valid"] for r in archive.states(lines).collect()} == {f"s{k}.us.txt": True for k in range(7)}


def test_broken_member(spark, zipped, tmp_path):
    body = bytearray(open(zipped, "rb").read())
    at = body.index(b"XYZ.US,D,20200101")
    body[at] = ord("Y")
    (tmp_path / "b.zip").write_bytes(body)
    lines = archive.read_zip(spark, str(tmp_path / "b.zip"))
    assert [(r["member"].rpartition("/")[2], r["error"]) for r in archive.member_errors(lines).collect()] == [("xyz.us.txt", "ValueError: CRC differs")]
    assert archive.headers(lines).count() == 4


def label(spark, bars, direction, segment=(0, 0, 0, 0, 0)):
    rows = [("I", "T", "NYSE", "stocks", dt.date(2020, 1, 1) + dt.timedelta(i), 20200101 + i, i + 2, *map(float, b), segment[i], 0.01, 1 + i) for i, b in enumerate(bars)]
    f = spark.createDataFrame(rows, "instrument_id string, ticker string, exchange string, instrument_class string, date date, signal_date int, source_row_number long, open double, high double, low double, close double, segment_id int, atr_14_pct double, history_bars int")
    g = signals.EveryNth("every_nth", direction=direction, config={"modulus": 99})
    s = signals.materialize(type("First", (signals.EveryNth,), {"mask": lambda self: F.col("signal_date") == 20200101, "strength": lambda self: F.lit(1.0)})(g.setup_family, direction=direction), f)
    return outcomes.outcomes(s, f).first()


BARS = [(100, 101, 99, 100), (100, 104, 98, 102), (102, 105, 101, 104), (103, 106, 102, 105), (104, 107, 103, 106)]


def test_outcomes(spark):
    r = label(spark, BARS, "LONG")
    assert [round(r[f"h1_directional_{x}"], 9) for x in ("close_return", "mfe", "mae")] == [0.02, 0.04, -0.02]
    assert (r["stop_first_bar"], r["target_1r_first_bar"], r["barrier_1r_20_result"]) == (1, 1, "stop")
    short = label(spark, [BARS[0], (100, 102, 96, 97), *BARS[2:]], "SHORT")
    assert [round(short[f"h1_directional_{x}"], 9) for x in ("close_return", "mfe", "mae")] == [0.03, 0.04, -0.02] and short["barrier_1r_20_result"] == "stop"
    cut = label(spark, BARS, "LONG", (0, 0, 0, 1, 1))
    assert (cut["same_segment_bars_available"], cut["termination"], cut["h3_directional_close_return"]) == (2, "segment_boundary", None)
    none = label(spark, BARS[:1], "LONG")
    assert none["termination"] == "no_entry" and none["barrier_2r_20_result"] == "no_entry" and none["h1_end_date"] is None


def test_signal_without_its_bar(spark):
    f = spark.createDataFrame([("I", "T", "NYSE", "stocks", dt.date(2020, 1, 1) + dt.timedelta(i), 20200101 + i, i + 2, *map(float, b), 0, 0.01, 1 + i, 0.0) for i, b in enumerate(BARS)], "instrument_id string, ticker string, exchange string, instrument_class string, date date, signal_date int, source_row_number long, open double, high double, low double, close double, segment_id int, atr_14_pct double, history_bars int, return_1 double")
    s = signals.materialize(signals.EveryNth("every_bar", config={"modulus": 1}), f)
    count = lambda x: {r["check"]: r["violations"] for r in outcomes.bar_violations(x, f).collect()}
    assert set(count(s).values()) == {0} and outcomes.outcome_violations(outcomes.outcomes(s, f)).agg(F.sum("violations")).first()[0] == 0
    lost = s.withColumn("signal_source_row_number", F.when(F.col("signal_date") == 20200102, 99).otherwise(F.col("signal_source_row_number")))
    assert count(lost)["missing_bar"] == 1
    with pytest.raises(Exception, match="missing_bar"):
        outcomes.outcomes(lost, f).collect()
    with pytest.raises(Exception, match="entry_date"):
        outcomes.outcomes(s.withColumn("entry_date", F.when(F.col("signal_date") == 20200102, 20200105).otherwise(F.col("entry_date"))), f).collect()


def test_causality(spark):
    bars = frame(spark, 220, close=lambda i: 100 + (i * 37 % 11))
    full = lambda b: ft.features(ft.segments(b))
    f = full(bars)
    violations = lambda g, at: signals.causality(g, bars, at, full).agg(F.sum("violations")).first()[0]
    assert violations(signals.EveryNth("nth_probe"), (50, 100)) == 0
    assert violations(signals.TrendPullback("trend_pullback", config={"minimum_history_bars": 60, "minimum_return_20": -1.0, "pullback_from_high_min": -1.0, "pullback_from_high_max": 1.0, "maximum_atr_14_pct": 9.0, "minimum_log_dollar_volume": 0.0}), (100,)) == 0
    assert violations(signals.Peek("peeking"), (50, 100, 150)) > 0

    class Payload(signals.EveryNth):
        """A payload that tells how long the history is."""

        def prepare(self, b):
            from pyspark.sql import Window

            return b.withColumn("_all", F.count("*").over(Window.partitionBy("instrument_id")))

        def payload(self):
            return F.concat(F.lit('{"n":'), F.col("_all").cast("string"), F.lit("}"))

    assert violations(Payload("payload_probe"), (100,)) == 2
    one = signals.materialize(signals.EveryNth("nth_probe"), f)
    assert one.count() == 4
    with pytest.raises(Exception, match="twice"):
        signals.combine([one, one]).collect()
    with pytest.raises(ValueError):
        signals.Registry([signals.EveryNth("aa"), signals.EveryNth("aa")])


def test_generators_and_rows(spark):
    spec = {"class": "tidemark.operators.signals:EveryNth", "setup_family": "every_nth", "config": {"modulus": 50}}
    found = signals.load_registry({"generators": [spec]})
    assert [g.key for g in found] == ["every_nth|v1.0.0|LONG"]
    for bad in ({"class": "no_colon"}, spec | {"overlap_policy": "sometimes"}, spec | {"setup_version": "1.0"}, spec | {"description": " "}, spec | {"decision_time": "open"}, spec | {"required_features": ["a", "a"]}):
        with pytest.raises(ValueError):
            signals.load_generator(bad)
    with pytest.raises(TypeError):
        signals.load_generator({"class": "collections:OrderedDict"})
    with pytest.raises(ValueError):
        signals.canonical_json({"a": float("nan")})
    f = ft.features(ft.segments(frame(spark, 120)))
    rows = signals.canonical(signals.materialize(signals.EveryNth("every_nth", config={"modulus": 50}), f), "0" * 64)
    assert tuple(rows.columns) == signals.CANDIDATE_COLUMNS and rows.first()["candidate_id"].startswith("cand_")
    signals.require(signals.row_violations(rows), "rows")
    with pytest.raises(ValueError, match="strength"):
        signals.require(signals.row_violations(rows.withColumn("raw_setup_strength", F.lit(float("inf")))), "rows")
    signals.require(signals.signal_violations(signals.EveryNth("every_nth"), f), "signals")
    with pytest.raises(ValueError, match="only_bars"):
        signals.require(signals.context_violations(f, f.filter("signal_date <> 20200105")), "context")
    counts = {(r["kind"], r["value"]): r["n"] for r in signals.diagnostic_counts(rows).collect()}
    assert counts[("entry_status", "available")] == 2 and counts[("year", "2020")] == 2
    assert signals.diagnostics(rows.limit(0), f).first()["per_1000_bars"] == 0.0


def test_universe(spark):
    rows = spark.createDataFrame([("b", "NYSE", "stocks", 3), ("a", "NYSE", "etfs", 1), ("c", "NASDAQ", "stocks", 0), ("d", "NASDAQ", "stocks", 5)], "instrument_id string, exchange string, instrument_class string, valid_row_count long")
    ids = lambda **k: [r[0] for r in signals.select_universe(rows, **k).collect()]
    assert ids() == ["a", "b", "d"] and ids(exchange="nyse", instrument_class="STOCKS") == ["b"] and ids(explicit=["d", "c", "a"], require_rows=False, limit=2) == ["d", "c"]


def test_dates_have_to_rise(spark):
    b = frame(spark, 10)
    assert ft.increasing(b).count() == 10
    with pytest.raises(Exception, match="dates do not rise"):
        ft.increasing(b.withColumn("date", F.lit(dt.date(2020, 1, 1)))).collect()


def test_rank_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 0.1, 0.2, 1), ("b", 1, 0.1, -0.1, 0), ("c", 1, 0.3, 0.3, 1), ("d", 1, 0.0, -0.2, 0), ("e", 1, None, 9.0, 1)], "candidate_id string, g int, s double, y_return double, y_target int")
    r = research.rank_metrics(rows, "s", ["g"], 0.25).first()
    assert (r["n"], r["top_return"], r["bottom_return"], r["auc"], r["top_target_rate_lift"]) == (4, 0.3, -0.2, 0.875, 2.0)
    assert research.rank_metrics(rows.withColumn("y_target", F.lit(0)), "s", ["g"], 0.25).first()["top_target_rate_lift"] is None


def test_rank_metrics_over_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    score, value = rng.integers(0, 40, 700) / 40.0, rng.normal(size=700)
    rows = spark.createDataFrame([(f"c{i:04d}", 1 + i % 2, float(score[i]), float(value[i]), int(value[i] > 0.3)) for i in range(700)], "candidate_id string, g int, s double, y_return double, y_target int")
    got = {r["g"]: r for r in research.rank_metrics(rows, "s", ["g"]).collect()}

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for g in (1, 2):
        at = np.arange(g - 1, 700, 2)
        s, y, t = score[at], value[at], value[at] > 0.3
        order, k = np.lexsort((at, s)), -(-len(at) // 10)
        assert abs(got[g]["spearman"] - np.corrcoef(ranks(s), ranks(y))[0, 1]) < 1e-12
        assert abs(got[g]["top_return"] - y[order[-k:]].mean()) < 1e-12 and abs(got[g]["bottom_return"] - y[order[:k]].mean()) < 1e-12
        assert abs(got[g]["auc"] - ((s[t][:, None] > s[~t]).mean() + (s[t][:, None] == s[~t]).mean() / 2)) < 1e-12
        assert abs(got[g]["top_target_rate_lift"] - t[order[-k:]].mean() / t.mean()) < 1e-12


def test_gate_and_decision(spark):
    metrics = "setup_family string, n long, spearman double, top_return double, top_minus_mean double, auc double, top_target_rate double, base_target_rate double, top_target_rate_lift double"
    whole = spark.createDataFrame([("x", 2000, 0.03, 0.04, 0.01, 0.53, 0.28, 0.25, 1.12), ("y", 2000, 0.03, 0.04, 0.01, 0.53, 0.25, 0.25, 1.0)], metrics)
    folds = spark.createDataFrame([(f, 300, 0.02, 0.04, 0.01, 0.52, 0.3, 0.25, 1.2) for f in "xy" for _ in range(6)], metrics)
    gates = research.gate(whole, folds)
    assert {r["setup_family"]: (r["regression_pass"], r["classification_pass"]) for r in gates.collect()} == {"x": (True, True), "y": (True, False)}
    status = spark.createDataFrame([(f, str(i), "valid" if f == "x" or i < 2 else "insufficient_rows") for f in "xyz" for i in range(6)], "setup_family string, fold string, status string")
    got = {r["setup_family"]: (r["valid_folds"], r["decision"]) for r in research.decide(gates, status, 1000, 5).collect()}
    assert got == {"x": (6, "PROCEED_TO_SPECIALIST_RESEARCH"), "y": (2, "BASELINE_INCONCLUSIVE"), "z": (2, "BASELINE_INCONCLUSIVE")}


def test_research_query_shuffles_no_paths(spark, sf, monkeypatch):
    """Nothing is staged, and bars are dealt by instrument once."""
    from tidemark.plans import queries

    monkeypatch.setattr(queries, "stage", lambda *a: pytest.fail("features are staged"))
    plan = queries.q_research(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instrument_id") <= 1


def test_leakage(spark):
    rows = spark.createDataFrame([("a", "development", "development_pre2013", 0.1, 20100101, "target"), ("b", "development", "development_pre2013", None, None, "incomplete"), ("c", "development", "development_pre2013", 0.2, 20100101, "stop")], "candidate_id string, ticker_split string, temporal_partition string, h20_directional_close_return double, h20_end_date int, barrier_2r_20_result string")
    assert [(r["candidate_id"], r["y_target"]) for r in research.load_safe(rows).orderBy("candidate_id").collect()] == [("a", 1), ("c", 0)]
    for bad in (rows.withColumn("ticker_split", F.lit("integration_holdout")), rows.withColumn("temporal_partition", F.lit("pseudo_lockbox_2024_2026")), rows.union(rows)):
        with pytest.raises(ValueError, match="protected or repeated"):
            research.load_safe(bad)


def test_ensemble(spark):
    rows = [(f"c{i}", ("x", "y")[i % 2], float(i % 7), float(i % 5), int(i % 7 > 3), float(i % 7) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "candidate_id string, setup_family string, a double, b double, y_target int, y_return double")
    config = models.EnsembleConfig(("a",), ("b",), minimum_rows=100, iterations=2, depth=2, leaf_rows=5)
    model = models.GatedEnsemble(config).fit(df)
    assert [tuple(r) for r in model.specialist_metadata(spark).collect()] == [("x", 150, 2), ("y", 150, 2)]
    odd = df.withColumn("y_return", F.when(F.col("candidate_id") != "c1", F.col("y_return"))).withColumn("setup_family", F.when(F.col("candidate_id") != "c2", F.col("setup_family")))
    assert [r["train_rows"] for r in models.GatedEnsemble(config).fit(odd).specialist_metadata(spark).collect()] == [149, 149]
    for bad, why in ((df.limit(0), "no rows"), (df.withColumn("y_target", F.lit(1)), "both classes"), (df.limit(60), "no family")):
        with pytest.raises(ValueError, match=why):
            models.GatedEnsemble(config).fit(bad)
    with pytest.raises(ValueError, match="twice"):
        models.EnsembleConfig(("a", "a"), ("b",))
    out = model.predict(df.withColumn("setup_family", F.when(F.col("candidate_id") == "c0", "z").otherwise(F.col("setup_family"))))
    assert out.filter("score < 0 or score > 1").count() == 0 and out.filter("score is null and score_status = 'family_not_fitted'").count() == 1 and out.count() == 300
    with pytest.raises(ValueError, match="missing columns"):
        model.predict(df.drop("a"))


def test_model_queries_take_all_predictors(spark, sf, monkeypatch):
    from tidemark.plans import queries

    seen = []

    def walk(rows, columns, folds):
        assert set(columns) <= set(rows.columns)
        seen.append(columns)

    monkeypatch.setattr(models, "walk_forward", walk)
    monkeypatch.setattr(models.GatedEnsemble, "fit", lambda self, rows: seen.append(self.config) or self._need(rows, "y_target", "y_return"))
    queries.oof(spark, sf)
    queries.ensemble(spark, sf)
    columns, config = seen
    assert len(columns) == 37 and columns[0] == "raw_setup_strength" and tuple(columns) == config.feature_columns
    assert (config.iterations, config.depth) == (150, 4)


def test_ridge_parameter(spark):
    import numpy as np

    x = np.array([[0.0], [1.0], [2.0], [4.0]])
    y = np.array([1.0, 2.0, 2.5, 5.0])
    z = (x - x.mean()) / x.std()
    w = float((z[:, 0] @ (y - y.mean())) / (z[:, 0] @ z[:, 0] + 2.0))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y, strict=True)], "x double, y_return double")
    ready = models.Preparation(df, ["x"])
    assert abs(models.ridge(ready.apply(df), 2.0).coefficients[0] - w) < 1e-9


def test_coefficients_and_folds(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x, z = float(rng.normal()), float(rng.normal())
        rows.append((f"c{i}", "I", "fam", "LONG", 20100101 + i % 28, 20100201, "one", "train" if i < 160 else "test", x, z if i % 5 else None, 2 * x + 0.1 * float(rng.normal()), int(x > 0)))
    members = spark.createDataFrame(rows, "candidate_id string, instrument_id string, setup_family string, direction string, signal_date int, h20_end_date int, fold string, part string, raw_setup_strength double, z double, y_return double, y_target int")
    ready, line, odds = models.fitted(members, ["raw_setup_strength", "z"], "fam", "one")
    top = models.top_coefficients(ready, line)
    assert [t["feature"] for t in top][0] == "raw_setup_strength" and {t["feature"] for t in top} == {"raw_setup_strength", "z", "missing_z"} and len(models.top_coefficients(ready, odds, 1)) == 1
    oof = models.walk_forward(members, ["raw_setup_strength", "z"], [("fam", "one")]).collect()
    assert len(oof) == 80 and all(0 <= r["logistic_score"] <= 1 for r in oof) and models.walk_forward(members, ["z"], []).count() == 0


def test_store(spark, tmp_path):
    df = frame(spark, 20).select("instrument_id", "signal_date", "close")
    root = str(tmp_path / "store")
    stores.write_store(df, root, ["instrument_id", "signal_date"], "bars_v1")
    assert stores.verify_store(spark, root) == {"rows": True, "content": True, "duplicate_keys": 0}
    with pytest.raises(FileExistsError):
        stores.write_store(df, root, ["instrument_id", "signal_date"], "bars_v1")
    with pytest.raises(ValueError):
        stores.read_store(spark, root, "bars_v2")
    assert stores.compare_stores(df, stores.read_store(spark, root)).first().asDict() == {"only_a": 0, "only_b": 0}


def test_store_is_moved_aside_and_checked(spark, tmp_path):
    df = frame(spark, 20).select("instrument_id", "signal_date", "close")
    root, keys = str(tmp_path / "store"), ["instrument_id", "signal_date"]
    stores.write_store(df, root, keys, "bars_v1")
    stores.write_store(df.limit(5), root, keys, "bars_v1", replace=True)
    assert stores.read_store(spark, root, "bars_v1", ["close"], verify=True).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["store"]
    assert stores.verify_store(spark, root, "signal_date = 20200102")["protected_rows"] == 1
    df.limit(6).write.mode("overwrite").parquet(f"{root}/data")
    report = stores.verify_store(spark, root)
    assert not report["rows"] and not report["content"] and not stores.passed(report)
    with pytest.raises(ValueError, match="content"):
        stores.read_store(spark, root, verify=True)


def test_csv_cells(spark, tmp_path):
    values = [0.1, 1e-5, 123456789012345.0, 100.0, -2.5, 1 / 3, 0.0001, 1e12, 999999999999.5, 1e-300, 0.0, float("nan"), None, 12345.678901234567]
    rows = spark.createDataFrame([(i, v, [1, 2], "x" if i else None) for i, v in enumerate(values)], "i int, v double, a array<int>, s string")
    got = {r["i"]: r for r in stores.csv_cells(rows).withColumn("i", F.col("i").cast("int")).collect()}
    assert [got[i]["v"] for i in range(len(values))] == ["" if v is None else f"{v:.12g}" for v in values]
    assert (got[0]["a"], got[0]["s"], got[1]["s"]) == ("[1,2]", "", "x")
    stores.write_csv(rows, str(tmp_path / "t.csv"), ["i"])
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == len(values)
    stores.write_jsonl(rows.select("i"), str(tmp_path / "j"))
    stores.write_jsonl(rows.select("i").limit(1), str(tmp_path / "j"))
    assert stores.read_jsonl(spark, str(tmp_path / "j"), "i int").count() == len(values) + 1


def test_run(spark, tmp_path):
    from tidemark.plans.runs import Run, load_config

    r = Run(spark, str(tmp_path), "features", {"a": 1, "_b": 2})
    r.checkpoint(done=["x"])
    r.interrupt()
    again = Run(spark, str(tmp_path), "features", {"a": 1, "_b": 3}, r.path)
    assert again.last_checkpoint() == {"done": ["x"]} and len(again.manifest["lineage"]["source_tree_sha256"]) == 64
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path), "features", {"a": 2}, r.path)
    with pytest.raises(KeyError), again:
        raise KeyError("lost")
    assert again.folder.read_json("manifest.json")["status"] == "failed" and again.folder.read("events.jsonl").count("\n") == 4
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        load_config(str(tmp_path / "c.yaml"))


def test_catalog(spark, zipped, tmp_path):
    from tidemark.sources.catalog import Catalog

    names = "source_member,instrument_id,ticker,exchange,instrument_class,valid_row_count,invalid_row_count,first_date,last_date"
    own = "data/daily/us/nyse stocks/{0}.us.txt,US:NYSE:STOCKS:{1},{1},NYSE,stocks,{2},0,2020-01-01,2020-01-09"
    path = tmp_path / "m.csv"
    path.write_text("\n".join([names, own.format("xyz", "XYZ", 9), own.format("abc", "ABC", 2), own.format("empty", "NA", 0)]))
    c = Catalog(spark, zipped, str(path))
    assert [r["ticker"] for r in c.list(exchange="nyse").collect()] == ["ABC", "XYZ"] and c.load("US:NYSE:STOCKS:XYZ").count() == 9 and c.bars().count() == 11 and c.manifest.filter("ticker = 'NA'").count() == 1
    with pytest.raises(KeyError):
        c.member_for("US:NYSE:STOCKS:QQQ")
    with pytest.raises(Exception, match="invalid row"):
        Catalog(spark, zipped, str(path), "raise").bars().collect()
    path.write_text("\n".join([names, own.format("xyz", "XYZ", 9), own.format("abc", "XYZ", 2)]))
    with pytest.raises(ValueError, match="repeated instrument_id"):
        Catalog(spark, zipped, str(path))
    path.write_text(names.replace("exchange,", "") + "\n")
    with pytest.raises(ValueError, match="exchange"):
        Catalog(spark, zipped, str(path))


def test_builds_end_to_end(spark, tmp_path):
    """Audit, features, candidates, outcomes, research, verification, publication and the report, by the command line's functions."""
    import math

    from tidemark.__main__ import parser, run
    from tidemark.sources.files import Folder

    path = str(tmp_path / "a.zip")
    day = [dt.date(2008, 1, 1) + dt.timedelta(i) for i in range(400)]
    with zipfile.ZipFile(path, "w") as z:
        for t in ("AAA", "BBB", "CCC", "DDD"):
            price = [50 + ord(t[0]) % 7 + 8 * math.sin(i / 17 + ord(t[0])) + i / 50 for i in range(400)]
            body = "\n".join(f"{t}.US,D,{d:%Y%m%d},000000,{p:.4f},{p + 1:.4f},{p - 1:.4f},{p + 0.3:.4f},100000,0" for d, p in zip(day, price, strict=True))
            z.writestr(f"data/daily/us/nyse stocks/{t.lower()}.us.txt", f"{HEADER}\n{body}\nbroken\n")
        z.writestr("data/daily/us/nyse stocks/none.us.txt", "")
    go = lambda *words: run(parser().parse_args(list(words)), spark)

    def config(name, text):
        (tmp_path / f"{name}.yaml").write_text(text)
        return str(tmp_path / f"{name}.yaml")

    audit = config("audit", "module: {name: data, version: v1}\ndata: {archive_path: a.zip}\nexecution: {runs_root: runs}\npublication: {artifact_root: published/data}\n")
    first = go("data", "audit", "--config", audit)
    dry = go("data", "audit", "--config", audit, "--dry-run")
    second = go("data", "audit", "--config", audit)
    summary = Folder(spark, first).read_json("summary.json")
    assert (summary["audited_member_count"], summary["valid_row_count"], summary["empty_file_count"], summary["invalid_reason_counts"]) == (5, 1600, 1, {"wrong_column_count": 4})
    assert go("data", "compare", "--first", first, "--second", second, "--output", f"{second}/determinism_check.json")["deterministic_match"]
    assert go("data", "report", "--run", second, "--output", str(tmp_path / "r" / "report.md"))["accepted"] and not go("data", "report", "--run", dry, "--output", str(tmp_path / "r" / "dry.md"))["accepted"]
    assert "1,604" in (tmp_path / "r" / "report.md").read_text()
    assert go("data", "show", "--archive", path, "--member", "data/daily/us/nyse stocks/aaa.us.txt").count() == 5

    up = "archive_path: a.zip, symbol_manifest_path: published/data/symbol_manifest.csv"
    features = config("features", f"upstream: {{{up}}}\nexecution: {{runs_root: runs}}\n")
    made = go("features", "build", "--config", features)
    assert go("features", "verify", "--reference", made, "--output", str(tmp_path / "v.json"), "--config", features)["passed"]
    go("features", "publish", "--run", made, "--target", str(tmp_path / "published/features"))
    demo = "{class: 'tidemark.operators.signals:TrendPullback', setup_family: trend_pullback, config: {minimum_history_bars: 60, minimum_return_20: -1.0, pullback_from_high_min: -0.9, pullback_from_high_max: 0.5, maximum_atr_14_pct: 2.0, minimum_log_dollar_volume: 1.0}}"
    candidates = config("candidates", f"upstream: {{{up}, feature_root: published/features}}\ngenerators: [{demo}]\nexecution: {{runs_root: runs}}\n")
    made = go("candidates", "build", "--config", candidates)
    assert go("candidates", "verify", "--reference", made, "--output", str(tmp_path / "v.json"))["passed"]
    go("candidates", "publish", "--run", made, "--target", str(tmp_path / "published/candidates"))
    outcome = config("outcomes", "upstream: {feature_root: published/features, candidate_roots: [published/candidates]}\nexecution: {runs_root: runs}\n")
    made = go("outcomes", "build", "--config", outcome)
    assert go("outcomes", "verify", "--reference", made, "--output", str(tmp_path / "v.json"))["passed"]
    go("outcomes", "publish", "--run", made, "--target", str(tmp_path / "published/outcomes"))
    with pytest.raises(FileExistsError):
        go("outcomes", "publish", "--run", made, "--target", str(tmp_path / "published/outcomes"))
    with pytest.raises(ValueError, match="dry run"):
        go("candidates", "publish", "--run", go("candidates", "build", "--config", candidates, "--dry-run"), "--target", str(tmp_path / "published/candidates"))
    table = config("research", "upstream: {feature_root: published/features, candidate_roots: [published/candidates], outcome_root: published/outcomes}\nexecution: {runs_root: runs}\n")
    made = go("research", "build", "--config", table)
    report = go("research", "verify", "--reference", made, "--output", str(tmp_path / "v.json"))
    assert report["passed"] and report["protected_rows"] == 0
    base = config("base", "baseline: {minimum_train_rows: 100, minimum_test_rows: 30, ridge_alpha: 10.0, logistic_c: 0.1, minimum_oof_rows: 1000, minimum_valid_folds: 5}\nexecution: {runs_root: runs}\n")
    runs = [go("research", "baselines", "--config", base, "--research-root", made) for _ in range(2)]
    assert Folder(spark, runs[0]).read_json("summary.json")["protected_rows_accessed"] == 0
    assert go("research", "compare-baselines", "--first", runs[0], "--second", runs[1], "--output", str(tmp_path / "b.json"))["deterministic_match"]
    go("research", "publish-baselines", "--run", runs[0], "--target", str(tmp_path / "published/baselines"))


def test_doctor(tmp_path):
    from tidemark.plans.doctor import inspect

    (tmp_path / "c.yaml").write_text("data: {archive_path: missing.zip}\nexecution: {runs_root: runs}\n")
    found = inspect(configs=(str(tmp_path / "c.yaml"),))
    assert [c["name"] for c in found["checks"] if not c["passed"]] == ["config:c.yaml:data.archive_path"] and inspect()["passed"]


def test_boosting_is_that_of_mllib(spark):
    """Trees from one stage score as MLlib's do, whose every level is a job."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(11)
    x = rng.integers(0, 20, (900, 3)) / 3
    v = np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.2, 900)
    rows = [(i, "xy"[i % 3 == 0], *map(float, x[i]), int(v[i] + rng.normal() > 1), float(v[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, setup_family string, a double, b double, c double, y_target int, y_return double")
    df = df.withColumn("b", F.when(F.col("i") % 7 != 0, F.col("b"))).withColumn("c", F.when(F.col("i") == 5, float("nan")).otherwise(F.col("c")))
    config = models.EnsembleConfig(("a", "b", "c"), ("c",), iterations=20, depth=3, leaf_rows=10)
    got = {r["i"]: r for r in models.GatedEnsemble(config).fit(df).predict(df).collect()}
    for family in "xy":
        own = df.filter(F.col("setup_family") == family)
        ready = models.Preparation(own, ["a", "b", "c"], scale=False)
        made = ready.apply(own).cache()
        same = {"featuresCol": "features", "maxIter": 20, "maxDepth": 3, "minInstancesPerNode": 10, "stepSize": 0.05}
        odds, line = GBTClassifier(labelCol="y_target", **same).fit(made), GBTRegressor(labelCol="y_return", predictionCol="line", **same).fit(made)
        wanted = line.transform(odds.transform(made)).withColumn("p", vector_to_array("probability")[1]).select("i", "p", "line").collect()
        assert max(abs(got[r["i"]]["p_specialist"] - r["p"]) for r in wanted) < 1e-9 and max(abs(got[r["i"]]["predicted_return"] - r["line"]) for r in wanted) < 1e-9


def test_ensemble_is_one_stage(spark):
    """The jobs of a fit don't grow with its rounds."""
    rows = [(("x", "y")[i % 2], float(i % 7), float(i % 5), int(i % 7 > 3), float(i % 7) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "setup_family string, a double, b double, y_target int, y_return double")
    jobs = []
    for rounds in (2, 12):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        models.GatedEnsemble(models.EnsembleConfig(("a",), ("b",), minimum_rows=100, iterations=rounds, depth=2, leaf_rows=5)).fit(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_walk_forward_is_one_stage_with_mllibs_scores(spark):
    """Folds add no jobs, and scores are those of MLlib's models fitted one fold at a time."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x, z, k = float(rng.normal()), float(rng.normal()), float(rng.integers(0, 3))
        rows.append((f"c{i}", "I", "fg"[i % 2], "LONG", 20100101 + i % 28, 20100201, ("one", "two")[i // 300], "train" if i % 300 < 200 else "test", x, z if i % 5 else float("inf"), k if i % 4 else None, None, 2.5, x - z + float(rng.normal()), int(x + k + rng.normal() > 1)))
    names = "raw_setup_strength double, z double, k double, never double, always double"
    members = spark.createDataFrame(rows, f"candidate_id string, instrument_id string, setup_family string, direction string, signal_date int, h20_end_date int, fold string, part string, {names}, y_return double, y_target int")
    columns, jobs, got = [x.split()[0] for x in names.split(", ")], [], {}
    for pairs in ([("f", "one")], [(f, k) for f in "fg" for k in ("one", "two")]):
        spark.sparkContext.setJobGroup(f"folds {len(pairs)}", "")
        made = models.walk_forward(members, columns, pairs, 2.0, 0.5).collect()
        got |= {r["candidate_id"]: r for r in made}
        assert len(made) == 50 * len(pairs)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds {len(pairs)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    for family, fold in pairs:
        ready, line, odds = models.fitted(members, columns, family, fold, 2.0, 0.5)
        test = ready.apply(members.filter((F.col("setup_family") == family) & (F.col("fold") == fold) & (F.col("part") == "test")))
        for r in odds.transform(line.transform(test)).select("candidate_id", "ridge_score", vector_to_array("_p")[1].alias("p")).collect():
            own = got[r["candidate_id"]]
            # constant columns send MLlib to an iterative solver
            assert abs(own["ridge_score"] - r["ridge_score"]) < 1e-6 and abs(own["logistic_score"] - r["p"]) < 1e-5


def test_rows_pass_once_for_all_folds(spark):
    """Rows with their sets of folds give the scores of rows repeated by fold; what is not asked for is not fitted."""
    import numpy as np

    rng = np.random.default_rng(9)
    days = [20121001, 20121220, 20130301, 20141220, 20150105, 20160301, 20230401]
    rows = []
    for i in range(700):
        day, x = days[i % 7], float(rng.normal())
        rows.append((f"c{i}", "I", "fg"[i % 2], "LONG", day, day + (10000 if i % 11 == 0 else 5), x, x + float(rng.normal()), int(x + rng.normal() > 0)))
    rows = spark.createDataFrame(rows, "candidate_id string, instrument_id string, setup_family string, direction string, signal_date int, h20_end_date int, raw_setup_strength double, y_return double, y_target int")
    long, short = research.fold_members(rows, research.folds(spark)), research.fold_sets(rows)
    sets = {(r[0], r[1], r[2]) for r in short.selectExpr("candidate_id", "explode(train_folds) f", "'train'").collect()} | {tuple(r) for r in short.filter("fold is not null").selectExpr("candidate_id", "fold", "'test'").collect()}
    assert sets == {tuple(r) for r in long.select("candidate_id", "fold", "part").collect()}
    pairs = [(f, k) for f in "fg" for k in ("2015_2016", "2023")]
    a, b = ({r["candidate_id"]: r for r in models.walk_forward(x, ["raw_setup_strength"], pairs).collect()} for x in (long, short))
    assert a.keys() == b.keys() and a
    assert all(a[k]["fold"] == b[k]["fold"] and abs(a[k]["ridge_score"] - b[k]["ridge_score"]) < 1e-9 and abs(a[k]["logistic_score"] - b[k]["logistic_score"]) < 1e-9 for k in a)
    for name, other in (("ridge_score", "logistic_score"), ("logistic_score", "ridge_score")):
        only = models.walk_forward(short, ["raw_setup_strength"], pairs, scores=(name,)).collect()
        assert all(r[other] is None and r[name] == b[r["candidate_id"]][name] for r in only) and len(only) == len(b)


def test_arrays_have_what_window_functions_have(spark, sf):
    """Features and label of whole instruments as arrays, both directions and short histories too, are those of the window functions."""
    import numpy as np

    from tidemark.operators import dense
    from tidemark.plans import queries

    segmented = signals.with_entry(ft.segments(queries.bars(spark, sf, gap_after=60)))
    wanted = ["h20_end_date", research.RETURN, research.LABEL]
    for direction in ("LONG", "SHORT"):
        every = signals.EveryNth("every_bar", direction=direction, config={"modulus": 1})
        ahead = outcomes.forward(ft.features(segmented))
        a = outcomes.label(signals.signal_rows([every], ahead, (*(c for c in ahead.columns if c.startswith("_")), *ft.NAMES)))
        b = signals.signal_rows([every], dense.labelled_bars(segmented.drop("date"), direction), (*wanted, *ft.NAMES))
        a, b = ({r["candidate_id"]: r for r in x.select("candidate_id", *wanted, *ft.NAMES).collect()} for x in (a, b))
        assert a.keys() == b.keys() and len({r[research.LABEL] for r in a.values()}) > 3
        for k, r in a.items():
            assert (r["h20_end_date"], r[research.LABEL]) == (b[k]["h20_end_date"], b[k][research.LABEL])
            assert all((r[c] is None) == (b[k][c] is None) and (r[c] is None or np.isclose(r[c], b[k][c], 1e-9, 1e-12)) for c in (research.RETURN, *ft.NAMES)), k


def test_histograms_count_the_smaller_child_only():
    """Below the root at most half of the rows are counted, and all nodes still have their rows and sums."""
    import numpy as np

    from tidemark.operators import boosting

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    fit = boosting._Fit(bins, np.zeros(3), [np.arange(8) + 0.5] * 3, bins[0] + rng.normal(size=500), False, 3, 5, 0.1)
    fit.begin()
    for level in range(3):
        part = fit.histograms(level)
        assert part[0, 0].sum() <= (500 if level == 0 else 250)
        node = fit.node.copy()
        fit.split(level, part)
        for j in range(3):
            for i in range(1 << level):
                rows = node == i
                assert (fit.sums[0, j, i] == np.bincount(bins[j, rows], minlength=boosting.BINS)).all()
                assert np.allclose(fit.sums[1, j, i], np.bincount(bins[j, rows], fit.r[rows], boosting.BINS), atol=1e-9)


def test_labels_of_lines_are_those_of_bars(spark, sf):
    """Bars, segments, entries, features and labels made of sorted lines, several instruments at a time, are those of the window functions."""
    import numpy as np

    from tidemark.operators import dense
    from tidemark.plans import queries

    cols = ["instrument_id", "ticker", "exchange", "instrument_class", "segment_id", "history_bars", "signal_source_row_number", "entry_date", "entry_source_row_number", "historical_entry_status", "h20_end_date", research.LABEL, "generator_payload_json"]
    doubles = ["raw_setup_strength", research.RETURN, *ft.NAMES]
    ahead = outcomes.forward(signals.with_entry(ft.features(ft.segments(queries.bars(spark, sf, gap_after=60)))))
    a = outcomes.label(signals.signal_rows(list(queries.FAMILIES), ahead, (*(c for c in ahead.columns if c.startswith("_")), *ft.NAMES)))
    b = signals.signal_rows(list(queries.FAMILIES), dense.labelled_lines(queries.order_lines(spark, sf), 60), (*dense.LABELS, *ft.NAMES))
    a, b = ({r["candidate_id"]: r for r in x.select("candidate_id", *cols, *doubles).collect()} for x in (a, b))
    assert a.keys() == b.keys() and len({r[research.LABEL] for r in a.values()}) > 3
    for k, r in a.items():
        assert all(r[c] == b[k][c] for c in cols), k
        assert all((r[c] is None) == (b[k][c] is None) and (r[c] is None or np.isclose(r[c], b[k][c], 1e-9, 1e-12)) for c in doubles), k


def test_folds_of_a_family_share_their_passes(monkeypatch):
    """Medians, moments, ridge and logistic models of overlapping folds come from sums by sets of folds, in a few passes for all."""
    import numpy as np

    from tidemark.operators import linear
    from tidemark.operators.peers import Peers

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(900, 3)) * [1, 50, 1e-3] + [0, 1e6, 3], np.full((900, 2), [2.5, np.nan])], axis=1)
    x[rng.random(900) < 0.3, 0], x[:300][rng.random(300) < 0.1, 2] = np.inf, np.nan
    odds = np.where(np.isfinite(x[:, 0]), x[:, 0], 0.5) + (x[:, 1] - 1e6) / 50
    rows = np.concatenate([(odds + rng.normal(size=900))[:, None], (odds + rng.logistic(size=900) > 0.4)[:, None], x], axis=1)
    parts = {7: [rows[:100], rows[100:300]], 6: [rows[300:600]], 4: [rows[600:]]}
    passes, plain = [], linear.Family.rows

    def counted(self, sets):
        passes.extend(sets)
        return plain(self, sets)

    monkeypatch.setattr(linear.Family, "rows", counted)
    family = linear.Family(parts, 7, Peers())
    ready = [linear.Prepared(family, f) for f in range(3)]
    models = linear.logistic(ready, 0.5, Peers())
    assert max(passes.count(g) for g in range(3)) <= 9
    for f, r in enumerate(ready):
        own = rows[: 300 * (f + 1)]
        x = np.where(np.isfinite(own[:, 2:]), own[:, 2:], np.nan)
        middle = np.append(np.nanmedian(x[:, :4], axis=0), 0.0)
        assert (r.medians == middle).all() and r.flags.tolist() == [0, 2, 4]
        z = np.concatenate([np.where(np.isnan(x), middle, x), np.isnan(x)[:, r.flags]], axis=1)
        spread = z.std(axis=0)
        z = (z - z.mean(axis=0)) / np.where(spread > 1e-12, spread, 1.0)
        assert np.allclose(r.means[:3], np.where(np.isnan(x), middle, x).mean(axis=0)[:3], 1e-12) and np.allclose(r.deviations, np.where(spread > 1e-12, spread, 1.0), 1e-9)
        a = np.concatenate([np.ones((len(z), 1)), z], axis=1)
        w = np.linalg.lstsq(a.T @ a + np.diag([0.0, *[2.0] * z.shape[1]]), a.T @ own[:, 0], rcond=None)[0]
        assert np.allclose(r.margin(linear.ridge(r, 2.0), own[:, 2:]), a @ w, atol=1e-8)
        m = r.margin(models[f], own[:, 2:])
        assert np.abs(a.T @ (1 / (1 + np.exp(-m)) - own[:, 1]) + np.append(0.0, models[f][1:] / 0.5)).max() < 1e-6


def test_scores_share_the_ranks_of_returns(spark, monkeypatch):
    """Gates of several scores are those of each alone, and returns are ranked once a grouping; a score with gaps stays apart."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"c{i}", "fg"[i % 2], ("one", "two", "three")[i % 3], float(rng.integers(-9, 9)), int(rng.integers(0, 2)), float(rng.integers(0, 5)), float(rng.normal()), float(rng.normal()) if i % 4 else None) for i in range(400)]
    oof = spark.createDataFrame(rows, "candidate_id string, setup_family string, fold string, y_return double, y_target int, a double, b double, gaps double")
    for by in (["setup_family"], ["setup_family", "fold"]):
        got = {(r["score"], *(r[c] for c in by)): r for r in research.all_rank_metrics(oof, ["a", "b"], by).collect()}
        for name in "ab":
            for r in research.rank_metrics(oof, name, by).collect():
                own = got.pop((name, *(r[c] for c in by)))
                assert all(np.isclose(r[c], own[c], 1e-12, 1e-12) for c in r.asDict() if c not in by)
        assert not got
    ranked, plain = [], research._ranked
    monkeypatch.setattr(research, "_ranked", lambda *a: ranked.append(a[2]) or plain(*a))
    gates = research.score_gates(oof, ("a", "b", "gaps"))
    assert ranked.count("y_return") == 4 and gates.columns[-1] == "score"
    n = {(r["score"], r["setup_family"]): r["n"] for r in gates.collect()}
    assert n == {(s, f): 200 if s != "gaps" else sum(r[7] is not None for r in rows if r[1] == f) for s in ("a", "b", "gaps") for f in "fg"}
