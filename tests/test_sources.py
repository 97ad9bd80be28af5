import json

from barwright.config import Config
from barwright.operators import report
from barwright.sources import bars


def test_csv(spark, tmp_path):
    (tmp_path / "EURUSD_H1.csv").write_text("time,open,high,low,close,tick_volume,real_volume,spread\n2022-01-03T00:00:00,1,2,0.5,1.5,10,100,1\n2022-01-03T01:00:00,1.5,2,1,1.2,11,110,1\n")
    (tmp_path / "GBPUSD_M5.csv").write_text("time,open,high,low,close,tick_volume,real_volume,spread\n2022-01-03T00:05:00,1,1,1,1,1,1,1\n")
    df = bars.read_csv(spark, str(tmp_path))
    assert sorted((r.symbol, r.timeframe) for r in df.collect()) == [("EURUSD", "H1")] * 2 + [("GBPUSD", "M5")]
    assert bars.read_csv(spark, str(tmp_path), ["EURUSD"], "H1", "2022-01-03 01:00:00", "2022-01-03 01:00:00").count() == 1
    assert {r.symbol for r in bars.Resolver(spark, csv=str(tmp_path)).symbols().collect()} >= {"EURUSD", "USDJPY"}


def test_simulation_is_sound_and_repeats(spark):
    df = bars.simulate(spark, ["EURUSD", "USDJPY"], "H4", "2022-01-03", "2022-01-20")
    rows = df.collect()
    assert rows and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) and r.time.weekday() < 5 for r in rows)
    assert sorted(rows) == sorted(bars.simulate(spark, ["EURUSD", "USDJPY"], "H4", "2022-01-03", "2022-01-20").collect())


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "hour_12", 200, 0.01, 0.6, 1.5, True), ("a", "swing_3", 20, 0.5, 0.4, -1.0, False)], "symbol string, edge_key string, n long, p_value double, win_rate double, sharpe_ratio double, is_significant boolean")
    report.write_report(df, str(tmp_path / "r"))
    body = json.loads(next((tmp_path / "r" / "report").glob("part*")).read_text())
    assert body["total_edges"] == 2 and body["top"][0]["edge_key"] == "hour_12" and body["types"] == [{"edge_type": "structure", "total": 1, "significant": 0}, {"edge_type": "time_hour", "total": 1, "significant": 1}]
    assert spark.read.json(str(tmp_path / "r" / "results")).count() == 2
    assert "hour_12" in report.to_html(df) and report.significant(df).count() == 1


def test_config():
    c = Config.from_dict({"edges": {"lookahead": 5}})
    assert c.edges.lookahead == 5 and Config.from_dict(c.to_dict()) == c


def test_from_csv_to_edges(spark, tmp_path):
    """Two timeframes of one symbol and another symbol, from files to tests, are told apart."""
    from barwright.plans.edges import detect

    bars.simulate(spark, ["EURUSD", "USDJPY"], "H1", "2022-01-03", "2022-02-28").drop("timeframe").toPandas().groupby("symbol").apply(lambda g: g.assign(time=g.time.dt.strftime("%Y-%m-%dT%H:%M:%S")).drop(columns="symbol", errors="ignore").to_csv(tmp_path / f"{g.name}_H1.csv", index=False), include_groups=False)
    bars.simulate(spark, ["EURUSD"], "M15", "2022-01-03", "2022-01-20").drop("timeframe", "symbol").toPandas().assign(time=lambda g: g.time.dt.strftime("%Y-%m-%dT%H:%M:%S")).to_csv(tmp_path / "EURUSD_M15.csv", index=False)
    series = bars.to_series(bars.read_csv(spark, str(tmp_path))).cache()
    assert {r.symbol for r in series.select("symbol").distinct().collect()} == {"EURUSD|H1", "EURUSD|M15", "USDJPY|H1"}
    found = bars.by_series(detect(series))
    both = {(r.symbol, r.timeframe, r.edge_key): r for r in found.collect()}
    alone = {r.edge_key: r for r in detect(series.filter("symbol = 'EURUSD|M15'")).collect()}
    assert len({k[:2] for k in both}) == 3 and len(alone) > 40
    for key, r in alone.items():
        other = both["EURUSD", "M15", key]
        assert other.n == r.n and abs(other.mean_return - r.mean_return) < 2e-6
    rows = report.matrix(found).collect()
    assert {(r.symbol, r.timeframe) for r in rows} == {("EURUSD", "H1"), ("EURUSD", "M15"), ("USDJPY", "H1")} and all(r.total_edges > 40 for r in rows)


def test_overview_of_a_matrix(spark):
    rows = spark.createDataFrame(
        [("A", "H1", 4, "x", "time_hour", 2.0, 0.6), ("A", "H4", 0, "None", "-", 0.0, 0.0), ("B", "H1", 2, "y", "time_hour", 1.0, 0.5), ("B", "H4", 1, "z", "rsi", 3.0, 0.7)],
        "symbol string, timeframe string, significant_edges long, top_edge string, top_edge_type string, sharpe_ratio double, win_rate double",
    )
    got = {(r.view, r.name): (r.series, r.avg_significant, r.avg_sharpe, r.avg_win_rate) for r in report.overview(rows).collect()}
    assert got == {
        ("timeframe", "H1"): (2, 3.0, 1.5, 0.55), ("timeframe", "H4"): (2, 0.5, 1.5, 0.35), ("symbol", "A"): (2, 2.0, 1.0, 0.3), ("symbol", "B"): (2, 1.5, 2.0, 0.6),
        ("edge_type", "time_hour"): (2, 3.0, 1.5, 0.55), ("edge_type", "rsi"): (1, 1.0, 3.0, 0.7),
    }
    assert [(r.symbol, r.timeframe) for r in report.best_series(rows, 2).collect()] == [("B", "H4"), ("A", "H1")]


def test_html_with_data(spark):
    edges = spark.createDataFrame([("a", "hour_12", 200, 0.01, 0.6, 1.5, True)], "symbol string, edge_key string, n long, p_value double, win_rate double, sharpe_ratio double, is_significant boolean")
    series = spark.createDataFrame([("<b>", 1, 1.0, 2.0, 0.5, 1.5, 3.0), ("<b>", 2, 1.5, 4.0, 1.0, 2.0, 5.0)], "symbol string, t long, open double, high double, low double, close double, volume double")
    page = report.to_html(edges, bars=series)
    assert "<td>&lt;b&gt;</td><td>2</td><td>1</td><td>2</td><td>0.5</td><td>4.0</td><td>4.0</td>" in page and "<h2>Data</h2>" not in report.to_html(edges)
