"""Experiments, reports, command line, streams."""

from __future__ import annotations

import datetime
import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factorloom import cli, reports, translate
from factorloom.operators import evaluation
from factorloom.plans import experiment, formula, oos
from factorloom.sources import market
from factorloom.streaming import bars


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    assert reports.ledger(spark, path).count() == 0
    for i, p in enumerate((0.01, 0.04, 0.03)):
        reports.append(path, reports.Entry(f"e{i}", "f", p))
    got = {r["name"]: (round(r["p_bonferroni"], 9), round(r["p_bh"], 9)) for r in reports.ledger(spark, path).collect()}
    assert got == {"e0": (0.03, 0.03), "e1": (0.12, 0.04), "e2": (0.09, 0.04)}
    with pytest.raises(ValueError):
        reports.Entry("x", "f", 2.0)


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["card"]) == 0 and cli.main(["check", "rank(close)"]) == 0 and cli.main(["check", "rank(close, 1)"]) == 1
    assert cli.main(["idea", "buy low"]) == 2
    script = translate.Scripted(translate.Proposal(True, "nope(close)"), translate.Proposal(True, "-rank(close)"))
    assert cli.main(["idea", "buy low"], script) == 0 and capsys.readouterr().out.endswith("-rank(close)\n")
    assert cli.main(["quality", "--data", sf, "--out", str(tmp_path / "a")]) == 0
    assert cli.main(["validate", "--data", sf, "--out", str(tmp_path / "b"), "--min-names", "5", "-delta(close, 5)".join(["0", ""])]) == 0
    assert {"summary.md", "summary.html", "evidence.csv"} <= {p.name for p in (tmp_path / "b").iterdir()}
    assert reports.folder_digest(str(tmp_path / "a")) == reports.folder_digest(str(tmp_path / "a"))


def test_walk_forward(spark, sf):
    p = market.panel(spark, sf)
    f = evaluation.unpivot(formula.evaluate(p, formula.DEFAULTS), tuple(formula.DEFAULTS))
    spec = experiment.WalkForward.from_yaml("{horizon: 1, min_train: 150, test_size: 100, step: 100, min_names: 5, cost_bps: [0, 10]}")
    out = experiment.walk_forward(p, f, market.supplier_industry(spark, sf), spec)
    assert out.gates["no_label_overlap"] and out.tables["performance"].count() == 6
    tests = out.tables["folds"].filter("role = 'test'")
    assert out.tables["scores"].select("date").distinct().join(tests.select("date"), "date", "left_anti").count() == 0


def test_out_of_sample_report_files(spark, sf, tmp_path):
    p = market.panel(spark, sf)
    f = evaluation.unpivot(formula.evaluate(p, formula.DEFAULTS), tuple(formula.DEFAULTS))
    spec = experiment.WalkForward(1, 150, 100, 100, min_names=5, cost_bps=(0.0, 10.0))
    industry = market.supplier_industry(spark, sf)
    found = oos.report(experiment.walk_forward(p, f, industry, spec), p, industry, spec, 1.0, adv=p.select("date", "ticker", "adv20"), aum=(1e6, 1e7))
    files = {Path(x).name for x in oos.write(found, {"spec": spec}, str(tmp_path / "out"))}
    assert files == {f"{n}.csv" for n in set(found.tables) - set(oos.LONG)} | set(oos.LONG) | {"quality_report.json", "metadata.json", "report.md"}
    assert found.tables["fold_metrics"].count() == 3 * found.tables["fold_metrics"].select("fold").distinct().count() > 0
    assert found.tables["cost_stress"].count() == found.tables["capacity"].count() == 6 and found.tables["portfolio_scorecard"].count() == 3
    quality = json.loads((tmp_path / "out" / "quality_report.json").read_text())
    assert set(quality["gates"]) == {r["gate"] for r in found.gates.collect()} and quality["gates"]["zero_label_overlap"]
    assert "## Fold metrics" in (tmp_path / "out" / "report.md").read_text()
    with pytest.raises(ValueError, match="judged cost"):
        oos.report(experiment.Result({}), p, industry, spec, 1.0, cost_bps=7.0)


def test_experiment_of_variants_by_hand(spark):
    """Dates on which no name has an industry have no neutral values; a cap under a name's share makes a date infeasible."""
    r, n, names = random.Random(5), 30, [f"T{i:02}" for i in range(20)]
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=i), i + 1, t, r.gauss(0, 1) if i < 24 or k < 5 else None, r.gauss(0, 0.01), 100 + r.random()) for i in range(n) for k, t in enumerate(names)]
    panel = spark.createDataFrame(rows, "date date, pos int, ticker string, value double, returns double, close double")
    industry = spark.createDataFrame([(t, "ab"[k % 2] if k < 15 else None) for k, t in enumerate(names)], "ticker string, industry string")
    found = oos.variants(panel, panel, industry, oos.Experiment(horizon=1, min_names=10, max_weight=0.4))
    gates = {g["gate"]: g for g in found.gates.collect()}
    assert gates["classification_coverage"]["value"] == 0.75 and not gates["classification_coverage"]["passed"]
    assert math.isclose(gates["neutralization_dates"]["value"], 24 / 30) and not gates["neutralization_dates"]["passed"]
    assert gates["industry_exposure"]["passed"] and gates["label_overlap"]["passed"] and gates["variants_present"]["passed"]
    got = {m["variant"]: m for m in found.tables["portfolio_metrics"].collect()}
    # 20 names: 4 a side, a quarter each; 5 names on the last 6 dates: one a side, over the cap
    assert got["raw"]["invalid_weight_dates"] == 6
    # industries of 8 and 7 names: one a side in each, so a half each, over the cap; the last dates hold nothing, which is feasible
    assert got["neutralized"]["invalid_weight_dates"] == 24 and got["neutralized"]["average_turnover"] == 0
    with pytest.raises(ValueError):
        oos.Experiment(max_weight=0)


def test_charts(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "<c>", None)], "left string, right string, value double")
    hot = reports.heatmap(reports.small(pairs))
    assert hot.count("<rect") == 9 and hot.count("0.50<") == 2 and hot.count("1.00<") == 3 and hot.count("#eee") == 4 and "<c>" not in hot
    assert reports.shade(0.0) == "rgb(255,255,255)" and reports.shade(5) == reports.shade(1.0) != reports.shade(-1.0)
    by = spark.createDataFrame([("f", 1, 0.1), ("f", 5, 0.2), ("g", 1, -0.1), ("g", 5, None), ("g", 10, 0.3)], "factor string, horizon int, ic_mean double")
    page = reports.scorecard_html("a < b", by.select("factor", "ic_mean"), pairs, by, by.select(F.col("horizon").alias("every"), F.col("ic_mean").alias("gross_sharpe"), F.col("ic_mean").alias("net_sharpe")).filter("factor = 'f'"))
    assert "a &lt; b" in page and "<script" not in page and "<h2>Rebalancing</h2>" in page
    # f is one line; g has a gap, so two points
    assert page.split("IC by horizon")[1].split("<h2>")[0].count("<polyline") == 1 and page.split("IC by horizon")[1].split("<h2>")[0].count("<circle") == 2
    assert reports.lines(reports.small(by.filter("ic_mean is null").select("horizon", "ic_mean")), "horizon") == "<p>no numbers</p>"


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert reports.fingerprint(a) == reports.fingerprint(a.orderBy(F.desc("id")).select("x", "id")) != reports.fingerprint(a.limit(99))


def test_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    q = bars.stream_bars(bars.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    batch = bars.stream_bars(spark.read.schema(bars.EVENTS).parquet(f"{sf}/events.parquet"))
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))
