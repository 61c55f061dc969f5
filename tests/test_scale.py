"""How much is shuffled: steps that all queries share read a date's or a ticker's rows once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from factorloom.operators import crosssection as xs
from factorloom.operators import evaluation as ev
from factorloom.operators import portfolio as pf
from factorloom.operators import redundancy as rd


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, dates: int = 12, names: int = 40):
    rng = random.Random(3)
    some = lambda: None if rng.random() < 0.1 else float(rng.randint(1, 15))
    rows = [(d + 1, t, rng.uniform(5, 9), rng.uniform(-0.1, 0.1), some(), some(), some()) for d in range(dates) for t in range(names)]
    df = spark.createDataFrame(rows, "pos int, ticker long, close double, returns double, a double, b double, c double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos")))


def near(got, want, key: int) -> None:
    got, want = sorted(map(tuple, got)), sorted(map(tuple, want))
    assert [r[:key] for r in got] == [r[:key] for r in want] and got
    assert all(abs(x - y) < 1e-9 for g, w in zip(got, want, strict=True) for x, y in zip(g[key:], w[key:], strict=True))


def test_ranks_take_one_shuffle(spark):
    ranked = panel(spark).select("date", "a", xs.mean_rank(F.col("a")).alias("r"))
    assert plan(ranked).count("Exchange hashpartitioning") == 1
    for _, rows in ranked.toPandas().groupby("date"):
        assert (rows["r"].fillna(0) == rows["a"].rank().fillna(0)).all()


def test_wide_ics_are_those_of_long_factors(spark):
    p = panel(spark)
    wide = ev.Wide(p, {n: n for n in "abc"})
    for method in ("spearman", "pearson"):
        got = wide.ic((1, 2), method, 20)
        assert plan(got).count("Exchange hashpartitioning(date") == 1 and "Join" not in plan(got)
        want = ev.ic(wide.long(), ev.forward_returns(p, (1, 2)), method, 20)
        near(got.select("date", "factor", "horizon", "n", "ic").collect(), want.select("date", "factor", "horizon", "n", "ic").collect(), 4)


def test_correlations_of_a_date_take_one_shuffle(spark):
    p = panel(spark)
    wide = ev.Wide(p, {n: n for n in "abc"})
    got = rd.daily_correlation(None, 20, wide)
    assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got)
    near(got.collect(), rd.daily_correlation(wide.long(), 20).collect(), 3)
    want = {(d, x, y): c for d, g in p.toPandas().groupby("date") for x, y in (("a", "b"), ("a", "c"), ("b", "c")) for c in [g[[x, y]].dropna().rank().corr().iloc[0, 1]]}
    near(got.collect(), [(*k, v) for k, v in want.items()], 3)


def test_trades_of_targets_that_carry_returns(spark):
    p = panel(spark).withColumn("value", F.col("a"))
    want = pf.executed(pf.buffered_targets(p, every=3), p).select("date", "ticker", "w", "dw", "ret")
    got = pf.executed_targets(pf.buffered_targets(p, every=3, also=("returns",))).select("date", "ticker", "w", "dw", "ret")
    assert "Join" not in plan(got)
    near(got.collect(), want.collect(), 2)
    assert got.filter("w <> 0").count() > 0


def test_technical_factors_roll_over_arrays(spark):
    from factorloom.functions import technical

    rng = random.Random(5)
    px = lambda: None if rng.random() < 0.05 else rng.uniform(1, 9)
    rows = [(t, d, px(), px(), px(), px(), float(rng.randint(0, 9))) for t in (1, 2) for d in range(300)]
    bars = spark.createDataFrame(rows, "ticker long, d int, open double, high double, low double, close double, volume double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    got = technical.technical(bars)
    assert "Window" not in plan(got) and plan(got).count("Exchange") == 1
    b, g = bars.toPandas().sort_values(["ticker", "date"]), got.toPandas().sort_values(["ticker", "date"])
    high, volume = b.groupby("ticker")["high"].shift(1), b["volume"].where(b["volume"] > 0)
    assert g["price_volume_corr"].notna().sum() > 100
    for t in (1, 2):
        import numpy as np

        mine, x, y = g[g["ticker"] == t], np.log(high[b["ticker"] == t].astype(float)), np.log1p(volume[b["ticker"] == t])
        x, y = x.where(y.notna()), y.where(x.notna())
        want = x.rolling(237, min_periods=118).corr(y).to_numpy()
        assert np.allclose(mine["price_volume_corr"].to_numpy(float), want, atol=1e-9, equal_nan=True)
        close = b.loc[b["ticker"] == t, "close"].astype(float)
        assert np.allclose(mine["median_reversion"].to_numpy(float), (close.rolling(40, min_periods=20).median() / close).to_numpy(), atol=1e-9, equal_nan=True)


def test_fills_read_no_frame_anew(spark):
    from factorloom.operators import quality

    rows = [(1, d, v) for d, v in enumerate((None, None, 3.0, None, None, 6.0, None))] + [(2, 0, None), (2, 1, None)]
    bars = spark.createDataFrame(rows, "ticker long, d int, close double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    for method, want in (("forward_fill", [3.0, 3.0, 3.0, 3.0, 3.0, 6.0, 6.0]), ("interpolate", [None, None, 3.0, 4.0, 5.0, 6.0, 6.0])):
        got = quality.fill(bars, ("close",), method)
        assert "currentrow$(), unboundedfollowing$()" not in plan(got).lower()
        values = [r["close"] for r in got.orderBy("ticker", "date").collect()]
        assert values == [*want, None, None]


def test_wide_groups_are_those_of_long_factors(spark):
    p = panel(spark)
    wide = ev.Wide(p, {n: n for n in "abc"})
    got, keys = wide.groups(2, 4, 20), ("date", "factor", "horizon", "bucket", "names", "mean_return")
    assert "Join" not in plan(got)
    near(got.select(*keys).collect(), ev.quantile_groups(wide.long(), ev.forward_returns(p, (2,)), 4, 20).select(*keys).collect(), 5)


def test_short_windows_are_no_frames(spark):
    import numpy as np

    from factorloom.operators.timeseries import Frame

    rng = random.Random(7)
    rows = [(t, d + 1, 0.1 if 20 <= d < 40 else None if rng.random() < 0.04 else rng.uniform(1, 2) + 1e6 * t, None if rng.random() < 0.04 else float(rng.randint(1, 3))) for t in (0, 1) for d in range(120)]
    f = Frame(spark.createDataFrame(rows, "ticker long, pos int, a double, b double"))
    c, s = f.correlation(F.col("a"), F.col("b"), 6), f.stddev(F.col("a"), 5)
    got = f.df.select("ticker", "pos", "a", "b", c.alias("c"), s.alias("s"))
    assert "covar_pop" not in plan(got) and "stddev" not in plan(got)
    for _, g in got.toPandas().sort_values("pos").groupby("ticker"):
        a, b, c, s = (g[n].to_numpy(float) for n in "abcs")
        assert (s[24:40] == 0).all() and np.isnan(c[25:40]).all()
        for i in range(len(a)):
            x, y = a[max(0, i - 5):i + 1], b[max(0, i - 5):i + 1]
            whole = len(x) == 6 and not np.isnan(x + y).any() and x.min() < x.max() and y.min() < y.max()
            assert np.isnan(c[i]) if not whole else abs(c[i] - np.corrcoef(x, y)[0, 1]) < 1e-7
            x = a[max(0, i - 4):i + 1]
            assert np.isnan(s[i]) if len(x) < 5 or np.isnan(x).any() else abs(s[i] - np.std(x, ddof=1)) < 1e-7


def test_dense_panel_joins_nothing(spark):
    from factorloom.sources import market

    rows = [(1, 3, 1.0), (1, 5, 2.0), (2, 2, 3.0), (2, 6, 4.0), (3, None, 5.0), (None, 2, 6.0), (4, None, 7.0), (4, 2, 8.0)]
    bars = spark.createDataFrame(rows, "ticker long, d int, close double").select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "close")
    want = {(t, k): next((c for u, e, c in rows if u == t and e == d and t is not None), None) for t in (1, 2, 3, 4, None) for k, d in enumerate((2, 3, 5, 6), 1)}
    for got in (market.densify(bars), market.densify(bars, bars)):
        assert "Join" not in plan(got)
        found = [((r["ticker"], r["pos"]), r["close"], r["date"].day - 1) for r in got.collect()]
        assert len(found) == 20 and {k: c for k, c, _ in found} == want and {(k[1], d) for k, _, d in found} == {(1, 2), (2, 3), (3, 5), (4, 6)}


def test_bars_are_shuffled_by_ticker_once(spark, sf):
    from factorloom.sources import market

    assert plan(market.panel(spark, sf)).count("Exchange hashpartitioning") == 1


def test_forward_returns_of_the_rows(spark):
    p = panel(spark)
    ready = ev.Wide(p.withColumn("_ahead", ev.forward(2)).localCheckpoint(), {n: n for n in "abc"}, {2: "_ahead"})
    got = ready.ic((2,), "spearman", 20)
    assert "Window" not in plan(got) and plan(got).count("Exchange") == 1
    near(got.select("date", "factor", "horizon", "n", "ic").collect(), ev.Wide(p, ready.names).ic((2,), "spearman", 20).select("date", "factor", "horizon", "n", "ic").collect(), 4)


def test_variants_of_rows_that_have_all(spark, monkeypatch):
    from factorloom.plans import oos

    p, spec = panel(spark, 60).withColumn("value", F.col("a")), oos.Experiment(2, 10, max_weight=0.2)
    industry = p.select("ticker", (F.col("ticker") % 3).cast("string").alias("industry")).distinct().filter("ticker > 3")
    want = oos.variants(p, p, industry, spec)
    kept = []
    monkeypatch.setattr(oos, "keep", lambda df: kept.append(plan(df)) or df.localCheckpoint())
    got = oos.variants(p.join(industry, "ticker", "left").withColumn("fwd", ev.forward(2)), None, None, spec)
    assert "FullOuter" not in kept[0] and kept[0].count("Exchange hashpartitioning(date") == 1
    for name in want.tables:
        assert got.tables[name].orderBy("variant").collect() == want.tables[name].orderBy("variant").collect()
    assert got.gates.collect() == want.gates.collect()


def test_winsorize_joins_nothing(spark):
    assert "Join" not in plan(xs.winsorize(panel(spark).withColumnRenamed("a", "value")))


def test_clusters_make_the_panel_once(spark, sf, monkeypatch):
    from factorloom import queries
    from factorloom.sources import market

    made, real = [], market.panel
    monkeypatch.setattr(market, "panel", lambda *a: made.append(a) or real(*a))
    queries.QUERIES["corr_clusters"](spark, sf)
    assert len(made) == 1


def test_more_rows_make_more_tasks(spark, sf, monkeypatch):
    import re

    from factorloom import queries
    from factorloom.sources import market, shared

    dealt = lambda df: re.findall(r"Exchange hashpartitioning\((\w+)#.*?, (\d+)\)", plan(df))
    few, usual = queries._wide(spark, sf, queries.CANDIDATES), spark.conf.get("spark.sql.shuffle.partitions")
    assert [n for _, n in dealt(few.df)] == [usual] * 3
    aware = queries.QUERIES["select_corr_aware"](spark, sf).collect()
    monkeypatch.setattr(shared, "ROWS", 800)
    n = str(-(-market.line_count(spark, sf) // 800))
    assert int(n) > int(usual)
    wide = queries._wide(spark, sf, queries.CANDIDATES)
    assert dealt(wide.df) == [("ticker", n), ("date", n), ("ticker", n)]
    ready = ev.Wide(wide.df.localCheckpoint(), wide.names, rows=wide.rows)
    assert dealt(rd.daily_correlation(None, 2, ready)) == [("date", n)]
    near(rd.daily_correlation(None, 2, ready).collect(), rd.daily_correlation(None, 2, few).collect(), 3)
    train = ready.df.select(F.lit(0).alias("fold"), "date", "pos").distinct()
    shares = lambda rows: rd.rank_changes(ready.long(), ready.df, train, 5, 2, rows)
    assert {("date", "7"), ("factor", "7")} <= set(dealt(shares(7 * 800))) and "7" not in dict(dealt(shares(None))).values()
    near(shares(7 * 800).collect(), shares(None).collect(), 2)
    assert sorted(map(str, queries.QUERIES["select_corr_aware"](spark, sf).collect())) == sorted(map(str, aware))


def test_scanned_rows_are_sent_unsorted(spark, monkeypatch):
    from factorloom.sources import shared

    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda n: shared.tasks(spark, n * shared.ROWS, scanned=True)
    assert [of(1), of(usual), of(usual + 1), of(200), of(201), of(800), of(804)] == [(), (), (usual + 1,), (200,), (200,), (200,), (201,)]
    assert shared.tasks(spark, 201 * shared.ROWS) == (201,)
    monkeypatch.setattr(shared, "UNSORTED", usual - 1)
    assert of(1) == (usual - 1,)


def test_candidates_carry_their_returns(spark, sf):
    from factorloom import queries

    wide, ics, *_ = queries._candidates(spark, sf)
    assert "Window" not in plan(wide.ic((5,), min_names=2))
    near(wide.ic((5,), min_names=2).select("date", "factor", "n", "ic").collect(), ev.Wide(wide.df, wide.names).ic((5,), min_names=2).select("date", "factor", "n", "ic").collect(), 3)


def test_trades_keep_no_names(spark, monkeypatch):
    """Ties, missing values, names without an industry, rows that aren't there and a fold without weights: as the portfolios of the scores themselves."""
    from factorloom.operators import selection
    from factorloom.plans import experiment

    p = panel(spark, 60).filter("not (ticker = 7 and pos % 4 = 0)").localCheckpoint()
    industry = p.select("ticker", (F.col("ticker") % 3).cast("string").alias("industry")).distinct().filter("ticker > 3").localCheckpoint()
    spec = experiment.WalkForward(horizon=2, min_train=9, test_size=12, step=12, min_names=20, every=3, cost_bps=(0.0, 10.0))
    folds = selection.purged_folds(p, 9, 12, 12, 2)
    weights = spark.createDataFrame([("x", f, n, d, w) for f in range(4) for n, d, w in (("a", 1, 0.7), ("b", -1, 0.3))] + [("y", 1, "c", -1, 1.0), ("y", 3, "a", 1, 1.0)], "pool string, fold int, factor string, direction int, weight double")
    kept = []
    monkeypatch.setattr(experiment, "keep", lambda df: kept.append((df.columns, plan(df))) or df.localCheckpoint())
    wide = ev.Wide(p.withColumn("_ahead", ev.forward(2)).localCheckpoint(), {n: n for n in "abc"}, {2: "_ahead"})
    t = experiment.trade(p, wide.long(), F.broadcast(industry), folds, weights, ("x", "y"), spec, wide)
    assert not any("ticker" in c for c, _ in kept)
    assert [k.count("Exchange hashpartitioning(ticker") for c, k in kept if "marks" in c or "now" in c] == [0, 1]
    by, key = ("pool", "path"), ("pool", "path", "date", "ticker")
    targets = pf.buffered_targets(t.scores, every=3, by=by, also=("returns",)).localCheckpoint()
    near(t.targets.select(*key, "action", "w").collect(), targets.select(*key, "action", "w").collect(), 5)
    assert {r["action"] for r in targets.select("action").distinct().collect()} == {"rebalance", "hold_invalid", "hold_schedule"}
    moves = pf.executed_targets(targets, by)
    near(t.moves.select(*key, "ret", "w", "dw").collect(), moves.select(*key, "ret", "w", "dw").collect(), 4)
    daily = (*by, "date", "pos", "cost_bps", "gross", "turnover", "net")
    near(t.daily.select(*daily).collect(), pf.simulate(moves, (0.0, 10.0), by).select(*daily).collect(), 5)
    ics = ev.ic(t.scores.select("date", "ticker", F.concat_ws("/", *by).alias("factor"), "value"), ev.forward_returns(p, (2,)), min_names=20)
    near(t.ics.select("date", F.concat_ws("/", "pool", "factor").alias("factor"), "horizon", "n", "ic").collect(), ics.select("date", "factor", "horizon", "n", "ic").collect(), 4)
    held = moves.join(industry, "ticker").groupBy(*by, "date", "industry").agg(F.sum("w"))
    near(t.exposures.select(*by, "date", "industry", "exposure").collect(), held.collect(), 4)


def test_ics_and_correlations_take_one_shuffle(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rd, "keep", lambda df: made.append(plan(df)) or df.localCheckpoint())
    wide = ev.Wide(panel(spark).withColumn("_ahead", ev.forward(2)).localCheckpoint(), {n: n for n in "abc"}, {2: "_ahead"})
    ics, pairs = rd.daily_evidence(wide, 2, 20)
    assert [k.count("Exchange") for k in made] == [1]
    near(ics.select("date", "factor", "ic").collect(), wide.ic((2,), "spearman", 20).select("date", "factor", "ic").collect(), 2)
    near(pairs.collect(), rd.daily_correlation(None, 20, wide).collect(), 3)


def test_ablation_keeps_the_rows_once(spark, sf, monkeypatch):
    from factorloom import queries
    from factorloom.sources import market

    kept, given = [], []
    monkeypatch.setattr(queries, "keep", lambda df: kept.append(plan(df)) or df.localCheckpoint())
    monkeypatch.setattr(queries.ablation, "run_arms", lambda *a: given.append(a))
    monkeypatch.setattr(queries.ablation, "report", lambda *a: {})
    queries._ablation(spark, sf)
    wide = given[0][-1]
    assert len(kept) == 1 and kept[0].count("Exchange hashpartitioning(date") == 1
    assert kept[0].count("Exchange hashpartitioning(ticker") == 3  # order lines, ranks, and suppliers
    assert wide.rows == market.line_count(spark, sf) and "Window" not in plan(wide.df.select(wide.forward(5))) and "industry" in wide.df.columns


def test_rows_are_ranked_before_they_grow(spark):
    from factorloom.plans import formula

    p, texts = panel(spark), {"s": "-stddev(close, 5)", "r": "correlation(rank(close), rank(returns), 3)", "d": "delta(close, 2)"}
    got = formula.evaluate(p, texts)
    assert got.columns == ["date", "pos", "ticker", "s", "r", "d"]
    below = plan(got).split("Exchange hashpartitioning(date")[1]
    assert "lag(" not in below and "rank(" not in below
    for n, text in texts.items():
        near(*(df.filter(f"{n} is not null").select("pos", "ticker", n).collect() for df in (got, formula.evaluate(p, {n: text}))), 2)
