"""Operators against loops, what formulas refuse, and that nothing looks ahead."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import alphas
from factorloom.operators import crosssection, evaluation, pit, portfolio, quality, selection, statistics
from factorloom.plans import formula
from factorloom.sources import market


def day(i: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


def bars(spark, days: int = 60, names: int = 6, seed: int = 3):
    r = random.Random(seed)
    rows = []
    for k in range(names):
        p = 100.0
        for i in range(days):
            p *= 1 + r.gauss(0, 0.02)
            if r.random() < 0.95:
                rows.append((day(i), f"T{k}", p, p * 1.01, p * 0.98, p * (1 + r.gauss(0, 0.005)), float(r.randint(10, 1000))))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("text", [
    "", "1", "1 + 2", "__import__('os')", "close.real", "close[0]", "(lambda: close)()", "unknown(close)", "cash", "'close'", "close if close else open", "close > open",
    "delay(close, 0)", "delay(close, -1)", "delay(close)", "delay(5, 1)", "delay(close, open)", "rank(close, n=1)", "rank(*close)", "close and open", "True * close", "x" * 3000, "close +",
])
def test_formulas_that_are_refused(text):
    with pytest.raises(formula.FormulaError):
        formula.parse(text)
    assert not formula.is_valid(text)[0]


def test_card_names_all_operators():
    card = formula.capability_card()
    assert all(f"{name}(" in card for name in formula.OPERATORS) and all(i in card for i in formula.INPUTS)


def test_the_future_changes_nothing(spark):
    b = bars(spark)
    cut = day(45)
    other = b.withColumn("close", F.when(F.col("date") > F.lit(cut), F.col("close") * 3).otherwise(F.col("close"))).withColumn("volume", F.when(F.col("date") > F.lit(cut), F.lit(7.0)).otherwise(F.col("volume")))
    texts = formula.DEFAULTS | {"deep": "rank(ts_rank(delta(close, 2), 5)) - correlation(high, volume, 6)"}

    def run(x):
        p = market.measures(market.densify(x))
        a = formula.evaluate(p, texts).join(alphas.build(p).drop("pos"), ["date", "ticker"])
        return {(r["date"], r["ticker"]): tuple(r)[2:] for r in a.filter(F.col("date") <= F.lit(cut)).collect()}

    assert run(b) == run(other)


def test_operators_against_loops(spark):
    p = market.measures(market.densify(bars(spark))).cache()
    out = formula.evaluate(p, {"r": "rank(close)", "t": "ts_rank(close, 5)", "s": "stddev(close, 4)", "c": "correlation(close, volume, 5)", "m": "close % 7", "d": "safe_divide(close, close - close)"}).collect()
    close = {(r["pos"], r["ticker"]): r["close"] for r in p.collect()}
    volume = {(r["pos"], r["ticker"]): r["volume"] for r in p.collect()}

    def near(a, b):
        return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)

    for r in out:
        x, past = close[r["pos"], r["ticker"]], lambda n, of, r=r: [of.get((r["pos"] - k, r["ticker"])) for k in range(n)]
        all_ = [v for (q, _), v in close.items() if q == r["pos"] and v is not None]
        assert near(r["r"], None if x is None else (sum(v < x for v in all_) + (sum(v == x for v in all_) + 1) / 2) / len(all_))
        w = past(5, close)
        assert near(r["t"], None if None in w else (sum(v < x for v in w) + (sum(v == x for v in w) + 1) / 2) / 5)
        assert near(r["s"], None if None in past(4, close) else float(np.std(past(4, close), ddof=1)))
        v = past(5, volume)
        assert near(r["c"], None if None in w or None in v else float(np.corrcoef(w, v)[0, 1]))
        assert near(r["m"], None if x is None else x % 7) and r["d"] is None


def test_neutral_residuals_are_those_of_least_squares(spark):
    r = np.random.default_rng(1)
    rows = [(day(0), f"T{i}", float(r.normal()), "abc"[i % 3], float(np.exp(r.normal()))) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, ticker string, value double, industry string, size double")
    got = {x["ticker"]: x["value"] for x in crosssection.neutralize(df, size="size").collect()}
    m = np.array([[row[3] == "a", row[3] == "b", row[3] == "c", np.log(row[4])] for row in rows], float)
    y = np.array([row[2] for row in rows])
    e = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    e = (e - e.mean()) / e.std()
    assert all(math.isclose(got[row[1]], v, abs_tol=1e-9) for row, v in zip(rows, e, strict=True))


def test_buffered_targets_against_a_loop(spark):
    r = random.Random(5)
    rows = [(day(i), i + 1, f"T{k:02}", None if r.random() < 0.1 else r.random()) for i in range(40) for k in range(20)]
    df = spark.createDataFrame(rows, "date date, pos int, ticker string, value double")
    got = {(x["pos"], x["ticker"]): x["w"] for x in portfolio.buffered_targets(df, every=3).collect()}
    long_, short, w = set(), set(), {}
    for pos in range(1, 41):
        if (pos - 1) % 3 == 0:
            order = [t for _, t in sorted((v, t) for _, p, t, v in rows if p == pos and v is not None)]
            enter, stay = max(1, int(len(order) * 0.2)), max(1, int(len(order) * 0.3))
            long_ = set(order[-enter:]) | (long_ & set(order[-stay:]))
            short = set(order[:enter]) | (short & set(order[:stay]))
            w = {t: 1 / len(long_) for t in long_} | {t: -1 / len(short) for t in short}
        for k in range(20):
            assert math.isclose(got[pos, f"T{k:02}"], w.get(f"T{k:02}", 0.0), abs_tol=1e-12)


def test_bootstrap_against_a_loop(spark):
    r = np.random.default_rng(2)
    n, block, boot = 23, 5, 7
    x = r.normal(size=n)
    ics = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(x) if i != 4], "i int, factor string, ic double")
    got = {row["draw"]: row["mean"] for row in statistics.bootstrap_null(ics, n, block, boot, 9).collect()}
    rng, kept = np.random.default_rng(9), np.delete(x, 4)
    y = x - kept.mean()
    y[4] = np.nan
    for b in range(boot):
        index = np.concatenate([(s + np.arange(block)) % n for s in rng.integers(0, n, size=-(-n // block))])[:n]
        assert math.isclose(got[b], np.nanmean(y[index]), abs_tol=1e-12)


def test_membership_by_undoing_changes(spark):
    days = spark.createDataFrame([(day(i), t) for i in range(6) for t in "ABCD"], "date date, ticker string")
    changes = spark.createDataFrame([(day(3), "B", "C"), (day(5), "D", "B")], "effective_date date, added string, removed string")
    current = spark.createDataFrame([("A",), ("D",)], "ticker string")
    got = {(r["date"], r["ticker"]) for r in pit.reverse_changes(days, current, changes).collect() if r["is_member"]}
    members = lambda i: {"A", "C"} if i < 3 else {"A", "B"} if i < 5 else {"A", "D"}
    assert got == {(day(i), t) for i in range(6) for t in members(i)}


def test_t_tail():
    assert math.isclose(evaluation.t_tail(2.0, 10), 0.07338803477074039, rel_tol=1e-9)
    assert math.isclose(evaluation.t_tail(0.0, 5), 1.0) and evaluation.t_tail(None, 5) is None


def test_t_critical():
    for df, want in ((1, 12.706204736432095), (10, 2.2281388519649385), (30, 2.042272456301238)):
        assert math.isclose(evaluation.t_critical(df, 0.05), want, rel_tol=1e-7)
    assert evaluation.t_critical(0, 0.05) is None
    assert math.isclose(evaluation.t_tail(evaluation.t_critical(7, 0.2), 7), 0.2, rel_tol=1e-9)


def test_interval_of_the_mean(spark):
    ics = spark.createDataFrame([("a", 1, x) for x in (0.1, 0.2, 0.3)] + [("b", 1, 0.5)], "factor string, horizon int, ic double")
    got = {r["factor"]: r for r in evaluation.ic_t_test(ics).collect()}
    assert math.isclose(got["a"]["ci_upper"] - 0.2, 4.302652729911275 * 0.1 / math.sqrt(3), rel_tol=1e-9) and math.isclose(got["a"]["ci_lower"] + got["a"]["ci_upper"], 0.4)
    assert got["b"]["p"] is None and got["b"]["ci_lower"] is None and not got["b"]["significant"]


def test_weights():
    w = selection.capped_weights({"a": 10.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0, "f": 1.0}, 0.2)
    assert math.isclose(sum(w.values()), 1) and max(w.values()) <= 0.2 + 1e-9 and math.isclose(w["b"], w["f"])
    with pytest.raises(ValueError):
        selection.capped_weights({"a": 1.0}, 0.2)
    assert math.isclose(sum(abs(v) for v in selection.ir_weights({"a": 0.3, "b": -0.1}, {("a", "b"): 0.5}).values()), 1)


def test_cleaning_leaves_no_gaps(spark):
    out = quality.clean(bars(spark, 30, 2))
    assert out.filter("close is null or volume is null or weekday(date) > 4 or high < low").count() == 0


def test_reasons_of_dates_without_neutral_values(spark):
    """Too few classified names; values that industries explain whole; a good date with one unclassified name and one without size."""
    d = [datetime.date(2020, 1, i) for i in (1, 2, 3)]
    rows = [(d[0], t, 1.0 * k, "a", 1.0) for k, t in enumerate("ABC")] + [(d[1], t, float(k % 2), "ab"[k % 2], 2.0) for k, t in enumerate("ABCDEF")]
    rows += [(d[2], t, float(k * k), "ab"[k % 2] if k else None, float(k + 1) if k != 1 else None) for k, t in enumerate("ABCDEFGH")]
    df = spark.createDataFrame(rows, "date date, ticker string, value double, industry string, size double")
    got = {r["date"]: r for r in crosssection.neutralize_reasons(df, crosssection.neutralize(df, size="size", min_names=4), size="size", min_names=4).collect()}
    assert [(got[x]["valid"], got[x]["reason"]) for x in d] == [(False, "insufficient_names"), (False, "constant_residual"), (True, None)]
    assert (got[d[2]]["n_names"], got[d[2]]["rank"], got[d[2]]["coverage"]) == (6, 3, 0.75) and got[d[1]]["n_names"] is None and got[d[0]]["coverage"] == 1.0


def test_mix_and_dates_and_counts(spark):
    t = spark.createDataFrame([("A", 1.0, None), ("B", None, None), ("C", 2.0, 3.0)], "ticker string, x double, y double")
    assert [r["mix"] for r in selection.mix(t, {"x": 2.0, "y": -1.0}).orderBy("ticker").collect()] == [2.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="nope"):
        selection.mix(t, {"x": 1.0, "nope": 1.0})
    day = lambda i: datetime.date(2020, 1, i)
    b = spark.createDataFrame([("A", day(1)), ("A", day(5)), ("B", day(9))], "ticker string, date date")
    assert {(r["ticker"], r["date"]) for r in quality.shift_dates(b, "2020-01-08").collect()} == {("A", day(4)), ("A", day(8)), ("B", day(9))}
    a = spark.createDataFrame([("A", "m", "warning"), ("A", "n", "warning"), ("B", "m", "critical")], "ticker string, message string, severity string")
    assert {tuple(r) for r in quality.alert_counts(a).collect()} == {("warning", 2, 1), ("critical", 1, 1)}
    assert quality.alert_counts(a.limit(0)).count() == 0 and quality.shift_dates(b.limit(0), "2020-01-08").count() == 0


def test_quantile_buckets_are_even(spark):
    df = spark.createDataFrame([(day(0), f"T{i:03}", float(i)) for i in range(83)], "date date, ticker string, value double")
    counts = [r["count"] for r in crosssection.buckets(df).groupBy("bucket").count().collect()]
    assert sorted(counts) == [16, 16, 17, 17, 17]


def test_t_test_selection(spark):
    from factorloom.operators import selection

    rows = [("a", 0.03, 1.0, False), ("b", 0.02, 3.0, True), ("c", -0.05, -4.0, True), ("d", 0.01, 2.0, False)]
    tests = spark.createDataFrame(rows, "factor string, mean double, t double, significant boolean")
    pick = lambda **k: [r["factor"] for r in selection.t_test_selection(tests, **k).collect()]
    # among a, b, d: a has 0.45 * 3/3 + 0.45 * 1/3, b 0.45 * 2/3 + 0.45 + 0.1, d 0.45 * 1/3 + 0.45 * 2/3
    assert pick(n=2) == ["b", "a"] and pick(n=3) == ["b", "a", "d"]
    assert pick(n=4) == ["c", "b", "a", "d"]  # too few positive ones: all, by |mean|
    assert pick(n=1, positive=False) == ["b"] and pick(n=2, significant=True) == ["b"]


def test_illiquid_trades_are_infinite_shares(spark):
    from factorloom.operators import portfolio

    moves = spark.createDataFrame([("2020-01-01", "a", 0.5), ("2020-01-01", "b", 0.5), ("2020-01-01", "c", 0.0)], "date string, ticker string, dw double")
    adv = spark.createDataFrame([("2020-01-01", "a", 100.0)], "date string, ticker string, adv20 double")
    got = {r["ticker"]: (r["illiquid"], r["participation"]) for r in portfolio.participation(moves, adv, (10.0,)).collect()}
    assert got == {"a": (False, 0.05), "b": (True, float("inf")), "c": (False, 0.0)}
