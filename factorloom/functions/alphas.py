"""The twelve registered formulas, over a dense panel (calendar positions)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators.timeseries import Frame
from factorloom.sources.market import finite


@dataclass(frozen=True)
class Alpha:
    number: int
    inputs: tuple[str, ...]
    lookback: int
    build: Callable[[Frame], Column]
    delay: int = 1

    @property
    def name(self) -> str:
        return f"alpha_{self.number:03d}"


def _a002(f: Frame) -> Column:
    moves = f.rank(f.delta(f.log(f["volume"]), 2))
    return -f.correlation(moves, f.rank(f.safe_divide(f["close"] - f["open"], f["open"])), 6)


def _a007(f: Frame) -> Column:
    change = f.put(f.delta(f["close"], 7))
    active = -f.ts_rank(F.abs(change), 60) * f.sign(change)
    return f.where(f["adv20"] < f["volume"], active, F.lit(-1.0))


def _a012(f: Frame) -> Column:
    return f.sign(f.delta(f["volume"], 1)) * -f.delta(f["close"], 1)


def _a017(f: Frame) -> Column:
    turn = f.rank(f.delta(f.delta(f["close"], 1), 1))
    return -f.rank(f.ts_rank(f["close"], 10)) * turn * f.rank(f.ts_rank(f.safe_divide(f["volume"], f["adv20"]), 5))


def _a021(f: Frame) -> Column:
    slow, fast, spread = f.ts_sum(f["close"], 8) / 8, f.ts_sum(f["close"], 2) / 2, f.stddev(f["close"], 8)
    activity = f.put(f.safe_divide(f["volume"], f["adv20"]))
    known = slow.isNotNull() & fast.isNotNull() & spread.isNotNull() & activity.isNotNull()
    regime = F.when(slow + spread < fast, -1.0).when(fast < slow - spread, 1.0).when(activity >= 1, 1.0).otherwise(-1.0)
    return F.when(known, regime)


def _a022(f: Frame) -> Column:
    return -(f.delta(f.correlation(f["high"], f["volume"], 5), 5) * f.rank(f.stddev(f["close"], 20)))


def _a030(f: Frame) -> Column:
    step = lambda k: f.sign((f["close"] if k == 0 else f.delay(f["close"], k)) - f.delay(f["close"], k + 1))
    return f.safe_divide((1 - f.rank(step(0) + step(1) + step(2))) * f.ts_sum(f["volume"], 5), f.ts_sum(f["volume"], 20))


def _a034(f: Frame) -> Column:
    calm = f.rank(f.safe_divide(f.stddev(f["returns"], 2), f.stddev(f["returns"], 5)))
    return f.rank((1 - calm) + (1 - f.rank(f.delta(f["close"], 1))))


def _a035(f: Frame) -> Column:
    return f.ts_rank(f["volume"], 32) * (1 - f.ts_rank(f["close"] + f["high"] - f["low"], 16)) * (1 - f.ts_rank(f["returns"], 32))


def _a040(f: Frame) -> Column:
    return -f.rank(f.stddev(f["high"], 10)) * f.correlation(f["high"], f["volume"], 10)


def _a046(f: Frame) -> Column:
    now, ten, twenty = f["close"], f.delay(f["close"], 10), f.delay(f["close"], 20)
    bend = f.put((twenty - ten) / 10 - (ten - now) / 10)
    back = f.put(-f.delta(now, 1))
    return F.when(bend.isNotNull() & back.isNotNull(), F.when(bend > 0.25, -1.0).when(bend < 0, 1.0).otherwise(back))


def _a101(f: Frame) -> Column:
    return f.safe_divide(f["close"] - f["open"], (f["high"] - f["low"]) + 0.001)


#: The numbers, inputs and lookbacks of the pool.
ALPHAS = (
    Alpha(2, ("open", "close", "volume"), 8, _a002),
    Alpha(7, ("close", "volume", "adv20"), 67, _a007),
    Alpha(12, ("close", "volume"), 2, _a012),
    Alpha(17, ("close", "volume", "adv20"), 24, _a017),
    Alpha(21, ("close", "volume", "adv20"), 20, _a021),
    Alpha(22, ("high", "close", "volume"), 20, _a022),
    Alpha(30, ("close", "volume"), 20, _a030),
    Alpha(34, ("close", "returns"), 6, _a034),
    Alpha(35, ("close", "high", "low", "volume", "returns"), 33, _a035),
    Alpha(40, ("high", "volume"), 10, _a040),
    Alpha(46, ("close",), 20, _a046),
    Alpha(101, ("open", "high", "low", "close"), 1, _a101),
)


def check_registry(alphas: tuple[Alpha, ...]) -> None:
    if len({a.number for a in alphas}) < len(alphas) or any(a.delay < 1 or a.lookback < 1 for a in alphas):
        raise ValueError("numbers are unique; delays and lookbacks are at least 1")


check_registry(ALPHAS)


def build(panel: DataFrame, numbers: tuple[int, ...] | None = None) -> DataFrame:
    """date, pos, ticker and a column for each formula, sharing what they have in common."""
    f = Frame(panel)
    out = {a.name: f.put(finite(a.build(f))) for a in ALPHAS if numbers is None or a.number in numbers}
    return f.df.select("date", "pos", "ticker", *(c.alias(n) for n, c in out.items()))
