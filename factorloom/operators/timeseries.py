"""The column operators of formulas. Each works on all tickers or all dates at once.

An operator that needs a window is put into the frame as a column of its own, so that what stands on it
mentions a column, not a tree. Operators of one window specification that follow each other share one sort.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from factorloom.sources.market import finite
from factorloom.sources.shared import deal


#: Windows of at most so many rows are laid out as columns, of which deviations and correlations are one expression; a frame would be read anew for each row.
LAID_OUT = 32


def window_length(n: float) -> int:
    """n rounded down; less than one is an error, so no operator can look ahead."""
    size = math.floor(n)
    if size < 1:
        raise ValueError("a window has at least one row")
    return size


class Frame:
    """A dense panel to which operators add columns. ``df`` has date, pos, ticker and the inputs.

    With ``rows``, about how many it has, these are dealt to the tasks they need wherever windows change from tickers to dates or back;
    ``dealt`` is the column that df is dealt by.
    """

    def __init__(self, df: DataFrame, rows: int | None = None, dealt: str | None = None):
        self.df, self._n, self._known, self._rows, self._dealt = df, 0, {}, rows, dealt

    def _by(self, key: str) -> WindowSpec:
        if self._dealt != key:
            self.df, self._dealt = deal(self.df, self._rows, key), key
        return Window.partitionBy(key)

    def put(self, c: Column) -> Column:
        """c as a column of its own; the same expression is put once."""
        return self.put_all([c])[0]

    def put_all(self, cs: list[Column]) -> list[Column]:
        """As ``put`` of each, which don't start from each other, in one step."""
        out, new = [], {}
        for c in cs:
            key = c._jc.toString()
            if key.isidentifier():
                out.append(c)
                continue
            if key not in self._known:
                self._known[key] = f"_f{self._n}"
                self._n += 1
                new[self._known[key]] = c
            out.append(F.col(self._known[key]))
        if new:
            self.df = self.df.withColumns(new)
        return out

    def __getitem__(self, name: str) -> Column:
        return F.col(name)

    def _past(self, n: float) -> tuple[Window, int]:
        size = window_length(n)
        return self._by("ticker").orderBy("pos").rowsBetween(1 - size, 0), size

    def _full(self, x: Column, n: float, agg) -> Column:
        """agg over the last n rows, where all of them have x."""
        x = self.put(finite(x.cast("double")))
        w, size = self._past(n)
        return self.put(F.when(F.count(x).over(w) == size, agg(x).over(w)))

    def rank(self, x: Column) -> Column:
        """Share of the date's values that are at most x, ties at their mean."""
        x = self.put(finite(x.cast("double")))
        w = self._by("date").orderBy(x.asc_nulls_last())
        mean_rank = (F.rank().over(w) + F.count("*").over(w)) / 2  # midway between the first and the last of its equals: one sort
        return self.put(F.when(x.isNotNull(), mean_rank / F.count(x).over(Window.partitionBy("date"))))

    def delay(self, x: Column, n: float) -> Column:
        x = self.put(finite(x.cast("double")))
        return self.put(F.lag(x, window_length(n)).over(self._by("ticker").orderBy("pos")))

    def delta(self, x: Column, n: float) -> Column:
        x = self.put(finite(x.cast("double")))
        return x - self.delay(x, n)

    def ts_sum(self, x: Column, n: float) -> Column:
        return self._full(x, n, F.sum)

    def ts_min(self, x: Column, n: float) -> Column:
        return self._full(x, n, F.min)

    def ts_max(self, x: Column, n: float) -> Column:
        return self._full(x, n, F.max)

    def stddev(self, x: Column, n: float) -> Column:
        size = window_length(n)
        if not 2 <= size <= LAID_OUT:
            return self._full(x, n, F.stddev_samp)
        (d,), full = self._laid_out(size, self.put(finite(x.cast("double"))))
        m = self._mean(d)
        return self.put(F.when(full, F.sqrt(self._products(d, m, d, m) / (size - 1))))

    def _laid_out(self, n: int, *xs: Column) -> tuple[list[list[Column]], Column]:
        """For each of xs how much the n - 1 rows before differ from this one, and whether all n rows have all of xs (else differences mean nothing).

        What is centred on the row itself is exactly 0 where nothing varies. No column is nullable, so that sums stay short code: the JVM
        compiles no method over 8,000 bytes.
        """
        by, none = self._by("ticker").orderBy("pos"), F.lit(0.0)
        there = reduce(and_, (x.isNotNull() for x in xs))
        now = self.put_all([F.coalesce(x, none) for x in xs])
        full, *before = self.put_all([F.count(F.when(there, 1)).over(by.rowsBetween(1 - n, 0)) == n, *(F.lag(x, k, 0.0).over(by) for x in now for k in range(1, n))])
        apart = self.put_all([before[i * (n - 1) + k] - x for i, x in enumerate(now) for k in range(n - 1)])
        return [apart[i * (n - 1):(i + 1) * (n - 1)] for i in range(len(xs))], full

    def _mean(self, d: list[Column]) -> Column:
        """Of differences from the row itself, whose own is 0."""
        return self.put(reduce(add, d) / (len(d) + 1))

    def _products(self, d: list[Column], m: Column, e: list[Column], k: Column) -> Column:
        """The sum of products of deviations from the means m and k."""
        return reduce(add, ((a - m) * (b - k) for a, b in zip(d, e, strict=True)), m * k)

    def ts_rank(self, x: Column, n: float) -> Column:
        """Where the last value stands among the last n, as a share, ties at their mean."""
        x = self.put(finite(x.cast("double")))
        w, size = self._past(n)
        seen = self.put(F.collect_list(x).over(w))
        place = F.size(F.filter(seen, lambda v: v < x)) + (F.size(F.filter(seen, lambda v: v == x)) + 1) / 2
        return self.put(F.when(F.size(seen) == size, place / size))

    def _paired(self, x: Column, y: Column, n: float):
        x, y = self.put(finite(x.cast("double"))), self.put(finite(y.cast("double")))
        both = x.isNotNull() & y.isNotNull()
        x, y = self.put(F.when(both, x)), self.put(F.when(both, y))
        w, size = self._past(n)
        return x, y, w, F.count(x).over(w) == size

    def correlation(self, x: Column, y: Column, n: float) -> Column:
        """Pearson's over the last n rows; null where a side is constant."""
        size = window_length(n)
        if 2 <= size <= LAID_OUT:
            (d, e), full = self._laid_out(size, *self.put_all([finite(x.cast("double")), finite(y.cast("double"))]))
            m, k = self._mean(d), self._mean(e)
            xy, xx, yy = self.put_all([self._products(d, m, e, k), self._products(d, m, d, m), self._products(e, k, e, k)])
            return self.put(F.when(full, finite(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))))
        x, y, w, full = self._paired(x, y, n)
        spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
        moves = (F.min(x).over(w) < F.max(x).over(w)) & (F.min(y).over(w) < F.max(y).over(w))
        return self.put(F.when(full & moves, finite(F.try_divide(F.covar_pop(x, y).over(w), spread))))

    def covariance(self, x: Column, y: Column, n: float) -> Column:
        x, y, w, full = self._paired(x, y, n)
        return self.put(F.when(full, F.covar_samp(x, y).over(w)))

    def sign(self, x: Column) -> Column:
        return F.signum(finite(x.cast("double"))) + F.lit(0.0)

    def signed_power(self, x: Column, p: Column | float) -> Column:
        x = self.put(finite(x.cast("double")))
        return finite((F.signum(x) + F.lit(0.0)) * F.pow(F.abs(x), p if isinstance(p, Column) else F.lit(float(p))))

    def safe_divide(self, a: Column, b: Column) -> Column:
        return finite(F.try_divide(finite(a.cast("double")), finite(b.cast("double"))))

    def where(self, condition: Column, a: Column, b: Column) -> Column:
        """a or b by a boolean, or a number that isn't 0; null where that is null."""
        return F.when(condition.isNull(), F.lit(None)).when(condition.cast("boolean"), finite(a.cast("double"))).otherwise(finite(b.cast("double")))

    def adv(self, price: Column, volume: Column, n: float) -> Column:
        return self.ts_sum(finite(price) * finite(volume), n) / window_length(n)

    def log(self, x: Column) -> Column:
        x = self.put(finite(x.cast("double")))
        return F.when(x > 0, F.log(x))

    def abs(self, x: Column) -> Column:
        return F.abs(finite(x.cast("double")))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * F.floor(F.try_divide(a, b))
