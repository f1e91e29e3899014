"""Row-frame window helpers with pandas-style minimum-observation gates.

Every frame here runs over one row per (asset, date): the length of a window
partition is bounded by the calendar, not by the volume of raw facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec


def series(*keys: str, order: str = "d") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def before(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def gated(agg: Column, c: Column, frame: WindowSpec, need: int) -> Column:
    return F.when(F.count(c).over(frame) >= need, agg.over(frame))


def roll_mean(c: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    return gated(F.avg(c), c, trailing(w, n), need or n)


def roll_std(c: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    return gated(F.stddev_samp(c), c, trailing(w, n), need or n)


def roll_sum(c: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    return gated(F.sum(c), c, trailing(w, n), need or n)


def rolling_z(c: Column, w: WindowSpec, n: int, need: int) -> Column:
    """(x - mean) / sample std over the trailing n rows; NULL when the std is (numerically) zero."""
    mu, sd = roll_mean(c, w, n, need), roll_std(c, w, n, need)
    return F.when(sd > 1e-12, (c - mu) / sd)


def lag_return(c: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def _rungs(n: int, part: int, most: int = 7) -> list[tuple[int, int]]:
    """(length, length it is joined from) up to n, each a small multiple of the one before; a length of 1 stands for the rows themselves."""
    start = part if n % part == 0 else 1
    left, factors, k = n // start, [], 2
    while left > 1:
        if left % k:
            k += 1
            continue
        left //= k
        if factors and factors[-1] * k <= most:
            factors[-1] *= k
        else:
            factors.append(k)
    out = []
    for f in factors:
        out.append((start * f, start))
        start *= f
    return out or [(1, 1)]


def laddered(df: DataFrame, w: WindowSpec, lengths: list[int], direct: Callable[[WindowSpec], Column], join: Callable[[list[Column]], Column], none: Column | None = None) -> DataFrame:
    """Add `_f{n}`, the struct `direct` gives over the last n rows, for every length.

    Spark goes through a whole moving frame again on every row. Here only a frame of a few rows is gone through; a longer one is joined from
    shorter ones that end a multiple of their length back, so a row costs the few steps between the lengths. `none` stands for a frame before the first row.
    """
    part = 1
    for n in sorted(set(lengths)):
        for m, of in [] if n == part else _rungs(n, part):
            if of == 1:
                df = df.withColumn(f"_f{m}", direct(trailing(w, m)))
                continue
            back = {f"_g{i}": F.lag(f"_f{of}", i * of).over(w) for i in range(1, m // of)}
            df = df.withColumns(back)
            if none is not None:
                df = df.withColumns({c: F.coalesce(F.col(c), none) for c in back})
            df = df.withColumn(f"_f{m}", join([F.col(c) for c in (f"_f{of}", *back)])).drop(*back)
        part = n
    return df


def without_frames(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_f") and c[2:].isdigit()])


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def rolling_moments(df: DataFrame, w: WindowSpec, wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add `{name}_mean` and `{name}_sd` (sample) of a column's last n rows for each wanted[name] = (column, n, rows needed).

    Frames are joined by count, sum and squared deviations from the joint mean: whole numbers are summed exactly and nothing cancels. A
    deviation below the last digits of the mean is 0: the frame is constant. The structs hold no nulls, which keeps the generated code short enough to be compiled.
    """
    cols, zero, long = sorted({c for c, _, _ in wanted.values()}), F.lit(0.0), "bigint"
    filled = lambda x: F.coalesce(x, zero)
    moments = lambda n, s, mean, m2: F.struct(n.alias("n"), s.alias("s"), mean.alias("mean"), m2.alias("m2"))

    def direct(f: WindowSpec) -> Column:
        one = lambda c: moments(F.count(c).over(f), filled(F.sum(c).over(f)), filled(F.avg(c).over(f)), filled(F.var_pop(c).over(f)) * F.count(c).over(f))
        return F.struct(*[one(c).alias(c) for c in cols])

    def join(parts: list[Column]) -> Column:
        def one(c: str) -> Column:
            n, s = _total([x[c]["n"] for x in parts]), _total([x[c]["s"] for x in parts])
            mean = filled(F.try_divide(s, n))
            off = [x[c]["mean"] - mean for x in parts]
            return moments(n, s, mean, _total([x[c]["m2"] + x[c]["n"] * d * d for x, d in zip(parts, off)]))

        return F.struct(*[one(c).alias(c) for c in cols])

    none = F.struct(*[moments(F.lit(0).cast(long), zero, zero, zero).alias(c) for c in cols])
    df = df.withColumns({c: F.col(c).cast("double") for c in cols if dict(df.dtypes)[c] != "double"})
    df = laddered(df, w, [n for _, n, _ in wanted.values()], direct, join, none)
    out = {}
    for name, (c, n, need) in wanted.items():
        at = F.col(f"_f{n}")[c]
        noise = at["n"] * at["mean"] * at["mean"] * 1e-30
        sd = F.when(at["m2"] < noise, zero).otherwise(F.sqrt(F.try_divide(at["m2"], at["n"] - 1)))
        out |= {f"{name}_mean": F.when(at["n"] >= need, at["mean"]), f"{name}_sd": F.when(at["n"] >= need, sd)}
    return without_frames(df.withColumns(out))


def with_rolling_z(df: DataFrame, w: WindowSpec, wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add rolling_z of a column's last n rows for each wanted[out] = (column, n, rows needed), at a cost that does not follow n."""
    df = rolling_moments(df, w, {f"_z_{o}": x for o, x in wanted.items()})
    z = {o: F.when(F.col(f"_z_{o}_sd") > 1e-12, (F.col(c) - F.col(f"_z_{o}_mean")) / F.col(f"_z_{o}_sd")) for o, (c, _, _) in wanted.items()}
    return df.withColumns(z).drop(*[f"_z_{o}_{k}" for o in wanted for k in ("mean", "sd")])


def rolling_extremes(df: DataFrame, w: WindowSpec, wanted: dict[str, tuple[str, str]], n: int) -> DataFrame:
    """Add the greatest or least value of a column's last n rows for each wanted[out] = (column, "max" or "min"); exact."""
    pick = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    direct = lambda f: F.struct(*[pick[k][0](c).over(f).alias(o) for o, (c, k) in wanted.items()])
    join = lambda parts: F.struct(*[pick[k][1](*[p[o] for p in parts]).alias(o) for o, (_, k) in wanted.items()])
    df = laddered(df, w, [n], direct, join)
    return without_frames(df.withColumns({o: F.col(f"_f{n}")[o] for o in wanted}))


def rolling_mean(df: DataFrame, w: WindowSpec, c: str, n: int, mean: str, count: str) -> DataFrame:
    """Add the mean and the number of a column's non-null values in its last n rows; whole numbers are summed exactly."""
    direct = lambda f: F.struct(F.sum(c).over(f).alias("s"), F.count(c).over(f).alias("n"))
    join = lambda parts: F.struct(*[_total([F.coalesce(p[k], F.lit(0).cast(t)) for p in parts]).alias(k) for k, t in (("s", "double"), ("n", "bigint"))])
    at = F.col(f"_f{n}")
    df = laddered(df.withColumn(c, F.col(c).cast("double")), w, [n], direct, join)
    return without_frames(df.withColumns({mean: F.when(at["n"] > 0, at["s"] / at["n"]), count: at["n"]}))
