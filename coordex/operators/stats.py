"""Intraclass correlation and tests of normality."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from coordex.operators.ranks import ranked, same


def icc11(pairs: DataFrame, a: str = "m1", b: str = "m2", by: tuple[str, ...] = ()) -> DataFrame:
    """One-way single-measure intraclass correlation of two methods."""
    x, y = F.col(a), F.col(b)
    out = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (2 * F.var_samp((x + y) / 2)).alias("msb"), F.avg((x - y) * (x - y) / 2).alias("msw")
    )
    return out.withColumn("icc", (F.col("msb") - F.col("msw")) / F.nullif(F.col("msb") + F.col("msw"), F.lit(0.0))).withColumn("f", F.col("msb") / F.nullif(F.col("msw"), F.lit(0.0)))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, up, down = 1e-300, 1.0, 0.0
    value, k = 1.0, 0
    while True:
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        down = 1 / (1 + term * down or tiny)
        up = 1 + term / up or tiny
        value *= up * down
        k += 1
        if k > 2 and abs(up * down - 1) < 1e-14:
            return front * (value - 1)


def f_share(f: float, d1: float, d2: float) -> float:
    """Share of an F distribution above ``f``."""
    return beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def f_quantile(share: float, d1: float, d2: float) -> float:
    """The value below which ``share`` of an F distribution lies, by halving."""
    low, high = 0.0, 1.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if beta_share(x, d1 / 2, d2 / 2) < share else (low, x)
    return d2 / d1 * low / (1 - low) if low < 1 else math.inf


def icc_interval(icc: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Rows of ``icc11`` (one a group) with the p value of its F test and the bounds
    of its confidence interval; null where F is (fewer than two pairs, no spread)."""
    schema = StructType([*icc.schema.fields, *[StructField(c, DoubleType()) for c in ("p_value", "lower", "upper")]])
    share = 1 - (1 - confidence) / 2

    def bounds(n: int, f: float | None) -> tuple[float | None, ...]:
        if f is None or n < 2:
            return None, None, None
        low, high = f / f_quantile(share, n - 1, n), f * f_quantile(share, n, n - 1)
        return f_share(f, n - 1, n), (low - 1) / (low + 1), (high - 1) / (high + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bounds(n, f) for n, f in zip(b.column("n").to_pylist(), b.column("f").to_pylist())]
            yield pa.record_batch([*b.columns, *[pa.array([x[k] for x in found], pa.float64()) for k in range(3)]], schema.fieldNames())

    return icc.mapInArrow(add, schema)


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov test of the raw column against N(0, 1): p_value, statistic."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    sample = df.select(F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull())
    out = KolmogorovSmirnovTest.test(sample, column, "norm", 0.0, 1.0)
    return out.select(F.col("pValue").alias("p_value"), "statistic")


# Wichura's AS 241 (normal quantiles) and Hart's normal distribution, highest power first.
_NEAR = (("2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457", "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.387132872796366608"),
         ("5226.495278852854561", "28729.085735721942674", "39307.89580009271061", "21213.794301586595867", "5394.1960214247511077", "687.1870074920579083", "42.313330701600911252", "1"))
_TAIL = (("7.7454501427834140764e-4", "0.0227238449892691845833", "0.24178072517745061177", "1.27045825245236838258", "3.64784832476320460504", "5.7694972214606914055", "4.6303378461565452959", "1.42343711074968357734"),
         ("1.05075007164441684324e-9", "5.475938084995344946e-4", "0.0151986665636164571966", "0.14810397642748007459", "0.68976733498510000455", "1.6763848301838038494", "2.05319162663775882187", "1"))
_FAR = (("2.01033439929228813265e-7", "2.71155556874348757815e-5", "0.0012426609473880784386", "0.026532189526576123093", "0.29656057182850489123", "1.7848265399172913358", "5.4637849111641143699", "6.6579046435011037772"),
        ("2.04426310338993978564e-15", "1.4215117583164458887e-7", "1.8463183175100546818e-5", "7.868691311456132591e-4", "0.0148753612908506148525", "0.13692988092273580531", "0.59983220655588793769", "1"))
_HART = (("0.0352624965998911", "0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"),
         ("0.0883883476483184", "1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"))


def _ratio(tables: tuple[tuple[str, ...], ...], x: str) -> str:
    """Quotient of two polynomials of x, as SQL of doubles."""
    horner = []
    for table in tables:
        text = ""
        for c in table:
            c = c if "e" in c else c + "e0"
            text = f"({text} * {x} + {c})" if text else c
        horner.append(text)
    return f"{horner[0]} / {horner[1]}"


def normal_score(p: str) -> str:
    """SQL: the value below which the share p of N(0, 1) lies."""
    q = f"({p} - 0.5e0)"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    near = f"{q} * {_ratio(_NEAR, f'(0.180625e0 - {q} * {q})')}"
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {near} ELSE sign({q}) * CASE WHEN {r} <= 5e0 THEN {_ratio(_TAIL, f'({r} - 1.6e0)')} ELSE {_ratio(_FAR, f'({r} - 5e0)')} END END"


def normal_share(x: str) -> str:
    """SQL: the share of N(0, 1) below x."""
    a = f"abs({x})"
    tail = f"{a} + 0.65e0"
    for k in (4, 3, 2, 1):
        tail = f"{a} + {k}e0 / ({tail})"
    beyond = f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN exp(-{a} * {a} / 2e0) * {_ratio(_HART, a)} ELSE exp(-{a} * {a} / 2e0) / ({tail}) / 2.506628274631e0 END"
    return f"CASE WHEN {x} > 0e0 THEN 1e0 - {beyond} ELSE {beyond} END"


# Royston's 1995 approximation.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def royston_p(w: float, n: int) -> float:
    """Share of normal samples of 3 to 5000 values with a W as low."""
    poly = lambda c, t: sum(k * t**p for p, k in enumerate(c))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        y, mean = -math.log(-2.273 + 0.459 * n - math.log(1 - w)), poly((0.544, -0.39978, 0.025054, -0.0006714), n)
        sd = math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        t = math.log(n)
        y, mean = math.log(1 - w), poly((-1.5861, -0.31082, -0.083751, 0.0038915), t)
        sd = math.exp(poly((-0.4803, -0.082676, 0.0030302), t))
    return 1 - NormalDist(mean, sd).cdf(y)


def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """W and p for 3 to 5000 values; None where it is not defined."""
    x = np.sort(values[np.isfinite(values)])
    n = len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        return None, None
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), 1 / math.sqrt(n)
    poly = lambda c, t: sum(k * t**p for p, k in enumerate(c))
    a = np.empty(n)
    last = poly(_C1, u) + m[-1] / math.sqrt(total)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0, math.sqrt(0.5))
    else:
        ends = 1 if n <= 5 else 2
        second = poly(_C2, u) + m[-2] / math.sqrt(total)
        tops = [last, second][:ends]
        scale = (total - 2 * sum(m[-1 - i] ** 2 for i in range(ends))) / (1 - 2 * sum(t * t for t in tops))
        a = m / math.sqrt(scale)
        for i, t in enumerate(tops):
            a[i], a[-1 - i] = -t, t
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    return w, royston_p(w, n)


def _finite(df: DataFrame, column: str, *by: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))).select(*by, x.alias("x"))


def shapiro_sums(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, n and w of each group, from global ranks joined with their normal scores: w is
    made of sums and of the two values at each end, so no group comes into one task.
    Null for fewer than 3 values, or equal ones. Values that are not finite don't count."""
    rows = _finite(df, column, by)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    placed = ranked(rows, [by], ["x"]).alias("r").join(sizes.alias("s"), same("r", "s", [by]))
    score = F.expr(normal_score("((r.rank - 0.375e0) / (s.n + 0.25e0))"))
    placed = placed.select(f"r.{by}", "s.n", "r.rank", (F.col("r.x") - F.col("s.mean")).alias("d"), score.alias("m"))
    end = lambda c, at: F.max(F.when(F.col("rank") == at, F.col(c)))
    n = F.col("n")
    sums = placed.groupBy(by).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("total"), F.sum(F.col("m") * F.col("d")).alias("md"), F.sum(F.col("d") * F.col("d")).alias("dd"),
        (end("d", n) - end("d", F.lit(1))).alias("span1"), (end("d", n - 1) - end("d", F.lit(2))).alias("span2"), end("m", n).alias("m1"), end("m", n - 1).alias("m2"),
    )
    u = 1 / F.sqrt(n.cast("double"))
    poly = lambda c: sum((F.lit(k) * F.pow(u, F.lit(float(p))) for p, k in enumerate(c) if k), F.lit(0.0))
    top1, top2 = poly(_C1) + F.col("m1") / F.sqrt("total"), poly(_C2) + F.col("m2") / F.sqrt("total")
    m1, m2 = F.col("m1"), F.col("m2")
    one = (F.col("md") - m1 * F.col("span1")) / F.sqrt((F.col("total") - 2 * m1 * m1) / (1 - 2 * top1 * top1)) + top1 * F.col("span1")
    two = (F.col("total") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * top1 * top1 - 2 * top2 * top2)
    two = (F.col("md") - m1 * F.col("span1") - m2 * F.col("span2")) / F.sqrt(two) + top1 * F.col("span1") + top2 * F.col("span2")
    b = F.when(n == 3, F.sqrt(F.lit(0.5)) * F.col("span1")).when(n <= 5, one).otherwise(two)
    w = F.when((n >= 3) & (F.col("span1") > 0), F.least(b * b / F.col("dd"), F.lit(1.0)))
    return sums.select(by, w.alias("w"), "n")


def shapiro(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, w, p_value, n per group. The approximation of p holds up to 5000 values; it is
    null beyond, where w still stands."""
    found = shapiro_sums(df, column, by)
    schema = StructType([*found.schema.fields[:2], StructField("p_value", DoubleType()), found.schema.fields[2]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a row a group
            p = [None if w is None or n > 5000 else royston_p(w, n) for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p, pa.float64()), b.column(2)], schema.fieldNames())

    return found.mapInArrow(add, schema)


def ks_statistic(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n and the Kolmogorov-Smirnov statistic against N(0, 1): the largest gap between
    the steps of the ranks and the normal distribution. Values that are not finite don't count."""
    by = list(by)
    rows = _finite(df, column, *by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, by, ["x"]).alias("r").join(sizes.alias("s"), same("r", "s", by))
    share = F.expr(normal_share("r.x"))
    gap = F.greatest(F.col("r.rank") / F.col("s.n") - share, share - (F.col("r.rank") - 1) / F.col("s.n"))
    return placed.groupBy(*[F.col(f"r.{k}").alias(k) for k in by]).agg(F.max("s.n").alias("n"), F.max(gap).alias("statistic"))


def qq_points(df: DataFrame, column: str, by: str) -> DataFrame:
    """Ordered values with their plotting positions, per group, from global ranks."""
    rows = df.where(F.col(column).isNotNull()).select(by, F.col(column).alias("value"))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, [by], ["value"]).alias("r").join(sizes.alias("s"), same("r", "s", [by]))
    return placed.select(f"r.{by}", "r.value", ((F.col("r.rank") - 0.5) / F.col("s.n")).alias("position"))
