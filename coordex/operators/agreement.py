"""Agreement between methods: vectors, pairs, limits of agreement, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coordex.config import AREAS, AUTO_RATER, BASELINE, COORDINATES_OF_INTEREST, DIMENSIONS, FULL, GROUP, HALF, IQR_LIMIT, MANUAL, PLACEHOLDER, SD_LIMIT, SEMI
from coordex.functions.geometry import norm
from coordex.operators.ranks import quantiles, same
from coordex.written import materialize

PAIRS = ((FULL, SEMI), (FULL, MANUAL), (SEMI, MANUAL))
PAIR_KEYS = [*GROUP, "Area", "Electrode"]


def area(experiment: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, a in AREAS.items():
        out = F.when(experiment == e, a).otherwise(out)
    return out


def backfill_experiment(df: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """A placeholder gets the subject's first Experiment that begins with P, or null."""
    first = F.min(F.when(F.col("Experiment").startswith("P"), F.col("Experiment"))).over(Window.partitionBy("Subject"))
    return df.withColumn("Experiment", F.when(F.col("Experiment") == placeholder, first).otherwise(F.col("Experiment")))


def recode_methods(df: DataFrame) -> DataFrame:
    """Baseline runs are method baseline; then half-automated is semi-automated."""
    return df.withColumn("Method", F.when(F.col("run") == BASELINE, BASELINE).when(F.col("Method") == HALF, SEMI).otherwise(F.col("Method")))


def normalize_measurements(df: DataFrame) -> DataFrame:
    return recode_methods(backfill_experiment(df.drop("Unnamed: 0", "date")))


def for_methods(df: DataFrame, m1: str, m2: str, human: tuple[str, ...], auto: str = AUTO_RATER) -> DataFrame:
    """Rows of both methods by the raters that belong to them."""
    raters = (*human, auto) if FULL in (m1, m2) else human
    return df.where(F.col("Method").isin(m1, m2) & F.col("Rater").isin(*raters))


def vectors(df: DataFrame) -> DataFrame:
    """X, Y, Z, Euclidean_Norm and Area per key, electrode, rater and method."""
    keys = [*GROUP, "Experiment", "Electrode", "Rater", "Method"]
    means = [F.avg(F.when(F.col("Dimension") == d, F.col("Coordinates"))).alias(d) for d in DIMENSIONS]
    out = df.groupBy(*keys).agg(*means)
    return out.withColumn("Euclidean_Norm", norm(F.col("X"), F.col("Y"), F.col("Z"))).withColumn("Area", area(F.col("Experiment")))


def repeat_baseline(v: DataFrame) -> DataFrame:
    """Baseline vectors are repeated for each session and run of their subject."""
    base = v.where(F.col("Method") == BASELINE)
    rest = v.where(~F.col("Method").eqNullSafe(BASELINE))
    template = rest.select(*PAIR_KEYS).distinct().alias("t")
    right = base.drop("Session", "run").alias("b")
    same = F.lit(True)
    for k in ("Subject", "Area", "Electrode"):
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}"))
    own = [c for c in v.columns if c not in PAIR_KEYS]
    repeated = template.join(right, same, "left").select(*[f"t.{k}" for k in PAIR_KEYS], *[f"b.{c}" for c in own])
    return rest.unionByName(repeated)


def paired_methods(v: DataFrame, coi: str, m1: str, m2: str, area_only: str | None = None, electrode: str | None = None) -> DataFrame:
    """One column per method with its value of ``coi``, Difference and Mean, where
    both are there. ``n1`` and ``n2`` count the values behind each; over 1 the
    pair is ambiguous and the least is taken."""
    if area_only is not None:
        v = v.where(F.col("Area") == area_only)
    if electrode is not None:
        v = v.where(F.col("Electrode") == electrode)
    of = lambda m: F.when(F.col("Method") == m, F.col(coi))
    out = v.groupBy(*PAIR_KEYS).agg(F.min(of(m1)).alias("m1"), F.min(of(m2)).alias("m2"), F.count(of(m1)).alias("n1"), F.count(of(m2)).alias("n2"))
    out = out.where("m1 is not null and m2 is not null")
    return out.withColumn("Difference", F.col("m1") - F.col("m2")).withColumn("Mean", (F.col("m1") + F.col("m2")) / 2)


def bland_altman(pairs: DataFrame, coi: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Bias and reported limits (mean, standard deviation), and the centre and limits that
    are drawn: for axes from the exact median and interquartile range, found without
    holding a group's values."""
    d = F.col("Difference")
    bias, sd = F.avg(d), F.stddev_samp(d)
    reported = [F.count(d).alias("n"), bias.alias("bias"), sd.alias("sd"), (bias + SD_LIMIT * sd).alias("loa_hi"), (bias - SD_LIMIT * sd).alias("loa_lo")]
    out = pairs.groupBy(*by).agg(*reported)
    if coi.startswith("Euclidean_Norm"):
        return out.withColumns({"centre": F.col("bias"), "limit_hi": F.col("bias") + SD_LIMIT * F.col("sd"), "limit_lo": F.col("bias") - SD_LIMIT * F.col("sd")})
    drawn = quantiles(pairs, "Difference", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, by)
    spread = IQR_LIMIT * (F.col("q._q3") - F.col("q._q1"))
    joined = out.alias("o").join(drawn.alias("q"), same("o", "q", list(by)), "left")
    return joined.select("o.*", F.col("q._q2").alias("centre"), (F.col("q._q2") + spread).alias("limit_hi"), (F.col("q._q2") - spread).alias("limit_lo"))


def with_limits(pairs: DataFrame, coi: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each pair with its group's limits and place: within, outside or null (no limits)."""
    summary = bland_altman(pairs, coi, by)
    if by:
        mine, theirs = pairs.alias("p"), summary.alias("s")
        same = F.lit(True)
        for k in by:
            same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
        out = mine.join(theirs, same).select("p.*", *[f"s.{c}" for c in summary.columns if c not in by])
    else:
        one = F.lit(1)
        out = pairs.withColumn("_one", one).join(F.broadcast(summary.withColumn("_one", one)), "_one").drop("_one")  # one row
    within = F.col("Difference").between(F.col("loa_lo"), F.col("loa_hi"))
    return out.withColumn("within", within)


def outliers(pairs: DataFrame, coi: str, by: tuple[str, ...] = ()) -> DataFrame:
    return with_limits(pairs, coi, by).where(~F.col("within")).select(*GROUP, "Area", "Electrode", "m1", "m2", "Difference")


def loa_report(pairs: DataFrame, coi: str, by: tuple[str, ...] = (), marked_area: str = "rDLPFC") -> DataFrame:
    out = with_limits(pairs, coi, by)
    out = out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("within").alias("within_n"), F.count_if(~F.col("within")).alias("outside_n"),
        F.count_if(~F.col("within") & (F.col("Area") == marked_area)).alias("outside_marked"),
    )
    return out.withColumn("within_percent", F.col("within_n") * 100.0 / F.col("total"))


def displayed(summary: DataFrame, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """The drawn values as they are shown: n, bias, upper and lower limit, rounded."""
    shown = {"bias": "centre", "upper": "limit_hi", "lower": "limit_lo"}
    return summary.select(*by, "n", *[F.round(c, digits).alias(n) for n, c in shown.items()])


def report_text(report: DataFrame) -> DataFrame:
    """The report as lines of text."""
    return report.select(F.explode(F.array(
        F.format_string("Total points: %d", "total"), F.format_string("Points within limits: %d (%.2f%%)", "within_n", "within_percent"), F.format_string("Points outside limits: %d", "outside_n"),
    )).alias("value"))


def agreement_sequence(df: DataFrame, human: tuple[str, ...], pairs=PAIRS, coi=COORDINATES_OF_INTEREST, chained: bool = True) -> list[tuple[str, str, str, DataFrame]]:
    """(coordinate, method, method, pairs) in order. Chained, each step sees only
    the (Subject, Session, run) that the step before kept, so keys shrink; kept keys are
    written, so that no step plans the steps before it again."""
    out, kept = [], None
    for c in coi:
        for m1, m2 in pairs:
            rows = for_methods(df, m1, m2, human)
            if chained and kept is not None:
                same = F.lit(True)
                for k in GROUP:
                    same = same & rows[k].eqNullSafe(kept[f"_{k}"])
                rows = rows.join(kept, same, "left_semi")
            found = paired_methods(repeat_baseline(vectors(rows)) if BASELINE in (m1, m2) else vectors(rows), c, m1, m2)
            out.append((c, m1, m2, found))
            if chained:
                kept = materialize(found.select(*[F.col(k).alias(f"_{k}") for k in GROUP]).distinct(), "kept")
    return out


def outlier_coordinates(found: DataFrame, measurements: DataFrame, method: str, rater: str) -> DataFrame:
    """X, Y, Z of each outlier in one method by one rater: one join, then a pivot."""
    keys = [*GROUP, "Electrode"]
    name = HALF if method == SEMI else method
    rows = measurements.where((F.col("Method") == name) & (F.col("Rater") == rater))
    points = rows.groupBy(*keys).agg(*[F.min_by("Coordinates", F.when(F.col("Dimension") == d, F.struct("Experiment", "Coordinates"))).alias(d) for d in DIMENSIONS])
    return found.select(*keys).distinct().join(points, keys)
