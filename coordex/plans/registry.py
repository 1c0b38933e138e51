"""Queries over the driver's tables and the SQL each is held against."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordex.config import AREAS, FULL, HALF, MANUAL, PLACEHOLDER, SEMI
from coordex.functions import geometry as G
from coordex.functions import text as X
from coordex.operators import agreement as A
from coordex.operators import clusters as C
from coordex.operators import correct as K
from coordex.operators import masks as M
from coordex.operators import reshape as R
from coordex.operators import sampling as S
from coordex.operators import stats as T
from coordex.operators import volumes as W
from coordex.plans import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sql_rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _vectors(spark, d):
    return A.vectors(A.recode_methods(V.measurements(spark, d)))


def _pairs(spark, d, coi="Euclidean_Norm", m1=FULL, m2=SEMI):
    return A.paired_methods(_vectors(spark, d), coi, m1, m2)


# ---- reshaping


@query("positions_long", f"WITH {V.E} SELECT 'YourExperimentName' AS Experiment, Subject, Session, run, 'Network' AS Rater, 'full-automated' AS Method, Electrode, ['X', 'Y', 'Z'][d] AS Dimension, h[d] AS Coordinates FROM e1, (SELECT unnest([1, 2, 3]) AS d)")
def positions_long(spark, d):
    return R.to_long(V.positions(spark, d))


@query("positions_round_trip", f"WITH {V.E} SELECT Subject AS subject, Session AS session, run, max(CASE WHEN idx = 0 THEN h[1] END) AS ax, max(CASE WHEN idx = 1 THEN h[2] END) AS c1y, max(CASE WHEN idx = 3 THEN h[3] END) AS c3z FROM e1 GROUP BY ALL")
def positions_round_trip(spark, d):
    w = R.to_wide(R.to_long(V.positions(spark, d)))
    return w.select("subject", "session", "run", F.col("anode_mni")[0].alias("ax"), F.col("cathode1_mni")[1].alias("c1y"), F.col("cathode3_mni")[2].alias("c3z"))


@query("parse_vector", f"WITH {V.E} SELECT image, idx, h[1] AS x, h[2] AS y, h[3] AS z FROM e1")
def parse_vector(spark, d):
    e = V.electrodes(spark, d)
    p = X.parse_vector(X.format_vector(F.col("h")))
    return e.select("image", "idx", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))


@query("merge_measurements", f"WITH {V.M} SELECT *, CAST(NULL AS VARCHAR) AS date FROM ml WHERE Method = 'full-automated' UNION ALL SELECT *, '2020' FROM ml WHERE Method <> 'full-automated'")
def merge_measurements(spark, d):
    m = V.measurements(spark, d)
    return R.merge_measurements(m.where(F.col("Method") == FULL), m.where(F.col("Method") != FULL).withColumn("date", F.lit("2020")))


# ---- agreement


@query("vectors_pivot", f"WITH {V.V} SELECT * EXCLUDE (X, Y, Z, Euclidean_Norm), {sql_rounded('X', 'Y', 'Z', 'Euclidean_Norm')} FROM vn")
def vectors_pivot(spark, d):
    return rounded(_vectors(spark, d), "X", "Y", "Z", "Euclidean_Norm")


@query("paired_methods", f"WITH {V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)} SELECT Subject, Session, run, Area, Electrode, {sql_rounded('m1', 'm2', 'Difference', 'Mean')} FROM pr")
def paired_methods(spark, d):
    return rounded(_pairs(spark, d).drop("n1", "n2"), "m1", "m2", "Difference", "Mean")


_LOA = "count(Difference) AS n, avg(Difference) AS bias, stddev_samp(Difference) AS sd, avg(Difference) + 1.96::DOUBLE * stddev_samp(Difference) AS loa_hi, avg(Difference) - 1.96::DOUBLE * stddev_samp(Difference) AS loa_lo"
_ROBUST = "median(Difference) AS centre, median(Difference) + 1.5::DOUBLE * (quantile_cont(Difference, 0.75) - quantile_cont(Difference, 0.25)) AS limit_hi, median(Difference) - 1.5::DOUBLE * (quantile_cont(Difference, 0.75) - quantile_cont(Difference, 0.25)) AS limit_lo"
_SEVEN = ("bias", "sd", "loa_hi", "loa_lo", "centre", "limit_hi", "limit_lo")


@query("bland_altman_mean_sd", f"WITH {V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)}, s AS (SELECT {_LOA} FROM pr) SELECT n, {sql_rounded('bias', 'sd', 'loa_hi', 'loa_lo')}, round(bias, 6) AS centre, round(loa_hi, 6) AS limit_hi, round(loa_lo, 6) AS limit_lo FROM s")
def bland_altman_mean_sd(spark, d):
    return rounded(A.bland_altman(_pairs(spark, d), "Euclidean_Norm"), *_SEVEN)


@query("bland_altman_median_iqr", f"WITH {V.V}, {V.pair_sql('X', FULL, MANUAL)}, s AS (SELECT {_LOA}, {_ROBUST} FROM pr) SELECT n, {sql_rounded(*_SEVEN)} FROM s")
def bland_altman_median_iqr(spark, d):
    return rounded(A.bland_altman(_pairs(spark, d, "X", FULL, MANUAL), "X"), *_SEVEN)


@query("bland_altman_by_electrode", f"WITH {V.V}, {V.pair_sql('Y', SEMI, MANUAL)}, s AS (SELECT Area, Electrode, {_LOA}, {_ROBUST} FROM pr GROUP BY Area, Electrode) SELECT Area, Electrode, n, {sql_rounded(*_SEVEN)} FROM s")
def bland_altman_by_electrode(spark, d):
    return rounded(A.bland_altman(_pairs(spark, d, "Y", SEMI, MANUAL), "Y", ("Area", "Electrode")), *_SEVEN)


_LIMITED = f"{V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)}, s AS (SELECT {_LOA} FROM pr)"


@query("displayed_limits", f"WITH {V.V}, {V.pair_sql('X', FULL, MANUAL)}, s AS (SELECT {_LOA}, {_ROBUST} FROM pr) SELECT n, round(centre, 4) AS bias, round(limit_hi, 4) AS upper, round(limit_lo, 4) AS lower FROM s")
def displayed_limits(spark, d):
    return A.displayed(A.bland_altman(_pairs(spark, d, "X", FULL, MANUAL), "X"))


@query("loa_outliers", f"WITH {_LIMITED} SELECT Subject, Session, run, Area, Electrode, {sql_rounded('m1', 'm2', 'Difference')} FROM pr, s WHERE NOT (Difference BETWEEN loa_lo AND loa_hi)")
def loa_outliers(spark, d):
    return rounded(A.outliers(_pairs(spark, d), "Euclidean_Norm"), "m1", "m2", "Difference")


@query("loa_report", f"WITH {_LIMITED} SELECT count(*) AS total, count(*) FILTER (Difference BETWEEN loa_lo AND loa_hi) AS within_n, count(*) FILTER (NOT Difference BETWEEN loa_lo AND loa_hi) AS outside_n, count(*) FILTER (NOT Difference BETWEEN loa_lo AND loa_hi AND Area = 'rDLPFC') AS outside_marked, round(count(*) FILTER (Difference BETWEEN loa_lo AND loa_hi) * 100.0::DOUBLE / count(*), 6) AS within_percent FROM pr, s")
def loa_report(spark, d):
    return rounded(A.loa_report(_pairs(spark, d), "Euclidean_Norm"), "within_percent")


@query("outlier_coordinates", f"WITH {_LIMITED}, o AS (SELECT DISTINCT Subject, Session, run, Electrode FROM pr, s WHERE NOT (Difference BETWEEN loa_lo AND loa_hi)) SELECT o.*, h[1] AS X, h[2] AS Y, h[3] AS Z FROM o JOIN e1 USING (Subject, Session, run, Electrode)")
def outlier_coordinates(spark, d):
    found = A.outliers(_pairs(spark, d), "Euclidean_Norm")
    return A.outlier_coordinates(found, V.measurements(spark, d), SEMI, V.RATERS[HALF])


@query("method_filter", f"WITH {V.M} SELECT * FROM ml WHERE Method IN ('half-automated', 'manually') AND Rater IN ('human_a')")
def method_filter(spark, d):
    return A.for_methods(V.measurements(spark, d), HALF, MANUAL, ("human_a",))


def _partial(spark, d):
    """Methods missing for some runs, so that a chain of passes loses keys."""
    m = A.recode_methods(V.measurements(spark, d))
    s = F.substring("Subject", 5, 3).cast("int")
    return m.where(~((F.col("Method") == MANUAL) & (s % 3 == 0)) & ~((F.col("Method") == SEMI) & (s % 4 == 1)))


_PARTIAL = V.V + """, part AS (SELECT * FROM vn WHERE NOT (Method = 'manually' AND CAST(substr(Subject, 5, 3) AS INTEGER) % 3 = 0) AND NOT (Method = 'semi-automated' AND CAST(substr(Subject, 5, 3) AS INTEGER) % 4 = 1))"""


@query("chained_semijoin", f"WITH {_PARTIAL}, {V.pair_sql('Euclidean_Norm', FULL, SEMI, 'p1', 'part')}, {V.pair_sql('Euclidean_Norm', FULL, MANUAL, 'p2', '(SELECT * FROM part WHERE (Subject, Session, run) IN (SELECT (Subject, Session, run) FROM p1))')}, {V.pair_sql('Euclidean_Norm', SEMI, MANUAL, 'p3', '(SELECT * FROM part WHERE (Subject, Session, run) IN (SELECT (Subject, Session, run) FROM p2))')} SELECT 1 AS step, Subject, count(*) AS n FROM p1 GROUP BY Subject UNION ALL SELECT 2, Subject, count(*) FROM p2 GROUP BY Subject UNION ALL SELECT 3, Subject, count(*) FROM p3 GROUP BY Subject")
def chained_semijoin(spark, d):
    steps = A.agreement_sequence(_partial(spark, d), V.HUMAN, coi=("Euclidean_Norm",))
    out = None
    for i, (*_, p) in enumerate(steps):
        n = p.groupBy("Subject").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i + 1).alias("step"), "Subject", "n")
        out = n if out is None else out.unionByName(n)
    return out


def _with_baseline(spark, d):
    v = _vectors(spark, d)
    first = (F.col("Method") == MANUAL) & (F.col("Session") == "ses-1") & (F.col("run") == "run-01")
    return v.withColumn("Method", F.when(first, "baseline").otherwise(F.col("Method")))


@query("baseline_repeat", f"WITH {V.V}, b AS (SELECT * REPLACE (CASE WHEN Method = 'manually' AND Session = 'ses-1' AND run = 'run-01' THEN 'baseline' ELSE Method END AS Method) FROM vn), t AS (SELECT DISTINCT Subject, Session, run, Area, Electrode FROM b WHERE Method <> 'baseline'), r AS (SELECT t.*, b.Method, b.X FROM t LEFT JOIN (SELECT * FROM b WHERE Method = 'baseline') b ON t.Subject = b.Subject AND t.Area IS NOT DISTINCT FROM b.Area AND t.Electrode = b.Electrode) SELECT *  REPLACE (round(X, 6) AS X) FROM (SELECT Subject, Session, run, Area, Electrode, Method, X FROM b WHERE Method <> 'baseline' UNION ALL SELECT * FROM r)")
def baseline_repeat(spark, d):
    return rounded(A.repeat_baseline(_with_baseline(spark, d)).select("Subject", "Session", "run", "Area", "Electrode", "Method", "X"), "X")


@query("baseline_pairs", f"WITH {V.V}, b AS (SELECT * REPLACE (CASE WHEN Method = 'manually' AND Session = 'ses-1' AND run = 'run-01' THEN 'baseline' ELSE Method END AS Method) FROM vn WHERE Rater <> 'Network'), s AS (SELECT * FROM b WHERE Method = 'semi-automated'), {V.pair_sql('Euclidean_Norm', 'baseline', SEMI, source='(SELECT Subject, Session, run, Area, Electrode, Method, Euclidean_Norm FROM s UNION ALL SELECT s.Subject, s.Session, s.run, s.Area, s.Electrode, b.Method, b.Euclidean_Norm FROM s JOIN b ON b.Subject = s.Subject AND b.Area = s.Area AND b.Electrode = s.Electrode AND b.Method = $$baseline$$)')} SELECT Subject, Session, run, Area, Electrode, {sql_rounded('m1', 'm2', 'Difference')} FROM pr")
def baseline_pairs(spark, d):
    m = A.recode_methods(V.measurements(spark, d))
    first = (F.col("Method") == MANUAL) & (F.col("Session") == "ses-1") & (F.col("run") == "run-01")
    m = m.withColumn("Method", F.when(first, "baseline").otherwise(F.col("Method")))
    ((*_, found),) = A.agreement_sequence(m, V.HUMAN, pairs=(("baseline", SEMI),), coi=("Euclidean_Norm",))
    return rounded(found.select("Subject", "Session", "run", "Area", "Electrode", "m1", "m2", "Difference"), "m1", "m2", "Difference")


@query("normalize_measurements", f"WITH {V.M} SELECT Experiment, Subject, Session, CASE WHEN Session = 'ses-1' AND run = 'run-01' THEN 'baseline' ELSE run END AS run, Rater, CASE WHEN Session = 'ses-1' AND run = 'run-01' THEN 'baseline' WHEN Method = 'half-automated' THEN 'semi-automated' ELSE Method END AS Method, Electrode, Dimension, Coordinates FROM ml")
def normalize_measurements(spark, d):
    first = (F.col("Session") == "ses-1") & (F.col("run") == "run-01")
    m = V.measurements(spark, d).withColumn("run", F.when(first, "baseline").otherwise(F.col("run")))
    m = m.withColumn("Experiment", F.when(F.col("Session") == "ses-2", PLACEHOLDER).otherwise(F.col("Experiment")))
    return A.normalize_measurements(m.withColumn("Unnamed: 0", F.lit(1)).withColumn("date", F.lit("2020")))


@query("experiment_backfill", "SELECT event_id, user_id, CASE WHEN e = 'YourExperimentName' THEN min(CASE WHEN e LIKE 'P%' THEN e END) OVER (PARTITION BY user_id) ELSE e END AS Experiment FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'YourExperimentName' WHEN event_id % 3 = 1 THEN 'P' || (event_id % 7) ELSE event_type END AS e FROM events)")
def experiment_backfill(spark, d):
    e = F.when(F.col("event_id") % 3 == 0, "YourExperimentName").when(F.col("event_id") % 3 == 1, F.concat(F.lit("P"), (F.col("event_id") % 7).cast("string"))).otherwise(F.col("event_type"))
    rows = V.read(spark, d, "events").select("event_id", F.col("user_id").alias("Subject"), e.alias("Experiment"))
    return A.backfill_experiment(rows).withColumnRenamed("Subject", "user_id")


@query("recode_methods", "SELECT event_id, run, CASE WHEN run = 'baseline' THEN 'baseline' WHEN m = 'half-automated' THEN 'semi-automated' ELSE m END AS Method FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'baseline' ELSE 'run-01' END AS run, CASE WHEN event_id % 2 = 0 THEN 'half-automated' ELSE event_type END AS m FROM events)")
def recode_methods(spark, d):
    rows = V.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "baseline").otherwise("run-01").alias("run"), F.when(F.col("event_id") % 2 == 0, HALF).otherwise(F.col("event_type")).alias("Method"))
    return A.recode_methods(rows)


@query("area_case", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'rOTC' WHEN 1 THEN 'lTPJ' WHEN 2 THEN 'rDLPFC' END AS Area FROM events")
def area_case(spark, d):
    names = F.array(*[F.lit(x) for x in (*AREAS, "P9", "other")])
    return V.read(spark, d, "events").select("event_id", A.area(F.get(names, (F.col("event_id") % 5).cast("int"))).alias("Area"))


# ---- correction


@query("first_by_struct", "SELECT o_custkey, arg_min(o_totalprice, (o_orderstatus, o_orderpriority, o_totalprice)) AS first_price FROM orders GROUP BY o_custkey")
def first_by_struct(spark, d):
    return V.read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", F.struct("o_orderstatus", "o_orderpriority", "o_totalprice")).alias("first_price"))


def _dist(e: int, c: int) -> str:
    return "sqrt(" + " + ".join(f"(H[{e}][{k}] - P[{c}][{k}]) * (H[{e}][{k}] - P[{c}][{k}])" for k in (1, 2, 3)) + ")"


def _greedy_sql() -> str:
    """One step an electrode: the nearest name not used; used only if it is another's."""
    out = V.E + """, g0 AS (
  SELECT Subject, Session, run, list(h ORDER BY Electrode) AS H FROM e1 GROUP BY ALL
), g1 AS (SELECT Subject, Session, run, list(f ORDER BY FullElectrode) AS P FROM e1 GROUP BY ALL),
s0 AS (SELECT *, CAST([] AS INTEGER[]) AS used FROM g0 JOIN g1 USING (Subject, Session, run))"""
    for e in range(1, 5):
        free = ", ".join(f"CASE WHEN NOT list_contains(used, {c}) THEN {{'d': {_dist(e, c)}, 'c': {c}}} END" for c in range(1, 5))
        out += f""", b{e} AS (SELECT *, list_sort(list_filter([{free}], lambda x: x IS NOT NULL))[1].c AS t{e} FROM s{e - 1}),
s{e} AS (SELECT * REPLACE (CASE WHEN t{e} <> {e} THEN list_append(used, t{e}) ELSE used END AS used) FROM b{e})"""
    return out


_GREEDY = _greedy_sql()


@query("greedy_match", f"WITH {_GREEDY} SELECT Subject, Session, run, t1 - 1 AS t1, t2 - 1 AS t2, t3 - 1 AS t3, t4 - 1 AS t4 FROM s4")
def greedy_match(spark, d):
    m = K.matching(V.measurements(spark, d), partial=True)
    return m.select("Subject", "Session", "run", *[F.col("to")[k].alias(f"t{k + 1}") for k in range(4)])


@query("correct_electrodes", f"WITH {_GREEDY}, fixed AS (SELECT Subject, Session, run, e, P[[t1, t2, t3, t4][e]] AS p FROM s4, (SELECT unnest([1, 2, 3, 4]) AS e)), everything AS (SELECT Subject, Session, run, 'full-automated' AS Method, ['Anode', 'Cathode1', 'Cathode2', 'Cathode3'][e] AS Electrode, p FROM fixed UNION ALL SELECT Subject, Session, run, 'half-automated', Electrode, h FROM e1 UNION ALL SELECT Subject, Session, run, 'manually', Electrode, m FROM e1) SELECT Subject, Session, run, Method, Electrode, ['X', 'Y', 'Z'][d] AS Dimension, p[d] AS Coordinates FROM everything, (SELECT unnest([1, 2, 3]) AS d)")
def correct_electrodes(spark, d):
    return K.correct_electrodes(V.measurements(spark, d), partial=True).drop("Experiment", "Rater")


@query("excluded_rater", f"WITH {V.M} SELECT Method, count(*) AS n FROM (SELECT *, CASE WHEN Electrode = 'Anode' THEN NULL ELSE Rater END AS r FROM ml) WHERE r IS DISTINCT FROM 'human_a' GROUP BY Method")
def excluded_rater(spark, d):
    m = V.measurements(spark, d).withColumn("Rater", F.when(F.col("Electrode") != "Anode", F.col("Rater")))
    return K.without_raters(m, ("human_a",)).groupBy("Method").agg(F.count(F.lit(1)).alias("n"))


def _assigned_sql() -> str:
    ways = []
    for i, p in enumerate(permutations(range(4))):
        total = " + ".join(_dist(e + 1, c + 1) for e, c in enumerate(p))
        ways.append(f"{{'d': {total}, 'i': {i}, 'to': {list(p)}}}")
    return f"WITH {_GREEDY}, w AS (SELECT Subject, Session, run, list_sort([{', '.join(ways)}])[1] AS best FROM s0) SELECT Subject, Session, run, best.to[1] AS t1, best.to[2] AS t2, best.to[3] AS t3, best.to[4] AS t4 FROM w"


@query("assign_match", _assigned_sql())
def assign_match(spark, d):
    m = K.matching(V.measurements(spark, d), mode="assignment", partial=True)
    return m.select("Subject", "Session", "run", *[F.col("to")[k].alias(f"t{k + 1}") for k in range(4)])


# ---- clusters


def _checked(spark, d):
    e = V.electrodes(spark, d).select(F.col("image").alias("image_id"), F.col("idx").alias("label"), F.struct(*[F.col("c")[k].alias(n) for k, n in enumerate("ijk")]).alias("com"))
    return C.validate_configuration(e, e.select("image_id"), labels=(0, 1, 2, 3)).where("n > 1")


_CD = "sqrt((a.c[1] - b.c[1]) * (a.c[1] - b.c[1]) + (a.c[2] - b.c[2]) * (a.c[2] - b.c[2]) + (a.c[3] - b.c[3]) * (a.c[3] - b.c[3]))"
_HUB = V.E + f", hubs AS (SELECT a.image, a.idx, bool_and({_CD} BETWEEN 5 AND 70) AS ok FROM e1 a JOIN e1 b ON a.image = b.image AND a.idx <> b.idx GROUP BY a.image, a.idx)"


@query("hub_valid", f"WITH {_HUB} SELECT image AS image_id, bool_or(ok) AS valid FROM hubs GROUP BY image")
def hub_valid(spark, d):
    return _checked(spark, d).select("image_id", "valid")


@query("extract_positions", f"WITH {_HUB}, ok AS (SELECT image FROM hubs GROUP BY image HAVING bool_or(ok)) SELECT image AS image_id, max(CASE WHEN idx = 0 THEN 90 - c[1] END) AS ax, max(CASE WHEN idx = 2 THEN c[2] - 126 END) AS c2y, max(CASE WHEN idx = 3 THEN c[3] - 72 END) AS c3z FROM e1 JOIN ok USING (image) GROUP BY image")
def extract_positions(spark, d):
    checked = _checked(spark, d)
    affine = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in _AFFINE])
    meta = checked.select("image_id", F.lit("s").alias("subject"), F.lit("1").alias("session"), F.col("image_id").cast("string").alias("run"), affine.alias("affine"))
    p = C.extract_positions(checked, meta)
    return p.select(F.col("run").cast("long").alias("image_id"), F.col("anode_mni")[0].alias("ax"), F.col("cathode2_mni")[1].alias("c2y"), F.col("cathode3_mni")[2].alias("c3z"))


_ALL12 = [(e, n, k) for e, n in enumerate(("anode", "cathode1", "cathode2", "cathode3")) for k in range(3)]


@query("positions_extracted", f"WITH {_HUB}, ok AS (SELECT image FROM hubs GROUP BY image HAVING bool_or(ok)) SELECT image AS image_id, {', '.join(f'max(CASE WHEN idx = {e} THEN ' + ('90 - c[1]', 'c[2] - 126', 'c[3] - 72')[k] + f' END) AS {n}_{c}' for (e, n, k), c in zip(_ALL12, 'xyz' * 4))} FROM e1 JOIN ok USING (image) GROUP BY image")
def positions_extracted(spark, d):
    checked = _checked(spark, d)
    affine = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in _AFFINE])
    meta = checked.select("image_id", F.lit("s").alias("subject"), F.lit("1").alias("session"), F.col("image_id").cast("string").alias("run"), affine.alias("affine"))
    p = C.extract_positions(checked, meta)
    return p.select(F.col("run").cast("long").alias("image_id"), *[F.col(f"{n}_mni")[k].alias(f"{n}_{c}") for (_, n, k), c in zip(_ALL12, "xyz" * 4)])


@query("size_filter", "WITH c AS (SELECT l_suppkey AS image_id, l_linenumber % (1 + l_suppkey % 7) * 10 + CAST(l_partkey % 7 = 0 AS INTEGER) AS label, count(*) AS size FROM lineitem GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, avg(size) OVER (PARTITION BY image_id) AS mean FROM c) SELECT image_id, label, size FROM w WHERE n <= 4 OR size >= 0.2::DOUBLE * mean")
def size_filter(spark, d):
    rows, image = V.read(spark, d, "lineitem"), F.col("l_suppkey")
    label = F.col("l_linenumber") % (1 + image % 7) * 10 + (F.col("l_partkey") % 7 == 0).cast("int")
    c = rows.groupBy(image.alias("image_id"), label.alias("label")).agg(F.count(F.lit(1)).alias("size"))
    return C.filter_clusters(c)


_COMPONENTS = f"""vox AS ({V.EVERY_VOX}), n AS (SELECT *, (i * 12 + j) * 8 + k AS id FROM vox),
edge AS (SELECT a.image_id, a.id AS s, b.id AS t FROM n a JOIN n b ON a.image_id = b.image_id AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
walk AS (SELECT image_id, id, id AS root FROM n UNION SELECT w.image_id, e.t, w.root FROM walk w JOIN edge e ON w.image_id = e.image_id AND w.id = e.s),
lab AS (SELECT image_id, id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM (SELECT image_id, id, min(root) AS root FROM walk GROUP BY ALL)),
stats AS (SELECT image_id, CAST(label AS INTEGER) AS label, count(*) AS size, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM lab JOIN n USING (image_id, id) GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, avg(size) OVER w AS mean FROM stats WINDOW w AS (PARTITION BY image_id)) WHERE n <= 4 OR size >= 0.2::DOUBLE * mean)"""


@query("components", f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, size, {sql_rounded('ci', 'cj', 'ck')} FROM stats")
def components(spark, d):
    s = C.cluster_stats(C.label_components(V.voxels(spark, d)))
    return s.select("image_id", "label", "size", *[F.round(F.col("com")[c], 6).alias(f"c{c}") for c in "ijk"])


_CLASSED = f"""{_COMPONENTS}, img AS (SELECT s_suppkey * 4 + f AS image_id FROM supplier, (SELECT unnest([0, 1, 2]) AS f) UNION ALL SELECT -1), per AS (SELECT image_id, count(*) AS n FROM kept GROUP BY image_id),
far AS (SELECT a.image_id, a.label, bool_and(sqrt((a.ci - b.ci) * (a.ci - b.ci) + (a.cj - b.cj) * (a.cj - b.cj) + (a.ck - b.ck) * (a.ck - b.ck)) BETWEEN 1.5 AND 70) AS ok FROM kept a JOIN kept b ON a.image_id = b.image_id AND a.label <> b.label GROUP BY ALL),
ch AS (SELECT img.image_id, coalesce(n, 0) AS n, coalesce(n = 4 AND (SELECT bool_or(ok) FROM far WHERE far.image_id = img.image_id), FALSE) AS valid,
  CASE coalesce(n, 0) WHEN 0 THEN 'no_clusters' WHEN 1 THEN 'one_cluster' WHEN 2 THEN 'two_clusters' WHEN 3 THEN 'three_clusters' WHEN 4 THEN 'four_clusters' ELSE 'more_than_four' END AS class FROM img LEFT JOIN per USING (image_id))"""


def _classed(spark, d):
    kept = C.filter_clusters(C.cluster_stats(C.label_components(V.voxels(spark, d))))
    return C.validate_configuration(kept, V.images(spark, d), near=1.5)


@query("extraction_counts", f"WITH RECURSIVE {_CLASSED} SELECT 'processed_images' AS counter, count(*) AS value FROM ch UNION ALL SELECT 'valid_configurations', count(*) FROM ch WHERE valid UNION ALL SELECT 'invalid_configurations', count(*) FROM ch WHERE NOT valid UNION ALL SELECT c, count(*) FILTER (class = c) FROM ch, (SELECT unnest(['no_clusters', 'one_cluster', 'two_clusters', 'three_clusters', 'more_than_four']) AS c) GROUP BY c")
def extraction_counts(spark, d):
    return C.extraction_report(_classed(spark, d))


@query("extraction_ids", f"WITH RECURSIVE {_CLASSED} SELECT class, string_agg(image_id::VARCHAR, ',' ORDER BY image_id::VARCHAR) AS ids FROM ch WHERE class <> 'four_clusters' GROUP BY class")
def extraction_ids(spark, d):
    return C.extraction_ids(_classed(spark, d))


@query("extraction_id_rows", f"WITH RECURSIVE {_CLASSED} SELECT class, image_id FROM ch WHERE class <> 'four_clusters'")
def extraction_id_rows(spark, d):
    return C.extraction_id_rows(_classed(spark, d))


# ---- statistics


@query("icc11", f"WITH {V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)}, s AS (SELECT count(*) AS n, 2 * var_samp((m1 + m2) / 2) AS msb, avg((m1 - m2) * (m1 - m2) / 2) AS msw FROM pr) SELECT n, {sql_rounded('msb', 'msw')}, round((msb - msw) / (msb + msw), 6) AS icc, round(msb / msw, 6) AS f FROM s")
def icc11(spark, d):
    return rounded(T.icc11(_pairs(spark, d)), "msb", "msw", "icc", "f")


@query("icc_subsets", f"WITH {V.V}, {V.pair_sql('X', SEMI, MANUAL)}, s AS (SELECT Area, Electrode, count(*) AS n, 2 * var_samp((m1 + m2) / 2) AS msb, avg((m1 - m2) * (m1 - m2) / 2) AS msw FROM pr GROUP BY Area, Electrode) SELECT Area, Electrode, n, {sql_rounded('msb', 'msw')}, round((msb - msw) / (msb + msw), 6) AS icc, round(msb / msw, 6) AS f FROM s")
def icc_subsets(spark, d):
    return rounded(T.icc11(_pairs(spark, d, "X", SEMI, MANUAL), by=("Area", "Electrode")), "msb", "msw", "icc", "f")


@query("icc_interval")
def icc_interval(spark, d):
    return T.icc_interval(T.icc11(_pairs(spark, d, "X", SEMI, MANUAL), by=("Area", "Electrode")))


@query("qq_points", "SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY value) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY event_type) AS position FROM events WHERE value IS NOT NULL")
def qq_points(spark, d):
    return T.qq_points(V.read(spark, d, "events"), "value", "event_type")


@query("ks_normal")
def ks_normal(spark, d):
    return T.ks_normal(_pairs(spark, d), "Difference")


@query("shapiro")
def shapiro(spark, d):
    return T.shapiro(_pairs(spark, d), "Difference", "Electrode")


def _shapiro_sql() -> str:
    poly = lambda c: " + ".join(f"{k!r}::DOUBLE * pow(1 / sqrt(n), {p})" for p, k in enumerate(c) if k)
    return f"""WITH {V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)},
x AS (SELECT Electrode, Difference - avg(Difference) OVER (PARTITION BY Electrode) AS d, row_number() OVER (PARTITION BY Electrode ORDER BY Difference) AS k, count(*) OVER (PARTITION BY Electrode) AS n FROM pr),
y AS (SELECT *, {T.normal_score("((k - 0.375e0) / (n + 0.25e0))")} AS m FROM x),
g AS (SELECT Electrode, n, sum(m * m) AS total, sum(m * d) AS md, sum(d * d) AS dd, max(m) FILTER (k = n) AS m1, max(m) FILTER (k = n - 1) AS m2,
  max(d) FILTER (k = n) - max(d) FILTER (k = 1) AS s1, max(d) FILTER (k = n - 1) - max(d) FILTER (k = 2) AS s2 FROM y GROUP BY Electrode, n),
t AS (SELECT *, {poly(T._C1)} + m1 / sqrt(total) AS t1, {poly(T._C2)} + m2 / sqrt(total) AS t2 FROM g),
b AS (SELECT *, (md - m1 * s1 - m2 * s2) / sqrt((total - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * t1 * t1 - 2 * t2 * t2)) + t1 * s1 + t2 * s2 AS b FROM t)
SELECT Electrode, round(b * b / dd, 6) AS w, n FROM b"""


@query("shapiro_w", _shapiro_sql())
def shapiro_w(spark, d):
    return rounded(T.shapiro_sums(_pairs(spark, d), "Difference", "Electrode"), "w")


@query("ks_statistic", f"WITH {V.V}, {V.pair_sql('Euclidean_Norm', FULL, SEMI)}, x AS (SELECT Electrode, {T.normal_share('Difference')} AS share, row_number() OVER (PARTITION BY Electrode ORDER BY Difference) AS k, count(*) OVER (PARTITION BY Electrode) AS n FROM pr) SELECT Electrode, n, round(max(greatest(k / n - share, share - (k - 1) / n)), 6) AS statistic FROM x GROUP BY Electrode, n")
def ks_statistic(spark, d):
    return rounded(T.ks_statistic(_pairs(spark, d), "Difference", ("Electrode",)), "statistic")


# ---- masks and volumes


_MASKS = f"a AS ({V.VOX.format(flag='A')}), b AS ({V.VOX.format(flag='R')})"


@query("mask_dice_iou", f"WITH {_MASKS}, j AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, a.i AS p, b.i AS t FROM a FULL JOIN b USING (image_id, i, j, k)), s AS (SELECT image_id, count(*) FILTER (p IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY image_id) SELECT *, CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS dice, CASE WHEN tp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END AS iou FROM s")
def mask_dice_iou(spark, d):
    return M.overlap(V.voxels(spark, d, "A"), V.voxels(spark, d, "R"))


@query("hausdorff", f"WITH {_MASKS}, d AS (SELECT a.image_id, (a.i, a.j, a.k) AS x, (b.i, b.j, b.k) AS y, (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k) AS q FROM a JOIN b USING (image_id)), m AS (SELECT image_id, min(q) AS q FROM d GROUP BY image_id, x UNION ALL SELECT image_id, min(q) FROM d GROUP BY image_id, y) SELECT image_id, sqrt(max(q)) AS hausdorff FROM m GROUP BY image_id")
def hausdorff(spark, d):
    return M.hausdorff(V.voxels(spark, d, "A"), V.voxels(spark, d, "R"))


@query("minmax_scale", "SELECT p_partkey, p_brand, (p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0) AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def minmax_scale(spark, d):
    return M.minmax(V.read(spark, d, "part"), "p_retailprice", ("p_brand",)).select("p_partkey", "p_brand", "scaled")


@query("binarise", "SELECT event_id, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM events")
def binarise(spark, d):
    return M.binarise(V.read(spark, d, "events").select("event_id", (F.col("value") - 50).alias("v")))


@query("busiest_slice", f"WITH v AS ({V.EVERY_VOX}), s AS (SELECT image_id, k, sum(i + j)::DOUBLE AS total FROM v GROUP BY ALL) SELECT image_id, k, total FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY total DESC, k) = 1")
def busiest_slice(spark, d):
    return M.busiest_slice(V.voxels(spark, d).withColumn("v", (F.col("i") + F.col("j")).cast("double")))


_SIDES = "SELECT image_id, 'axial' AS plane, 11 - j AS row, i AS col FROM v WHERE k = 3 UNION ALL SELECT image_id, 'sagittal', 7 - k, i FROM v WHERE j = image_id % 4 UNION ALL SELECT image_id, 'coronal', 7 - k, j FROM v WHERE i = image_id % 3"


@query("orthogonal_slices", f"WITH v AS ({V.EVERY_VOX}) {_SIDES}")
def orthogonal_slices(spark, d):
    image = F.col("image_id")
    points = V.images(spark, d).select(image, (image % 3).alias("i"), (image % 4).alias("j"), F.lit(3).alias("k"), F.array(*[F.lit(n) for n in (12, 12, 8)]).alias("shape"))
    return M.orthogonal_slices(V.voxels(spark, d), points)


@query("stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || printf('%03d', millisecond(ts) % 1000) AS logged, strftime(ts, '%Y%m%d_%H%M%S') AS named FROM events")
def stamps(spark, d):
    return V.read(spark, d, "events").select("event_id", X.log_stamp(F.col("ts")).alias("logged"), X.name_stamp(F.col("ts")).alias("named"))


@query("sphere_voxels", "SELECT s_suppkey AS image_id, s_suppkey % 7 + a AS i, s_suppkey % 5 + b AS j, s_suppkey % 9 + c AS k FROM supplier, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b), (SELECT unnest(range(-2, 3)) AS c) WHERE a * a + b * b + c * c <= 4 AND s_suppkey % 7 + a BETWEEN 0 AND 7 AND s_suppkey % 5 + b BETWEEN 0 AND 7 AND s_suppkey % 9 + c BETWEEN 0 AND 7")
def sphere_voxels(spark, d):
    s = V.read(spark, d, "supplier")
    centres = s.select(F.col("s_suppkey").alias("image_id"), *[(F.col("s_suppkey") % m).alias(c) for c, m in zip("ijk", (7, 5, 9))], F.array(*[F.lit(8).cast("long")] * 3).alias("shape"))
    return M.sphere(centres).select("image_id", "i", "j", "k")


@query("in_volume", "SELECT s_suppkey AS image_id, s_suppkey % 9 < 8 AND s_suppkey % 5 - 1 >= 0 AS in_volume FROM supplier")
def in_volume(spark, d):
    s = V.read(spark, d, "supplier")
    return M.in_volume(s.select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 9).alias("i"), (F.col("s_suppkey") % 5 - 1).alias("j"), F.lit(3).cast("long").alias("k"), F.array(*[F.lit(8).cast("long")] * 3).alias("shape"))).select("image_id", "in_volume")


@query("overlay", f"WITH v AS ({V.VOX.format(flag='A')}), s AS ({V.VOX.format(flag='R')}) SELECT v.image_id, v.i, v.j, v.k, CASE WHEN s.i IS NULL THEN v.k ELSE v.k * 0.5::DOUBLE + 0.5 END AS r, CASE WHEN s.i IS NULL THEN v.k ELSE v.k * 0.5::DOUBLE END AS g, CASE WHEN s.i IS NULL THEN v.k ELSE v.k * 0.5::DOUBLE END AS b FROM v LEFT JOIN s USING (image_id, i, j, k)")
def overlay(spark, d):
    return M.overlay(V.voxels(spark, d, "A").withColumn("v", F.col("k").cast("double")), V.voxels(spark, d, "R"))


_AFFINE = ((-1, 0, 0, 90), (0, 1, 0, -126), (0, 0, 1, -72), (0, 0, 0, 1))


def _affine():
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in _AFFINE])


@query("affine_apply", f"WITH {V.E} SELECT image, idx, 90 - h[1] AS x, h[2] - 126 AS y, h[3] - 72 AS z FROM e1")
def affine_apply(spark, d):
    w = G.apply_affine(_affine(), F.col("h"))
    return V.electrodes(spark, d).select("image", "idx", *[w[k].alias(c) for k, c in enumerate("xyz")])


@query("mni_to_voxel", f"WITH {V.E} SELECT image, idx, CAST(round_even(90 - h[1], 0) AS INTEGER) AS i, CAST(round_even(h[2] + 126, 0) AS INTEGER) AS j, CAST(round_even(h[3] + 72, 0) AS INTEGER) AS k FROM e1")
def mni_to_voxel(spark, d):
    v = G.world_to_voxel(_affine(), F.col("h"))
    return V.electrodes(spark, d).select("image", "idx", *[v[k].alias(c) for k, c in enumerate("ijk")])


@query("argmax_channel", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS channel FROM embeddings")
def argmax_channel(spark, d):
    return V.read(spark, d, "embeddings").select("vec_id", G.argmax(F.col("embedding")).alias("channel"))


# ---- sampling and metrics


@query("running_best", "SELECT event_id, event_type, greatest(coalesce(b, 0), 0, value) AS best, value > greatest(coalesce(b, 0), 0) AS improved FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)")
def running_best(spark, d):
    m = V.read(spark, d, "events").select(F.lit("r").alias("run_id"), F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return S.running_best(m).select(F.col("step").alias("event_id"), F.col("tag").alias("event_type"), "best", "improved")


@query("best_step", "SELECT event_type AS tag, arg_max(event_id, (value, -event_id)) AS step, max(value) AS best FROM events WHERE value > 0 GROUP BY event_type")
def best_step(spark, d):
    m = V.read(spark, d, "events").select(F.lit("r").alias("run_id"), F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return S.best_step(m).select("tag", "step", "best")


@query("mean_metrics", "SELECT event_type AS tag, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def mean_metrics(spark, d):
    m = V.read(spark, d, "events").select(F.lit("r").alias("run_id"), F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return rounded(S.mean_metrics(m).drop("run_id"), "mean")


@query("split_sizes", "SELECT 'train' AS subset, count(*) - 16 AS n FROM documents UNION ALL SELECT 'validation', 8 UNION ALL SELECT 'test', 8")
def split_sizes(spark, d):
    return S.split_dataset(V.read(spark, d, "documents").select("doc_id"), "doc_id", 8, 8).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("split_members", "SELECT doc_id, CASE WHEN n <= 8 THEN 'validation' WHEN n <= 16 THEN 'test' ELSE 'train' END AS subset FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1001:' || doc_id), doc_id) AS n FROM documents)")
def split_members(spark, d):
    return S.split_dataset(V.read(spark, d, "documents").select("doc_id"), "doc_id", 8, 8)


# ---- volumes in new grids


def _valued(spark, d, flag=None):
    return V.voxels(spark, d, flag).withColumn("v", (F.col("i") + 2 * F.col("j") + F.col("k")).cast("double"))


_EVERY = f"v AS (SELECT *, (i + 2 * j + k)::DOUBLE AS v FROM ({V.EVERY_VOX}))"
_VALUED = f"v AS (SELECT *, (i + 2 * j + k)::DOUBLE AS v FROM ({V.VOX.format(flag='A')})), m AS (SELECT *, (i + 2 * j + k)::DOUBLE AS v FROM ({V.VOX.format(flag='R')}))"
_CORNERS = "(SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)"
_WEIGHT = " * ".join(f"CASE {u} WHEN 1 THEN {x} - floor({x}) ELSE 1 - {x} + floor({x}) END" for u, x in zip("abc", "xyz"))


@query("resample_affine", f"WITH {_EVERY}, g AS (SELECT image_id, p, q, r, 0.5::DOUBLE * p + 0.25 AS x, 0.5::DOUBLE * q AS y, 0.25::DOUBLE * q + 0.5 * r + 0.5 AS z FROM (SELECT DISTINCT image_id FROM v), (SELECT unnest(range(20)) AS p), (SELECT unnest(range(16)) AS q), (SELECT unnest(range(10)) AS r)), n AS (SELECT image_id, p, q, r, floor(x) + a AS i, floor(y) + b AS j, floor(z) + c AS k, {_WEIGHT} AS w FROM g, {_CORNERS}) SELECT image_id, p::INTEGER AS i, q::INTEGER AS j, r::INTEGER AS k, sum(w * v) AS v FROM n JOIN v USING (image_id, i, j, k) WHERE w > 0 GROUP BY ALL")
def resample_affine(spark, d):
    return W.resample(_valued(spark, d), ((0.5, 0, 0, 0.25), (0, 0.5, 0, 0), (0, 0.25, 0.5, 0.5)), (20, 16, 10), block=8)


def _area_sql(c: str, n: int, m: int) -> str:
    return f"(SELECT o AS o{c}, unnest(range(o * {n} // {m}, ((o + 1) * {n} + {m} - 1) // {m})) AS {c}, ((o + 1) * {n} + {m} - 1) // {m} - o * {n} // {m} AS n{c} FROM (SELECT unnest(range({m})) AS o)) side_{c}"


@query("resize_area", f"WITH {_EVERY} SELECT image_id, oi::INTEGER AS i, oj::INTEGER AS j, ok::INTEGER AS k, round(sum(v / (ni * nj * nk)), 6) AS v FROM v JOIN {_area_sql('i', 12, 5)} USING (i) JOIN {_area_sql('j', 12, 18)} USING (j) JOIN {_area_sql('k', 8, 3)} USING (k) GROUP BY ALL")
def resize_area(spark, d):
    return rounded(W.resize_area(_valued(spark, d), (12, 12, 8), (5, 18, 3)), "v")


def _level(name: str) -> str:
    return f"(SELECT image_id, i, j, k, least(floor(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) * 8), 7) AS level FROM {name} WINDOW w AS (PARTITION BY image_id))"


@query("mutual_information", f"WITH {_VALUED}, f AS (SELECT image_id, level AS la, i + 0.25::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM {_level('v')}), n AS (SELECT image_id, la, floor(x) + a AS i, floor(y) + b AS j, floor(z) + c AS k, {_WEIGHT} AS w FROM f, {_CORNERS}), h AS (SELECT image_id, la, level AS lb, sum(w) AS w FROM n JOIN {_level('m')} USING (image_id, i, j, k) WHERE w > 0 GROUP BY ALL), e AS (SELECT image_id, 'a' AS o, sum(w) AS w FROM h GROUP BY image_id, la UNION ALL SELECT image_id, 'b', sum(w) FROM h GROUP BY image_id, lb UNION ALL SELECT image_id, 'ab', w FROM h), s AS (SELECT image_id, o, sum(w) AS total, log2(sum(w)) - sum(w * log2(w)) / sum(w) AS entropy FROM e GROUP BY ALL), t AS (SELECT image_id, max(total) AS weight, max(entropy) FILTER (o = 'ab') AS hab, sum(entropy) FILTER (o <> 'ab') AS h FROM s GROUP BY image_id) SELECT image_id, weight, CASE WHEN hab > 1e-12 THEN round(h / hab, 6) END AS nmi FROM t")
def mutual_information(spark, d):
    found = W.mutual_information(_valued(spark, d, "A"), _valued(spark, d, "R"), ((1, 0, 0, 0.25), (0, 1, 0, 0), (0, 0, 1, 0)), bins=8)
    return rounded(found, "nmi")


# ---- inventories


@query("inventory_regex", "SELECT page_id, regexp_extract(p, '.*sub-(.*)_ses-(.*)_run-(.*)/', 1) AS subject, regexp_extract(p, '.*sub-(.*)_ses-(.*)_run-(.*)/', 2) AS session, regexp_extract(p, '.*sub-(.*)_ses-(.*)_run-(.*)/', 3) AS run, regexp_extract(url, '[^/]*$') AS name FROM (SELECT *, '/m/sub-' || page_id || '/unzipped/sub-' || page_id || '_ses-' || (page_id % 4) || '_run-01/mask.nii.gz' AS p FROM pages)")
def inventory_regex(spark, d):
    i = F.col("page_id").cast("string")
    p = F.concat(F.lit("/m/sub-"), i, F.lit("/unzipped/sub-"), i, F.lit("_ses-"), (F.col("page_id") % 4).cast("string"), F.lit("_run-01/mask.nii.gz"))
    return V.read(spark, d, "pages").withColumn("k", X.path_parts(p)).select("page_id", "k.*", X.file_name(F.col("url")).alias("name"))


@query("anti_skip", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_skip(spark, d):
    from coordex.sources.inventory import to_process

    done = V.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return to_process(V.read(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(spark, d):
    from coordex.sources.inventory import processed

    with_r = V.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return processed(V.read(spark, d, "orders").select("o_orderkey"), with_r, ["o_orderkey"])


@query("pair_volumes_masks", "SELECT a.s_suppkey AS volume_id, a.s_suppkey % 4 + 1 AS session FROM supplier a WHERE a.s_suppkey % 3 <> 0")
def pair_volumes_masks(spark, d):
    from coordex.sources.inventory import pairs, with_keys

    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    name = lambda head, tail: F.concat(F.lit(head), F.col("i").cast("string"), F.lit("_ses-"), (F.col("i") % 4 + 1).cast("string"), F.lit(tail))
    volumes = with_keys(s.select(name("/d/rsub-", "_acq-petra_run-01_PDw.nii").alias("path")))
    masks = with_keys(s.where("i % 3 <> 0").select(name("/d/sub-", "_run-01/mask.nii.gz").alias("path")))
    return pairs(volumes, masks).select(F.col("subject").cast("long").alias("volume_id"), F.col("session").cast("long").alias("session"))


@query("subject_lengths", "SELECT p_partkey FROM part WHERE length('sub-' || p_partkey) IN (7, 8)")
def subject_lengths(spark, d):
    from coordex.sources.inventory import subjects

    s = V.read(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("subject"))
    return subjects(s).select("p_partkey")


_SCANS = """f AS (
  SELECT o_custkey % 500 AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'base' ELSE 's' || (o_orderkey % 4) END AS session,
    ['T1', 'Petra_Pre', 'Petra_Post'][(o_orderkey // 3) % 3 + 1] AS kind, min(o_orderkey)::VARCHAR AS path FROM orders GROUP BY ALL
), done AS (SELECT DISTINCT o_custkey % 500 AS subject, 's' || (o_orderkey % 4) AS session FROM orders WHERE o_orderkey % 50 = 1)"""


@query("coregistration_jobs", f"WITH {_SCANS} SELECT a.subject, a.session, a.path AS pre, b.path AS post, t.path AS reference FROM f a JOIN f t ON t.subject = a.subject AND t.kind = 'T1' AND t.session = 'base' LEFT JOIN f b ON b.subject = a.subject AND b.session = a.session AND b.kind = 'Petra_Post' WHERE a.kind = 'Petra_Pre' AND a.session <> 'base' AND NOT EXISTS (SELECT 1 FROM done WHERE done.subject = a.subject AND done.session = a.session)")
def coregistration_jobs(spark, d):
    from coordex.sources.inventory import coregistration_jobs as jobs

    key = F.col("o_orderkey")
    orders = V.read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("subject"), "o_orderkey")
    later = F.concat(F.lit("s"), (key % 4).cast("string"))
    kind = F.element_at(F.array(F.lit("T1"), F.lit("Petra_Pre"), F.lit("Petra_Post")), (F.floor(key / 3) % 3 + 1).cast("int"))
    files = orders.withColumn("session", F.when(key % 3 == 0, "base").otherwise(later)).withColumn("kind", kind)
    files = files.groupBy("subject", "session", "kind").agg(F.min("o_orderkey").cast("string").alias("path"))
    done = orders.where(key % 50 == 1).select("subject", later.alias("session"))
    return jobs(files, done).select("subject", "session", F.col("Petra_Pre").alias("pre"), F.col("Petra_Post").alias("post"), "reference")


@query("unmatched_files", "SELECT a.s_suppkey AS file_id, 'mask' AS missing FROM supplier a WHERE a.s_suppkey % 3 = 0")
def unmatched_files(spark, d):
    from coordex.sources.inventory import unmatched

    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_suppkey") % 4).alias("session"), F.lit("01").alias("run"))
    return unmatched(s, s.where("subject % 3 <> 0")).select(F.col("subject").alias("file_id"), "missing")


@query("counter_lines", f"WITH RECURSIVE {_CLASSED}, lines AS (SELECT 'processed_images' AS counter, count(*) AS value FROM ch UNION ALL SELECT 'valid_configurations', count(*) FROM ch WHERE valid UNION ALL SELECT 'invalid_configurations', count(*) FROM ch WHERE NOT valid UNION ALL SELECT c, count(*) FILTER (class = c) FROM ch, (SELECT unnest(['no_clusters', 'one_cluster', 'two_clusters', 'three_clusters', 'more_than_four']) AS c) GROUP BY c) SELECT upper(counter[1]) || replace(counter[2:], '_', ' ') || ': ' || value AS value FROM lines")
def counter_lines(spark, d):
    from coordex.sources.tables import counter_lines as lines

    return lines(C.extraction_report(_classed(spark, d)))


@query("report_text", f"WITH {_LIMITED}, t AS (SELECT count(*) AS total, count(*) FILTER (Difference BETWEEN loa_lo AND loa_hi) AS n FROM pr, s) SELECT unnest([printf('Total points: %d', total), printf('Points within limits: %d (%.2f%%)', n, n * 100.0::DOUBLE / total), printf('Points outside limits: %d', total - n)]) AS value FROM t")
def report_text(spark, d):
    return A.report_text(A.loa_report(_pairs(spark, d), "Euclidean_Norm"))


@query("paired_in_area", f"WITH {V.V}, {V.pair_sql('Z', FULL, MANUAL)} SELECT Subject, Session, run, {sql_rounded('Difference', 'Mean')} FROM pr WHERE Area = 'lTPJ' AND Electrode = 'Cathode2'")
def paired_in_area(spark, d):
    p = A.paired_methods(_vectors(spark, d), "Z", FULL, MANUAL, area_only="lTPJ", electrode="Cathode2")
    return rounded(p.select("Subject", "Session", "run", "Difference", "Mean"), "Difference", "Mean")


@query("shape_filter", "SELECT p_partkey, p_size % 2 = 0 AS ok FROM part")
def shape_filter(spark, d):
    z = F.when(F.col("p_size") % 2 == 0, 288).otherwise(100)
    ok, bad = M.matching_shape(V.read(spark, d, "part").select("p_partkey", F.array(F.lit(224), F.lit(288), z).alias("shape")))
    return ok.select("p_partkey", F.lit(True).alias("ok")).unionByName(bad.select("p_partkey", F.lit(False).alias("ok")))
