"""URL filter: rules for hosts and paths, and gradient-boosted trees for all other urls.

A url that a rule fits gets the rule's verdict. The others are judged by boosted trees
(Spark ML) on lexical features: length, depth, share of digits, entropy of the
characters, parameters, host length, labels and hyphens, and statistics of the host's
suffix: how often it comes among all urls, and which share of its labelled urls is
blocked. Labelled urls are those that a rule fits, or a table (url, verdict) that the
caller has. Suffix shares are counted in two halves (by a hash of the url), and a labelled
url is trained with the share of the half it is not in, so its own label is no feature.

Everything is DataFrame functions and Spark ML, in the JVM. Bounded sample: at most
``SAMPLE`` distinct labelled urls of each verdict, by hash, are trained on; all counts
are over all rows.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged by the trees as an empty one (its other features from what text there is); only
A-Z are lower-cased in hosts; a url whose host ends it has an empty path, which no rule
with a path fits; repeated rows and null page_ids are rows like others; of rules of one
length the first in order is taken; if labelled urls have one verdict only, it is that of
all others, and without any labelled url they are allowed; an empty table gives an empty
table; extra columns are not read. Very long urls are read whole, in linear time but for
the entropy (a sort of the characters).

Scale: one pass writes the features of all rows; suffix counts are aggregated before
they move, and a hot suffix is dealt over salts where rows meet its counts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, seeded, table, unit

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE = 2000
TREES, DEPTH, BINS, SEED = 10, 4, 64, 13
LEXICAL = ("length", "depth", "digits", "entropy", "parameters", "host_length", "labels", "hyphens")
SUFFIX = ("suffix_count", "suffix_blocked", "top_count", "top_blocked")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Weight of the share over all labelled urls in a suffix's own.
PRIOR = 20.0


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """host, path and query; empty where the url is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(tail, "^[^?#]*", 0), query


def fitted(host: Column, path: Column, rules=RULES) -> Column:
    """rule and verdict of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character: runs of equal characters in the sorted text are summed up."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    part = lambda n: n * F.log2(F.greatest(n, F.lit(1.0)))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.when(acc["c"] == c, F.struct(acc["c"].alias("c"), (acc["n"] + 1).alias("n"), acc["sum"].alias("sum"))).otherwise(
        F.struct(c.alias("c"), F.lit(1.0).alias("n"), (acc["sum"] + part(acc["n"])).alias("sum"))
    )
    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + part(acc["n"]))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def described(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (null without a rule), lexical features, suffix and top label."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), F.coalesce(url, F.lit("")).alias("_text"))
    host, path, query = split_url(url)
    rows = rows.select("*", host.alias("host"), path.alias("path"), query.alias("_query")).withColumn("_rule", fitted(F.col("host"), F.col("path"), rules))
    text, host = F.col("_text"), F.col("host")
    filled = lambda c, by: F.size(F.filter(F.split(c, by), lambda x: x != "")).cast("double")
    n = F.length(text).cast("double")
    lexical = {
        "length": n, "depth": filled(F.col("path"), "/"), "digits": F.when(n > 0, 1 - F.length(F.translate(text, "0123456789", "")) / n).otherwise(0.0), "entropy": entropy(text),
        "parameters": filled(F.col("_query"), "&"), "host_length": F.length(host).cast("double"), "labels": filled(host, "[.]"), "hyphens": (F.length(host) - F.length(F.translate(host, "-", ""))).cast("double"),
    }
    tops = {"suffix": F.substring_index(host, ".", -2), "top": F.substring_index(host, ".", -1)}
    half = F.pmod(F.xxhash64(F.lit(SEED), text), F.lit(2)).cast("int").alias("half")
    return rows.select("page_id", "url", "host", "path", "_rule.rule", "_rule.verdict", half, *[c.alias(k) for k, c in {**lexical, **tops}.items()])


def suffix_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, n, and labelled and blocked urls of each half."""
    own = lambda h, c: F.count_if((F.col("half") == h) & c)
    labelled, blocked = F.col("verdict").isNotNull(), F.col("verdict") == "block"
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[own(h, c).alias(f"{n}{h}") for h in (0, 1) for n, c in (("l", labelled), ("b", blocked))])


def with_suffixes(rows: DataFrame, counts: dict[str, DataFrame], share: float) -> DataFrame:
    """Rows with the statistics of their suffix and top label; of labelled ones those of the other half."""
    for key, table_ in counts.items():
        rows = salted_join(rows, table_, [key], F.xxhash64("page_id", "url"))
        other = lambda c: F.when(F.col("verdict").isNull(), F.col(f"{c}0") + F.col(f"{c}1")).when(F.col("half") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
        blocked = (other("b") + PRIOR * share) / (other("l") + PRIOR)
        rows = rows.withColumns({f"{key}_count": F.log1p(F.col("n").cast("double")), f"{key}_blocked": blocked}).drop("n", "l0", "b0", "l1", "b1")
    return rows


def sampled(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """At most ``sample`` distinct labelled urls of each verdict, by hash."""
    out = None
    for verdict, n in sorted(counts.items()):
        h = seeded("url", F.col("url"))
        # Some more than asked for pass the threshold; they are ordered and cut, so the order is over a bounded number of urls.
        own = rows.where(F.col("verdict") == verdict).withColumn("_h", h).where(unit(F.col("_h")) <= 2.0 * sample / n + 1e-9)
        own = own.dropDuplicates(["url"]).orderBy("_h", "url").limit(sample)
        out = own if out is None else out.unionByName(own)
    return out


def train(sample: DataFrame) -> GBTClassificationModel:
    """sample: bounded rows with features and ``blocked``; one task trains them in order, so reruns agree."""
    rows = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(sample.coalesce(1).sortWithinPartitions("_h", "url"))
    return GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED).fit(rows.select("features", "blocked"))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' share for block; null with a rule).

    labelled: url, verdict (allow or block) of urls to learn from, in place of those that a rule fits.
    """
    rows = materialize(described(pages, rules), "urls")
    known = rows
    if labelled is not None:
        told = described(labelled.select(F.lit(0).cast("long").alias("page_id"), "url", F.col("verdict").alias("_told")), ())
        told = told.drop("verdict").join(labelled.select("url", "verdict").distinct(), "url")
        known = materialize(told.select(*rows.columns), "urls-labelled")
    by = {r["verdict"]: r["count"] for r in known.where("verdict is not null").groupBy("verdict").count().collect()}  # two rows
    done = rows.where("rule is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    rest = rows.where("rule is null")
    if len(by) < 2:
        only = next(iter(by), "allow")
        return done.unionByName(rest.select("page_id", "host", "path", "rule", F.lit(only).alias("verdict"), F.lit(float(only == "block")).alias("score")))
    share = by["block"] / sum(by.values())
    counts = {k: materialize(suffix_counts(known, k), "urls-suffixes") for k in ("suffix", "top")}
    blocked = (F.col("verdict") == "block").cast("double").alias("blocked")
    learnt = materialize(with_suffixes(sampled(known, by, sample), counts, share).select("_h", "url", blocked, *LEXICAL, *SUFFIX), "urls-sample")
    model = train(learnt)
    from pyspark.ml.functions import vector_to_array

    asked = with_suffixes(rest.withColumn("verdict", F.lit(None).cast("string")), counts, share)
    prior = F.lit(share)
    asked = asked.fillna(0.0, [f"{k}_count" for k in counts]).withColumns({f"{k}_blocked": F.coalesce(f"{k}_blocked", prior) for k in counts})
    scored = model.transform(VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(asked))
    verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict")
    return done.unionByName(scored.select("page_id", "host", "path", "rule", verdict, vector_to_array("probability")[1].alias("score")))


def op13_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
