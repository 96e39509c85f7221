"""Rule lists and empirical-Bayes host reputation for urls, in DataFrame operations only.

Labelled page outcomes are counted per host, registered domain (last two labels) and suffix (last label).
Each level's rate is shrunk towards its parent's posterior mean by a beta-binomial prior whose strength is
estimated from the spread of that level's own rates (method of moments); above the suffixes stands the overall
rate, with one bad page in ten to start from. A host is blocked when the lower
credible bound of its bad rate exceeds a threshold. Counts are sums, so a host with a third of all pages is
partially aggregated before any shuffle, and only one row per host is joined back.

Nulls: a null url, or one without ``://``, has empty host and path, fits no rule and is judged like any other
host (the empty one). A null outcome is no outcome; outcomes of pages that do not exist count for nothing.
Repeated page rows are judged row by row, and count once each as outcomes. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: for each host the rules (text, kind) of itself and of its parent domains, by a join on the rule's domain."""
    named = rules.select(F.length("text").alias("size"), "text", "kind", F.substring_index("text", "/", 1).alias("_at"), F.expr("CASE WHEN instr(text, '/') > 0 THEN substring(text, instr(text, '/')) ELSE '' END").alias("prefix"))
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_at"))
    return parents.join(named, "_at").groupBy("host").agg(F.collect_list(F.struct("size", "text", "kind", "prefix")).alias("rules"))


def longest_rule(path: Column, rules: Column) -> Column:
    """struct<size, text, kind, prefix>: the longest of a host's rules whose prefix the path has (ties: the last by text); null for none."""
    return F.array_max(F.filter(rules, lambda r: path.startswith(r["prefix"])))


def _strength(level: DataFrame, k: str, n: str, low: float = 1.0, high: float = 1000.0) -> DataFrame:
    """One row: the prior strength a + b that explains the spread of k / n over the level's groups."""
    sums = level.where(F.col(n) > 0).agg(
        F.sum(n).cast("double").alias("N"), F.sum(k).cast("double").alias("K"), F.count("*").cast("double").alias("m"),
        F.sum((F.col(n) * F.col(n)).cast("double")).alias("NN"),
        F.sum(F.col(k).cast("double") * F.col(k) / F.col(n)).alias("KK"),
    )
    p = F.try_divide("K", "N")
    within = p * (1 - p) * (F.col("m") - 1)
    between = F.col("KK") - F.col("N") * p * p
    rho = F.try_divide(between - within, p * (1 - p) * (F.col("N") - F.try_divide("NN", "N") - (F.col("m") - 1)))
    s = F.try_divide(F.lit(1.0), rho) - 1
    return sums.select(F.when(rho <= 0, high).otherwise(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), s)), F.lit(high))).alias("s"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, page_col: str = "page_id", host_col: str = "host", bad_col: str = "bad", z: float = 1.645) -> DataFrame:
    """One row per host of pages: n, k, posterior mean, lower and upper bound of its bad rate."""
    bad = outcomes.where(F.col(bad_col).isNotNull()).groupBy(F.col(page_col).alias("_page")).agg(F.max(F.col(bad_col).cast("int")).alias("_bad"))
    host = F.col("host")
    hosts = (
        pages.select(F.col(page_col).alias("_page"), F.col(host_col).alias("host")).join(bad, "_page", "left")
        .groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("k"))
        .select("host", "n", "k", F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    root = suffixes.agg(((F.coalesce(F.sum("sk"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 10)).alias("p0"))  # a single row
    one = root.crossJoin(_strength(suffixes, "sk", "sn").withColumnRenamed("s", "s1")).crossJoin(_strength(domains, "dk", "dn").withColumnRenamed("s", "s2")).crossJoin(_strength(hosts, "k", "n").withColumnRenamed("s", "s3"))
    one = F.broadcast(one)  # four single-row aggregates side by side
    levels = (
        hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix").crossJoin(one)
        .withColumn("ps", (F.col("sk") + F.col("s1") * F.col("p0")) / (F.col("sn") + F.col("s1")))
        .withColumn("pd", (F.col("dk") + F.col("s2") * F.col("ps")) / (F.col("dn") + F.col("s2")))
        .withColumn("a", F.col("k") + F.col("s3") * F.col("pd")).withColumn("b", F.col("n") - F.col("k") + F.col("s3") * (1 - F.col("pd")))
    )
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return levels.select("host", "n", "k", mean.alias("mean"), (mean - z * sd).alias("lower"), (mean + z * sd).alias("upper"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.3, z: float = 1.645, page_col: str = "page_id", url_col: str = "url", bad_col: str = "bad"
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate: allow or block by the longest rule, else by the host's posterior bound.

    rules are (kind, domain with an optional path prefix), however many; they are joined to the hosts, not to the pages.
    """
    table = pages.sparkSession.createDataFrame([(k, t) for k, t in rules], "kind string, text string")
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(page_col).alias("page_id"), host.alias("host"), path.alias("path"))
    told = outcomes.select(F.col(page_col).alias("page_id"), F.col(bad_col).alias("bad"))
    known = host_reputation(parsed, told, z=z).select("host", "mean", "lower")
    known = known.join(rules_of_hosts(known.select("host"), table), "host", "left")
    judged = parsed.join(known, "host", "left").withColumn("_rule", longest_rule(F.col("path"), F.col("rules")))
    return judged.select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"),
        F.coalesce("_rule.kind", F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"),
    )
