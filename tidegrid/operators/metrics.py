"""Evaluation of scored outcomes. Curves have one row per distinct score, and their running sums are put together from buckets of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.prefix import running, value_bucket


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, t, f, tp, fp, p, n at each distinct score, from high to low (score >= threshold is positive); t and f are its own rows."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("t"), F.count(F.when(F.col(label) != 1, 1)).alias("f"))
    sums = running(by, value_bucket(by, "threshold", descending=True), [F.desc("threshold")], {"tp": "t", "fp": "f"})
    return sums.withColumnsRenamed({"tp_all": "p", "fp_all": "n"})


def _rates(c: DataFrame) -> DataFrame:
    return c.withColumns({
        "tpr": F.try_divide("tp", "p"), "fpr": F.try_divide("fp", "n"), "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "p"),
    })


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve; ties count half. Null with a single class."""
    step = curve(df, score, label).withColumn("_a", F.col("f") * (2 * F.col("tp") - F.col("t")) / 2.0)
    return step.agg(F.try_divide(F.sum("_a"), F.max(F.col("p").cast("double") * F.col("n"))).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    c = _rates(curve(df, score, label))
    return c.withColumn("_a", F.try_divide("t", "p") * F.col("precision")).agg(F.sum("_a").alias("average_precision"))


def pr_trapezoid(df: DataFrame, score: str, label: str) -> DataFrame:
    """Trapezoid area under the precision-recall points, from (recall 0, precision 1)."""
    c = _rates(curve(df, score, label))
    tp0, fp0 = F.col("tp") - F.col("t"), F.col("fp") - F.col("f")
    mean = (F.col("precision") + F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))) / 2
    return c.withColumn("_a", F.try_divide("t", "p") * mean).agg(F.sum("_a").alias("pr_area"))


def _best(c: DataFrame, goal: Column, name: str, also: dict[str, Column]) -> DataFrame:
    """The point of the highest goal; the highest threshold of several."""
    s = c.withColumn("_g", goal).agg(F.max(F.struct(F.col("_g").alias(name), "threshold", *[x.alias(k) for k, x in also.items()])).alias("b"))
    return s.select("b.*")


def gmean_point(df: DataFrame, score: str, label: str) -> DataFrame:
    c = _rates(curve(df, score, label))
    return _best(c, F.sqrt(F.col("tpr") * (1 - F.col("fpr"))), "gmean", {})


def youden_point(df: DataFrame, score: str, label: str) -> DataFrame:
    c = _rates(curve(df, score, label))
    return _best(c, F.col("tpr") - F.col("fpr"), "youden", {"ppv": F.col("precision"), "sensitivity": F.col("tpr"), "specificity": 1 - F.col("fpr")})


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    c = _rates(curve(df, score, label))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return _best(c, f1, "f1", {})


def precision_at_recall(df: DataFrame, score: str, label: str, least: float = 0.8) -> DataFrame:
    return _rates(curve(df, score, label)).where(F.col("recall") >= least).agg(F.max("precision").alias("precision"))


def threshold_at_recall(df: DataFrame, score: str, label: str, least: float = 0.4) -> DataFrame:
    """The highest threshold whose recall reaches the floor."""
    return _rates(curve(df, score, label)).where(F.col("recall") >= least).agg(F.max("threshold").alias("threshold"))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    pos, hit = F.col(label) == 1, F.col(score) >= threshold
    c = df.agg(*[F.count(F.when(x, 1)).alias(k) for k, x in (("tn", ~pos & ~hit), ("fp", ~pos & hit), ("fn", pos & ~hit), ("tp", pos & hit))])
    d = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return c.select("*", d("tp", "fp").alias("ppv"), d("tp", "fn").alias("sensitivity"), d("tn", "fp").alias("specificity"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts and shares of each row of the multi-class matrix."""
    c = df.groupBy(actual, predicted).count()
    return c.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy(actual)))


def ppv_at(sensitivity: Column, specificity: Column, prevalence) -> Column:
    hit = sensitivity * prevalence
    return F.try_divide(hit, hit + (1 - specificity) * (1 - F.lit(prevalence)))


def priority_decision(scores: dict[int, tuple[Column, float]]) -> Column:
    """The highest class whose score reaches its threshold, else 0."""
    out = None
    for k in sorted(scores, reverse=True):
        test = scores[k][0] >= scores[k][1]
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(0)


def bootstrap_auroc(df: DataFrame, score: str, label: str, row: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """low, high (2.5 and 97.5 %) of AUROC over Poisson resamples.

    Rows of one score and label are counted first, so that a replicate draws for distinct (score, label) pairs, not for
    rows: a pair of k rows is drawn Poisson(k) times, by the normal approximation (at least 0) from k = 30 on. The draws
    are hashes of (score, label, replicate) and seed; row only names the rows' key. Resampling with replacement draws
    exactly as many rows each time; these resamples do so on average.
    """
    pairs = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s"), F.when(F.col(label) == 1, 1).otherwise(0).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    x = pairs.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    uniform = lambda n: (F.pmod(F.xxhash64("s", "y", "b", F.lit(seed + n)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    mean = F.col("k").cast("double")
    normal = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))))
    steps = F.sequence(F.lit(1), F.lit(120))  # inverse of the Poisson distribution, for means below 30
    small = F.aggregate(
        steps, F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0.0).alias("w")),
        lambda a, i: F.when(uniform(0) <= a["total"], a).otherwise(F.struct((a["term"] * mean / i).alias("term"), (a["total"] + a["term"] * mean / i).alias("total"), i.cast("double").alias("w"))), lambda a: a["w"],
    )
    by = x.withColumn("w", F.when(F.col("k") >= 30, normal).otherwise(small)).where("w > 0").groupBy("b", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("y") != 1, F.col("w")).otherwise(0.0)).alias("f"))
    above = F.coalesce(F.sum("t").over(W.partitionBy("b").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    per = by.withColumn("a", F.col("f") * (above + F.col("t") / 2)).groupBy("b").agg(F.try_divide(F.sum("a"), F.sum("t") * F.sum("f")).alias("auc"))
    return per.where("auc IS NOT NULL").agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"), F.count("*").alias("replicates"))


def class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """label, n, weight: 'balanced' n_all / (classes * n); 'inverse' 1 / n, scaled to sum 1; 'ratio' n of the other rows / n."""
    c = df.groupBy(label).count()
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per class
    n, total = F.col("count"), F.sum("count").over(all_)
    weight = {"balanced": total / (F.count("*").over(all_) * n), "inverse": (1 / n) / F.sum(1 / n).over(all_), "ratio": (total - n) / n}[kind]
    return c.select(label, n.alias("n"), weight.alias("weight"))


def chi_square_2x2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two 0/1 columns, Yates-corrected statistic and its p-value (complementary error function by a rational fit)."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = df.agg(*[F.count(F.when(t, 1)).cast("double").alias(k) for k, t in (("n11", x & y), ("n10", x & ~y), ("n01", ~x & y), ("n00", ~x & ~y))])
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    det = F.abs(F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01"))
    bottom = (F.col("n11") + F.col("n10")) * (F.col("n01") + F.col("n00")) * (F.col("n11") + F.col("n01")) * (F.col("n10") + F.col("n00"))
    c = c.withColumn("chi2", F.try_divide(n * F.pow(F.greatest(det - n / 2, F.lit(0.0)), F.lit(2.0)), bottom))
    z = F.sqrt(F.col("chi2") / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return c.withColumn("p", poly * F.exp(-z * z))
