"""All registered queries and their SQL twins: each query is one or two operators over the bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.compat import dow_sunday0, nan_to_null, safe_div, truncated_text
from ..operators import classify, clean, cohort, flatten, horizon, metrics, relational, rolling, timegrid, windows
from .binding import ALARMS, CONDITIONS, NOTES, PEOPLE, READINGS, bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 42
KINDS = {"Heartrate": "heartrate", "BloodPressure": "sbp", "Temperature": "temperature", "Steps": "steps", "Saturation": "saturation"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _readings(spark, d):
    return bound(spark, d, READINGS)


def _alarms(spark, d):
    return bound(spark, d, ALARMS)


def _when(kind, column):
    return F.when(F.col("type") == kind, F.col(column))


def _buckets(spark, d, width="1 HOUR"):
    """The wide bucket table of the feature query."""
    sbp, dbp = F.avg(_when("BloodPressure", "sbp")), F.avg(_when("BloodPressure", "dbp"))
    return timegrid.bucketed(_readings(spark, d), "senior_id", "date", width, [
        F.avg(_when("Temperature", "value")).alias("temperature"), F.avg(_when("Heartrate", "value")).alias("heartrate"),
        sbp.alias("sbp"), dbp.alias("dbp"), F.when(dbp < sbp, sbp - dbp).alias("pulse_pressure"),
        F.sum(_when("Steps", "value")).alias("_steps"), F.avg(_when("Saturation", "value")).alias("saturation"), F.max(_when("Saturation", "date")).alias("latest_saturation"),
        F.max(_when("Temperature", "date")).alias("latest_temperature"), F.max(_when("Heartrate", "date")).alias("latest_heartrate"),
        F.max(_when("BloodPressure", "date")).alias("latest_sbp"), F.max(_when("Steps", "date")).alias("latest_steps"),
    ]).withColumn("steps", F.coalesce("_steps", F.lit(0.0))).drop("_steps")


def _grid(spark, d):
    return timegrid.on_grid(_buckets(spark, d), "senior_id", "1 HOUR")


def _r(c, n=4):
    return F.round(c, n).alias(c if isinstance(c, str) else "x")


M, A, P = f"WITH m AS ({READINGS})", f"WITH a AS ({ALARMS})", f"WITH p AS ({PEOPLE})"
BUCKETS = f"""{M}, b AS (SELECT senior_id, time_bucket(INTERVAL '1 hour', date) AS bucket,
  avg(CASE WHEN type = 'Temperature' THEN value END) AS temperature, avg(CASE WHEN type = 'Heartrate' THEN value END) AS heartrate,
  avg(CASE WHEN type = 'BloodPressure' THEN sbp END) AS sbp, avg(CASE WHEN type = 'BloodPressure' THEN dbp END) AS dbp,
  CASE WHEN avg(CASE WHEN type = 'BloodPressure' THEN dbp END) < avg(CASE WHEN type = 'BloodPressure' THEN sbp END)
       THEN avg(CASE WHEN type = 'BloodPressure' THEN sbp END) - avg(CASE WHEN type = 'BloodPressure' THEN dbp END) END AS pulse_pressure,
  sum(CASE WHEN type = 'Steps' THEN value ELSE 0 END) AS steps, avg(CASE WHEN type = 'Saturation' THEN value END) AS saturation, max(CASE WHEN type = 'Saturation' THEN date END) AS latest_saturation,
  max(CASE WHEN type = 'Temperature' THEN date END) AS latest_temperature, max(CASE WHEN type = 'Heartrate' THEN date END) AS latest_heartrate,
  max(CASE WHEN type = 'BloodPressure' THEN date END) AS latest_sbp, max(CASE WHEN type = 'Steps' THEN date END) AS latest_steps
  FROM m GROUP BY 1, 2)"""
GRID = f"""{BUCKETS}, e AS (SELECT senior_id, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY 1),
 t AS (SELECT senior_id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS bucket FROM e),
 g AS (SELECT t.senior_id, t.bucket, b.* EXCLUDE (senior_id, bucket) FROM t LEFT JOIN b USING (senior_id, bucket))"""
AT = "strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket"


def _at():
    return truncated_text("bucket").alias("bucket")


@query(f"{BUCKETS} SELECT senior_id, {AT}, round(temperature, 4) AS temperature, round(heartrate, 4) AS heartrate, round(sbp, 4) AS sbp, round(dbp, 4) AS dbp, round(pulse_pressure, 4) AS pulse_pressure, round(steps, 4) AS steps FROM b")
def bucket_pivot(spark, d):
    return _buckets(spark, d).select("senior_id", _at(), *[_r(c) for c in ("temperature", "heartrate", "sbp", "dbp", "pulse_pressure", "steps")])


@query(f"{GRID} SELECT senior_id, count(*) AS n, count(heartrate) AS seen, round(sum(coalesce(steps, 0)), 3) AS steps FROM g GROUP BY 1")
def grid_left_join(spark, d):
    return _grid(spark, d).groupBy("senior_id").agg(F.count("*").alias("n"), F.count("heartrate").alias("seen"), F.round(F.sum(F.coalesce("steps", F.lit(0.0))), 3).alias("steps"))


W4 = "OVER (PARTITION BY senior_id ORDER BY bucket RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW)"


@query(f"{GRID} SELECT senior_id, {AT}, round(stddev_samp(heartrate) {W4.format('4 HOUR')}, 4) AS hr_volatility FROM g")
def rolling_std_4h(spark, d):
    return _grid(spark, d).select("senior_id", _at(), F.round(rolling.range_std("heartrate", "senior_id", "bucket", "4 HOUR"), 4).alias("hr_volatility"))


@query(f"{GRID}, s AS (SELECT senior_id, bucket, regr_slope(sbp, epoch(bucket)) {W4.format('3 HOUR')} AS v FROM g) SELECT senior_id, {AT}, round(CASE WHEN isnan(v) THEN NULL ELSE v END * 3600, 4) AS bp_trend FROM s")
def rolling_slope_3h(spark, d):
    s = rolling.range_slope(_grid(spark, d), "sbp", "senior_id", "bucket", "3 HOUR", "v")
    return s.select("senior_id", _at(), F.round(nan_to_null("v") * 3600, 4).alias("bp_trend"))


@query(f"{GRID} SELECT senior_id, {AT}, round(sum(coalesce(steps, 0)) {W4.format('6 HOUR')}, 4) AS steps_6h FROM g")
def rolling_sum_6h(spark, d):
    return _grid(spark, d).select("senior_id", _at(), F.round(rolling.range_sum("steps", "senior_id", "bucket", "6 HOUR"), 4).alias("steps_6h"))


LAST = "date_diff('minute', max(latest_{0}) OVER (PARTITION BY senior_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), bucket) AS since_{0}"


@query(f"{GRID} SELECT senior_id, {AT}, {', '.join(LAST.format(k) for k in KINDS.values())} FROM g")
def time_since_last(spark, d):
    timers = rolling.since_last({f"since_{k}": f"latest_{k}" for k in KINDS.values()}, "senior_id", "bucket")
    return _grid(spark, d).select("senior_id", _at(), *[c.alias(k) for k, c in timers.items()])


@query("WITH x AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'error') SELECT event_id, user_id FROM x WHERE before IS NULL OR ts > before + INTERVAL 24 HOUR")
def burst_compress(spark, d):
    return timegrid.compress_bursts(_t(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", "24 HOURS").select("event_id", "user_id")


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 y AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_no FROM x)
 SELECT event_id, user_id, event_no, count(*) OVER (PARTITION BY user_id, event_no) AS event_size FROM y""")
def burst_events(spark, d):
    return timegrid.burst_events(_t(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", "24 HOURS").select("event_id", "user_id", "event_no", "event_size")


def _labels_sql(alarms: str) -> str:
    span = "al.severity = {0} AND al.alert_date > g.bucket AND al.alert_date <= g.bucket + INTERVAL 4 HOUR"
    return f"""{GRID}, al AS ({alarms}), l AS (SELECT g.senior_id, g.bucket,
  count(CASE WHEN al.severity IN (1, 2, 3) AND al.alert_date >= g.bucket - INTERVAL 48 HOUR AND al.alert_date < g.bucket THEN 1 END) AS recent_event_burden,
  {", ".join(f"max(CASE WHEN {span.format(k)} THEN 1 ELSE 0 END) AS label_{k}" for k in (1, 2, 3))}
  FROM g LEFT JOIN al ON al.senior_id = g.senior_id AND al.alert_date >= g.bucket - INTERVAL 48 HOUR AND al.alert_date <= g.bucket + INTERVAL 4 HOUR GROUP BY 1, 2)"""


LABELS = _labels_sql(ALARMS)
COMPRESSED = f"SELECT alert_id, senior_id, alert_date, severity FROM (SELECT *, lag(alert_date) OVER (PARTITION BY senior_id ORDER BY alert_date, alert_id) AS before FROM ({ALARMS})) WHERE before IS NULL OR alert_date > before + INTERVAL 10 MINUTE"


def _labelled(spark, d):
    return horizon.burden_and_labels(_grid(spark, d), _alarms(spark, d), "senior_id", "bucket", "alert_date", "severity")


@query(f"{LABELS} SELECT senior_id, {AT}, recent_event_burden FROM l")
def event_burden_48h(spark, d):
    return _labelled(spark, d).select("senior_id", _at(), "recent_event_burden")


@query(f"{LABELS} SELECT senior_id, {AT}, label_1, label_2, label_3 FROM l")
def lookahead_labels(spark, d):
    return _labelled(spark, d).select("senior_id", _at(), "label_1", "label_2", "label_3")


@query(f"WITH a AS ({ALARMS}), m AS ({READINGS}) SELECT a.alert_id, count(m.id) AS n, round(avg(CASE WHEN m.type = 'Heartrate' THEN m.value END), 4) AS hr FROM a LEFT JOIN m ON a.senior_id = m.senior_id AND m.date > a.alert_date - INTERVAL 2 HOUR AND m.date <= a.alert_date GROUP BY 1")
def lookback_2h_profile(spark, d):
    aggs = [F.count("r.id").alias("n"), F.round(F.avg(F.when(F.col("r.type") == "Heartrate", F.col("r.value"))), 4).alias("hr")]
    return horizon.look_back(_alarms(spark, d), _readings(spark, d), "senior_id", "alert_date", "date", "alert_id", "2 HOURS", aggs)


@query(f"WITH a AS ({ALARMS}), m AS ({READINGS}) SELECT a.alert_id, count(m.id) AS n, count(DISTINCT date_trunc('hour', m.date)) AS hours FROM a LEFT JOIN m ON a.senior_id = m.senior_id AND m.date >= a.alert_date - INTERVAL 6 HOUR AND m.date < a.alert_date GROUP BY 1")
def local_density_6h(spark, d):
    aggs = [F.count("r.id").alias("n"), F.countDistinct(F.date_trunc("hour", F.col("r.date"))).alias("hours")]
    return horizon.look_back(_alarms(spark, d), _readings(spark, d), "senior_id", "alert_date", "date", "alert_id", "6 HOURS", aggs, closed="left")


@query(f"{M} SELECT senior_id, type, strftime(date_trunc('day', date), '%Y-%m-%d') AS day, round(avg(value), 4) AS value, round(avg(sbp), 4) AS sbp FROM m GROUP BY 1, 2, 3")
def dedup_mean(spark, d):
    x = _readings(spark, d).withColumn("day", F.date_format(F.date_trunc("day", "date"), "yyyy-MM-dd"))
    return clean.dedup_mean(x, ["senior_id", "type", "day"], ["value", "sbp"]).select("senior_id", "type", "day", _r("value"), _r("sbp"))


ROUNDED = "CASE WHEN type = 'Temperature' THEN round(value, 1) ELSE round(value, 0) END"
CLIPPED = """CASE type WHEN 'Heartrate' THEN CASE WHEN v < 30 THEN 30 WHEN v > 220 THEN 220 ELSE v END
  WHEN 'Temperature' THEN CASE WHEN v > 45 THEN NULL WHEN v < 30 THEN 30 ELSE v END
  WHEN 'Saturation' THEN CASE WHEN v < 50 THEN 50 ELSE v END
  WHEN 'Steps' THEN CASE WHEN v < 0 THEN 0 WHEN v > 50000 THEN 50000 ELSE v END ELSE v END"""


@query(f"{M}, x AS (SELECT id, type, {ROUNDED} AS v FROM m) SELECT id, type, CAST({CLIPPED} AS DOUBLE) AS value FROM x")
def round_clip_by_type(spark, d):
    k = F.col("type")
    return _readings(spark, d).select("id", "type", clean.clipped(clean.rounded(F.col("value"), k), k).alias("value"))


@query(f"""{M}, x AS (SELECT id, round(sbp, 0) AS s, round(dbp, 0) AS l FROM m WHERE type = 'BloodPressure'),
 y AS (SELECT id, CAST(least(greatest(s, 70), 250) AS DOUBLE) AS s, CAST(least(greatest(l, 40), 140) AS DOUBLE) AS l FROM x),
 z AS (SELECT id, CASE WHEN l < s THEN s END AS sbp, CASE WHEN l < s THEN l END AS dbp FROM y)
 SELECT id, sbp, dbp, CASE WHEN sbp - dbp >= 10 THEN sbp - dbp END AS pulse_pressure FROM z""")
def bp_guard(spark, d):
    return clean.clean_readings(_readings(spark, d)).where("type = 'BloodPressure'").select("id", "sbp", "dbp", "pulse_pressure")


@query(f"""WITH n AS ({NOTES}), x AS (SELECT id, lower(note) AS t FROM n) SELECT id, CASE WHEN t IS NULL THEN -1
 WHEN contains(t, 'alarm przypadkowy') OR contains(t, 'alarm testowy') OR contains(t, 'alert techniczny') THEN 0
 WHEN NOT contains(t, 'brak wskazań do interwencji zrm') AND (contains(t, 'zdecydowano się na interwencję zrm') OR contains(t, 'zdecydowano wezwać zrm') OR contains(t, 'wezwanie zrm')
   OR (contains(t, 'zagrożenia życia i zdrowia') AND contains(t, 'nawiązano kontakt')) OR (contains(t, 'na podstawie odczytów z systemu') AND contains(t, 'zrm'))) THEN 3
 WHEN contains(t, 'nie nawiązano kontaktu') THEN 2 WHEN contains(t, 'nawiązano kontakt') OR contains(t, 'opiekun powiadomiony') THEN 1 ELSE -1 END AS severity FROM x""")
def severity_rules(spark, d):
    return bound(spark, d, NOTES).select("id", classify.severity(F.col("note")).alias("severity"))


def _cases(column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{s}')" for s in stems) + f" THEN '{k}'" for k, stems in classify.CATEGORIES.items()) + f" ELSE '{classify.OTHER}' END"


SPLIT = f"WITH c AS ({CONDITIONS}), s AS (SELECT id, trim(x) AS disease FROM (SELECT id, unnest(string_split(disease_names, ',')) AS x FROM c) WHERE trim(x) <> '')"


def _diseases(spark, d):
    return clean.split_names(bound(spark, d, CONDITIONS), "disease_names", "disease")


@query(f"{SPLIT} SELECT id, disease FROM s")
def split_explode_names(spark, d):
    return _diseases(spark, d)


@query(f"{SPLIT} SELECT id, disease, {_cases('disease')} AS category FROM s")
def keyword_category(spark, d):
    return _diseases(spark, d).withColumn("category", classify.category(F.col("disease")))


LABELS_ALL = [*classify.CATEGORIES, classify.OTHER]


@query(f"{SPLIT}, k AS (SELECT id, {_cases('disease')} AS category FROM s) SELECT id, {', '.join(f'max(CASE WHEN category = {chr(39)}{x}{chr(39)} THEN 1 ELSE 0 END) AS {x}' for x in LABELS_ALL)} FROM k GROUP BY 1")
def onehot_pivot(spark, d):
    return classify.flags(_diseases(spark, d).withColumn("category", classify.category(F.col("disease"))), "id", "category", LABELS_ALL)


@query(f"""{SPLIT}, k AS (SELECT {_cases('disease')} AS category, id FROM s), o AS (SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS hit FROM c)
 SELECT category, count(DISTINCT k.id) AS entities, count(DISTINCT CASE WHEN hit = 1 THEN k.id END) AS with_outcome, round(count(DISTINCT CASE WHEN hit = 1 THEN k.id END) / count(DISTINCT k.id), 6) AS rate FROM k JOIN o ON k.id = o.id GROUP BY 1""")
def category_association(spark, d):
    x = _diseases(spark, d).select("id", classify.category(F.col("disease")).alias("category"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("hit"))
    return classify.association(x, "id", "category", "hit").withColumn("rate", F.round("rate", 6))


@query(f"""{SPLIT}, f AS (SELECT translate(disease, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, id, disease FROM s),
 m AS (SELECT folded, min(id) AS o, arg_min(disease, (id, disease)) AS disease FROM f GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY o, disease) AS INT) AS id, folded, disease FROM m""")
def surrogate_keys(spark, d):
    return clean.surrogate_keys(_diseases(spark, d), "disease", "id")


@query(f"""{P}, x AS (SELECT id, NULLIF(gender, 'Unknown') AS gender, age, birthdate FROM p WHERE age BETWEEN 60 AND 110),
 y AS (SELECT id, gender, birthdate, CAST(CASE WHEN birthdate IS NOT NULL AND abs(2026 - year(birthdate) - age) > 1 THEN 2026 - year(birthdate) ELSE age END AS INT) AS age FROM x)
 SELECT id, gender, age, strftime(coalesce(birthdate, make_date(2026 - age, 1, 1)), '%Y-%m-%d') AS birthdate, CASE WHEN lower(gender) LIKE 'k%' OR lower(gender) LIKE 'f%' THEN 1 WHEN lower(gender) LIKE 'm%' THEN 0 END AS gender_code FROM y""")
def demographic_reconcile(spark, d):
    x = clean.reconcile_people(bound(spark, d, PEOPLE), 2026)
    return x.select("id", "gender", F.col("age").cast("int").alias("age"), F.date_format("birthdate", "yyyy-MM-dd").alias("birthdate"), clean.gender_code(F.col("gender")).alias("gender_code"))


DENSITY = f"""{M}, r AS (SELECT senior_id, count(CASE WHEN type = 'Heartrate' THEN 1 END) AS heartrate_readings, count(CASE WHEN type = 'BloodPressure' THEN 1 END) AS bloodpressure_readings,
 greatest(date_diff('second', min(date), max(date)) / 86400.0 + 1, 1) AS active_days FROM m GROUP BY 1)"""


@query(f"{DENSITY} SELECT senior_id, heartrate_readings, bloodpressure_readings, round(active_days, 6) AS active_days, round(heartrate_readings / active_days, 6) AS heartrate_per_day, round(bloodpressure_readings / active_days, 6) AS bloodpressure_per_day FROM r WHERE heartrate_readings / active_days >= 0.4 AND bloodpressure_readings / active_days >= 0.3")
def cohort_density(spark, d):
    x = cohort.density(_readings(spark, d), "senior_id", "date", "type", {"heartrate": "Heartrate", "bloodpressure": "BloodPressure"})
    x = cohort.dense_enough(x, {"heartrate": 0.4, "bloodpressure": 0.3})
    return x.select("senior_id", "heartrate_readings", "bloodpressure_readings", *[_r(c, 6) for c in ("active_days", "heartrate_per_day", "bloodpressure_per_day")])


GAPS = f"""{M}, x AS (SELECT senior_id, date, date_diff('second', lag(date) OVER (PARTITION BY senior_id ORDER BY date), date) / 3600.0 AS gap FROM m),
 q AS (SELECT senior_id, count(*) AS n, count(CASE WHEN gap > 0.5 THEN 1 END) AS long_gaps, max(gap) AS max_gap_hours, count(DISTINCT date_trunc('hour', date)) AS hours_with_data,
 greatest(date_diff('second', min(date), max(date)) / 3600.0, 1) AS total_hours FROM x GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"{GAPS} SELECT senior_id, n, long_gaps, round(max_gap_hours, 6) AS max_gap_hours, hours_with_data, round(hours_with_data / total_hours, 6) AS density FROM q")
def gap_metrics(spark, d):
    return cohort.gap_metrics(_readings(spark, d), "senior_id", "date").select("senior_id", "n", "long_gaps", _r("max_gap_hours", 6), "hours_with_data", _r("density", 6))


@query(f"{M}, x AS (SELECT type, date_diff('second', lag(date) OVER (PARTITION BY senior_id, type ORDER BY date), date) / 60.0 AS gap FROM m) SELECT type, round(quantile_cont(gap, 0.5), 4) AS median_minutes, round(quantile_cont(gap, 0.9), 4) AS p90_minutes FROM x WHERE gap IS NOT NULL GROUP BY 1")
def sampling_audit(spark, d):
    return cohort.sampling_audit(_readings(spark, d), "senior_id", "date", "type").select("type", _r("median_minutes"), _r("p90_minutes"))


CUTS = [0.05, 0.06, 0.07, 0.08, 0.09]


@query(f"{GAPS} SELECT cutoff, count(CASE WHEN hours_with_data / total_hours > cutoff THEN 1 END) AS kept, count(CASE WHEN NOT hours_with_data / total_hours > cutoff THEN 1 END) AS lost, CAST(sum(CASE WHEN hours_with_data / total_hours > cutoff THEN n ELSE 0 END) AS BIGINT) AS kept_weight, CAST(sum(CASE WHEN hours_with_data / total_hours > cutoff THEN 0 ELSE n END) AS BIGINT) AS lost_weight FROM q, (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in CUTS)}]) AS cutoff) GROUP BY 1")
def cutoff_sweep(spark, d):
    return cohort.cutoff_sweep(cohort.gap_metrics(_readings(spark, d), "senior_id", "date"), "density", "n", CUTS)


@query(f"{GAPS}, f AS (SELECT senior_id FROM q WHERE hours_with_data / total_hours > 0.075), a AS ({ALARMS}), s AS (SELECT DISTINCT senior_id FROM a WHERE severity = 3) SELECT coalesce(f.senior_id, s.senior_id) AS senior_id, CASE WHEN f.senior_id IS NOT NULL AND s.senior_id IS NOT NULL THEN 'both' WHEN f.senior_id IS NOT NULL THEN 'first only' ELSE 'second only' END AS origin FROM f FULL JOIN s ON f.senior_id = s.senior_id")
def gold_cohort(spark, d):
    first = cohort.gap_metrics(_readings(spark, d), "senior_id", "date").where("density > 0.075")
    return cohort.gold(first, _alarms(spark, d).where("severity = 3"), "senior_id")


@query(f"{M} SELECT senior_id, strftime(CAST(date AS DATE), '%Y-%m-%d') AS day, round(avg(CASE WHEN type = 'Heartrate' THEN value END), 4) AS heartrate, round(avg(CASE WHEN type = 'Temperature' THEN value END), 4) AS temperature FROM m WHERE type IN ('Heartrate', 'Temperature') GROUP BY 1, 2")
def daily_wide_outer(spark, d):
    x = _readings(spark, d).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    out = relational.full_outer_by_kind(x, ["senior_id", "day"], "type", "value", {"heartrate": "Heartrate", "temperature": "Temperature"})
    return out.select("senior_id", "day", _r("heartrate"), _r("temperature"))


@query(f"{M}, x AS (SELECT DISTINCT senior_id, CAST(date AS DATE) AS day FROM m), e AS (SELECT senior_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM x GROUP BY 1) SELECT senior_id, strftime(e.day, '%Y-%m-%d') AS day FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.senior_id = e.senior_id AND x.day = CAST(e.day AS DATE))")
def missing_days(spark, d):
    return timegrid.missing_days(_readings(spark, d), "senior_id", "date").select("senior_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


LAGS = range(0, 4)


@query("WITH x AS (SELECT value AS x, " + ", ".join(f"lead(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y{k}" for k in LAGS) + " FROM events) " + " UNION ALL ".join(f"SELECT {k} AS lag, count(y{k}) AS n, round(corr(x, y{k}), 6) AS r FROM x WHERE y{k} IS NOT NULL" for k in LAGS))
def lag_correlation(spark, d):
    ev = _t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return rolling.lag_correlation(ev, "value", "value", "user_id", "o", LAGS).withColumn("r", F.round("r", 6))


CORR = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(CORR) for b in CORR[i:]))
def corr_matrix(spark, d):
    return rolling.correlation_pairs(_t(spark, d, "lineitem"), CORR).withColumn("r", F.round("r", 6))


@query(f"{M} SELECT senior_id, type, strftime(date_trunc('day', date), '%Y-%m-%d') AS day, count(*) AS n FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_groups(spark, d):
    return clean.duplicate_groups(_readings(spark, d).withColumn("day", F.date_format("date", "yyyy-MM-dd")), ["senior_id", "type", "day"])


@query(f"{A} SELECT hour(alert_date) AS hour, {', '.join(f'count(CASE WHEN severity = {v} THEN 1 END) AS {n}' for v, n in ((-1, 'sev_m1'), (0, 'sev_0'), (1, 'sev_1'), (2, 'sev_2'), (3, 'sev_3')))} FROM a GROUP BY 1")
def hour_severity_pivot(spark, d):
    return relational.pivot_counts(_alarms(spark, d).withColumn("hour", F.hour("alert_date").cast("long")), "hour", "severity", [-1, 0, 1, 2, 3], "sev_")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_share(spark, d):
    return relational.value_share(_t(spark, d, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT event_type, event_id, value, CAST(rank AS INT) AS rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_events(spark, d):
    return relational.top_per_group(_t(spark, d, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 5).select("event_type", "event_id", "value", "rank")


@query("SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    kept = clean.known_parents(c, o, "c_custkey", "o_custkey").agg(F.lit("semi").alias("kind"), F.count("*").alias("n"))
    lost = c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.lit("anti").alias("kind"), F.count("*").alias("n"))
    return kept.unionByName(lost)


SETS = "x AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND value > 50), y AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase' AND value > 60)"


@query(f"WITH {SETS} SELECT 'union' AS op, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum FROM (SELECT id FROM x UNION SELECT id FROM y) UNION ALL SELECT 'intersect', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM (SELECT id FROM x INTERSECT SELECT id FROM y) UNION ALL SELECT 'a_minus_b', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM (SELECT id FROM x EXCEPT SELECT id FROM y) UNION ALL SELECT 'b_minus_a', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM (SELECT id FROM y EXCEPT SELECT id FROM x)")
def set_ops(spark, d):
    ev = _t(spark, d, "events").withColumnRenamed("user_id", "id")
    return relational.set_table(ev.where("event_type = 'error' AND value > 50"), ev.where("event_type = 'purchase' AND value > 60"), "id")


L = 24
INDEXED = f"""{LABELS}, z AS (SELECT senior_id, bucket, label_1, label_2, label_3, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY senior_id) AS nrows,
 CASE WHEN label_1 + label_2 + label_3 > 0 THEN 1 ELSE 0 END AS abn FROM l WINDOW w AS (PARTITION BY senior_id ORDER BY bucket))"""


def _indexed(spark, d):
    return windows.indexed(_labelled(spark, d), "senior_id", "bucket", F.col("label_1") + F.col("label_2") + F.col("label_3") > 0)


@query(f"{INDEXED}, q AS (SELECT *, sum(abn) OVER (PARTITION BY senior_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {L - 1} FOLLOWING) AS bad FROM z) SELECT senior_id, pos FROM q WHERE pos % 11 = 0 AND pos + {L} <= nrows AND bad = 0")
def windows_train(spark, d):
    return windows.normal_starts(_indexed(spark, d), "senior_id", "bucket", L, 11).select("senior_id", F.col("pos").cast("long").alias("pos"))


TARGETS = f"""{INDEXED}, q AS (SELECT *, sum(abn) OVER (PARTITION BY senior_id ORDER BY pos ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING) AS bad FROM z),
 w AS (SELECT senior_id, pos, bucket, CASE WHEN bad = 0 AND (label_2 = 1 OR label_3 = 1) THEN 1 WHEN bad = 0 AND abn = 0 AND pos % {L} = 0 THEN 0 END AS label FROM q WHERE pos >= {L}), tg AS (SELECT * FROM w WHERE label IS NOT NULL)"""


def _targets(spark, d):
    return windows.targets(_indexed(spark, d), "senior_id", "bucket", L, (F.col("label_2") == 1) | (F.col("label_3") == 1))


@query(f"{TARGETS} SELECT senior_id, pos FROM tg WHERE label = 1")
def windows_positive(spark, d):
    return _targets(spark, d).where("label = 1").select("senior_id", F.col("pos").cast("long").alias("pos"))


@query(f"{TARGETS} SELECT senior_id, pos FROM tg WHERE label = 0")
def windows_negative(spark, d):
    return _targets(spark, d).where("label = 0").select("senior_id", F.col("pos").cast("long").alias("pos"))


@query(f"""{TARGETS}, c AS (SELECT CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS n FROM (SELECT label, count(*) AS n FROM tg GROUP BY 1)),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', CAST(senior_id AS VARCHAR), CAST(pos AS VARCHAR), '{SEED}')), senior_id, pos) AS rk FROM tg) SELECT senior_id, pos, label FROM k, c WHERE rk <= c.n""")
def balanced_sample(spark, d):
    return windows.balanced(_targets(spark, d), "label", SEED, "senior_id", "pos").select("senior_id", F.col("pos").cast("long").alias("pos"), "label")


@query(f"""{A}, e AS (SELECT senior_id, max(CASE WHEN severity >= 2 THEN 1 ELSE 0 END) AS actionable FROM a GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY actionable ORDER BY md5(concat_ws('|', CAST(senior_id AS VARCHAR), '{SEED}')), senior_id) AS r, count(*) OVER (PARTITION BY actionable) AS n FROM e)
 SELECT senior_id, actionable, CASE WHEN actionable = 1 AND r <= 20 THEN 'val' WHEN actionable = 1 AND r <= 40 THEN 'test' WHEN actionable = 0 AND r <= floor(n * 0.05) THEN 'val' WHEN actionable = 0 AND r <= 2 * floor(n * 0.05) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_entities(spark, d):
    e = _alarms(spark, d).groupBy("senior_id").agg(F.max(F.when(F.col("severity") >= 2, 1).otherwise(0)).alias("actionable"))
    return windows.reserved_split(e, "senior_id", "actionable", SEED, 20, 20, 0.05, short_ok=True)


@query(f"{INDEXED}, q AS (SELECT *, max(greatest(3 * label_3, 2 * label_2, label_1)) OVER (PARTITION BY senior_id ORDER BY pos ROWS BETWEEN {L} FOLLOWING AND {2 * L - 1} FOLLOWING) AS severity FROM z) SELECT senior_id, pos, severity FROM q WHERE pos % 4 = 0 AND pos + {2 * L} <= nrows")
def horizon_max_severity(spark, d):
    return windows.horizon_severity(_indexed(spark, d), "senior_id", "bucket", L, 4, ["label_1", "label_2", "label_3"]).select("senior_id", F.col("pos").cast("long").alias("pos"), "severity")


FLAT = f"{GRID}, f AS (SELECT *, CAST(bucket AS DATE) AS day FROM g)"
DYN = ["heartrate", "steps"]


@query(f"{FLAT} SELECT senior_id, strftime(day, '%Y-%m-%d') AS day, " + ", ".join(f"round({f}({c}), 4) AS {c}_{s}" for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")) for c in DYN) + ", round(arg_min(struct_pack(x := sbp), bucket).x, 4) AS sbp FROM f GROUP BY senior_id, day")
def flatten_stats(spark, d):
    out = flatten.flatten(_grid(spark, d).withColumn("day", F.date_format("bucket", "yyyy-MM-dd")), ["senior_id", "day"], "bucket", DYN, ["sbp"])
    return out.select("senior_id", "day", *[_r(c) for c in out.columns[2:]])


@query(f"{GRID} SELECT senior_id, {AT} FROM g WHERE coalesce(abs(heartrate) > 0.000001, false) OR coalesce(abs(steps) > 0.000001, false)")
def active_mask(spark, d):
    return flatten.active(_grid(spark, d), DYN).select("senior_id", _at())


@query(f"{GRID} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) < 0.000001 THEN 1 ELSE stddev_pop({c}) END, 4) AS std FROM g" for c in ("heartrate", "sbp", "temperature")))
def norm_stats(spark, d):
    return flatten.norm_stats(_grid(spark, d), ["heartrate", "sbp", "temperature"]).select("feature", _r("mean"), _r("std"))


@query(f"{GRID}, s AS (SELECT avg(heartrate) AS m, stddev_pop(heartrate) AS s FROM g WHERE senior_id % 2 = 0) SELECT senior_id, {AT}, round((coalesce(heartrate, m) - m) / s, 4) AS heartrate FROM g, s")
def normalise_train(spark, d):
    g = _grid(spark, d)
    return flatten.normalise(g, g.where("senior_id % 2 = 0"), ["heartrate"]).select("senior_id", _at(), _r("heartrate"))


@query(f"{BUCKETS}, s AS (SELECT median(heartrate) AS m FROM b) SELECT senior_id, {AT}, round(coalesce(heartrate, m), 4) AS heartrate FROM b, s")
def median_impute(spark, d):
    b = _buckets(spark, d)
    return flatten.median_impute(b, b, ["heartrate"]).select("senior_id", _at(), _r("heartrate"))


SCORED = "x AS (SELECT value AS s, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"
CURVE = f"""WITH {SCORED}, k AS (SELECT s, sum(y) AS t, sum(1 - y) AS f FROM x GROUP BY 1),
 c AS (SELECT s, CAST(sum(t) OVER (ORDER BY s DESC) AS DOUBLE) AS tp, CAST(sum(f) OVER (ORDER BY s DESC) AS DOUBLE) AS fp, (SELECT CAST(sum(y) AS DOUBLE) FROM x) AS p, (SELECT CAST(sum(1 - y) AS DOUBLE) FROM x) AS n FROM k),
 r AS (SELECT *, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS prec FROM c)"""


def _scored(spark, d):
    return _t(spark, d, "events").select(F.col("value").alias("s"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))


@query(f"{CURVE}, z AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY s DESC), 0) AS fp0 FROM r) SELECT round(sum((fp - fp0) * (tp + tp0) / 2) / max(p * n), 6) AS auroc FROM z")
def auroc(spark, d):
    return metrics.auroc(_scored(spark, d), "s", "y").select(_r("auroc", 6))


@query(f"{CURVE}, z AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS r0 FROM r) SELECT round(sum((tpr - r0) * prec), 6) AS average_precision FROM z")
def average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), "s", "y").select(_r("average_precision", 6))


@query(f"{CURVE}, z AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS r0, coalesce(lag(prec) OVER (ORDER BY s DESC), 1) AS p0 FROM r) SELECT round(sum((tpr - r0) * (prec + p0) / 2), 6) AS pr_area FROM z")
def pr_trapezoid(spark, d):
    return metrics.pr_trapezoid(_scored(spark, d), "s", "y").select(_r("pr_area", 6))


@query(f"{CURVE} SELECT round(sqrt(tpr * (1 - fpr)), 6) AS gmean, s AS threshold FROM r ORDER BY sqrt(tpr * (1 - fpr)) DESC, s DESC LIMIT 1")
def gmean_threshold(spark, d):
    return metrics.gmean_point(_scored(spark, d), "s", "y").select(_r("gmean", 6), "threshold")


@query(f"{CURVE} SELECT round(tpr - fpr, 6) AS youden, s AS threshold, round(prec, 6) AS ppv, round(tpr, 6) AS sensitivity, round(1 - fpr, 6) AS specificity FROM r ORDER BY tpr - fpr DESC, s DESC LIMIT 1")
def youden_point(spark, d):
    return metrics.youden_point(_scored(spark, d), "s", "y").select(_r("youden", 6), "threshold", _r("ppv", 6), _r("sensitivity", 6), _r("specificity", 6))


@query(f"{CURVE} SELECT round(max(CASE WHEN prec + tpr = 0 THEN 0 ELSE 2 * prec * tpr / (prec + tpr) END), 6) AS f1 FROM r")
def best_f1(spark, d):
    return metrics.best_f1(_scored(spark, d), "s", "y").select(_r("f1", 6))


@query(f"{CURVE} SELECT round(max(prec), 6) AS precision FROM r WHERE tpr >= 0.8")
def precision_at_recall(spark, d):
    return metrics.precision_at_recall(_scored(spark, d), "s", "y").select(_r("precision", 6))


@query(f"{CURVE} SELECT max(s) AS threshold FROM r WHERE tpr >= 0.4")
def recall_floor_threshold(spark, d):
    return metrics.threshold_at_recall(_scored(spark, d), "s", "y")


CONF = f"WITH {SCORED}, c AS (SELECT count(CASE WHEN y = 0 AND s < 50 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND s >= 50 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND s < 50 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND s >= 50 THEN 1 END) AS tp FROM x), d AS (SELECT *, tp / (tp + fp) AS ppv, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM c)"


@query(f"{CONF} SELECT tn, fp, fn, tp, round(ppv, 6) AS ppv, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM d")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), "s", "y", 50).select("tn", "fp", "fn", "tp", _r("ppv", 6), _r("sensitivity", 6), _r("specificity", 6))


@query(f"{CONF} SELECT round(sensitivity * 0.02 / (sensitivity * 0.02 + (1 - specificity) * 0.98), 6) AS ppv FROM d")
def ppv_prevalence(spark, d):
    c = metrics.confusion(_scored(spark, d), "s", "y", 50)
    return c.select(F.round(metrics.ppv_at(F.col("sensitivity"), F.col("specificity"), 0.02), 6).alias("ppv"))


@query("WITH c AS (SELECT event_type, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS high, count(*) AS count FROM events GROUP BY 1, 2) SELECT event_type, high, count, round(count / sum(count) OVER (PARTITION BY event_type), 6) AS share FROM c")
def confusion_matrix(spark, d):
    ev = _t(spark, d, "events").withColumn("high", F.when(F.col("value") >= 50, 1).otherwise(0))
    return metrics.confusion_matrix(ev, "event_type", "high").withColumn("share", F.round("share", 6))


@query("SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weights(spark, d):
    return metrics.class_weights(_t(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 6))


@query("""WITH c AS (SELECT CAST(count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS DOUBLE) AS b, CAST(count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS DOUBLE) AS c, CAST(count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS DOUBLE) AS d FROM labels)
 SELECT a AS n11, b AS n10, c AS n01, d AS n00, round((a+b+c+d) * pow(greatest(abs(a*d-b*c) - (a+b+c+d)/2, 0), 2) / ((a+b)*(c+d)*(a+c)*(b+d)), 6) AS chi2 FROM c""")
def chi_square(spark, d):
    return metrics.chi_square_2x2(_t(spark, d, "labels"), "quality", "toxic").select("n11", "n10", "n01", "n00", _r("chi2", 6))


@query("SELECT d.doc_id, e.label, l.quality, len(e.embedding) AS dims, round(CAST(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x)) AS DOUBLE), 4) AS energy FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def embedding_fusion_join(spark, d):
    x = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    energy = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return x.select("doc_id", "label", "quality", F.size("embedding").cast("long").alias("dims"), F.round(energy, 4).alias("energy"))


@query("WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM n UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 3 <> 0")
def latest_upsert(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return clean.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark, d):
    return clean.keep_last(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT id, count(*) AS n FROM (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer) GROUP BY 1")
def entity_universe(spark, d):
    return clean.universe([(_t(spark, d, "orders"), "o_custkey"), (_t(spark, d, "customer"), "c_custkey")]).groupBy("id").agg(F.count("*").alias("n"))


@query(f"{GRID} SELECT senior_id, {AT}, round(last_value(heartrate IGNORE NULLS) OVER (PARTITION BY senior_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS heartrate FROM g")
def bounded_ffill(spark, d):
    return clean.forward_fill(_grid(spark, d), "senior_id", "bucket", ["heartrate"], 4).select("senior_id", _at(), _r("heartrate"))


@query("SELECT event_id, (SELECT max_by(v.value, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'click' AND v.ts <= e.ts) AS last_click FROM events e WHERE event_type = 'error'")
def as_of_join(spark, d):
    ev = _t(spark, d, "events")
    clicks = ev.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return rolling.as_of(ev.where("event_type = 'error'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["last_click"]).select("event_id", "last_click")


TIMERS = {"temperature": "temperature", "heartrate": "heartrate", "sbp": "sbp", "dbp": "sbp", "pulse_pressure": "sbp", "steps": "steps", "saturation": "saturation"}
MEASURED = ["temperature", "heartrate", "sbp", "dbp", "pulse_pressure", "steps", "saturation"]
FLAG_NAMES = {x: "other" if x == classify.OTHER else x for x in LABELS_ALL}
SINCE = "date_diff('minute', max(latest_{0}) OVER (PARTITION BY senior_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), bucket) AS time_since_last_{1}"


@query(f"""{_labels_sql(COMPRESSED)}, s AS (SELECT g.*, stddev_samp(heartrate) {W4.format('4 HOUR')} AS vol, regr_slope(sbp, epoch(bucket)) {W4.format('3 HOUR')} AS slope, sum(coalesce(steps, 0)) {W4.format('6 HOUR')} AS s6,
 {', '.join(SINCE.format(v, k) for k, v in TIMERS.items())} FROM g), c AS ({CONDITIONS}), dn AS (SELECT id, trim(x) AS disease FROM (SELECT id, unnest(string_split(disease_names, ',')) AS x FROM c) WHERE trim(x) <> ''), k AS (SELECT id, {_cases('disease')} AS category FROM dn),
 rp AS (SELECT id, {', '.join(f'max(CASE WHEN category = {chr(39)}{x}{chr(39)} THEN 1 ELSE 0 END) AS {x}' for x in LABELS_ALL)} FROM k GROUP BY 1), pe AS ({PEOPLE})
 SELECT strftime(s.bucket, '%Y-%m-%d %H:%M:%S') AS timestamp, {', '.join(f'round({"coalesce(steps, 0)" if c == "steps" else c}, 4) AS {c}' for c in MEASURED)}, s.senior_id,
 round(vol, 4) AS hr_volatility, round(CASE WHEN isnan(slope) THEN NULL ELSE slope END * 3600, 4) AS bp_trend, CAST(hour(s.bucket) AS INT) AS hour, round(sin(2 * pi() * hour(s.bucket) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(s.bucket) / 24.0), 6) AS hour_cos,
 CASE WHEN hour(s.bucket) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_night, round(s6, 4) AS steps_rolling_sum_6h, {', '.join(f'time_since_last_{x}' for x in TIMERS)}, {', '.join(f'coalesce({x}, 0) AS {y}' for x, y in FLAG_NAMES.items())},
 pe.age, CASE WHEN lower(gender) LIKE 'k%' OR lower(gender) LIKE 'f%' THEN 1 WHEN lower(gender) LIKE 'm%' THEN 0 END AS gender, round(CASE WHEN dbp <> 0 THEN heartrate / dbp END, 4) AS shock_index, CAST(extract(dow FROM s.bucket) AS INT) AS day_of_week,
 l.recent_event_burden, l.label_1, l.label_2, l.label_3 FROM s JOIN l ON s.senior_id = l.senior_id AND s.bucket = l.bucket LEFT JOIN rp ON rp.id = s.senior_id LEFT JOIN pe ON pe.id = s.senior_id""")
def feature_matrix(spark, d):
    """All 42 columns of the model's input; burden and labels are of alarms after burst compression."""
    alarms = timegrid.compress_bursts(_alarms(spark, d), "senior_id", "alert_date", "alert_id")
    g = horizon.burden_and_labels(_grid(spark, d), alarms, "senior_id", "bucket", "alert_date", "severity")
    g = rolling.range_slope(g, "sbp", "senior_id", "bucket", "3 HOUR", "slope")
    timers = rolling.since_last({f"time_since_last_{k}": f"latest_{v}" for k, v in TIMERS.items()}, "senior_id", "bucket")
    hour = F.hour("bucket")
    turn = 2 * F.pi() * hour / 24.0
    risks = classify.flags(_diseases(spark, d).withColumn("category", classify.category(F.col("disease"))), "id", "category", LABELS_ALL)
    people = bound(spark, d, PEOPLE).select("id", "age", clean.gender_code(F.col("gender")).alias("gender"))
    x = g.select(
        "senior_id", "bucket", *[F.coalesce(c, F.lit(0.0)).alias(c) if c == "steps" else c for c in MEASURED],
        F.round(rolling.range_std("heartrate", "senior_id", "bucket", "4 HOUR"), 4).alias("hr_volatility"), F.round(nan_to_null("slope") * 3600, 4).alias("bp_trend"),
        hour.alias("hour"), F.round(F.sin(turn), 6).alias("hour_sin"), F.round(F.cos(turn), 6).alias("hour_cos"), F.when(hour.between(0, 5), 1).otherwise(0).alias("is_night"),
        F.round(rolling.range_sum("steps", "senior_id", "bucket", "6 HOUR"), 4).alias("steps_rolling_sum_6h"), *[c.alias(k) for k, c in timers.items()],
        F.round(safe_div("heartrate", "dbp"), 4).alias("shock_index"), dow_sunday0("bucket").alias("day_of_week"), "recent_event_burden", "label_1", "label_2", "label_3",
    )
    x = x.join(risks.withColumnRenamed("id", "senior_id"), "senior_id", "left").join(people.withColumnRenamed("id", "senior_id"), "senior_id", "left")
    first = [truncated_text("bucket").alias("timestamp"), *[_r(c) for c in MEASURED], "senior_id", "hr_volatility", "bp_trend", "hour", "hour_sin", "hour_cos", "is_night", "steps_rolling_sum_6h"]
    flags = [F.coalesce(c, F.lit(0)).alias(name) for c, name in FLAG_NAMES.items()]
    return x.select(*first, *timers, *flags, "age", "gender", "shock_index", "day_of_week", "recent_event_burden", "label_1", "label_2", "label_3")


@query(f"{GRID} SELECT senior_id, {AT}, round(sum(steps) OVER (PARTITION BY senior_id ORDER BY bucket RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 4) AS steps_48h FROM g")
def rolling_sum_48h_left(spark, d):
    """The sum over [t - 48 h, t)."""
    return _grid(spark, d).select("senior_id", _at(), F.round(rolling.range_sum_before("steps", "senior_id", "bucket", 48), 4).alias("steps_48h"))


ROWS = "OVER (PARTITION BY senior_id ORDER BY bucket ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""{GRID} SELECT senior_id, {AT}, round(CASE WHEN count(heartrate) {ROWS.format(15)} >= 2 THEN stddev_samp(heartrate) {ROWS.format(15)} END, 4) AS std_16, round(sum(steps) {ROWS.format(23)}, 4) AS sum_24, round(avg(sbp) {ROWS.format(23)}, 4) AS mean_24 FROM g""")
def row_frame_stats(spark, d):
    x = lambda f, n: rolling.row_frame(f, "senior_id", "bucket", n)
    return _grid(spark, d).select("senior_id", _at(), F.round(x(F.stddev_samp("heartrate"), 16), 4).alias("std_16"), F.round(x(F.sum("steps"), 24), 4).alias("sum_24"), F.round(x(F.avg("sbp"), 24), 4).alias("mean_24"))


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS event_no FROM x), z AS (SELECT user_id, event_no, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS minutes FROM y GROUP BY 1, 2)
 SELECT user_id, count(*) AS events, CAST(sum(n) AS BIGINT) AS rows, round(max(minutes), 4) AS longest_minutes, round(sum(n) / count(*), 6) AS ratio FROM z GROUP BY 1""")
def burst_summary(spark, d):
    x = timegrid.burst_events(_t(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", "24 HOURS")
    return timegrid.burst_summary(x, "user_id", "ts").withColumn("longest_minutes", F.round("longest_minutes", 4)).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH a AS ({ALARMS}), m AS ({READINGS}), s AS (SELECT a.senior_id, a.alert_id, count(DISTINCT epoch(m.date)::BIGINT // 3600) AS n FROM a JOIN m ON m.senior_id = a.senior_id AND m.date >= a.alert_date - INTERVAL 240 HOUR AND m.date < a.alert_date WHERE a.severity = 3 GROUP BY 1, 2)
 SELECT DISTINCT senior_id FROM s WHERE n / 240.0 > 0.04""")
def gold_local_density(spark, d):
    """Entities with a severe alarm before which enough slots hold readings (here: hours of ten days)."""
    return cohort.dense_before(_alarms(spark, d).where("severity = 3"), _readings(spark, d), "senior_id", "alert_date", "date", "alert_id", 240, 0.04, 1)


@query("SELECT DISTINCT user_id, event_type FROM events")
def full_row_dedup(spark, d):
    return relational.full_row_dedup(_t(spark, d, "events").select("user_id", "event_type"))


@query("WITH e AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT c_custkey AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN e ON c_custkey = e.id")
def reindex_fill(spark, d):
    n = _t(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return relational.reindexed(n, _t(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", {"n": 0})


@query(f"{INDEXED}, h AS (SELECT senior_id FROM z GROUP BY 1 HAVING max(greatest(label_2, label_3)) = 0), q AS (SELECT *, sum(abn) OVER (PARTITION BY senior_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {L - 1} FOLLOWING) AS bad FROM z) SELECT senior_id, pos FROM q JOIN h USING (senior_id) WHERE pos % 11 = 0 AND pos + {L} <= nrows AND bad = 0")
def windows_train_clean(spark, d):
    """Training windows of entities that never have a level 2 or 3 label."""
    x = windows.without_history(_indexed(spark, d), "senior_id", ["label_2", "label_3"])
    return windows.normal_starts(x, "senior_id", "bucket", L, 11).select("senior_id", F.col("pos").cast("long").alias("pos"))


KEY = f"md5(concat_ws('|', CAST(senior_id AS VARCHAR), CAST(pos AS VARCHAR), '{SEED}')), senior_id, pos"


@query(f"""{TARGETS}, c AS (SELECT least(count(CASE WHEN label = 1 THEN 1 END), count(CASE WHEN label = 0 THEN 1 END)) AS n FROM tg), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY senior_id, pos) AS fo, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rk FROM tg)
 SELECT senior_id, pos, label FROM k, c WHERE CASE WHEN label = 1 THEN fo ELSE rk END <= n""")
def balanced_first(spark, d):
    return windows.balanced_first(_targets(spark, d), "label", ["senior_id", "pos"], SEED, "senior_id", "pos").select("senior_id", F.col("pos").cast("long").alias("pos"), "label")


@query(f"""{TARGETS}, w2 AS (SELECT tg.* FROM tg WHERE senior_id IN (SELECT senior_id FROM tg WHERE label = 1)), c AS (SELECT least(count(CASE WHEN label = 1 THEN 1 END), count(CASE WHEN label = 0 THEN 1 END)) AS n FROM w2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rk FROM w2)
 SELECT senior_id, pos, label FROM k, c WHERE rk <= n""")
def mixed_train(spark, d):
    return windows.mixed_train(_targets(spark, d), "label", "senior_id", SEED, "senior_id", "pos").select("senior_id", F.col("pos").cast("long").alias("pos"), "label")


@query("SELECT quality, count(*) AS n, round((1.0 / count(*)) / sum(1.0 / count(*)) OVER (), 6) AS inverse, round((sum(count(*)) OVER () - count(*)) / count(*), 6) AS ratio FROM labels GROUP BY 1")
def class_weight_variants(spark, d):
    x = _t(spark, d, "labels")
    one = metrics.class_weights(x, "quality", "inverse").select("quality", "n", F.round("weight", 6).alias("inverse"))
    return one.join(metrics.class_weights(x, "quality", "ratio").select("quality", F.round("weight", 6).alias("ratio")), "quality")
