"""Readings, alarms and people as seen in the test tables; the SQL texts hold in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READINGS = """SELECT event_id AS id, user_id AS senior_id, ts AS date,
  CASE event_type WHEN 'click' THEN 'Heartrate' WHEN 'view' THEN 'BloodPressure' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'Saturation' ELSE 'Temperature' END ELSE 'Steps' END AS type,
  value, CASE WHEN event_type = 'view' THEN 60 + value END AS sbp,
  CASE WHEN event_type = 'view' THEN CAST(40 + event_id % 60 AS DOUBLE) END AS dbp
FROM events WHERE event_type <> 'error'"""
ALARMS = """SELECT event_id AS alert_id, user_id AS senior_id, ts AS alert_date, CAST(event_id % 5 - 1 AS INT) AS severity
FROM events WHERE event_type = 'error'"""
PEOPLE = """SELECT c_custkey AS id,
  CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(50 + c_custkey % 70 AS INT) END AS age,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE make_date(CAST(1976 - c_custkey % 70 + c_custkey % 4 AS INT), 3, 1) END AS birthdate
FROM customer"""
# Condition lists in the shape of the raw source: comma-separated, odd blanks, mixed case, empty entries.
CONDITIONS = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Nadciśnienie, cukrzyca' WHEN 1 THEN ' UDAR ,, Depresja' WHEN 2 THEN 'cukrzyca,Zaćma' WHEN 3 THEN 'chodzenie o lasce'
  WHEN 4 THEN 'inne' ELSE NULL END AS disease_names FROM customer"""
NOTES = """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'Alarm testowy' WHEN 1 THEN 'Nie nawiązano kontaktu' WHEN 2 THEN 'Nawiązano kontakt, wszystko dobrze'
  WHEN 3 THEN 'WEZWANIE ZRM' WHEN 4 THEN 'Brak wskazań do interwencji ZRM, wezwanie zrm odwołane, nawiązano kontakt' WHEN 5 THEN 'Opiekun powiadomiony'
  WHEN 6 THEN 'stan zagrożenia życia i zdrowia, nawiązano kontakt' WHEN 7 THEN '' ELSE NULL END AS note FROM events"""


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The binding's rows over the tables of sf_dir."""
    head, _, tail = sql.rpartition("FROM ")
    name, _, where = tail.partition(" WHERE ")
    df = spark.read.parquet(f"{sf_dir}/{name.strip()}.parquet")
    if where:
        df = df.where(where)
    fields = head.strip().removeprefix("SELECT ")
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and fields[:i].count("'") % 2 == 0:
            parts.append(fields[start:i])
            start = i + 1
    return df.selectExpr(*[p.strip() for p in [*parts, fields[start:]]])
