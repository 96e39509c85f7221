"""Licence scans by sparse TF-IDF cosine, with inheritance along directories; DataFrame operations only.

Every line of a file, and every paragraph where blank lines part it into several, is a candidate header; the whole text
of a licence file (LICENSE, LICENCE, COPYING, NOTICE) is one more unit. A unit's vector holds, for each term, how often the unit
has it times its idf ``ln((1 + N) / (1 + df)) + 1``, with document frequencies of all terms counted over all documents;
so does a template's. The best template at or above the threshold names the licence (ties: the first by name).

Scoring is pruned exactly: the terms that are shared with templates are split so that the commoner ones alone
cannot reach the threshold against any template; a unit without one of the others is never scored.

Files without a licence of their own take that of the nearest ancestor directory with a licence file, by
joins on (directory) of each file's ancestors, however deep; a directory is one key, and its files are never gathered.

Nulls: a null text has no licence of its own; a null path has no directory and inherits nothing. Empty texts
score nothing. Several licence files in one directory: highest cosine, then first by name. Repeated rows give
repeated results. Empty tables give no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stage
from .licence_texts import TEMPLATES
from .urls import LOWER, UPPER

TERM = r"[a-z0-9]+"
LICENCE_FILE = r"^(LICENSE|LICENCE|COPYING|NOTICE)(\..*)?$"


PARAGRAPHS = r"\n[ \t\r]*\n"


def terms_of(text: str) -> dict[str, int]:
    """How often a text has each of its terms."""
    return dict(Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))))


def _terms(text: Column) -> Column:
    """Terms in turn, with repeats and perhaps an empty one at either end; splitting is far cheaper than extracting."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """term, df: over all documents."""
    held = docs.select(F.explode(F.array_distinct(_terms(F.col(text_col).cast("string")))).alias("term")).where("term <> ''")
    return held.groupBy("term").agg(F.count("*").alias("df"))


def telling_terms(idf: dict[str, float], threshold: float, templates=TEMPLATES) -> list[str]:
    """Terms of which any unit at or above the threshold holds one: the rest, by rising idf, stay below it on every template."""
    squares = [{t: (n * idf[t]) ** 2 for t, n in terms_of(text).items()} for _, text in templates]
    bounds = [(threshold - 1e-9) ** 2 * sum(s.values()) for s in squares]
    reached, plain = [0.0] * len(squares), set()
    for t in sorted(idf, key=lambda t: (idf[t], t)):
        # cos(unit, template) <= |template restricted to shared terms| / |template|
        reached = [r + s.get(t, 0.0) for r, s in zip(reached, squares, strict=True)]
        if any(r >= b for r, b in zip(reached, bounds, strict=True)):
            break
        plain.add(t)
    return sorted(set(idf) - plain)


def own_licences(docs: DataFrame, id_col: str, text_col: str, path_col: str, threshold: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """_id, _licence, _score: a row for each file that states a licence itself."""
    spark = docs.sparkSession
    frequencies = stage(document_frequencies(docs, text_col), "term-frequencies")
    n = docs.count()
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    df = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}  # a row per template term
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    telling = F.array(*map(F.lit, telling_terms(idf, threshold, templates) or vocabulary))
    text = F.col(text_col).cast("string")
    hit = docs.where(F.arrays_overlap(_terms(text), telling)).select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), text.alias("_text"))
    named = F.regexp_extract(F.col("_path"), r"[^/]*$", 0).rlike(LICENCE_FILE)
    none = F.array().cast("array<string>")
    units = F.concat(F.split(F.col("_text"), "\n"), F.when(F.col("_text").rlike(PARAGRAPHS), F.split(F.col("_text"), PARAGRAPHS)).otherwise(none), F.when(named, F.array("_text")).otherwise(none))
    units = hit.select("_id", F.explode(F.array_distinct(units)).alias("_unit")).select("_id", F.xxhash64("_unit").alias("_u"), _terms(F.col("_unit")).alias("_terms"))
    units = units.where(F.arrays_overlap("_terms", telling)).dropDuplicates(["_id", "_u"])
    counts = units.select("_id", "_u", F.explode("_terms").alias("term")).where("term <> ''").groupBy("_id", "_u", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(frequencies, "term").withColumn("w", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).withColumn("x", F.col("tf") * F.col("w"))
    vectors = []
    for k, (name, statement) in enumerate(templates):
        own = terms_of(statement)
        length = math.sqrt(sum((f * idf[t]) ** 2 for t, f in own.items()))
        vectors += [(k, name, t, f * idf[t] / length) for t, f in own.items()]
    known = spark.createDataFrame(vectors, "k int, licence string, term string, y double")  # as many rows as the templates have terms
    norms = weighed.groupBy("_id", "_u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(known), "term").groupBy("_id", "_u", "k", "licence").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    same = [F.col("d._id").eqNullSafe(F.col("n._id")), F.col("d._u") == F.col("n._u")]
    scores = dots.alias("d").join(norms.alias("n"), same).select("d._id", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    ranked = scores.groupBy("_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("licence").alias("licence"))).alias("b"))
    out = stage(ranked.select("_id", F.col("b.licence").alias("_licence"), (-F.col("b.neg")).alias("_score")), "licences")
    discard(frequencies)
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """id, path, licence, score, origin ('own', 'inherited' or 'none') and the directory that it comes from."""
    own = own_licences(docs, id_col, text_col, path_col, threshold, templates)
    files = docs.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path")).join(own, "_id", "left")
    parts = F.split(F.col("_path"), "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    named = F.regexp_extract("_path", r"[^/]*$", 0).rlike(LICENCE_FILE)
    files = files.withColumn("_folder", folder).withColumn("_named", F.coalesce(named, F.lit(False)))
    granted = (
        files.where("_named AND _licence IS NOT NULL").groupBy(F.col("_folder").alias("_at"))
        .agg(F.min(F.struct((-F.col("_score")).alias("neg"), F.col("_licence").alias("licence"))).alias("g"))
        .select("_at", F.col("g.licence").alias("_granted"), (-F.col("g.neg")).alias("_granted_score"))
    )
    # One row per directory that holds a file, with its ancestors, nearest first; its grant then serves all its files.
    folders = files.where(F.col("_path").isNotNull()).select("_folder").distinct()
    steps = F.split("_folder", "/")
    up = folders.select("_folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("d"), F.array_join(F.slice(steps, 1, i), "/").alias("a")))).alias("u"))
    nearest = (
        up.select("_folder", F.col("u.d").alias("_depth"), F.col("u.a").alias("_at")).join(granted, "_at")
        .groupBy("_folder").agg(F.max(F.struct("_depth", "_at", "_granted", "_granted_score")).alias("n")).select("_folder", "n.*")
    )
    out = files.join(nearest, "_folder", "left")
    stated = F.col("_licence").isNotNull()
    return out.select(
        F.col("_id").alias(id_col), F.col("_path").alias(path_col),
        F.coalesce("_licence", "_granted").alias("licence"),
        F.coalesce("_score", "_granted_score").alias("score"),
        F.when(stated, "own").when(F.col("_granted").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(stated, F.col("_folder")).otherwise(F.col("_at")).alias("from_folder"),
    )
