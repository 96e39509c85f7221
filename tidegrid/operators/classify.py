"""Rule tables as data: note severity, and first-match keyword categories with one-hot flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Phrases of alarm notes.
FALSE_ALARM = ("alarm przypadkowy", "alarm testowy", "alert techniczny")
NO_DISPATCH = "brak wskazań do interwencji zrm"
DISPATCH = (
    ("zdecydowano się na interwencję zrm",),
    ("zdecydowano wezwać zrm",),
    ("wezwanie zrm",),
    ("zagrożenia życia i zdrowia", "nawiązano kontakt"),
    ("na podstawie odczytów z systemu", "zrm"),
)
NO_CONTACT = "nie nawiązano kontaktu"
CONTACT = ("nawiązano kontakt", "opiekun powiadomiony")

# Word stems of each category, in order; the first category with a match wins.
CATEGORIES = {
    "cardiovascular": ["serc", "nadciśnien", "ciśnien", "arytmi", "migotani", "trzepotani", "niewydolność serca", "zawał", "wieńc", "miażdżyc", "aort", "tętniak", "dusznica", "zakrzep", "zator", "płucn", "kołatanie", "hipotensj"],
    "metabolic_endocrine": ["cukrzyc", "insulin", "lipid", "cholesterol", "hiperlipid", "otyło", "nadwag", "tarczyc", "hashimoto", "metabolic", "endokryn", "hipoglik", "stan przedcukrzyc"],
    "neurological": ["udar", "neurolog", "padaczk", "parkinson", "stwardnieni", "neuropat", "polineurop", "rwa", "zawrot", "omdleni"],
    "psychiatric_cognitive": ["depresj", "nerwic", "lękow", "schizofren", "psychicz", "demencj", "otępieni", "alzheimer", "zanik pamięci", "bezsenność"],
    "musculoskeletal": ["staw", "kostn", "reumaty", "zwyrodnieni", "kręgosłup", "dyskopati", "skolioz", "osteoporoz", "osteopeni", "endoprotez", "lasce", "chodzeni"],
    "respiratory": ["astm", "pochp", "rozedm", "oddech", "bezdech", "duszno", "płuc"],
    "gastro_renal_urologic": ["żołądk", "jelit", "refluks", "wrzod", "uchyłk", "przepuklin", "wątroba", "trzustk", "żółci", "nerk", "kamica", "mocz", "prostat"],
    "oncological": ["nowotwór", "rak", "onkolog", "guzy", "mastektomia"],
    "sensory": ["wzrok", "widzeni", "zaćm", "jaskr", "plamki", "słuch", "niedosłuch", "głuchot", "szumy uszne"],
    "other_functional_risk": ["niepełnosprawność", "porusz", "chodzeni", "laska", "nikotyn", "palenie", "autoimmun", "łuszczyc", "borelioz", "anemi", "implant", "stent", "rozrusznik", "bajpas"],
}
OTHER = "unclassified"


def severity(note: Column) -> Column:
    """3 dispatch, 2 no contact, 1 contact, 0 false alarm, -1 else or null; earlier rules win."""
    n = F.lower(note)

    def any_of(tests):
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    def all_of(phrases):
        out = F.lit(True)
        for p in phrases:
            out = out & n.contains(p)
        return out

    dispatch = ~n.contains(NO_DISPATCH) & any_of(all_of(p) for p in DISPATCH)
    ranked = F.when(any_of(n.contains(p) for p in FALSE_ALARM), 0).when(dispatch, 3).when(n.contains(NO_CONTACT), 2)
    return F.when(note.isNull(), -1).otherwise(ranked.when(any_of(n.contains(p) for p in CONTACT), 1).otherwise(-1))


def category(name: Column, categories: dict[str, list[str]] | None = None, other: str = OTHER) -> Column:
    """The first category with a stem in the lower-cased name."""
    low, out = F.lower(name), None
    for label, stems in (categories or CATEGORIES).items():
        hit = low.rlike("|".join(map(re.escape, stems)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def flags(df: DataFrame, entity: str, label: str, labels: list[str]) -> DataFrame:
    """One row per entity with a 0/1 column for each label, all labels present."""
    return df.groupBy(entity).agg(*[F.coalesce(F.max(F.when(F.col(label) == x, 1)), F.lit(0)).alias(x) for x in labels])


def association(df: DataFrame, entity: str, label: str, outcome: str) -> DataFrame:
    """Per label: entities, entities with the outcome, and their share."""
    n = F.countDistinct(entity)
    hit = F.countDistinct(F.when(F.col(outcome) == 1, F.col(entity)))
    return df.groupBy(label).agg(n.alias("entities"), hit.alias("with_outcome"), F.try_divide(hit, n).alias("rate"))
