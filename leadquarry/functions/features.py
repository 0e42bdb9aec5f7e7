"""Feature scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadquarry.functions.text import BLANK

# --- fixed values: patterns and weights that define the features -----------------------
LEGAL_ENTITY_PATTERNS = [
    r"\bsarl\b", r"\bsuarl\b", r"\bs\.?a\.?r\.?l\.?\b",
    r"\bs\.?a\.?\b", r"\bspa\b", r"\bsnc\b", r"\bscs\b",
    r"\bets\b", r"\betablissement", r"\bentreprise",
    r"\bgroupe\b", r"\bsociete\b", r"\bste\b", r"\bcompany\b",
    r"\bllc\b", r"\bltd\b", r"\bgmbh\b", r"\binc\b",
]
VERTICAL_PATTERNS = {
    "medical": r"clinic|clinique|medic|pharmac|dentaire|dentist|hospital|hopital|labo|laborat|imagerie|radiolog|cabinet.*medical",
    "industrial": r"industri|usine|fabric|manufactur|metallurg|plastique|chimique|textile",
    "transport": r"transport|logistic|logisti|cargo|freight|shipping|expedition|livraison|taxi",
    "it": r"informatique|software|technolog|digital|numerique|systeme|reseau|network|it\s|solution",
    "restaurant": r"restaurant|cafe|coffee|resto|pizza|snack|patisser|boulanger",
    "hotel": r"hotel|motel|hostel|residence|dar\b|auberge|villa\b|resort",
    "retail": r"boutique|magasin|shop|store|supermarch|epicer|commerce",
    "education": r"ecole|school|institut|universit|college|formation|academy|academie",
    "construction": r"construction|batiment|immobilier|architec|travaux|entreprise.*btp|beton",
    "auto": r"auto|garage|vehicule|mecanique|carrosser|pieces.*auto",
    "finance": r"banque|bank|assurance|insurance|finance|comptable|expert",
    "services": r"service|consulting|conseil|agence|bureau",
}
ADDRESS_PATTERNS = {
    "zone_industrielle": r"zone\s+industriel|z\.i\.|parc\s+industriel|parc\s+d.?activit",
    "has_immeuble": r"immeuble|residence|complexe|centre\s+commercial",
    "has_avenue_rue": r"\bavenue\b|\bav\.?\b|\brue\b|\bboulevard\b|\bbd\.?\b|\broute\b",
    "has_floor": r"etage|floor|\bappart|\bapt\b",
}
PHONE_TN, HOST_TN, HOST_SOCIAL = r"\+?216", r"\.tn(/|$)", r"facebook\.com|instagram\.com|linkedin\.com"
CONFIDENCE_WEIGHTS = {"exact": 1.0, "high": 1.0, "borderline": 0.5, "": 1.0}
# ---------------------------------------------------------------------------------------


def flag(condition: Column) -> Column:
    """0/1 int; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Unicode-aware search of a pattern; null text never matches."""
    return flag(c.rlike(("(?iU)" if ignore_case else "(?U)") + pattern))


def number(c: Column) -> Column:
    """Coerced number; bad text and NaN read as missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """Not null and not the empty string (the supervised stage uses :func:`not_null`)."""
    return flag(filled(c) != "")


def not_null(c: Column) -> Column:
    return flag(c.isNotNull())


def email_count(c: Column) -> Column:
    return F.size(F.filter(F.split(filled(c), ";"), lambda e: F.regexp_replace(e, f"{BLANK}+", "") != ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(filled(c), f"{BLANK}+"), lambda t: t != ""))


def is_upper(c: Column) -> Column:
    """More than three characters, at least one letter, unchanged by upper-casing."""
    s = filled(c)
    return flag((F.length(s) > 3) & (F.upper(s) == s) & s.rlike(r"\p{L}"))


def positive_weight(confidence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CONFIDENCE_WEIGHTS.items() for x in kv])
    return F.coalesce(known[filled(confidence)], F.lit(1.0))
