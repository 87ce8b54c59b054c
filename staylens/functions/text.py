"""Label text, pattern flags and name classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_TEXT = "none"

# Substring patterns behind the drug-class and procedure flags.
DRUG_PATTERNS = {
    "rx_any_abx": [
        "cillin", "cef", "ceph", "penem", "floxacin",
        "vancomycin", "metronidazole", "piperacillin", "tazobactam",
    ],
    "rx_any_insulin": ["insulin"],
    "rx_any_diuretic": [
        "furosemide", "lasix", "bumetanide", "torsemide",
        "hydrochlorothiazide", "hctz", "spironolactone",
    ],
    "rx_any_steroid": ["predni", "methylpred", "hydrocortisone", "dexamethasone"],
}
PROCEDURE_PATTERNS = {
    "proc_vent_any": ["vent", "intubat", "endotracheal", "peep", "tidal volume"],
    "proc_rrt_any": ["dialysis", "crrt", "hemodialysis"],
    "proc_central_line_any": [
        "central line", "cvc", "subclavian", "internal jugular", "femoral line",
    ],
}

# Ordered substring rules for the ethnicity bucket; first hit wins.
ETHNICITY_RULES = {
    "WHITE": ["white"],
    "BLACK": ["black"],
    "ASIAN": ["asian"],
    "HISPANIC": ["hisp", "latino", "latina"],
}
ETHNICITY_OTHER = "OTHER"

MISSINGNESS_SUFFIXES = ("__measured", "__count")


def quoted(name: str) -> str:
    """Column name safe to use in an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a frame, safe for names with dots."""
    return [F.col(quoted(c)) for c in df.columns]


def lowered(text: Column) -> Column:
    """Lower-cased text with NULL spelled out."""
    return F.lower(F.coalesce(text.cast("string"), F.lit(MISSING_TEXT)))


def normal_label(text: Column) -> Column:
    """Trimmed lower-case label with NULL spelled out."""
    return F.trim(lowered(text))


def digits_only(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True when one of the alternatives occurs in the text; NULL is false."""
    return F.coalesce(text.rlike("|".join(patterns)), F.lit(False))


def bucket(text: Column, rules: Mapping[str, Sequence[str]], other: str) -> Column:
    """Name of the first rule with a substring inside the lower-cased text."""
    low = lowered(text)
    chosen = None
    for name, needles in rules.items():
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise(other)


def group_value(name: Column) -> Column:
    """Upper-cased rest of a column name after its first underscore."""
    return F.upper(F.substr(name, F.instr(name, "_") + F.lit(1)))


def name_group(feature: Column, default: str = "baseline") -> Column:
    """Provenance group of a feature name, taken from its suffix."""
    ends = F.lit(False)
    for suffix in MISSINGNESS_SUFFIXES:
        ends = ends | feature.endswith(suffix)
    return F.when(ends, F.lit("missingness")).otherwise(F.lit(default))
