"""Text expressions on code-point offsets. All of them stay on the JVM but for ``normalize_surface``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dash variants that count as a hyphen.
DASHES = "‐‑‒–—−"
_TO_HYPHEN = str.maketrans(dict.fromkeys(DASHES, "-"))
# Words without an initial in an acronym.
INITIAL_STOP_WORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "type", "with")
# Generic ontology names that are no findings.
GENERIC_ALIASES = (
    "abnormal", "abnormality", "acute", "all", "bilateral", "clinical abnormality", "congenital", "decreased", "disorder", "generalized", "high",
    "increased", "large", "low", "mild", "moderate", "phenotypic abnormality", "severe", "short", "small", "unilateral", "wide",
)
# Cues of negation before and after a finding.
NEGATION_BEFORE = (
    r"(?i)(?:\bno\b|\bwithout\b|\babsence of\b|\babsent\b|\bnegative for\b|\bfree of\b|\bden(?:y|ied|ies)\b|\bdid not (?:have|show|demonstrate|exhibit)\b|\b(?:not|never) (?:have|show|demonstrate|exhibit)\b)"
    r"(?:\s+(?:evidence|signs?|symptoms?|history|presence)\s+of\b|\s+(?:any|an?\s+|the\s+|bilateral\s+|unilateral\s+|mild\s+|severe\s+|significant\s+|obvious\s+|clinical\s+))*\s*$"
)
NEGATION_AFTER = r"(?i)^\s+(?:was|were|is|are|remained|remains)\s+(?:absent|not present|not observed|negative)\b"
NEGATION_NEAR = r"(?i)\b(?:no|not|without|lack(?:ing|s|ed)?(?:\s+of)?|absent|neither)\b"


def normalized(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).translate(_TO_HYPHEN).casefold().split())


@F.pandas_udf(T.StringType())
def normalize_surface(texts: pd.Series) -> pd.Series:
    """NFKC, dashes as hyphens, case folded, white space collapsed; null stays null."""
    return texts.map(normalized, na_action="ignore")


def normalize_ascii(text: Column) -> Column:
    """The same for texts of ASCII and simple letters, without Python."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, DASHES, "-" * len(DASHES))), r"(?U)\s+", " "))


def is_positive(note: Column) -> Column:
    """Null counts as positive."""
    return ~note.eqNullSafe(F.lit("NO"))


def sentence_start(text: Column, start: Column) -> Column:
    """Code points before the sentence that holds ``start``."""
    return F.length(F.regexp_extract(F.substr(text, F.lit(1), start), r"(?s)^.*[.!?;\n]", 0))


def sentence_end(text: Column, end: Column) -> Column:
    """Code points up to and with the mark that ends the sentence after ``end``."""
    return end + F.length(F.regexp_extract(F.substr(text, end + 1), r"(?s)^[^.!?;\n]*[.!?;\n]?", 0))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def is_uppercase_abbreviation(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 2) & t.rlike(r"[A-Z]") & t.rlike(r"^[A-Z0-9]+(?:[/-][A-Z0-9]+)*$")


def initials(text: Column) -> Column:
    """Capital initials of the words and whole numbers, without stop words."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[0-9]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*INITIAL_STOP_WORDS))
    return F.upper(F.array_join(F.transform(kept, lambda w: F.when(w.rlike("^[0-9]"), w).otherwise(F.substring(w, 1, 1))), ""))


def units(identifier: Column) -> Column:
    """The single ids of a compound identifier."""
    return F.filter(F.split(identifier, ";"), lambda u: u != "")
