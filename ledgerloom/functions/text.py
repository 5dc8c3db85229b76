"""Text of headers, names and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DOSAGE_NOISE, FOOTER, LETTERHEAD, PAGE_MARK, PAGE_TOTAL, RUNNING_TOTAL, SERIAL_HEADERS, STRENGTH

TORN = ("MRP", "QTY", "HSN", "GST", "CGST", "SGST", "PTR", "EXP", "AMT", "DISC", "RATE", "PACK")
GSTIN = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def last_found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match; null where nothing matches."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def falsy_coalesce(a: Column, b: Column) -> Column:
    """b where a is null or zero."""
    return F.when(a.isNull() | (a == 0), b).otherwise(a)


def cleaned(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def collapsed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def header_repaired(c: Column) -> Column:
    """Joins headers that were torn into letters, such as `M R P` or `Q T Y`."""
    for word in TORN:
        c = F.regexp_replace(c, "(?i)\\b" + r"[\s.]+".join(word) + r"\b\.?", word)
    return collapsed(c)


def is_serial_header(c: Column) -> Column:
    return cleaned(c).isin(SERIAL_HEADERS)


def drug_name(c: Column) -> Column:
    """The core of a product name: no dosage forms, pack counts or punctuation."""
    s = F.regexp_replace(F.upper(F.trim(c)), STRENGTH, "$1$2")
    s = F.regexp_replace(s, r"[()\[\]{}/\\,:;*#@!?_-]", " ")
    s = collapsed(F.regexp_replace(s, "(?i)" + DOSAGE_NOISE, " "))
    return F.when(s != "", s).otherwise(F.upper(F.trim(c)))


def any_of(phrases: list[str]) -> str:
    """A regular expression that is found where one of the phrases is. Common beginnings stand once: all phrases in a row
    would be tried at each letter."""
    root: dict = {}
    for p in sorted(set(phrases)):
        at = root
        for ch in p:
            if "" in at:  # a shorter phrase is found wherever this one is
                break
            at = at.setdefault(ch, {})
        else:
            at[""] = {}

    def text(at: dict) -> str:
        parts = [re.escape(ch) + text(x) for ch, x in at.items()] if "" not in at else []
        return f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)

    return text(root)


def contains_any(c: Column, phrases: list[str]) -> Column:
    return c.rlike(any_of(phrases))


def is_footer(joined: Column) -> Column:
    """Footer phrases, amounts in words, or marks of a page that continues."""
    return footer_read(F.lower(joined))


def footer_read(low: Column) -> Column:
    """is_footer() of a text in lower case."""
    return contains_any(low, FOOTER) | footer_shaped(low)


def footer_shaped(low: Column) -> Column:
    """What footer_read() tells by more than a phrase."""
    words = low.rlike(r"\b(thousand|hundred|lakh|crore)\b") & low.rlike(r"\b(only|and|rupees|rs\.?)\b")
    return words | low.rlike(r"\b(continue|continued|contd|cont\.)\b|\bpage\s*\.{2,}\b|\bpage\s*\d+\s*of\s*\d+\b")


def is_letterhead(joined: Column) -> Column:
    return contains_any(F.lower(joined), LETTERHEAD)


def row_reason(joined: Column, is_header: Column) -> Column:
    """Why a table row is no line item; null for those that are."""
    low = F.lower(joined)
    return (
        F.when(is_header, "REPEATED_HEADER_ROW")
        .when(low.rlike(RUNNING_TOTAL), "RUNNING_BF_CF_ROW")
        .when(low.rlike(PAGE_TOTAL), "PAGE_SUBTOTAL_ROW")
        .when(low.rlike(PAGE_MARK), "PAGE_CONTINUATION_CHROME")
        .when(is_footer(joined) | is_letterhead(joined), "LETTERHEAD_OR_FOOTER_ROW")
    )


def identity_status(name: Column, gstin: Column, confidence: Column) -> Column:
    """How safely a supplier is known. Punctuation in a tax number doesn't count; a name has three letters or
    digits at least, and not digits alone."""
    valid = F.regexp_replace(F.upper(gstin), "[^A-Z0-9]", "").rlike("^" + GSTIN.replace("\\b", "") + "$")
    plain = cleaned(F.coalesce(name, F.lit("")))
    named = (F.length(plain) >= 3) & ~plain.rlike(r"^\d+$")
    return F.when(valid, "EXACT_GSTIN").when(named & (confidence.isNull() | (confidence >= 0.7)), "VERIFIED_NAME").when(named, "SUPPLIER_IDENTITY_REVIEW_REQUIRED").otherwise("NO_IDENTITY")
