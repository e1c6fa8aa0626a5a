"""Parsing as Column expressions: selectors, numbers in logs, keys, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ELEMENTS, HARTREE_EV

MISSING = ("", "na", "n/a", "nan", "none", "null", "-")
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EeDd][-+]?[0-9]+)?"


def number(text: Column) -> Column:
    """A double, Fortran exponents included; null where it isn't one."""
    return F.regexp_replace(F.trim(text), "[Dd]", "E").try_cast("double")


def numbers(text: Column) -> Column:
    """All numbers in a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), number)


def last_number(text: Column) -> Column:
    found = numbers(text)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def missing(text: Column) -> Column:
    """Whether a cell of a text table counts as missing."""
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING)


def key(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def filename_part(text: Column) -> Column:
    """A safe part of a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9._-]+", "_"), "^_+|_+$", "")


def element_of(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias, else the exact symbol, else the first two letters, else the first letter; null where none is an element."""
    symbols = F.array(*(F.lit(s) for s in ELEMENTS))
    letters = F.regexp_replace(raw, "[^A-Za-z]", "")
    known = lambda s: F.when(F.array_contains(symbols, s), s)
    proper = lambda n: known(F.concat(F.upper(F.substring(letters, 1, 1)), F.lower(F.substring(letters, 2, n - 1))))
    options = [known(raw), proper(2), proper(1)]
    if aliases:
        pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        options.insert(0, F.element_at(pairs, raw))
    return F.coalesce(*options)


# The forms of a Fermi energy in a log, and whether it is in atomic units or in electron volts.
_VALUE = r"([+-]?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?)"
FERMI = (
    (r"(?i:Fermi\s+energy\s*\[(?:a\.u\.|hartree)\]\s*:\s*)" + _VALUE, HARTREE_EV),
    (r"Fermi\s+energy\s*:\s*" + _VALUE, HARTREE_EV),
    (r"Fermi\s+energy\s*\[eV\]\s*:\s*" + _VALUE, 1.0),
    (r"E\(Fermi\)\s*=\s*" + _VALUE + r"\s*(?:a\.u\.|au|A\.U\.)", HARTREE_EV),
)


def fermi_ev(line: Column) -> Column:
    """The last Fermi energy of a line in eV; of forms that start at the same place the later one; null without one."""
    found = []
    for i, (pattern, factor) in enumerate(FERMI):
        p = F.lit(f"(?s)^(.*){pattern}")
        value = F.nullif(F.regexp_extract(line, f"(?s)^(.*){pattern}", 2), F.lit("")).try_cast("double") * factor
        found.append(F.when(F.regexp_like(line, p), F.struct(F.length(F.regexp_extract(line, f"(?s)^(.*){pattern}", 1)).alias("at"), F.lit(i).alias("form"), value.alias("ev"))))
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))["ev"]


def utc_iso(time: Column) -> Column:
    """A time in UTC as ISO text of whole seconds."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def output_name(source: Column, analysis: str, ending: str = ".h5") -> Column:
    """The name of an analysis of a source: its file name without ending, the analysis, and the ending of the store."""
    name = F.regexp_extract(source, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(f".{analysis}{ending}"))


def numbered_name(name: Column, number: Column) -> Column:
    """A name with _number before its first dot, as a name that is taken gets it."""
    return F.concat(F.regexp_extract(name, r"^([^.]*)", 1), F.lit("_"), number.cast("string"), F.regexp_extract(name, r"^[^.]*(.*)$", 1))


def parse_selection_token(token: str) -> tuple[float, str]:
    """Number and unit (f, %, ps, step) of a token of a frame selector."""
    m = re.fullmatch(r"\s*([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)\s*(f|%|ps|steps?)?\s*", token)
    if not m:
        raise ValueError(f"not a frame selector: {token!r}")
    unit = (m[2] or "f").rstrip("s") if (m[2] or "f").startswith("step") else (m[2] or "f")
    return float(m[1]), unit


def expand_indices(text: Column) -> Column:
    """The numbers of a list such as `4 7..9,12`, ranges inclusive, in order."""
    parts = F.filter(F.split(text, r"[\s,]+"), lambda x: x.rlike(r"^\d+(\.\.\d+)?$"))
    ends = lambda x: F.transform(F.split(x, r"\.\."), lambda y: y.cast("int"))
    return F.flatten(F.transform(parts, lambda x: F.sequence(F.element_at(ends(x), 1), F.element_at(ends(x), -1))))


def natural_key(name: Column) -> tuple[Column, Column]:
    """Order by number where a name is one, then by text."""
    return name.try_cast("long").asc_nulls_last(), name.asc()
