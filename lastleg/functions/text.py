"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented Latin capitals and their plain letters.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCY"


def base_letters(x: Column) -> Column:
    """Every letter's base form: canonical decomposition without its combining marks. Plain ASCII stays in the JVM."""
    ascii_only = x.rlike(r"^\p{ASCII}*$")
    return F.when(x.isNull() | ascii_only, x).otherwise(_decomposed(F.when(~ascii_only, x)))


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def fold(x: Column) -> Column:
    """Upper case, base letters, everything but letters and digits to single spaces; null to empty."""
    return F.trim(F.regexp_replace(F.upper(base_letters(F.coalesce(x, F.lit("")))), "[^A-Z0-9]+", " "))


def words(x: Column) -> Column:
    """Lower case, base letters, all but letters, digits and underscores to single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(base_letters(x)), r"[^a-z0-9_\s]+", " "), r"\s+", " "))


def compatible(x: Column) -> Column:
    """Compatibility forms, without zero-width spaces, blanks squeezed; null stays null."""
    return F.trim(F.regexp_replace(F.replace(_compatible(x), F.lit("\u200b"), F.lit("")), r"\s+", " "))


def compare_numbers(a: Column, b: Column) -> tuple[Column, Column]:
    """Whether both addresses have numbers, and whether they share one."""
    return (F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def xml_escape(x: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        x = F.replace(x, F.lit(mark), F.lit(f"&{name};"))
    return x


def hsv_to_rgb(hue: Column, saturation: float, value: float) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255) of a hue in degrees."""
    x, chroma = hue / 60.0, value * saturation
    second, sector = F.lit(chroma) * (1 - F.abs(x % 2 - 1)), F.floor(x)
    low = F.lit(value - chroma)

    def part(full: tuple[int, int], rising: tuple[int, int]) -> Column:
        return 255 * (low + F.when(sector.isin(*full), chroma).when(sector.isin(*rising), second).otherwise(0.0))

    return part((0, 5), (1, 4)), part((1, 2), (0, 3)), part((3, 4), (2, 5))


def canonical(x: Column, known: dict[str, str]) -> tuple[Column, Column]:
    """A value's name by a map of folded spellings, else with capitals at each word; and how it was found."""
    key = fold(x)
    name = F.lit(None).cast("string")
    for spelling, value in known.items():
        name = F.when(key == spelling, value).otherwise(name)
    title = F.initcap(F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.coalesce(name, title), F.when(x.isNull(), "missing").when(name.isNotNull(), "map").otherwise("title")


def normalize_text(x: Column) -> Column:
    """Upper case, Latin accents folded, everything but letters and digits to single spaces; null to empty."""
    folded = F.translate(F.upper(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(folded, "[^A-Z0-9]+", " "))


def zone_key(x: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("all"))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "'", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def address_numbers(x: Column) -> Column:
    """Distinct numbers of an address, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normalize_text(x), F.lit(r"\b\d+\b"), F.lit(0))))


def customer_key(x: Column) -> Column:
    """Ids as text: 123.0 and 123 are one id; null is empty."""
    number = x.try_cast("double")
    return F.when(x.isNull(), "").when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(F.trim(x))


def branch_id(x: Column) -> Column:
    """The branch number of a description, with its prefix."""
    patterns = (r"(?i)\bOP\s*(\d{3,})\b", r"(?i)\bOFICINA\s*(\d{3,})\b", r"(?i)\bSUC\w*\s*(\d{3,})\b", r"\b(\d{6,})\b")
    found = F.coalesce(*(F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns))
    return F.when(found.isNotNull(), F.concat(F.lit("OP"), found))
