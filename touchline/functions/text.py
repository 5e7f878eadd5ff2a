"""Text, number and time cleaning as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words read as null and words read as true.
NULL_WORDS = ("", "nan", "none", "null", "<na>", "nat")
TRUE_WORDS = ("true", "1", "yes", "y")


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """ASCII remains of the compatibility decomposition of Latin letters and full-width forms: those of
    one letter, and those of several."""
    one, more = {}, {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(code)] = plain
        elif plain:
            more[chr(code)] = plain
    return one, more


_ONE, _MORE = _decompositions()
ACCENTED, PLAIN = "".join(_ONE), "".join(_ONE.values())
PERIOD_WORDS = {
    1: ("firsthalf", "1sthalf", "1h", "h1", "first", "1"),
    2: ("secondhalf", "2ndhalf", "2h", "h2", "second", "2"),
    3: ("firstperiodofextratime", "extratimefirsthalf", "firstextratime", "et1", "3"),
    4: ("secondperiodofextratime", "extratimesecondhalf", "secondextratime", "et2", "4"),
    5: ("penaltyshootout", "penalties", "shootout", "pso", "5"),
}


def compact(col: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "")


def clean(col: Column) -> Column:
    """Null-like words become null, other text is trimmed."""
    return F.when(F.lower(F.trim(col)).isin(*NULL_WORDS), None).otherwise(F.trim(col))


def truthy(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def fold(col: Column) -> Column:
    """Letters without their accents, ligatures spelt out, whatever has no ASCII form left out."""
    spelt = F.translate(col, ACCENTED, PLAIN)
    rare = spelt
    for letter, plain in _MORE.items():
        rare = F.replace(rare, F.lit(letter), F.lit(plain))
    spelt = F.when(spelt.rlike("[" + "".join(_MORE) + "]"), rare).otherwise(spelt)
    return F.regexp_replace(spelt, r"[^\x00-\x7F]", "")


def team_key(col: Column) -> Column:
    """ASCII fold, ``&`` read as "and", letters and digits only."""
    return compact(F.regexp_replace(fold(col), "&", "and"))


def slug(col: Column) -> Column:
    """Every other character becomes one ``_``; those at the ends go."""
    kept = F.regexp_replace(fold(F.coalesce(col, F.lit(""))), "[^A-Za-z0-9_.]", "_")
    return F.regexp_replace(kept, "^_+|_+$", "")


def period_number(col: Column) -> Column:
    """Period text or number -> 1..5, anything unknown -> 1."""
    word = compact(F.regexp_replace(col.cast("string"), r"\.0+$", ""))
    out = F.lit(None).cast("int")
    for value, words in PERIOD_WORDS.items():
        out = F.when(word.isin(*words), F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(1))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def number(name: str) -> Column:
    """Unparseable text is null (a plain cast raises under ANSI)."""
    return F.expr(f"try_cast({name} as double)")


def alias_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """For each target take the first alias the frame has; other columns stay."""
    have = set(df.columns)
    used = {}
    for target, names in aliases.items():
        found = next((n for n in names if n in have), None)
        if found is not None:
            used[target] = found
    drop = [c for t, c in used.items() if c != t]
    return df.withColumns({t: F.col(c) for t, c in used.items()}).drop(*drop)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))
