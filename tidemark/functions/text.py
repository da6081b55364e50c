"""Text and type rules as column expressions."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Letters with marks and the plain letters that they count as.
MARKED = "áàâãäåæçéèêëíìîïñóòôõöøúùûüýÿšžćčğıł"
PLAIN = "aaaaaaaceeeeiiiinoooooouuuuyyszccgil"

#: What a position may be called.
POSITIONS = {
    "1": "GKP", "gk": "GKP", "gkp": "GKP", "goalkeeper": "GKP",
    "2": "DEF", "def": "DEF", "defender": "DEF",
    "3": "MID", "mid": "MID", "midfielder": "MID",
    "4": "FWD", "fwd": "FWD", "for": "FWD", "forward": "FWD", "striker": "FWD",
}


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: str | Column) -> Column:
    """Lower case without marks; ß counts as ss."""
    return F.translate(F.replace(F.lower(column(x)), F.lit("ß"), F.lit("ss")), MARKED, PLAIN)


def normal_name(x: str | Column) -> Column:
    """Folded, & as and, other than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.replace(fold(x), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def compact_name(x: str | Column) -> Column:
    return F.replace(normal_name(x), F.lit(" "), F.lit(""))


def last_token(x: str | Column) -> Column:
    return F.element_at(F.split(normal_name(x), " "), -1)


def initial_surname(x: str | Column) -> Column:
    """First letter and last token; null for a single token."""
    name = normal_name(x)
    return F.when(name.contains(" "), F.concat(F.substring(name, 1, 1), F.lit(" "), last_token(x)))


def name_variants(x: str | Column) -> Column:
    """The distinct spellings to compare, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.array(normal_name(x), compact_name(x), last_token(x), initial_surname(x)), lambda v: v.isNotNull() & (v != ""))))


def raw_id(x: str | Column) -> Column:
    """Trimmed, without a trailing .0; empty counts as null."""
    return F.nullif(F.regexp_replace(F.trim(column(x).cast("string")), r"\.0$", ""), F.lit(""))


def position_code(x: str | Column) -> Column:
    """The code of a position by any of its names, null if unknown."""
    table = F.create_map(*(F.lit(v) for pair in POSITIONS.items() for v in pair))
    return F.try_element_at(table, F.lower(F.trim(column(x))))


def team_name(x: str | Column) -> Column:
    """Usual short forms written out."""
    out = normal_name(x)
    for short, full in (("man", "manchester"), ("utd", "united"), ("nottm", "nottingham"), ("spurs", "tottenham")):
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return out


def to_bool(x: str | Column) -> Column:
    """true, false, or null where the text says neither."""
    t = F.lower(F.trim(column(x).cast("string")))
    return F.when(t.isin("true", "1", "yes", "y", "t", "1.0"), True).when(t.isin("false", "0", "no", "n", "f", "0.0"), False)


def to_number(x: str | Column, kind: str = "double") -> Column:
    """The number, null where the text is none."""
    return F.trim(column(x)).try_cast(kind)


def kickoff(x: str | Column) -> tuple[Column, Column]:
    """(timestamp, status) of ISO 8601 text: known, missing or invalid."""
    text = F.nullif(F.trim(column(x)), F.lit(""))
    ts = F.try_to_timestamp(text)
    return ts, F.when(text.isNull(), "missing").when(ts.isNull(), "invalid").otherwise("known")


def nested_get(x: str | Column, keys: Sequence[str], default: str | None = None) -> Column:
    """The value of nested keys in a JSON object, as text; `default` where a key on the way is missing, null where its value is null."""
    level, found = column(x), F.lit(True)
    for key in keys:
        members = F.from_json(level, "map<string,string>")
        found = found & F.coalesce(F.map_contains_key(members, F.lit(key)), F.lit(False))
        level = F.try_element_at(members, F.lit(key))
    return F.when(found, level).otherwise(F.lit(default).cast("string"))


def season_valid(x: str | Column) -> Column:
    """YYYY_YY with consecutive years."""
    c = column(x)
    return F.coalesce(c.rlike(r"^\d{4}_\d{2}$") & ((F.substring(c, 1, 4).try_cast("int") + 1) % 100 == F.substring(c, 6, 2).try_cast("int")), F.lit(False))


def season_start(x: str | Column) -> Column:
    return F.when(season_valid(x), F.substring(column(x), 1, 4).try_cast("int"))


def safe_segment(x: str | Column) -> Column:
    return F.coalesce(column(x).rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"), F.lit(False))


def text_list(x: str | Column) -> Column:
    """A list out of JSON text, or of text with commas; empty parts go."""
    c = F.trim(column(x))
    split = F.transform(F.split(c, ","), lambda p: F.trim(p))
    parsed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(split)
    return F.coalesce(F.filter(parsed, lambda p: p.isNotNull() & (p != "")), F.array().cast("array<string>"))


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; Spark has no such function. Null for a null side."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
