"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

UNSPECIFIED = "NO ESPECIFICADO"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition leaves ASCII, by rule."""
    one_from, one_to, many = [], [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        kept = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(kept) == 1:
            one_from.append(char)
            one_to.append(kept)
        elif kept:
            many[char] = kept
    return "".join(one_from), "".join(one_to), many


def literal_map(entries: dict[str, object]) -> Column:
    """Constant text map from one literal; Catalyst folds it once per plan."""
    packed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))


def ascii_fold(column: Column) -> Column:
    """Drop accents and everything that has no ASCII form.

    Plain texts pass through; single letters are translated; only texts with
    characters that spell out as several letters are walked one by one.
    """
    one_from, one_to, many = _fold_tables()
    table = literal_map(many)
    letter = lambda c: F.when(c < F.lit("\x80"), c).otherwise(F.coalesce(F.element_at(table, c), c))
    spelled = F.array_join(F.transform(F.split(column, ""), letter), "")
    rare = F.length(F.translate(column, "".join(many), "")) < F.length(column)
    fold = lambda c: F.regexp_replace(F.translate(c, one_from, one_to), r"[^\x00-\x7F]", "")
    plain = F.octet_length(column) == F.length(column)
    return F.when(plain, column).when(~rare, fold(column)).otherwise(fold(spelled))


def collapse_spaces(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def normalize_text(column: Column, default: str | None = UNSPECIFIED) -> Column:
    """Upper case, ASCII, single spaces; ``default`` where nothing is left."""
    text = collapse_spaces(ascii_fold(F.upper(F.coalesce(column, F.lit("")))))
    if default is None:
        return text
    return F.when(text == "", F.lit(default)).otherwise(text)


def first_non_empty(*columns: Column) -> Column:
    """First value of the row that is not NULL or blank."""
    cleaned = [F.trim(c.cast("string")) for c in columns]
    return F.coalesce(*[F.when(c != "", c) for c in cleaned])


def decimal_number(column: Column) -> Column:
    """Number written with point or comma; anything else becomes NULL."""
    text = F.replace(F.trim(column.cast("string")), F.lit(","), F.lit("."))
    return text.try_cast("double")
