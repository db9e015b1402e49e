"""CSV text: splitting, escaping and joining fields, as Catalyst expressions and, for schema files on the driver, as text.

A quote switches quoting anywhere in a field; a doubled quote inside quotes is one quote; a carriage return outside quotes
is dropped; an unclosed quote is an error; an empty line is one empty field. A field is quoted when it holds the delimiter, the
quote or a line end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER, QUOTE = ",", '"'


def _one(character: str) -> str:
    """A single character as it stands in a class of a Java pattern."""
    if len(character) != 1 or character in "\r\n":
        raise ValueError(f"{character!r} can't delimit or quote")
    return "\\" + character if not character.isalnum() and character.isascii() else character


def unclosed(line: Column, quote: str = QUOTE) -> Column:
    """Whether a line's quotes are odd in number."""
    return F.pmod(F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit(""))), F.lit(2)) == 1


def split(line: Column, delimiter: str = DELIMITER, quote: str = QUOTE) -> Column:
    """The array of a line's fields. Possessive patterns, so that long fields take neither stack nor backtracking."""
    d, q = _one(delimiter), _one(quote)
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"{d}((?:[^{q}{d}]++|{q}[^{q}]*+{q})*+)"), F.lit(1))
    tokens = lambda f: F.regexp_extract_all(f, F.lit(f"((?:{q}[^{q}]*+{q})++|[^{q}\r]++)"), F.lit(1))
    bare = lambda t: F.when(F.startswith(t, F.lit(quote)), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(t)
    fields = F.transform(parts, lambda f: F.when(F.contains(f, F.lit(quote)) | F.contains(f, F.lit("\r")), F.array_join(F.transform(tokens(f), bare), "")).otherwise(f))
    return F.when(unclosed(line, quote), F.raise_error(F.concat(F.lit("unclosed quote: "), line)).cast("array<string>")).otherwise(fields)


def needs_quotes(field: Column, delimiter: str = DELIMITER, quote: str = QUOTE) -> Column:
    return F.rlike(field, F.lit(f"[{_one(delimiter)}{_one(quote)}\n\r]"))


def escape(field: Column, delimiter: str = DELIMITER, quote: str = QUOTE) -> Column:
    doubled = F.concat(F.lit(quote), F.replace(field, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    return F.when(needs_quotes(field, delimiter, quote), doubled).otherwise(field)


def join(fields: Sequence[Column], delimiter: str = DELIMITER, quote: str = QUOTE) -> Column:
    """A line of fields, none of which is NULL (concat_ws would leave it out)."""
    return F.concat_ws(delimiter, *(escape(f, delimiter, quote) for f in fields))


def split_text(line: str, delimiter: str = DELIMITER, quote: str = QUOTE) -> list[str]:
    """split() for one line on the driver: pieces between quotes are quoted in turn."""
    pieces = line.split(quote)
    if len(pieces) % 2 == 0:
        raise ValueError(f"unclosed quote: {line}")
    fields = [""]
    for k, piece in enumerate(pieces):
        if k % 2:
            fields[-1] += piece
            continue
        if k and not piece and k + 1 < len(pieces):  # nothing between two quotes: a doubled one
            fields[-1] += quote
            continue
        first, *rest = piece.replace("\r", "").split(delimiter)
        fields[-1] += first
        fields += rest
    return fields


def join_text(fields: Sequence[str], delimiter: str = DELIMITER, quote: str = QUOTE) -> str:
    special = {delimiter, quote, "\n", "\r"}
    return delimiter.join(quote + f.replace(quote, quote * 2) + quote if special & set(f) else f for f in fields)
