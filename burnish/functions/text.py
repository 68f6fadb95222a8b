"""Unicode white space and lookups."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
SPACE_CLASS = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LETTER_LIKE = r"[\p{L}\p{N}_]"


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def trim(text: Column) -> Column:
    # Possessive, so that long runs inside a value are passed over once.
    return F.regexp_replace(text, rf"\A{SPACE_CLASS}++|(?<!{SPACE_CLASS}){SPACE_CLASS}++\z", "")


def remove_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def split_spaces(text: Column) -> Column:
    return F.split(text, f"{SPACE_CLASS}+", -1)


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), trim)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The value of a key in a literal map, null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def whole_token(pattern: str) -> str:
    """Any case, and not next to a letter, digit or underscore."""
    return rf"(?i)(?<!{LETTER_LIKE}){pattern}(?!{LETTER_LIKE})"


def quoted(token: str) -> str:
    return re.escape(token)


def join_valid(parts: Column, separator: str = ", ") -> Column:
    """The parts joined, or null if any is null."""
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, separator))
