"""Full-token scalar parsing.  Null in gives null; text that is no such value gives null; ANSI mode changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract.model import ParserOptions, SparkDataType
from ..contract.vocabulary import INTEGER_BITS, ISO_DAY, ISO_LOCAL, ISO_OFFSET, SQL_LOCAL, US_MINUTE, US_SECOND, Encoding, ParserType

WHOLE = r"\A[+-]?[0-9]+\.?\z"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def parse_integer(text: Column, ddl: str) -> Column:
    return F.when(text.rlike(WHOLE), F.rtrim(text, F.lit(".")).try_cast(ddl))


def parse_decimal(text: Column, ddl: str) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast(ddl))


def parse_floating(text: Column, ddl: str) -> Column:
    """May be infinite, or zero by underflow; checked_floating() decides."""
    return F.when(text.rlike(NUMBER), text.try_cast(ddl))


def checked_floating(text: Column, value: Column) -> Column:
    """Finite values only, and no zero from a token with a digit other than zero before its exponent."""
    return F.when((F.abs(value) < float("inf")) & ((value != 0) | ~text.rlike(r"\A[^eE]*[1-9]")), value)


def parse_binary(text: Column, encoding: Encoding) -> Column:
    read = F.try_to_binary(text, F.lit("utf-8" if encoding is Encoding.UTF8 else encoding.value))
    if encoding is Encoding.BASE64:
        return F.when(text.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(text) % 4 == 0), read)
    return F.when(text.rlike(r"\A[0-9A-Fa-f]*\z"), read) if encoding is Encoding.HEX else read


def parse_boolean(text: Column, true: Sequence[str], false: Sequence[str], case_sensitive: bool) -> Column:
    fold: Callable[[Column], Column] = (lambda c: c) if case_sensitive else F.lower
    is_one_of = lambda tokens: fold(text).isin(*[fold(F.lit(t)) for t in tokens])
    return F.when(is_one_of(true), F.lit(True)).when(is_one_of(false), F.lit(False))


_TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?"
_OFFSET = r"(?:Z|[+-][0-9]{2}:[0-9]{2})"
_US = r"\A([0-9]{2})/([0-9]{2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2})%s ([AaPp])[Mm]\z"


def _same(text: Column) -> Column:
    return text


def _us_to_iso(pattern: str, seconds: bool) -> Callable[[Column], Column]:
    """Month-first text of the 12-hour clock as ISO text; null for an hour that the clock has not."""

    def rewrite(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        hour = part(4).try_cast("int")
        late = F.lower(part(7 if seconds else 6)) == "p"
        on_24 = hour % 12 + F.when(late, 12).otherwise(0)
        iso = F.concat(part(3), F.lit("-"), part(1), F.lit("-"), part(2), F.lit("T"), F.lpad(on_24.cast("string"), 2, "0"), F.lit(":"), part(5), F.lit(":"), part(6) if seconds else F.lit("00"))
        return F.when(hour.between(1, 12), iso)

    return rewrite


# Built-in patterns: (shape of the whole token, rewrite to text that a cast reads).  Casts know the Gregorian
# calendar whatever the time-parser policy says; the shapes keep them from reading more than the pattern.
BUILT_IN: dict[str, tuple[str, Callable[[Column], Column]]] = {
    ISO_DAY: (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", _same),
    ISO_LOCAL: (rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}\z", _same),
    ISO_OFFSET: (rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}{_OFFSET}\z", _same),
    SQL_LOCAL: (rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_TIME}\z", _same),
    US_MINUTE: (_US % "", _us_to_iso(_US % "", False)),
    US_SECOND: (_US % ":([0-9]{2})", _us_to_iso(_US % ":([0-9]{2})", True)),
}


def _local(text: Column, pattern: str) -> Column:
    """The fields as written, without a zone.  An offset must be legal and is then left aside."""
    if pattern in BUILT_IN:
        shape, rewrite = BUILT_IN[pattern]
        value = rewrite(text)
        if pattern == ISO_OFFSET:
            value = F.when(text.try_cast("timestamp_ltz").isNotNull(), F.regexp_replace(text, rf"{_OFFSET}\z", ""))
        return F.when(text.rlike(shape), value.try_cast("timestamp_ntz"))
    return F.when(_instant(text, pattern).isNotNull(), F.to_timestamp_ntz(text, F.lit(pattern)))


def _instant(text: Column, pattern: str) -> Column:
    if pattern in BUILT_IN:
        shape, rewrite = BUILT_IN[pattern]
        return F.when(text.rlike(shape), rewrite(text).try_cast("timestamp_ltz"))
    # The JSON reader takes a pattern and a stated type, and gives null where the text does not match.
    read = F.from_json(F.to_json(F.struct(text.alias("v"))), "v timestamp_ltz", {"timestampFormat": pattern})["v"]
    return F.when(text.isNotNull(), read)


def parse_temporal(text: Column, kind: ParserType, patterns: Sequence[str]) -> Column:
    """The first pattern that reads the text decides."""
    one = _instant if kind is ParserType.TIMESTAMP else _local
    value = F.coalesce(*[one(text, p) for p in patterns])
    return value.cast("date") if kind is ParserType.DATE else value


def needs_check(kind: SparkDataType) -> bool:
    """Whether parse_scalar() is to be followed by checked_floating(), on a column so that casts are not repeated."""
    return kind.parser_type in (ParserType.FLOAT, ParserType.DOUBLE)


def parse_scalar(text: Column, kind: SparkDataType, options: ParserOptions) -> Column:
    t = kind.parser_type
    if t in INTEGER_BITS:
        return parse_integer(text, kind.ddl)
    if t is ParserType.DECIMAL:
        return parse_decimal(text, kind.ddl)
    if t in (ParserType.FLOAT, ParserType.DOUBLE):
        return parse_floating(text, kind.ddl)
    if t is ParserType.BINARY:
        return parse_binary(text, options.binary_encoding)
    if t is ParserType.BOOLEAN:
        return parse_boolean(text, options.true_values, options.false_values, options.boolean_case_sensitive)
    if t is ParserType.STRING:
        from .profiles import apply_format

        return apply_format(text, options.string_format)
    return parse_temporal(text, t, options.formats)
