"""Normalise, parse, resolve: each step as one column expression over the one before."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract.model import ColumnParser, ParserOptions, SparkDataType
from ..contract.vocabulary import Encoding, OnError, ParserType
from ..functions import text as T


def normalised(source: Column, p: ParserOptions) -> Column:
    if p.collapse_whitespace:
        # What is left of white space is single spaces, which need no pattern to trim.
        return F.trim(T.collapse(source)) if p.trim_whitespace else T.collapse(source)
    return T.trim(source) if p.trim_whitespace else source


def is_empty(normal: Column, p: ParserOptions) -> Column:
    return F.coalesce(normal == "", F.lit(False)) if p.empty_is_null else F.lit(False)


def is_marker(normal: Column, p: ParserOptions) -> Column:
    """Never true of what counts as empty already."""
    if not (p.replace_null_markers and p.null_markers):
        return F.lit(False)
    # Both sides are lowered by Spark, whose tables decide.
    hit = normal.isin(*p.null_markers) if p.null_marker_case_sensitive else F.lower(normal).isin(*[F.lower(F.lit(m)) for m in p.null_markers])
    return F.coalesce(hit, F.lit(False)) & ~is_empty(normal, p)


def present(normal: Column, p: ParserOptions) -> Column:
    return F.when(~(is_empty(normal, p) | is_marker(normal, p)), normal)


def is_bad(value: Column, candidate: Column) -> Column:
    return value.isNotNull() & candidate.isNull()


def literal(value: Any, kind: SparkDataType, encoding: Encoding = Encoding.BASE64) -> Column:
    """A compiled default as a typed literal."""
    if kind.parser_type is ParserType.BINARY:
        return F.try_to_binary(F.lit(value), F.lit("utf-8" if encoding is Encoding.UTF8 else encoding.value))
    return F.lit(format(value, "f") if isinstance(value, Decimal) else value).cast(kind.ddl)


def resolved(value: Column, candidate: Column, source: Column, c: ColumnParser, collect: bool) -> Column:
    """What stands after a failed parse."""
    policy, bad = c.parser.on_parse_error, is_bad(value, candidate)
    if policy is OnError.NULL or (policy is OnError.FAIL and collect):
        return candidate
    if policy is OnError.DEFAULT:
        return F.when(bad, literal(c.parser.default_on_error, c.data_type, c.parser.binary_encoding)).otherwise(candidate)
    if policy is OnError.PRESERVE:
        return F.when(bad, source).otherwise(candidate)
    message = F.concat(F.lit(f"Source {c.source_column_name!r} could not be parsed into target column {c.target_column_name!r} as {c.expected_data_type}: "), source)
    return F.when(bad, F.raise_error(message).cast(c.data_type.ddl)).otherwise(candidate)


def is_zero(value: Column, p: ParserOptions) -> Column:
    return F.lit(False) if p.zero_is_valid else F.coalesce(value == 0, F.lit(False))


def final(value: Column, c: ColumnParser) -> Column:
    out = value if c.parser.zero_is_valid else F.when(~is_zero(value, c.parser), value)
    return out if c.parser.is_nullable else F.coalesce(out, literal(c.parser.default_on_null, c.data_type, c.parser.binary_encoding))
