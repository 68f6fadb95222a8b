"""Evidence about rows: collected errors and audit records."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract.identity import parser_mapping
from ..contract.model import ColumnParser
from ..contract.vocabulary import OnError, ParserType, StringFormat
from ..functions.text import remove_spaces, split_list
from . import steps

ERROR_SCHEMA = "array<struct<source_column_name:string,target_column_name:string,original_value:string,expected_data_type:string,error_code:string,message:string,resolution:string>>"
AUDIT_SCHEMA = (
    "array<struct<source_column_name:string,target_column_name:string,parser_type:string,expected_data_type:string,original_value:string,parsed_value:string,"
    "changed:boolean,effective:boolean,actions_applied:array<string>,options:map<string,string>,error:string>>"
)


@dataclass(frozen=True)
class Stages:
    """The columns that hold a configured column's value after each step."""

    source: Column
    normal: Column
    value: Column
    candidate: Column
    resolved: Column
    final: Column
    missing: bool
    collect: bool

    @property
    def bad(self) -> Column:
        return steps.is_bad(self.value, self.candidate)


def _gave_way(c: ColumnParser, s: Stages) -> Column:
    """default_on_null took the place of a null."""
    if c.parser.is_nullable:
        return F.lit(False)
    return s.resolved.isNull() | steps.is_zero(s.resolved, c.parser)


def error_entry(c: ColumnParser, s: Stages) -> Column:
    """The error struct of a row whose value did not parse, else null."""
    outcome = {OnError.DEFAULT: "default_on_error", OnError.PRESERVE: "preserve"}.get(c.parser.on_parse_error, "null")
    resolution = F.when(s.final.isNull(), "null").when(_gave_way(c, s), "default_on_null").otherwise(outcome)
    profile = f" with format '{c.parser.string_format.value}'" if c.parser.string_format else ""
    fields = {
        "source_column_name": F.lit(c.source_column_name),
        "target_column_name": F.lit(c.target_column_name),
        "original_value": s.source,
        "expected_data_type": F.lit(c.expected_data_type),
        "error_code": F.lit("PARSE_ERROR"),
        "message": F.lit(f"Value could not be parsed as {c.expected_data_type}{profile}."),
        "resolution": resolution,
    }
    return F.when(s.bad, F.struct(*[v.alias(k) for k, v in fields.items()]))


def _array(entries: list[Column], schema: str) -> Column:
    return (F.array_compact(F.array(*entries)) if entries else F.array()).cast(schema)


def errors(columns: list[tuple[ColumnParser, Stages]]) -> Column:
    """The error structs of a row; rows without a failure, nearly all, build none."""
    if not columns:
        return _array([], ERROR_SCHEMA)
    any_bad = reduce(or_, [s.bad for _, s in columns])
    return F.when(any_bad, _array([error_entry(c, s) for c, s in columns], ERROR_SCHEMA)).otherwise(_array([], ERROR_SCHEMA))


def audits(entries: list[Column]) -> Column:
    return _array(entries, AUDIT_SCHEMA)


def _zip_flags(c: ColumnParser, s: Stages) -> list[tuple[str, Column]]:
    if c.parser.string_format is not StringFormat.ZIP:
        return []
    before, after = split_list(s.normal), F.split(s.candidate, ", ", -1)
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    grew = F.zip_with(before, after, lambda b, a: digits(a) > digits(b))
    plus = F.zip_with(before, after, lambda b, a: F.contains(a, F.lit("-")) & (a != remove_spaces(b)))
    return [(name, F.when(s.candidate.isNotNull(), F.exists(flags, lambda f: F.coalesce(f, F.lit(False))))) for name, flags in (("zip_padded", grew), ("zip_plus4_formatted", plus))]


def _actions(c: ColumnParser, s: Stages) -> Column:
    policy = c.parser.on_parse_error
    of_policy = {OnError.NULL: ("parse_error_to_null",), OnError.DEFAULT: ("parse_error_default_applied",), OnError.PRESERVE: ("parse_error_preserved",)}
    on_bad = of_policy.get(policy, ("parse_error_collected", "parse_error_to_null") if s.collect else ())
    flags = [
        ("source_column_missing", F.lit(s.missing)),
        ("empty_string_to_null", steps.is_empty(s.normal, c.parser)),
        ("null_marker_replaced", steps.is_marker(s.normal, c.parser)),
        *[(name, s.bad) for name in on_bad],
        ("zero_invalidated", steps.is_zero(s.resolved, c.parser)),
        ("default_on_null_applied", _gave_way(c, s)),
        *_zip_flags(c, s),
    ]
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags]))


def _as_text(c: ColumnParser, value: Column) -> Column:
    if c.data_type.parser_type is ParserType.BINARY:
        return F.base64(value)
    if c.data_type.parser_type is ParserType.DATE:
        # The day through a wall clock, which no formatter setting shifts.
        return F.substring(value.cast("timestamp_ntz").cast("string"), 1, 10)
    return value.cast("string")


def _option_text(value: Any) -> str:
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, list) else str(value)


def audit_entry(c: ColumnParser, s: Stages) -> Column:
    options = {"default_on_null": None, "default_on_error": None} | {k: v for k, v in parser_mapping(c.parser).items() if k != "type"}
    actions = _actions(c, s)
    changed = F.size(actions) > 0
    if c.data_type.parser_type is ParserType.STRING:
        changed = changed | ~s.final.eqNullSafe(s.source)
    fields = {
        "source_column_name": F.lit(c.source_column_name),
        "target_column_name": F.lit(c.target_column_name),
        "parser_type": F.lit(c.parser.parser_type.value),
        "expected_data_type": F.lit(c.expected_data_type),
        "original_value": s.source,
        "parsed_value": _as_text(c, s.final),
        "changed": changed,
        "effective": F.lit(not s.missing),
        "actions_applied": actions,
        "options": F.create_map(*[F.lit(x) for k in sorted(options) for x in (k, _option_text(options[k]))]),
        "error": F.lit("Source column is missing.") if s.missing else F.when(s.bad, F.lit(f"Value could not be parsed as {c.expected_data_type}.")),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])
