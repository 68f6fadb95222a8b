"""The resolved form of a contract, its canonical JSON and its hash."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal
from typing import Any

from .model import ColumnParser, ParserConfig, ParserOptions
from .vocabulary import NUMERIC, TEMPORAL, OnError, ParserType


def _plain(value: Any) -> Any:
    if isinstance(value, Decimal):
        return format(value, "f")
    return list(value) if isinstance(value, tuple) else value


def parser_mapping(p: ParserOptions) -> dict[str, Any]:
    """Every option that bears on this type, resolved; compiling it again gives the same options."""
    out: dict[str, Any] = {
        "type": p.parser_type.value,
        "collapse_whitespace": p.collapse_whitespace,
        "trim_whitespace": p.trim_whitespace,
        "empty_is_null": p.empty_is_null,
        "replace_null_markers": p.replace_null_markers,
        "null_markers": p.null_markers,
        "null_markers_mode": p.null_markers_mode.value,
        "null_marker_case_sensitive": p.null_marker_case_sensitive,
        "is_nullable": p.is_nullable,
        "on_parse_error": p.on_parse_error.value,
        "audit": p.audit,
    }
    if not p.is_nullable:
        out["default_on_null"] = p.default_on_null
    if p.on_parse_error is OnError.DEFAULT:
        out["default_on_error"] = p.default_on_error
    if p.parser_type in NUMERIC:
        out["zero_is_valid"] = p.zero_is_valid
    elif p.parser_type in TEMPORAL:
        out["formats"] = p.formats
    elif p.parser_type is ParserType.STRING:
        out["format"] = p.string_format.value if p.string_format else None
    elif p.parser_type is ParserType.BINARY:
        out["encoding"] = p.binary_encoding.value
    elif p.parser_type is ParserType.BOOLEAN:
        out |= {"true_values": p.true_values, "false_values": p.false_values, "boolean_case_sensitive": p.boolean_case_sensitive, "boolean_values_mode": p.boolean_values_mode.value}
    return {k: _plain(v) for k, v in out.items()}


def _column(c: ColumnParser) -> dict[str, Any]:
    return {"source_column_name": c.source_column_name, "target_column_name": c.target_column_name, "expected_data_type": c.expected_data_type, "parser": parser_mapping(c.parser)}


def to_mapping(config: ParserConfig) -> dict[str, Any]:
    out = {k: getattr(config, k) for k in ("parser_config_id", "parser_config_name", "version", "description", "owner", "owner_department")}
    return out | {"globals": {k: _plain(v) for k, v in vars(config.globals).items()}, "columns": [_column(c) for c in config.columns]}


def canonical_json(config: ParserConfig) -> str:
    return json.dumps(to_mapping(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(config: ParserConfig) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()
