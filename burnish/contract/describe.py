"""Machine-readable help for authors."""

from __future__ import annotations

from typing import Any

from .authoring import COLUMN_KEYS, GLOBAL_KEYS, TOP_KEYS, parser_keys
from .vocabulary import DEFAULTS, NUMERIC, Encoding, ListMode, OnError, ParserType, StringFormat

_ARGUMENTS = {
    "type": "The parser; it must produce the expected datatype.",
    "collapse_whitespace": "Each run of Unicode white space becomes one space.",
    "trim_whitespace": "White space at both ends goes.",
    "empty_is_null": "An empty value becomes null.",
    "replace_null_markers": "Values equal to a null marker become null.",
    "null_markers": "The column's null markers, compared after white space is normalised.",
    "null_markers_mode": "Whether null_markers replace or extend the global ones.",
    "null_marker_case_sensitive": "Whether case counts in null markers.",
    "is_nullable": "Whether the final value may be null.",
    "default_on_null": "Takes the place of a final null; needed with is_nullable: false.",
    "on_parse_error": "What happens to a value that does not parse.",
    "default_on_error": "Takes the place of a value that does not parse; needed with on_parse_error: default.",
    "audit": "Whether each row gets an audit record of this column.",
    "zero_is_valid": "false turns a parsed zero into null.",
    "format": "A display profile for the text.",
    "formats": "Spark datetime patterns, tried in order.",
    "encoding": "How bytes are written in the text.",
    "true_values": "Tokens that mean true.",
    "false_values": "Tokens that mean false.",
    "boolean_case_sensitive": "Whether case counts in Boolean tokens.",
    "boolean_values_mode": "Whether the column's tokens replace or extend the global ones.",
}
_CHOICES = {
    "null_markers_mode": [m.value for m in ListMode],
    "boolean_values_mode": [m.value for m in ListMode],
    "encoding": [e.value for e in Encoding],
    "format": [None, *[f.value for f in StringFormat]],
}
_BEHAVIOURS = {
    "string": ["Text stays text; a profile may change how it is written."],
    "decimal": ["Digits beyond the scale are rounded half up; what does not fit is a parse error."],
    "float": ["NaN, infinities and text that would vanish to zero are parse errors."],
    "double": ["NaN, infinities and text that would vanish to zero are parse errors."],
    "binary": ["Audit records show bytes as base64."],
    "boolean": ["A token in neither list is a parse error, not false."],
    "date": ["The calendar day stays as written."],
    "timestamp": ["Local text is read in the session time zone; an offset keeps its instant."],
    "timestamp_ntz": ["Wall-clock time; text with an offset is a parse error."],
}
_GOTCHAS = {
    "boolean": ["Quote YAML words such as \"yes\" and \"true\"."],
    "date": ["MM/dd/yyyy alone is not read unless a pattern says so.", "Custom patterns need spark.sql.legacy.timeParserPolicy=CORRECTED."],
    "timestamp": ["Custom patterns need spark.sql.legacy.timeParserPolicy=CORRECTED."],
    "timestamp_ntz": ["Custom patterns need spark.sql.legacy.timeParserPolicy=CORRECTED."],
    "float": ["Use decimal(p,s) for exact amounts."],
    "double": ["Use decimal(p,s) for exact amounts."],
    "string": ["preserve keeps the token as it came, before white space is normalised."],
}


def describe_parser(kind: ParserType) -> dict[str, Any]:
    defaults = dict(DEFAULTS["common"]) | dict(DEFAULTS["numeric"] if kind in NUMERIC else DEFAULTS.get(kind.value, {}))
    arguments = {}
    for key in parser_keys(kind):
        about: dict[str, Any] = {"description": _ARGUMENTS[key], "required": key == "type"}
        if key in defaults:
            about["default"] = list(defaults[key]) if isinstance(defaults[key], tuple) else defaults[key]
        if key == "on_parse_error":
            about["choices"] = [o.value for o in OnError if o is not OnError.PRESERVE or kind is ParserType.STRING]
        elif key in _CHOICES:
            about["choices"] = list(_CHOICES[key])
        arguments[key] = about
    integers = ["A fraction, an exponent or a value out of range is a parse error."]
    return {
        "type": kind.value,
        "expected_data_type": "decimal(p,s)" if kind is ParserType.DECIMAL else kind.value,
        "arguments": arguments,
        "behaviors": list(_BEHAVIOURS.get(kind.value, integers)),
        "gotchas": list(_GOTCHAS.get(kind.value, [])),
    }


def describe_config() -> dict[str, Any]:
    required = {"parser_config_id", "parser_config_name", "version", "columns", *COLUMN_KEYS}
    part = lambda keys: {k: {"required": k in required} for k in keys}
    shared = {k: {"required": False, "default": list(v) if isinstance(v, tuple) else v} for k, v in DEFAULTS["globals"].items() if k in GLOBAL_KEYS}
    return {"top_level": part(TOP_KEYS), "globals": shared, "columns": part(COLUMN_KEYS)}
