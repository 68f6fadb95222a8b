"""From authored YAML or mappings to compiled contracts.  All independent findings are raised together."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from enum import Enum
from pathlib import Path
from typing import Any

import yaml

from ..errors import CompilationError
from .model import ColumnParser, ParserConfig, ParserGlobals, ParserOptions, SparkDataType, read_data_type
from .typed_defaults import typed_default
from .vocabulary import DEFAULTS, NUMERIC, TEMPORAL, Encoding, ListMode, OnError, ParserType, StringFormat

MOST_NESTING = 256
TOP_KEYS = ("parser_config_id", "parser_config_name", "version", "columns", "globals", "description", "owner", "owner_department")
GLOBAL_KEYS = tuple(DEFAULTS["globals"])
COLUMN_KEYS = ("source_column_name", "target_column_name", "expected_data_type", "parser")
COMMON_KEYS = ("type", *DEFAULTS["common"], "default_on_null", "default_on_error")
_BAD = object()
_ABSENT = object()


def parser_keys(kind: ParserType) -> tuple[str, ...]:
    """The keys that a parser mapping of this type may have."""
    own: tuple[str, ...] = ()
    if kind in NUMERIC:
        own = ("zero_is_valid",)
    elif kind in TEMPORAL:
        own = ("formats",)
    elif kind.value in ("string", "binary", "boolean"):
        own = tuple(DEFAULTS[kind.value])
    return COMMON_KEYS + own


class _StrictLoader(yaml.SafeLoader):
    """Safe YAML without duplicate keys, merge keys, implicit timestamps or deep nesting."""

    depth = 0

    def compose_node(self, parent, index):
        self.depth += 1
        if self.depth > MOST_NESTING:
            raise CompilationError(f"YAML is nested deeper than {MOST_NESTING} levels.")
        try:
            return super().compose_node(parent, index)
        finally:
            self.depth -= 1

    def construct_mapping(self, node, deep=False):
        seen: set[Any] = set()
        for key_node, _ in node.value:
            at = f"line {key_node.start_mark.line + 1}, column {key_node.start_mark.column + 1}"
            if key_node.tag == "tag:yaml.org,2002:merge":
                raise CompilationError(f"YAML merge keys are not supported ({at}).")
            key = self.construct_object(key_node, deep=True)
            try:
                again = key in seen
            except TypeError:
                raise CompilationError(f"YAML mapping keys must be plain values ({at}).") from None
            if again:
                raise CompilationError(f"Duplicate YAML key {key!r} ({at}).")
            seen.add(key)
        return super().construct_mapping(node, deep=True)


_StrictLoader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in found if tag != "tag:yaml.org,2002:timestamp"] for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_StrictLoader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: loader.construct_mapping(node, deep=True))


def well_formed(text: str) -> bool:
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


class _Reader:
    """Reads the values of one mapping; what is wrong goes to the findings under the mapping's path."""

    def __init__(self, values: Mapping[str, Any], path: str, findings: list[tuple[str, str]]):
        self.values, self.path, self.findings = values, path, findings

    def add(self, key: str, text: str) -> Any:
        self.findings.append((f"{self.path}.{key}".strip("."), text))
        return _BAD

    def unknown(self, allowed: tuple[str, ...], what: str) -> None:
        for key in self.values:
            if key not in allowed:
                self.add(str(key), f"Unknown {what} key {key!r}.")

    def get(self, key: str, default: Any, read: Callable[[Any], Any]) -> Any:
        """The value as read, the default where the key is absent, or _BAD."""
        value = self.values.get(key, _ABSENT)
        if value is _ABSENT:
            return self.add(key, f"{key} is required.") if default is _ABSENT else default
        try:
            return read(value)
        except ValueError as e:
            return self.add(key, f"{key} {e}.")

    def text(self, key: str, default: Any = _ABSENT, *, trim: bool = True) -> Any:
        def read(value: Any) -> str | None:
            if value is None and default is None:
                return None
            if not isinstance(value, str):
                raise ValueError("must be a string")
            if not value.strip():
                raise ValueError("must not be blank")
            if not well_formed(value):
                raise ValueError("must be well-formed Unicode")
            return value.strip() if trim else value

        return self.get(key, default, read)

    def boolean(self, key: str, default: bool) -> Any:
        def read(value: Any) -> bool:
            if not isinstance(value, bool):
                raise ValueError("must be true or false")
            return value

        return self.get(key, default, read)

    def texts(self, key: str, default: Any, *, some: bool = False) -> Any:
        def read(value: Any) -> tuple[str, ...]:
            if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                raise ValueError("must be a list of strings")
            if not all(map(well_formed, value)):
                raise ValueError("must be well-formed Unicode")
            if some and not value:
                raise ValueError("must not be empty")
            return tuple(dict.fromkeys(value))

        return self.get(key, default, read)

    def choice(self, key: str, kind: type[Enum], default: Any) -> Any:
        def read(value: Any) -> Enum:
            try:
                return kind(value.strip().lower())
            except (ValueError, AttributeError):
                raise ValueError(f"must be one of {', '.join(x.value for x in kind)}") from None

        return self.get(key, default, read)


def _bad(*values: Any) -> bool:
    return any(v is _BAD for v in values)


def _overlap(true: tuple[str, ...], false: tuple[str, ...], case_sensitive: bool) -> list[str]:
    """Tokens in both lists.  Beyond ASCII, case is for Spark to compare when a DataFrame is bound."""
    fold = (lambda x: x) if case_sensitive else (lambda x: x.lower() if x.isascii() else x)
    other = {fold(x) for x in false}
    return [x for x in true if fold(x) in other]


class YamlParserConfigCompiler:
    """Compiles text, files and mappings."""

    def compile_path(self, path: str | Path) -> ParserConfig:
        try:
            text = Path(path).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError) as e:
            raise CompilationError(f"Contract file {str(path)!r} cannot be read: {e}") from e
        return self.compile_text(text)

    def compile_text(self, text: str) -> ParserConfig:
        if not well_formed(text):
            raise CompilationError("YAML text must be well-formed Unicode.")
        try:
            loaded = yaml.load(text, Loader=_StrictLoader)  # noqa: S506 - a safe loader
        except yaml.YAMLError as e:
            raise CompilationError(f"Invalid YAML: {e}") from e
        except RecursionError:
            raise CompilationError(f"YAML is nested deeper than {MOST_NESTING} levels.") from None
        return self.compile_mapping(loaded)

    def compile_mapping(self, mapping: Any) -> ParserConfig:
        if not isinstance(mapping, Mapping):
            raise CompilationError("A contract must be a mapping.")
        findings: list[tuple[str, str]] = []
        top = _Reader(mapping, "", findings)
        top.unknown(TOP_KEYS, "top-level")
        identity = [top.text(k) for k in ("parser_config_id", "parser_config_name", "version")]
        notes = {k: top.text(k, None) for k in ("description", "owner", "owner_department")}
        shared = self._globals(mapping.get("globals", {}), findings)
        columns = self._columns(mapping.get("columns", _ABSENT), shared, findings)
        if findings:
            raise CompilationError([text for _, text in findings] if len(findings) == 1 else [f"{path}: {text}" for path, text in findings])
        return ParserConfig(*identity, columns=tuple(columns), globals=shared, **notes)

    def _globals(self, authored: Any, findings: list[tuple[str, str]]) -> ParserGlobals | Any:
        base = DEFAULTS["globals"]
        if authored is None:
            authored = {}
        if not isinstance(authored, Mapping):
            findings.append(("globals", "globals must be a mapping."))
            return _BAD
        r = _Reader(authored, "globals", findings)
        r.unknown(GLOBAL_KEYS, "global")
        markers = r.texts("null_markers", base["null_markers"])
        true, false = (r.texts(k, base[k], some=True) for k in ("true_values", "false_values"))
        flags = {k: r.boolean(k, base[k]) for k in ("null_marker_case_sensitive", "boolean_case_sensitive")}
        if _bad(markers, true, false, *flags.values()):
            return _BAD
        if both := _overlap(true, false, flags["boolean_case_sensitive"]):
            r.add("true_values", f"Boolean tokens are both true and false: {', '.join(map(repr, both))}.")
            return _BAD
        return ParserGlobals(markers, flags["null_marker_case_sensitive"], true, false, flags["boolean_case_sensitive"])

    def _columns(self, authored: Any, shared: Any, findings: list[tuple[str, str]]) -> list[ColumnParser]:
        if authored is _ABSENT:
            findings.append(("columns", "columns is required."))
            return []
        if not isinstance(authored, (list, tuple)) or not authored:
            findings.append(("columns", "columns must be a non-empty list."))
            return []
        out, targets = [], {}
        for i, item in enumerate(authored):
            path = f"columns[{i}]"
            if not isinstance(item, Mapping):
                findings.append((path, "A column must be a mapping."))
                continue
            r = _Reader(item, path, findings)
            r.unknown(COLUMN_KEYS, "column")
            source, target = r.text("source_column_name", trim=False), r.text("target_column_name", trim=False)
            if not _bad(target):
                if target in targets:
                    r.add("target_column_name", f"Duplicate target column {target!r}.")
                targets[target] = i

            kind = r.get("expected_data_type", _ABSENT, _type_or_error)
            options = self._parser(item.get("parser", _ABSENT), kind, shared, path, findings)
            if not _bad(source, target, kind, options):
                out.append(ColumnParser(source, target, kind.canonical, kind, options))
        return out

    def _parser(self, authored: Any, kind: Any, shared: Any, path: str, findings: list[tuple[str, str]]) -> ParserOptions | Any:
        outer = _Reader({} if authored is _ABSENT else {"parser": authored}, path, findings)
        if authored is _ABSENT:
            return outer.add("parser", "parser is required.")
        if isinstance(authored, str):
            authored = {"type": authored}
        if not isinstance(authored, Mapping):
            return outer.add("parser", "parser must be a name or a mapping.")
        r = _Reader(authored, f"{path}.parser", findings)
        before = len(findings)
        parser_type = r.choice("type", ParserType, _ABSENT)
        if _bad(parser_type):
            return _BAD
        r.unknown(parser_keys(parser_type), f"{parser_type.value} parser")
        if not _bad(kind) and kind.parser_type is not parser_type:
            r.add("type", f"Parser {parser_type.value} does not produce {kind.canonical}.")
            kind = _BAD
        common = DEFAULTS["common"]
        given = {k: r.boolean(k, common[k]) for k in ("collapse_whitespace", "trim_whitespace", "empty_is_null", "replace_null_markers", "is_nullable", "audit")}
        given["on_parse_error"] = r.choice("on_parse_error", OnError, OnError.FAIL) if authored.get("on_parse_error", "") is not None else OnError.NULL
        if given["on_parse_error"] is OnError.PRESERVE and parser_type is not ParserType.STRING:
            r.add("on_parse_error", "on_parse_error preserve is for string targets only.")
        given |= self._markers(r, authored, shared, given["replace_null_markers"])
        given |= self._own(r, authored, parser_type, shared)
        encoding = given.get("binary_encoding", Encoding.BASE64)
        given |= self._defaults(r, authored, kind, given, Encoding.BASE64 if _bad(encoding) else encoding, _bad(encoding))
        return _BAD if len(findings) > before or _bad(kind, shared, *given.values()) else ParserOptions(parser_type=parser_type, **given)

    def _markers(self, r: _Reader, authored: Mapping, shared: Any, replaced: Any) -> dict[str, Any]:
        mode = r.choice("null_markers_mode", ListMode, ListMode.REPLACE)
        own = r.texts("null_markers", None)
        if "null_markers_mode" in authored and "null_markers" not in authored:
            r.add("null_markers_mode", "null_markers_mode needs null_markers.")
        inherited = DEFAULTS["globals"] if _bad(shared) else vars(shared)
        case = r.boolean("null_marker_case_sensitive", inherited["null_marker_case_sensitive"])
        if _bad(mode, own):
            markers = _BAD
        else:
            markers = inherited["null_markers"] if own is None else own if mode is ListMode.REPLACE else tuple(dict.fromkeys((*inherited["null_markers"], *own)))
            if replaced is True and not markers and not _bad(shared):
                r.add("replace_null_markers", "replace_null_markers needs null_markers, here or in globals.")
        return {"null_markers": markers, "null_marker_case_sensitive": case, "null_markers_mode": ListMode.REPLACE}

    def _own(self, r: _Reader, authored: Mapping, kind: ParserType, shared: Any) -> dict[str, Any]:
        if kind in NUMERIC:
            return {"zero_is_valid": r.boolean("zero_is_valid", True)}
        if kind in TEMPORAL:
            formats = r.texts("formats", DEFAULTS[kind.value]["formats"], some=True)
            for f in () if _bad(formats) else formats:
                if not f.strip():
                    r.add("formats", "formats must not hold blank patterns.")
                elif kind is ParserType.TIMESTAMP_NTZ and (zone := set(re.sub(r"'[^']*'", "", f)) & set("VvzOXxZ")):
                    r.add("formats", f"Pattern {f!r} reads a zone ({', '.join(sorted(zone))}), which timestamp_ntz cannot keep.")
            return {"formats": formats}
        if kind is ParserType.BINARY:
            return {"binary_encoding": r.choice("encoding", Encoding, Encoding.BASE64)}
        if kind is ParserType.STRING:
            named = authored.get("format")
            if named is None or (isinstance(named, str) and named.strip().lower() in ("none", "null")):
                return {"string_format": None}
            return {"string_format": r.choice("format", StringFormat, None)}
        if kind is ParserType.BOOLEAN:
            mode = r.choice("boolean_values_mode", ListMode, ListMode.REPLACE)
            inherited = DEFAULTS["globals"] if _bad(shared) else vars(shared)
            case = r.boolean("boolean_case_sensitive", inherited["boolean_case_sensitive"])
            lists = {}
            for key in ("true_values", "false_values"):
                own = r.texts(key, None, some=True)
                lists[key] = own if _bad(own) else inherited[key] if own is None else own if mode is not ListMode.EXTEND else tuple(dict.fromkeys((*inherited[key], *own)))
            if "boolean_values_mode" in authored and not {"true_values", "false_values"} & set(authored):
                r.add("boolean_values_mode", "boolean_values_mode needs true_values or false_values.")
            if not _bad(case, shared, *lists.values()) and (both := _overlap(lists["true_values"], lists["false_values"], case)):
                r.add("true_values", f"Boolean tokens are both true and false: {', '.join(map(repr, both))}.")
            return lists | {"boolean_case_sensitive": case, "boolean_values_mode": ListMode.REPLACE}
        return {}

    def _defaults(self, r: _Reader, authored: Mapping, kind: Any, given: dict[str, Any], encoding: Encoding, unread: bool) -> dict[str, Any]:
        out = {}
        wanted = {"default_on_null": given["is_nullable"] is False, "default_on_error": given["on_parse_error"] is OnError.DEFAULT}
        unsure = {"default_on_null": _bad(given["is_nullable"]), "default_on_error": _bad(given["on_parse_error"])}
        says = {"default_on_null": "is_nullable: false", "default_on_error": "on_parse_error: default"}
        for key, needed in wanted.items():
            out[key] = None
            if unsure[key]:
                continue
            if key not in authored:
                if needed:
                    r.add(key, f"{says[key]} needs {key}.")
            elif not needed:
                r.add(key, f"{key} needs {says[key]}.")
            elif not _bad(kind) and not unread:
                out[key] = r.get(key, None, lambda v: typed_default(v, kind, encoding))
                if given.get("zero_is_valid") is False and not _bad(out[key]) and out[key] == 0:
                    r.add(key, f"{key} is zero, which zero_is_valid: false forbids.")
        return out


def _type_or_error(value: Any) -> SparkDataType:
    try:
        return read_data_type(value)
    except ValueError as e:
        raise ValueError(f"is not usable: {str(e).rstrip('.')}") from None
