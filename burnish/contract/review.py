"""Review reports: what a contract does, before it meets any data.  Authoring errors are reported, not raised."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..errors import CompilationError
from ..sources.contracts import compile_source
from .describe import describe_parser
from .identity import canonical_json, content_hash, to_mapping
from .model import ParserConfig
from .vocabulary import ENGINE_VERSION, OnError, ParserType

#: The plan uses functions that older versions lack.
MINIMUM_SPARK = "4.0"

# Control and bidirectional characters could make a report read as something else.
_UNSAFE = re.compile("[\x00-\x1f\x7f-\x9f؜‎‏  ‪-‮⁦-⁩﻿]")


def _visible(text: Any) -> str:
    return _UNSAFE.sub(lambda m: f"\\u{ord(m[0]):04x}", str(text))


def _cell(text: Any) -> str:
    return re.sub(r"([\\`*_{}\[\]<>()#+!|~&-])", r"\\\1", _visible(text))


@dataclass
class ConfigReviewReport:
    is_valid: bool
    source: str | None = None
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    summary: dict[str, Any] = field(default_factory=dict)
    checks: list[dict[str, str]] = field(default_factory=list)
    columns: list[dict[str, Any]] = field(default_factory=list)
    resolved_config: dict[str, Any] | None = None
    content_hash: str | None = None

    def to_mapping(self) -> dict[str, Any]:
        return {"report_type": "burnish_contract_review", "engine_version": ENGINE_VERSION} | json.loads(json.dumps(asdict(self), ensure_ascii=False))

    def to_json(self, *, indent: int = 2) -> str:
        """ASCII only, so that no character of a contract can make the report read as something else."""
        return json.dumps(self.to_mapping(), indent=indent, ensure_ascii=True)

    def to_markdown(self) -> str:
        out = ["# Contract review", "", f"Status: **{'valid' if self.is_valid else 'invalid'}**", ""]
        if self.source:
            out += [f"Source: {_cell(self.source)}", ""]
        for title, items in (("Errors", self.errors), ("Warnings", self.warnings)):
            if items:
                out += [f"## {title}", "", *[f"- {_cell(x)}" for x in items], ""]
        if self.summary:
            out += ["## Summary", "", "| Field | Value |", "| --- | --- |", *[f"| {_cell(k)} | {_cell(v)} |" for k, v in self.summary.items()], ""]
        if self.checks:
            out += ["## Checks", "", "| Check | Status | Evidence |", "| --- | --- | --- |", *[f"| {_cell(c['check'])} | {c['status']} | {_cell(c['evidence'])} |" for c in self.checks], ""]
        if self.columns:
            shown = {"Source": "source", "Target": "target", "Type": "type", "Parser": "parser", "Format": "format", "On error": "on_parse_error", "Nullable": "is_nullable", "Audit": "audit"}
            out += ["## Columns", "", f"| {' | '.join(shown)} |", "| --- " * len(shown) + "|"]
            out += ["| " + " | ".join(_cell("" if c[k] is None else c[k]) for k in shown.values()) + " |" for c in self.columns] + [""]
            for c in self.columns:
                if notes := [*c["behaviors"], *c["gotchas"]]:
                    out += [f"### {_cell(c['target'])}", "", *[f"- {_cell(n)}" for n in notes], ""]
        if self.resolved_config is not None:
            text = yaml.safe_dump(self.resolved_config, sort_keys=False, allow_unicode=False)
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
            out += ["## Resolved contract", "", f"{fence}yaml", text.rstrip("\n"), fence, ""]
        return "\n".join(out).rstrip("\n")

    def write_json(self, path: str | Path, *, indent: int = 2) -> Path:
        Path(path).write_text(self.to_json(indent=indent) + "\n", encoding="utf-8")
        return Path(path)

    def write_markdown(self, path: str | Path) -> Path:
        Path(path).write_text(self.to_markdown() + "\n", encoding="utf-8")
        return Path(path)


def _warnings(config: ParserConfig) -> list[str]:
    out = [f"{k} is not given." for k in ("description", "owner", "owner_department") if getattr(config, k) is None]
    if not any(c.parser.audit for c in config.columns):
        out.append("No column is audited.")
    if config.globals.null_markers and not any(c.parser.replace_null_markers for c in config.columns):
        out.append("Global null markers have no effect: no column replaces them.")
    return out


def _checks(config: ParserConfig) -> list[dict[str, str]]:
    booleans = any(c.parser.parser_type is ParserType.BOOLEAN for c in config.columns)
    beyond = any(not t.isascii() for c in config.columns for t in (*c.parser.true_values, *c.parser.false_values))
    again = content_hash(compile_source(to_mapping(config))) == content_hash(config)
    rows = [
        ("structure", "PASS", f"{len(config.columns)} columns compiled without findings"),
        ("targets", "PASS", "target names are distinct as written"),
        ("parsers and types", "PASS", "each parser makes its column's type: " + ", ".join(sorted({f"{c.parser.parser_type.value} to {c.expected_data_type}" for c in config.columns}))),
        ("defaults and options", "PASS", f"{sum(not c.parser.is_nullable for c in config.columns)} columns have a default for null, {sum(c.parser.on_parse_error is OnError.DEFAULT for c in config.columns)} one for values that do not parse"),
        ("Boolean vocabularies", "DEFERRED" if booleans and beyond else "PASS" if booleans else "N/A", "tokens beyond ASCII are compared by Spark at binding" if beyond else "true and false tokens are disjoint" if booleans else "no Boolean columns"),
        ("round trip", "PASS" if again else "FAIL", "the resolved contract compiles to the same hash"),
        ("source schema", "DEFERRED", "checked when a DataFrame is bound"),
    ]
    return [dict(zip(("check", "status", "evidence"), r, strict=True)) for r in rows]


def _label(source: Any) -> str | None:
    if isinstance(source, Path):
        return str(source)
    return "text" if isinstance(source, str) else "mapping" if isinstance(source, Mapping) else "compiled contract" if isinstance(source, ParserConfig) else None


def review(source: Any) -> ConfigReviewReport:
    try:
        config = source if isinstance(source, ParserConfig) else compile_source(source)
    except (CompilationError, TypeError, ValueError, OSError) as e:
        return ConfigReviewReport(False, _label(source), errors=e.errors if isinstance(e, CompilationError) else (str(e),))
    resolved = to_mapping(config)
    columns = []
    for c, r in zip(config.columns, resolved["columns"], strict=True):
        about = describe_parser(c.parser.parser_type)
        options = {"default_on_null": None, "default_on_error": None} | r["parser"]
        columns.append({
            "source": c.source_column_name, "target": c.target_column_name, "type": c.expected_data_type, "parser": c.parser.parser_type.value,
            "on_parse_error": c.parser.on_parse_error.value, "is_nullable": c.parser.is_nullable, "audit": c.parser.audit,
            "format": options.get("format") or ", ".join(options.get("formats") or ()) or None, "options": options,
            "behaviors": about["behaviors"], "gotchas": about["gotchas"],
        })
    times = Counter(c["source"] for c in columns)
    summary = {k: resolved[k] for k in ("parser_config_id", "parser_config_name", "version", "description", "owner", "owner_department")}
    summary |= {"columns": len(columns), "audited_columns": sum(c["audit"] for c in columns), "repeated_sources": sorted(n for n, k in times.items() if k > 1)}
    summary |= {"minimum_spark_version": MINIMUM_SPARK, "content_hash": content_hash(config), "canonical_bytes": len(canonical_json(config).encode())}
    return ConfigReviewReport(True, _label(source), (), tuple(_warnings(config)), summary, _checks(config), columns, resolved, content_hash(config))
