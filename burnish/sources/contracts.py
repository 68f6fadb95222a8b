"""Contracts from text, files and mappings; a string is always YAML text, never a path."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from ..contract.authoring import YamlParserConfigCompiler
from ..contract.model import ParserConfig
from ..errors import CompilationError


def compile_source(source: Any) -> ParserConfig:
    compiler = YamlParserConfigCompiler()
    if isinstance(source, Mapping):
        return compiler.compile_mapping(source)
    if isinstance(source, Path):
        return compiler.compile_path(source)
    if isinstance(source, str):
        return compiler.compile_text(source)
    raise CompilationError(f"A contract is YAML text, a path or a mapping, not {type(source).__name__}.")
