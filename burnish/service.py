"""The facade: compile, review, describe and parse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import TYPE_CHECKING, Any

from .contract.authoring import YamlParserConfigCompiler
from .contract.describe import describe_config, describe_parser
from .contract.identity import canonical_json, content_hash, to_mapping
from .contract.model import ParserConfig, read_data_type
from .contract.review import ConfigReviewReport, review
from .contract.vocabulary import ParserType, detached_defaults
from .errors import CompilationError
from .sources.contracts import compile_source

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .plans.parse import DataFrameParsing


class _Described:
    def __init__(self, describe):
        self._describe = describe

    def describe(self) -> dict[str, Any]:
        return self._describe()


class ParserService:
    """Also has one attribute for each parser type, such as decimal, with describe()."""

    def __init__(self) -> None:
        self._compiler = YamlParserConfigCompiler()
        self.config = _Described(describe_config)
        for kind in ParserType:
            setattr(self, kind.value, _Described(lambda kind=kind: describe_parser(kind)))

    def compile_text(self, text: str) -> ParserConfig:
        return self._compiler.compile_text(text)

    def compile_path(self, path: str | Path) -> ParserConfig:
        return self._compiler.compile_path(path)

    def compile_mapping(self, mapping: Mapping[str, Any]) -> ParserConfig:
        return self._compiler.compile_mapping(mapping)

    def compile_yaml(self, source: str | Path | Mapping[str, Any]) -> ParserConfig:
        return compile_source(source)

    def to_mapping(self, config: ParserConfig) -> dict[str, Any]:
        return to_mapping(config)

    def canonical_json(self, config: ParserConfig) -> str:
        return canonical_json(config)

    def content_hash(self, config: ParserConfig) -> str:
        return content_hash(config)

    def defaults(self) -> dict[str, dict[str, Any]]:
        return detached_defaults()

    def normalize_data_type(self, value: str) -> str:
        try:
            return read_data_type(value).canonical
        except ValueError as e:
            raise CompilationError(str(e)) from None

    def describe(self, parser_type: str | None = None) -> dict[str, Any]:
        if parser_type is None:
            return {kind.value: describe_parser(kind) for kind in ParserType}
        return describe_parser(ParserType(read_data_type("decimal(1,0)" if parser_type == "decimal" else parser_type).parser_type))

    def review_yaml(self, source: str | Path | Mapping[str, Any]) -> ConfigReviewReport:
        return review(source)

    def parse_dataframe(self, df: DataFrame, config: ParserConfig | str | Path | Mapping[str, Any], *, key_columns: Sequence[str], on_missing_source: str = "fail", column_prefix: str = "burnish", error_mode: str = "configured") -> DataFrameParsing:
        from .plans.parse import parse  # Spark is needed from here on

        compiled = config if isinstance(config, ParserConfig) else compile_source(config)
        return parse(df, compiled, key_columns=key_columns, on_missing_source=on_missing_source, column_prefix=column_prefix, error_mode=error_mode)


parser = ParserService()
