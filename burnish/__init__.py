"""Typed columns from raw string columns, declared in versioned contracts and run as native Spark expressions.

Contracts compile, hash and review without Spark; only parse_dataframe() needs it.
"""

from .contract.authoring import YamlParserConfigCompiler
from .contract.model import ColumnParser, ParserConfig, ParserGlobals, ParserOptions, SparkDataType
from .contract.review import ConfigReviewReport
from .contract.vocabulary import DEFAULTS
from .errors import CompilationError, ContractError, SchemaValidationError, SchemaWarning
from .service import ParserService, parser

__all__ = [
    "DEFAULTS", "ColumnParser", "CompilationError", "ConfigReviewReport", "ContractError", "DataFrameParsing", "ParserConfig", "ParserGlobals",
    "ParserOptions", "ParserService", "SchemaValidationError", "SchemaWarning", "SparkDataType", "YamlParserConfigCompiler", "parser",
]


def __getattr__(name: str):
    if name == "DataFrameParsing":
        from .plans.parse import DataFrameParsing

        return DataFrameParsing
    raise AttributeError(name)
