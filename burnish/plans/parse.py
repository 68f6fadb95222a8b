"""The plan: a fixed number of wide projections, whatever the number of columns, and no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract.identity import content_hash
from ..contract.model import ParserConfig
from ..contract.vocabulary import ENGINE_VERSION
from ..errors import SchemaValidationError
from ..functions.scalars import checked_floating, needs_check, parse_scalar
from ..operators import evidence, steps
from .binding import EXHAUSTED, Key, bind, quoted

class DataFrameParsing:
    """The outcome of a binding.  Nothing has run; parsed_df and results_df are projections of one plan."""

    def __init__(self, plan: DataFrame, targets: list[tuple[str, str]], results: list[tuple[str, str]], key_columns: tuple[str, ...], extras: list[tuple[str, str]], warnings: tuple[str, ...], error_mode: str):
        self._plan, self._targets, self._results, self._extras = plan, targets, results, extras
        self.key_columns, self.warnings, self.error_mode = key_columns, warnings, error_mode

    @property
    def result_columns(self) -> tuple[str, ...]:
        return tuple(name for _, name in self._results)

    def _named(self, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        return self._plan.select(*[F.col(held).alias(name) for held, name in pairs])

    @property
    def parsed_df(self) -> DataFrame:
        """The targets in contract order, with the errors of each row in collect mode."""
        return self._named([*self._targets, *self._extras])

    @property
    def results_df(self) -> DataFrame:
        """The row keys, audit records and lineage."""
        return self._named(self._results)

    def persist(self, storageLevel: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrameParsing:  # noqa: N803 - Spark's name
        self._plan.persist(storageLevel)
        return self

    def unpersist(self, blocking: bool = False) -> DataFrameParsing:
        self._plan.unpersist(blocking)
        return self


def parse(df: DataFrame, config: ParserConfig, *, key_columns: Sequence[str], on_missing_source: str = "fail", column_prefix: str = "burnish", error_mode: str = "configured") -> DataFrameParsing:
    collect = error_mode == "collect"
    name = {k: f"{column_prefix}_{k}" for k in ("parse_results", "config", "engine_version", "parse_errors", "error_mode")}
    wanted = list(name) if collect else ["parse_results", "config", "engine_version"]
    bound = bind(
        df, config, key_columns=key_columns, on_missing_source=on_missing_source, column_prefix=column_prefix, error_mode=error_mode,
        result_columns=[name[k] for k in wanted], parsed_extras=[name["parse_errors"]] if collect else [],
    )
    try:
        return _plan(df, config, bound.keys, bound.missing, bound.warnings, name, wanted, collect)
    except Exception as e:
        if isinstance(e, RecursionError) or EXHAUSTED.search(str(e)):
            raise SchemaValidationError(f"The contract's {len(config.columns)} columns exceed the analyser's limits; raise spark.sql.analyzer.maxIterations or the driver's stack size, or split the contract.") from e
        raise


def _owners(config: ParserConfig, *options: str) -> list[int]:
    """For each column the first with the same source and options, whose normalised text it shares."""
    first: dict[tuple, int] = {}
    return [first.setdefault((c.source_column_name, *[getattr(c.parser, o) for o in options]), i) for i, c in enumerate(config.columns)]


def _plan(df: DataFrame, config: ParserConfig, keys: Sequence[Key], missing: frozenset[str], warnings: tuple[str, ...], name: dict[str, str], wanted: list[str], collect: bool) -> DataFrameParsing:
    tag = uuid.uuid4().hex
    held = lambda step, i: f"_{step}_{i}_{tag}"
    columns = list(enumerate(config.columns))
    source = {i: F.lit(None).cast("string") if c.source_column_name in missing else F.col(quoted(c.source_column_name)) for i, c in columns}
    owners = {"n": _owners(config, "collapse_whitespace", "trim_whitespace")}
    owners["v"] = _owners(config, "collapse_whitespace", "trim_whitespace", "empty_is_null", "replace_null_markers", "null_markers", "null_marker_case_sensitive")
    owner = lambda step, i: owners[step][i] if step in owners else i
    at = lambda step, i: F.col(held(step, owner(step, i)))

    def stage(step: str, make) -> dict[str, Column]:
        return {held(step, i): make(i, c) for i, c in columns if owner(step, i) == i}

    out = df.withColumns(stage("n", lambda i, c: steps.normalised(source[i], c.parser)))
    out = out.withColumns(stage("v", lambda i, c: steps.present(at("n", i), c.parser)))
    out = out.withColumns(stage("c", lambda i, c: parse_scalar(at("v", i), c.data_type, c.parser)))
    if checked := {held("c", i): checked_floating(at("v", i), at("c", i)) for i, c in columns if needs_check(c.data_type)}:
        out = out.withColumns(checked)
    out = out.withColumns(stage("r", lambda i, c: steps.resolved(at("v", i), at("c", i), source[i], c, collect)))
    out = out.withColumns(stage("f", lambda i, c: steps.final(at("r", i), c)))

    def seen(i: int) -> evidence.Stages:
        return evidence.Stages(source[i], at("n", i), at("v", i), at("c", i), at("r", i), at("f", i), config.columns[i].source_column_name in missing, collect)

    made = {
        "parse_results": evidence.audits([evidence.audit_entry(c, seen(i)) for i, c in columns if c.parser.audit]),
        "config": F.struct(F.lit(config.parser_config_id).alias("id"), F.lit(config.version).alias("version"), F.lit(content_hash(config)).alias("content_hash")),
        "engine_version": F.lit(ENGINE_VERSION),
        "parse_errors": evidence.errors([(c, seen(i)) for i, c in columns]) if collect else None,
        "error_mode": F.lit("collect"),
    }
    key_columns = {held("k", i): at("f", k.target) if k.target is not None else F.col(quoted(k.column)) for i, k in enumerate(keys)}
    targets = [(held("f", i), c.target_column_name) for i, c in columns]
    meta = [(held("m", k), name[k]) for k in wanted]
    out = out.select(*[h for h, _ in targets], *[v.alias(h) for h, v in key_columns.items()], *[made[k].alias(held("m", k)) for k in wanted])
    results = [*zip(key_columns, [k.output for k in keys], strict=True), *meta]
    extras = [(held("m", "parse_errors"), name["parse_errors"])] if collect else []
    return DataFrameParsing(out, targets, results, tuple(k.output for k in keys), extras, warnings, "collect" if collect else "configured")
