"""Checks of a DataFrame against a contract.

Names are put to Spark's own resolver, tokens and patterns to its optimizer, which folds literals; no job runs.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ..contract.authoring import well_formed
from ..contract.model import ParserConfig
from ..contract.vocabulary import ParserType
from ..errors import SchemaValidationError, SchemaWarning
from ..functions.scalars import BUILT_IN


@dataclass(frozen=True)
class Key:
    """A row key: the input column, the name it has in the results, and the target that stands for it if any."""

    column: str
    output: str
    target: int | None


@dataclass(frozen=True)
class Binding:
    keys: tuple[Key, ...]
    missing: frozenset[str]
    warnings: tuple[str, ...]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _listed(names: Iterable[str]) -> str:
    return ", ".join(map(repr, names))


def _analysed(df: DataFrame, names: Sequence[str]) -> list[StructField] | None:
    """The fields that the active resolver finds for the names in a projection; None if some name has none or several."""
    try:
        return df.select(*[F.col(quoted(n)) for n in names]).schema.fields
    except AnalysisException:
        return None


class Names:
    """Column names, as the active resolver sees them.  It is asked by analysing projections, which starts no job."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, spark: SparkSession, names: Iterable[str]) -> Names:
        return cls(spark.range(0).select(*[F.lit(None).alias(n) for n in names]))

    def find(self, names: Sequence[str]) -> tuple[dict[str, StructField], list[str], list[str]]:
        """The field of each name that stands for one, the names that stand for several, and those for none."""
        names = list(dict.fromkeys(names))
        found = _analysed(self.df, names)
        if found is not None:
            return dict(zip(names, found, strict=True)), [], []
        one, many, none = {}, [], []
        for n in names:
            try:
                one[n] = self.df.select(F.col(quoted(n))).schema.fields[0]
            except AnalysisException as e:
                (many if e.getCondition() == "AMBIGUOUS_REFERENCE" else none).append(n)
        return one, many, none

    def among(self, names: Sequence[str]) -> list[str]:
        """Those of the names that stand for a column here, or for several."""
        held = self.df.columns
        # drop() passes over names that are not there, and takes any that a projection would: mostly this is all to ask.
        if not names or not held or len(self.df.drop(*names).columns) == len(held):
            return []
        one, many, _ = self.find(names)
        return [n for n in names if n in one or n in many]


def _alike(spark: SparkSession, names: Sequence[str]) -> list[list[str]]:
    """Groups of names that the resolver can't tell apart."""
    distinct = list(dict.fromkeys(names))
    _, many, _ = Names.of(spark, distinct).find(distinct) if distinct else ({}, [], [])
    groups, seen = [], set()
    for n in distinct:
        if n in seen:
            continue
        alike = [m for m in many if Names.of(spark, [m]).among([n])] if n in many else [n]
        group = [m for m in names if m in alike]
        seen.update(group)
        if len(group) > 1:
            groups.append(group)
    return groups


# ---- what Spark's functions make of literals ----

#: A pattern that no policy accepts.
_REFUSED = "yyyy-QQQQQQ-bad"


def _neutral(spark: SparkSession) -> SparkSession:
    """A fresh session that folds literals whatever the caller's says; the caller's own where there is none to have."""
    try:
        fresh = spark.newSession()
        fresh.conf.set("spark.sql.optimizer.excludedRules", "")
        fresh.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
        fresh.conf.set("spark.sql.ansi.enabled", "true")
    except Exception:  # noqa: BLE001 - a client without sessions of its own, or one that may not set these
        return spark
    return fresh


def _refusal(spark: SparkSession, pattern: Column) -> str | None:
    """Why a datetime pattern made of literals is refused, found as the optimizer folds it: no job runs."""
    try:
        spark.range(0).select(F.try_to_timestamp(F.lit(""), pattern).alias("t")).inputFiles()
    except Exception as e:  # noqa: BLE001 - the optimizer raises several kinds
        return str(e).splitlines()[0]
    return None


def _boolean_findings(probe: SparkSession, config: ParserConfig) -> list[str]:
    """Boolean tokens that Spark's lower() makes equal, beyond ASCII.  Equal ones turn a fine pattern into one that is refused."""
    out = []
    for c in config.columns:
        p = c.parser
        if p.parser_type is not ParserType.BOOLEAN or p.boolean_case_sensitive or all(t.isascii() for t in (*p.true_values, *p.false_values)):
            continue
        low = lambda tokens: F.array(*[F.lower(F.lit(t)) for t in tokens])

        def meet(tokens: Sequence[str], others: Sequence[str] = p.false_values, low=low) -> bool:
            return _refusal(probe, F.when(F.arrays_overlap(low(tokens), low(others)), F.lit(_REFUSED)).otherwise(F.lit("yyyy"))) is not None

        if meet(p.true_values):
            out.append(f"Target {c.target_column_name!r} has Boolean tokens that Spark lowers alike: {_listed(t for t in p.true_values if meet([t]))}.")
    return out


def _pattern_findings(spark: SparkSession, probe: SparkSession, config: ParserConfig) -> list[str]:
    custom = [(c, f) for c in config.columns for f in c.parser.formats if f not in BUILT_IN]
    if not custom:
        return []
    try:
        policy = spark.conf.get("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    except Exception as e:  # noqa: BLE001 - a client that may not read it
        return [f"Custom datetime patterns need spark.sql.legacy.timeParserPolicy=CORRECTED, which can't be read: {str(e).splitlines()[0]}"]
    if str(policy).upper() != "CORRECTED":
        return [f"Custom datetime patterns need spark.sql.legacy.timeParserPolicy=CORRECTED, not {policy}."]
    why = {f: _refusal(probe, F.lit(f)) for f in dict.fromkeys(f for _, f in custom)}
    return [f"Target {c.target_column_name!r} has an invalid datetime pattern {f!r}: {why[f]}" for c, f in custom if why[f] is not None]


def _literal_findings(spark: SparkSession, config: ParserConfig) -> list[str]:
    beyond = any(not t.isascii() for c in config.columns for t in (*c.parser.true_values, *c.parser.false_values))
    if not beyond and all(f in BUILT_IN for c in config.columns for f in c.parser.formats):
        return []
    # A session that lets the refused pattern pass folds nothing, and so proves nothing.
    probe = next((s for s in (_neutral(spark), spark) if _refusal(s, F.lit(_REFUSED)) is not None), None)
    if probe is None:
        return ["Boolean tokens beyond ASCII and custom datetime patterns can't be checked: the session folds no literals."]
    return [*_boolean_findings(probe, config), *_pattern_findings(spark, probe, config)]


def _check_arguments(config: object, on_missing_source: str, column_prefix: object, error_mode: str) -> None:
    if not isinstance(config, ParserConfig):
        raise TypeError("config must be a compiled contract.")
    if error_mode not in ("configured", "collect"):
        raise ValueError("error_mode must be 'configured' or 'collect'.")
    if on_missing_source not in ("fail", "warn"):
        raise ValueError("on_missing_source must be 'fail' or 'warn'.")
    if not isinstance(column_prefix, str) or not column_prefix.strip() or not well_formed(column_prefix):
        raise ValueError("column_prefix must be a non-blank, well-formed string.")


def _read_keys(given: object) -> tuple[list[str], list[str]]:
    """The names that can be looked up, and findings; a TypeError for what holds no names."""
    if given is None:
        return [], ["key_columns is required."]
    if isinstance(given, (str, bytes)) or not isinstance(given, Iterable):
        raise TypeError("key_columns must be a sequence of column names.")
    keys = list(given)
    findings = [] if keys else ["key_columns must hold at least one name."]
    named = [k for k in keys if isinstance(k, str) and k]
    if len(named) < len(keys):
        findings.append("key_columns must hold non-empty strings only.")
    if odd := [k for k in named if not well_formed(k)]:
        findings.append(f"key_columns must hold well-formed Unicode: {_listed(odd)}.")
    return [k for k in named if well_formed(k)], findings


def bind(df: DataFrame, config: ParserConfig, *, key_columns: Iterable[str] | None, on_missing_source: str, column_prefix: str, error_mode: str, result_columns: Sequence[str], parsed_extras: Sequence[str]) -> Binding:
    """Key bindings and allowed gaps; all findings against the DataFrame are raised together, checks that rest on bad names left out."""
    _check_arguments(config, on_missing_source, column_prefix, error_mode)
    named_keys, findings = _read_keys(key_columns)
    spark = df.sparkSession
    sources = list(dict.fromkeys(c.source_column_name for c in config.columns))
    targets = [c.target_column_name for c in config.columns]
    findings += _literal_findings(spark, config)
    if odd := [n for n in (*sources, *targets) if not well_formed(n)]:
        findings.append(f"Configured names must be well-formed Unicode: {_listed(odd)}.")
        raise SchemaValidationError(findings)
    inputs = Names(df)
    fields, many, missing = inputs.find(sources)
    if many:
        findings.append(f"Ambiguous source columns: {_listed(many)}.")
    if missing and on_missing_source == "fail":
        findings.append(f"Missing source columns: {_listed(missing)}.")
    if other := {n: f.dataType.simpleString() for n, f in fields.items() if not isinstance(f.dataType, StringType)}:
        findings.append("Source columns must be top-level strings: " + ", ".join(f"{n!r} is {kind}" for n, kind in other.items()) + ".")
    if taken := inputs.among(result_columns):
        findings.append(f"Input columns have reserved result names: {_listed(taken)}.")
    if clash := Names.of(spark, targets).among(parsed_extras):
        findings.append(f"Target columns have reserved result names: {_listed(clash)}.")
    findings += [f"Target columns are one name to the resolver: {_listed(g)}." for g in _alike(spark, targets)]
    keys, key_findings = _keys(spark, config, named_keys, inputs, result_columns)
    findings += key_findings
    if findings:
        raise SchemaValidationError(findings)
    told = tuple(f"Source column {s!r} is missing; its targets are parsed from null." for s in missing)
    for t in told:
        warnings.warn(t, SchemaWarning, stacklevel=4)
    return Binding(tuple(keys), frozenset(missing), told)


def _keys(spark: SparkSession, config: ParserConfig, key_columns: Sequence[str], inputs: Names, result_columns: Sequence[str]) -> tuple[list[Key], list[str]]:
    if not key_columns:
        return [], []
    findings = [f"Duplicate key columns: {_listed(g)}." for g in _alike(spark, key_columns)]
    _, many, gone = inputs.find(key_columns)
    if gone:
        findings.append(f"Missing key columns: {_listed(gone)}.")
    if many:
        findings.append(f"Ambiguous key columns: {_listed(many)}.")
    if findings:
        return [], findings
    configured = Names.of(spark, dict.fromkeys(c.source_column_name for c in config.columns))
    # A key that stands for several sources, one column by several names, passes through.
    told, _, _ = configured.find([k for k in key_columns if configured.among([k])])
    keys = []
    for k in key_columns:
        feeds = [i for i, c in enumerate(config.columns) if k in told and c.source_column_name == told[k].name]
        keys.append(Key(k, config.columns[feeds[0]].target_column_name, feeds[0]) if len(feeds) == 1 else Key(k, k, None))
    findings += [f"Key columns have one name in the results: {_listed(g)}." for g in _alike(spark, [k.output for k in keys])]
    passed = [k.column for k in keys if k.target is None]
    if shared := Names.of(spark, [c.target_column_name for c in config.columns]).among(passed):
        findings.append(f"Key columns that pass through share names with targets: {_listed(shared)}.")
    if clash := Names.of(spark, result_columns).among([k.output for k in keys]):
        findings.append(f"Key columns have reserved result names: {_listed(clash)}.")
    return keys, findings


EXHAUSTED = re.compile(r"StackOverflowError|Max iterations|max iterations|RecursionError|maximum recursion", re.I)
