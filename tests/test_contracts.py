"""Authoring, identity, description and review, all without Spark."""

import copy
import json
import pickle
import subprocess
import sys
from pathlib import Path

import pytest

from burnish import DEFAULTS, CompilationError, SchemaValidationError, parser

BASE = """
parser_config_id: " id "
parser_config_name: Name
version: "1"
columns:
  - source_column_name: a
    target_column_name: A
    expected_data_type: Decimal ( 018 , 2 )
    parser: {type: decimal, is_nullable: false, default_on_null: 1.5}
  - source_column_name: b
    target_column_name: B
    expected_data_type: bool
    parser: boolean
"""


def one(kind="integer", **options):
    return {"parser_config_id": "i", "parser_config_name": "n", "version": "1", "columns": [{"source_column_name": "a", "target_column_name": "A", "expected_data_type": kind, "parser": {"type": kind.split("(")[0], **options}}]}


def errors_of(source):
    with pytest.raises(CompilationError) as e:
        parser.compile_yaml(source)
    return e.value.errors


def test_import_needs_no_spark():
    code = "import sys, burnish; burnish.parser.describe(); sys.exit('pyspark' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent).returncode == 0


def test_compiles_and_resolves(tmp_path):
    config = parser.compile_yaml(BASE)
    assert config.parser_config_id == "id" and config.columns[0].expected_data_type == "decimal(18,2)"
    mapping = parser.to_mapping(config)
    assert mapping["columns"][0]["parser"]["default_on_null"] == "1.50"
    assert mapping["columns"][1]["parser"]["true_values"] == ["true"]
    assert parser.compile_mapping(mapping) == config
    (tmp_path / "c.yaml").write_text(BASE, encoding="utf-8")
    assert parser.compile_yaml(tmp_path / "c.yaml") == config
    assert errors_of(str(tmp_path / "c.yaml"))  # a string is YAML text, never a path
    assert parser.content_hash(config) == parser.content_hash(parser.compile_text(BASE.replace("\n", "\n\n")))
    swapped = parser.to_mapping(config)
    swapped["columns"].reverse()
    assert parser.content_hash(parser.compile_mapping(swapped)) != parser.content_hash(config)
    assert json.loads(parser.canonical_json(config)) == mapping


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("a: 1\na: 2", "Duplicate YAML key"), ("x: &x {a: 1}\ny:\n  <<: *x", "merge"), ("[1]", "mapping"), ("a: [", "Invalid YAML"),
        ("{? [1] : 2}", "plain values"), ("[" * 300 + "]" * 300, "nested deeper"),
    ],
)
def test_bad_yaml(text, part):
    assert part in errors_of(text)[0]


def test_one_finding_is_bare_and_several_have_paths():
    single = one(unknown=1)
    assert errors_of(single) == ("Unknown integer parser key 'unknown'.",)
    both = one(unknown=1)
    both["extra"] = 1
    got = errors_of(both)
    assert [e.split(":")[0] for e in got] == ["extra", "columns[0].parser.unknown"]


BAD = [
    (one(on_parse_error="preserve"), "string targets only"),
    (one(default_on_null=1), "needs is_nullable: false"),
    (one(is_nullable=False), "needs default_on_null"),
    (one(on_parse_error="default"), "needs default_on_error"),
    (one(is_nullable="false"), "true or false"),
    (one(is_nullable=False, default_on_null=True), "integer"),
    (one("byte", is_nullable=False, default_on_null=128), "out of range"),
    (one("float", is_nullable=False, default_on_null=1e39), "default_on_null"),
    (one("float", is_nullable=False, default_on_null=1e-46), "vanishes"),
    (one("double", is_nullable=False, default_on_null=float("nan")), "finite"),
    (one("decimal(4,2)", is_nullable=False, default_on_null="1.234"), "exactly"),
    (one("decimal(4,2)", is_nullable=False, default_on_null=123), "fit"),
    (one("decimal(39,2)"), "precision"),
    (one("decimal"), "precision"),
    (one("array<int>"), "Unsupported"),
    (one("date", is_nullable=False, default_on_null="2024-02-30"), "default_on_null"),
    (one("timestamp", is_nullable=False, default_on_null="2024-01-01T00:00:00+19:00"), "18:00"),
    (one("timestamp_ntz", is_nullable=False, default_on_null="2024-01-01T00:00:00Z"), "offset"),
    (one("timestamp_ntz", formats=["yyyy-MM-dd XXX"]), "zone"),
    (one("date", formats=[]), "not be empty"),
    (one("binary", is_nullable=False, default_on_null="SGk"), "base64"),
    (one("boolean", true_values=["x"], false_values=["X"]), "both true and false"),
    (one("boolean", true_values=[]), "not be empty"),
    (one(zero_is_valid=False, is_nullable=False, default_on_null=0), "zero"),
    (one(null_markers_mode="extend"), "needs null_markers"),
    (one(replace_null_markers=True), "needs null_markers"),
    (one("string", format="shout"), "must be one of"),
    (one("string", formats=["x"]), "Unknown"),
]


@pytest.mark.parametrize(("source", "part"), BAD)
def test_findings(source, part):
    assert any(part in e for e in errors_of(source))


def test_duplicate_targets_and_vocabulary_inheritance():
    twice = one()
    twice["columns"] *= 2
    assert "Duplicate target" in errors_of(twice)[0]
    source = one("boolean", true_values=["y"], boolean_values_mode="extend") | {"globals": {"null_markers": ["NA"], "true_values": ["t"], "false_values": ["f"]}}
    options = parser.compile_mapping(source).columns[0].parser
    assert options.true_values == ("t", "y") and options.false_values == ("f",) and options.null_markers == ("NA",)
    assert parser.compile_mapping(one("string", format="NONE")).columns[0].parser.string_format is None
    assert parser.compile_mapping(one("timestamp", is_nullable=False, default_on_null="2024-01-01T01:00:00+01:00")).columns[0].parser.default_on_null == "2024-01-01T00:00:00Z"


def test_errors_survive_pickling():
    for e in (CompilationError(["a", "b"]), SchemaValidationError("x")):
        again = pickle.loads(pickle.dumps(e))
        assert again.errors == e.errors and str(again) == str(e)


def test_defaults_are_fixed_and_copies_are_free():
    with pytest.raises(TypeError):
        DEFAULTS["common"]["audit"] = True
    copied = parser.defaults()
    copied["common"]["audit"] = True
    assert parser.defaults()["common"]["audit"] is False


def test_descriptions():
    about = parser.describe()
    assert len(about) == 13 and about["boolean"]["arguments"]["true_values"]["default"] == ["true"]
    assert parser.string.describe()["arguments"]["on_parse_error"]["choices"][-1] == "preserve"
    assert "preserve" not in parser.integer.describe()["arguments"]["on_parse_error"]["choices"]
    assert parser.describe("bigint") == parser.long.describe() and parser.config.describe()["columns"]["parser"]["required"]
    assert parser.normalize_data_type(" NUMERIC(5, 2) ") == "decimal(5,2)"
    changed = parser.describe()
    changed["long"]["arguments"].clear()
    assert parser.describe()["long"]["arguments"]


def test_review(tmp_path):
    report = parser.review_yaml(BASE)
    assert report.is_valid and report.content_hash == parser.content_hash(parser.compile_text(BASE))
    assert "No column is audited." in report.warnings and len(report.checks) == 7
    report.write_json(tmp_path / "r.json")
    report.write_markdown(tmp_path / "r.md")
    assert json.loads((tmp_path / "r.json").read_text())["is_valid"] and (tmp_path / "r.md").read_text().endswith("\n")
    bad = parser.review_yaml("columns: 1")
    assert not bad.is_valid and len(bad.errors) == 4 and bad.resolved_config is None
    odd = copy.deepcopy(one())
    odd["columns"][0]["target_column_name"] = "a|b\u202e`````\n# x"
    text = parser.review_yaml(odd).to_markdown()
    assert "\u202e" not in text and "\n# x" not in text and "``````yaml" in text
