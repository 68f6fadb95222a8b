"""Scalar parsing, policies, evidence and binding on small DataFrames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from burnish import SchemaValidationError, SchemaWarning, parser

D = dt.date
T = dt.datetime


def contract(*columns, **globals_):
    return {"parser_config_id": "t", "parser_config_name": "T", "version": "1", "globals": globals_, "columns": list(columns)}


def column(kind, source="v", target="V", **options):
    return {"source_column_name": source, "target_column_name": target, "expected_data_type": kind, "parser": {"type": kind.split("(")[0], **options}}


def parse_all(spark, kind, tokens, **options):
    """Token to value, with null for what does not parse; timestamps as text, so that no host zone has a say."""
    df = spark.createDataFrame([(t,) for t in tokens], "v string")
    parsed = parser.parse_dataframe(df, contract(column("string", target="S", collapse_whitespace=False, trim_whitespace=False, empty_is_null=False), column(kind, target="Value", on_parse_error="null", **options)), key_columns=["v"]).parsed_df
    value = F.col("Value").cast("string") if kind.startswith("timestamp") else F.col("Value")
    return {r.S: r.V for r in parsed.select("S", value.alias("V")).collect()}


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", old)


NUMBERS = {
    "byte": {"127": 127, "128": None, "-128": -128, "+7": 7, "007": 7, "5.": 5, ".5": None, "5.0": None, "1e2": None, "1d": None, "٣": None, "1,000": None, "1\n": 1},
    "integer": {"2147483647": 2147483647, "2147483648": None, "0x1": None, "": None, ".": None, "-": None, "NaN": None},
    "long": {"9223372036854775807": 9223372036854775807, "9223372036854775808": None},
    "decimal(6,2)": {"1.239": Decimal("1.24"), "1.": Decimal("1.00"), ".5": Decimal("0.50"), "1e2": Decimal("100.00"), "99999": None, "1e-9": Decimal("0.00"), "1.e1": Decimal("10.00"), ".e2": None, "+.": None},
    "double": {"1e400": None, "1e-400": None, "0e-10000": 0.0, "-0.0": -0.0, "5e-324": 5e-324, "1f": None, "Infinity": None, "1.5": 1.5, "-.5": -0.5, "1.e2": 100.0, "+.e2": None, "-00.000e+999": -0.0, "007": 7.0},
    "float": {"1e39": None, "1e-45": 1.401298464324817e-45, "1e-46": None, "1.5": 1.5},
}


@pytest.mark.parametrize("kind", NUMBERS)
def test_numbers(spark, ansi, kind):
    assert parse_all(spark, kind, NUMBERS[kind]) == NUMBERS[kind]


def test_line_ends_are_not_ignored(spark):
    options = {"collapse_whitespace": False, "trim_whitespace": False}
    assert set(parse_all(spark, "integer", ["1\n", "1\r\n", "1 "], **options).values()) == {None}


def test_binary_and_boolean(spark, ansi):
    assert parse_all(spark, "binary", ["SGk=", "SGk", "SG k=", "="], collapse_whitespace=False) == {"SGk=": b"Hi", "SGk": None, "SG k=": None, "=": None}
    assert parse_all(spark, "binary", ["4869", "4g"], encoding="hex") == {"4869": b"Hi", "4g": None}
    assert parse_all(spark, "binary", ["é"], encoding="utf8") == {"é": "é".encode()}
    assert parse_all(spark, "boolean", ["TRUE", "y", "no"], true_values=["y"], boolean_values_mode="extend") == {"TRUE": True, "y": True, "no": None}


@pytest.mark.parametrize("policy", ["CORRECTED", "EXCEPTION", "LEGACY"])
def test_built_in_dates(spark, ansi, policy):
    wanted = {
        "2024-02-29": D(2024, 2, 29), "2023-02-29": None, "1500-02-29": None, "2024-1-2": None, "01/02/2026": None, "2024-01-02T03:04:05": D(2024, 1, 2),
        "2024-01-02 03:04:05.123": D(2024, 1, 2), "12/31/2024 12:00 AM": D(2024, 12, 31), "12/31/2024 13:00 AM": None, "2024-01-02T03:04:05Z": None,
    }
    old = spark.conf.get("spark.sql.legacy.timeParserPolicy")
    spark.conf.set("spark.sql.legacy.timeParserPolicy", policy)
    try:
        assert parse_all(spark, "date", wanted) == wanted
    finally:
        spark.conf.set("spark.sql.legacy.timeParserPolicy", old)


def test_timestamps(spark, ansi):
    wanted = {
        "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "2024-01-02T03:04:05.5": "2024-01-02 03:04:05.5", "2024-01-02T03:04:05+19:00": None, "2024-01-02": None,
        "01/02/2024 12:30 PM": "2024-01-02 12:30:00", "01/02/2024 1:02:03 am": "2024-01-02 01:02:03", "01/02/2024 0:30 PM": None,
    }
    assert parse_all(spark, "timestamp", wanted) == wanted
    local = {"2024-01-02T03:04:05Z": None, "2024-01-02 03:04:05": "2024-01-02 03:04:05"}
    assert parse_all(spark, "timestamp_ntz", local) == local
    offset = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
    assert parse_all(spark, "date", ["2024-01-02T23:00:00-05:00", "2024-01-02T23:00:00-19:00"], formats=[offset]) == {"2024-01-02T23:00:00-05:00": D(2024, 1, 2), "2024-01-02T23:00:00-19:00": None}


def test_custom_patterns(spark, ansi):
    tokens = {"02.01.2024": D(2024, 1, 2), "02.01.2024x": None, "31.02.2024": None, '"}': None}
    assert parse_all(spark, "date", tokens, formats=["dd.MM.yyyy"]) == tokens
    assert parse_all(spark, "timestamp", ["2024/01/02 03"], formats=["yyyy/MM/dd HH"]) == {"2024/01/02 03": "2024-01-02 03:00:00"}
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(SchemaValidationError, match="pattern"):
        parser.parse_dataframe(df, contract(column("date", formats=["yyyy-QQQQQQ-bad"])), key_columns=["v"])
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "LEGACY")
    try:
        with pytest.raises(SchemaValidationError, match="CORRECTED"):
            parser.parse_dataframe(df, contract(column("date", formats=["dd.MM.yyyy"])), key_columns=["v"])
    finally:
        spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")


def test_normalisation(spark):
    df = spark.createDataFrame([(" a \t b ",), ("  ",), ("n/a",), ("N/A",), (None,)], "v string")
    config = contract(column("string", replace_null_markers=True, null_marker_case_sensitive=False), null_markers=["N/A"])
    assert [r.V for r in parser.parse_dataframe(df, config, key_columns=["v"]).parsed_df.collect()] == ["a b", None, None, None, None]


POLICIES = [
    column("integer", "bad", "Null", on_parse_error="null"),
    column("integer", "bad", "Default", on_parse_error="default", default_on_error=7),
    column("integer", "bad", "Required", is_nullable=False, default_on_null=0, audit=True),
    column("integer", "bad", "Fail"),
    {**column("string", "state", "State", on_parse_error="preserve", format="state_us", audit=True)},
    column("integer", "zero", "Zero", zero_is_valid=False, audit=True),
    column("string", "zip", "Zip", format="zip", audit=True),
]


def test_policies_and_evidence(spark):
    df = spark.createDataFrame([(1, "oops", " Atlantis ", "0", "1234, 123456789"), (2, "5", "tx", None, None)], "id int, bad string, state string, zero string, zip string")
    strict = parser.parse_dataframe(df, contract(*POLICIES), key_columns=["id"])
    with pytest.raises(Exception, match="oops"):
        strict.parsed_df.select("Fail").collect()
    assert [r.Null for r in strict.parsed_df.select("Null").collect()] == [None, 5]
    soft = parser.parse_dataframe(df, contract(*POLICIES), key_columns=["id"], error_mode="collect")
    one, two = soft.parsed_df.collect()
    assert (one.Null, one.Default, one.Required, one.Fail, one.State, one.Zero, one.Zip) == (None, 7, 0, None, " Atlantis ", None, "01234, 12345-6789")
    assert [(e.target_column_name, e.resolution, e.error_code) for e in one.burnish_parse_errors] == [
        ("Null", "null", "PARSE_ERROR"), ("Default", "default_on_error", "PARSE_ERROR"), ("Required", "default_on_null", "PARSE_ERROR"),
        ("Fail", "null", "PARSE_ERROR"), ("State", "preserve", "PARSE_ERROR"),
    ]
    assert one.burnish_parse_errors[4].message == "Value could not be parsed as string with format 'state_us'."
    assert two.burnish_parse_errors == [] and two.Required == 5
    audit = {a.target_column_name: a for a in soft.results_df.filter("id = 1").first().burnish_parse_results}
    assert audit["Required"].actions_applied == ["parse_error_collected", "parse_error_to_null", "default_on_null_applied"]
    assert audit["Required"].error == "Value could not be parsed as integer." and audit["Required"].parsed_value == "0" and audit["Required"].changed
    assert audit["State"].actions_applied == ["parse_error_preserved"] and audit["State"].original_value == " Atlantis "
    assert audit["Zero"].actions_applied == ["zero_invalidated"]
    assert audit["Zip"].actions_applied == ["zip_padded", "zip_plus4_formatted"]
    assert audit["Zip"].options["on_parse_error"] == "fail" and audit["Zip"].options["null_markers"] == "[]" and audit["Zip"].options["audit"] == "true"
    assert soft.results_df.columns == ["id", "burnish_parse_results", "burnish_config", "burnish_engine_version", "burnish_parse_errors", "burnish_error_mode"]


def test_missing_sources_and_keys(spark):
    df = spark.createDataFrame([("1",)], "a string")
    config = contract(column("integer", "a", "A"), column("string", "gone", "Gone", audit=True))
    with pytest.raises(SchemaValidationError, match="gone"):
        parser.parse_dataframe(df, config, key_columns=["a"])
    with pytest.warns(SchemaWarning):
        got = parser.parse_dataframe(df, config, key_columns=["a"], on_missing_source="warn")
    row = got.results_df.first()
    assert row.A == 1 and row.burnish_parse_results[0].effective is False
    assert row.burnish_parse_results[0].actions_applied == ["source_column_missing"]
    twice = contract(column("integer", "a", "A"), column("string", "a", "B"))
    with pytest.raises(SchemaValidationError, match="share names"):
        parser.parse_dataframe(df, twice, key_columns=["a"])


def test_findings_come_together(spark):
    df = spark.createDataFrame([(1, "x", "y")], "n int, burnish_config string, k string")
    config = contract(column("integer", "n", "N"), column("string", "gone", "G"), column("string", "k", "g"))
    with pytest.raises(SchemaValidationError) as e:
        parser.parse_dataframe(df, config, key_columns=["k", "none"])
    text = " ".join(e.value.errors)
    assert len(e.value.errors) == 5
    for part in ("gone", "top-level strings", "burnish_config", "one name", "none"):
        assert part in text


def test_odd_names_and_unicode_booleans(spark):
    df = spark.createDataFrame([("1",)], ["a.b`c"])
    got = parser.parse_dataframe(df, contract(column("integer", "a.b`c", " X ")), key_columns=["a.b`c"])
    assert got.parsed_df.columns == [" X "] and got.results_df.columns[0] == " X "
    bad = contract(column("boolean", "a.b`c", "X", true_values=["Ä"], false_values=["ä"]))
    with pytest.raises(SchemaValidationError, match="lowers alike"):
        parser.parse_dataframe(df, bad, key_columns=["a.b`c"])


def test_plan_is_wide_and_narrow(spark):
    df = spark.createDataFrame([tuple("1" * 40)], ", ".join(f"c{i} string" for i in range(40)))
    config = contract(*[column("integer", f"c{i}", f"C{i}", on_parse_error="null") for i in range(40)])
    parsed = parser.parse_dataframe(df, config, key_columns=["c0"], error_mode="collect").parsed_df
    analysed, executed = parsed._jdf.queryExecution().analyzed().toString(), parsed._jdf.queryExecution().executedPlan().toString()
    assert analysed.count("Project [") <= 10
    assert "Exchange" not in executed and "Python" not in executed
    assert parsed.first().C39 == 1


def test_binding_runs_no_job(spark):
    df = spark.createDataFrame([("1",)], "v string")
    group = "burnish-binding"
    spark.sparkContext.setJobGroup(group, "binding")
    config = contract(column("boolean", "v", "B", true_values=["Ä"], false_values=["ö"]), column("date", "v", "D", formats=["dd.MM.yyyy"]))
    parser.parse_dataframe(df, config, key_columns=["v"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    spark.sparkContext.setJobGroup("other", "")


def test_binding_runs_no_job_whatever_the_optimizer_leaves_out(spark):
    df = spark.createDataFrame([("1",)], "v string")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation,org.apache.spark.sql.catalyst.optimizer.ConstantFolding")
    try:
        test_binding_runs_no_job(spark)
        with pytest.raises(SchemaValidationError, match="pattern"):
            parser.parse_dataframe(df, contract(column("date", formats=["yyyy-QQQQQQ-bad"])), key_columns=["v"])
        with pytest.raises(SchemaValidationError, match="'Ä'"):
            parser.parse_dataframe(df, contract(column("boolean", true_values=["y", "Ä"], false_values=["ä"])), key_columns=["v"])
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def test_a_session_that_folds_nothing_proves_nothing(spark, monkeypatch):
    from burnish.plans import binding

    df = spark.createDataFrame([("1",)], "v string")
    monkeypatch.setattr(binding, "_refusal", lambda session, pattern: None)
    with pytest.raises(SchemaValidationError, match="can't be checked"):
        parser.parse_dataframe(df, contract(column("date", formats=["dd.MM.yyyy"])), key_columns=["v"])


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_names_are_what_the_resolver_says(spark, case_sensitive):
    """Names that only a fold in Python takes for one stay apart; those that Spark can't tell apart are found."""
    spark.conf.set("spark.sql.caseSensitive", str(case_sensitive).lower())
    try:
        df = spark.createDataFrame([("2", "1", "3")], ["i", "ı", "K"])
        got = parser.parse_dataframe(df, contract(column("integer", "i", "a"), column("integer", "ı", "b")), key_columns=["i", "ı"]).parsed_df.first()
        assert (got.a, got.b) == (2, 1)
        upper = contract(column("integer", "k", "x"))
        if case_sensitive:
            with pytest.raises(SchemaValidationError, match="Missing source columns: 'k'"):
                parser.parse_dataframe(df, upper, key_columns=["K"])
            both = spark.createDataFrame([("2", "1")], ["v", "V"])
            twice = parser.parse_dataframe(both, contract(column("integer", "v", "a"), column("integer", "V", "A")), key_columns=["v", "V"])
            assert tuple(twice.parsed_df.first()) == (2, 1) and twice.key_columns == ("a", "A")
        else:
            assert parser.parse_dataframe(df, upper, key_columns=["k", "i"]).key_columns == ("x", "i")
            several = parser.parse_dataframe(df, contract(column("integer", "k", "x"), column("string", "K", "y")), key_columns=["K", "i"])
            assert several.key_columns == ("K", "i") and several.results_df.first().K == "3"
            doubled = spark.createDataFrame([("2", "1")], ["v", "V"])
            with pytest.raises(SchemaValidationError, match="Ambiguous source columns: 'v'"):
                parser.parse_dataframe(doubled, contract(column("integer", "v", "a")), key_columns=["v"])
            with pytest.raises(SchemaValidationError, match="Duplicate key columns: 'K', 'k'"):
                parser.parse_dataframe(df, upper, key_columns=["K", "k"])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.parametrize(("keys", "said"), [(None, "required"), ([], "at least one"), (["v", ""], "non-empty"), ([None], "non-empty"), (["\ud800"], "well-formed")])
def test_key_findings_come_first_with_the_others(spark, keys, said):
    df = spark.createDataFrame([("1",)], "v string")
    with pytest.raises(SchemaValidationError) as e:
        parser.parse_dataframe(df, contract(column("integer"), column("integer", "gone", "G")), key_columns=keys)
    assert said in e.value.errors[0] and any("gone" in x for x in e.value.errors[1:])
    for odd in ("v", b"v", 5):
        with pytest.raises(TypeError):
            parser.parse_dataframe(df, contract(column("integer")), key_columns=odd)
    assert parser.parse_dataframe(df, contract(column("integer")), key_columns=(k for k in ["v"])).key_columns == ("V",)


def test_defaults_of_every_type(spark):
    df = spark.createDataFrame([(None,)], "v string")
    given = {"string": "x", "byte": 1, "short": 2, "integer": 3, "long": 4, "float": 1.5, "double": 2.5, "decimal(5,2)": 1.25, "binary": "SGk=", "boolean": True, "date": "1500-01-01", "timestamp": "2024-01-02T03:04:05+01:00", "timestamp_ntz": "2024-01-02T03:04:05.5"}
    config = contract(*[column(k, target=f"t{i}", is_nullable=False, default_on_null=v, audit=True) for i, (k, v) in enumerate(given.items())])
    got = parser.parse_dataframe(df, config, key_columns=["v"])
    values = [a.parsed_value for a in got.results_df.first().burnish_parse_results]
    assert values == ["x", "1", "2", "3", "4", "1.5", "2.5", "1.25", "SGk=", "true", "1500-01-01", "2024-01-02 02:04:05", "2024-01-02 03:04:05.5"]
    assert parser.content_hash(parser.compile_mapping(parser.to_mapping(parser.compile_mapping(config)))) == parser.content_hash(parser.compile_mapping(config))


def test_persist(spark):
    df = spark.createDataFrame([("1",)], "v string")
    got = parser.parse_dataframe(df, contract(column("integer")), key_columns=["v"])
    assert got.persist().parsed_df.first().V == 1
    assert got.unpersist() is got


def test_stream(spark, tmp_path):
    from burnish.streaming import start_parsed_stream

    spark.createDataFrame([("1",), ("x",)], "v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in"))
    config = contract(column("integer", on_parse_error="null"))
    q = start_parsed_stream(stream, config, key_columns=["v"], sink="parquet", checkpoint=str(tmp_path / "c"), path=str(tmp_path / "out"), available_now=True)
    q.awaitTermination(120)
    assert sorted(str(r.V) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "None"]
