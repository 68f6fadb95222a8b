"""Queries over the test tables, one for each group of operators, and SQL that returns the same rows.

The tables are typed, so each query first writes bronze text (columns cast to strings, some made dirty by their keys)
over the whole table, and its SQL does the same.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalogues
from .service import parser

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract(*columns: dict[str, Any], **globals_: Any) -> dict[str, Any]:
    return {"parser_config_id": "bench", "parser_config_name": "Bench", "version": "1", "owner": "tests", "globals": globals_, "columns": list(columns)}


def column(source: str, target: str, kind: str, **options: Any) -> dict[str, Any]:
    kind = "integer" if kind == "int" else kind
    return {"source_column_name": source, "target_column_name": target, "expected_data_type": kind, "parser": {"type": kind.split("(")[0], "on_parse_error": "null", **options}}


def typed(df: DataFrame, key: str, *columns: dict[str, Any], **options: Any) -> DataFrame:
    """The key as text, parsed back, beside the columns."""
    globals_ = options.pop("globals_", {})
    return parser.parse_dataframe(df, contract(column(key, key, "long"), *columns, **globals_), key_columns=[key], **options).parsed_df


def _text(name: str) -> Column:
    return F.col(name).cast("string")


@query("""
SELECT p_partkey, trim(regexp_replace(chr(9) || ' ' || replace(p_name, ' ', '  ') || chr(160), '[\\t \\x{00A0}]+', ' ', 'g')) AS clean,
  chr(9) || ' ' || replace(p_name, ' ', '  ') || chr(160) AS kept FROM part
""")
def norm_whitespace(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(_text("p_partkey").alias("p_partkey"), F.concat(F.lit("\t "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("v"))
    return typed(df, "p_partkey", column("v", "clean", "string"), column("v", "kept", "string", collapse_whitespace=False, trim_whitespace=False))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE c_mktsegment END AS any_case,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE c_mktsegment END AS one_case FROM customer
""")
def norm_null_markers(spark, sf_dir):
    v = F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 5 == 1, " n/a ").otherwise(F.col("c_mktsegment"))
    df = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), v.alias("v"))
    marked = {"replace_null_markers": True}
    return typed(
        df, "c_custkey",
        column("v", "any_case", "string", null_markers=["N/A"], null_markers_mode="extend", null_marker_case_sensitive=False, **marked),
        column("v", "one_case", "string", **marked), globals_={"null_markers": ["NA", "N/A"]},
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS emptied, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS kept,
  CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_name END AS filled FROM customer
""")
def norm_empty(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "   ").otherwise(F.col("c_name")).alias("v"))
    return typed(df, "c_custkey", column("v", "emptied", "string"), column("v", "kept", "string", empty_is_null=False), column("v", "filled", "string", is_nullable=False, default_on_null="none"))


_INTEGERS = "CASE WHEN l_orderkey % 7 = 0 THEN 'oops' WHEN l_orderkey % 11 = 0 THEN l_quantity::BIGINT || '.0' WHEN l_orderkey % 13 = 0 THEN '+0' || l_quantity::BIGINT ELSE ' ' || (l_quantity::BIGINT * 5) || '. ' END"


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, trim({_INTEGERS}) AS v FROM lineitem),
i AS (SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+\\.?') THEN CAST(replace(v, '.', '') AS BIGINT) END AS n FROM b)
SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN n <= 127 THEN n END::TINYINT AS as_byte, n::SMALLINT AS as_short, n::INTEGER AS as_integer, n AS as_long FROM i
""")
def parse_integers(spark, sf_dir):
    key, n = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    v = F.when(key % 7 == 0, "oops").when(key % 11 == 0, F.concat(n.cast("string"), F.lit(".0"))).when(key % 13 == 0, F.concat(F.lit("+0"), n.cast("string"))).otherwise(F.concat(F.lit(" "), (n * 5).cast("string"), F.lit(". ")))
    df = table(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("l_orderkey"), _text("l_linenumber").alias("l_linenumber"), v.alias("v"))
    return typed(df, "l_orderkey", column("l_linenumber", "l_linenumber", "int"), *[column("v", f"as_{k}", k) for k in ("byte", "short", "integer", "long")])


@query("""
SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice::DECIMAL(12,2)::DOUBLE + CASE WHEN l_orderkey % 5 = 0 THEN 0.01::DECIMAL(12,2)::DOUBLE ELSE 0 END END AS price,
  CASE WHEN l_orderkey % 7 = 0 THEN 'bad' ELSE 'fine' END AS told FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL
SELECT l_orderkey, l_linenumber::INTEGER, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_extendedprice::DECIMAL(12,2) + 0.01)::DECIMAL(12,2)::DOUBLE END,
  CASE WHEN l_orderkey % 7 = 0 THEN 'bad' ELSE 'fine' END FROM lineitem WHERE l_orderkey % 5 = 0
""")
def parse_decimal(spark, sf_dir):
    """Prices with a third digit that rounds half up, or none of which rounds."""
    exact = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    v = F.when(F.col("l_orderkey") % 7 == 0, "1,5").when(F.col("l_orderkey") % 5 == 0, F.concat(exact, F.lit("5"))).otherwise(F.concat(exact, F.lit("4e0")))
    df = table(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("l_orderkey"), _text("l_linenumber").alias("l_linenumber"), v.alias("v"))
    out = typed(df, "l_orderkey", column("l_linenumber", "l_linenumber", "int"), column("v", "price", "decimal(12,2)"))
    return out.select("l_orderkey", "l_linenumber", F.col("price").cast("double").alias("price"), F.when(F.col("price").isNull(), "bad").otherwise("fine").alias("told"))


@query("""
SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN l_orderkey % 9 IN (0, 1, 2) THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_orderkey % 9 IN (0, 1, 2) OR l_tax = 0 THEN NULL ELSE l_tax END AS tax_not_zero FROM lineitem
""")
def parse_double(spark, sf_dir):
    key = F.col("l_orderkey") % 9
    v = F.when(key == 0, "1e400").when(key == 1, "1e-400").when(key == 2, "NaN").otherwise(_text("l_tax"))
    df = table(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("l_orderkey"), _text("l_linenumber").alias("l_linenumber"), v.alias("v"))
    return typed(df, "l_orderkey", column("l_linenumber", "l_linenumber", "int"), column("v", "tax", "double"), column("v", "tax_not_zero", "double", zero_is_valid=False))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done, CASE o_orderstatus WHEN 'F' THEN true ELSE false END AS sure FROM orders
""")
def parse_boolean(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), F.lower("o_orderstatus").alias("v"))
    words = {"true_values": ["F"], "false_values": ["O"]}
    return typed(df, "o_orderkey", column("v", "done", "boolean", **words), column("v", "sure", "boolean", on_parse_error="default", default_on_error=False, **words))


_SPARK_SHAPES = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy h:mm a", "MM/dd/yyyy h:mm:ss a")


def _shaped(ts: Column, key: Column, shapes: tuple[str, ...]) -> Column:
    out = F.when(key % 17 == 0, "not-a-date").when(key % 19 == 0, "2023-02-29")
    for i, f in enumerate(shapes):
        out = out.when(key % len(shapes) == i, F.date_format(ts, f))
    return out


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), _shaped(F.col("o_orderdate"), F.col("o_orderkey"), _SPARK_SHAPES).alias("v"))
    return typed(df, "o_orderkey", column("v", "day", "date")).withColumn("day", _text("day"))


@query("""
SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL
  WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events
""".replace("AS at", 'AS "at"'))
def parse_timestamp_ntz(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(_text("event_id").alias("event_id"), _shaped(F.col("ts"), F.col("event_id"), _SPARK_SHAPES[1:]).alias("v"))
    return typed(df, "event_id", column("v", "at", "timestamp_ntz")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS instant FROM events
""")
def parse_timestamp(spark, sf_dir):
    """Offsets of two hours, none, and beyond what is legal."""
    offset = F.when(F.col("event_id") % 3 == 0, "+02:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("+19:00")
    df = table(spark, sf_dir, "events").select(_text("event_id").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("v"))
    return typed(df, "event_id", column("v", "instant", "timestamp")).withColumn("instant", F.date_format(F.to_utc_timestamp("instant", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 14 BETWEEN 1 AND 12 THEN '2024-03-09 ' || lpad((o_orderkey % 14 % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 0 END)::VARCHAR, 2, '0') || ':05:00' END AS "at" FROM orders
""")
def parse_us_12_hour(spark, sf_dir):
    v = F.concat(F.lit("03/09/2024 "), (F.col("o_orderkey") % 14).cast("string"), F.lit(":05 "), F.when(F.col("o_orderkey") % 2 == 0, "pm").otherwise("AM"))
    df = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), v.alias("v"))
    return typed(df, "o_orderkey", column("v", "at", "timestamp_ntz")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders
""")
def parse_custom_pattern(spark, sf_dir):
    v = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.when(F.col("o_orderkey") % 6 == 0, "x").otherwise(""))
    df = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), v.alias("v"))
    return typed(df, "o_orderkey", column("v", "day", "date", formats=["yyyy/MM/dd", "dd.MM.yyyy"])).withColumn("day", _text("day"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE hex(encode(c_name)) END AS from_base64, hex(encode(c_name)) AS from_hex, hex(encode(c_name)) AS from_utf8 FROM customer
""")
def parse_binary(spark, sf_dir):
    name = F.col("c_name").cast("binary")
    padded = F.base64(name)
    broken = F.when(F.col("c_custkey") % 4 == 0, F.concat(padded, F.lit("="))).otherwise(padded)
    df = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), broken.alias("b"), F.hex(name).alias("h"), F.col("c_name").alias("u"))
    out = typed(df, "c_custkey", column("b", "from_base64", "binary"), column("h", "from_hex", "binary", encoding="hex"), column("u", "from_utf8", "binary", encoding="utf8"))
    return out.select("c_custkey", *[F.hex(c).alias(c) for c in ("from_base64", "from_hex", "from_utf8")])


def _dirty_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    v = F.when(key % 6 == 0, " oops ").when(key % 6 == 1, "0").when(key % 6 == 2, "").otherwise(_text("p_size"))
    return table(spark, sf_dir, "part").select(_text("p_partkey").alias("p_partkey"), v.alias("v"))


_SIZES = [
    column("v", "as_null", "int"),
    column("v", "as_default", "int", on_parse_error="default", default_on_error=-1),
    column("v", "required", "int", is_nullable=False, default_on_null=-2, audit=True),
    column("v", "no_zero", "int", zero_is_valid=False, on_parse_error="fail", is_nullable=False, default_on_null=-3, audit=True),
    column("v", "preserved", "string", format="zip", on_parse_error="preserve", audit=True),
]


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE p_size END AS as_null,
  CASE p_partkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE p_size END AS as_default,
  CASE p_partkey % 6 WHEN 0 THEN -2 WHEN 1 THEN 0 WHEN 2 THEN -2 ELSE p_size END AS required,
  CASE p_partkey % 6 WHEN 0 THEN -3 WHEN 1 THEN -3 WHEN 2 THEN -3 ELSE p_size END AS no_zero,
  CASE p_partkey % 6 WHEN 0 THEN ' oops ' WHEN 1 THEN '00000' WHEN 2 THEN NULL ELSE lpad(p_size::VARCHAR, 5, '0') END AS preserved FROM part
""")
def error_policies(spark, sf_dir):
    return typed(_dirty_sizes(spark, sf_dir), "p_partkey", *_SIZES, error_mode="collect").drop("burnish_parse_errors")


@query("""
SELECT p_partkey, t.target, ' oops ' AS original, t.resolution, t.message FROM part, (VALUES
  ('as_null', 'null', 'Value could not be parsed as integer.'), ('as_default', 'default_on_error', 'Value could not be parsed as integer.'),
  ('required', 'default_on_null', 'Value could not be parsed as integer.'), ('no_zero', 'default_on_null', 'Value could not be parsed as integer.'),
  ('preserved', 'preserve', 'Value could not be parsed as string with format ''zip''.')) t(target, resolution, message) WHERE p_partkey % 6 = 0
""")
def collected_errors(spark, sf_dir):
    parsed = typed(_dirty_sizes(spark, sf_dir), "p_partkey", *_SIZES, error_mode="collect")
    # explode() makes the optimizer test the array before the row is parsed, and so parse twice; explode_outer() does not.
    flat = parsed.select("p_partkey", F.explode_outer("burnish_parse_errors").alias("e")).filter("e IS NOT NULL")
    return flat.select("p_partkey", F.col("e.target_column_name").alias("target"), F.col("e.original_value").alias("original"), "e.resolution", "e.message")


@query("""
SELECT p_partkey, t.target, CASE p_partkey % 6 WHEN 0 THEN t.a0 WHEN 1 THEN t.a1 WHEN 2 THEN t.a2 ELSE t.a3 END AS actions,
  CASE p_partkey % 6 WHEN 0 THEN t.c0 WHEN 1 THEN t.c1 WHEN 2 THEN t.c2 ELSE t.c3 END AS changed FROM part, (VALUES
  ('required', 'parse_error_to_null,default_on_null_applied', '', 'empty_string_to_null,default_on_null_applied', '', true, false, true, false),
  ('no_zero', 'parse_error_collected,parse_error_to_null,default_on_null_applied', 'zero_invalidated,default_on_null_applied', 'empty_string_to_null,default_on_null_applied', '', true, true, true, false),
  ('preserved', 'parse_error_preserved', 'zip_padded', 'empty_string_to_null', 'zip_padded', true, true, true, true)) t(target, a0, a1, a2, a3, c0, c1, c2, c3)
""")
def audit_records(spark, sf_dir):
    config = contract(column("p_partkey", "p_partkey", "long"), *_SIZES)
    results = parser.parse_dataframe(_dirty_sizes(spark, sf_dir), config, key_columns=["p_partkey"], error_mode="collect").results_df
    flat = results.select("p_partkey", F.inline_outer("burnish_parse_results"))
    return flat.select("p_partkey", F.col("target_column_name").alias("target"), F.array_join("actions_applied", ",").alias("actions"), "changed")


@query("""
SELECT p_partkey, 'size' AS target, true AS effective, CASE p_partkey % 6 WHEN 0 THEN 'Value could not be parsed as integer.' END AS error,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE p_size::VARCHAR END AS parsed, 'true' AS nullable, 'null' AS "default", '["NA","N/A"]' AS markers FROM part
UNION ALL SELECT p_partkey, 'lost', false, 'Source column is missing.', '1.50', 'false', '1.50', '["x"]' FROM part
""")
def audit_details(spark, sf_dir):
    """Whether a value took effect, why not, what it became, and the options it was read with."""
    columns = [
        column("v", "size", "int", audit=True, null_markers=["NA", "N/A"], replace_null_markers=True),
        column("gone", "lost", "decimal(5,2)", audit=True, is_nullable=False, default_on_null=1.5, null_markers=["x"], replace_null_markers=True),
    ]
    parsed = parser.parse_dataframe(_dirty_sizes(spark, sf_dir), contract(column("p_partkey", "p_partkey", "long"), *columns), key_columns=["p_partkey"], on_missing_source="warn")
    flat = parsed.results_df.select("p_partkey", F.inline_outer("burnish_parse_results"))
    told = [F.col("options")[k].alias(n) for k, n in (("is_nullable", "nullable"), ("default_on_null", "default"), ("null_markers", "markers"))]
    return flat.select("p_partkey", F.col("target_column_name").alias("target"), "effective", "error", F.col("parsed_value").alias("parsed"), *told)


_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), {1})"


@query(f"""
SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, {_TITLE.format("p_name", "' '")} AS titled, {_TITLE.format("p_name", "''")} AS pascal FROM part
""")
def format_case(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(_text("p_partkey").alias("p_partkey"), F.col("p_name").alias("v"))
    return typed(df, "p_partkey", *[column("v", t, "string", format=f) for t, f in (("low", "lower"), ("up", "upper"), ("titled", "title"), ("pascal", "pascal"))])


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad((c_custkey % 99999)::VARCHAR, 5, '0') WHEN 1 THEN lpad((c_custkey % 99999)::VARCHAR, 5, '0') || ', ' || '00123-0045'
  WHEN 2 THEN '12345-' || lpad((c_custkey % 9999)::VARCHAR, 4, '0') END AS zip FROM customer
""")
def format_zip(spark, sf_dir):
    key, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 99999).cast("string")
    v = F.when(key == 0, n).when(key == 1, F.concat(n, F.lit(" ,123-45"))).when(key == 2, F.concat(F.lit("12345"), F.lpad((F.col("c_custkey") % 9999).cast("string"), 4, "0"))).otherwise("123456")
    df = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), v.alias("v"))
    return typed(df, "c_custkey", column("v", "zip", "string", format="zip"))


def _quote(x) -> str:
    return "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"


def _picked(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _by_place(key: str, values: list, cast: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values)) + f" END::{cast}"


#: For each profile, bronze values and what they become (None: not accepted).
GOLDEN = {
    "title_business_v1": {
        "fhlb semi-annual 2 yrs": "FHLB Semi-Annual 2-Years", "cmt-backed": "CMT-Backed", "RCF6M": "Rcf6m", "fhlb_code": "Fhlb_code",
        "state-of-the-art": "State-Of-The-Art", "18 months": "18-Months", "2 years": "2-Years", "1.5 years": "1.5 Years", "1 year": "1 Year",
        "semiannually": "Semi-Annual", "biweekly p&i": "Bi-Weekly P&I", "biannually_code": "Biannually_code", "a- b": "A- B", "ust (cmt)": "UST (CMT)",
    },
    "address_us_v1": {
        "123 n main st apt 4b": "123 N Main St Apt 4B", "123 Center Street": "123 Center St", "Apt , 4b": "Apt 4B", "Apt #4b": "Apt #4B",
        "1st o'brien avenue": "1st O'Brien Ave", "12 MCDONALD RD.": "12 McDonald Rd", "po box 12a": "PO Box 12A", "99 dekalb pkwy": "99 DeKalb Pkwy",
        "5 smith-jones north": "5 Smith-Jones N", ",.": "",
    },
    "county": {"mcclain COUNTY": "McClain County", "cook county.": "Cook County", "de witt": "De Witt County", "COUNTY": None, "lake\u00a0County": "Lake County", "st. clair": "St Clair County"},
    "state_us": {
        "Illinois": "IL", "Ill.": "IL", "Washington, D.C.": "DC", "Illinois, tx": "IL, TX", "N. Mex.": "NM", "Mul": None, "IL,": None, "puerto rico": "PR",
        "wa, washington , d.c": "WA, DC", "U.S. Virgin Islands": "VI", "": None,
        "Illinois, ": None, "a,b": None, "Washington, D.C.,": None, "Washington, D.C., Ill.": "DC, IL", "tx,  Ohio": "TX, OH",
    },
    "interest_rate_index_v1": {
        "SOFR Term - 12M": "SOFR Term 12-Month", "10Y CMT": "10-Year Constant Maturity Treasury (CMT)", "TSFR6M": "SOFR Term 6-Month", "SOFR - 30-Day": "SOFR 30-Day",
        "Treasury - 1 yr": "Treasury 1-Year", "sofr avg - 30 days": "SOFR 30-Day Average", "XSOFR30": None, "prime": "Prime", "12 month libor": "12-Month LIBOR",
        "libor - 1 year (daily)": "LIBOR 1-Year (Daily)", "SOFR Term 2M": None, "NAP": None, "RCF12M": "RCF 12-Month", "ameribor 1 week": "Ameribor 1-Week", "012M LIBOR": None,
    },
    "property_type_v1": {
        "Warehouse-Mixed use": "Mixed Use - Warehouse", "sfr": "Single Family", "Condominimum": "Condominium", "industrial / warehouse": "Industrial - Warehouse",
        "12 units": "Multifamily", "4 unit": "Four-Unit", "2-4 Unit": None, "mixed use": "Mixed Use", "Mixed-Use (Office)": "Mixed Use - Office",
        "Mixed use - (Office) & (Retail)": "Mixed Use - (Office) & (retail)", "mixed use ((office))": "Mixed Use - Office", "Multi Family LIHTC mixed use": "Mixed Use - Multifamily - LIHTC",
        "Apartment – Garden": "Apartment - Garden", "unmixed use": None, "pud - mixed use - retail": "Mixed Use - PUD - Retail",
        "Condo Low Rise (<= 4 Stories; Single Unit)": "Condominium", "RE/Equipment": None,
        "Mixed Use - ((A) (B))": "Mixed Use - (A) (b)", "Mixed Use - (A (B))": "Mixed Use - A (b)", "Mixed Use - (A))": "Mixed Use - (A))", "Mixed Use - ((A)": "Mixed Use - ((A)",
        "Mixed Use - () - A": "Mixed Use - A", "Mixed Use - (( ))": "Mixed Use", "mixed use - ((école))": "Mixed Use - École", "Four–Unit": "Four-Unit", "Retail, Office": None,
        "MIXED USE- MULTIFAMILY-Over 20": "Mixed Use - Multifamily - Over 20", "Mixed use - 24 UNIT": "Mixed Use - 24 Unit", "1": None, "Multi": None,
    },
}
# Every spelling of the closed catalogues.
GOLDEN["state_us"] |= catalogues.STATES
GOLDEN["interest_rate_index_v1"] |= catalogues.INTEREST_RATES
GOLDEN["property_type_v1"] |= catalogues.PROPERTY_TYPES
GOLDEN["address_us_v1"] |= {f"1 x {given}": f"1 X {made}" for table_ in (catalogues.DIRECTIONALS, catalogues.UNITS, catalogues.SUFFIXES) for given, made in table_.items()}


def _golden(profile: str) -> None:
    pairs = GOLDEN[profile]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "part").select(_text("p_partkey").alias("p_partkey"), _picked(F.col("p_partkey"), list(pairs)).alias("v"))
        return typed(df, "p_partkey", column("v", "value", "string", format=profile))

    QUERIES[f"format_{profile}"] = run
    SQL[f"format_{profile}"] = f"SELECT p_partkey, {_by_place('p_partkey', list(pairs.values()), 'VARCHAR')} AS value FROM part"


for _profile in GOLDEN:
    _golden(_profile)


@query("""
SELECT o_orderkey, o_orderstatus = 'F' AS replaced, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus = 'F' END AS extended FROM orders
WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, NULL, true FROM orders WHERE o_orderstatus = 'P'
""")
def parse_boolean_lists(spark, sf_dir):
    """A column's own tokens in place of the global ones, and beside them."""
    df = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), F.lower("o_orderstatus").alias("v"))
    own = column("v", "replaced", "boolean", true_values=["F"], false_values=["O"])
    more = column("v", "extended", "boolean", true_values=["F"], false_values=["O"], boolean_values_mode="extend")
    return typed(df, "o_orderkey", own, more, globals_={"true_values": ["P"], "false_values": ["Q"]})


@query("""
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:00') END AS "at" FROM events
""")
def parse_offsets_and_patterns(spark, sf_dir):
    """A date whose offset must be legal though only its day counts, and instants by a pattern of the author's."""
    offset = F.when(F.col("event_id") % 3 == 0, "-05:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("+18:30")
    custom = F.concat(F.date_format("ts", "dd/yyyy/MM HH'h'mm"), F.when(F.col("event_id") % 4 == 0, "x").otherwise(""))
    df = table(spark, sf_dir, "events").select(_text("event_id").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("o"), custom.alias("c"))
    day, at = column("o", "day", "date", formats=["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"]), column("c", "at", "timestamp", formats=["dd/yyyy/MM HH'h'mm"])
    return typed(df, "event_id", day, at).select("event_id", _text("day").alias("day"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '1999-12-31' ELSE '2024-02-29' END AS day, CASE WHEN c_custkey % 2 = 0 THEN '2000-01-01 00:00:00' ELSE '2024-02-29 01:02:03' END AS "at",
  CASE WHEN c_custkey % 2 = 0 THEN '2000-01-01 10:00:00' ELSE '2024-02-29 01:02:03' END AS instant, CASE WHEN c_custkey % 2 = 0 THEN '-1.50' ELSE '7.25' END AS amount,
  CASE WHEN c_custkey % 2 = 0 THEN '4869' ELSE '00' END AS bytes FROM customer
""")
def typed_defaults(spark, sf_dir):
    """Defaults of dates, times, decimals and bytes, where every other value is missing."""
    odd = F.col("c_custkey") % 2 == 1
    given = {"d": "2024-02-29", "t": "2024-02-29 01:02:03", "n": "7.25", "b": "AA=="}
    df = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), *[F.when(odd, v).otherwise("").alias(k) for k, v in given.items()])
    default = lambda v: {"is_nullable": False, "default_on_null": v}
    out = typed(
        df, "c_custkey", column("d", "day", "date", **default("1999-12-31")), column("t", "at", "timestamp_ntz", **default("2000-01-01T00:00:00")),
        column("t", "instant", "timestamp", **default("2000-01-01T10:00:00Z")), column("n", "amount", "decimal(9,2)", **default(-1.5)), column("b", "bytes", "binary", **default("SGk=")),
    )
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    instant = F.when(F.col("c_custkey") % 2 == 1, F.date_format("instant", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(F.to_utc_timestamp("instant", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
    return out.select("c_custkey", _text("day").alias("day"), shown("at"), instant.alias("instant"), _text("amount").alias("amount"), F.hex("bytes").alias("bytes"))


#: Text of a number, and what it becomes as float, decimal(4,1) and integer (None: a parse error).
NUMBERS = [
    ("1.25", 1.25, "1.3", None), ("-0.5", -0.5, "-0.5", None), ("007", 7.0, "7.0", 7), ("+8.", 8.0, "8.0", 8), (".5", 0.5, "0.5", None), ("1e2", 100.0, "100.0", None), ("999.94", None, "999.9", None),
    ("999.95", None, None, None), ("12345", 12345.0, None, 12345), ("1d", None, None, None), ("1f", None, None, None), ("0x1p3", None, None, None), (".", None, None, None), ("+.", None, None, None),
    (".e2", None, None, None), ("NaN", None, None, None), ("Infinity", None, None, None), ("1,000", None, None, None), ("١٢", None, None, None), ("1e39", None, None, None), ("1e-60", None, "0.0", None),
    ("0e-10000", 0.0, "0.0", None), ("--1", None, None, None), ("1 2", None, None, None), ("2147483648", 2147483648.0, None, None),
]


@query(f"""
SELECT p_partkey, {_by_place("p_partkey", [None if t.startswith("999") else f for t, f, _, _ in NUMBERS], "DOUBLE")} AS as_float,
  {_by_place("p_partkey", [d for _, _, d, _ in NUMBERS], "VARCHAR")} AS as_decimal, {_by_place("p_partkey", [i for _, _, _, i in NUMBERS], "INTEGER")} AS as_integer FROM part
""")
def parse_number_grammar(spark, sf_dir):
    """Every shape of number text, taken or not; floats near a thousand are left out, as they have no short decimal text."""
    df = table(spark, sf_dir, "part").select(_text("p_partkey").alias("p_partkey"), _picked(F.col("p_partkey"), [t for t, *_ in NUMBERS]).alias("v"))
    out = typed(df, "p_partkey", column("v", "as_float", "float"), column("v", "as_decimal", "decimal(4,1)"), column("v", "as_integer", "int"))
    near = F.col("as_float").between(999, 1000)
    return out.select("p_partkey", F.when(~near, F.col("as_float").cast("double")).alias("as_float"), _text("as_decimal").alias("as_decimal"), "as_integer")


#: Hexadecimal text and base64 text, and the bytes they stand for.
HEXES = [("4A6f", "4A6F"), ("F", "0F"), ("ABC", "0ABC"), ("", ""), ("GG", None), ("0x41", None), ("4 1", None)]
BASES = [("SGk=", "4869"), ("SGk", None), ("SG k=", None), ("SGk-", None), ("", ""), ("AA==", "00"), ("====", None)]


@query(f"SELECT s_suppkey, {_by_place('s_suppkey', [b for _, b in HEXES], 'VARCHAR')} AS hexed, {_by_place('s_suppkey', [b for _, b in BASES], 'VARCHAR')} AS based FROM supplier")
def parse_binary_grammar(spark, sf_dir):
    key = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("s_suppkey"), _picked(key, [h for h, _ in HEXES]).alias("h"), _picked(key, [b for b, _ in BASES]).alias("b"))
    out = typed(df, "s_suppkey", column("h", "hexed", "binary", encoding="hex", empty_is_null=False), column("b", "based", "binary", empty_is_null=False))
    return out.select("s_suppkey", F.hex("hexed").alias("hexed"), F.hex("based").alias("based"))


@query("SELECT n_nationkey, n_name AS \"a.b`c\", upper(n_name) AS \" Up \" FROM nation")
def odd_names(spark, sf_dir):
    """Names with dots, backticks and spaces are literal."""
    df = table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("n_nationkey"), F.col("n_name").alias("a.b`c"))
    return typed(df, "n_nationkey", column("a.b`c", "a.b`c", "string"), column("a.b`c", " Up ", "string", format="upper"))


@query("SELECT s_suppkey, NULL::INTEGER AS gone, 'x' AS filled FROM supplier")
def missing_source(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("s_suppkey"))
    return typed(df, "s_suppkey", column("not_there", "gone", "int"), column("nor_there", "filled", "string", is_nullable=False, default_on_null="x"), on_missing_source="warn")


@query("SELECT n_nationkey::BIGINT AS nation_id, n_name, 'bench' AS config_id, 1::BIGINT AS records, upper(n_name) AS value FROM nation")
def mapped_keys(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("n_nationkey"), "n_name")
    config = contract(column("n_nationkey", "nation_id", "long"), column("n_name", "a", "string", format="upper", audit=True), column("n_name", "b", "string"))
    results = parser.parse_dataframe(df, config, key_columns=["n_nationkey", "n_name"]).results_df
    return results.select("nation_id", "n_name", F.col("burnish_config.id").alias("config_id"), F.size("burnish_parse_results").cast("long").alias("records"), F.col("burnish_parse_results")[0]["parsed_value"].alias("value"))


@query("""
SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity::INTEGER END AS quantity, l_discount AS discount,
  l_returnflag = 'R' AS returned, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END::INTEGER AS errors FROM lineitem
""")
def typed_lineitem(spark, sf_dir):
    """The flagship: a whole table from text to types, with all failures collected."""
    parsed = typed(bronze_lineitem(spark, sf_dir), "l_orderkey", *LINEITEM, error_mode="collect")
    return parsed.select("l_orderkey", "l_linenumber", "quantity", "discount", "returned", _text("shipped").alias("shipped"), F.size("burnish_parse_errors").alias("errors"))


LINEITEM = [
    column("l_linenumber", "l_linenumber", "int"),
    column("l_quantity", "quantity", "int", on_parse_error="fail"),
    column("l_discount", "discount", "double"),
    column("l_returnflag", "returned", "boolean", true_values=["R"], false_values=["A", "N"]),
    column("l_shipdate", "shipped", "date"),
]


def bronze_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.when(F.col("l_orderkey") % 7 == 0, "oops").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        _text("l_orderkey").alias("l_orderkey"), _text("l_linenumber").alias("l_linenumber"), quantity.alias("l_quantity"), _text("l_discount").alias("l_discount"),
        F.concat(F.lit("  "), F.col("l_returnflag")).alias("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"),
    )
