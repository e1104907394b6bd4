"""Rows of text cells against declared contracts: which columns match, which cells fail, and the verdict of each resource.

A contract is data: a row for each declared field (resource_id, pos, name, type and what narrows it). One plan checks the
rows of all resources; rows are not exploded into cells, only failures are. Results carry counts and row numbers, never values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm
from ..functions.types import DATETIME_FORMATS, fits_any_format, fits_format, plain_number
from ..session import written

MAX_ERROR_RATE = 0.01
ROWS_KEPT = 5
#: Contract fields that are sent to every executor; larger contracts are joined by a shuffle.
MAX_BROADCAST_FIELDS = 200_000
#: Distinct checks of all contracts up to which each is an expression of its own.
SPELLED_OUT = 64
#: What narrows a field beyond its name and type, with the kind of each column.
NARROWING = {
    "format": "string", "decimalChar": "string", "groupChar": "string", "trueValues": "array<string>", "falseValues": "array<string>", "required": "boolean", "minLength": "int",
    "maxLength": "int", "minimum": "string", "maximum": "string", "pattern": "string", "enum": "array<string>",
}


def as_contract(df: DataFrame) -> DataFrame:
    """df (resource_id, pos, name, type, ...) with every column of a contract; those it lacks are null."""
    return df.select("resource_id", "pos", "name", "type", *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in NARROWING.items()])


def gathered(contract: DataFrame) -> DataFrame:
    """One row a resource: its fields in order. A contract has few fields beside its resource's rows."""
    field = F.struct("pos", *[c for c in contract.columns if c not in ("resource_id", "pos")])
    return contract.groupBy("resource_id").agg(F.array_sort(F.collect_list(field)).alias("fields"))


def last_place(array: Column, x: Column) -> Column:
    """The last index (from 1) of x in an array, 0 if it is not there: of columns of one name the last counts."""
    back = F.array_position(F.reverse(array), x)
    return F.when(back > 0, F.size(array) - back + 1).otherwise(F.lit(0)).cast("int")


def match_fields(names: Column, header: Column) -> Column:
    """Struct of exact, spelling (pairs that are equal after norm), missing and undeclared names."""
    cleaned = F.transform(header, norm)
    near = F.filter(names, lambda n: ~F.array_contains(header, n) & F.array_contains(cleaned, norm(n)))
    pairs = F.transform(near, lambda n: F.named_struct(F.lit("declared"), n, F.lit("column"), F.element_at(header, last_place(cleaned, norm(n)))))
    exact = F.filter(names, lambda n: F.array_contains(header, n))
    used = F.concat(exact, F.transform(pairs, lambda p: p["column"]))
    return F.struct(exact.alias("exact"), pairs.alias("spelling"), F.filter(names, lambda n: ~F.array_contains(F.concat(exact, near), n)).alias("missing"), F.filter(header, lambda h: ~F.array_contains(used, h)).alias("undeclared"))


def tests_of(value: Column, f) -> tuple[Column, dict[str, Column]]:
    """Whether an unempty value is of a field's type, and by kind whether it breaks a constraint (null: no such constraint). f: a struct, or a dict of columns."""
    default = lambda c, x: F.coalesce(c, F.array(*map(F.lit, x)))
    number = plain_number(value, f["decimalChar"], f["groupChar"])
    iso = F.coalesce(*[F.when(fits_format(value, x), F.lit(True)) for x in DATETIME_FORMATS if x[2:4] == "-%" or x.startswith("%Y-")], F.lit(False))
    kind = f["type"]
    good = (
        F.when(kind == "integer", F.when(f["groupChar"].isNotNull(), F.replace(value, f["groupChar"], F.lit(""))).otherwise(value).rlike("^[+-]?[0-9]+$"))
        .when(kind == "number", number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
        .when(kind == "boolean", F.array_contains(F.concat(default(f["trueValues"], ["true", "True", "TRUE", "1"]), default(f["falseValues"], ["false", "False", "FALSE", "0"])), value))
        .when(kind == "date", F.when(f["format"].isNull(), fits_format(value, "%Y-%m-%d")).otherwise(fits_any_format(value, f["format"])))
        .when(kind == "datetime", F.when(f["format"].isNull(), iso).otherwise(fits_any_format(value, f["format"])))
        .when(kind == "time", value.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$"))
        .when(kind == "object", F.coalesce(value.rlike(r"^\s*\{") & F.try_parse_json(value).isNotNull(), F.lit(False)))
        .otherwise(F.lit(True))
    )
    as_number = F.when(kind.isin("integer", "number"), number.try_cast("double"))
    below = F.coalesce(F.when(as_number.isNotNull(), as_number < f["minimum"].try_cast("double")).otherwise(value < f["minimum"]), F.lit(False))
    above = F.coalesce(F.when(as_number.isNotNull(), as_number > f["maximum"].try_cast("double")).otherwise(value > f["maximum"]), F.lit(False))
    tests = {
        "minLength": F.char_length(value) < f["minLength"], "maxLength": F.char_length(value) > f["maxLength"], "minimum": below, "maximum": above,
        "pattern": ~F.regexp_like(value, F.concat(F.lit("^(?:"), f["pattern"], F.lit(")$"))), "enum": ~F.array_contains(f["enum"], value),
    }
    return F.coalesce(good, F.lit(False)), tests


def failures(value: Column, f: Column) -> Column:
    """What an unempty value breaks of a field: `type`, or else the constraints it breaks."""
    good, tests = tests_of(value, f)
    broken = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return F.when(~good, F.array(F.lit("type"))).otherwise(broken)


#: What a failure is: its field and its kind.
FAILURE = "struct<field:string,kind:string>"
#: Constraints by kind, and the column of a contract that states each.
STATED = {"minLength": "minLength", "maxLength": "maxLength", "minimum": "minimum", "maximum": "maximum", "pattern": "pattern", "enum": "enum"}


def spelled_out(check, number: int) -> list[Column]:
    """The failures of one known check (at, f) as columns, null where there is none: its type, format and constraints are constants, so Spark compiles what is left of them."""
    value = F.coalesce(F.try_element_at("cells", F.lit(check["at"])), F.lit(""))
    literal = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, list) and v else F.lit(None if isinstance(v, list) else v)).cast(kind)
    f = {"type": F.lit(check["f"]["type"])} | {c: literal(check["f"][c], k) for c, k in NARROWING.items()}
    good, tests = tests_of(value, f)
    asked = F.array_contains("check_nos", number) & (value != "")
    failure = lambda kind: F.struct(F.lit(check["f"]["name"]).alias("field"), F.lit(kind).alias("kind")).cast(FAILURE)
    return [F.when(asked & ~good, failure("type"))] + [F.when(asked & good & F.coalesce(tests[k], F.lit(False)), failure(k)) for k, c in STATED.items() if check["f"][c] is not None]


@dataclass(frozen=True)
class Checked:
    """totals: resource_id, member, rows, ragged_rows, cells_checked. errors: resource_id, field, kind, errors, first_rows. matches: by resource."""

    totals: DataFrame
    errors: DataFrame
    matches: DataFrame


def check(cells: DataFrame, contract: DataFrame) -> Checked:
    """Every row of cells (resource_id, member, row_no, header, cells) against the contract of its resource."""
    fields = gathered(contract)
    if contract.limit(MAX_BROADCAST_FIELDS + 1).count() <= MAX_BROADCAST_FIELDS:
        fields = F.broadcast(fields)
    # headers are told apart by a hash; which cell each field is in is worked out once a header, not once a row
    keyed = cells.withColumn("header_key", F.xxhash64("header"))
    header, cleaned = F.col("header"), F.transform("header", norm)
    place = lambda f: F.when(F.array_contains(header, f["name"]), last_place(header, f["name"])).otherwise(last_place(cleaned, norm(f["name"])))
    checks = F.filter(F.transform(F.filter("fields", lambda f: f["type"] != "any"), lambda f: F.struct(place(f).alias("at"), f.alias("f"))), lambda c: c["at"] > 0)
    seen = keyed.groupBy("resource_id", "header_key").agg(F.first("header").alias("header"), F.min(F.struct("member", "row_no")).alias("first"))
    heads = written(seen.join(fields, "resource_id").withColumn("checks", checks), "heads")
    matches = heads.groupBy("resource_id").agg(F.min_by(F.struct("header", "fields"), "first").alias("h")).select("resource_id", match_fields(F.transform("h.fields", lambda f: f["name"]), F.col("h.header")).alias("m")).select("resource_id", "m.*")
    heads = heads.select("resource_id", "header_key", "checks")
    single = heads.select(F.explode("checks").alias("c"))
    distinct = single.select(F.to_json("c", {"ignoreNullFields": "false"}).alias("text"), "c").dropDuplicates(["text"]).limit(SPELLED_OUT + 1).orderBy("text").collect()
    if len(distinct) <= SPELLED_OUT:  # a few checks, however many rows: each is compiled for itself
        heads = heads.select("resource_id", "header_key", F.size("checks").alias("n_checks"), F.transform("checks", lambda c: F.array_position(F.array(*[F.lit(d.text) for d in distinct]).cast("array<string>"), F.to_json(c, {"ignoreNullFields": "false"})).cast("int")).alias("check_nos"))
        failing = F.array(*[x for i, d in enumerate(distinct, 1) for x in spelled_out(d.c, i)]).cast(f"array<{FAILURE}>")
    else:
        heads = heads.withColumn("n_checks", F.size("checks"))
        value = lambda c: F.coalesce(F.try_element_at("cells", c["at"]), F.lit(""))
        failing = F.flatten(F.transform("checks", lambda c: F.when(value(c) == "", F.array().cast(f"array<{FAILURE}>")).otherwise(F.transform(failures(value(c), c["f"]), lambda k: F.struct(c["f"]["name"].alias("field"), k.alias("kind"))))))
    small = len(distinct) <= SPELLED_OUT or heads.select(F.explode("checks")).limit(MAX_BROADCAST_FIELDS + 1).count() <= MAX_BROADCAST_FIELDS
    placed = keyed.join(F.broadcast(heads) if small and heads.limit(MAX_BROADCAST_FIELDS + 1).count() <= MAX_BROADCAST_FIELDS else heads, ["resource_id", "header_key"], "left")
    # one pass over the cells: what each row gives is written, and both results are made of that
    rows = written(placed.select("resource_id", "member", "row_no", (F.size("cells") != F.size("header")).alias("ragged"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.when(F.col("n_checks") > 0, failing).alias("failing")), "checked")
    totals = rows.groupBy("resource_id", "member").agg(F.count("*").alias("rows"), F.count_if("ragged").alias("ragged_rows"), F.sum("n_checks").cast("bigint").alias("cells_checked"))
    broken = rows.select("resource_id", "member", "row_no", F.explode("failing").alias("x")).where("x is not null").select("resource_id", "member", "row_no", "x.*")
    return Checked(totals, first_rows(broken, ["resource_id", "field", "kind"]), matches)


def first_rows(failing: DataFrame, key: list[str], keep: int = ROWS_KEPT) -> DataFrame:
    """Count and the first row numbers of each key. A window's limit is applied in each task, so a field of only failures gathers no list of them."""
    order = Window.partitionBy(*key).orderBy("member", "row_no")
    first = failing.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row_no"))), lambda x: x["row_no"]).alias("first_rows"))
    return failing.groupBy(*key).agg(F.count("*").alias("errors")).join(first, key)


def verdicts(checked: Checked, max_error_rate: float = MAX_ERROR_RATE) -> DataFrame:
    """One verdict a resource: it passes if no field is missing, no column undeclared and few cells fail."""
    totals = checked.totals.groupBy("resource_id").agg(F.sum("rows").alias("rows"), F.sum("ragged_rows").alias("ragged_rows"), F.sum("cells_checked").alias("cells_checked"))
    bad = checked.errors.groupBy("resource_id").agg(F.sum("errors").alias("bad"))
    out = totals.join(checked.matches, "resource_id").join(bad, "resource_id", "left").withColumn("cells_with_errors", F.coalesce("bad", F.lit(0)).cast("bigint"))
    rate = F.coalesce(F.try_divide(F.col("cells_with_errors").cast("double"), F.col("cells_checked")), F.lit(0.0))
    passed = (F.size("missing") == 0) & (F.size("undeclared") == 0) & (rate <= max_error_rate)
    return out.select("resource_id", "rows", "ragged_rows", "missing", "undeclared", "cells_checked", "cells_with_errors", F.round(rate, 6).alias("error_rate"), passed.alias("pass"))


def summarise_members(tables: DataFrame) -> DataFrame:
    """tables (resource_id, member, rows, ragged_rows, decode_errors, header, encoding, delimiter, fmt) by resource. Decode errors are a running count: the largest holds."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    return tables.groupBy("resource_id").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum("ragged_rows").alias("ragged_rows"), F.max("decode_errors").alias("decode_errors"), F.count_distinct("header").alias("distinct_headers"), F.max(F.size(F.filter("header", lambda h: h == ""))).alias("columns_without_name"), sets("encoding").alias("encodings"), sets("delimiter").alias("delimiters"), sets("fmt").alias("formats"))


CONTRACT = T.StructType([T.StructField("resource_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
