"""Any table as rows of text cells, and the types that columns of text fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import share
from ..functions.types import BOOLEAN_PAIRS, COMMA_DECIMAL, COMMA_NUMBER, DATE_FORMATS, DATETIME_FORMATS, DOT_DECIMAL, DOT_NUMBER, GROUPED, GROUPED_START, INTEGER, LEADING_ZERO, fits_format
from ..session import written

SAMPLE_ROWS = 5000
FORMAT_VALUES = 500
MAX_NAME = 512


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as text: null is empty, whole doubles have no fraction, dates are ISO, nested values are JSON."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def as_cells(df: DataFrame, resource: str, row_no: Column, member: str = "", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """resource_id, member, row_no, header and cells (text, in column order) of a typed table."""
    fields = [f for f in df.schema.fields if f.name not in leave_out]
    return df.select(F.lit(resource).alias("resource_id"), F.lit(member).alias("member"), row_no.cast("bigint").alias("row_no"), F.array(*[F.lit(f.name) for f in fields]).alias("header"), F.array(*[cell(F.col(f"`{f.name}`"), f.dataType) for f in fields]).alias("cells"))


def with_ordinals(df: DataFrame, *keys: str) -> DataFrame:
    """df with row_no from 1 in the order of keys, without gathering rows in one task: rows are dealt by range, and
    numbered within their range after the rows of the ranges before it."""
    dealt = written(df.repartitionByRange(*keys).withColumn("range_no", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range_no").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*keys))
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "range_no").withColumn("row_no", F.col("start") + F.col("inside")).drop("range_no", "start", "inside")


def records_as_rows(records: DataFrame, order: str, first: int = 1000) -> DataFrame:
    """Records (resource_id, `order`, record: map of text) as header and cells.

    The header is the union of keys of a resource's first records, in order of appearance; missing keys give empty
    cells, and a record with a key that only comes later has one empty cell more. A resource of empty records has an empty header.
    """
    # the window's limit is applied in each task before records of a resource meet
    nth = F.row_number().over(Window.partitionBy("resource_id").orderBy(order))
    early = records.select("resource_id", order, F.map_keys("record").alias("keys")).withColumn("nth", nth).where(F.col("nth") <= first)
    place = early.select("resource_id", "nth", F.posexplode("keys").alias("at", "key")).groupBy("resource_id", "key").agg(F.min(F.struct("nth", "at")).alias("first"))
    header = place.groupBy("resource_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("header"))
    rows = records.join(header, "resource_id", "left").withColumn("header", F.coalesce("header", F.array().cast("array<string>")))
    late = F.size(F.array_except(F.map_keys("record"), F.col("header"))) > 0
    cells = F.concat(F.transform("header", lambda k: F.coalesce(F.col("record")[k], F.lit(""))), F.when(late, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return rows.select("resource_id", order, "header", cells.alias("cells"))


def columns(cells: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each cell of the sampled rows: resource_id, pos (from 0), name, row_no and value. Short rows have no cell there."""
    return cells.where(F.col("row_no") <= sample).select("resource_id", "row_no", F.posexplode(F.arrays_zip("header", "cells")).alias("pos", "x"), F.size("cells").alias("width")).where("pos < width").select("resource_id", "pos", F.col("x.header").alias("name"), "row_no", F.col("x.cells").alias("value"))


def format_shares(values: DataFrame, formats: tuple[str, ...], key: list[str]) -> DataFrame:
    """For each key and format: its share among the first 500 non-empty values (columns: key, row_no, value)."""
    first = values.where("value <> ''").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("row_no"))).where(F.col("nth") <= FORMAT_VALUES)
    flags = first.groupBy(*key).agg(*[F.avg(fits_format(F.col("value"), f).cast("double")).alias(f"f{i}") for i, f in enumerate(formats)])
    return flags.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(f).alias("format"), F.col(f"f{i}").alias("share")) for i, f in enumerate(formats)])).alias("x")).select(*key, "x.*")


def best_format(values: DataFrame, formats: tuple[str, ...], key: list[str], minimum: float = 0.5) -> DataFrame:
    """The format of the largest share of each key (the first of equal ones); null below the minimum."""
    best = format_shares(values, formats, key).groupBy(*key).agg(F.max_by(F.struct("format", "share"), F.struct("share", -F.col("nth"))).alias("x"))
    return best.select(*key, F.when(F.col("x.share") >= minimum, F.col("x.format")).alias("format"), F.col("x.share").alias("share"))


def infer_types(values: DataFrame, key: list[str]) -> DataFrame:
    """The narrowest type that every non-empty value of a key fits: type, format, decimalChar, groupChar, trueValues, falseValues, empty_share."""
    v = F.col("value")
    filled = v != ""
    every = lambda p: F.coalesce(F.bool_and(F.when(filled, v.rlike(p))), F.lit(True))
    some = lambda p: F.coalesce(F.bool_or(F.when(filled, v.rlike(p))), F.lit(False))
    known = sorted({x for t, f in BOOLEAN_PAIRS for x in t + f})
    flags = values.groupBy(*key).agg(
        F.count_if(filled).alias("filled"), F.count("*").alias("cells"), some(LEADING_ZERO).alias("zero"), every(INTEGER).alias("whole"), every(DOT_NUMBER).alias("dot"),
        every(COMMA_NUMBER).alias("comma"), some(GROUPED_START).alias("grouped"), F.coalesce(F.bool_and(F.when(filled, v.isin(known))), F.lit(True)).alias("known"), F.collect_set(F.when(v.isin(known), v)).alias("seen"),
    )
    dates = {n: best_format(values, f, key, 1.0).select(*key, F.col("format").alias(n)) for n, f in (("date", DATE_FORMATS), ("datetime", DATETIME_FORMATS))}
    out = flags.join(dates["date"], key, "left").join(dates["datetime"], key, "left")
    lit_set = lambda x: F.array(*map(F.lit, x))
    pair = F.coalesce(*[F.when((F.size(F.array_except("seen", lit_set(t + f))) == 0) & F.arrays_overlap("seen", lit_set(t)) & F.arrays_overlap("seen", lit_set(f)), F.struct(F.array_sort(F.array_intersect("seen", lit_set(t))).alias("t"), F.array_sort(F.array_intersect("seen", lit_set(f))).alias("f"))) for t, f in BOOLEAN_PAIRS])
    kind = (F.when(F.col("filled") == 0, "any").when(F.col("zero"), "string").when(F.col("whole"), "integer").when(F.col("dot") | F.col("comma"), "number")
            .when(F.col("date").isNotNull(), "date").when(F.col("datetime").isNotNull(), "datetime").when(F.col("known") & pair.isNotNull(), "boolean").otherwise("string"))
    out = out.withColumn("type", kind).withColumn("pair", F.when(F.col("type") == "boolean", pair))
    comma = (F.col("type") == "number") & ~F.col("dot")
    return out.select(*key, "type", F.when(F.col("type") == "date", F.col("date")).when(F.col("type") == "datetime", F.col("datetime")).alias("format"), F.when(comma, ",").alias("decimalChar"), F.when(comma & F.col("grouped"), ".").alias("groupChar"), F.col("pair.t").alias("trueValues"), F.col("pair.f").alias("falseValues"), share(F.col("cells") - F.col("filled"), F.col("cells")).alias("sampleEmptyShare"))


def observed_schema(cells: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """A field for each column of each resource's header, with a clean name and what was wrong with the given one."""
    headers = cells.groupBy("resource_id").agg(F.min_by("header", "row_no").alias("header"))
    fields = headers.select("resource_id", F.posexplode("header").alias("pos", "name"))
    found = fields.join(infer_types(columns(cells, sample), ["resource_id", "pos"]), ["resource_id", "pos"], "left")
    clean = F.trim(F.regexp_replace("name", r"[\x00-\x1f\x7f]+", " "))
    name = F.when(clean == "", F.concat(F.lit("_column_"), (F.col("pos") + 1).cast("string"))).otherwise(F.left(clean, F.lit(MAX_NAME)))
    return found.select("resource_id", "pos", name.alias("name"), F.coalesce("type", F.lit("any")).alias("type"), "format", "decimalChar", "groupChar", "trueValues", "falseValues", "sampleEmptyShare", (clean != F.col("name")).alias("headerNameCleaned"), (clean == "").alias("headerWithoutName"), F.when(F.char_length(clean) > MAX_NAME, F.char_length(clean)).alias("headerNameCut"))


def complete_formats(contract: DataFrame, values: DataFrame) -> DataFrame:
    """contract (resource_id, pos, name, type, format, decimalChar, groupChar, trueValues, falseValues) with formats that are
    left open filled by the majority of sampled values (resource_id, pos, row_no, value), and `inferred`, what was filled."""
    key = ["resource_id", "pos"]
    v, filled = F.col("value"), values.where("value <> ''")
    counts = filled.groupBy(*key).agg(F.count_if(v.rlike(COMMA_DECIMAL)).alias("n_comma"), F.count_if(v.rlike(DOT_DECIMAL)).alias("n_dot"), F.bool_or(v.rlike(GROUPED)).alias("any_grouped"), F.collect_set(F.when(v.isin(sorted({x for t, f in BOOLEAN_PAIRS for x in t + f})), v)).alias("seen"))
    best = {n: best_format(values, f, key).select(*key, F.col("format").alias(n)) for n, f in (("as_date", DATE_FORMATS), ("as_datetime", DATETIME_FORMATS), ("as_either", DATE_FORMATS + DATETIME_FORMATS))}
    out = contract.join(counts, key, "left")
    for b in best.values():
        out = out.join(b, key, "left")
    open_format = F.col("format").isNull()
    late = (F.col("type") == "date") & open_format & F.col("as_date").isNull() & F.col("as_datetime").isNotNull()
    fmt = F.when(open_format & (F.col("type") == "date"), F.coalesce("as_date", "as_datetime")).when(open_format & (F.col("type") == "datetime"), F.col("as_either"))
    comma = (F.col("type") == "number") & F.col("decimalChar").isNull() & F.coalesce(F.col("n_comma") > F.col("n_dot"), F.lit(False))
    lit_set = lambda x: F.array(*map(F.lit, sorted(x)))
    pair = F.coalesce(*[F.when(F.arrays_overlap("seen", lit_set(t)) & F.arrays_overlap("seen", lit_set(f)), F.struct(lit_set(t).alias("t"), lit_set(f).alias("f"))) for t, f in BOOLEAN_PAIRS])
    pair = F.when((F.col("type") == "boolean") & F.col("trueValues").isNull(), pair)
    group = F.when(comma & F.col("any_grouped"), ".")
    told = F.struct(F.when(late, "datetime (date values carry a time)").alias("type"), fmt.alias("format"), F.when(comma, ",").alias("decimalChar"), group.alias("groupChar"), pair["t"].alias("trueValues"))
    new = {"type": F.when(late, "datetime").otherwise(F.col("type")), "format": F.coalesce("format", fmt), "decimalChar": F.when(comma, ",").otherwise(F.col("decimalChar")), "groupChar": F.coalesce(group, F.col("groupChar")), "trueValues": F.coalesce("trueValues", pair["t"]), "falseValues": F.coalesce("falseValues", pair["f"])}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in contract.columns], told.alias("inferred"))
