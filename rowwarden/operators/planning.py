"""What to check next and under which contract: precedence of schemas, reasons for work, the queue, copies of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, digest

#: Kinds of schemas from the one preferred, and statuses of an extracted one that may be used.
KINDS = ("attached", "declared", "extracted", "described", "datastore")
USABLE_EXTRACTED = ("extracted", "verified")
#: Reasons for work, the most pressing first.
REASONS = ("new", "schema", "changed", "error", "reader", "rotation")
ROTATION_DAYS = 28
HISTORY = 12
#: Formats from the one preferred.
FORMAT_ORDER = ("csv", "zip", "parquet", "xlsx", "ods", "xls", "json", "xml")


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    """The place (from 0) of a value in a fixed order; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def select_schema(schemas: DataFrame) -> DataFrame:
    """The schema a check uses: one row of (dataset, resource_id, kind, status, ...) for each resource."""
    usable = schemas.where(F.col("kind").isin(*KINDS) & ((F.col("kind") != "extracted") | F.coalesce(F.col("status").isin(*USABLE_EXTRACTED), F.lit(False))))
    order = Window.partitionBy("dataset", "resource_id").orderBy(rank_of(F.col("kind"), KINDS))
    return usable.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def fingerprints(contract: DataFrame) -> DataFrame:
    """resource_id and fingerprint: 16 digits over what a check depends on (names, types, formats, constraints), in order."""
    core = [c for c in contract.columns if c not in ("resource_id", "pos", "description")]
    fields = contract.groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("pos", *core))).alias("fields"))
    return fields.select("resource_id", digest(F.transform("fields", lambda f: F.struct(*[f[c].alias(c) for c in core]))).alias("fingerprint"))


def reason(now: Column, head: bool = False) -> Column:
    """Why a file is due, or null. Over tables left-joined to earlier checks (columns of these with prev_); with `head`
    also whether the server's answer differs, asked only for rows that nothing else makes due."""
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    checked = F.coalesce(F.col("prev_validated_at"), F.col("prev_checked_at"))
    out = (
        F.when(F.col("prev_id").isNull(), "new")
        .when(differs("fingerprint"), "schema")
        .when(differs("url") | differs("last_modified") | differs("size"), "changed")
        .when(F.col("prev_status") == "error", "error")
        .when((F.col("prev_status") == "not-tabular") & F.coalesce(F.col("prev_not_tabular_kind") == "", F.col("prev_not_tabular_kind").isNull()), "reader")
        .when(checked.isNull() | (checked < now - F.expr(f"INTERVAL {ROTATION_DAYS} DAYS")), "rotation")
    )
    if head:
        moved = lambda c: F.coalesce((F.col(f"head_{c}") != "") & (F.col(f"prev_{c}") != "") & (F.col(f"head_{c}") != F.col(f"prev_{c}")), F.lit(False))
        out = out.when(moved("etag") | moved("http_last_modified") | moved("content_length"), "changed")
    return out


def queue(tables: DataFrame, validation: DataFrame, now: Column) -> DataFrame:
    """id, dataset, reason and since of the files that are due, those of datasets on hold left out, in order of work."""
    prev = validation.select([F.col(c).alias(f"prev_{c}") for c in validation.columns])
    due = tables.where(~F.coalesce("hold", F.lit(False))).join(prev, F.col("id") == F.col("prev_id"), "left").withColumn("reason", reason(now)).where("reason is not null")
    return due.select("id", "dataset", "reason", F.col("prev_validated_at").alias("since"), "pos").orderBy(rank_of(F.col("reason"), REASONS), F.asc_nulls_first("since"), "pos")


def unfinished(queued: DataFrame, done: DataFrame) -> DataFrame:
    return queued.join(done, "id", "left_anti")


def still_there(queued: DataFrame, tables: DataFrame) -> DataFrame:
    """The queue with `gone` for files that no longer exist (they count as done)."""
    return queued.join(tables.select("id", F.lit(False).alias("here")), "id", "left").withColumn("gone", F.col("here").isNull()).drop("here")


def copies(tables: DataFrame) -> DataFrame:
    """id and copy_of: files of a dataset with the name, declared size and file name of an earlier one (pos).

    The first of each group is a pre-aggregated minimum, joined back to the group, however many copies there are.
    """
    key = ["dataset", "name", "bytes", "file"]
    sized = tables.withColumn("bytes", F.col("size").cast("string").try_cast("bigint")).where("bytes is not null").withColumn("file", basename(F.col("url")))
    first = sized.groupBy(*key).agg(F.min_by("id", "pos").alias("copy_of"), F.count("*").alias("files")).where("files > 1").drop("files")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return sized.alias("a").join(first.alias("b"), same).where("id <> copy_of").select("id", "copy_of")


def copied_results(validation: DataFrame, copy: DataFrame) -> DataFrame:
    """validation with the first file's result for copies that were not read or failed while the first did not."""
    first = validation.select(F.col("id").alias("copy_of"), F.struct(*[c for c in validation.columns if c != "id"]).alias("first"))
    j = validation.join(copy, "id", "left").join(first, "copy_of", "left")
    use = F.col("first").isNotNull() & (F.coalesce(F.col("status"), F.lit("error")) == "error") & (F.col("first.status") == "ok")
    return j.select("id", *[F.when(use, F.col(f"first.{c}")).otherwise(F.col(c)).alias(c) for c in validation.columns if c != "id"], F.when(use, F.col("copy_of")).alias("copy_of"))


def compared_copies(copy: DataFrame, validation: DataFrame) -> DataFrame:
    """One row: copies, files they are of, and how many pairs that were both downloaded are byte for byte the same."""
    sha = lambda k, n: validation.select(F.col("id").alias(k), F.col("sha256").alias(n))
    j = copy.join(sha("id", "a"), "id", "left").join(sha("copy_of", "b"), "copy_of", "left")
    return j.agg(F.count("*").alias("files"), F.count_distinct("copy_of").alias("of_files"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.count_if(F.col("a") != F.col("b")).alias("different"))


def kept_readings(census: DataFrame, previous: DataFrame, now: Column, days: int = ROTATION_DAYS) -> DataFrame:
    """census (dataset, unreachable) with what becomes of it: read, keep (an earlier reading of at most `days`) or hold."""
    j = census.join(previous.select("dataset", "read_at"), "dataset", "left")
    fresh = F.col("read_at") >= now - F.expr(f"INTERVAL {days} DAYS")
    return j.withColumn("state", F.when(~F.col("unreachable"), "read").when(F.coalesce(fresh, F.lit(False)), "keep").otherwise("hold"))


def group_formats(tables: DataFrame, key: Column) -> DataFrame:
    """Files of a dataset with one key and all of different formats become one table, read in the preferred format:
    dataset, id, primary_id and distribution (whether another format of the primary)."""
    keyed = tables.withColumn("key", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("\0"), F.col("id"))))
    groups = keyed.groupBy("dataset", "key").agg(F.count("*").alias("files"), F.count_distinct("format").alias("formats"), F.min_by("id", F.struct(rank_of(F.col("format"), FORMAT_ORDER), "pos")).alias("first"))
    j = keyed.join(groups, ["dataset", "key"])
    one = (F.col("files") > 1) & (F.col("files") == F.col("formats"))
    return j.select("dataset", "id", F.when(one, F.col("first")).otherwise(F.col("id")).alias("primary_id"), (one & (F.col("id") != F.col("first"))).alias("distribution"))


def probe_sample(resources: DataFrame, per_host: int = 3) -> DataFrame:
    """At most three files of each host, one a dataset, in order of pos."""
    one = resources.withColumn("nth", F.row_number().over(Window.partitionBy("host", "dataset").orderBy("pos"))).where("nth = 1")
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("pos"))).where(F.col("nth") <= per_host).drop("nth")


def cheapest_first(tables: DataFrame) -> DataFrame:
    """Text files first, then by declared size: the order in which headers are asked for."""
    return tables.orderBy(F.when(F.col("format") == "csv", 0).otherwise(1), F.coalesce(F.col("size").cast("string").try_cast("bigint"), F.lit(0)), "id")


def candidate_format(fmt: Column, url: Column) -> Column:
    """The format of a file that may hold a table, from its metadata; null for maps, pages and documents."""
    f, u = F.btrim(F.upper(F.coalesce(fmt, F.lit(""))), F.lit(". ")), F.lower(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)))
    #: Words of map files, and formats as portals name them.
    geo = "shp|shape|kmz|kml|geojson|gpkg|wms|wmts"
    known = {"CSV": "csv", "TSV": "csv", "TXT": "csv", "ZIP": "zip", "CSV.ZIP": "zip", "CSV-ZIP": "zip", "XLSX": "xlsx", "XLS": "xls", "ODS": "ods", "PARQUET": "parquet", "JSON": "json", "XML": "xml"}
    out = F.when(basename(u).rlike(geo) | f.isin("GEOJSON", "SHP", "KMZ", "KML", "WMS", "SHP-ZIP"), None).when(u.endswith(".zip"), "zip")
    for k, v in known.items():
        out = out.when(f == k, v)
    for ext in ("csv", "parquet", "xlsx", "xls", "ods"):
        out = out.when(u.endswith(f".{ext}"), ext)
    return out


def history(previous: Column, day: Column, passed: Column) -> Column:
    """The last twelve verdicts: an earlier list of (day, pass) with the new one, if there is one."""
    whole = F.when(passed.isNull(), F.coalesce(previous, F.array().cast("array<struct<day:string,pass:boolean>>"))).otherwise(F.concat(F.coalesce(previous, F.array().cast("array<struct<day:string,pass:boolean>>")), F.array(F.struct(day.alias("day"), passed.alias("pass")))))
    return F.slice(whole, F.greatest(F.size(whole) - HISTORY + 1, F.lit(1)), HISTORY)


def first_seen(tables: DataFrame, earlier: DataFrame, now: Column) -> DataFrame:
    """id and first_seen: as remembered, else the day of the first check there is a record of, else now. earlier: id, first_seen, validated_at, checked_at."""
    return tables.select("id").join(earlier, "id", "left").select("id", F.coalesce("first_seen", "validated_at", "checked_at", now).alias("first_seen"))
