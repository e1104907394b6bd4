"""Changes of structure between two readings, and the append-only log of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, safe_markdown

ISSUES_PER_RUN = 15
NAMES_SHOWN = 40


def observed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events of files whose columns, delimiter, encoding or number of headers changed. Both: resource_id, names, delimiter,
    encoding, distinct_headers. A file without an earlier reading has none: its first is the baseline."""
    b, a = before.alias("b"), after.alias("a")
    j = a.join(b, "resource_id")
    added, removed = F.array_except("a.names", "b.names"), F.array_except("b.names", "a.names")
    j = j.select("resource_id", added.alias("columns_added"), removed.alias("columns_removed"), ((F.size(added) == 0) & (F.size(removed) == 0) & (F.col("a.names") != F.col("b.names"))).alias("columns_reordered"),
                 *[F.when(F.col(f"b.{c}").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.struct(F.col(f"b.{c}").alias("before"), F.col(f"a.{c}").alias("after"))).alias(c) for c in ("delimiter", "encoding", "distinct_headers")],
                 F.col("b.names").alias("names_before"), F.col("a.names").alias("names_after"))
    changed = (F.size("columns_added") > 0) | (F.size("columns_removed") > 0) | F.col("columns_reordered") | F.col("delimiter").isNotNull() | F.col("encoding").isNotNull() | F.col("distinct_headers").isNotNull()
    return j.where(changed).withColumn("id", digest(F.lit("observed"), F.col("resource_id"), *[F.col(c) for c in j.columns[1:]])).withColumn("kind", F.lit("observed")).drop("names_before", "names_after")


def declared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields added, removed or of another type. Both: resource_id, kind, name, type, one row a field; a schema that is
    gone has only removed fields. Schemas without an earlier version have no events."""
    key = ["resource_id", "kind", "name"]
    known = before.select("resource_id", "kind").distinct()
    j = before.withColumnRenamed("type", "old").withColumn("was", F.lit(True)).join(after.withColumnRenamed("type", "new").withColumn("is", F.lit(True)), key, "full").join(known, ["resource_id", "kind"], "left_semi")
    moved = j.where(F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    events = moved.groupBy("resource_id", "kind").agg(names(F.col("was").isNull()).alias("fields_added"), names(F.col("is").isNull()).alias("fields_removed"), F.array_sort(F.collect_list(F.when(F.col("was") & F.col("is"), F.struct("name", F.col("old").alias("before"), F.col("new").alias("after"))))).alias("types_changed"))
    left = after.select("resource_id", "kind").distinct().withColumn("stays", F.lit(True))
    return events.join(left, ["resource_id", "kind"], "left").withColumn("schema_removed", F.col("stays").isNull()).drop("stays").withColumn("id", digest(F.lit("declared"), *[F.col(c) for c in events.columns]))


def new_events(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events that the log does not hold: what may be appended."""
    return events.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")


def append(events: DataFrame, log: DataFrame, path: str) -> None:
    """Appends what is new to the log at path. Running it again appends nothing."""
    new_events(events, log).write.mode("append").parquet(path)


def to_open(events: DataFrame, opened: DataFrame, most: int = ISSUES_PER_RUN) -> DataFrame:
    """The first events (seq) without an issue yet: opened has the marker texts of issues."""
    known = opened.select(F.regexp_extract("body", r"drift:([0-9a-f]{16})", 1).alias("id"))
    return events.join(known, "id", "left_anti").orderBy("seq").limit(most)


def issue_title(kind: Column, dataset: Column, resource: Column) -> Column:
    what = F.when(kind == "observed", "file structure changed").otherwise("declared schema changed")
    return F.left(F.concat(F.lit("[L1] "), safe_markdown(dataset), F.lit(" / "), safe_markdown(resource), F.lit(": "), what), F.lit(240))


def names_line(label: str, names: Column) -> Column:
    """A line of an issue's body: up to 40 names, neutralised."""
    shown = F.array_join(F.transform(F.slice(names, 1, NAMES_SHOWN), lambda n: F.concat(F.lit("`"), safe_markdown(n), F.lit("`"))), ", ")
    return F.when(F.size(names) > 0, F.concat(F.lit(f"- {label}: "), shown, F.when(F.size(names) > NAMES_SHOWN, " …").otherwise("")))


def issue_body(event: dict[str, Column], portal: str, dashboard: str) -> Column:
    """The text of an issue. event: columns id, kind, dataset, resource_id, resource_name, columns_added, columns_removed."""
    name = safe_markdown(event["resource_name"])
    lines = [
        F.concat(F.lit("<!-- drift:"), event["id"], F.lit(" -->")),
        F.concat(F.lit("**Dataset:** ["), safe_markdown(event["dataset"]), F.lit(f"]({portal}/dataset/"), event["dataset"], F.lit(")")),
        F.concat(F.lit("**Resource:** "), name, F.lit(" (`"), event["resource_id"], F.lit("`)")),
        names_line("columns added", event["columns_added"]),
        names_line("columns removed", event["columns_removed"]),
        F.concat(F.lit(f"Details: {dashboard}?resource="), event["resource_id"]),
    ]
    return F.concat_ws("\n", *lines)


def last_events(log: DataFrame, names: DataFrame, most: int = 100) -> DataFrame:
    """The last events by seq, with the file's present name where the event has none."""
    return log.orderBy(F.desc("seq")).limit(most).join(names, "resource_id", "left").withColumn("file", F.coalesce("resource_name", "name")).drop("name", "resource_name")
