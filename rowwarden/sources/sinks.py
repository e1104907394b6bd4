"""Writers that may run again: a second run with the same input changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: What an accepted record may say.
STATUSES = ("ok", "empty", "error", "not-tabular")
OUTCOMES = ("extracted", "suggested", "llm-needed", "failed")
MAX_FIELDS, MAX_TEXT, MAX_NAME = 3000, 2000, 512
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f‪-‮⁦-⁩]"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of results, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_run(spark: SparkSession, path: str, stage: str, info: dict) -> None:
    """A line of the run log."""
    spark.createDataFrame([(stage, {str(k): str(v) for k, v in info.items()})], "stage string, info map<string,string>").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def changed_schemas(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Of new schemas (dataset, resource_id, kind, fingerprint) those that are not stored as they are."""
    return new.join(stored, ["dataset", "resource_id", "kind", "fingerprint"], "left_anti")


def write_schemas(new: DataFrame, stored: DataFrame, path: str) -> None:
    """Appends changed schemas as new versions; the last version of each is the one in force."""
    changed_schemas(new, stored).withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("kind").parquet(path)


def removed_schemas(stored: DataFrame, declared: DataFrame, kinds: tuple[str, ...] = ("attached", "declared", "described", "datastore")) -> DataFrame:
    """Stored schemas of the kinds that a survey manages and that are declared no longer."""
    return stored.where(F.col("kind").isin(*kinds)).join(declared, ["dataset", "resource_id", "kind"], "left_anti")


def good_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"), F.lit(False))


def good_dataset(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9][a-z0-9_-]{0,99}$"), F.lit(False))


def good_model(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}(/[a-z0-9][a-z0-9._-]{0,63})?(:[A-Za-z0-9][A-Za-z0-9._-]{0,63})?$"), F.lit(False))


def good_digest(c: Column) -> Column:
    return c.isNull() | (c == "") | c.rlike("^(sha256:)?[0-9a-f]{64}$")


def schema_faults(fields: DataFrame, status: Column, allowed: list[str]) -> DataFrame:
    """dataset, resource_id and fault of schemas that are not to be accepted. fields: a row a field, with name and texts."""
    text = [c for c, k in fields.dtypes if k == "string" and c not in ("dataset", "resource_id", "kind")]
    bad_text = F.exists(F.array(*[F.col(c) for c in text]), lambda x: F.coalesce((F.char_length(x) > MAX_TEXT) | x.rlike(CONTROL), F.lit(False)))
    bad_name = ~F.coalesce(F.char_length("name").between(1, MAX_NAME), F.lit(False))
    per = fields.groupBy("dataset", "resource_id").agg(F.count("*").alias("n"), F.bool_or(bad_text).alias("text"), F.bool_or(bad_name).alias("name"), F.bool_or(~F.coalesce(status.isin(allowed), F.lit(False))).alias("status"))
    fault = F.when(F.col("n") > MAX_FIELDS, "too many fields").when(F.col("status"), "status").when(F.col("name"), "bad field name").when(F.col("text"), "text too long or with control characters")
    return per.select("dataset", "resource_id", fault.alias("fault")).where("fault is not null")


def accepted(handed: DataFrame, known: DataFrame, faults: DataFrame) -> DataFrame:
    """Handed-over rows (dataset, resource_id, ...) of files that are known, with good names, whose schemas have no fault."""
    fit = handed.where(good_dataset(F.col("dataset")) & good_id(F.col("resource_id")))
    return fit.join(known, ["dataset", "resource_id"], "left_semi").join(faults, ["dataset", "resource_id"], "left_anti")


def appended_only(handed: DataFrame, committed: DataFrame) -> bool:
    """Whether a handed-over log (seq, id) still starts with the committed one."""
    return committed.join(handed, ["seq", "id"], "left_anti").isEmpty()


def suggestions_table(fields: DataFrame) -> DataFrame:
    """A Markdown table of suggested fields for each resource (resource_id, pos, name, type, description)."""
    line = F.concat_ws(" | ", F.lit("").cast("string"), "name", "type", F.coalesce("description", F.lit("")), F.lit(""))
    rows = fields.groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim(line).alias("line")))).alias("rows"))
    return rows.select("resource_id", F.concat(F.lit("| name | type | description |\n|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))
