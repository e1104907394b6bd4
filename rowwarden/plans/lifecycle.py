"""Whole runs: survey of a portal, validation of files, extraction from documents, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import host, resource_ids, table_key
from ..functions.types import descriptor, store_type
from ..operators import cells, conformance, documents, drift, extraction, linking, matching, planning, reporting
from ..session import written
from ..sources import files as file_source
from ..sources import portal

PARAMETERS = {"rotation_days": planning.ROTATION_DAYS, "sample_rows": cells.SAMPLE_ROWS, "max_error_rate": conformance.MAX_ERROR_RATE, "pass_threshold": reporting.PASS_THRESHOLD}


#: Types that a check knows.
KNOWN_TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "time", "object")


@dataclass(frozen=True)
class Census:
    """tables: candidate files with their level. dictionaries: with their findings. contracts: a row a field of the schema in
    force. schemas: which kinds of schema each file has. groups: files that are one table in several formats, and copies."""

    tables: DataFrame
    dictionaries: DataFrame
    links: DataFrame
    contracts: DataFrame
    schemas: DataFrame
    groups: DataFrame
    copies: DataFrame
    findings: DataFrame


#: A Table Schema as portals attach it: fields with constraints.
ATTACHED = "fields array<struct<name:string,type:string,format:string,decimalChar:string,groupChar:string,trueValues:array<string>,falseValues:array<string>,constraints:struct<required:boolean,minLength:int,maxLength:int,minimum:string,maximum:string,pattern:string,enum:array<string>>>>"


def attached_contracts(resources: DataFrame) -> DataFrame:
    """Contracts from Table Schemas that resources carry (id, schema: JSON). A schema without fields, or with one that has no name, is none."""
    parsed = resources.select(F.col("id").alias("resource_id"), F.from_json("schema", ATTACHED)["fields"].alias("fields"))
    valid = parsed.where((F.size("fields") > 0) & F.forall("fields", lambda f: F.coalesce(f["name"], F.lit("")) != ""))
    each = valid.select("resource_id", F.posexplode("fields").alias("pos", "f"))
    direct = [F.col(f"f.{c}").alias(c) for c in ("format", "decimalChar", "groupChar", "trueValues", "falseValues")]
    known = F.when(F.col("f.type").isin(*KNOWN_TYPES), F.col("f.type")).otherwise(F.lit("any"))
    plain = [F.when(F.col("format") != "default", F.col("format")).alias("format") if c == "format" else F.col(c) for c in ("resource_id", "pos", "name", "type", "format", "decimalChar", "groupChar", "trueValues", "falseValues", "required", "minLength", "maxLength", "minimum", "maximum", "pattern", "enum")]
    return conformance.as_contract(each.select("resource_id", "pos", F.col("f.name").alias("name"), known.alias("type"), *direct, "f.constraints.*").select(plain))


def declared_contracts(fields: DataFrame, links: DataFrame) -> DataFrame:
    """Contracts of linked files from the fields of their dictionaries (dictionary_id, row_no, name, type, size, description, allowed)."""
    made = links.join(fields, "dictionary_id").select("table_id", F.col("row_no").alias("pos"), descriptor(F.col("name"), F.col("type"), F.col("size"), F.col("description"), F.col("allowed")).alias("f"))
    return conformance.as_contract(made.select(F.col("table_id").alias("resource_id"), F.col("pos").cast("int").alias("pos"), "f.*"))


def store_contracts(fields: DataFrame) -> DataFrame:
    """Contracts from the types of the portal's store; none where every column is text."""
    typed = fields.where("store_type <> 'text'").select("resource_id").distinct()
    return conformance.as_contract(fields.join(typed, "resource_id", "left_semi").select("resource_id", "pos", "name", store_type(F.col("store_type")).alias("type")))


def census(spark: SparkSession, resources: DataFrame, open_: portal.Open = portal.open_url, limit: int = 50_000_000, headers: DataFrame | None = None, store: DataFrame | None = None) -> Census:
    """Which files may be tables, which dictionary describes which, and under what contract.

    resources: portal.resources(). headers: table_id and header of files that were read before, as evidence for links.
    store: portal.store_fields(). Contracts are those of the first kind of schema that a file has (planning.KINDS).
    """
    r = written(resources, "resources")
    is_dict = linking.is_dictionary(F.col("name"), F.col("url"))
    dicts = r.where(is_dict).withColumn("reader", linking.reader_kind(F.col("format")))
    tables = r.where(~is_dict).withColumn("candidate", planning.candidate_format(F.col("format"), F.col("url"))).where("candidate is not null")
    if headers is None:
        headers = spark.createDataFrame([], "table_id string, header array<string>")

    # dictionaries: fields by part, and why there are none
    got = written(portal.fetched(dicts.where("reader = 'machine'"), limit, open_, tries=1), "dictionaries")
    ids_of = dicts.select("dataset", F.col("url").alias("path"), F.col("id").alias("dictionary_id"), F.col("pos").alias("dict_pos"), "name", "format")
    read, outcomes = documents.read_dictionaries(got.dropDuplicates(["path"]).join(ids_of.select("path", "format").dropDuplicates(["path"]), "path").select("path", "format", "content"))
    read, outcomes = written(read.join(ids_of.select("path", "dictionary_id"), "path"), "fields"), written(outcomes.join(ids_of.select("path", "dictionary_id"), "path"), "outcomes")
    parts = read.select("dictionary_id", F.col("part").alias("label")).distinct().withColumn("part", F.row_number().over(Window.partitionBy("dictionary_id").orderBy("label")) - 1)
    fields = read.withColumnRenamed("part", "label").join(parts, ["dictionary_id", "label"])

    # links, by what ids, headers and names share
    text = got.where("content is not null").select("path", F.col("content").cast("string").alias("text")).join(ids_of.select("path", "dataset", "dictionary_id"), "path")
    declared_ids = text.select("dictionary_id", resource_ids(F.col("text")).alias("declared_ids"))
    named = fields.groupBy("dictionary_id", "part").agg(F.collect_list("name").alias("names"))
    every = ids_of.join(parts, "dictionary_id", "left").withColumns({"part": F.coalesce("part", F.lit(0)), "label": F.coalesce("label", F.lit(""))})
    units = every.join(named, ["dictionary_id", "part"], "left").join(declared_ids, "dictionary_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    known = tables.select("dataset", F.col("id").alias("table_id"), "name").join(headers, "table_id", "left")
    links = written(linking.link(units.select("dataset", "dictionary_id", "dict_pos", "name", "part", "label", "names", "declared_ids"), known), "census-links")

    # schemas of every kind, and the one in force
    attached = attached_contracts(tables.where("schema is not null")).withColumn("kind", F.lit("attached"))
    declared = declared_contracts(fields, links).withColumn("kind", F.lit("declared"))
    stored = (store_contracts(store) if store is not None else conformance.as_contract(spark.createDataFrame([], conformance.CONTRACT))).withColumn("kind", F.lit("datastore"))
    item = documents.fields_of_description(F.coalesce("description", F.lit("")))
    listed = tables.select(F.col("id").alias("resource_id"), F.posexplode(item).alias("pos", "f"))
    none = F.lit("")
    described = listed.select("resource_id", "pos", descriptor(F.col("f.name"), F.col("f.type"), none, F.col("f.description"), none).alias("d"))
    described = conformance.as_contract(described.select("resource_id", "pos", "d.*")).withColumn("kind", F.lit("described"))
    all_fields = written(attached.unionByName(declared).unionByName(stored).unionByName(described), "schemas")
    in_dataset = tables.select("dataset", F.col("id").alias("resource_id"))
    kinds = all_fields.select("resource_id", "kind").distinct().join(in_dataset, "resource_id").withColumn("status", F.lit("verified"))
    schemas = written(planning.select_schema(kinds), "in-force")
    contracts = all_fields.join(schemas.select("resource_id", "kind"), ["resource_id", "kind"]).drop("kind")

    # levels and findings
    readable = outcomes.select("dictionary_id", F.col("error_kind").isNull().alias("readable"), "error_kind")
    found = dicts.join(readable, dicts.id == readable.dictionary_id, "left").select("dataset", "id", "name", "format", F.col("reader").alias("kind"), F.coalesce("readable", F.lit(False)).alias("readable"), F.when(F.col("reader") == "machine", F.coalesce("error_kind", F.when(F.col("readable").isNull(), "download-failed"))).alias("error_kind"))
    found = found.join(linking.other_datasets(text).select(F.col("dictionary_id").alias("id"), "names_other_dataset"), "id", "left")
    has = kinds.groupBy(F.col("resource_id").alias("id")).agg(F.bool_or(F.col("kind") == "attached").alias("has_attached"), F.bool_or(F.col("kind") == "datastore").alias("has_store"), F.bool_or(F.col("kind") == "described").alias("has_described"))
    leveled = tables.join(links.select(F.col("table_id").alias("id"), "dictionary_id"), "id", "left").join(found.select(F.col("id").alias("dictionary_id"), F.col("kind").alias("dict_kind"), "readable"), "dictionary_id", "left").join(has, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    level = reporting.level_of(yes("has_attached"), yes("has_store"), F.col("dict_kind"), F.col("readable"), yes("has_described").cast("int"))
    out = leveled.select("id", "dataset", "name", "url", "size", "candidate", "last_modified", "pos", host(F.col("url")).alias("host"), level.alias("level"))
    groups = planning.group_formats(out.withColumnRenamed("candidate", "format"), table_key(F.col("name"), list(planning.FORMAT_ORDER)))
    return Census(out, found, links, contracts, schemas, groups, planning.copies(out), documents.type_findings(fields, "dictionary_id"))


@dataclass(frozen=True)
class Validation:
    """verdicts, errors and observed schemas of files, and files without a table."""

    verdicts: DataFrame
    errors: DataFrame
    observed: DataFrame
    unread: DataFrame


def validate(files: DataFrame, contract: DataFrame) -> Validation:
    """Reads files (path, content), whose path is their resource id, and checks each against its contract.

    A declared format that is left open is the one that most sampled values have.
    """
    rows = written(file_source.read_tables(files), "rows")
    table_rows = rows.where("row_no > 0").select(F.col("path").alias("resource_id"), "member", "row_no", "header", "cells")
    observed = written(cells.observed_schema(table_rows), "observed")
    # sampled values by the place of the declared field
    names = table_rows.groupBy("resource_id").agg(F.min_by("header", "row_no").alias("header")).join(conformance.gathered(contract), "resource_id")
    matched = names.withColumn("m", conformance.match_fields(F.transform("fields", lambda f: f["name"]), F.col("header")))
    each = matched.select("resource_id", F.explode("fields").alias("f"), F.col("m.spelling").alias("spelling"))
    spelled = F.get(F.filter("spelling", lambda p: p["declared"] == F.col("f.name")), 0)["column"]
    places = each.select("resource_id", F.col("f.pos").alias("pos"), F.coalesce(spelled, F.col("f.name")).alias("name"))
    values = cells.columns(table_rows).drop("pos").join(places, ["resource_id", "name"])
    complete = written(cells.complete_formats(contract, values).drop("inferred"), "contract")
    checked = conformance.check(table_rows, complete)
    return Validation(conformance.verdicts(checked), checked.errors, observed, rows.where("error_kind is not null").select(F.col("path").alias("resource_id"), "error_kind"))


#: What a run remembers of each file, and its events.
STATE = "id string, status string, fingerprint string, validated_at timestamp, first_seen timestamp, pass boolean, pass_history array<struct<day:string,pass:boolean>>"
EVENTS = "id string, kind string, resource_id string, columns_added array<string>, columns_removed array<string>"


@dataclass(frozen=True)
class Run:
    """What a run found and what it remembers: validation, the state of each file, new events, and the row of changes."""

    validation: Validation
    state: DataFrame
    events: DataFrame
    changes: DataFrame


def run(spark: SparkSession, survey: Census, files: DataFrame, now, state: DataFrame | None = None, observed: DataFrame | None = None, declared: DataFrame | None = None, log: DataFrame | None = None) -> Run:
    """One validation of the files (path: the id of a table, content) of a survey, against what the run before remembered.

    state: STATE. observed and declared: the observed fields and the contracts of the run before. log: events so far (id). Files
    that are not handed over keep their state. now: a datetime.
    """
    state = spark.createDataFrame([], STATE) if state is None else state
    at = F.lit(now).cast("timestamp")
    done = validate(files, survey.contracts)
    events = [] if observed is None else [observed_events(observed, done.observed).select("id", "kind", "resource_id", "columns_added", "columns_removed")]
    if declared is not None:
        of = lambda c: c.select("resource_id", F.lit("declared").alias("kind"), "name", "type")
        moved = drift.declared(of(declared), of(survey.contracts))
        events.append(moved.select("id", F.lit("declared").alias("kind"), "resource_id", F.col("fields_added").alias("columns_added"), F.col("fields_removed").alias("columns_removed")))
    every = reduce(DataFrame.unionByName, events) if events else spark.createDataFrame([], EVENTS)
    fresh = written(drift.new_events(every, spark.createDataFrame([], "id string") if log is None else log), "events")

    prints = planning.fingerprints(survey.contracts).withColumnRenamed("resource_id", "id")
    checked = files.select(F.col("path").alias("id")).distinct().join(done.verdicts.select(F.col("resource_id").alias("id"), "pass"), "id", "left").join(done.unread.select(F.col("resource_id").alias("id"), "error_kind"), "id", "left").join(prints, "id", "left")
    status = F.when(F.col("error_kind").isin("malformed", "too-large"), "error").when(F.col("error_kind").isNotNull(), "not-tabular").otherwise("ok")
    earlier = state.select("id", F.col("first_seen").alias("old_seen"), F.col("pass_history").alias("old_history"))
    day = F.date_format(at, "yyyy-MM-dd")
    now_state = checked.join(earlier, "id", "left").select("id", status.alias("status"), "fingerprint", at.alias("validated_at"), F.coalesce("old_seen", at).alias("first_seen"), "pass", planning.history(F.col("old_history"), day, F.col("pass")).alias("pass_history"))
    remembered = written(now_state.unionByName(state.join(checked.select("id"), "id", "left_anti")), "state")
    verdicts = remembered.select("id", F.posexplode("pass_history").alias("at", "v")).select("id", F.to_timestamp("v.day").alias("at"), "v.pass")
    changes = reporting.run_transitions(verdicts, survey.tables, remembered.select("id", "first_seen"), F.date_trunc("day", at))
    return Run(done, remembered, fresh, changes)


def extract(dictionaries: DataFrame, links: DataFrame, headers: DataFrame, fields: DataFrame) -> DataFrame:
    """The deterministic stage over PDF dictionaries: dictionary_id, stage, n_fields, recall, precision and outcome.

    links: dictionary_id, resource_id, pos. headers: resource_id, header. fields: dictionary_id, row_no, name, ...
    (documents.fields_of_pdf_rows). The oracle is the header most common among linked files.
    """
    oracle = extraction.common_header(links, headers)
    names = fields.groupBy("dictionary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda x: x["name"]).alias("names"))
    each = dictionaries.where("format = 'PDF'").select("dictionary_id").join(names, "dictionary_id", "left").join(oracle, "dictionary_id", "left")
    each = each.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("o", F.when(F.col("header").isNotNull(), matching.oracle(F.col("names"), F.col("header"))))
    agreement = F.when(F.col("header").isNotNull(), matching.agreement(F.col("o")))
    return each.select("dictionary_id", F.lit("deterministic").alias("stage"), F.size("names").alias("n_fields"), F.col("o.recall").alias("recall"), F.col("o.precision").alias("precision"), extraction.outcome(agreement, F.size("names"), F.col("header").isNotNull()).alias("outcome"))


def similar_columns(verdicts: DataFrame) -> DataFrame:
    """Missing names and undeclared columns of each verdict that are alike."""
    return verdicts.where((F.size("missing") > 0) & (F.size("undeclared") > 0)).select("resource_id", F.explode(matching.similar_names(F.col("missing"), F.col("undeclared"))).alias("p")).select("resource_id", "p.*")


def file_facts(tables: DataFrame, validation: DataFrame) -> DataFrame:
    """The wide table that reports read: every file with what is known of it."""
    return tables.join(validation, "id", "left")


def report(facts: DataFrame, probes: DataFrame, events: DataFrame, queue: DataFrame) -> dict[str, DataFrame]:
    """Every figure of a run, by name."""
    delivered = reporting.delivery(facts, probes)
    return {
        "summary": reporting.summary(facts), "coverage": reporting.coverage(facts), "datasets": reporting.dataset_levels(facts), "sources": reporting.by_source(facts), "sizes": reporting.sizes(facts), "network": reporting.network(facts),
        "delivery": delivered, "suggestions": reporting.suggestions(delivered), "unreadable": reporting.unreadable(facts), "queue": reporting.queue_size(facts, queue), "dashboard": reporting.dashboard(facts, events, queue),
    }


def observed_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drift between two observed schemas (rows of cells.observed_schema)."""
    lists = lambda df: df.groupBy("resource_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"), F.lit(None).cast("string").alias("delimiter"), F.lit(None).cast("string").alias("encoding"), F.lit(1).alias("distinct_headers"))
    return drift.observed(lists(before), lists(after))
