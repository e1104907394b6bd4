"""Which dictionary describes which file: every pair within a dataset is scored, and the strongest evidence wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, dataset_names, header_score, jaccard, name_score, norm, tokens

#: Methods, from the weakest.
METHODS = ("single", "name", "header", "declared-id")
#: Formats that machines or people read.
MACHINE_FORMATS = ("CSV", "JSON", "XML", "XLSX", "XLS", "ODS", "TXT")
HUMAN_FORMATS = ("PDF", "HTML", "HTM", "DOC", "DOCX", "ODT", "RTF")
#: Words in the name of a dictionary.
DICTIONARY_NAME = r"metadad|dicion[aá]rio|dicionario|dictionary|\besquema\b|\bschema\b|\blayout\b"
ENOUGH = 0.5


def is_dictionary(name: Column, url: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), basename(url)).rlike(f"(?iu){DICTIONARY_NAME}")


def reader_kind(fmt: Column) -> Column:
    f = F.btrim(F.upper(F.coalesce(fmt, F.lit(""))), F.lit(". "))
    return F.when(f.isin(*MACHINE_FORMATS), "machine").when(f.isin(*HUMAN_FORMATS), "human").otherwise("other")


def link(dictionaries: DataFrame, tables: DataFrame) -> DataFrame:
    """dataset, table_id, dictionary_id, part, method and score of each linked table.

    dictionaries: dataset, dictionary_id, dict_pos, name, part, label, names (field names), declared_ids.
    tables: dataset, table_id, name, header (may be null). Evidence needs something in common (an id, a token of the
    name, a column), so pairs come from equi-joins on those, not from all pairs of a dataset; only a dictionary that is
    alone meets every table of its dataset.
    """
    count = lambda df, n: df.groupBy("dataset").agg(F.count("*").alias(n))
    d = dictionaries.withColumn("full", F.trim(F.concat_ws(" ", "name", "label"))).drop("name").join(count(dictionaries, "units"), "dataset")
    t = tables.join(count(tables, "files"), "dataset")
    marked = lambda mark, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    names = lambda c: F.transform(F.col(c), lambda x: norm(x))
    unit, file = ["dataset", "dictionary_id", "part"], ["dataset", "table_id"]
    of_d = d.select(*unit, F.explode(F.array_distinct(F.concat(marked("i", F.col("declared_ids")), marked("t", tokens(F.col("full"))), marked("t", tokens(F.col("label"))), marked("h", names("names"))))).alias("key"))
    of_t = t.select(*file, F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("i"), F.col("table_id"))), marked("t", tokens(F.col("name"))), marked("h", names("header"))))).alias("key"))
    alone = d.where("units = 1").select(*unit).join(t.select(*file), "dataset")
    met = of_d.join(of_t, ["dataset", "key"]).select(*unit, "table_id").union(alone.select(*unit, "table_id")).distinct()
    pairs = met.join(d, unit).join(t, file)
    by_header = F.when(F.col("header").isNotNull() & (F.size("header") > 0) & (F.size("names") > 0), header_score(F.col("names"), F.col("header")))
    by_name = F.greatest(jaccard(F.col("full"), F.col("name")), F.when(F.coalesce("label", F.lit("")) != "", jaccard(F.col("label"), F.col("name"))))
    option = lambda rank, when, score, tie: F.when(when, F.struct(F.lit(rank).alias("rank"), score.cast("double").alias("score"), tie.cast("double").alias("tie")))
    single = (F.col("units") == 1) & ((F.size(tokens(F.col("full"))) == 0) | (F.col("files") == 1))
    scored = pairs.withColumn("best", F.greatest(
        option(3, F.coalesce(F.array_contains("declared_ids", F.col("table_id")), F.lit(False)), F.lit(1.0), F.lit(0.0)),
        option(2, by_header >= ENOUGH, F.round(by_header, 3), F.lit(0.0)),
        option(1, by_name >= ENOUGH, F.round(by_name, 3), name_score(F.col("full"), F.col("name"))),
        option(0, single, F.lit(0.5), F.lit(0.0)),
    )).where("best is not null")
    order = Window.partitionBy(*file).orderBy(F.desc("best.rank"), F.desc("best.score"), F.desc("best.tie"), "dict_pos", "part")
    return scored.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*file, "dictionary_id", "part", F.element_at(F.array(*map(F.lit, METHODS)), F.col("best.rank") + 1).alias("method"), F.col("best.score").alias("score"))


def header_decides(units: Column, any_names: Column, method: Column) -> Column:
    """Whether reading a file's header could change its link."""
    return F.when((method == "declared-id") | ~any_names, F.lit(False)).otherwise((units > 1) | method.isNull())


def broken_ids(dictionaries: DataFrame, tables: DataFrame) -> DataFrame:
    """dataset, dictionary_id and declared_id where a dictionary names a file that its dataset lacks."""
    named = dictionaries.select("dataset", "dictionary_id", F.explode("declared_ids").alias("declared_id")).distinct()
    return named.join(tables.select("dataset", F.col("table_id").alias("declared_id")), ["dataset", "declared_id"], "left_anti")


def borrowed_descriptions(resources: DataFrame, enough: float = 0.99) -> DataFrame:
    """dataset, id and from_id: a file without a field list takes that of the first sibling of the same name.

    resources: dataset, id, pos, name, n_described. Names that are alike to 0.99 have equal token sets, so the
    sibling is found by an equi-join on those.
    """
    keyed = resources.withColumn("key", F.array_join(F.array_sort(tokens(F.col("name"))), " ")).where("key <> ''")
    lacks, has = keyed.where("n_described = 0").alias("a"), keyed.where("n_described > 0").alias("b")
    return lacks.join(has, ["dataset", "key"]).groupBy("dataset", F.col("a.id").alias("id")).agg(F.min_by("b.id", "b.pos").alias("from_id"))


def other_datasets(dictionaries: DataFrame) -> DataFrame:
    """dataset, dictionary_id and the names of other datasets that a dictionary's text cites, such as one it was copied from."""
    cited = F.array_except(dataset_names(F.col("text")), F.array("dataset"))
    return dictionaries.select("dataset", "dictionary_id", cited.alias("names_other_dataset")).where(F.size("names_other_dataset") > 0)
