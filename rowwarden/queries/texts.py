"""Queries on texts: neutralised text, ids in text, documents read as field lists, kinds of content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import linking as L
from ..operators import planning as P
from ..operators import reporting as R
from ..session import table
from .common import SQL_FACTS, facts, joined, registry, sql_list, sql_norm

QUERIES, SQL, query = registry()


@query("SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE left(t, 100) || ' […]' END AS clean FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g') AS t FROM documents)")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text"), 100).alias("clean"))


@query("SELECT doc_id, 'ValueError: ' || regexp_replace(regexp_extract(trim(text), '^([^\\r\\n]*)', 1), '\"[^\"]*\"|''[^'']*''', '…', 'g') AS t, CASE WHEN length(t) <= 200 THEN t ELSE left(t, 200) || ' […]' END AS error FROM documents".replace("SELECT doc_id, 'ValueError", "SELECT doc_id, error FROM (SELECT doc_id, 'ValueError") + ")")
def error_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.error_text(F.lit("ValueError"), F.col("text"), F.lit(False)).alias("error"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(CASE WHEN length(t) <= 300 THEN t ELSE left(t, 300) || ' […]' END, '[\\r\\n]', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '/'), '`', '''') AS plain
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g'), '[@#!\\[\\]()]|https?://', '', 'g') AS t FROM pages)""")
def safe_markdown(spark, sf):
    bare = F.regexp_replace("html", r"[@#!\[\]()]|https?://", "")
    return table(spark, sf, "pages").select("page_id", X.safe_markdown(bare).alias("plain"))


@query("SELECT page_id, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host, string_split(string_split(url, '?')[1], '/')[-1] AS file FROM pages")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.basename(F.col("url")).alias("file"))


_IDS = "concat('see /dataset/d-', user_id % 9, '/resource/', lpad(to_hex(event_id), 8, '0'), '-0000-0000-0000-', lpad(to_hex(user_id), 12, '0'), ' and /dataset/d-', user_id % 9, '/ or /dataset/x', event_id % 4)"


@query(f"SELECT event_id, array_to_string(regexp_extract_all(lower(t), '/resource/([0-9a-f-]{{36}})', 1), ',') AS ids, CASE WHEN user_id % 9 >= 0 THEN 'd-' || user_id % 9 || ',x' || event_id % 4 END AS datasets FROM (SELECT *, {_IDS} AS t FROM events)")
def declared_ids(spark, sf):
    hexed = _IDS.replace("to_hex(event_id)", "hex(event_id)").replace("to_hex(user_id)", "hex(user_id)")
    e = table(spark, sf, "events").selectExpr("event_id", f"lower({hexed}) AS t")
    return e.select("event_id", joined(X.resource_ids(F.col("t"))).alias("ids"), joined(X.dataset_names(F.col("t"))).alias("datasets"))


@query("SELECT concat('d', e.user_id % 40) AS dataset, concat('u', e.user_id) AS dictionary_id, e.event_id::VARCHAR AS declared_id FROM events e WHERE e.event_id % 6 = 0 GROUP BY ALL")
def broken_ids(spark, sf):
    e = table(spark, sf, "events")
    d = e.where("event_id % 3 = 0").groupBy(F.expr("concat('d', user_id % 40)").alias("dataset"), F.expr("concat('u', user_id)").alias("dictionary_id")).agg(F.collect_list(F.col("event_id").cast("string")).alias("declared_ids"))
    return L.broken_ids(d, e.where("event_id % 2 = 1").select(F.expr("concat('d', user_id % 40)").alias("dataset"), F.col("event_id").cast("string").alias("table_id"))).select("dataset", "dictionary_id", "declared_id")


@query("""SELECT page_id, CASE WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html' WHEN starts_with(h, '<') THEN 'xml' WHEN starts_with(h, '[') OR starts_with(h, '{') THEN 'json' ELSE 'csv' END AS kind
FROM (SELECT page_id, lower(regexp_replace(html, '^[ \\r\\n\\t]+', '')) AS h FROM pages)""")
def sniff_kind(spark, sf):
    return table(spark, sf, "pages").select("page_id", D.sniffed(F.col("html")).alias("kind"))


@query("SELECT event_id, CASE WHEN starts_with(trim(props), '{') THEN 'json' ELSE 'csv' END AS kind FROM events")
def dictionary_kind(spark, sf):
    return table(spark, sf, "events").select("event_id", D.content_kind(F.col("props")).alias("kind"))


@query(f"SELECT id, CASE WHEN m LIKE '%404 Client Error%' THEN 'HTTP 404' WHEN m LIKE '%503 Server Error%' THEN 'HTTP 503' WHEN m LIKE '%InvalidURL%' THEN 'no URL' WHEN m LIKE '%TooManyRedirects%' THEN 'redirect loop' WHEN m LIKE '%Timeout%' THEN 'Timeout' ELSE 'other' END AS kind FROM (SELECT id, error AS m FROM ({SQL_FACTS}) WHERE error IS NOT NULL)")
def error_kind(spark, sf):
    return facts(spark, sf).where("error is not null").select("id", R.error_kind(F.col("error")).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN 300 + (event_id * 7) % 300 >= 500 THEN 'unreachable' ELSE 'download-failed' END WHEN event_id % 5 IN (1, 2) THEN 'unreachable' ELSE 'download-failed' END AS kind FROM events")
def download_kind(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN 300 + (event_id * 7) % 300 END AS status", "CASE event_id % 5 WHEN 1 THEN 'Timeout' WHEN 2 THEN 'ConnectionError' WHEN 3 THEN 'SSLError' ELSE 'ValueError' END AS x")
    return e.select("event_id", R.download_kind(F.col("status"), F.col("x")).alias("kind"))


_MD = lambda hexed: f"concat('Dicionário de dados:', chr(10), '* **f', doc_id % 5, '**: {hexed} Tipo: texto;', chr(10), '- g', doc_id % 3, ' – second', chr(10), 'no item', chr(10), '1. h: third', chr(10), '* **f', doc_id % 5, '**: again')"


@query("SELECT doc_id, 'f' || doc_id % 5 || ':texto,g' || doc_id % 3 || ':,h:' AS fields FROM documents")
def description_fields(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_MD('first')} AS t")
    return d.select("doc_id", F.array_join(F.transform(D.fields_of_description(F.col("t")), lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",").alias("fields"))


@query("SELECT lang, doc_id + 2 AS row_no, 'f' || doc_id AS name, source AS type, trim(text) AS description FROM documents")
def dictionary_rows(spark, sf):
    d = table(spark, sf, "documents")
    langs = d.select("lang").distinct()
    head = langs.select("lang", F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("Title"), F.lit(""), F.lit("")).alias("cells")).union(langs.select("lang", F.lit(1).cast("bigint"), F.array(F.lit("Nome do Campo"), F.lit("Descrição"), F.lit("Tipo"))))
    body = d.select("lang", F.col("doc_id") + 2, F.array(F.concat(F.lit("f"), F.col("doc_id").cast("string")), "text", "source"))
    return D.fields_of_rows(head.union(body), ["lang"]).select("lang", "row_no", "name", "type", "description")


@query("SELECT user_id, array_to_string(list(DISTINCT k ORDER BY k), ',') AS header FROM (SELECT user_id, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) GROUP BY user_id")
def record_headers(spark, sf):
    from ..operators.cells import records_as_rows

    e = table(spark, sf, "events").select(F.col("user_id").alias("resource_id"), F.col("event_id").alias("n"), F.from_json("props", "map<string,string>").alias("record")).where("record is not null and size(record) > 0")
    rows = records_as_rows(e, "n")
    return rows.select(F.col("resource_id").alias("user_id"), joined(F.array_sort("header")).alias("header")).distinct()


@query()
def text_chunks(spark, sf):
    """Pieces depend on the ones before: no SQL."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 500)).alias("nth", "piece")).select("doc_id", "nth", F.char_length("piece").alias("length"))


@query()
def pdf_rows(spark, sf):
    """Rows of a table read by content: no SQL."""
    d = table(spark, sf, "documents")
    rows = d.select("lang", F.col("doc_id").alias("row_no"), F.when(F.col("doc_id") % 3 == 0, F.array("text")).otherwise(F.array(F.concat(F.lit("campo_"), F.col("doc_id").cast("string")), F.lit("Cadeia de caracteres"), F.lit("20"), "text")).alias("cells"))
    return D.fields_of_pdf_rows(rows, "lang")


@query("SELECT doc_id, 'a,b' AS names FROM documents")
def model_answers(spark, sf):
    answer = F.concat(F.lit('{"fields": [{"name": " a ", "type": "x"}, {"name": "a"}, null, {"name": ""}, {"name": "b", "size": "'), F.col("doc_id").cast("string"), F.lit('"}]}'))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(D.fields_of_model(answer), lambda f: f["name"]), ",").alias("names"))


_NAMES = "concat(n_name, CASE n_nationkey % 3 WHEN 0 THEN ' dados csv' WHEN 1 THEN ' arquivo 2020' ELSE '' END)"


@query(f"""WITH t AS (SELECT n_regionkey, n_nationkey, {sql_norm(_NAMES)} AS n FROM nation)
SELECT n_nationkey, array_to_string(list_sort(list_filter(string_split(n, ' '), lambda w: w <> '' AND NOT list_contains({sql_list(['csv', 'dados', 'arquivo'])}, w))), ' ') AS key FROM t""")
def table_keys(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.table_key(F.expr(_NAMES), ["csv", "dados", "arquivo"]).alias("key"))


@query("""WITH n AS (SELECT *, first_value(n_nationkey) OVER (PARTITION BY n_regionkey, regexp_replace(n_name, '[0-9_]', '', 'g') ORDER BY n_nationkey) AS first FROM nation)
SELECT n_regionkey::VARCHAR AS dataset, n_nationkey::VARCHAR AS table_id, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE first END::VARCHAR AS dictionary_id, CASE WHEN n_nationkey % 5 = 0 THEN 'declared-id' ELSE 'name' END AS method, 1.0::DOUBLE AS score FROM n""")
def link_best(spark, sf):
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    d = n.select(F.col("n_regionkey").cast("string").alias("dataset"), key.alias("dictionary_id"), F.col("n_nationkey").alias("dict_pos"), F.concat(F.lit("Metadados - "), "n_name").alias("name"), F.lit(0).alias("part"), F.lit("").alias("label"), F.array().cast("array<string>").alias("names"), F.when(F.col("n_nationkey") % 5 == 0, F.array(key)).alias("declared_ids"))
    t = n.select(F.col("n_regionkey").cast("string").alias("dataset"), key.alias("table_id"), F.concat("n_name", F.lit(" csv")).alias("name"), F.lit(None).cast("array<string>").alias("header"))
    return L.link(d, t).select("dataset", "table_id", "dictionary_id", "method", "score")


@query("SELECT page_id, regexp_matches(url, '(?i)metadad|schema|layout|dictionary') AS is_dictionary, CASE page_id % 4 WHEN 0 THEN 'machine' WHEN 1 THEN 'human' WHEN 2 THEN 'machine' ELSE 'other' END AS kind FROM (SELECT page_id, string_split(string_split(CASE WHEN page_id % 3 = 0 THEN url || '/layout.csv' ELSE url END, '?')[1], '/')[-1] AS url FROM pages)")
def dictionaries_found(spark, sf):
    p = table(spark, sf, "pages").withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/layout.csv"))).otherwise(F.col("url")))
    fmt = F.expr("CASE page_id % 4 WHEN 0 THEN ' .csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'Xlsx' ELSE 'zip' END")
    return p.select("page_id", L.is_dictionary(F.lit(None).cast("string"), F.col("url")).alias("is_dictionary"), L.reader_kind(fmt).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'zip' WHEN event_id % 4 = 2 THEN 'csv' ELSE 'parquet' END AS format FROM events")
def candidate_formats(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 2 THEN '.tsv' ELSE '' END AS f", "concat('https://x/', CASE event_id % 4 WHEN 0 THEN 'map_shp.csv' WHEN 1 THEN 'a.ZIP?x=1' WHEN 2 THEN 'a' ELSE 'a.parquet' END) AS u")
    return e.select("event_id", P.candidate_format(F.col("f"), F.col("u")).alias("format"))
