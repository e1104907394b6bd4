"""Queries on planning and drift: precedence, fingerprints, queue, copies, formats, histories, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import extraction as E
from ..operators import planning as P
from ..operators import reporting as R
from ..session import table
from .common import SQL_FACTS, facts, joined, registry

QUERIES, SQL, query = registry()
_KIND = "CASE event_id % 6 WHEN 0 THEN 'datastore' WHEN 1 THEN 'described' WHEN 2 THEN 'extracted' WHEN 3 THEN 'declared' WHEN 4 THEN 'observed' ELSE 'attached' END"
_STATUS = "CASE WHEN event_id % 4 = 2 THEN 'suggested' ELSE 'verified' END"


@query(f"""WITH s AS (SELECT user_id AS resource_id, min(event_id) AS first, {_KIND} AS kind, {_STATUS} AS status FROM events GROUP BY user_id, kind, status),
ranked AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY CASE kind WHEN 'attached' THEN 0 WHEN 'declared' THEN 1 WHEN 'extracted' THEN 2 WHEN 'described' THEN 3 ELSE 4 END) AS nth FROM s WHERE kind <> 'observed' AND (kind <> 'extracted' OR status = 'verified'))
SELECT resource_id, kind FROM ranked WHERE nth = 1""")
def schema_precedence(spark, sf):
    s = table(spark, sf, "events").selectExpr("'d' AS dataset", "user_id AS resource_id", f"{_KIND} AS kind", f"{_STATUS} AS status").distinct()
    return P.select_schema(s).select("resource_id", "kind")


@query("""SELECT source AS resource_id, left(sha256('{"p0":[' || string_agg('{"name":"' || lang || doc_id || '","type":"string"}', ',' ORDER BY doc_id) || ']}'), 16) AS fingerprint FROM documents GROUP BY source""")
def fingerprints(spark, sf):
    return P.fingerprints(table(spark, sf, "documents").select(F.col("source").alias("resource_id"), F.col("doc_id").alias("pos"), F.concat("lang", F.col("doc_id").cast("string")).alias("name"), F.lit("string").alias("type")))


_PREV = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id END AS prev_id, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE 'f' END AS prev_fingerprint, 'f' AS fingerprint, 'u' AS url, CASE WHEN event_id % 8 = 0 THEN 'w' ELSE 'u' END AS prev_url, 1 AS size, 1 AS prev_size, 'm' AS last_modified, 'm' AS prev_last_modified, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 = 1 THEN 'not-tabular' ELSE 'ok' END AS prev_status, CASE WHEN event_id % 3 = 0 THEN 'html' END AS prev_not_tabular_kind"


@query(f"""SELECT * FROM (SELECT event_id, CASE WHEN prev_id IS NULL THEN 'new' WHEN prev_fingerprint <> 'f' THEN 'schema' WHEN prev_url <> 'u' THEN 'changed' WHEN prev_status = 'error' THEN 'error' WHEN prev_status = 'not-tabular' AND prev_not_tabular_kind IS NULL THEN 'reader' WHEN ts < TIMESTAMP '2024-02-01' - INTERVAL 28 DAYS THEN 'rotation' END AS reason
FROM (SELECT event_id, ts, {_PREV} FROM events)) WHERE reason IS NOT NULL""")
def work_reasons(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS prev_validated_at", "CAST(NULL AS TIMESTAMP) AS prev_checked_at", *[x + ")" if x.count("(") > x.count(")") else x for x in _PREV.split(", ")])
    return e.select("event_id", P.reason(F.lit("2024-02-01").cast("timestamp")).alias("reason")).where("reason is not null")


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE 'error' END AS reason FROM ({SQL_FACTS}) WHERE dataset NOT IN ('d1', 'd2') AND (id % 4 = 0 OR (status = 'error' AND id % 4 <> 0))""")
def queue_plan(spark, sf):
    f = facts(spark, sf).select("id", "dataset", "url", "size", F.lit("m").alias("last_modified"), F.lit("f").alias("fingerprint"), F.col("dataset").isin("d1", "d2").alias("hold"), F.col("id").alias("pos"), "status")
    now = F.lit("2024-06-01").cast("timestamp")
    v = f.where("id % 4 <> 0").select("id", "url", "size", "last_modified", "fingerprint", F.when(F.col("status") == "not-tabular", "ok").otherwise(F.col("status")).alias("status"), F.lit("x").alias("not_tabular_kind"), now.alias("validated_at"), now.alias("checked_at"))
    return P.queue(f.drop("status"), v, now).select("id", "reason")


_FILES = "SELECT doc_id AS id, source AS dataset, lang AS name, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (n_chars // 300)::VARCHAR END AS size, 'https://x/' || lang || '.csv?v=' || doc_id AS url, doc_id AS pos FROM documents"


def _files(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS id", "source AS dataset", "lang AS name", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(n_chars DIV 300 AS STRING) END AS size", "concat('https://x/', lang, '.csv?v=', doc_id) AS url", "doc_id AS pos")


_COPIES = f"SELECT id, first_value(id) OVER (PARTITION BY dataset, name, size ORDER BY pos) AS copy_of FROM ({_FILES}) WHERE size IS NOT NULL QUALIFY id <> copy_of"


@query(_COPIES)
def copies(spark, sf):
    return P.copies(_files(spark, sf))


_VALID = "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status, md5(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0"


@query(f"WITH c AS ({_COPIES}), v AS ({_VALID}) SELECT v.id, CASE WHEN v.status = 'error' AND f.status = 'ok' THEN 'ok' ELSE v.status END AS status, CASE WHEN v.status = 'error' AND f.status = 'ok' THEN c.copy_of END AS copy_of FROM v LEFT JOIN c ON v.id = c.id LEFT JOIN v f ON c.copy_of = f.id")
def copy_results(spark, sf):
    v = table(spark, sf, "documents").where("doc_id % 7 <> 0").selectExpr("doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status", "md5(text) AS sha256")
    return P.copied_results(v, P.copies(_files(spark, sf))).select("id", "status", "copy_of")


@query(f"WITH c AS ({_COPIES}), v AS ({_VALID}) SELECT count(*) AS files, count(DISTINCT copy_of) AS of_files, count(*) FILTER (a.sha256 = b.sha256) AS identical, count(*) FILTER (a.sha256 <> b.sha256) AS different FROM c LEFT JOIN v a ON c.id = a.id LEFT JOIN v b ON c.copy_of = b.id")
def compared_copies(spark, sf):
    v = table(spark, sf, "documents").where("doc_id % 7 <> 0").selectExpr("doc_id AS id", "md5(text) AS sha256")
    return P.compared_copies(P.copies(_files(spark, sf)), v)


@query("""WITH g AS (SELECT *, user_id % 500 || '-' || event_id % 90 AS key, ['csv', 'zip', 'json', 'xml'][event_id % 4 + 1] AS f, [0, 1, 6, 7][event_id % 4 + 1] AS rank FROM events),
k AS (SELECT event_type, key, count(*) AS n, count(DISTINCT f) AS m, arg_min(event_id, rank * 1e9 + event_id) AS first FROM g GROUP BY ALL)
SELECT event_id AS id, CASE WHEN n > 1 AND n = m THEN first ELSE event_id END AS primary_id, n > 1 AND n = m AND event_id <> first AS distribution FROM g JOIN k USING (event_type, key)""")
def group_formats(spark, sf):
    g = table(spark, sf, "events").selectExpr("event_type AS dataset", "event_id AS id", "event_id AS pos", "concat(user_id % 500, '-', event_id % 90) AS k", "element_at(array('csv', 'zip', 'json', 'xml'), CAST(event_id % 4 AS INT) + 1) AS format")
    return P.group_formats(g, F.col("k")).select("id", "primary_id", "distribution")


@query(f"SELECT host, id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY host, dataset ORDER BY id) AS n FROM ({SQL_FACTS}) WHERE host IS NOT NULL) WHERE n = 1) WHERE m <= 3")
def probe_sample(spark, sf):
    return P.probe_sample(facts(spark, sf).where("host is not null").select("host", "dataset", "id", F.col("id").alias("pos"))).select("host", "id")


@query("""SELECT user_id, array_to_string(list(b ORDER BY event_id)[-12:], ',') AS history FROM (SELECT *, CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS b FROM events) GROUP BY user_id""")
def pass_history(spark, sf):
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 20).alias("p")))), lambda x: F.struct(x["event_id"].cast("string").alias("day"), x["p"].alias("pass"))).alias("h"))
    last = P.history(F.slice("h", F.lit(1), F.size("h") - 1), F.element_at("h", -1)["day"], F.element_at("h", -1)["pass"])
    return lists.select("user_id", joined(F.transform(last, lambda x: x["pass"])).alias("history"))


@query("""WITH v AS (SELECT *, value > 20 AS p, lag(value > 20) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events)
SELECT count(*) FILTER (NOT b AND p) AS fixed, count(*) FILTER (b AND NOT p) AS broken, count(*) FILTER (b = p) AS same FROM v WHERE nth = 1 AND b IS NOT NULL AND event_id >= 10""")
def history_transitions(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("value") > 20).alias("pass"))
    return R.transitions(v, F.lit(10))


@query("SELECT \"at\", max(report_at) AS report_at, arg_max(n, report_at) AS n FROM (SELECT user_id AS \"at\", event_id AS report_at, value AS n FROM events) GROUP BY \"at\"")
def history_upsert(spark, sf):
    h = table(spark, sf, "events").select(F.col("user_id").alias("at"), F.col("event_id").alias("report_at"), F.col("value").alias("n"))
    return R.upserted_history(h.where("report_at % 2 = 0"), h.where("report_at % 2 = 1"))


_NAMES = "SELECT user_id AS resource_id, list(DISTINCT event_type || '_' || event_id % 3 ORDER BY event_type || '_' || event_id % 3) AS names, max(CASE WHEN event_id % 500 = 0 THEN ';' ELSE ',' END) AS delimiter FROM events WHERE {} GROUP BY user_id"


@query(f"""WITH b AS ({_NAMES.format('event_id % 2 = 0')}), a AS ({_NAMES.format('event_id % 2 = 1')}),
j AS (SELECT resource_id, list_sort(list_filter(a.names, lambda x: NOT list_contains(b.names, x))) AS added, list_sort(list_filter(b.names, lambda x: NOT list_contains(a.names, x))) AS removed, a.delimiter IS DISTINCT FROM b.delimiter AS d FROM a JOIN b USING (resource_id))
SELECT resource_id, array_to_string(added, ',') AS columns_added, array_to_string(removed, ',') AS columns_removed, d AS delimiter_changed FROM j WHERE len(added) > 0 OR len(removed) > 0 OR d""")
def drift_observed(spark, sf):
    def read(odd):
        e = table(spark, sf, "events").where(f"event_id % 2 = {odd}")
        return e.groupBy(F.col("user_id").alias("resource_id")).agg(F.array_sort(F.collect_set(F.expr("concat(event_type, '_', event_id % 3)"))).alias("names"), F.max(F.expr("CASE WHEN event_id % 500 = 0 THEN ';' ELSE ',' END")).alias("delimiter"), F.lit("utf-8").alias("encoding"), F.lit(1).alias("distinct_headers"))

    return D.observed(read(0), read(1)).select("resource_id", joined(F.array_sort("columns_added")).alias("columns_added"), joined(F.array_sort("columns_removed")).alias("columns_removed"), F.col("delimiter").isNotNull().alias("delimiter_changed"))


_FIELDS = "SELECT user_id AS resource_id, event_type AS name, CASE WHEN max(value) > {} THEN 'number' ELSE 'string' END AS type FROM events WHERE {} GROUP BY ALL"


@query(f"""WITH b AS ({_FIELDS.format(50, 'event_id % 3 <> 0')}), a AS ({_FIELDS.format(40, 'event_id % 3 <> 1')}),
j AS (SELECT coalesce(b.resource_id, a.resource_id) AS r, coalesce(b.name, a.name) AS n, b.type AS old, a.type AS new FROM b FULL JOIN a ON b.resource_id = a.resource_id AND b.name = a.name)
SELECT r AS resource_id, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS removed, count(*) FILTER (old <> new) AS retyped, r NOT IN (SELECT resource_id FROM a) AS schema_removed FROM j WHERE old IS DISTINCT FROM new AND r IN (SELECT resource_id FROM b) GROUP BY r""")
def drift_declared(spark, sf):
    def read(limit, skip):
        return table(spark, sf, "events").where(f"event_id % 3 <> {skip}").groupBy(F.col("user_id").alias("resource_id"), F.lit("declared").alias("kind"), F.col("event_type").alias("name")).agg(F.when(F.max("value") > limit, "number").otherwise("string").alias("type"))

    n = lambda c: F.size(c).cast("bigint")
    return D.declared(read(50, 0), read(40, 1)).select("resource_id", n("fields_added").alias("added"), n("fields_removed").alias("removed"), n("types_changed").alias("retyped"), "schema_removed")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def drift_append(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return D.new_events(e.where("id % 3 = 0"), e.where("id % 2 = 0"))


@query("SELECT user_id, '[L1] d / f|x: file structure changed' AS title, count(*) AS n FROM events GROUP BY user_id".replace("f|x", "f/x"))
def issue_titles(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(D.issue_title(F.lit("observed"), F.lit("d"), F.lit("f|x")).alias("title"), F.count("*").alias("n"))


@query("SELECT event_id AS seq FROM events WHERE event_id % 5 <> 0 ORDER BY seq LIMIT 15")
def issues_to_open(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lpad(F.lower(F.hex("event_id")), 16, "0").alias("id"))
    opened = e.where("seq % 5 = 0").select(F.concat(F.lit("<!-- drift:"), "id", F.lit(" -->")).alias("body"))
    return D.to_open(e, opened).select("seq")


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'name' || user_id ELSE event_type END AS file FROM events ORDER BY seq DESC LIMIT 100")
def last_events(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("resource_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("resource_name"))
    return D.last_events(log, e.select(F.col("user_id").alias("resource_id"), F.concat(F.lit("name"), F.col("user_id").cast("string")).alias("name")).distinct()).select("seq", "file")


@query("SELECT source AS dataset, CASE WHEN n % 3 <> 0 THEN 'read' WHEN n % 2 = 0 THEN 'keep' ELSE 'hold' END AS state FROM (SELECT source, substr(source, 4)::INT AS n FROM documents GROUP BY source)")
def kept_readings(spark, sf):
    s = table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.substring("source", 4, 9).cast("int").alias("n")).distinct()
    now = F.lit("2024-03-01").cast("timestamp")
    old = s.where("n % 5 <> 4 or n % 2 = 0").select("dataset", F.when(F.col("n") % 2 == 0, "2024-02-20").otherwise("2024-01-01").cast("timestamp").alias("read_at"))
    return P.kept_readings(s.select("dataset", (F.col("n") % 3 == 0).alias("unreachable")), old, now).select("dataset", "state")


@query("SELECT 'd' || user_id % 100 AS dictionary_id, arg_max(h, n * 1e9 - first) AS header FROM (SELECT user_id % 100 AS user_id, event_type AS h, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY ALL")
def common_headers(spark, sf):
    e = table(spark, sf, "events")
    links = e.select(F.expr("concat('d', user_id % 100)").alias("dictionary_id"), F.col("event_id").alias("resource_id"), F.col("event_id").alias("pos"))
    return E.common_header(links, e.select(F.col("event_id").alias("resource_id"), F.array("event_type").alias("header"))).select("dictionary_id", F.element_at("header", 1).alias("header"))


@query("SELECT event_id AS dictionary_id FROM events WHERE event_id % 4 <> 0 AND (event_id % 3 = 0 OR event_id % 5 = 0)")
def extraction_tasks(spark, sf):
    e = table(spark, sf, "events")
    d = e.select(F.col("event_id").alias("dictionary_id"), F.when(F.col("event_id") % 4 != 0, "PDF").otherwise("CSV").alias("format"), F.lit("s").alias("sha256"), F.array(F.lit("h")).alias("header"), F.lit(True).alias("all_done"), F.lit(1).alias("linked"))
    r = e.select(F.col("event_id").alias("dictionary_id"), F.when(F.col("event_id") % 3 == 0, "old").otherwise("s").alias("sha256"), F.when(F.col("event_id") % 5 == 0, "v1").otherwise("v2").alias("reader_version"), F.lit("llm-needed").alias("outcome"), F.lit("m").alias("model"), F.lit("p").alias("prompt_version"))
    return E.tasks(d, r, "deterministic", "v2", "m", "p").select("dictionary_id")


@query("""WITH o AS (SELECT event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE (event_id % 10) / 10.0 END AS v FROM events WHERE event_id % 7 <> 0)
SELECT stage, 'recall' AS metric, count(*) AS n, round(avg(v), 4)::DOUBLE AS mean, round(median(v), 4)::DOUBLE AS median, count(*) FILTER (v = 1.0) AS perfect FROM o GROUP BY stage""")
def stage_stats(spark, sf):
    o = table(spark, sf, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 7 != 0).alias("available"), F.when(F.col("event_id") % 3 == 0, F.lit(1.0)).otherwise((F.col("event_id") % 10) / 10.0).alias("recall"), *[F.lit(None).cast("double").alias(m) for m in E.METRICS[1:]])
    return E.stage_stats(o)
