"""Queries on reports: coverage, sizes, network, delivery, levels, conformance, and lists for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import reporting as R
from ..session import table
from .common import SQL_FACTS, facts, registry

QUERIES, SQL, query = registry()
_F = f"WITH f AS ({SQL_FACTS}), t AS (SELECT * FROM f WHERE NOT coalesce(status = 'not-tabular' AND not_tabular_kind = 'no-tables', false))"
_REASON = "CASE WHEN error LIKE '%404 Client%' THEN 'HTTP 404' WHEN error LIKE '%503 Server%' THEN 'HTTP 503' WHEN error LIKE '%InvalidURL%' THEN 'no URL' WHEN error LIKE '%TooManyRedirects%' THEN 'redirect loop' WHEN error LIKE '%Timeout%' THEN 'Timeout' ELSE 'other' END"


@query(_F + """
SELECT count(*) AS files, count(*) FILTER (status = 'ok') AS read, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'not-tabular' AND not_tabular_kind <> 'too-large') AS not_tabular, count(*) FILTER (status = 'not-tabular' AND not_tabular_kind = 'too-large') AS too_large,
  count(*) FILTER (status = 'error') AS not_downloaded, count(*) FILTER (status IS NULL) AS pending, count(*) FILTER (status = 'ok' AND passed IS NULL) AS read_without_schema, count(*) FILTER (status = 'ok' AND passed IS NOT NULL) AS checked, count(*) FILTER (status = 'ok' AND passed) AS conform,
  count(*) FILTER (status = 'ok' AND NOT passed AND missing > 0) AS fail_missing_fields, count(*) FILTER (status = 'ok' AND NOT passed AND undeclared > 0) AS fail_undeclared_columns, count(*) FILTER (status = 'ok' AND NOT passed AND error_rate > 0.01) AS fail_cells_over_limit,
  count(*) FILTER (status = 'ok' AND NOT passed AND error_rate > 0.01 AND missing = 0 AND undeclared = 0) AS fail_only_cells FROM t""")
def coverage_funnel(spark, sf):
    return R.coverage(facts(spark, sf))


@query(_F + f", r AS (SELECT {_REASON} AS reason, coalesce(host, '—') AS host FROM t WHERE status = 'error') SELECT reason, host, count(*) AS files FROM r GROUP BY GROUPING SETS ((reason, host), (reason))")
def not_downloaded(spark, sf):
    return R.not_downloaded(facts(spark, sf))


@query(_F + ", s AS (SELECT coalesce(candidate, '?') AS format, try_cast(size AS BIGINT) AS n FROM f) SELECT format, count(*) AS files, round(coalesce(sum(n), 0) / 1e9, 2)::DOUBLE AS gb, count(*) FILTER (n IS NULL OR n = 0) AS size_unknown FROM s GROUP BY format")
def sizes_by_format(spark, sf):
    return R.sizes(facts(spark, sf))


@query(_F + "SELECT id, name, round(try_cast(size AS BIGINT) / 1e9, 2)::DOUBLE AS gb FROM f WHERE id % 3 = 0 AND try_cast(size AS BIGINT) > 0 ORDER BY try_cast(size AS BIGINT) DESC, id LIMIT 5")
def queue_largest(spark, sf):
    f = facts(spark, sf)
    return R.queue_largest(f, f.where("id % 3 = 0").select("id"))


@query(_F + "SELECT round(sum(coalesce(try_cast(size AS BIGINT), 0)) / 1e9, 2)::DOUBLE AS queue_gb FROM f WHERE id % 3 = 0")
def queue_size(spark, sf):
    f = facts(spark, sf)
    return R.queue_size(f, f.where("id % 3 = 0").select("id"))


@query(_F + """
, n AS (SELECT *, coalesce(host, '—') AS h, status <> 'error' AND bytes > 0 AND seconds > 0 AS ok FROM f WHERE status IS NOT NULL)
SELECT h AS host, count(*) AS files, count(*) FILTER (status = 'error') AS failed_files, round(coalesce(sum(bytes) FILTER (ok), 0) / 1e9, 2)::DOUBLE AS gb, round(coalesce(sum(seconds) FILTER (ok), 0) / 60, 1)::DOUBLE AS minutes,
  round(sum(bytes) FILTER (ok) / sum(seconds) FILTER (ok) / 1e6, 2)::DOUBLE AS end_to_end_mb_s, round(sum(bytes) FILTER (ok AND kind = 'zip' AND download_s > 0) / sum(download_s) FILTER (ok AND kind = 'zip' AND download_s > 0) / 1e6, 2)::DOUBLE AS zip_download_mb_s,
  list_sort(list(first_byte_s) FILTER (ok AND first_byte_s IS NOT NULL))[(count(first_byte_s) FILTER (ok)) // 2 + 1]::DOUBLE AS first_byte_s_median, round(sum(network_s) FILTER (ok AND network_s IS NOT NULL) / sum(seconds) FILTER (ok AND network_s IS NOT NULL), 3)::DOUBLE AS network_share,
  round(sum(bytes) FILTER (ok AND network_s IS NOT NULL) / sum(network_s) FILTER (ok AND network_s IS NOT NULL) / 1e6, 2)::DOUBLE AS network_mb_s
FROM n GROUP BY GROUPING SETS ((h), ())""")
def network_by_host(spark, sf):
    return R.network(facts(spark, sf))


_GENERIC = "(content_type IS NULL OR content_type = 'application/octet-stream')"
_DELIVERY = _F + f"""
, seen AS (SELECT host, count(*) AS linked, count(*) FILTER (g) AS files, count(*) FILTER (g AND etag IS NOT NULL) AS with_etag, count(*) FILTER (g AND last_modified IS NOT NULL) AS with_last_modified, count(*) FILTER (g AND etag IS NULL AND last_modified IS NULL) AS fv,
  count(*) FILTER (g AND content_length IS NULL) AS fl, count(*) FILTER (g AND kind IN ('zip', 'csv') AND {_GENERIC}) AS fg, count(*) FILTER (status = 'error' AND error LIKE '%404 Client%') AS broken_links, count(*) FILTER (status = 'error' AND error LIKE '%TooManyRedirects%') AS redirect_loops
  FROM (SELECT *, coalesce(status IN ('ok', 'empty'), false) AS g FROM f) WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT host, CASE id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 206 END AS s, etag, last_modified, content_length, content_type, candidate FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY host, dataset ORDER BY id) AS nth FROM f WHERE host IS NOT NULL) WHERE nth = 1) WHERE place <= 3),
asked AS (SELECT host, count(*) AS probes, count(*) FILTER (s IN (200, 206)) AS answered, count(*) FILTER (s = 206) AS ranged, count(*) FILTER (s <> 404 AND etag IS NULL AND last_modified IS NULL) AS pv, count(*) FILTER (s <> 404 AND content_length IS NULL) AS pl, count(*) FILTER (s <> 404 AND candidate IS NOT NULL AND {_GENERIC}) AS pg, count(*) FILTER (s <> 404 AND candidate IS NOT NULL) AS pt FROM p GROUP BY host),
j AS (SELECT coalesce(seen.host, asked.host) AS host, coalesce(linked, 0) AS linked, coalesce(files, 0) AS files, coalesce(probes, 0) AS probes, coalesce(answered, 0) AS answered, coalesce(ranged, 0) AS ranged, coalesce(with_etag, 0) AS with_etag, coalesce(with_last_modified, 0) AS with_last_modified, coalesce(broken_links, 0) AS broken_links, coalesce(redirect_loops, 0) AS redirect_loops,
  CASE WHEN files > 0 THEN fv ELSE pv END AS without_validator, CASE WHEN files > 0 THEN fl ELSE pl END AS without_length, CASE WHEN files > 0 THEN files ELSE answered END AS "of", CASE WHEN files > 0 THEN fg ELSE pg END AS generic_type, CASE WHEN files > 0 THEN files ELSE pt END AS typed FROM seen FULL JOIN asked ON seen.host = asked.host)
"""
_DELIVERED = _DELIVERY + """, d AS (SELECT *, CASE WHEN answered = 0 THEN 'unknown' WHEN ranged = answered THEN 'honoured' WHEN ranged = 0 THEN 'ignored' ELSE 'partly' END AS range FROM j)"""


def _delivered(spark, sf):
    f = facts(spark, sf)
    probes = P.probe_sample(f.where("host is not null").withColumn("pos", F.col("id"))).selectExpr("host", "CASE id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 206 END AS status", "etag", "last_modified", "content_length", "content_type", "candidate")
    return R.delivery(f, probes)


@query(_DELIVERED + "SELECT * FROM d")
def delivery(spark, sf):
    return _delivered(spark, sf)


@query(_DELIVERED + """, s AS (
  SELECT host, 0 AS nth, 'broken-links' AS id, broken_links AS n, linked AS "of" FROM d UNION ALL SELECT host, 1, 'redirect-loops', redirect_loops, linked FROM d UNION ALL SELECT host, 2, 'byte-ranges', CASE WHEN range IN ('ignored', 'partly') THEN answered - ranged ELSE 0 END, answered FROM d
  UNION ALL SELECT host, 3, 'validators', without_validator, "of" FROM d UNION ALL SELECT host, 4, 'media-type', generic_type, typed FROM d UNION ALL SELECT host, 5, 'length', without_length, "of" FROM d)
SELECT * FROM s WHERE n > 0""")
def delivery_suggestions(spark, sf):
    return R.suggestions(_delivered(spark, sf))


_LEVEL = "CASE WHEN level = 3 AND coalesce(passed, false) THEN 4 ELSE level END"


@query(_F + f"SELECT dataset, min({_LEVEL})::BIGINT AS level, count(*) AS tables, count(passed) AS verifiable, count(*) FILTER (passed) AS conformant, CASE WHEN count(passed) > 0 THEN round(count(*) FILTER (passed) / count(passed)::DOUBLE, 4) END AS l1_rate FROM t GROUP BY dataset")
def dataset_levels(spark, sf):
    return R.dataset_levels(facts(spark, sf)).withColumn("level", F.col("level").cast("bigint"))


@query(_F + f"SELECT r.level, count(t.id) AS n FROM range(5) r(level) LEFT JOIN (SELECT id, {_LEVEL} AS level FROM t) t ON t.level = r.level GROUP BY r.level")
def table_levels(spark, sf):
    f = R.tabular(facts(spark, sf))
    return R.level_counts(f.select(R.table_level(F.col("level"), F.col("passed")).alias("level")))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 3 WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END WHEN event_id % 3 = 1 AND event_id % 5 <> 0 THEN 2 ELSE 1 END AS level FROM events")
def documentation_levels(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "event_id % 7 = 0 AS a", "event_id % 11 = 0 AS s", "CASE event_id % 3 WHEN 1 THEN 'machine' WHEN 2 THEN 'human' END AS k", "event_id % 5 <> 0 AS r", "CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS d").select("event_id", R.level_of(F.col("a"), F.col("s"), F.col("k"), F.col("r"), F.col("d")).alias("level"))


@query(_F + "SELECT schema_kind, count(*) AS verifiable, count(*) FILTER (passed) AS conformant, round(count(*) FILTER (passed) / count(*)::DOUBLE, 4) AS l1_rate FROM t WHERE passed IS NOT NULL GROUP BY schema_kind")
def conformance_by_source(spark, sf):
    return R.by_source(facts(spark, sf))


@query(_F + """, s AS (SELECT count(*) AS tables, count(*) FILTER (status IN ('ok', 'empty', 'not-tabular')) AS validated, count(*) FILTER (status = 'error') AS errors, count(passed) AS verifiable, count(*) FILTER (passed) AS conformant FROM t)
SELECT *, round(validated / tables::DOUBLE, 4) AS validation_coverage, round(conformant / verifiable::DOUBLE, 4) AS l1_rate, conformant / verifiable::DOUBLE >= 0.85 AS l1_pass FROM s""")
def portal_summary(spark, sf):
    return R.summary(facts(spark, sf))


@query("SELECT count(*) AS files_with_baseline, min(ts) AS first_baseline_at, max(ts) AS last_observed_at FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 0")
def drift_baseline(spark, sf):
    v = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, "ok").otherwise("error").alias("status"), (F.col("event_id") % 4 != 0).alias("has_header"), F.col("ts").alias("validated_at"))
    return R.drift_baseline(v)


@query(_F + f"SELECT dataset, id, name, url, host, status, CASE WHEN status = 'error' THEN {_REASON} WHEN not_tabular_kind = 'no-tables' THEN 'not-a-table' ELSE status END AS reason, left(coalesce(error, ''), 200) AS detail FROM f WHERE status IN ('error', 'not-tabular', 'empty')")
def unreadable_list(spark, sf):
    return R.unreadable(facts(spark, sf))


@query("SELECT count(*) AS other_formats, count(*) FILTER (a) AS compared, count(*) FILTER (a AND b) AS same_columns, count(*) FILTER (a AND NOT b AND c) AS spelling_only, count(*) FILTER (a AND NOT b AND NOT c) AS different_columns, count(*) FILTER (NOT a) AS not_compared FROM (SELECT event_id % 4 <> 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c FROM events)")
def compared_formats(spark, sf):
    return R.compared_formats(table(spark, sf, "events").selectExpr("CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'ok' END AS status", "event_id % 3 = 0 AS same_columns", "event_id % 5 = 0 AS spelling_only"))


@query("SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id ORDER BY n DESC, first LIMIT 15")
def most_common(spark, sf):
    return R.most_common(table(spark, sf, "events"), "user_id", "event_id", 15)


_DICTIONARIES = [
    "CASE event_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'CSV' ELSE 'JSON' END AS format", "CASE event_id % 4 WHEN 0 THEN 'human' ELSE 'machine' END AS kind", "event_id % 3 = 0 AS readable", "CASE event_id % 5 WHEN 0 THEN 'html-page' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'malformed' END AS error_kind",
    "event_id % 6 AS linked", "event_id % 7 AS declared_ids", "event_id % 8 AS broken_ids", "event_id % 9 = 0 AS other_dataset",
]
_DOCS = f"SELECT {', '.join(_DICTIONARIES)} FROM events"


def _docs(spark, sf):
    return table(spark, sf, "events").selectExpr(*_DICTIONARIES)


@query(f"SELECT count(*) AS total, count(*) FILTER (kind = 'machine') AS machine_readable, count(*) FILTER (kind = 'human') AS human_readable, count(*) FILTER (kind = 'machine' AND readable) AS machine_readable_and_read, count(*) FILTER (format = 'PDF' AND error_kind IN ('html-page', 'malformed')) AS pdf_link_not_a_pdf, count(*) FILTER (error_kind = 'unreachable') AS unreachable, count(*) FILTER (linked = 0) AS orphans, count(*) FILTER (declared_ids > 0) AS declaring_resource_ids, count(*) FILTER (broken_ids > 0) AS broken_declared_links, count(*) FILTER (other_dataset) AS naming_another_dataset FROM ({_DOCS})")
def documentation_findings(spark, sf):
    return R.documentation(_docs(spark, sf))


@query(f"SELECT coalesce(error_kind, 'other') AS reason, count(*) AS n FROM ({_DOCS}) WHERE kind = 'machine' AND NOT readable AND coalesce(error_kind, '') <> 'unreachable' GROUP BY ALL")
def unread_dictionaries(spark, sf):
    return R.unread_reasons(_docs(spark, sf))


@query("SELECT o_orderpriority AS metric, sum(o_totalprice) FILTER (s = 'F')::DECIMAL(38, 2)::DOUBLE AS \"F\", sum(o_totalprice) FILTER (s = 'O')::DECIMAL(38, 2)::DOUBLE AS \"O\" FROM (SELECT o_orderpriority, o_orderstatus AS s, o_totalprice::DECIMAL(18, 2) AS o_totalprice FROM orders) GROUP BY o_orderpriority")
def pivot_comparison(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("portal"), F.col("o_orderpriority").alias("metric")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return R.portals_side_by_side(m, ["F", "O"])


@query(_F + f", e AS (SELECT resource_id, count(*) AS n FROM (SELECT id % 500 AS resource_id FROM f) GROUP BY resource_id) SELECT f.dataset, count(*) AS files, sum({_LEVEL})::BIGINT AS levels, sum(coalesce(e.n, 0))::BIGINT AS drift_events, count(*) FILTER (f.id % 3 = 0) AS queued FROM f LEFT JOIN e ON e.resource_id = f.id GROUP BY f.dataset")
def dashboard_projection(spark, sf):
    f = facts(spark, sf)
    d = R.dashboard(f, f.select((F.col("id") % 500).alias("resource_id")), f.where("id % 3 = 0").select("id"))
    total = lambda g: F.aggregate(F.transform("files", g), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return d.select("dataset", F.size("files").cast("bigint").alias("files"), total(lambda x: x["level"].cast("bigint")).alias("levels"), total(lambda x: x["drift_events"].cast("bigint")).alias("drift_events"), total(lambda x: x["queued"].cast("bigint")).alias("queued"))


@query(_F + f"SELECT id FROM f WHERE lower(name) LIKE '%1%' AND {_LEVEL} = 3 AND NOT coalesce(passed, true)")
def dashboard_search(spark, sf):
    return R.searched(facts(spark, sf), "1", 3, True).select("id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'done 2024-01-01 · ' || event_id || '/' || user_id || ' files conform' ELSE 'running · ' || event_id || ' files left to check' END AS en, CASE WHEN event_id % 2 = 0 THEN 'brightgreen' ELSE 'blue' END AS color FROM events")
def status_badge(spark, sf):
    b = R.badge(F.col("event_id") % 2 == 0, F.col("event_id"), F.col("event_id"), F.col("user_id"), F.lit("2024-01-01"))
    return table(spark, sf, "events").select("event_id", b["en"].alias("en"), b["color"].alias("color"))


@query("SELECT e.event_type AS kind, n.n_name AS host, count(*) AS files FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey GROUP BY ALL ORDER BY files DESC, kind, host LIMIT 20")
def hosts_by_files(spark, sf):
    e, n = table(spark, sf, "events"), table(spark, sf, "nation")
    return e.join(F.broadcast(n), (F.col("user_id") % 25) == F.col("n_nationkey")).groupBy(F.col("event_type").alias("kind"), F.col("n_name").alias("host")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "kind", "host").limit(20)  # nation: a table of fixed size
