"""Figures over one wide table of files: levels, coverage, conformance, sizes, network, delivery, history.

`facts` has a row for each file: id, dataset, name, url, host, size, candidate, level, status, not_tabular_kind, error,
schema_kind, passed, missing, undeclared (numbers of names), error_rate, bytes, seconds, first_byte_s, download_s, network_s, kind, etag,
last_modified, content_length, content_type, served_by. Each report is one aggregate (or few) over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import share

MAX_ERROR_RATE, PASS_THRESHOLD = 0.01, 0.85
LEVELS = 5
#: Media types that say nothing about the content, and formats that have a registered one.
GENERIC_TYPES = ("application/octet-stream", "binary/octet-stream", "application/download", "application/force-download", "application/unknown")
TYPED_KINDS = ("csv", "zip", "json", "xml", "xlsx", "xls", "ods")
SUGGESTIONS = ("broken-links", "redirect-loops", "byte-ranges", "validators", "media-type", "length")


def error_kind(message: Column) -> Column:
    """`HTTP 404`, `no URL`, `redirect loop`, `batch time limit`, the exception's name, or other."""
    m = F.coalesce(message, F.lit(""))
    code = F.regexp_extract(m, r"\b([45][0-9][0-9]) (Client|Server) Error", 1)
    out = F.when(code != "", F.concat(F.lit("HTTP "), code)).when(m.rlike("MissingSchema|InvalidURL|InvalidSchema"), "no URL").when(m.contains("TooManyRedirects"), "redirect loop").when(m.contains("did not finish within the batch"), "batch time limit")
    for name in ("Timeout", "ConnectionError", "SSLError", "ChunkedEncodingError"):
        out = out.when(m.contains(name), name)
    return out.otherwise("other")


def download_kind(status: Column, exception: Column) -> Column:
    """unreachable (the server did not answer: asked again) or download-failed (the portal's answer)."""
    return F.when(status.isNotNull(), F.when(status >= 500, "unreachable").otherwise("download-failed")).when(exception == "SSLError", "download-failed").when(exception.isin("ConnectionError", "Timeout", "ConnectTimeout", "ReadTimeout", "ChunkedEncodingError", "ProtocolError"), "unreachable").otherwise("download-failed")


def not_a_table(status: Column, kind: Column, error: Column) -> Column:
    e = F.coalesce(error, F.lit(""))
    return F.coalesce((status == "not-tabular") & (F.coalesce(kind == "no-tables", F.lit(False)) | e.contains("without CSV members") | e.contains("without tables")), F.lit(False))


def level_of(attached: Column, store_typed: Column, dict_kind: Column, dict_readable: Column, described: Column) -> Column:
    """Documentation level 0 to 3 of a file."""
    return F.when(attached | store_typed, 3).when(dict_kind.isNull(), F.when(described > 0, 1).otherwise(0)).when((dict_kind == "machine") & dict_readable, 2).otherwise(1)


def table_level(level: Column, passed: Column) -> Column:
    """Level 4: of level 3, and it conforms."""
    return F.when((level == 3) & F.coalesce(passed, F.lit(False)), 4).otherwise(level)


def size_bytes(size: Column) -> Column:
    return F.coalesce(size.cast("string").try_cast("bigint"), F.lit(0))


def tabular(facts: DataFrame) -> DataFrame:
    return facts.where(~not_a_table(F.col("status"), F.col("not_tabular_kind"), F.col("error")))


def coverage(facts: DataFrame) -> DataFrame:
    """One row: from all files to conforming ones, with the reason at every step."""
    is_ = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    large = is_("not-tabular") & F.coalesce(F.col("not_tabular_kind") == "too-large", F.lit(False))
    checked = is_("ok") & F.col("passed").isNotNull()
    failing, over = checked & ~F.col("passed"), F.col("error_rate") > MAX_ERROR_RATE
    counts = {
        "read": is_("ok"), "empty": is_("empty"), "not_tabular": is_("not-tabular") & ~large, "too_large": large, "not_downloaded": is_("error"), "pending": F.col("status").isNull(), "read_without_schema": is_("ok") & F.col("passed").isNull(),
        "checked": checked, "conform": checked & F.col("passed"), "fail_missing_fields": failing & (F.col("missing") > 0), "fail_undeclared_columns": failing & (F.col("undeclared") > 0), "fail_cells_over_limit": failing & over,
        "fail_only_cells": failing & over & (F.col("missing") == 0) & (F.col("undeclared") == 0),
    }
    return tabular(facts).agg(F.count("*").alias("files"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def not_downloaded(facts: DataFrame) -> DataFrame:
    """reason, host and files that could not be downloaded, by reason and, with host null, in total of a reason."""
    rows = tabular(facts).where("status = 'error'").select(error_kind(F.col("error")).alias("reason"), F.coalesce("host", F.lit("—")).alias("host"))
    return rows.groupingSets([["reason", "host"], ["reason"]], "reason", "host").agg(F.count("*").alias("files"))


def sizes(facts: DataFrame) -> DataFrame:
    """format, files, gb and size_unknown, the format of most files first."""
    known = F.col("size").cast("string").try_cast("bigint")
    out = facts.groupBy(F.coalesce("candidate", F.lit("?")).alias("format")).agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum(known), F.lit(0)) / 1e9, 2).alias("gb"), F.count_if(known.isNull() | (known == 0)).alias("size_unknown"))
    return out.orderBy(F.desc("files"), "format")


def queue_size(facts: DataFrame, queue: DataFrame) -> DataFrame:
    return facts.join(queue.select("id").distinct(), "id", "left_semi").agg(F.round(F.coalesce(F.sum(size_bytes(F.col("size"))), F.lit(0)) / 1e9, 2).alias("queue_gb"))


def queue_largest(facts: DataFrame, queue: DataFrame, most: int = 5) -> DataFrame:
    left = facts.join(queue.select("id").distinct(), "id", "left_semi").withColumn("bytes_left", size_bytes(F.col("size")))
    return left.where("bytes_left > 0").orderBy(F.desc("bytes_left"), "id").limit(most).select("id", "name", F.round(F.col("bytes_left") / 1e9, 2).alias("gb"))


def network(facts: DataFrame) -> DataFrame:
    """Figures of each host and, with host null, of all: one aggregate over grouping sets.

    The median of the first byte is the upper one: the smallest value that more than half of the values do not exceed.
    """
    tried = facts.where(F.col("status").isin("ok", "empty", "not-tabular", "error"))
    timed = (F.col("status") != "error") & (F.coalesce("bytes", F.lit(0)) > 0) & (F.coalesce("seconds", F.lit(0.0)) > 0)
    net, zipped = timed & F.col("network_s").isNotNull(), timed & (F.col("kind") == "zip") & (F.col("download_s") > 0)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")
    mb_s = lambda b, s: F.round(F.try_divide(b, s) / 1e6, 2)
    rows = tried.withColumn("host", F.coalesce("host", F.lit("—"))).withColumn("first", F.when(timed, F.col("first_byte_s")))
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY first DESC)")  # from above: the upper one
    return rows.groupingSets([["host"], []], "host").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "error").alias("failed_files"), F.round(total("bytes", timed) / 1e9, 2).alias("gb"), F.round(total("seconds", timed) / 60, 1).alias("minutes"),
        mb_s(total("bytes", timed), total("seconds", timed)).alias("end_to_end_mb_s"), mb_s(total("bytes", zipped), total("download_s", zipped)).alias("zip_download_mb_s"), upper.alias("first_byte_s_median"),
        F.round(F.try_divide(total("network_s", net), total("seconds", net)), 3).alias("network_share"), mb_s(total("bytes", net), total("network_s", net)).alias("network_mb_s"),
    )


def delivery(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """How each host delivers its files, from the files checked or, before any was, from the survey's probes.
    probes: host, status, etag, last_modified, content_length, content_type, candidate."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    generic = F.col("content_type").isNull() | F.col("content_type").isin(*GENERIC_TYPES)
    got = F.coalesce(F.col("status").isin("ok", "empty"), F.lit(False))
    kind = error_kind(F.col("error"))
    bad = F.coalesce(F.col("status") == "error", F.lit(False))
    seen = facts.where("host is not null").groupBy("host").agg(
        F.count("*").alias("linked"), F.count_if(got).alias("files"), F.count_if(got & ~empty("etag")).alias("with_etag"), F.count_if(got & ~empty("last_modified")).alias("with_last_modified"),
        F.count_if(got & empty("etag") & empty("last_modified")).alias("f_validator"), F.count_if(got & F.col("content_length").isNull()).alias("f_length"), F.count_if(got & F.col("kind").isin(*TYPED_KINDS) & generic).alias("f_generic"),
        F.count_if(bad & kind.isin("HTTP 404", "HTTP 410")).alias("broken_links"), F.count_if(bad & (kind == "redirect loop")).alias("redirect_loops"),
    )
    ok = F.col("status").isin(200, 206)
    typed = ok & F.col("candidate").isin(*TYPED_KINDS)
    asked = probes.groupBy("host").agg(
        F.count("*").alias("probes"), F.count_if(ok).alias("answered"), F.count_if(F.col("status") == 206).alias("ranged"), F.count_if(ok & empty("etag") & empty("last_modified")).alias("p_validator"),
        F.count_if(ok & F.col("content_length").isNull()).alias("p_length"), F.count_if(typed & generic).alias("p_generic"), F.count_if(typed).alias("p_typed"),
    )
    j = seen.join(asked, "host", "full").na.fill(0)
    by_files = F.col("files") > 0
    pick = lambda a, b: F.when(by_files, F.col(a)).otherwise(F.col(b))
    ranges = F.when(F.col("answered") == 0, "unknown").when(F.col("ranged") == F.col("answered"), "honoured").when(F.col("ranged") == 0, "ignored").otherwise("partly")
    return j.select("host", "linked", "files", "probes", "answered", "ranged", ranges.alias("range"), "with_etag", "with_last_modified", pick("f_validator", "p_validator").alias("without_validator"), pick("f_length", "p_length").alias("without_length"), pick("files", "answered").alias("of"), pick("f_generic", "p_generic").alias("generic_type"), pick("files", "p_typed").alias("typed"), "broken_links", "redirect_loops")


def suggestions(delivered: DataFrame) -> DataFrame:
    """host, id, n and of: what was observed beside what HTTP provides for it, one of each kind and host."""
    ignored = F.when(F.col("range").isin("ignored", "partly"), F.col("answered") - F.col("ranged")).otherwise(F.lit(0))
    found = {"broken-links": ("broken_links", "linked"), "redirect-loops": ("redirect_loops", "linked"), "byte-ranges": (ignored, "answered"), "validators": ("without_validator", "of"), "media-type": ("generic_type", "typed"), "length": ("without_length", "of")}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("id"), as_col(found[s][0]).cast("bigint").alias("n"), as_col(found[s][1]).cast("bigint").alias("of")) for i, s in enumerate(SUGGESTIONS)])
    return delivered.select("host", F.explode(rows).alias("x")).select("host", "x.*").where("n > 0")


def dataset_levels(facts: DataFrame) -> DataFrame:
    """dataset, level (the lowest of its files), tables, verifiable, conformant and rate."""
    level = table_level(F.col("level"), F.col("passed"))
    ok, known = F.coalesce(F.col("passed"), F.lit(False)), F.col("passed").isNotNull()
    return tabular(facts).groupBy("dataset").agg(F.min(level).alias("level"), F.count("*").alias("tables"), F.count_if(known).alias("verifiable"), F.count_if(ok).alias("conformant"), share(F.count_if(ok), F.count_if(known)).alias("l1_rate"))


def level_counts(levels: DataFrame) -> DataFrame:
    """level 0 to 4 and how many, with zeros."""
    counts = levels.groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("n"))
    return levels.sparkSession.range(LEVELS).select(F.col("id").alias("level")).join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def by_source(facts: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return tabular(facts).where("passed is not null").groupBy("schema_kind").agg(F.count("*").alias("verifiable"), F.count_if(ok).alias("conformant"), share(F.count_if(ok), F.count("*")).alias("l1_rate"))


def summary(facts: DataFrame) -> DataFrame:
    """One row: files, validated, verifiable, conformant, the rate and whether the layer passes."""
    ok, known = F.coalesce(F.col("passed"), F.lit(False)), F.col("passed").isNotNull()
    done = F.coalesce(F.col("status").isin("ok", "empty", "not-tabular"), F.lit(False))
    out = tabular(facts).agg(F.count("*").alias("tables"), F.count_if(done).alias("validated"), F.count_if(F.coalesce(F.col("status") == "error", F.lit(False))).alias("errors"), F.count_if(known).alias("verifiable"), F.count_if(ok).alias("conformant"))
    rate = share(F.col("conformant"), F.col("verifiable"))
    return out.select("*", share(F.col("validated"), F.col("tables")).alias("validation_coverage"), rate.alias("l1_rate"), F.coalesce(rate >= PASS_THRESHOLD, F.lit(False)).alias("l1_pass"))


def drift_baseline(validation: DataFrame) -> DataFrame:
    return validation.where("status = 'ok' and has_header").agg(F.count("*").alias("files_with_baseline"), F.min("validated_at").alias("first_baseline_at"), F.max("validated_at").alias("last_observed_at"))


def unreadable(facts: DataFrame) -> DataFrame:
    """Files that gave no table, with the reason."""
    f = facts.where(F.col("status").isin("error", "not-tabular", "empty"))
    gone = not_a_table(F.col("status"), F.col("not_tabular_kind"), F.col("error"))
    why = F.when(F.col("status") == "error", error_kind(F.col("error"))).when(gone, "not-a-table").otherwise(F.col("status"))
    return f.select("dataset", "id", "name", "url", "host", "status", why.alias("reason"), F.left(F.coalesce("error", F.lit("")), F.lit(200)).alias("detail"))


def transitions(verdicts: DataFrame, since: Column) -> DataFrame:
    """fixed, broken and unchanged files whose last verdict (id, at, pass) is not before `since`, by the one before it."""
    order = Window.partitionBy("id").orderBy("at")
    last = verdicts.withColumn("before", F.lag("pass").over(order)).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))).where((F.col("nth") == 1) & (F.col("at") >= since) & F.col("before").isNotNull())
    return last.agg(F.count_if(~F.col("before") & F.col("pass")).alias("fixed"), F.count_if(F.col("before") & ~F.col("pass")).alias("broken"), F.count_if(F.col("before") == F.col("pass")).alias("same"))


def run_transitions(verdicts: DataFrame, tables: DataFrame, first_seen: DataFrame, since: Column) -> DataFrame:
    """One row of what a run changed: files fixed, broken and the same by their last two verdicts (id, at, pass), files first
    seen since then (id, first_seen), and files with a verdict that are no longer among the tables (id)."""
    here = verdicts.join(tables.select("id"), "id", "left_semi")
    gone = verdicts.select("id").distinct().join(tables.select("id"), "id", "left_anti").agg(F.count("*").alias("gone"))
    new = tables.select("id").distinct().join(first_seen, "id").agg(F.count_if(F.col("first_seen") >= since).alias("new"))
    return transitions(here, since).crossJoin(F.broadcast(new)).crossJoin(F.broadcast(gone))  # of one row each


def upserted_history(history: DataFrame, row: DataFrame) -> DataFrame:
    """history with the row of this run: the later report of one `at` replaces the earlier."""
    order = Window.partitionBy("at").orderBy(F.desc("report_at"))
    return history.unionByName(row).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def compared_formats(distributions: DataFrame) -> DataFrame:
    """One row over tables in other formats: compared, same_columns, spelling_only, different_columns, not_compared."""
    ok = F.col("status") == "ok"
    return distributions.agg(F.count("*").alias("other_formats"), F.count_if(ok).alias("compared"), F.count_if(ok & F.col("same_columns")).alias("same_columns"), F.count_if(ok & ~F.col("same_columns") & F.col("spelling_only")).alias("spelling_only"), F.count_if(ok & ~F.col("same_columns") & ~F.col("spelling_only")).alias("different_columns"), F.count_if(~ok).alias("not_compared"))


def most_common(values: DataFrame, value: str, pos: str, most: int) -> DataFrame:
    """The most frequent values; of equals the one that came first."""
    return values.groupBy(value).agg(F.count("*").alias("n"), F.min(pos).alias("first")).orderBy(F.desc("n"), "first").limit(most)


def documentation(dictionaries: DataFrame) -> DataFrame:
    """One row of findings on dictionaries (format, kind, readable, error_kind, linked, declared_ids, broken_ids, other_dataset)."""
    machine = F.col("kind") == "machine"
    return dictionaries.agg(F.count("*").alias("total"), F.count_if(machine).alias("machine_readable"), F.count_if(F.col("kind") == "human").alias("human_readable"), F.count_if(machine & F.col("readable")).alias("machine_readable_and_read"), F.count_if((F.col("format") == "PDF") & F.col("error_kind").isin("html-page", "malformed")).alias("pdf_link_not_a_pdf"), F.count_if(F.col("error_kind") == "unreachable").alias("unreachable"), F.count_if(F.col("linked") == 0).alias("orphans"), F.count_if(F.col("declared_ids") > 0).alias("declaring_resource_ids"), F.count_if(F.col("broken_ids") > 0).alias("broken_declared_links"), F.count_if(F.col("other_dataset")).alias("naming_another_dataset"))


def unread_reasons(dictionaries: DataFrame) -> DataFrame:
    return dictionaries.where((F.col("kind") == "machine") & ~F.col("readable") & (F.coalesce("error_kind", F.lit("other")) != "unreachable")).groupBy(F.coalesce("error_kind", F.lit("other")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def searched_pairs(pairs: DataFrame, text: str) -> DataFrame:
    """Pairs of alike names (title, dataset, file, declared, column) of which one text holds `text`, without case."""
    sought = F.lit(text.strip().lower())
    return pairs.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(sought) for c in ("title", "dataset", "file", "declared", "column")]))


def pdf_dictionaries(dictionaries: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """Every PDF dictionary that describes a file, and what became of it.

    dictionaries: dataset, dictionary_id, name, format. links: dictionary_id, table_id. records: dictionary_id, outcome, stage, recall, precision.
    """
    files = links.groupBy("dictionary_id").agg(F.count_distinct("table_id").alias("files"))
    listed = dictionaries.where("format = 'PDF'").join(files, "dictionary_id").join(records, "dictionary_id", "left")
    return listed.select("dataset", "dictionary_id", "name", "files", F.coalesce("outcome", F.lit("pending")).alias("outcome"), "stage", "recall", "precision")


def failure_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind and n of the failed requests between two counts (kind, n); kinds that did not grow are left out."""
    more = F.col("n") - F.coalesce("old", F.lit(0))
    return after.join(before.withColumnRenamed("n", "old"), "kind", "left").select("kind", more.alias("n")).where("n > 0")


def similar_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of alike names (dataset, declared, column, similarity), the most alike first."""
    return pairs.orderBy(F.desc("similarity"), "dataset", "declared")


def portals_side_by_side(metrics: DataFrame, portals: list[str]) -> DataFrame:
    """metrics (portal, metric, value) with a column a portal. The portals are named, so the pivot needs no pass to find them."""
    return metrics.groupBy("metric").pivot("portal", portals).agg(F.first("value", True))


def badge(done: Column, left: Column, conformant: Column, verifiable: Column, date: Column) -> Column:
    """The status line in English and Portuguese."""
    en = F.when(done, F.format_string("done %s · %d/%d files conform", date, conformant, verifiable)).otherwise(F.format_string("running · %d files left to check", left))
    pt = F.when(done, F.format_string("concluída em %s · %d/%d arquivos conformes", date, conformant, verifiable)).otherwise(F.format_string("rodando · faltam %d arquivos", left))
    return F.struct(en.alias("en"), pt.alias("pt"), F.when(done, "brightgreen").otherwise("blue").alias("color"))


def dashboard(facts: DataFrame, events: DataFrame, queue: DataFrame) -> DataFrame:
    """One row a dataset with its files nested, each with its level, verdict, drift events and whether it waits."""
    drifted = events.groupBy(F.col("resource_id").alias("id")).agg(F.count("*").alias("drift_events"))
    waits = queue.select("id").distinct().withColumn("waits", F.lit(True))
    j = facts.join(drifted, "id", "left").join(waits, "id", "left")
    file = F.struct("id", "name", table_level(F.col("level"), F.col("passed")).alias("level"), "status", "passed", F.coalesce("drift_events", F.lit(0)).alias("drift_events"), F.coalesce("waits", F.lit(False)).alias("queued"))
    return j.groupBy("dataset").agg(F.array_sort(F.collect_list(file)).alias("files"))


def searched(files: DataFrame, text: str = "", level: int | None = None, failing: bool = False) -> DataFrame:
    """Files whose name holds a text, of a level, or that fail."""
    out = files.where(F.lower("name").contains(text.lower())) if text else files
    out = out.where(table_level(F.col("level"), F.col("passed")) == level) if level is not None else out
    return out.where(~F.coalesce(F.col("passed"), F.lit(True))) if failing else out
