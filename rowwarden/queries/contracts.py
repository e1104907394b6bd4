"""Queries on contracts: types, inference, conformance, matching of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import types as Y
from ..operators import cells as C
from ..operators import conformance as V
from ..operators import documents as D
from ..operators import matching as M
from ..session import table
from .common import joined, registry, sql_list, sql_norm, sql_normalise

QUERIES, SQL, query = registry()

#: A declared contract of orders: a wrong date format, limits that some values break, a field that is missing and a column that is not declared.
CONTRACT = [
    ("orders", 0, "o_orderkey", "integer", {}), ("orders", 1, "O OrderStatus", "string", {"maxLength": 1, "enum": ["O", "F"]}), ("orders", 2, "o_totalprice", "number", {"maximum": "300000"}),
    ("orders", 3, "o_orderdate", "date", {"format": "%d/%m/%Y"}), ("orders", 4, "o_clerk", "string", {}), ("orders", 5, "o_orderpriority", "string", {"pattern": "[1-4]-.*"}),
]


def contract(spark):
    rows = [(r, p, n, t, *[x.get(c) for c in V.NARROWING]) for r, p, n, t, x in CONTRACT]
    return spark.createDataFrame(rows, T.StructType(V.CONTRACT.fields + [T.StructField(c, T._parse_datatype_string(k)) for c, k in V.NARROWING.items()]))


def order_cells(spark, sf):
    numbered = C.with_ordinals(table(spark, sf, "orders"), "o_orderkey")
    return C.as_cells(numbered, "orders", F.col("row_no"), leave_out=("row_no",))


_ERRORS = """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders),
bad AS (
  SELECT 'O OrderStatus' AS field, 'enum' AS kind, row_no FROM o WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'o_totalprice', 'maximum', row_no FROM o WHERE o_totalprice > 300000
  UNION ALL SELECT 'o_orderdate', 'type', row_no FROM o
  UNION ALL SELECT 'o_orderpriority', 'pattern', row_no FROM o WHERE NOT regexp_full_match(o_orderpriority, '[1-4]-.*'))
"""


@query(_ERRORS + "SELECT 'orders' AS resource_id, field, kind, count(*) AS errors, array_to_string(list(row_no ORDER BY row_no)[1:5], ',') AS first_rows FROM bad GROUP BY field, kind")
def conformance_errors(spark, sf):
    return V.check(order_cells(spark, sf), contract(spark)).errors.withColumn("first_rows", joined("first_rows"))


@query(_ERRORS + """
SELECT 'orders' AS resource_id, n AS rows, 0::BIGINT AS ragged_rows, 'o_clerk' AS missing, 'o_custkey' AS undeclared, (5 * n)::BIGINT AS cells_checked, e AS cells_with_errors, round(e / (5.0 * n), 6)::DOUBLE AS error_rate, false AS pass
FROM (SELECT count(*) AS n FROM orders), (SELECT count(*) AS e FROM bad)""")
def conformance_verdict(spark, sf):
    return V.verdicts(V.check(order_cells(spark, sf), contract(spark))).withColumns({"missing": joined("missing"), "undeclared": joined("undeclared")})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders")
def row_ordinals(spark, sf):
    return C.with_ordinals(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").withColumn("row_no", F.col("row_no").cast("bigint"))


@query("SELECT o_orderkey, concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderpriority) AS cells FROM orders")
def cell_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.array_join(F.array(*[C.cell(F.col(f.name), f.dataType) for f in o.schema.fields]), "|").alias("cells"))


def _sample(spark, sf):
    """Columns of many kinds as text: resource_id, pos, row_no, value; the first 5000 rows."""
    e = C.with_ordinals(table(spark, sf, "events"), "event_id").where(F.col("row_no") <= C.SAMPLE_ROWS)
    cols = [
        F.col("event_id").cast("string"), F.col("event_type"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("user_id") % 2 == 0, "S").otherwise("N"),
        F.concat((F.col("event_id") % 1000).cast("string"), F.lit(","), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")), F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".5")), F.lit(""),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("1."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(",25"))), F.when(F.col("event_id") % 50 == 0, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd")),
    ]
    return e.select(F.lit("events").alias("resource_id"), F.col("row_no").cast("bigint").alias("row_no"), F.posexplode(F.array(*cols)).alias("pos", "value"))


_SAMPLE = f"""
WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= 5000),
cols AS (
  SELECT row_number() OVER (ORDER BY event_id) AS row_no, unnest(range(11)) AS pos, unnest([event_id::VARCHAR, event_type, lpad(user_id::VARCHAR, 9, '0'), strftime(ts, '%d/%m/%Y'), strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN user_id % 2 = 0 THEN 'S' ELSE 'N' END,
    (event_id % 1000)::VARCHAR || ',' || lpad((event_id % 100)::VARCHAR, 2, '0'), (event_id % 1000)::VARCHAR || '.5', '',
    CASE WHEN event_id % 3 = 0 THEN '' ELSE '1.' || lpad((event_id % 1000)::VARCHAR, 3, '0') || ',25' END, CASE WHEN event_id % 50 = 0 THEN 'not a day' ELSE strftime(ts, '%Y-%m-%d') END]) AS value FROM e),
filled AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY row_no) AS nth FROM cols WHERE value <> '')
"""
_SHARES = _SAMPLE + ", shares AS (" + " UNION ALL ".join(f"SELECT pos, {i} AS nth, '{f}' AS format, avg((try_strptime(value, '{f}') IS NOT NULL AND {'length(value) = 8' if f == '%Y%m%d' else 'true'})::INT) AS share FROM filled WHERE nth <= {C.FORMAT_VALUES} GROUP BY pos" for i, f in enumerate(Y.DATE_FORMATS)) + ")"


@query(_SHARES + "SELECT pos, format, share FROM shares")
def format_shares(spark, sf):
    return C.format_shares(_sample(spark, sf), Y.DATE_FORMATS, ["pos"]).select("pos", "format", "share")


@query(_SHARES + "SELECT pos, CASE WHEN max(share) >= 0.5 THEN arg_max(format, share * 1000 - nth * 0.001) END AS format, max(share) AS share FROM shares GROUP BY pos")
def best_date_format(spark, sf):
    return C.best_format(_sample(spark, sf), Y.DATE_FORMATS, ["pos"])


@query(_SAMPLE + r"""
, flags AS (
  SELECT c.pos, count(*) AS cells, count(*) FILTER (value <> '') AS n, coalesce(bool_or(regexp_matches(value, '^[+-]?0[0-9]+$')) FILTER (value <> ''), false) AS zero, bool_and(regexp_matches(value, '^[+-]?(0|[1-9][0-9]*)$')) FILTER (value <> '') AS whole,
    bool_and(regexp_matches(value, '^[+-]?[0-9]*\.[0-9]+$|^[+-]?[0-9]+$')) FILTER (value <> '') AS dot, bool_and(regexp_matches(value, '^[+-]?([0-9]{1,3}(\.[0-9]{3})+|[0-9]*),[0-9]+$|^[+-]?[0-9]+$')) FILTER (value <> '') AS comma, bool_or(regexp_matches(value, '^[+-]?[0-9]{1,3}(\.[0-9]{3})+')) FILTER (value <> '') AS grouped,
    bool_and(value IN ('S', 'N')) FILTER (value <> '') AND count(DISTINCT value) FILTER (value <> '') = 2 AS pair
  FROM cols c GROUP BY c.pos),
times AS (SELECT pos, bool_and(try_strptime(value, '%d/%m/%Y') IS NOT NULL) AS dmy, bool_and(try_strptime(value, '%Y-%m-%dT%H:%M:%S') IS NOT NULL) AS iso FROM filled WHERE nth <= 500 GROUP BY pos)
SELECT f.pos, t.type, CASE t.type WHEN 'date' THEN '%d/%m/%Y' WHEN 'datetime' THEN '%Y-%m-%dT%H:%M:%S' END AS format, CASE WHEN t.type = 'number' AND NOT dot THEN ',' END AS "decimalChar", CASE WHEN t.type = 'number' AND NOT dot AND grouped THEN '.' END AS "groupChar",
  CASE WHEN t.type = 'boolean' THEN 'S' END AS "trueValues", CASE WHEN t.type = 'boolean' THEN 'N' END AS "falseValues", round((cells - n)::DOUBLE / cells, 4) AS "sampleEmptyShare"
FROM flags f JOIN (
  SELECT f.pos, CASE WHEN n = 0 THEN 'any' WHEN zero THEN 'string' WHEN whole THEN 'integer' WHEN dot OR comma THEN 'number' WHEN dmy THEN 'date' WHEN iso THEN 'datetime' WHEN pair THEN 'boolean' ELSE 'string' END AS type FROM flags f LEFT JOIN times USING (pos)) t USING (pos)""")
def infer_types(spark, sf):
    return C.infer_types(_sample(spark, sf), ["pos"]).withColumns({"trueValues": joined("trueValues"), "falseValues": joined("falseValues")})


@query("""SELECT event_type AS resource_id, pos, name, type FROM (SELECT event_type, bool_and(regexp_matches(props, '^[+-]?(0|[1-9][0-9]*)$')) AS whole FROM events GROUP BY event_type),
  LATERAL (VALUES (0, event_type || ' id', 'integer'), (1, '_column_2', CASE WHEN whole THEN 'integer' ELSE 'string' END), (2, 'rate', 'number'), (3, '_column_4', 'any')) t(pos, name, type)""")
def observed_header(spark, sf):
    e = table(spark, sf, "events").withColumn("row_no", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("bigint"))
    header = F.array(F.concat("event_type", F.lit("\n\tid ")), F.lit(" \t"), F.lit("rate"), F.lit(""))
    rows = e.select(F.col("event_type").alias("resource_id"), "row_no", header.alias("header"), F.array(F.col("event_id").cast("string"), "props", F.concat((F.col("event_id") % 9).cast("string"), F.lit(".5")), F.lit("")).alias("cells"))
    return C.observed_schema(rows).select("resource_id", "pos", "name", "type")


#: Declared types with parts of the table in them, and the type, format and decimal mark that each should give.
_WRITTEN = [
    ("concat('NUMBER(', c_custkey % 38 + 1, ')')", "integer", None, None), ("concat('number(', c_custkey % 38 + 1, ',2)')", "number", None, None), ("'NÚMERO DECIMAL SEPARADOR PONTO'", "number", None, "."), ("concat('Valor separador vírgula ', c_custkey)", "number", None, ","),
    ("'DATA (DD/MM/AA)'", "date", "%d/%m/%y", None), ("concat('Data e hora (DD-MM-AAAA HH:MM) ', c_custkey)", "datetime", "%d-%m-%Y %H:%M", None), ("'DATE (AAAA/MM/DD HH:MM:SS)'", "datetime", "%Y/%m/%d %H:%M:%S", None), ("'multipolygon'", "any", None, None),
    ("concat('Cadeia de ', c_custkey, ' caracteres')", "string", None, None), ("'S/N'", "boolean", None, None), ("concat('VARCHAR2(', c_custkey, ')')", "string", None, None), ("'hora'", "time", None, None), ("'JSON'", "object", None, None), ("c_name", "any", None, None), ("''", "any", None, None),
]
_lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_DECLARED = "CASE c_custkey % " + str(len(_WRITTEN)) + "".join(f" WHEN {i} THEN {w[0]}" for i, w in enumerate(_WRITTEN)) + " END"
_CASE = lambda k: "CASE c_custkey % " + str(len(_WRITTEN)) + "".join(f" WHEN {i} THEN {_lit(w[k])}" for i, w in enumerate(_WRITTEN)) + " END"


@query(f"""SELECT c_custkey, {_CASE(1)} AS type, {_CASE(2)} AS format, {_CASE(3)} AS "decimalChar" FROM customer""")
def type_mapping(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", Y.map_type(F.expr(_DECLARED)).alias("m")).select("c_custkey", "m.type", "m.format", "m.decimalChar")


_T = r"""CASE WHEN t = '' THEN 'any' WHEN regexp_matches(t, '\b(MULTI)?(POLYGON|POINT|LINESTRING|GEOMETRY|GEOMETRIA|SHAPE|GEOJSON)\b') THEN 'any' WHEN regexp_matches(t, 'DATETIME|DATATIME|TIMESTAMP|\bDATA ?(E|/)? ?HORA\b|\bDT ?HR\b') THEN 'datetime' WHEN regexp_matches(t, '\bDATE\b|\bDATA\b|\bDT\b') THEN 'date'
  WHEN regexp_matches(t, '\bTIME\b|\bHORA\b') THEN 'time' WHEN regexp_matches(t, '\bBOOL(EAN)?\b|\bLOGICO\b|\bS ?/ ?N\b') THEN 'boolean' WHEN regexp_matches(t, '\b(BIG|SMALL|TINY)?INT(EGER|EIRO)?\b|\bNUMBER ?\( ?[0-9]+ ?\)') THEN 'integer'
  WHEN regexp_matches(t, '\bDECIMAL\b|\bFLOAT\b|\bDOUBLE\b|\bREAL\b|\bNUM(ERIC|ERICO|ERO|BER)?\b|\bMONETARIO\b|\bMOEDA\b|\bVALOR\b') THEN 'number' WHEN regexp_matches(t, '\bJSON\b') THEN 'object'
  WHEN regexp_matches(t, '\bSTRING\b|\bTEXT(O)?\b|\b(VAR)?CHAR(2|ACTER)?\b|\bCADEIA\b|\bCARACTER(ES)?\b|\bALFANUMERICO\b|\bCLOB\b|\bENUM\b') THEN 'string' END"""


@query(f"""WITH f AS (SELECT 'part ' || p_brand AS dictionary, p_type AS declared FROM part UNION ALL SELECT 'document ' || doc_id, text FROM documents UNION ALL SELECT 'customer ' || c_nationkey, {_DECLARED} FROM customer),
m AS (SELECT dictionary, trim(coalesce(declared, '')) AS declared, {sql_normalise('declared')} AS t FROM f),
k AS (SELECT *, {_T} AS type, regexp_matches(t, '(DD|AAAA|YYYY)[/.-]MM[/.-](AAAA|YYYY|AA|YY|DD)') AS has_format FROM m)
SELECT dictionary, count(DISTINCT declared) AS spellings, count(*) FILTER (declared = '') AS fields_untyped, count(DISTINCT declared) FILTER (declared = '' OR type IS NULL) AS unmapped, count(*) FILTER (type IN ('date', 'datetime')) AS date_fields, count(*) FILTER (type IN ('date', 'datetime') AND has_format) AS date_fields_with_format FROM k GROUP BY dictionary""")
def type_findings(spark, sf):
    """Whole values: parts by brand, each document as a dictionary of its own, and declared types by nation."""
    named = lambda kind, c: F.concat(F.lit(kind + " "), F.col(c).cast("string")).alias("dictionary")
    parts = table(spark, sf, "part").select(named("part", "p_brand"), F.col("p_type").alias("type"))
    texts = table(spark, sf, "documents").select(named("document", "doc_id"), F.col("text").alias("type"))
    customers = table(spark, sf, "customer").select(named("customer", "c_nationkey"), F.expr(_DECLARED).alias("type"))
    found = D.type_findings(parts.union(texts).union(customers), "dictionary")
    return found.select("dictionary", F.size("type_spellings").cast("bigint").alias("spellings"), "fields_untyped", F.size("unmapped_types").cast("bigint").alias("unmapped"), "date_fields", "date_fields_with_format")


@query(_SAMPLE + r"""
SELECT pos, count(*) FILTER (regexp_matches(value, '^[+-]?([0-9]{1,3}(\.[0-9]{3})+|[0-9]*),[0-9]+$')) > count(*) FILTER (regexp_matches(value, '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]*)\.[0-9]+$')) AS comma, CASE WHEN comma AND bool_or(regexp_matches(value, '^[+-]?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$')) THEN '.' END AS "groupChar"
FROM filled WHERE pos IN (6, 7, 9) GROUP BY pos""")
def completed_number_formats(spark, sf):
    c = V.as_contract(spark.createDataFrame([("events", p, f"c{p}", "number") for p in (6, 7, 9)], V.CONTRACT))
    done = C.complete_formats(c, _sample(spark, sf))
    return done.select("pos", (F.coalesce(F.col("decimalChar"), F.lit("")) == ",").alias("comma"), "groupChar")


@query("SELECT doc_id, length(text) > 1000 AS too_long FROM documents")
def max_length_errors(spark, sf):
    f = F.struct(F.lit("string").alias("type"), *[F.lit(1000 if c == "maxLength" else None).cast(k).alias(c) for c, k in V.NARROWING.items()])
    return table(spark, sf, "documents").select("doc_id", F.array_contains(V.failures(F.col("text"), f), "maxLength").alias("too_long"))


@query("SELECT count(*) AS rows, count(*) FILTER (len(string_split(text, ' ')) <> 50) AS ragged_rows FROM documents")
def ragged_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.lit("r").alias("resource_id"), F.lit("").alias("member"), F.col("doc_id").alias("row_no"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("header"), F.split("text", " ").alias("cells"))
    return V.check(rows, V.as_contract(spark.createDataFrame([], V.CONTRACT))).totals.select("rows", "ragged_rows")


@query("SELECT fmt, count(*) AS files, sum(n) AS rows, max(bad) AS decode_errors, count(DISTINCT header) AS distinct_headers FROM (SELECT source AS fmt, lang AS header, n_chars AS n, doc_id % 7 AS bad FROM documents) GROUP BY fmt")
def member_summary(spark, sf):
    t = table(spark, sf, "documents").select(F.col("source").alias("resource_id"), F.lit("").alias("member"), F.col("n_chars").alias("rows"), F.lit(0).alias("ragged_rows"), (F.col("doc_id") % 7).alias("decode_errors"), F.array("lang").alias("header"), F.lit("utf-8").alias("encoding"), F.lit(",").alias("delimiter"), F.lit("csv").alias("fmt"))
    return V.summarise_members(t).select(F.col("resource_id").alias("fmt"), F.col("tables").alias("files"), "rows", "decode_errors", "distinct_headers")


@query(f"SELECT p_partkey, {sql_norm('p_name')} AS norm FROM part")
def norm_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.norm(F.col("p_name")).alias("norm"))


@query(f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def norm_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm(F.col("text")).alias("norm"))


_STOPS = "string_split('metadados metadado dicionario dicionarios de da do das dos dados e data dictionary csv json xml pdf xlsx xls variaveis variavel tabela tabelas campos arquivo the of schema esquema layout zip download', ' ')"
_TOKENS = lambda x: f"list_distinct(list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '' AND NOT list_contains({_STOPS}, w) AND NOT regexp_matches(w, '^[0-9]+$')))"


@query(f"SELECT doc_id, array_to_string(list_sort({_TOKENS('text')}), ',') AS tokens FROM documents")
def name_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(F.array_sort(X.tokens(F.col("text")))).alias("tokens"))


@query(f"""WITH t AS (SELECT n_nationkey, r_regionkey, {_TOKENS("n_name || ' ' || r_name")} AS a, {_TOKENS('r_name')} AS b FROM nation, region)
SELECT n_nationkey, r_regionkey, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END::DOUBLE AS jaccard, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END::DOUBLE AS name_score FROM t""")
def jaccard_pairs(spark, sf):
    pairs = table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "region")))  # two tables of fixed size
    both = F.concat_ws(" ", "n_name", "r_name")
    return pairs.select("n_nationkey", "r_regionkey", X.jaccard(both, F.col("r_name")).alias("jaccard"), X.name_score(F.col("r_name"), both).alias("name_score"))


@query(f"SELECT a.p_brand AS a, b.p_brand AS b, 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n), 1)::DOUBLE AS similarity FROM (SELECT DISTINCT p_brand, {sql_norm('p_brand')} AS n FROM part) a JOIN (SELECT DISTINCT p_brand, {sql_norm('p_brand')} AS n FROM part) b ON left(a.n, 7) = left(b.n, 7)")
def levenshtein_similarity(spark, sf):
    """Brands with one beginning: pairs come from a join on it."""
    brands = table(spark, sf, "part").select("p_brand", X.norm(F.col("p_brand")).alias("n")).distinct().withColumn("begin", F.left("n", F.lit(7)))
    other = brands.select(F.col("p_brand").alias("b"), F.col("n").alias("m"), "begin")
    return brands.withColumnRenamed("p_brand", "a").join(other, "begin").select("a", "b", X.similarity(F.col("n"), F.col("m")).alias("similarity"))


@query("""WITH n AS (SELECT *, n_nationkey % 4 AS k FROM nation)
SELECT n_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (k = 0), '') AS exact, coalesce(string_agg(lower(n_name) || ' =' || n_name, ',' ORDER BY n_nationkey) FILTER (k = 1), '') AS spelled, coalesce(string_agg(n_name || ' gone', ',' ORDER BY n_nationkey) FILTER (k = 2), '') AS missing,
  coalesce(string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (k >= 2), '') AS undeclared FROM n GROUP BY n_regionkey""")
def field_matching(spark, sf):
    """Declared names of which some are exact, some only spelled otherwise and some absent, against a header of the nations of a region."""
    k = F.col("n_nationkey") % 4
    declared = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lower("n_name"), F.lit(" "))).when(k == 2, F.concat("n_name", F.lit(" gone")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n_nationkey", c.alias("x"))))), lambda r: r["x"])
    lists = table(spark, sf, "nation").groupBy("n_regionkey").agg(in_order(declared).alias("names"), in_order(F.col("n_name")).alias("header"))
    m = lists.select("n_regionkey", V.match_fields(F.col("names"), F.col("header")).alias("m"))
    spelled = F.array_join(F.transform("m.spelling", lambda p: F.concat(p["declared"], F.lit("="), p["column"])), ",")
    return m.select("n_regionkey", joined("m.exact").alias("exact"), spelled.alias("spelled"), joined("m.missing").alias("missing"), joined("m.undeclared").alias("undeclared"))


@query()
def similar_names(spark, sf):
    """Greedy and in order: no SQL."""
    words = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set(F.concat("p_type", F.lit("s")))).alias("altered"))
    return words.select("p_brand", F.to_json(M.similar_names("types", F.col("altered"))).alias("pairs"))


@query()
def pair_spelling(spark, sf):
    """Greedy and in order: no SQL."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("Codigo da "), "n_name"))).alias("missing"), F.array_sort(F.collect_list(F.concat(F.lit("cod"), F.initcap("n_name")))).alias("extra"))
    return n.select("n_regionkey", F.to_json(M.pair_spelling(F.col("missing"), F.col("extra"))).alias("paired"))


@query("SELECT n_regionkey, len(a) AS header_columns, len(b) AS extracted, least(round(len(list_intersect(a, b)) / len(a)::DOUBLE, 4), round(len(list_intersect(a, b)) / len(b)::DOUBLE, 4)) AS agreement, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 4) AS recall, round(len(list_intersect(a, b)) / len(b)::DOUBLE, 4) AS precision FROM (SELECT n_regionkey, list(n_name) AS a, list(n_name) FILTER (n_nationkey % 3 <> 0) || ['UTOPIA'] AS b FROM nation GROUP BY n_regionkey)")
def oracle_metrics(spark, sf):
    lists = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("a"), F.concat(F.collect_list(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))), F.array(F.lit("UTOPIA"))).alias("b"))
    return lists.select("n_regionkey", M.oracle(F.col("b"), F.col("a")).alias("o")).select("n_regionkey", "o.header_columns", "o.extracted", M.agreement(F.col("o")).alias("agreement"), "o.recall", "o.precision")


@query()
def by_position(spark, sf):
    """An alignment: no SQL."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("h"))
    n = n.withColumn("p", F.transform("h", lambda x, i: F.when(i == 1, F.lit("renamed")).otherwise(x)))
    key = lambda c: F.transform(c, X.norm)
    return n.select("n_regionkey", F.to_json(M.by_position("p", key("p"), "h", key("h"))).alias("pairs"))
