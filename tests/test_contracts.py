"""Types, inference, conformance and names: golden cases on small tables."""

import unicodedata

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden.functions import text as X
from rowwarden.functions import types as Y
from rowwarden.operators import cells as C
from rowwarden.operators import conformance as V
from rowwarden.operators import matching as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("declared", "kind", "fmt", "decimal"),
    [
        ("NUMBER(10)", "integer", None, None), ("NUMBER(10,2)", "number", None, None), ("NÚMERO DECIMAL SEPARADOR PONTO", "number", None, "."), ("NUMERO SEPARADOR VIRGULA", "number", None, ","), ("DATA (DD/MM/AA)", "date", "%d/%m/%y", None),
        ("DATA E HORA (DD/MM/AA HH:MM)", "datetime", "%d/%m/%y %H:%M", None), ("Data (AAAA-MM-DD HH:MM:SS)", "datetime", "%Y-%m-%d %H:%M:%S", None), ("multipolygon", "any", None, None), ("TEXTO (STRING)", "string", None, None), ("VARCHAR", "string", None, None),
        ("Cadeia de caracteres", "string", None, None), ("Booleano", "any", None, None), ("S/N", "boolean", None, None), ("hora", "time", None, None), ("json", "object", None, None), ("timestamp", "datetime", None, None), ("bigint", "integer", None, None),
    ],
)
def test_declared_types(spark, declared, kind, fmt, decimal):
    m = one(spark, Y.map_type(F.lit(declared)))
    assert (m.type, m.format, m.decimalChar) == (kind, fmt, decimal)


def test_descriptor_keeps_what_was_written(spark):
    d = one(spark, Y.descriptor(F.lit("UF"), F.lit("VARCHAR"), F.lit(" 2 "), F.lit("state \n code"), F.lit("PE, SP")))
    assert (d.type, d.maxLength, d.declaredSize, d.declaredType) == ("string", 2, 2, "VARCHAR")
    assert d.description == "state code [Allowed values, as declared: PE, SP]"
    assert one(spark, Y.map_type(F.lit("")))["note"] == "type not declared"
    assert one(spark, Y.declared_size(F.lit("0"))) is None and one(spark, Y.declared_size(F.lit("10,2"))) is None


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["1", "2", ""], {"type": "integer"}), (["01", "2"], {"type": "string"}), (["1,5", ",99"], {"type": "number", "decimalChar": ","}), (["1.234,50", "2,0"], {"type": "number", "decimalChar": ",", "groupChar": "."}), (["1.5", ".5", "2"], {"type": "number"}),
        (["2022-01-03"], {"type": "date", "format": "%Y-%m-%d"}), (["3/5/2022", "31/12/2021"], {"type": "date", "format": "%d/%m/%Y"}), (["31/02/2022"], {"type": "string"}), (["2022-01-03T10:00:00Z"], {"type": "datetime", "format": "%Y-%m-%dT%H:%M:%SZ"}),
        (["2022-01-03 10:00:00.123"], {"type": "datetime", "format": "%Y-%m-%d %H:%M:%S.%f"}), (["S", "N"], {"type": "boolean", "trueValues": ["S"], "falseValues": ["N"]}), (["S", "S"], {"type": "string"}), (["1", "0"], {"type": "integer"}), (["", ""], {"type": "any"}), (["x", "1"], {"type": "string"}),
    ],
)
def test_observed_types(spark, values, want):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "k string, row_no long, value string")
    got = C.infer_types(df, ["k"]).first().asDict()
    assert {k: got[k] for k in ("type", "format", "decimalChar", "groupChar", "trueValues", "falseValues") if got[k] is not None} == want


def rows(spark, header, data, resource="r"):
    return spark.createDataFrame([(resource, "", i, header, x) for i, x in enumerate(data, 1)], "resource_id string, member string, row_no long, header array<string>, cells array<string>")


def contract(spark, fields, resource="r"):
    made = [Row(resource_id=resource, pos=i, name=n, type=t, **{c: x.get(c) for c in V.NARROWING}) for i, (n, t, x) in enumerate(fields)]
    return spark.createDataFrame(made, T.StructType(V.CONTRACT.fields + [T.StructField(c, T._parse_datatype_string(k)) for c, k in V.NARROWING.items()]))


HEADER = ["ID", "DATA", "VALOR", "UF", "DESCRICAO", "EXTRA"]
DATA = [["1", "03/05/2022", "1.234,50", "PE", "Maria da Silva", "x"], ["2", "04/05/2022", ",99", "PE", "João", "x"], ["3", "31/02/2022", "10,00", "PER", "José", "x"], ["abc", "05/05/2022", "7,5", "SP", "", "x"]]
FIELDS = [("ID", "integer", {}), ("DATA", "date", {}), ("VALOR", "number", {}), ("UF", "string", {"maxLength": 2}), ("Descrição", "string", {}), ("SUMIU", "string", {})]


def test_conformance_counts_errors_and_completes_formats(spark):
    cells = rows(spark, HEADER, DATA)
    values = C.columns(cells).select("resource_id", "pos", "row_no", "value").where("pos < 4")
    done = C.complete_formats(contract(spark, FIELDS), values)
    got = {r.name: r for r in done.collect()}
    assert got["DATA"].format == "%d/%m/%Y" and (got["VALOR"].decimalChar, got["VALOR"].groupChar) == (",", ".") and got["DATA"].inferred.format == "%d/%m/%Y"
    checked = V.check(cells, done.drop("inferred"))
    errors = {(r.field, r.kind): (r.errors, r.first_rows) for r in checked.errors.collect()}
    assert errors == {("ID", "type"): (1, [4]), ("DATA", "type"): (1, [3]), ("UF", "maxLength"): (1, [3])}
    m = checked.matches.first()
    assert (m.missing, m.undeclared, [tuple(p) for p in m.spelling]) == (["SUMIU"], ["EXTRA"], [("Descrição", "DESCRICAO")])
    v = V.verdicts(checked).first()
    assert (v.cells_with_errors, v["pass"], v.rows, v.cells_checked) == (3, False, 4, 20)
    kept = str(checked.errors.collect() + checked.totals.collect() + V.verdicts(checked).collect())
    assert not any(x in kept for x in ("Maria", "João", "1.234", "PER", "abc"))


def test_clean_file_passes(spark):
    data = [["1", "2022-05-03", "1234.50", "PE", "a", "b"], ["2", "2022-05-04", "0.99", "PE", "", "b"]]
    fields = [("ID", "integer", {}), ("DATA", "date", {}), ("VALOR", "number", {}), ("UF", "string", {"maxLength": 2}), ("DESCRICAO", "string", {}), ("EXTRA", "any", {})]
    v = V.verdicts(V.check(rows(spark, HEADER, data), contract(spark, fields))).first()
    assert v["pass"] and v.error_rate == 0.0


def test_short_rows_and_constraints(spark):
    fields = [("a", "integer", {"minimum": "2", "maximum": "5"}), ("b", "string", {"pattern": "x[0-9]", "enum": ["x1", "x2"]}), ("c", "boolean", {"trueValues": ["S"], "falseValues": ["N"]}), ("d", "object", {}), ("e", "time", {})]
    data = [["1", "x1", "S", '{"k": 1}', "10:00:00"], ["6", "y", "Y", "{", "25:00:00"], ["3"]]
    checked = V.check(rows(spark, ["a", "b", "c", "d", "e"], data), contract(spark, fields))
    errors = {(r.field, r.kind): r.errors for r in checked.errors.collect()}
    assert errors == {("a", "minimum"): 1, ("a", "maximum"): 1, ("b", "pattern"): 1, ("b", "enum"): 1, ("c", "type"): 1, ("d", "type"): 1, ("e", "type"): 1}
    t = checked.totals.first()
    assert (t.rows, t.ragged_rows, t.cells_checked) == (3, 1, 15)


def test_many_failures_keep_five_rows(spark):
    checked = V.check(rows(spark, ["a"], [["x"]] * 300).repartition(4), contract(spark, [("a", "integer", {})]))
    e = checked.errors.first()
    assert (e.errors, e.first_rows) == (300, [1, 2, 3, 4, 5])


def test_observed_header(spark):
    got = C.observed_schema(rows(spark, ["Origem\nDestino", "ok", "\t", "n" * 600], [["a", "1", "", "x"], ["b", "2", "", "y"]])).orderBy("pos").collect()
    assert [r.name for r in got] == ["Origem Destino", "ok", "_column_3", "n" * 512]
    assert got[0].headerNameCleaned and got[2].headerWithoutName and got[3].headerNameCut == 600
    assert got[2].type == "any" and got[2].sampleEmptyShare == 1.0 and got[1].type == "integer"


def test_cells_and_records(spark):
    df = spark.createDataFrame([(1, 2.0, 2.5, True, None, [1, 2])], "a int, b double, c double, d boolean, e string, f array<int>")
    assert C.as_cells(df, "r", F.lit(1)).first().cells == ["1", "2", "2.5", "true", "", "[1,2]"]
    recs = spark.createDataFrame([("r", 0, {"A": "1", "B": "x"}), ("r", 1, {"A": "2"}), ("r", 5, {"A": "3", "Z": "late"})], "resource_id string, n int, record map<string,string>")
    got = {r.n: (r.header, r.cells) for r in C.records_as_rows(recs, "n", first=2).collect()}
    assert got == {0: (["A", "B"], ["1", "x"]), 1: (["A", "B"], ["2", ""]), 5: (["A", "B"], ["3", "", ""])}
    late = spark.createDataFrame([("q", 1500, {"K": "1"}), ("q", 1501, {"K": "2"}), ("e", 1, {})], recs.schema)
    assert {(r.resource_id, r.n): (r.header, r.cells) for r in C.records_as_rows(late, "n").collect()} == {("q", 1500): (["K"], ["1"]), ("q", 1501): (["K"], ["2"]), ("e", 1): ([], [])}


def test_ordinals_follow_the_keys(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(6)
    assert C.with_ordinals(df, "k").where("row_no <> k + 1").count() == 0


def test_alike_names(spark):
    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    got = one(spark, M.similar_names(names("IdeNuceloCEG", "nada"), names("IdeNucleoCEG", "outra")))
    assert [tuple(p) for p in got] == [("IdeNuceloCEG", "IdeNucleoCEG")]
    s = one(spark, M.pair_spelling(names("Ano Debito", "Numero de GRU", "Valor Pago (R$)", "Codigo da Categoria", "x"), names("anoDebito", "numeroGRU", "valorPago", "codCategoria", "yy")))
    assert dict(map(tuple, s.pairs)) == {"Ano Debito": "anoDebito", "Numero de GRU": "numeroGRU", "Valor Pago (R$)": "valorPago"} | ({"Codigo da Categoria": "codCategoria"} if len(s.pairs) == 4 else {})
    assert "x" in s.missing and "yy" in s.extra
    c = one(spark, M.same_columns(names("Ano", "Mês", ""), names("ano", "DIA")))
    assert (c.missing, c.extra, c.same_columns) == (["mes"], ["dia"], False)


def test_oracle_and_position(spark):
    names = lambda x: F.array(*map(F.lit, x))
    o = one(spark, M.oracle(names(["a", "b", "c", "d", "X"]), names(["a", "b", "c", "d", "y"])))
    assert (o.recall, o.precision, o.exact_match) == (0.8, 0.8, 0.8)
    assert one(spark, M.oracle(names(["a"]), F.array().cast("array<string>"))) is None
    df = spark.createDataFrame([(["a", "old", "c"], ["a", "new", "c"]), (["a", "b"], ["b", "a"]), (["a", "x", "y", "c"], ["a", "z", "c"])], "n array<string>, h array<string>")
    assert [r.p for r in df.select(M.by_position("n", "n", "h", "h").alias("p")).collect()] == [{"old": "new"}, {}, {}]


def test_text_functions(spark):
    assert one(spark, X.norm(F.lit("Não_é  fácil, ß!"))) == "nao e facil"
    words = ["ﬁnalidade", "codiﬁcação", "№ 3", "½ ano", "ªº", "𝐀𝟏", "㎏ ５", "⑴ Straße", "日本", None, "ÇÃÉ ñ", "a\u0301"]
    want = [unicodedata.normalize("NFKD", w or "").encode("ascii", "ignore").decode() for w in words]
    got = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", X.ascii_fold(F.col("w")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want and one(spark, X.norm(F.lit("ﬁnalidade № 3"))) == "finalidade no 3"
    assert one(spark, X.tokens(F.lit("Metadados - Termo de doação 2020 (CSV)"))) == ["termo", "doacao"]
    assert one(spark, X.clean_text(F.lit("a\x00b‮c" + "d" * 9), 5)) == "abcdd […]"
    assert one(spark, X.error_text(F.lit("ValueError"), F.lit("bad 'secret' here\nsecond"), F.lit(False))) == "ValueError: bad … here"
    assert one(spark, X.safe_markdown(F.lit("<b> [x](http://e.org) @me #12 a|b `c`"))) == "&lt;b&gt; x (http:​//e.org) @​me #​12 a/b 'c'"
    assert one(spark, X.chunks(F.lit("aa\nbb\ncccccc"), 5)) == ["aa\nbb", "ccccc", "c"]
    assert one(spark, X.host(F.lit("https://u@Ex.org:80/a?b"))) == "ex.org" and one(spark, X.basename(F.lit("http://x/a/b.csv?y=/z"))) == "b.csv"
    got = spark.createDataFrame([(bytearray("ação".encode("cp1252")),), (bytearray("﻿é".encode()),)], "b binary").select(X.decoded("b").alias("t")).collect()
    assert [r.t for r in got] == ["ação", "é"]
    assert one(spark, X.share(F.lit(1), F.lit(0))) is None


def test_formats(spark):
    ok = lambda v, f: one(spark, Y.fits_format(F.lit(v), f))
    assert ok("3/5/2022", "%d/%m/%Y") and not ok("31/02/2022", "%d/%m/%Y") and ok("01/01/70", "%d/%m/%y") and not ok("202231", "%Y%m%d") and ok("20220301", "%Y%m%d")
    assert ok("2022-01-01T10:00:00+0300", "%Y-%m-%dT%H:%M:%S%z") and not ok("2022-01-01", "%Y-%m-%d %H:%M") and not ok("", "%Y-%m-%d")
