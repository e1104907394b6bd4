"""Documents, linking, drift, planning, reports, readers, the portal and whole runs, on small inputs."""

import codecs
import datetime as dt
import io
import json
import random
import struct
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from rowwarden.operators import documents as D
from rowwarden.operators import drift, extraction, linking, planning, reporting
from rowwarden.plans import lifecycle
from rowwarden.sources import files as S
from rowwarden.sources import portal, sinks, xls
from rowwarden.streaming import incremental


def test_tabular_dictionary(spark):
    rows = [("d", 0, ["Dicionário", "", ""]), ("d", 1, ["nome_atributo", "datatype", "descricao"]), ("d", 2, ["SEQ_TAD", "NUMBER(10)", "key"]), ("d", 3, ["", "x", "y"]), ("d", 4, ["DAT_TAD", "DATE", "day"]), ("d", 5, ["SEQ_TAD", "again", ""]), ("d", 6, ["nome atributo", "", ""]), ("e", 0, ["a", "b"])]
    got = D.fields_of_rows(spark.createDataFrame(rows, "k string, row_no long, cells array<string>"), ["k"]).orderBy("row_no").collect()
    assert [(r.k, r.name, r.type, r.description) for r in got] == [("d", "SEQ_TAD", "NUMBER(10)", "key"), ("d", "DAT_TAD", "DATE", "day")]


def test_dictionaries_of_every_kind(spark):
    nested = {"metadados": {"cabecalho": {"titulo": "t"}, "recursos": [{"identificador": "r", "titulo": "x", "formato": "csv"}], "campos": [{"codigo": "cnpj", "descricao": "id", "tipo": "texto", "tamanho": 14}, {"codigo": "valor", "descricao": "v", "tipo": "number"}]}}
    book = XLSX | {"xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="inlineStr"><is><t>Title</t></is></c></row><row>' + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in ("Nome da variável", "Descrição", "Tipo")) + "</row><row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in ("CO_ESCOLA", "code", "num")) + "</row></sheetData></worksheet>"}
    data = {
        "json": json.dumps(nested).encode(), "wide": json.dumps(nested).encode("utf-16"), "xml": b"<d><x><campo><nome_atributo>A</nome_atributo><datatype>int</datatype></campo><campo><nome_atributo>B</nome_atributo><datatype>text</datatype></campo></x></d>", "xlsx": archive(book),
        "csv": "nome_entidade;nome_atributo;tipificacao;datatype;descricao\ne;SEQ_TAD;x;NUMBER;é\ne;UF;x;VARCHAR;f\n".encode("cp1252"), "page": b"<!DOCTYPE html><html>", "cut": b'{"a": [', "none": b"a,b\n1,2\n", "list": b'{"a": [{"x": 1}]}', "ods": archive(ODS), "gone": None,
    }
    files = spark.createDataFrame([(k, {"ods": "ODS"}.get(k, "CSV"), None if v is None else bytearray(v)) for k, v in data.items()], "path string, format string, content binary")
    fields, outcomes = D.read_dictionaries(files)
    got = {}
    for r in fields.orderBy("path", "row_no").collect():
        got.setdefault((r.path, r.part), []).append((r.name, r.type))
    assert got == {("json", "metadados.campos"): [("cnpj", "texto"), ("valor", "number")], ("wide", "metadados.campos"): [("cnpj", "texto"), ("valor", "number")], ("xml", "x.campo"): [("A", "int"), ("B", "text")], ("xlsx", "S1"): [("CO_ESCOLA", "num")], ("csv", ""): [("SEQ_TAD", "NUMBER"), ("UF", "VARCHAR")]}
    kinds = {r.path: r.error_kind for r in outcomes.collect()}
    assert kinds == {"json": None, "wide": None, "xml": None, "xlsx": None, "csv": None, "page": "html-page", "cut": "malformed", "none": "no-field-table", "list": "no-field-table", "ods": "format-not-read", "gone": "download-failed"}


def test_descriptions(spark):
    text = "About.\nDicionário de dados:\n* **UF**: Sigla. Formato: texto;\n* SEQ_TAD – Chave\n- `x`: third\n* **UF**: again\nno item"
    got = spark.range(1).select(D.fields_of_description(F.lit(text)).alias("f"), D.fields_of_description(F.lit("Dicionário de dados:\n* a: one")).alias("g"), D.fields_of_description(F.lit("* a: 1\n* b: 2")).alias("h")).first()
    assert [(f.name, f.type) for f in got.f] == [("UF", "texto"), ("SEQ_TAD", ""), ("x", "")] and got.g is None and got.h is None


def test_pdf_rows(spark):
    rows = [["Nome do Campo", "Tipo", "Tamanho"], ["id_pessoa", "Número", "10", "Identificador da pessoa"], [None, "nome", "Cadeia de caracteres", "100", "Nome completo"], ["continua aqui"], ["data_nasc", "Data", "Nascimento"], ["id_pessoa", "Char", "again"], ["42"]]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(rows)], "d string, row_no long, cells array<string>")
    got = D.fields_of_pdf_rows(df, "d").orderBy("row_no").collect()
    assert [(r.name, r.type, r.size) for r in got] == [("id_pessoa", "Número", "10"), ("nome", "Cadeia de caracteres", "100"), ("data_nasc", "Data", "")]
    assert got[1].description == "Nome completo continua aqui"


def test_model_answers(spark):
    good = json.dumps({"fields": [{"name": " a  b ", "type": "t" * 200}, {"name": "a b"}, {"name": ""}, {"x": 1}]})
    got = spark.range(1).select(D.fields_of_model(F.lit(good)).alias("a"), D.fields_of_model(F.lit("not json")).alias("b")).first()
    assert [(f.name, len(f.type)) for f in got.a] == [("a b", 100)] and got.b == []
    pieces = spark.createDataFrame([("d", 0, "x" * 500)], "document_id string, piece int, text string")
    asked = D.ask_model(pieces, lambda t: None if len(t) > 300 else json.dumps({"n": len(t)})).collect()
    assert [json.loads(r.answer)["n"] for r in asked] == [250, 250]


def test_links(spark):
    d = [("s", "d1", 0, "Metadados - Termo de doação", 0, "", [], ["r9"]), ("s", "d2", 1, "Dicionário", 0, "", ["ano", "mes", "valor"], []), ("s", "d3", 2, "x", 0, "Autos", [], ["gone"]), ("t", "d4", 0, "Dicionário de dados", 0, "", [], [])]
    t = [("s", "r1", "Termo de doação", None), ("s", "r2", "Receitas", ["ANO", "Mês", "valor"]), ("s", "r9", "Termo de doação", ["ano", "mes", "valor"]), ("s", "r3", "nothing alike", None), ("t", "q1", "a", None), ("t", "q2", "b", None)]
    dicts = spark.createDataFrame(d, "dataset string, dictionary_id string, dict_pos int, name string, part int, label string, names array<string>, declared_ids array<string>")
    tables = spark.createDataFrame(t, "dataset string, table_id string, name string, header array<string>")
    got = {r.table_id: (r.dictionary_id, r.method) for r in linking.link(dicts, tables).collect()}
    assert got == {"r1": ("d1", "name"), "r2": ("d2", "header"), "r9": ("d1", "declared-id"), "q1": ("d4", "single"), "q2": ("d4", "single")}
    assert [(r.dictionary_id, r.declared_id) for r in linking.broken_ids(dicts, tables).collect()] == [("d3", "gone")]


def test_drift(spark):
    schema = "resource_id string, names array<string>, delimiter string, encoding string, distinct_headers int"
    before = spark.createDataFrame([("a", ["x", "y"], ";", "utf-8", 1), ("b", ["x", "y"], ";", "utf-8", 1), ("c", ["x"], ";", "utf-8", 1)], schema)
    after = spark.createDataFrame([("a", ["x", "z"], ";", "utf-8", 1), ("b", ["y", "x"], ",", "utf-8", 1), ("c", ["x"], ";", "utf-8", 1), ("new", ["q"], ";", "utf-8", 1)], schema)
    got = {r.resource_id: r for r in drift.observed(before, after).collect()}
    assert set(got) == {"a", "b"} and got["a"].columns_added == ["z"] and got["a"].columns_removed == ["y"] and got["b"].columns_reordered and tuple(got["b"].delimiter) == (";", ",")
    again = {r.id for r in drift.observed(before, after).collect()}
    assert again == {r.id for r in got.values()} and len(again) == 2
    f = "resource_id string, kind string, name string, type string"
    b, a = spark.createDataFrame([("a", "declared", "x", "string"), ("a", "declared", "y", "string"), ("g", "declared", "x", "string")], f), spark.createDataFrame([("a", "declared", "x", "integer"), ("a", "declared", "z", "string"), ("n", "declared", "z", "string")], f)
    d = {r.resource_id: r for r in drift.declared(b, a).collect()}
    assert set(d) == {"a", "g"} and d["a"].fields_added == ["z"] and d["a"].fields_removed == ["y"] and [tuple(t) for t in d["a"].types_changed] == [("x", "string", "integer")] and d["g"].schema_removed and not d["a"].schema_removed


def test_reasons_one_a_branch(spark):
    day = datetime(2024, 1, 1)
    now = F.lit("2024-02-15").cast("timestamp")
    tables = spark.createDataFrame([(i, "s", "u", "m", "1", "f", i == "held", n) for n, i in enumerate(["new", "schema", "moved", "error", "reader", "old", "fine", "held"])], "id string, dataset string, url string, last_modified string, size string, fingerprint string, hold boolean, pos int")
    v = [("schema", "u", "m", "1", "g", "ok", None, day), ("moved", "w", "m", "1", "f", "ok", None, day), ("error", "u", "m", "1", "f", "error", None, day), ("reader", "u", "m", "1", "f", "not-tabular", None, day), ("old", "u", "m", "1", "f", "ok", None, day), ("fine", "u", "m", "1", "f", "ok", None, datetime(2024, 2, 10))]
    val = spark.createDataFrame(v, "id string, url string, last_modified string, size string, fingerprint string, status string, not_tabular_kind string, validated_at timestamp").withColumn("checked_at", F.col("validated_at"))
    q = planning.queue(tables, val, now).collect()
    assert [(r.id, r.reason) for r in q] == [("new", "new"), ("schema", "schema"), ("moved", "changed"), ("error", "error"), ("reader", "reader"), ("old", "rotation")]
    assert planning.unfinished(planning.queue(tables, val, now), tables.where("id = 'new'")).count() == 5


def test_copies(spark):
    t = spark.createDataFrame([("a", "s", "n", "http://x/f.csv?1", "10", 0), ("b", "s", "n", "http://y/f.csv", "10", 1), ("c", "s", "n", "http://y/f.csv", "x", 2), ("d", "t", "n", "http://y/f.csv", "10", 3)], "id string, dataset string, name string, url string, size string, pos int")
    c = planning.copies(t)
    assert [tuple(r) for r in c.collect()] == [("b", "a")]
    v = spark.createDataFrame([("a", "ok", "h"), ("b", "error", None)], "id string, status string, sha256 string")
    assert {r.id: (r.status, r.copy_of) for r in planning.copied_results(v, c).collect()} == {"a": ("ok", None), "b": ("ok", "a")}


def test_history_keeps_twelve(spark):
    h = spark.range(1).select(planning.history(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(i.cast("string").alias("day"), F.lit(True).alias("pass"))), F.lit("13"), F.lit(False)).alias("h")).first().h
    assert len(h) == 12 and (h[0].day, h[-1].day, h[-1]["pass"]) == ("2", "13", False)


def test_error_kinds(spark):
    cases = {"HTTPError: 404 Client Error: Not Found": "HTTP 404", "MissingSchema: x": "no URL", "TooManyRedirects": "redirect loop", "did not finish within the batch": "batch time limit", "ReadTimeout": "Timeout", "SSLError: y": "SSLError", "": "other"}
    df = spark.createDataFrame(list(cases.items()), "m string, want string")
    assert df.where(reporting.error_kind(F.col("m")) != F.col("want")).count() == 0


def test_stages_of_extraction(spark):
    o = spark.createDataFrame([("deterministic", True, 1.0, 0.5), ("deterministic", True, 0.5, None), ("deterministic", False, None, None)], "stage string, available boolean, recall double, precision double").withColumns({"exact_match": F.lit(None).cast("double"), "levenshtein": F.lit(None).cast("double")})
    got = {r.metric: (r.n, r.mean, r.median, r.perfect) for r in extraction.stage_stats(o).collect()}
    assert got == {"recall": (2, 0.75, 0.75, 1), "precision": (1, 0.5, 0.5, 0)}
    kinds = [spark.range(1).select(extraction.outcome(F.lit(a), F.lit(n), F.lit(h)).alias("x")).first().x for a, n, h in ((1.0, 3, True), (0.9, 3, True), (0.2, 3, True), (0.0, 3, False), (1.0, 0, True))]
    assert kinds == ["extracted", "suggested", "llm-needed", "suggested", "llm-needed"]


XLSX = {"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>A</t></si><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>C</t></is></c></row><row><c r="A2"><v>1.0</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>'}
ODS = {"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="P"><t:table-row><t:table-cell><x:p>A</x:p></t:table-cell><t:table-cell><x:p>B</x:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="float" o:value="3"/><t:table-cell t:number-columns-repeated="1000"/></t:table-row><t:table-row t:number-rows-repeated="9999"><t:table-cell/></t:table-row></t:table></d>'}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


def test_readers(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    parquet = io.BytesIO()
    pq.write_table(pa.table({"A": [1.0, None], "B": ["x", "y"]}), parquet)
    inner = archive({"z.csv": "A\n9\n"})
    data = {
        "j8": json.dumps([{"A": 1, "B": "x"}, {"A": 2, "B": None, "C": [1, 2]}]).encode(), "j16": json.dumps({"k": 1, "rows": [{"A": 1}]}).encode("utf-16"), "xml": b"<r><i><A>1</A><B>x</B></i><i><A>2</A><B>y</B></i></r>", "xlsx": archive(XLSX), "ods": archive(ODS), "parquet": parquet.getvalue(),
        "cp": "nome;UF\nJoão;PE\n".encode("cp1252"), "zip": archive({"b.csv": "A,B\n1,2\n3\n", "a.csv": "A;B\n5;6\n", "doc.pdf": "%PDF", "in.zip": inner, "__MACOSX/a.csv": "x"}), "html": b"<!DOCTYPE html><html>", "shapes": archive({"m.shp": "x"}), "broken": b'[{"A": ', "bomb": b'<?xml version="1.0"?><!DOCTYPE r [<!ENTITY a "x">]><r><i>&a;</i></r>', "head": b"A,B\n",
    }
    df = S.read_tables(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary").repartition(4))
    got = {}
    for r in df.orderBy("path", "member", "row_no").collect():
        got.setdefault(r.path, []).append((r.member, r.header, r.cells, r.error_kind))
    assert [x[1:3] for x in got["j8"]] == [(["A", "B", "C"], ["1", "x", ""]), (["A", "B", "C"], ["2", "", "[1, 2]"])]
    assert got["j16"][0][1:3] == (["A"], ["1"]) and [x[2] for x in got["xml"]] == [["1", "x"], ["2", "y"]]
    assert got["xlsx"] == [("S1", ["A", "", "C"], ["1", "true", "x"], None)]
    assert got["ods"] == [("P", ["A", "B"], ["3", ""], None)] * 2
    assert [x[2] for x in got["parquet"]] == [["1", "x"], ["", "y"]] and got["cp"][0][1:3] == (["nome", "UF"], ["João", "PE"])
    assert [(x[0], x[2]) for x in got["zip"]] == [("a.csv", ["5", "6"]), ("b.csv", ["1", "2"]), ("b.csv", ["3"]), ("in.zip/z.csv", ["9"])]
    assert [got[k][0][3] for k in ("html", "shapes", "broken", "bomb")] == ["html", "no-tables", "malformed", "malformed"]
    assert got["head"] == [("", ["A", "B"], None, None)]
    assert S.document_sample(archive({f"{i}.pdf": "x" for i in range(60)})) == {"members": 50, "kinds": {"pdf": 50}}
    assert S.read_tables(spark.createDataFrame([("z", bytearray(data["zip"]))], "path string, content binary"), most=1).where("row_no > 1").count() == 0


def test_spreadsheet_dates(spark):
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="[$-416]dd/mm/yy;@"/><numFmt numFmtId="171" formatCode="&quot;day&quot; 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs></styleSheet>'
    sheet = '<worksheet><sheetData><row><c><v>44562</v></c><c s="1"><v>44562</v></c><c s="2"><v>44562.5</v></c><c s="3"><v>44562</v></c><c s="4"><v>0.25</v></c><c s="1"><v>1</v></c></row><row><c s="1"/></row></sheetData></worksheet>'
    data = archive(XLSX | {"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet})
    assert [list(t.rows) for t in S.tables_of(data)] == [[["44562", "2022-01-01T00:00:00", "2022-01-01T12:00:00", "44562", "06:00:00", "1900-01-01T00:00:00"], [""]]]


def test_xml_doctype_and_json_streams(spark):
    tables = lambda data: [(t.format, list(t.rows)) for t in S.tables_of(data)]
    assert tables(b'<?xml version="1.0"?><!DOCTYPE r><r><i><A>1</A></i><i A="2"/></r>') == [("xml", [["A"], ["1"], ["2"]])]
    assert tables(b"<r><i><A>a &lt;!ENTITY b</A></i></r>") == [("xml", [["A"], ["a <!ENTITY b"]])]
    records = [{"n": i, "x": "é" * (i % 50)} for i in range(20_000)]
    late = records + [{"n": 1, "later": 2}]
    for doc in (late, {"a": {"b": [1, 2]}, "n": 12.5, "rows": late, "more": [9]}):
        got = tables(json.dumps(doc, ensure_ascii=False, indent=1).encode())[0][1]
        assert got[0] == ["n", "x"] and got[1:-1] == [[str(r["n"]), r["x"]] for r in records] and got[-1] == ["1", "", ""]
    assert tables(b"[]") == [("json", [[]])] and tables(b'{"a": 1}') == [("json", [[]])] and tables(b"[1, 2.5, null]") == [("json", [["value"], ["1"], ["2.5"], [""]])]
    for bad in (b'[{"A": 1}', b'[{"A": 1} {"A": 2}]', b'{"a" 1}', b'[{"A": tru}]'):
        assert [r[-1] for r in S.rows_of_file("p", bad)] == ["malformed"]


def test_encodings_and_delimiters():
    assert [S.encoding_of(x) for x in (b"abc", "é".encode(), "é".encode() * 40_000 + b"\xc3", "é".encode("cp1252") + b"x", codecs.BOM_UTF8 + b"a", "é".encode("utf-16"))] == ["utf-8", "utf-8", "utf-8", "cp1252", "utf-8-sig", "utf-16"]
    for mark in ";,\t|":
        assert S.delimiter_of("\n".join(mark.join((f"a{i}", "1.5", '"x' + mark + 'y"')) for i in range(9))) == mark
    assert S.delimiter_of("name;value\na, b;1\nc, d, e;2\n") == ";" and S.delimiter_of("only\none\n") == ";" and S.delimiter_of("") == ";"
    assert S.decode_errors("a\x81b".encode("latin-1"), "utf-8") == 1 and S.decode_errors("é�".encode() * 70_000, "utf-8") == 0 and S.decode_errors(b"ok\x81", "cp1252") == 1
    assert [S.cell(v) for v in (None, True, 3, 2.0, 2.5, dt.date(2022, 1, 2), {"a": "é"}, [1], "t")] == ["", "true", "3", "2", "2.5", "2022-01-02", '{"a": "é"}', "[1]", "t"]


def test_members_go_by_level_and_archives_stream():
    files = {"b/x.csv": "A\n1\n", "z.csv": "B;C\n1;2\n", "a/y.csv": "D\n", "a.csv": "E\n5\n", "n.zip": archive({"m.zip": archive({"b.csv": "c\n3\n"})})}
    assert [t.member for t in S.tables_of(archive(files))] == ["a.csv", "n.zip/m.zip/b.csv", "z.csv", "a/y.csv", "b/x.csv"]
    rng = random.Random(1)
    body = "COD;VALOR\n" + "".join(f"{rng.getrandbits(64):x};{rng.getrandbits(64):x}\n" for _ in range(100_000))
    for compression in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", compression) as z:
            z.writestr("readme.pdf", "%PDF" * 50)
            z.writestr("in/data.csv", body)
        data = out.getvalue()
        stream = S.Pieces(data[lo : lo + 10_000] for lo in range(0, len(data), 10_000))
        assert S.first_header(stream) == ("in/data.csv", "csv", ["COD", "VALOR"]) and stream.taken < 300_000 < len(data)
        members = dict((name, b"".join(content)) for name, content in S.streamed_members(S.Pieces([data])))
        assert members == {"readme.pdf": b"%PDF" * 50, "in/data.csv": body.encode()}

    class OneWay(io.RawIOBase):  # what cannot seek is written with sizes after the content
        def __init__(self):
            self.parts = []

        def writable(self):
            return True

        def write(self, b):
            self.parts.append(bytes(b))
            return len(b)

    way = OneWay()
    with zipfile.ZipFile(way, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "X;Y\n1;2\n")
        z.writestr("b.csv", "Z\n")
    assert [(n, b"".join(c)) for n, c in S.streamed_members(S.Pieces(way.parts))] == [("a.csv", b"X;Y\n1;2\n"), ("b.csv", b"Z\n")]
    assert S.first_header([archive(XLSX)]) == ("S1", "xlsx", ["A", "", "C"]) and S.first_header([b'[{"A":1},{"B":2}]']) == ("", "json", ["A", "B"])
    assert S.first_header([archive({"n.zip": archive({"b.csv": "c\n3\n"})})]) == ("n.zip/b.csv", "csv", ["c"])


def old_workbook(sheets):
    """A compound document with a workbook stream, as the published layout has it."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    strings = sorted({v for _, rows in sheets for r in rows for v in r if isinstance(v, str)})
    bodies = []
    for _, rows in sheets:
        out = record(xls.BOF, b"\0" * 16)
        for i, r in enumerate(rows):
            for j, v in enumerate(r):
                at = struct.pack("<HHH", i, j, 0)
                out += record(xls.LABELSST, at + struct.pack("<I", strings.index(v))) if isinstance(v, str) else record(xls.BOOLERR, at + bytes([v, 0])) if isinstance(v, bool) else record(xls.RK, at + struct.pack("<i", v << 2 | 2)) if isinstance(v, int) else record(xls.NUMBER, at + struct.pack("<d", v))
        bodies.append(out + record(xls.EOF, b""))
    whole = b"".join(text(s) for s in strings)
    cut = 8 + len(text(strings[0])) + 3 + 2  # in the second string, between two characters
    shared = struct.pack("<II", len(strings), len(strings)) + whole
    table = record(xls.SST, shared[:cut]) + record(xls.CONTINUE, b"\1" + shared[cut:])
    head = record(xls.BOF, b"\0" * 16)
    names = [name.encode("latin-1") for name, _ in sheets]
    start = len(head) + sum(4 + 8 + len(n) for n in names) + len(table) + 4
    for n, body in zip(names, bodies):
        head += record(xls.BOUNDSHEET, struct.pack("<IBBBB", start, 0, 0, len(n), 0) + n)
        start += len(body)
    stream = (head + table + record(xls.EOF, b"") + b"".join(bodies)).ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    entry = lambda name, kind, at, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", at, size)).ljust(128, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<III", 1, 1, 0) + struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * 432
    return header + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0") + stream.ljust(512 * n, b"\0")


def test_old_spreadsheets():
    data = old_workbook([("S1", [["Código", "valor ção"], [7, 2.5], [-3, "Código"]]), ("S2", [["x"], [True]])])
    got = [(t.member, t.format, list(t.rows)) for t in S.tables_of(data)]
    assert got == [("S1", "xls", [["Código", "valor ção"], ["7", "2.5"], ["-3", "Código"]]), ("S2", "xls", [["x"], ["1"]])]
    assert [r[-1] for r in S.rows_of_file("p", data[:600])] == ["malformed"]
    assert [xls.compressed_number(x) for x in (1 << 2 | 2, (250 << 2 | 3), 0x3FF00000, 0xFFFFFFFE)] == [1.0, 2.5, 1.0, -1.0]


def test_files_over_the_limit_are_listed(spark, tmp_path):
    (tmp_path / "small.csv").write_text("A;B\n1;2\n")
    (tmp_path / "large.csv").write_text("A;B\n" + "1;2\n" * 100)
    got = {r.path.rsplit("/", 1)[-1]: (r.cells, r.error_kind) for r in S.read_tables(S.list_files(spark, str(tmp_path), limit=50)).collect()}
    assert got == {"small.csv": (["1", "2"], None), "large.csv": (None, "too-large")}


def fake_portal(pages):
    def open_(method, url, headers):
        if "package_search" in url:
            rows = int(url.split("rows=")[1].split("&")[0])
            start = int(url.split("start=")[1].split("&")[0]) if "start=" in url else 0
            return 200, {}, json.dumps({"result": {"count": len(pages), "results": pages[start : start + rows]}}).encode()
        if url.endswith("dict.csv"):
            return 200, {}, "nome_atributo;datatype;descricao\nID;NUMBER(10);key\nUF;VARCHAR;state\n".encode()
        if "down" in url:
            raise ConnectionError("no answer")
        return (206 if "Range" in headers else 200), {"ETag": "e", "Content-Length": "7", "Content-Type": "Text/CSV; charset=utf-8"}, b"x"

    return open_


def test_census_of_a_portal(spark):
    pages = [{"name": n, "title": n, "resources": [{"id": f"{n}-1", "name": "Contratos", "format": "CSV", "url": f"http://h/{n}/data.csv", "size": 5}, {"id": f"{n}-d", "name": "Dicionário de dados", "format": "CSV", "url": f"http://h/{n}/dict.csv"}, {"id": f"{n}-m", "name": "Mapa", "format": "SHP", "url": "http://h/m.shp"}]} for n in ("b", "a", "c")]
    packages = portal.catalogue(spark, "http://p", fake_portal(pages), page=2)
    assert [r.name for r in packages.collect()] == ["a", "b", "c"]
    res = portal.resources(packages)
    assert res.count() == 9
    census = lifecycle.census(spark, res, fake_portal(pages))
    assert {(r.id, r.level, r.candidate) for r in census.tables.collect()} == {(f"{n}-1", 2, "csv") for n in "abc"}
    assert {(r.resource_id, r.name, r.type) for r in census.contracts.collect()} == {(f"{n}-1", f, t) for n in "abc" for f, t in (("ID", "integer"), ("UF", "string"))}
    links = spark.createDataFrame([("1", "http://h/a.csv"), ("2", "http://down/b.csv")], "id string, url string")
    got = {r.id: r for r in portal.answers(links, fake_portal(pages), ranged=True).collect()}
    assert (got["1"].status, got["1"].etag, got["1"].content_length, got["1"].content_type) == (206, "e", 7, "text/csv") and got["2"].status is None and "ConnectionError" in got["2"].error
    tries = []

    def flaky(method, url, headers):
        tries.append(url)
        return (503, {}, b"") if len(tries) < 3 else (200, {}, b"ok")

    assert portal.get("u", flaky, backoff=0)[2] == b"ok" and len(tries) == 3


def test_two_runs_in_a_row(spark):
    """Levels 0 to 4, schemas by precedence, events, history, files that are new, fixed, broken and gone."""
    schema = {"fields": [{"name": "A", "type": "integer", "constraints": {"minimum": 1}}, {"name": "B", "type": "string", "constraints": {"maxLength": 3}}]}
    file = lambda i, **x: {"id": i, "name": f"tabela {i}", "format": "CSV", "url": f"http://h/{i}.csv", "size": 5} | x
    book = json.dumps({"meta": {"campos": [{"codigo": "A", "tipo": "inteiro"}, {"codigo": "B", "tipo": "varchar"}]}, "see": "http://p/resource/declared /dataset/other"})
    first = [file("attached", schema=json.dumps(schema)), file("bad", schema='{"fields": []}'), file("listed", description="Dicionário de dados\n* A: tipo: inteiro\n* B: texto"), file("gone"), {"id": "dic", "name": "Dicionário declared", "format": "JSON", "url": "http://h/dic.json"}, file("declared")]
    package = lambda resources: portal.resources(spark.createDataFrame([("ds", json.dumps({"title": "t", "resources": resources}))], "name string, package string"))
    open_ = lambda method, url, headers: (200, {}, book.encode())
    headers = spark.createDataFrame([("declared", ["A", "B"]), ("gone", ["Z"])], "table_id string, header array<string>")
    store = spark.createDataFrame([("gone", 0, "Z", "int4"), ("listed", 0, "A", "text")], "resource_id string, pos int, name string, store_type string")
    survey = lifecycle.census(spark, package(first), open_, headers=headers, store=store)
    assert {r.id: r.level for r in survey.tables.collect()} == {"attached": 3, "bad": 0, "listed": 1, "gone": 3, "declared": 2}
    assert {(r.resource_id, r.kind) for r in survey.schemas.collect()} == {("attached", "attached"), ("listed", "described"), ("gone", "datastore"), ("declared", "declared")}
    assert [(r.table_id, r.dictionary_id, r.method) for r in survey.links.collect()] == [("declared", "dic", "header")]
    assert {(r.resource_id, r.name, r.type, r.maxLength, r.minimum) for r in survey.contracts.where("resource_id = 'attached'").collect()} == {("attached", "A", "integer", None, "1"), ("attached", "B", "string", 3, None)}
    assert [r.names_other_dataset for r in survey.dictionaries.collect()] == [["other"]] and survey.findings.count() == 1 and survey.copies.count() == 0
    content = lambda **x: spark.createDataFrame([(k, bytearray(v.encode())) for k, v in x.items()], "path string, content binary")
    one = lifecycle.run(spark, survey, content(attached="A;B\n0;x\n", declared="A;B\n1;x\n", gone="Z\n1\n", listed="<html>"), datetime(2024, 1, 1, 8))
    state = {r.id: r for r in one.state.collect()}
    assert {k: (r.status, r["pass"]) for k, r in state.items()} == {"attached": ("ok", False), "declared": ("ok", True), "gone": ("ok", True), "listed": ("not-tabular", None)}
    assert one.events.count() == 0 and one.changes.first().asDict() == {"fixed": 0, "broken": 0, "same": 0, "new": 4, "gone": 0}

    second = [x for x in first if x["id"] != "gone"] + [file("late")]
    again = lifecycle.census(spark, package(second), open_, headers=headers.where("table_id <> 'gone'"), store=store.where("resource_id <> 'gone'"))
    two = lifecycle.run(spark, again, content(attached="A;B\n5;x\n", declared="A;B;C\nn;x;1\n", late="Q\n1\n"), datetime(2024, 1, 8, 8), one.state, one.validation.observed, survey.contracts)
    state = {r.id: r for r in two.state.collect()}
    assert [(h.day, h["pass"]) for h in state["attached"].pass_history] == [("2024-01-01", False), ("2024-01-08", True)] and state["attached"].first_seen == datetime(2024, 1, 1, 8) and state["late"].first_seen == datetime(2024, 1, 8, 8)
    events = {(r.resource_id, r.kind, tuple(r.columns_added), tuple(r.columns_removed)) for r in two.events.collect()}
    assert events == {("declared", "observed", ("C",), ()), ("gone", "declared", (), ("Z",))}
    assert two.changes.first().asDict() == {"fixed": 1, "broken": 1, "same": 0, "new": 1, "gone": 1}
    level = again.tables.join(two.state.select("id", "pass"), "id").select("id", reporting.table_level(F.col("level"), F.col("pass")).alias("level"))
    assert {r.id: r.level for r in level.collect()}["attached"] == 4
    third = lifecycle.run(spark, again, content(declared="A;B;C\nn;x;1\n"), datetime(2024, 1, 15, 8), two.state, one.validation.observed, survey.contracts, two.events)
    assert third.events.count() == 0  # what the log holds is not appended again


def test_extraction_of_pdf_dictionaries(spark):
    dictionaries = spark.createDataFrame([("p1", "PDF"), ("p2", "PDF"), ("p3", "PDF"), ("c", "CSV")], "dictionary_id string, format string")
    links = spark.createDataFrame([("p1", "r1", 0), ("p1", "r2", 1), ("p1", "r3", 2), ("p2", "r4", 0)], "dictionary_id string, resource_id string, pos int")
    headers = spark.createDataFrame([("r1", ["A", "B"]), ("r2", ["A"]), ("r3", ["A", "B"])], "resource_id string, header array<string>")
    fields = spark.createDataFrame([("p1", 0, "A"), ("p1", 1, "B"), ("p2", 0, "X")], "dictionary_id string, row_no int, name string")
    got = {r.dictionary_id: (r.n_fields, r.recall, r.precision, r.outcome) for r in lifecycle.extract(dictionaries, links, headers, fields).collect()}
    assert got == {"p1": (2, 1.0, 1.0, "extracted"), "p2": (1, None, None, "suggested"), "p3": (0, None, None, "llm-needed")}


def test_spelled_out_checks_give_what_general_ones_give(spark, monkeypatch):
    from rowwarden.operators import conformance

    header = ["i", "n", "d", "b", "s"]
    rows = spark.createDataFrame([("r", "", k, header, [str(k), f"{k},5", f"0{k % 9 + 1}/01/2024", "S" if k % 2 else "x", "v" * (k % 5)][: 5 - k % 2]) for k in range(1, 40)] + [("q", "m", 1, ["i"], ["zz"])], "resource_id string, member string, row_no long, header array<string>, cells array<string>")
    fields = spark.createDataFrame([("r", 0, "i", "integer", None, None, "20", None, None), ("r", 1, "N", "number", None, ",", None, None, None), ("r", 2, "d", "date", "%d/%m/%Y", None, None, None, None), ("r", 3, "b", "boolean", None, None, None, ["S"], None), ("r", 4, "s", "string", None, None, None, None, 3), ("q", 0, "i", "integer", None, None, None, None, None)], "resource_id string, pos int, name string, type string, format string, decimalChar string, maximum string, trueValues array<string>, maxLength int")
    got = []
    for most in (64, 0):
        monkeypatch.setattr(conformance, "SPELLED_OUT", most)
        c = conformance.check(rows, conformance.as_contract(fields))
        got.append((sorted(map(str, c.totals.collect())), sorted(map(str, c.errors.collect())), sorted(map(str, c.matches.collect()))))
    assert got[0] == got[1] and len(got[0][1]) == 4


def test_validation_of_files(spark):
    files = spark.createDataFrame([("f1", bytearray("ID;DATA;UF\n1;03/05/2022;PE\nx;04/05/2022;PER\n".encode())), ("f2", bytearray(b"<html>"))], "path string, content binary")
    fields = spark.createDataFrame([("f1", 0, "ID", "integer", None), ("f1", 1, "data", "date", None), ("f1", 2, "UF", "string", 2)], "resource_id string, pos int, name string, type string, maxLength int")
    from rowwarden.operators import conformance

    got = lifecycle.validate(files, conformance.as_contract(fields))
    assert {(r.field, r.kind, r.errors) for r in got.errors.collect()} == {("ID", "type", 1), ("UF", "maxLength", 1)}
    assert {(r.resource_id, r["pass"]) for r in got.verdicts.collect()} == {("f1", False)}
    assert [tuple(r) for r in got.unread.collect()] == [("f2", "html")]
    assert {r.name: r.type for r in got.observed.collect()} == {"ID": "string", "DATA": "date", "UF": "string"}
    changed = lifecycle.observed_events(got.observed, got.observed.where("name <> 'UF'"))
    assert changed.first().columns_removed == ["UF"]


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("a", 1), ("b", 2)], "id string, seq int")
    log = str(tmp_path / "log")
    drift.append(events, sinks.load(spark, log, "id string, seq int"), log)
    drift.append(events.union(spark.createDataFrame([("c", 3)], "id string, seq int")), sinks.load(spark, log, "id string, seq int"), log)
    kept = spark.read.parquet(log)
    assert sorted(r.id for r in kept.collect()) == ["a", "b", "c"] and sinks.appended_only(kept, events) and not sinks.appended_only(events, kept)
    fields = spark.createDataFrame([("s", "r", "ok", "x"), ("s", "bad", "a\x00b", "x"), ("s", "empty", "", "x"), ("s", "late", "n", "suggested")], "dataset string, resource_id string, name string, status string")
    faults = sinks.schema_faults(fields, F.col("status"), ["x"])
    assert {r.resource_id: r.fault for r in faults.collect()} == {"bad": "text too long or with control characters", "empty": "bad field name", "late": "status"}
    known = spark.createDataFrame([("s", "r"), ("s", "bad")], "dataset string, resource_id string")
    assert [r.resource_id for r in sinks.accepted(fields, known, faults).collect()] == ["r"]
    made = spark.createDataFrame([("s", "r", "declared", "f1")], "dataset string, resource_id string, kind string, fingerprint string")
    assert sinks.changed_schemas(made, made).count() == 0 and sinks.removed_schemas(made, made.limit(0)).count() == 1
    assert spark.range(1).select(sinks.good_model(F.lit("qwen3:8b")).alias("a"), sinks.good_model(F.lit("x; rm")).alias("b"), sinks.good_digest(F.lit("sha256:" + "a" * 64)).alias("c")).first() == (True, False, True)


def test_stream_gives_what_one_batch_gives(spark, tmp_path):
    from rowwarden.operators import conformance

    schema = "resource_id string, member string, row_no long, header array<string>, cells array<string>"
    rows = spark.createDataFrame([("r", "", i, ["a"], ["x" if i % 3 == 0 else "1"]) for i in range(1, 31)], schema)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    contract = conformance.as_contract(spark.createDataFrame([("r", 0, "a", "integer")], conformance.CONTRACT))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.check_stream(stream, contract, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    total = incremental.totals_so_far(spark.read.parquet(str(tmp_path / "out/totals"))).first()
    error = incremental.errors_so_far(spark.read.parquet(str(tmp_path / "out/errors"))).first()
    whole = conformance.check(rows, contract)
    assert (total["rows"], total.cells_checked) == (30, 30) and (error.errors, error.first_rows) == (10, [3, 6, 9, 12, 15])
    assert whole.errors.first().first_rows == error.first_rows


def test_report_frames(spark):
    from rowwarden.queries.common import facts

    f = facts(spark, "/root/testdata/sf0.001")
    probes = f.limit(5).selectExpr("host", "206 AS status", "etag", "last_modified", "content_length", "content_type", "candidate")
    out = lifecycle.report(f, probes, f.select(F.col("id").alias("resource_id")).limit(3), f.select("id").limit(2))
    assert out["summary"].first().tables <= f.count() and out["coverage"].first().files == out["summary"].first().tables
    assert sum(r.files for r in out["sizes"].collect()) == f.count()


def test_queries_match_their_sql(spark):
    import duckdb

    from rowwarden.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "part", "orders", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert set(ORACLE_SQL) <= set(QUERIES)
    for name in sorted(ORACLE_SQL)[::4]:
        con.execute(ORACLE_SQL[name])
        columns, want = [d[0] for d in con.description], con.fetchall()
        got = QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(columns) and got.count() == len(want), name


def test_type_findings_of_whole_values(spark, tmp_path):
    from rowwarden.queries import QUERIES

    late = "palavra " * 6 + "varchar"
    spark.createDataFrame([("b", "NUMBER(9)"), ("b", "NUMBER(9)"), ("b", "")], "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, late), (2, "nada " * 10)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 2, "x")], "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.dictionary: r for r in QUERIES["type_findings"](spark, str(tmp_path)).collect()}
    assert (got["part b"].spellings, got["part b"].fields_untyped, got["part b"].unmapped) == (2, 1, 1)
    assert (got["document 1"].unmapped, got["document 2"].unmapped, got["customer 2"].date_fields_with_format) == (0, 1, 1)
    fields = spark.createDataFrame([("b", "NUMBER(9)"), ("b", "NUMBER(9)"), ("b", "nada")], "d string, type string")
    found = D.type_findings(fields, "d").first()
    assert found.type_spellings == {"NUMBER(9)": 2, "nada": 1} and found.unmapped_types == ["nada"]


def test_name_tokens_of_whole_texts(spark, tmp_path):
    from rowwarden.queries import QUERIES

    words = [f"palavra{i}" for i in range(100)]
    spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in QUERIES["name_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: ",".join(sorted(words)), 2: ""}


def test_similar_names_of_whole_lists(spark, tmp_path):
    from rowwarden.queries import QUERIES

    names = [f"{c * 12}" for c in "abcdefghijklmnopqrstuvwxy"]
    spark.createDataFrame([("b", n) for n in names], "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = json.loads(QUERIES["similar_names"](spark, str(tmp_path)).first().pairs)
    assert [(x["declared"], x["column"]) for x in pairs] == [(n, n + "s") for n in names]


def test_samples_are_by_ordinal(spark, tmp_path):
    from rowwarden.queries import QUERIES

    spark.range(9_000, 15_000, 1).selectExpr("id AS event_id", "'a' AS event_type", "id % 10 AS user_id", "timestamp'2024-01-02 03:04:05' AS ts", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.pos, r.type) for r in QUERIES["observed_header"](spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "integer"), (1, "string"), (2, "number"), (3, "any")]
    got = {r.pos: r for r in QUERIES["infer_types"](spark, str(tmp_path)).collect()}
    assert len(got) == 11 and got[0].type == "integer" and got[9].sampleEmptyShare == round(1667 / 5000, 4)


def balances_match_sql(spark, folder, name):
    """Whole, negative and very small numbers, and zero below zero, as its SQL writes them."""
    import duckdb

    from rowwarden.queries import ORACLE_SQL, QUERIES

    rows = [(i, i % 2, f"c{i}", b) for i, b in enumerate((-0.0, 0.0, -7.0, 12345678.5, 0.00001, -0.25, 1e15))]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_name string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    con.execute(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder)).select([d[0] for d in con.description])
    assert sorted(map(tuple, got.collect())) == sorted(con.fetchall())


def test_balances_of_read_json(spark, tmp_path):
    balances_match_sql(spark, tmp_path, "read_json")


def test_balances_of_read_ods(spark, tmp_path):
    balances_match_sql(spark, tmp_path, "read_ods")


def test_balances_of_read_parquet(spark, tmp_path):
    balances_match_sql(spark, tmp_path, "read_parquet")


def test_balances_of_read_xlsx(spark, tmp_path):
    balances_match_sql(spark, tmp_path, "read_xlsx")


def odd_customers_match_sql(spark, folder, name):
    """Nulls in every column beside empty texts, keys that no double holds, keys below zero, line ends, and balances of single precision."""
    import duckdb

    from rowwarden.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    rows = [(None, 1, "no key", 1.5), (1, None, "no nation", 2.0), (2, None, None, None), (3, 1, None, 3.25), (4, 1, "", 4.5), (6, 1, "no balance", None), (None, 2, None, None), (2**53 + 1, 1, "large", 0.1), (2**60 + 6, 1, "larger", 7.0), (-2, 1, "below", -8.5), (8, 1, " \r\n<&", 9.75), (9, 1, "c", 2983.91)]
    for kind in ("double", "float"):
        spark.createDataFrame(rows, f"c_custkey long, c_nationkey int, c_name string, c_acctbal {kind}").write.parquet(f"{folder}/{kind}/customer.parquet")
        con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{folder}/{kind}/customer.parquet/*.parquet'")
        con.execute(ORACLE_SQL[name])
        got = QUERIES[name](spark, f"{folder}/{kind}").select([d[0] for d in con.description])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.fetchall())), kind


def test_odd_customers_of_read_ods(spark, tmp_path):
    odd_customers_match_sql(spark, tmp_path, "read_ods")


def test_odd_customers_of_read_parquet(spark, tmp_path):
    odd_customers_match_sql(spark, tmp_path, "read_parquet")


def test_odd_customers_of_read_xlsx(spark, tmp_path):
    odd_customers_match_sql(spark, tmp_path, "read_xlsx")


def test_whole_numbers_of_xlsx():
    cells = "".join(f"<c><v>{v}</v></c>" for v in ("9007199254740993", "-1000000000000000007", "-0", "007", "5.0", "1e3", "12345678901234567890123"))
    [[row]] = [list(t.rows) for t in S.tables_of(archive(XLSX | {"xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>"}))]
    assert row == ["9007199254740993", "-1000000000000000007", "0", "7", "5", "1000", str(int(12345678901234567890123.0))]


def test_dictionaries_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)
    contents = [b"Campo;Tipo\nx;texto\n", b"a,b\n1,2\n", b'{"a": [', b'{"a": [{"campo": "x", "tipo": "texto"}]}', b"<html>", b"<r><x></r>"]

    def make(batches):
        for b in batches:
            for i in b["id"]:
                made.add(1)
            yield b.assign(path=[f"f{i}" for i in b["id"]], format="CSV", content=[contents[i % 6] for i in b["id"]])[["path", "format", "content"]]

    fields, outcomes = D.read_dictionaries(spark.range(60).mapInPandas(make, "path string, format string, content binary"))
    kinds = {r.path: r.error_kind for r in outcomes.collect()}
    assert kinds == {f"f{i}": (None, "no-field-table", "malformed", None, "html-page", "malformed")[i % 6] for i in range(60)}
    assert sorted((r.path, r.part, r.name) for r in fields.collect()) == sorted((f"f{i}", "a" if i % 6 == 3 else "", "x") for i in range(60) if i % 3 == 0)
    assert made.value == 60


def test_dictionaries_are_read_to_their_end(spark):
    n, late = 6000, 5500
    rows = lambda named: "Campo;Tipo\n" + "".join(f"f{i};texto\n" if i >= named else ";texto\n" for i in range(n))
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    sheet = "<worksheet><sheetData>" + "".join("<row>" + "".join(map(cell, r.split(";"))) + "</row>" for r in rows(late).splitlines()) + "</sheetData></worksheet>"
    records = json.dumps([{"campo": f"f{i}"} | ({"tipo": "texto"} if i >= late else {}) for i in range(n)])
    elements = "<r>" + "".join(f"<x><campo>f{i}</campo>{'<tipo>texto</tipo>' if i >= late else ''}</x>" for i in range(n)) + "</r>"
    data = {
        "csv": rows(0).encode(), "late": rows(late).encode(), "zip": archive({"d.csv": rows(late)}), "xlsx": archive(XLSX | {"xl/worksheets/sheet1.xml": sheet}), "json": archive({"d.json": records}), "xml": archive({"d.xml": elements}),
        "cut": archive({"d.json": "[" + '{"x": 1},' * n}), "entity": archive({"d.xml": '<!DOCTYPE r [<!ENTITY e "e">]><r><x><campo>a</campo></x></r>'}), "title": ("Campo" + " " * 300 + "x;Tipo\na;texto\n").encode(), "blanks": (" " * 300 + "Campo;Tipo\na;texto\n").encode(),
    }
    fields, outcomes = D.read_dictionaries(spark.createDataFrame([(k, "CSV", bytearray(v)) for k, v in data.items()], "path string, format string, content binary"))
    assert {r.path: r.error_kind for r in outcomes.collect()} == dict.fromkeys(data) | {"cut": "malformed", "entity": "malformed", "title": "no-field-table"}
    got = {r.path: (r.n, r.typed) for r in fields.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "texto").alias("typed")).collect()}
    assert got == {"csv": (n, n), "late": (n - late, n - late), "zip": (n - late, n - late), "xlsx": (n - late, n - late), "json": (n, n - late), "xml": (n, n - late), "blanks": (1, 1)}
