import json
import threading
import urllib.request
from xml.etree import ElementTree

import pytest

from ontoloom.catalog import RDF, RDFS, XSD, Catalog, ClassDef, PropertyDef
from ontoloom.engine import Engine
from ontoloom.server import serve
from ontoloom.sinks import writers
from ontoloom.sources import rdf
from tests.graphs import EX, catalog

DOC = f"""<?xml version='1.0'?>
<rdf:RDF xmlns:rdf='{RDF}' xmlns:t='{EX}' xmlns:u='http://u#' xml:base='http://doc'>
  <t:A rdf:ID='one' t:s='attr &amp; more'><t:n>12 apples</t:n><t:link rdf:resource='{EX}c1'/><t:many rdf:resource='#one'/><t:many rdf:nodeID='k'/>
    <t:nums>4</t:nums><t:nums>5</t:nums></t:A>
  <t:B rdf:nodeID='k'><t:n>2</t:n><t:link><t:C rdf:about='{EX}deep'><t:s>nested</t:s></t:C></t:link></t:B>
  <rdf:Description rdf:about='{EX}a1'><t:n>77</t:n></rdf:Description>
  <rdf:Description rdf:about='{EX}late'><t:n>3</t:n><rdf:type rdf:resource='{EX}B'/></rdf:Description>
  <u:Odd rdf:about='http://u#x'><t:n>1</t:n></u:Odd>
  <t:A rdf:about='{EX}two'><u:odd>1</u:odd><t:link rdf:resource='{EX}nobody'/></t:A>
  <rdf:Statement><rdf:subject rdf:resource='http://doc#one'/><rdf:predicate rdf:resource='{EX}link'/><rdf:object rdf:resource='{EX}c1'/><t:n>12345</t:n></rdf:Statement>
</rdf:RDF>"""


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_load_rdf_xml(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(DOC)
    (tmp_path / "b.rdf").write_text("<broken")
    got = rdf.load(catalog(spark), str(tmp_path))
    e = Engine(got.catalog)
    assert rows(e.query("SELECT ?n ?s ?l WHERE { <http://doc#one> ex:n ?n ; ex:s ?s ; ex:link ?l }")) == [("12", "attr & more", EX + "c1")]
    assert [r.v for r in e.query("SELECT ?v WHERE { <http://doc#one> ex:nums ?v }").collect()] == [4, 5]
    assert e.query("SELECT ?m WHERE { <http://doc#one> ex:many ?m }").count() == 2
    assert ("nested",) in rows(e.query("SELECT ?s WHERE { ?x a ex:B ; ex:link ?y . ?y ex:s ?s }"))
    assert rows(e.query("SELECT ?n WHERE { ex:a1 ex:n ?n }")) == [("77",)]
    assert rows(e.query("SELECT ?t ?n WHERE { ex:late a ?t ; ex:n ?n }")) == [(EX + "B", "3")]
    assert rows(e.query("SELECT ?l WHERE { ex:two ex:link ?l }")) == []
    why = {r.reason for r in got.rejected.collect()}
    assert why == {"unknown property", "unknown class", "link to nothing", "subject without a class", "not well-formed"}
    s = got.statements.collect()
    assert [(r.subject, r.predicate, r.object, r.meta) for r in s] == [("http://doc#one", EX + "link", EX + "c1", {EX + "n": "12345"})]


def test_load_turtle(spark, tmp_path):
    text = f'@prefix t: <{EX}> .\nt:x a t:C ; t:n 5 ; t:s """two\nlines""" ; t:many t:a1 , t:x .\n[] a t:A ; t:link [ a t:B ; t:n 6 ] .\n'
    (tmp_path / "a.ttl").write_text(text)
    e = Engine(rdf.load(catalog(spark), str(tmp_path), "turtle").catalog)
    assert rows(e.query("SELECT ?n ?s WHERE { ex:x ex:n ?n ; ex:s ?s }")) == [("5", "two\nlines")]
    assert ("6",) in rows(e.query("SELECT ?n WHERE { ?x a ex:A ; ex:link ?y . ?y a ex:B ; ex:n ?n }"))
    assert list(rdf.parse_turtle("<a> <b> 'c' .")) == [("a", "b", "c", False)]


def test_round_trip(spark, tmp_path):
    cat = catalog(spark)
    text = "\n".join(writers.rdf_xml(cat))
    ElementTree.fromstring(text)
    (tmp_path / "all.rdf").write_text(text)
    empty = cat
    for c in cat.concrete():
        empty = empty.with_tables({c: (cat.classes[c].table.limit(0), "")})
    back = rdf.load(empty, str(tmp_path)).catalog
    for c in cat.concrete():
        key = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
        fix = lambda df: df.selectExpr("id", "n", "nullif(s, '') as s", "link", "many", "nums")
        assert key(fix(back.classes[c].table)) == key(fix(cat.classes[c].table))


def test_documentation_examples(spark):
    ns = "http://test.example.org/#"
    a = ClassDef(ns + "A", None, (PropertyDef(ns + "a", XSD + "int"),), None)
    b = ClassDef(ns + "B", ns + "A", (PropertyDef(ns + "b", XSD + "double"), PropertyDef(ns + "x", RDFS + "XMLLiteral")), spark.createDataFrame([("http://d#i", 123, 0.123, "<i>k</i>")], "id string, a int, b double, x string"))
    cat = Catalog(spark).with_namespace("test", ns).with_class(a).with_class(b)
    line = writers.rdf_xml_rows(cat, b).first().value
    assert line == '<test:B rdf:about="http://d#i"><test:a>123</test:a><test:b>0.123</test:b><test:x rdf:parseType="Literal"><i>k</i></test:x></test:B>'
    assert 'rdfs:subClassOf rdf:resource="http://test.example.org/#A"' in writers.schema_rdf_xml(cat)
    j = json.loads(writers.json_ld_rows(cat, b).first().value)
    assert j["test:a"] == 123 and j["@type"] == "test:B" and "test:x" not in j


def test_results(spark):
    df = spark.createDataFrame([("a,\"b\"", 1.5, None), ("http://x/<y>", 2.0, True)], "s string, d double, b boolean")
    assert list(writers.csv(df)) == ["s,d,b", '"a,""b""",1.5,', "http://x/<y>,2,1"]
    xml = "\n".join(writers.sparql_xml(df))
    root = ElementTree.fromstring(xml)
    ns = "{http://www.w3.org/2005/sparql-results#}"
    assert [u.text for u in root.iter(ns + "uri")] == ["http://x/<y>"] and len(list(root.iter(ns + "binding"))) == 5


def test_spreadsheet(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([("a<b", 1.5), (None, 2.0)], "s string, d double")
    writers.write_ods(df, str(tmp_path / "r.ods"))
    with zipfile.ZipFile(tmp_path / "r.ods") as z:
        assert z.namelist()[0] == "mimetype"
        root = ElementTree.fromstring(z.read("content.xml"))
    ns = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}p"
    assert [x.text for x in root.iter(ns)] == ["s", "d", "a<b", "1.5", "2"]
    with pytest.raises(ValueError):
        writers.write_ods(df, str(tmp_path / "x.ods"), most=1)


def test_rest_and_server(spark):
    e = Engine(catalog(spark))
    assert writers.rest(e.catalog, "/rest") == (200, '["A", "B", "C"]')
    assert writers.rest(e.catalog, "/rest/Zed")[0] == 404 and writers.rest(e.catalog, "/rest/A/none")[0] == 404
    assert json.loads(writers.rest(e.catalog, "/rest/A/a1")[1])["nums"] == [1, 1]
    server = serve(e)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    get = lambda path, data=None: urllib.request.urlopen(url + path, data).read().decode()
    try:
        assert "<literal>7</literal>" in get("/sparql?query=SELECT%20%3Fn%20WHERE%20%7B%20ex%3Ac1%20ex%3An%20%3Fn%20%7D")
        assert "ex:C" in get("/sparql", b"INSERT DATA { ex:q a ex:C ; ex:n 4 }") or "#C" in get("/sparql", b"DESCRIBE ex:q")
        assert "rdf:about" in get("/data/http%3A%2F%2Fexample.org%2Ft%23q")
        assert len(json.loads(get("/rest/C"))) == 2
        with pytest.raises(urllib.error.HTTPError):
            get("/sparql?query=nonsense")
    finally:
        server.shutdown()


def test_rest_lists_every_id(spark, sf):
    from ontoloom.shop import shop

    catalog = Engine(shop(spark, sf)).catalog
    ids = json.loads(writers.rest(catalog, "/rest/Order")[1])
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{sf}/orders.parquet").count() > 1000


def test_lines_are_split(spark, tmp_path):
    from ontoloom.sources.rdf import parse_rdf_xml, read_node_lines, read_triples

    cat = catalog(spark)
    line = '<ex:A rdf:about="%sn%d"><ex:n>%d</ex:n><ex:link><ex:B><ex:s>s%d</ex:s></ex:B></ex:link><ex:many rdf:nodeID="n1"/></ex:A>'
    body = [line % (EX, i, i, i) for i in range(3000)] + ["<ex:A", "", '<ex:B rdf:nodeID="n1"/>']
    head = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="{EX}">'
    (tmp_path / "a.rdf").write_text("\n".join([head, *body, "</rdf:RDF>"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_node_lines(cat, str(tmp_path / "a.rdf"))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r.s is None for r in rows) == 1
    good = [r for r in rows if r.s is not None]
    assert len(good) == 3000 * 6 + 1 and len({r.s for r in good}) == 6001
    assert len({r.o for r in good if r.p == EX + "many"}) == 1 == len({r.s for r in good if r.s.endswith("_n1")})
    names = [s for s, _, _, _ in parse_rdf_xml(f'{head}<ex:A/><ex:A rdf:nodeID="n1"/></rdf:RDF>')]
    assert len(set(names)) == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.rdf").write_text("\n".join([head, *body[:50], "</rdf:RDF>"]))
    same = lambda x: sorted((r.p, r.o) for r in x.collect() if not r.r)
    assert same(read_node_lines(cat, str(tmp_path / "b"))) == same(read_triples(spark, str(tmp_path / "b")))
