import random
from collections import Counter

import pytest

from ontoloom.catalog import RDF, CatalogError
from ontoloom.engine import Engine
from ontoloom.plans.parser import QuerySyntaxError, parse
from ontoloom.plans.terms import Blank, Change, Count, Describe, Iri, Lit, Select, Var
from tests.graphs import EX, catalog, match, triples

NS = {"ex": EX, "rdf": RDF}


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_parse_select():
    q = parse("prefix p: <http://p#> select ?a count(?b) as ?n where { ?a p:x 'it\\'s' ; a ex:A , ex:B . ?a ex:n -1.5 . filter(?b >= 2) } order by ?a limit 3 offset 1", NS)
    assert isinstance(q, Select)
    assert q.items == [Var("a"), Count("b", "n")] and q.limit == 3 and q.offset == 1 and q.order == [("a", True)]
    assert q.where[0].o == Lit("it's") and q.where[1].p == Iri(RDF + "type") and len(q.where) == 4 and q.where[3].o == Lit("-1.5", True)
    assert q.filters[0].op == ">="


def test_parse_other():
    assert parse("DESCRIBE ex:x", NS) == Describe(Iri(EX + "x"), None, None)
    assert parse("BASE <http://b/> SELECT * WHERE { <q#x> ?p _:k }", NS).where[0].s == Iri("http://b/q#x")
    u = parse("DELETE DATA { ex:a ex:n 1 } ; INSERT DATA { [] a ex:A ; ex:link [ ex:n 2 ] . }", NS)
    assert [type(c) for c in u] == [Change, Change] and isinstance(u[1].insert[0].s, Blank)
    m = parse("DELETE { ?x ex:n ?n } INSERT { ?x ex:n 4 } WHERE { ?x ex:n ?n . FILTER(?n < 3) }", NS)[0]
    assert len(m.delete) == len(m.insert) == 1 and m.where.filters
    assert parse("SELECT $x WHERE { $x ex:s \"a\"@en . ?x ex:n '3'^^ex:int }", NS).variables == ["x"]


@pytest.mark.parametrize("text", ["", "SELECT WHERE { ?a ?b ?c }", "SELECT ?a { ?a ?b ?c }", "SELECT ?a WHERE { }", "SELECT ?a WHERE { ?a zz:x ?b }", "SELECT ?a WHERE { ?a ?b ?c } LIMIT x", "INSERT DATA { ?x ex:n 1 }", "SELECT ?a WHERE { ?a ?b ?c } junk", "SELECT ?a WHERE { 'x' ex:n 1 }", "DELETE DATA { ex:a ex:n 1"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text, NS)


PATTERNS = [
    "?x ex:n ?v", "?x ex:s ?v", "?x ex:link ?y", "?x ex:many ?y", "?x ex:nums ?v", "?x a ex:A", "?x a ex:B", "?x a ?t", "?y ex:n ?w", "?y ex:s ?u", "?y ex:link ?x", "?x ex:link ?x", "?y ex:many ?z", "?x ex:s 'x'", "?x ex:n 1",
    "ex:a1 ex:many ?y", "?x ex:link ex:a1", "?x ?p ?o", "?x ?p ex:a1", "?x ?p 'x'", "?x <http://ontoloom.example.org/obj#self> ?y", "?z ex:nums ?v", "?x ex:hexed ?h", "?y a ex:C", "ex:a1 ex:link ex:a2",
]


def to_plain(text):
    out = []
    for t in text.split(" . "):
        terms = []
        for x in t.split(" "):
            x = RDF + "type" if x == "a" else x
            if x.startswith("?"):
                terms.append(x)
            elif x.startswith("ex:"):
                terms.append(EX + x[3:])
            elif x.startswith("<"):
                terms.append(x[1:-1])
            elif x.startswith("'"):
                terms.append(("lit", x[1:-1]))
            else:
                terms.append(("lit", x) if x.isdigit() else x)
        if isinstance(terms[2], str) and not terms[2].startswith("?"):
            terms[2] = ("iri", terms[2])
        out.append(tuple(terms))
    return out


def test_patterns_against_matcher(cat):
    data = triples(cat)
    up = {c: [c, *cat.supers(c)] for c in cat.classes}
    r = random.Random(2)
    e = Engine(cat)
    for _ in range(20):
        text = " . ".join(r.sample(PATTERNS, r.choice([1, 2, 2, 3])))
        want = match(data, to_plain(text), up)
        got = e.query(f"SELECT * WHERE {{ {text} }}")
        names = got.columns
        assert Counter(tuple(str(x) for x in g) for g in got.collect()) == Counter(tuple(w["?" + n][1] for n in names) for w in want), text


def test_filters_order_count(cat):
    e = Engine(cat)
    assert [r.n for r in e.query("SELECT ?x ?n WHERE { ?x ex:n ?n . FILTER(?n > 0) } ORDER BY ?n ?x").collect()] == [1, 1, 5, 7]
    assert rows(e.query("SELECT ?x WHERE { ?x ex:n ?n ; ex:s ?s . FILTER(?n = ?s) }")) == []
    assert rows(e.query("SELECT ?x WHERE { ?x ex:s ?s . FILTER(?s = 5) }")) == [(EX + "c1",)]
    assert rows(e.query("SELECT ?s COUNT(?x) AS ?k WHERE { ?x ex:s ?s }")) == [("5", "1"), ("x", "2"), ("y", "1")]
    assert rows(e.query("SELECT COUNT(?x) AS ?k WHERE { ?x ex:s 'none' }")) == [("0",)]
    assert e.query("SELECT ?x WHERE { ?x ex:n ?n } ORDER BY DESC(?n) LIMIT 1").first().x == EX + "c1"
    assert Engine(cat, default_limit=2).query("SELECT ?x WHERE { ?x ex:n ?n }").count() == 2
    assert rows(e.query("SELECT ?x WHERE { ?x ex:nothing ?n }")) == []
    assert rows(e.query("SELECT ?a ?b WHERE { ?a a ex:C . ?b a ex:B }")) == [(EX + "c1", EX + "b1"), (EX + "c1", EX + "c1")]


def test_order_puts_literals_first(cat):
    got = [r.o for r in Engine(cat).query("SELECT ?o WHERE { ex:a1 ?p ?o . } ORDER BY ?o").collect()]
    kinds = [o.startswith("http") for o in got if o != EX + "a1"]
    assert kinds == sorted(kinds)


def test_schema_and_describe(cat):
    e = Engine(cat)
    assert rows(e.query("SELECT ?c WHERE { ?c rdfs:subClassOf ex:A }")) == [(EX + "B",), (EX + "C",)]
    assert (EX + "n",) in rows(e.query("SELECT ?p WHERE { ?p rdfs:domain ex:C }"))
    assert rows(e.query("SELECT ?c ?n WHERE { ?c a rdfs:Class ; obj:cardinality ?n }")) == [(EX + "A", "3"), (EX + "B", "1"), (EX + "C", "1")]
    assert len(rows(e.query("DESCRIBE ex:a1"))) == 8
    assert {r.s for r in e.query("DESCRIBE ?y WHERE { ?x ex:link ?y }").collect()} == {EX + x for x in ("a1", "a2", "a3", "c1")}
    assert e.lookup(EX + "b1", EX + "B").first().n == 1
    assert cat.is_subclass(EX + "C", EX + "A") and not cat.is_subclass(EX + "A", EX + "A") and cat.is_a(EX + "A", EX + "A")
    assert cat.qname(EX + "n") == "ex:n" and cat.expand("ex:n") == EX + "n"
    with pytest.raises(CatalogError):
        cat.expand("zz:n")


def test_updates(cat):
    e = Engine(cat)
    one = lambda q: rows(e.query(q))
    e.update("INSERT DATA { ex:a1 ex:n 12345 . ex:a1 ex:n 6789 }")
    assert one("SELECT ?n WHERE { ex:a1 ex:n ?n }") == [("6789",)]
    e.update("DELETE DATA { ex:a1 ex:n 6789 }")
    assert one("SELECT ?n WHERE { ex:a1 ex:n ?n }") == [("0",)]
    e.update("DELETE DATA { ex:a1 ex:n 55 ; ex:s 'x' ; ex:nums 1 ; ex:link ex:a2 }")
    assert one("SELECT ?s WHERE { ex:a1 ex:s ?s }") == [] and one("SELECT ?s WHERE { ex:a1 ex:nums ?s }") == [("1",)] and one("SELECT ?s WHERE { ex:a1 ex:link ?s }") == []
    assert e.update("INSERT DATA { ex:new a ex:C ; ex:link ex:a2 ; ex:many ex:a1 , ex:ghost , ex:new ; ex:n 'abc' ; ex:s 5 . }") == [EX + "new"]
    assert one("SELECT ?n ?s ?l WHERE { ex:new ex:n ?n ; ex:s ?s ; ex:link ?l }") == [("0", "5", EX + "a2")]
    assert one("SELECT ?m WHERE { ex:new ex:many ?m }") == [(EX + "a1",), (EX + "new",)]
    made = e.update("INSERT DATA { [] a ex:B ; ex:link [ ex:n 3 ] }")
    assert len(made) == 2 and all(m.startswith("_:") for m in made)
    assert one("SELECT ?n WHERE { ?x a ex:B ; ex:link ?y . ?y ex:n ?n . FILTER(?n = 3) }") == [("3",)]
    e.update("INSERT DATA { ex:b1 ex:hexed 'ff' }")
    assert one("SELECT ?n WHERE { ex:b1 ex:n ?n }") == [("255",)]
    e.update("DELETE { ?x ex:n ?n } INSERT { ?x ex:n 9 ; ex:nums ?n } WHERE { ?x ex:n ?n . FILTER(?n > 6) }")
    assert one("SELECT ?x WHERE { ?x ex:n 9 }") == [(EX + "b1",), (EX + "c1",)] and one("SELECT ?v WHERE { ex:c1 ex:nums ?v }") == [("7",)]
    before = e.catalog
    with pytest.raises(CatalogError):
        e.update("INSERT DATA { ex:a1 ex:n 1 . ex:nobody ex:n 2 }")
    assert e.catalog is before and one("SELECT ?n WHERE { ex:a1 ex:n ?n }") == [("0",)]
    for i in range(9):
        e.update(f"INSERT DATA {{ ex:a3 ex:n {i} }}")
    assert one("SELECT ?n WHERE { ex:a3 ex:n ?n }") == [("8",)]
    assert rows(Engine(cat).query("SELECT ?n WHERE { ex:a1 ex:n ?n }")) == [("1",)]  # the first version is as it was


def test_triggers_and_locks(cat):
    import dataclasses

    c = cat.with_trigger(EX + "n", "insert", lambda b: b.filter("o <> '13'"))
    e = Engine(c)
    e.update("INSERT DATA { ex:a1 ex:n 13 . ex:a2 ex:n 14 }")
    assert rows(e.query("SELECT ?x ?n WHERE { ?x a ex:A ; ex:n ?n . FILTER(?n > 12) }")) == [(EX + "a2", "14")]
    locked = c.with_class(dataclasses.replace(c.classes[EX + "A"], read_only=True))
    e = Engine(locked)
    e.update("INSERT DATA { ex:a1 ex:n 20 }")
    assert rows(e.query("SELECT ?n WHERE { ex:a1 ex:n ?n }")) == [("1",)]
    hidden = Engine(c.with_class(dataclasses.replace(c.classes[EX + "A"], hidden=frozenset([EX + "n"]))))
    assert EX + "a1" not in {r.x for r in hidden.query("SELECT ?x WHERE { ?x ex:n ?n }").collect()}
