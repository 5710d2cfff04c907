"""A small catalog and a plain pattern matcher to compare with."""

from __future__ import annotations

from ontoloom.catalog import OBJ, RDF, XSD, Catalog, ClassDef, PropertyDef
from ontoloom.functions.lexical import hex_in, hex_out

EX = "http://example.org/t#"


def p(name, kind, **kw):
    return PropertyDef(EX + name, kind if ":" in kind else EX + kind, **kw)


def catalog(spark):
    """C extends B extends A; links, arrays, text, numbers."""
    c = Catalog(spark).with_namespace("ex", EX)
    schema = "id string, n int, s string, link string, many array<string>, nums array<int>"
    cols = (p("n", XSD + "int"), p("s", XSD + "string"), p("link", "A"), p("many", "A", multi=True), p("nums", XSD + "int", multi=True))
    rows = {
        "A": [("a1", 1, "x", "a2", ["a1", "b1"], [1, 1]), ("a2", 0, "", None, [], []), ("a3", 5, "y", "a3", ["c1"], [2, 3])],
        "B": [("b1", 1, "x", "c1", ["a1", "a1"], [1])],
        "C": [("c1", 7, "5", "a1", [], [])],
    }
    for name, up in (("A", None), ("B", "A"), ("C", "B")):
        full = [(EX + i, n, s, EX + x if x else None, [EX + y for y in m], k) for i, n, s, x, m, k in rows[name]]
        c = c.with_class(ClassDef(EX + name, EX + up if up else None, cols if up is None else (p("hexed", XSD + "int", column="n", parse=hex_in, format=hex_out),) if name == "B" else (), spark.createDataFrame(full, schema)))
    return c


def triples(c):
    """All (s, p, o) of the rows as Python values."""
    out = []
    for iri in c.concrete():
        d = c.classes[iri]
        for r in d.table.collect():
            out += [(r.id, RDF + "type", ("iri", iri)), (r.id, OBJ + "self", ("iri", r.id)), (r.id, OBJ + "id", ("lit", r.id))]
            for name, q in c.properties(iri).items():
                v = r[q.name]
                for x in v if q.multi else [v]:
                    if x is None or x == "":
                        continue
                    text = format(x, "x") if q.format else str(x)
                    out.append((r.id, name, ("lit" if q.is_literal else "iri", text)))
    return out


def match(data, patterns, up):
    """Solutions (lists of dicts) of triple patterns; a variable starts with ``?``."""
    rows = [{}]
    for s, q, o in patterns:
        new = []
        for row in rows:
            for ts, tp, (kind, to) in data:
                got = dict(row)
                ok = True
                for term, value in ((s, ("iri", ts)), (q, ("iri", tp)), (o, (kind, to))):
                    if isinstance(term, str) and term.startswith("?"):
                        if got.setdefault(term, value) != value:
                            ok = False
                    elif term == ("iri", to) and tp == RDF + "type" and value[1] == to:
                        pass
                    elif tp == RDF + "type" and term is o and isinstance(o, tuple) and o[0] == "iri":
                        ok &= o[1] in up.get(to, [to])
                    elif (("iri", term) if isinstance(term, str) else term) != value:
                        ok = False
                if ok:
                    new.append(got)
        rows = new
    return rows
