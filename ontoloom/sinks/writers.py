"""Results and resources as text: SPARQL XML, CSV, RDF/XML, JSON-LD and REST JSON.

Each writer has a form that is a DataFrame of text rows (for ``write.text``), made by Column expressions, and where
one document is wanted, an iterator over it that keeps one partition on the driver at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.catalog import CLASS, PROPERTY, RDF, RDFS, TYPE, Catalog, ClassDef, PropertyDef, split_iri
from ontoloom.functions.lexical import lexical, xml_escape
from ontoloom.plans.planner import Binding, Planner, iri_of, key_of, text_of

_IRI = r"^([A-Za-z][A-Za-z0-9+.-]*://|_:|urn:)"


def _text(df: DataFrame, name: str) -> Column:
    return lexical(F.col(f"`{name}`"), df.schema[name].dataType)


# query results


def sparql_xml_rows(df: DataFrame) -> DataFrame:
    """One ``<result>`` per row; unbound variables are left out; texts that look like IRIs are ``<uri>``."""
    parts: list[Column] = [F.lit("<result>")]
    for n in df.columns:
        t = _text(df, n)
        body = F.when(t.rlike(_IRI) if isinstance(df.schema[n].dataType, T.StringType) else F.lit(False), F.concat(F.lit("<uri>"), xml_escape(t), F.lit("</uri>"))).otherwise(
            F.concat(F.lit("<literal>"), xml_escape(t), F.lit("</literal>"))
        )
        parts.append(F.coalesce(F.concat(F.lit(f'<binding name="{escape(n)}">'), body, F.lit("</binding>")), F.lit("")))
    return df.select(F.concat(*parts, F.lit("</result>")).alias("value"))


def sparql_xml(df: DataFrame) -> Iterator[str]:
    """Lines of the whole result document."""
    yield '<?xml version="1.0"?>'
    yield '<sparql xmlns="http://www.w3.org/2005/sparql-results#">'
    yield "<head>" + "".join(f'<variable name="{escape(n)}"/>' for n in df.columns) + "</head>"
    yield "<results>"
    for r in sparql_xml_rows(df).toLocalIterator():
        yield r.value
    yield "</results></sparql>"


def csv_rows(df: DataFrame) -> DataFrame:
    """Rows as CSV lines, quoted where needed, without the header."""
    cells = []
    for n in df.columns:
        t = F.coalesce(_text(df, n), F.lit(""))
        cells.append(F.when(t.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def csv(df: DataFrame) -> Iterator[str]:
    yield ",".join(df.columns)
    for r in csv_rows(df).toLocalIterator():
        yield r.value


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


# resources


def _tags(catalog: Catalog, iris: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Element names of IRIs and the namespaces that they need; unknown namespaces get a prefix."""
    spaces = {ns: p for p, ns in catalog.namespaces.items()}
    used: dict[str, str] = {RDF: "rdf"}
    out = {}
    for i in iris:
        ns, local = split_iri(i)
        if ns not in spaces:
            spaces[ns] = f"ns{len(spaces)}"
        used[ns] = spaces[ns]
        out[i] = f"{spaces[ns]}:{local}"
    return out, {p: ns for ns, p in used.items()}


def rdf_xml_rows(catalog: Catalog, c: ClassDef, rows: DataFrame | None = None) -> DataFrame:
    """One typed node element per resource of a class."""
    planner = Planner(catalog)
    props = {i: p for i, p in catalog.properties(c.iri).items() if p.inverse is None}
    tag, _ = _tags(catalog, [c.iri, *props])
    iri = iri_of(F.col("id"), Binding("res", c.prefix))
    local = F.lit(catalog.base + "#") if catalog.base else F.lit("\x00")
    about = (
        F.when(iri.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), xml_escape(F.substring(iri, 3, 1_000_000)), F.lit('"')))
        .when(iri.startswith(local) if catalog.base else F.lit(False), F.concat(F.lit(' rdf:ID="'), xml_escape(F.substring(iri, len(catalog.base) + 2, 1_000_000)), F.lit('"')))
        .otherwise(F.concat(F.lit(' rdf:about="'), xml_escape(iri), F.lit('"')))
    )
    parts = [F.concat(F.lit(f"<{tag[c.iri]}"), about, F.lit(">"))]
    for i, p in props.items():
        v, b = planner.value(p, c), planner.binding(p)
        if b.kind == "lit" and p.computed is None and not p.multi:
            b = Binding("lit", type=c.table.schema[p.name].dataType, format=p.format)
        one = _element(tag[i], b, RDFS + "XMLLiteral" == p.range)
        if p.multi:
            parts.append(F.coalesce(F.array_join(F.transform(v, one), ""), F.lit("")))
        else:
            here = planner.present(p, v)
            parts.append(F.coalesce(one(v) if here is None else F.when(here, one(v)), F.lit("")))
    return (c.table if rows is None else rows).select(F.concat(*parts, F.lit(f"</{tag[c.iri]}>")).alias("value"))


def _element(tag: str, b: Binding, raw: bool):
    def one(v: Column) -> Column:
        t = text_of(v, b)
        if b.kind == "res":
            return F.when(t.startswith("_:"), F.concat(F.lit(f'<{tag} rdf:nodeID="'), xml_escape(F.substring(t, 3, 1_000_000)), F.lit('"/>'))).otherwise(
                F.concat(F.lit(f'<{tag} rdf:resource="'), xml_escape(t), F.lit('"/>'))
            )
        return F.concat(F.lit(f"<{tag}>" if not raw else f'<{tag} rdf:parseType="Literal">'), t if raw else xml_escape(t), F.lit(f"</{tag}>"))

    return one


def _head(catalog: Catalog, iris: list[str]) -> str:
    _, spaces = _tags(catalog, iris)
    return '<?xml version="1.0"?>\n<rdf:RDF ' + " ".join(f'xmlns:{p}="{escape(ns)}"' for p, ns in spaces.items()) + (f' xml:base="{escape(catalog.base)}"' if catalog.base else "") + ">"


def rdf_xml(catalog: Catalog, classes: list[str] | None = None) -> Iterator[str]:
    """A whole document: every resource of the given classes, or of all."""
    chosen = catalog.concrete(classes)
    yield _head(catalog, [i for c in chosen for i in (c, *catalog.properties(c))])
    for c in chosen:
        for r in rdf_xml_rows(catalog, catalog.classes[c]).toLocalIterator():
            yield r.value
    yield "</rdf:RDF>"


def write_rdf_xml(catalog: Catalog, path: str, classes: list[str] | None = None) -> None:
    """All resources as text files, a folder per class; every file is a document of its own, so it loads again."""
    for c in catalog.concrete(classes):
        head = _head(catalog, [c, *catalog.properties(c)])

        def wrap(parts: Iterator[pd.DataFrame], head: str = head) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"value": [head]})
            yield from parts
            yield pd.DataFrame({"value": ["</rdf:RDF>"]})

        rdf_xml_rows(catalog, catalog.classes[c]).mapInPandas(wrap, "value string").write.text(f"{path}/{split_iri(c)[1]}")


def describe_rdf_xml(catalog: Catalog, described: DataFrame) -> DataFrame:
    """Described triples (``s, p, o, is_resource``) as one ``rdf:Description`` per subject."""
    props = list(catalog.all_properties())
    tag, _ = _tags(catalog, [TYPE, *props])
    names = F.create_map(*[x for i in [TYPE, *props] for x in (F.lit(i), F.lit(tag[i]))])
    t = names[F.col("p")]
    e = F.when(F.col("is_resource"), F.concat(F.lit("<"), t, F.lit(' rdf:resource="'), xml_escape(F.col("o")), F.lit('"/>'))).otherwise(
        F.concat(F.lit("<"), t, F.lit(">"), xml_escape(F.col("o")), F.lit("</"), t, F.lit(">"))
    )
    return described.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(e)), "").alias("e")).select(
        F.concat(F.lit('<rdf:Description rdf:about="'), xml_escape(F.col("s")), F.lit('">'), "e", F.lit("</rdf:Description>")).alias("value")
    )


def schema_rdf_xml(catalog: Catalog) -> str:
    """Properties, then classes, of the catalog."""
    out = [_head(catalog, [CLASS, PROPERTY])]
    for p in catalog.all_properties().values():
        body = "".join(f'<rdfs:domain rdf:resource="{escape(d)}"/>' for d in catalog.domains(p.iri)) + f'<rdfs:range rdf:resource="{escape(p.range)}"/>'
        out.append(f'<rdf:Property rdf:about="{escape(p.iri)}">{body}</rdf:Property>')
    for c in catalog.classes.values():
        body = "".join(f'<rdfs:subClassOf rdf:resource="{escape(s)}"/>' for s in catalog.supers(c.iri)) + (f"<rdfs:comment>{escape(c.comment)}</rdfs:comment>" if c.comment else "")
        out.append(f'<rdfs:Class rdf:about="{escape(c.iri)}">{body}</rdfs:Class>')
    return "\n".join([*out, "</rdf:RDF>"])


def _json_fields(catalog: Catalog, c: ClassDef) -> list[tuple[str, PropertyDef, Column]]:
    planner = Planner(catalog)
    out = []
    for i, p in catalog.properties(c.iri).items():
        if p.inverse is not None or p.range == RDFS + "XMLLiteral":
            continue
        v, b = planner.value(p, c), planner.binding(p)
        plain = p.is_literal and isinstance(b.type, T.NumericType) and p.format is None
        one = (lambda x: x) if plain else _texter(b)
        if p.multi:
            j = F.transform(v, one)
        else:
            here = planner.present(p, v)
            j = one(v) if here is None else F.when(here, one(v))
        out.append((i, p, j))
    return out


def _texter(b: Binding):
    return lambda x: text_of(x, b)


def json_ld_rows(catalog: Catalog, c: ClassDef, rows: DataFrame | None = None) -> DataFrame:
    """One JSON-LD object per resource: context, id, type; arrays for multi-valued properties; numbers plain."""
    fields = _json_fields(catalog, c)
    context = json.dumps({p: ns for p, ns in catalog.namespaces.items()})
    iri = iri_of(F.col("id"), Binding("res", c.prefix))
    planner = Planner(catalog)
    cols = []
    for i, p, j in fields:
        if not p.is_literal:
            j = F.transform(planner.value(p, c), _linker(planner.binding(p))) if p.multi else F.when(planner.value(p, c).isNotNull(), F.struct(text_of(planner.value(p, c), planner.binding(p)).alias("@id")))
        cols.append(j.alias(catalog.qname(i)))
    body = F.to_json(F.struct(iri.alias("@id"), F.lit(catalog.qname(c.iri)).alias("@type"), *cols))
    return (c.table if rows is None else rows).select(F.concat(F.lit('{"@context":' + context + ","), F.substring(body, 2, 100_000_000)).alias("value"))


def _linker(b: Binding):
    return lambda x: F.struct(text_of(x, b).alias("@id"))


def rest_rows(catalog: Catalog, c: ClassDef, rows: DataFrame | None = None) -> DataFrame:
    """One plain JSON object per resource."""
    iri = iri_of(F.col("id"), Binding("res", c.prefix))
    return (c.table if rows is None else rows).select(F.to_json(F.struct(iri.alias("id"), *[j.alias(p.name) for _, p, j in _json_fields(catalog, c)])).alias("value"))


def rest_parts(catalog: Catalog, path: str) -> tuple[int, str, Iterator[str]]:
    """Status, media type and parts of the body. ``/rest``: class names; ``/rest/Class``: all its ids, which come
    one partition at a time; ``/rest/Class/id``: one resource."""

    def ids(c: ClassDef) -> Iterator[str]:
        yield "["
        for n, r in enumerate(c.table.select(iri_of(F.col("id"), Binding("res", c.prefix)).alias("i")).toLocalIterator()):
            yield (", " if n else "") + json.dumps(r.i)
        yield "]"

    kind = "application/json"
    parts = [x for x in path.split("/") if x][1:]
    by_name = {split_iri(c)[1]: catalog.classes[c] for c in catalog.concrete()}
    if not parts:
        return 200, kind, iter([json.dumps(sorted(by_name))])
    c = by_name.get(parts[0])
    if c is not None and len(parts) == 1:
        return 200, kind, ids(c)
    if c is not None and len(parts) == 2:
        local = parts[1]
        for full in (local, split_iri(c.prefix)[0] + local if c.prefix else local, split_iri(c.iri)[0] + local):
            key = key_of(full, c)
            if key is not None:
                got = rest_rows(catalog, c, c.table.filter(F.col("id") == key)).limit(1).collect()
                if got:
                    return 200, kind, iter([got[0].value])
    return 404, kind, iter([json.dumps({"error": "not found"})])


def rest(catalog: Catalog, path: str) -> tuple[int, str]:
    """``rest_parts`` as one text."""
    status, _, parts = rest_parts(catalog, path)
    return status, "".join(parts)


def rendered(catalog: Catalog, iri: str) -> str | None:
    """A resource as its class renders it; None if it has no such class or does not exist."""
    for c in catalog.concrete():
        d = catalog.classes[c]
        key = key_of(iri, d) if d.render is not None else None
        if key is not None:
            got = d.render(d.table.filter(F.col("id") == key)).limit(1).collect()
            if got:
                return got[0][0]
    return None


_ODS = "application/vnd.oasis.opendocument.spreadsheet"


def write_ods(df: DataFrame, path: str, most: int = 1_048_575) -> None:
    """A result as one sheet of an OpenDocument file; more than ``most`` rows do not fit a sheet and are an error."""
    import zipfile

    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}

    def cell(name: str, v: str | None) -> str:
        if v is None:
            return "<table:table-cell/>"
        kind = f'office:value-type="float" office:value="{escape(v)}"' if name in numeric else 'office:value-type="string"'
        return f"<table:table-cell {kind}><text:p>{escape(v)}</text:p></table:table-cell>"

    line = lambda cells: "<table:table-row>" + "".join(cells) + "</table:table-row>"
    ns = "urn:oasis:names:tc:opendocument:xmlns:"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), _ODS)
        z.writestr("META-INF/manifest.xml", f'<manifest:manifest xmlns:manifest="{ns}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODS}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
        with z.open("content.xml", "w") as out:
            out.write(f'<office:document-content xmlns:office="{ns}office:1.0" xmlns:table="{ns}table:1.0" xmlns:text="{ns}text:1.0"><office:body><office:spreadsheet><table:table table:name="result">'.encode())
            out.write(line(f'<table:table-cell office:value-type="string"><text:p>{escape(n)}</text:p></table:table-cell>' for n in df.columns).encode())
            for k, r in enumerate(df.select(*[_text(df, n).alias(n) for n in df.columns]).toLocalIterator()):
                if k >= most:
                    raise ValueError(f"more than {most} rows")
                out.write(line(cell(n, r[n]) for n in df.columns).encode())
            out.write(b"</table:table></office:spreadsheet></office:body></office:document-content>")
