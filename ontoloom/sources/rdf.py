"""RDF/XML and Turtle text to triples, and triples into class tables.

Files are read as a distributed scan (one row per file), parsed where they lie and turned into class tables by
joins and aggregates; no document passes through the driver.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.catalog import BY_DOCUMENT, ID, RDF, SELF, STATEMENT, TYPE, Catalog, ClassDef
from ontoloom.plans.parser import Parser, QuerySyntaxError
from ontoloom.plans.planner import Binding, iri_of
from ontoloom.plans.terms import Blank, Iri, Lit, Triple
from ontoloom.plans.update import Updater, _default
from ontoloom.session import materialize

TRIPLE_SCHEMA = "src string, n long, s string, p string, o string, r boolean"
_XML = "{http://www.w3.org/XML/1998/namespace}"


def _name(tag: str) -> str:
    """``{ns}local`` as an IRI."""
    ns, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return ns + local


def parse_rdf_xml(text: str | bytes, base: str = "", mark: str = "") -> Iterator[tuple[str, str, str, bool]]:
    """Triples ``s, p, o, is_resource`` of a document, top-level node by top-level node.

    Nodes without a name are numbered, after ``mark``; no ``rdf:nodeID`` can begin as their names do.
    """
    data = text.encode() if isinstance(text, str) else text
    blank = [0]

    def fresh() -> str:
        blank[0] += 1
        return f"_:-{mark}{blank[0]}"

    def resolve(ref: str, at: str) -> str:
        return ref if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) else at + ref

    def node(e: ElementTree.Element, at: str) -> Iterator[tuple]:
        """Triples of a node element; the first yield is its subject."""
        at = e.get(_XML + "base", at)
        if (x := e.get(f"{{{RDF}}}ID")) is not None:
            s = at + "#" + x
        elif (x := e.get(f"{{{RDF}}}about")) is not None:
            s = resolve(x, at)
        elif (x := e.get(f"{{{RDF}}}nodeID")) is not None:
            s = "_:" + x
        else:
            s = fresh()
        yield s
        if _name(e.tag) != RDF + "Description":
            yield s, TYPE, _name(e.tag), True
        for k, v in e.attrib.items():
            n = _name(k)
            if n == TYPE:
                yield s, TYPE, resolve(v, at), True
            elif not n.startswith(RDF) and not k.startswith(_XML) and n:
                yield s, n, v, False
        count = 0
        for c in e:
            p = _name(c.tag)
            if p == RDF + "li":
                count += 1
                p = f"{RDF}_{count}"
            if (x := c.get(f"{{{RDF}}}resource")) is not None:
                yield s, p, resolve(x, at), True
            elif (x := c.get(f"{{{RDF}}}nodeID")) is not None:
                yield s, p, "_:" + x, True
            elif c.get(f"{{{RDF}}}parseType") == "Literal":
                yield s, p, (c.text or "") + "".join(ElementTree.tostring(k, encoding="unicode") for k in c), False
            elif c.get(f"{{{RDF}}}parseType") == "Resource":
                inner = ElementTree.Element(f"{{{RDF}}}Description", {})
                inner.extend(list(c))
                got = node(inner, at)
                o = next(got)
                yield s, p, o, True
                yield from got
            elif len(c):
                for child in c:
                    got = node(child, at)
                    o = next(got)
                    yield s, p, o, True
                    yield from got
            else:
                yield s, p, c.text or "", False

    depth, root_is_rdf = 0, False
    for event, e in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                root_is_rdf = _name(e.tag) == RDF + "RDF"
                base = e.get(_XML + "base", base)
            continue
        depth -= 1
        if depth == (1 if root_is_rdf else 0):
            got = node(e, base)
            next(got)
            yield from got
            e.clear()


class _Turtle(Parser):
    """The dialect's triples with Turtle's directives."""

    def document(self) -> list[Triple]:
        out: list[Triple] = []
        while self.peek()[0] != "end":
            kind, text, _ = self.peek()
            if text.lower() in ("@prefix", "prefix"):
                self.at += 1
                kind, name, at = self.next()
                if kind != "qname" or not name.endswith(":"):
                    raise QuerySyntaxError(f"expected a prefix at {at}")
                self.prefixes[name[:-1]] = self._iri_text()
                self.accept(".")
            elif text.lower() in ("@base", "base"):
                self.at += 1
                self.base = self._iri_text()
                self.accept(".")
            else:
                s = self._node(out)
                if not (isinstance(s, Blank) and s.anonymous and self.peek()[1] == "."):
                    self._predicates(s, out)
                self.need(".")
        return out


def parse_turtle(text: str, base: str = "") -> Iterator[tuple[str, str, str, bool]]:
    """Triples ``s, p, o, is_resource`` of a Turtle text; collections are not of the dialect."""
    long = re.compile(r'"""(.*?)"""|\'\'\'(.*?)\'\'\'', re.S)
    text = long.sub(lambda m: '"' + (m.group(1) or m.group(2) or "").replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"', text)
    term = lambda t: (t.value if isinstance(t, (Iri, Lit)) else "_:" + t.name, not isinstance(t, Lit))
    for t in _Turtle(text, {}, base).document():
        yield term(t.s)[0], t.p.value, *term(t.o)


def read_triples(spark: SparkSession, path: str, form: str = "rdfxml", base: str = "") -> DataFrame:
    """Triples of all files below ``path`` (``src, n, s, p, o, r``); blank nodes are kept apart by file.

    A file that is not well-formed gives one row with ``s`` null and the reason in ``o``.
    """
    parse: Callable = parse_turtle if form == "turtle" else parse_rdf_xml

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for src, content in zip(pdf.path, pdf.content):
                rows, mark = [], f"_:{abs(hash_text(src)):x}_"
                own = lambda x, m=mark: m + x[2:] if x.startswith("_:") else x
                try:
                    text = bytes(content)
                    for n, (s, p, o, r) in enumerate(parse(text.decode() if form == "turtle" else text, base)):
                        rows.append((src, n, own(s), p, own(o) if r else o, r))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["src", "n", "s", "p", "o", "r"])
                            rows = []
                except (ElementTree.ParseError, QuerySyntaxError, UnicodeDecodeError) as e:
                    rows.append((src, -1, None, None, f"{type(e).__name__}: {e}", False))
                if rows:
                    yield pd.DataFrame(rows, columns=["src", "n", "s", "p", "o", "r"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, TRIPLE_SCHEMA)


def read_node_lines(catalog: Catalog, path: str) -> DataFrame:
    """Triples of RDF/XML files with one top-level node per line (``src, n, s, p, o, r``), as ``write_rdf_xml`` writes them.

    Such a file is split like any text, so one large file is read by many tasks. The prefixes are those of the
    catalog; lines that begin or end the document are passed over. ``n`` grows along a file; nodes with one
    ``rdf:nodeID`` are one within a file. A line that is not well-formed gives one row with ``s`` null.
    """
    spaces = " ".join(f'xmlns:{p}="{escape(ns)}"' for p, ns in catalog.namespaces.items())
    head = f'<rdf:RDF {spaces} xml:base="{escape(catalog.base)}">'
    base = catalog.base

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, place = None, 0
        for pdf in batches:
            rows = []
            for src, block, line in zip(pdf.src, pdf.block, pdf.value):
                if (src, block) != at:
                    at, place = (src, block), int(block)
                start, place = place, place + len(line.encode()) + 1  # a triple takes more than a byte of its line
                bare = line.strip()
                if not bare or bare.startswith(("<?xml", "<rdf:RDF", "</rdf:RDF")):
                    continue
                own = f"_:{abs(hash_text(src)):x}_"
                try:
                    for n, (s, p, o, r) in enumerate(parse_rdf_xml(f"{head}{bare}</rdf:RDF>", base, f"{start}-")):
                        s, o = (own + x[2:] if x.startswith("_:") and (x is s or r) else x for x in (s, o))
                        rows.append((src, start + n, s, p, o, r))
                except ElementTree.ParseError as e:
                    rows.append((src, start, None, None, f"ParseError: {e}", False))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["src", "n", "s", "p", "o", "r"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["src", "n", "s", "p", "o", "r"])

    lines = catalog.spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"), "value").mapInPandas(run, TRIPLE_SCHEMA)


def hash_text(s: str) -> int:
    """A number for a text that is the same in every process."""
    h = 1469598103934665603
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return h


@dataclass
class Loaded:
    """The catalog after a load, triples that were not used with the reason, and reified statements."""

    catalog: Catalog
    rejected: DataFrame
    statements: DataFrame


def load_triples(catalog: Catalog, triples: DataFrame) -> Loaded:
    """Merge triples (``TRIPLE_SCHEMA``) into the class tables.

    A typed subject becomes a row of its class unless it exists; ``rdf:Description`` of a known subject changes
    it. Of several types the first counts. Scalars are replaced by the last value, arrays appended. Links to
    nothing, unknown properties and classes, and subjects without a class are rejected with a reason.
    """
    spark = catalog.spark
    t = materialize(triples, "triples")
    bad = t.filter("s is null").select("src", "n", "s", "p", "o", F.lit("not well-formed").alias("reason"))
    t = t.filter("s is not null")
    # one order over all files: files by name, triples by place
    t = t.withColumn("n", F.col("n") + F.pmod(F.xxhash64("src"), F.lit(1 << 20)) * F.lit(1 << 40))
    types = t.filter(F.col("p") == TYPE).groupBy("s").agg(F.min(F.struct("n", "o"))["o"].alias("cls"))
    types = materialize(types, "types")
    known = [c for c in catalog.classes]
    u = Updater(catalog, BY_DOCUMENT)
    for r in types.filter(F.col("cls").isin(*known)).select("cls").distinct().collect() if known else []:
        _append_rows(u, r.cls, types.filter(F.col("cls") == r.cls).select("s"))
    props = {i: p for i, p in catalog.all_properties().items() if p.computed is None and p.inverse is None}
    used = t.filter(F.col("p").isin(*props)) if props else t.limit(0)
    pools = u.catalog.concrete()
    u._apply(used.select("s", "p", "o", "r", "n"), [Triple(Iri("*"), Iri(i), Iri("*")) for i in props], True, pools)
    everyone = [u.catalog.classes[c].table.select(iri_of(F.col("id"), Binding("res", u.catalog.classes[c].prefix)).alias("s")) for c in pools]
    ids = reduce(DataFrame.unionByName, everyone, spark.createDataFrame([], "s string"))
    no_prop = t.filter(~F.col("p").isin(TYPE, SELF, ID, RDF + "subject", RDF + "predicate", RDF + "object", *props))
    rejected = bad.unionByName(no_prop.select("src", "n", "s", "p", "o", F.lit("unknown property").alias("reason")))
    rejected = rejected.unionByName(t.filter((F.col("p") == TYPE) & ~F.col("o").isin(STATEMENT, *known)).select("src", "n", "s", "p", "o", F.lit("unknown class").alias("reason")))
    links = [i for i, p in props.items() if not p.is_literal]
    if links:
        dangling = t.filter(F.col("p").isin(*links) & F.col("r")).join(ids.select(F.col("s").alias("o")), "o", "left_anti")
        rejected = rejected.unionByName(dangling.select("src", "n", "s", "p", "o", F.lit("link to nothing").alias("reason")))
    nameless = used.join(ids, "s", "left_anti")
    rejected = rejected.unionByName(nameless.select("src", "n", "s", "p", "o", F.lit("subject without a class").alias("reason")))
    return Loaded(u.catalog, rejected, reified(t))


def _append_rows(u: Updater, cls: str, subjects: DataFrame) -> None:
    """Rows with defaults for the subjects of a class that do not exist yet."""
    cat = u.catalog
    c = cat.class_def(cls)
    if c.rows is None:
        fields = [T.StructField("id", T.StringType())] + [T.StructField(p.name, p.type_of(T.StringType())) for p in cat.properties(cls).values() if p.computed is None and p.inverse is None]
        c = ClassDef(c.iri, c.extends, c.properties, cat.spark.createDataFrame([], T.StructType(fields)), "", c.comment, c.read_only, c.hidden)
    kind = c.table.schema["id"].dataType
    key = F.substring("s", len(c.prefix) + 1, 1_000_000).try_cast(kind)
    new = subjects.filter(F.col("s").startswith(c.prefix)).select(key.alias("id")).filter("id is not null").distinct().join(c.table.select("id"), "id", "left_anti")
    by_name = {p.name: p for p in cat.properties(cls).values()}
    cols = [F.col("id") if f.name == "id" else _default(by_name[f.name], f.dataType).alias(f.name) for f in c.table.schema]
    u.catalog = cat.with_tables({cls: (c.table.unionByName(new.select(*cols)), c.prefix)})


def reified(triples: DataFrame) -> DataFrame:
    """``subject, predicate, object, meta`` of reified statements; ``meta`` maps further properties to texts."""
    about = triples.join(triples.filter((F.col("p") == TYPE) & (F.col("o") == STATEMENT)).select("s").distinct(), "s", "left_semi")
    pick = lambda n: F.max(F.when(F.col("p") == RDF + n, F.col("o"))).alias(n)
    other = ~F.col("p").isin(TYPE, RDF + "subject", RDF + "predicate", RDF + "object")
    meta = F.map_from_entries(F.array_distinct(F.collect_list(F.when(other, F.struct("p", "o"))))).alias("meta")
    return about.dropDuplicates(["s", "p"]).groupBy("s").agg(pick("subject"), pick("predicate"), pick("object"), meta).drop("s")


def load(catalog: Catalog, path: str, form: str = "rdfxml", after: Callable[[Catalog], Catalog] | None = None) -> Loaded:
    """Read and merge the files below ``path``; ``after`` may change the catalog once all resources are there.

    ``form`` is ``rdfxml``, ``turtle`` or ``lines`` (RDF/XML with a node per line, which is split over tasks).
    """
    triples = read_node_lines(catalog, path) if form == "lines" else read_triples(catalog.spark, path, form, catalog.base)
    out = load_triples(catalog, triples)
    return replace(out, catalog=after(out.catalog)) if after else out
