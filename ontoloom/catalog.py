"""Ontology catalog: namespaces, classes, properties and the DataFrame of each class."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OBJ = "http://ontoloom.example.org/obj#"

#: Literal ranges with their Spark type and the value of an absent scalar (None: the triple vanishes).
LITERALS: dict[str, tuple[T.DataType, Any]] = {
    XSD + "double": (T.DoubleType(), 0.0),
    XSD + "float": (T.FloatType(), 0.0),
    XSD + "integer": (T.LongType(), 0),
    XSD + "int": (T.IntegerType(), 0),
    XSD + "short": (T.ShortType(), 0),
    XSD + "unsignedInt": (T.LongType(), 0),
    XSD + "unsignedShort": (T.IntegerType(), 0),
    OBJ + "Char": (T.StringType(), None),
    XSD + "boolean": (T.BooleanType(), False),
    XSD + "string": (T.StringType(), None),
    XSD + "anyURI": (T.StringType(), None),
    XSD + "dateTime": (T.TimestampType(), None),
    XSD + "date": (T.DateType(), None),
    RDFS + "XMLLiteral": (T.StringType(), None),
}

TYPE, SELF, ID = RDF + "type", OBJ + "self", OBJ + "id"

#: A stored property of this name says where a row was last changed: 1 by a loaded document, 2 by an update.
PROVENANCE = OBJ + "prov"
BY_DOCUMENT, BY_UPDATE = 1, 2
CLASS, PROPERTY, STATEMENT = RDFS + "Class", RDF + "Property", RDF + "Statement"


class CatalogError(ValueError):
    """A name or rule of the catalog is violated."""


def split_iri(iri: str) -> tuple[str, str]:
    """Namespace and local name, parted after the first ``#``; without one everything is the local name."""
    head, sep, tail = iri.partition("#")
    return (head + sep, tail) if sep else ("", iri)


@dataclass(frozen=True)
class PropertyDef:
    """A property: its range is a literal type or a class; ``computed`` makes it a view without storage."""

    iri: str
    range: str
    multi: bool = False
    const: bool = False
    computed: Callable[[], Column] | None = None
    column: str = ""
    parse: Callable[[Column], Column] | None = None
    format: Callable[[Column], Column] | None = None
    sub_property_of: str | None = None
    inverse: Callable[[], DataFrame] | None = None  # lazily joined (owner key, value) rows of a multi-valued property

    @property
    def is_literal(self) -> bool:
        return self.range in LITERALS

    @property
    def name(self) -> str:
        return self.column or split_iri(self.iri)[1]

    @property
    def default(self) -> Any:
        return LITERALS[self.range][1] if self.is_literal else None

    def type_of(self, key: T.DataType) -> T.DataType:
        one = LITERALS[self.range][0] if self.is_literal else key
        return T.ArrayType(one) if self.multi else one


@dataclass(frozen=True)
class ClassDef:
    """A class: its table has ``id`` (the key after ``prefix``) and a column per stored property; None is abstract.

    ``rows`` may be a function that reads the table, so that a query opens only the classes that it touches.
    """

    iri: str
    extends: str | None = None
    properties: tuple[PropertyDef, ...] = ()
    rows: DataFrame | Callable[[], DataFrame] | None = None
    prefix: str = ""
    comment: str = ""
    read_only: bool = False
    hidden: frozenset[str] = frozenset()
    versioned: str | None = None  # a property whose changes keep the old state, linked by obj:prev and obj:next
    render: Callable[[DataFrame], DataFrame] | None = None  # rows to one column of text
    storage: str = "parquet"  # format of its stored table; "volatile" is not stored

    @cached_property
    def table(self) -> DataFrame | None:
        return self.rows() if callable(self.rows) else self.rows


@dataclass(frozen=True)
class User:
    """What one user may see and change: hidden properties by class, hidden and read-only classes.

    What holds for a class holds for those below it.
    """

    name: str
    hidden: dict[str, frozenset[str]] = field(default_factory=dict)
    hidden_classes: frozenset[str] = frozenset()
    read_only: frozenset[str] = frozenset()


@dataclass
class Catalog:
    """Immutable in use: changes give a new catalog, so an update is seen whole or not at all."""

    spark: SparkSession
    namespaces: dict[str, str] = field(default_factory=lambda: {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "obj": OBJ})
    classes: dict[str, ClassDef] = field(default_factory=dict)
    triggers: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    version: int = 0
    base: str = ""

    def with_namespace(self, prefix: str, ns: str) -> Catalog:
        """Register a namespace; a prefix that means another one gets a number."""
        p, n = prefix, 0
        while self.namespaces.get(p, ns) != ns:
            p, n = f"{prefix}_{n}", n + 1
        return dataclasses.replace(self, namespaces={**self.namespaces, p: ns})

    def with_class(self, c: ClassDef) -> Catalog:
        if c.extends is not None and c.extends not in self.classes:
            raise CatalogError(f"unknown superclass {c.extends}")
        return dataclasses.replace(self, classes={**self.classes, c.iri: c})

    def with_tables(self, tables: dict[str, tuple[DataFrame, str]]) -> Catalog:
        """The next version, with other tables and key prefixes for some classes."""
        new = {i: dataclasses.replace(self.classes[i], rows=t, prefix=p) for i, (t, p) in tables.items()}
        return dataclasses.replace(self, classes={**self.classes, **new}, version=self.version + 1)

    def patch(self, iri: str, *properties: PropertyDef) -> Catalog:
        """The class with further rows of properties, or others in place of its own and inherited ones of the same IRI."""
        own = {p.iri: p for p in self.class_def(iri).properties} | {p.iri: p for p in properties}
        return self.with_class(dataclasses.replace(self.classes[iri], properties=tuple(own.values())))

    def as_user(self, user: User) -> Catalog:
        """The catalog as a user has it: hidden properties are unknown, hidden classes have no rows, updates are refused."""
        out = {}
        for i, c in self.classes.items():
            above = {i, *self.supers(i)}
            hidden = frozenset().union(c.hidden, *(user.hidden.get(a, frozenset()) for a in above))
            out[i] = dataclasses.replace(c, hidden=hidden, rows=None if above & user.hidden_classes else c.rows, read_only=c.read_only or bool(above & user.read_only))
        return dataclasses.replace(self, classes=out)

    def with_trigger(self, prop: str, event: str, f: Callable[[DataFrame], DataFrame]) -> Catalog:
        """``f`` maps the batch of (s, p, o) changes before it is applied; event is ``insert`` or ``delete``."""
        if event not in ("insert", "delete"):
            raise CatalogError("a trigger is for insert or delete")
        return dataclasses.replace(self, triggers={**self.triggers, (prop, event): f})

    def class_def(self, iri: str) -> ClassDef:
        if iri not in self.classes:
            raise CatalogError(f"unknown class {iri}")
        return self.classes[iri]

    def supers(self, iri: str) -> list[str]:
        """Ancestors, nearest first."""
        out: list[str] = []
        up = self.class_def(iri).extends
        while up is not None:
            if up in out:
                raise CatalogError(f"{iri} inherits from itself")
            out.append(up)
            up = self.class_def(up).extends
        return out

    def is_subclass(self, a: str, b: str) -> bool:
        """Strictly below."""
        return a in self.classes and b in self.supers(a)

    def is_a(self, a: str, b: str) -> bool:
        return a == b or self.is_subclass(a, b)

    def closure(self, iri: str) -> list[str]:
        """The class and all below it."""
        return [c for c in self.classes if self.is_a(c, iri)]

    def concrete(self, among: Iterable[str] | None = None) -> list[str]:
        return [c for c in (self.classes if among is None else among) if self.classes[c].rows is not None]

    def properties(self, iri: str) -> dict[str, PropertyDef]:
        """Own and inherited properties that are visible, inherited first."""
        out: dict[str, PropertyDef] = {}
        for c in [*reversed(self.supers(iri)), iri]:
            for p in self.classes[c].properties:
                out[p.iri] = p
        return {i: p for i, p in out.items() if i not in self.classes[iri].hidden}

    def domains(self, prop: str) -> list[str]:
        """Classes that declare the property."""
        return [i for i, c in self.classes.items() if any(p.iri == prop for p in c.properties)]

    def all_properties(self) -> dict[str, PropertyDef]:
        out: dict[str, PropertyDef] = {}
        for c in self.classes.values():
            for p in c.properties:
                out.setdefault(p.iri, p)
        return out

    def qname(self, iri: str) -> str:
        """``prefix:local`` of the namespace that fits, else the IRI in angle brackets."""
        ns, local = split_iri(iri)
        for p, n in self.namespaces.items():
            if n == ns and ns:
                return f"{p}:{local}"
        return f"<{iri}>"

    def expand(self, qname: str) -> str:
        prefix, _, local = qname.partition(":")
        if prefix not in self.namespaces:
            raise CatalogError(f"unknown prefix {prefix}:")
        return self.namespaces[prefix] + local

    # the schema as data

    def with_schema_pools(self) -> Catalog:
        """A catalog in which ``rdfs:Class`` and ``rdf:Property`` are classes with rows, built on the driver."""
        props = self.all_properties()
        crows = [
            (c.iri, self.supers(c.iri), [x for x in self.classes if self.is_subclass(x, c.iri)], c.comment or None, split_iri(c.iri)[0], self.size_of(c.iri), self.hash_of(c.iri))
            for c in self.classes.values()
        ]
        prows = [(p.iri, self.domains(p.iri), p.range, p.sub_property_of) for p in props.values()]
        cdf = lambda: self.spark.createDataFrame(crows, "id string, subClassOf array<string>, superClassOf array<string>, comment string, isDefinedBy string, sizeOf int, hashOf string")
        pdf = lambda: self.spark.createDataFrame(prows, "id string, domain array<string>, range string, subPropertyOf string")
        cp = (
            PropertyDef(RDFS + "subClassOf", CLASS, multi=True),
            PropertyDef(OBJ + "superClassOf", CLASS, multi=True),
            PropertyDef(RDFS + "comment", XSD + "string"),
            PropertyDef(RDFS + "isDefinedBy", XSD + "anyURI"),
            PropertyDef(OBJ + "sizeOf", XSD + "int"),
            PropertyDef(OBJ + "hashOf", XSD + "string"),
            PropertyDef(OBJ + "cardinality", XSD + "integer"),
        )
        pp = (PropertyDef(RDFS + "domain", CLASS, multi=True), PropertyDef(RDFS + "range", CLASS), PropertyDef(RDFS + "subPropertyOf", PROPERTY))
        return self.with_class(ClassDef(CLASS, None, cp, cdf)).with_class(ClassDef(PROPERTY, None, pp, pdf))

    def cardinalities(self) -> DataFrame:
        """``id, cardinality``: rows of each class's own pool, one aggregate per table."""
        parts = [c.table.agg(F.count("*").alias("cardinality")).select(F.lit(c.iri).alias("id"), "cardinality") for c in self.classes.values() if c.rows is not None]
        none = [(c.iri, 0) for c in self.classes.values() if c.rows is None]
        out = self.spark.createDataFrame(none, "id string, cardinality long")
        for p in parts:
            out = out.unionByName(p)
        return out

    def size_of(self, iri: str) -> int:
        """Number of columns of an instance."""
        return 1 + len(self.properties(iri))

    def hash_of(self, iri: str) -> str:
        """Stable hash of the class's shape."""
        import hashlib

        shape = ";".join(f"{p.iri}>{p.range}{'*' if p.multi else ''}" for p in self.properties(iri).values())
        return hashlib.md5(f"{iri}|{shape}".encode()).hexdigest()
