"""Updates: solutions to template triples, triples to new class tables, all or nothing."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.catalog import BY_UPDATE, ID, PROVENANCE, SELF, TYPE, Catalog, CatalogError, ClassDef, PropertyDef
from ontoloom.functions.lexical import parse_prefix
from ontoloom.plans.planner import Binding, Planner, Solution, col_of, iri_of, key_of, key_value, text_of
from ontoloom.plans.terms import Blank, Change, Iri, Lit, Term, Triple, Var
from ontoloom.session import materialize

TRIPLES = "s string, p string, o string, r boolean, n long"
#: Versions of a table that may pile up as a plan before it is written out.
CUT_AFTER = 8


@dataclass
class _Created:
    iri: str
    cls: str


def _default(p: PropertyDef, kind: T.DataType) -> Column:
    if p.multi:
        return F.array().cast(kind)
    return F.lit(p.default).cast(kind)


def _ground(t: Term, names: dict[str, str]) -> tuple[str, bool]:
    if isinstance(t, Lit):
        return t.value, False
    if isinstance(t, Blank):
        return names.get(t.name, "_:" + t.name), True
    return t.value, True


class Updater:
    """Applies changes to one catalog and gives the next."""

    def __init__(self, catalog: Catalog, provenance: int = BY_UPDATE) -> None:
        self.catalog = catalog
        self.provenance = provenance
        self.made: list[_Created] = []

    # which class a subject belongs to

    def existing(self, iris: list[str], classes: list[str] | None = None) -> dict[str, str]:
        """The class that has an instance of each IRI, for those that exist: one job for all of them and all classes."""
        parts = []
        for place, c in enumerate(self.catalog.concrete() if classes is None else classes):
            d = self.catalog.classes[c]
            kind = d.table.schema["id"].dataType
            wanted = [(x, k) for x in iris if (k := key_value(x, d)) is not None]
            if wanted:  # no more than the text of a statement names
                keys = self.catalog.spark.createDataFrame(wanted, T.StructType([T.StructField("iri", T.StringType()), T.StructField("k", T.LongType() if isinstance(kind, T.IntegralType) else T.StringType())]))
                parts.append(d.table.select("id").join(F.broadcast(keys.select("iri", F.col("k").cast(kind).alias("id"))), "id").select(F.lit(place).alias("place"), F.lit(c).alias("cls"), "iri").distinct())
        if not parts:
            return {}
        found = reduce(DataFrame.unionByName, parts).groupBy("iri").agg(F.min(F.struct("place", "cls"))["cls"].alias("cls")).collect()
        return {r.iri: r.cls for r in found}

    def _exists(self, iri: str) -> str | None:
        return self.existing([iri]).get(iri)

    def _named(self, triples: list[Triple]) -> dict[str, str]:
        """IRIs of the new blank nodes of a statement: a digest of the version and the place."""
        out = {}
        for t in triples:
            for x in (t.s, t.o):
                if isinstance(x, Blank) and x.anonymous and x.name not in out:
                    seed = f"{self.catalog.version}/{len(self.made)}/{x.name}/{len(out)}"
                    out[x.name] = "_:" + hashlib.md5(seed.encode()).hexdigest()[:16]
        return out

    def _create(self, triples: list[Triple], names: dict[str, str]) -> None:
        """New rows for unknown subjects that name their class, and for bracketed nodes."""
        types: dict[str, str] = {}
        subjects: list[str] = []
        met: set[str] = set()
        for t in triples:
            if isinstance(t.s, Var):
                continue
            s = _ground(t.s, names)[0]
            if s not in met:
                met.add(s)
                subjects.append(s)
            if isinstance(t.p, Iri) and t.p.value == TYPE and isinstance(t.o, Iri):
                types[s] = t.o.value
        for t in triples:  # a bracketed object is of its property's range
            if isinstance(t.o, Blank) and t.o.anonymous and isinstance(t.p, Iri):
                p = self.catalog.all_properties().get(t.p.value)
                if p is not None and not p.is_literal:
                    types.setdefault(names[t.o.name], p.range)
        for n, name in list(names.items()):  # in a class with keys a bracketed node gets a key
            c = self.catalog.classes.get(types.get(name, ""))
            if c is not None and c.prefix:
                names[n] = self._free(c, name)
                types[names[n]] = types.pop(name)
                subjects = [names[n] if x == name else x for x in subjects]
        rows: dict[str, list[str]] = {}
        subjects += [names[n] for n in names if names[n] not in subjects]
        there = self.existing(subjects)
        for s in subjects:
            if s in there:
                continue
            if s not in types:
                raise CatalogError(f"{s} does not exist and names no class")
            cls = types[s]
            if cls not in self.catalog.classes:
                raise CatalogError(f"unknown class {cls}")
            rows.setdefault(cls, []).append(s)
            self.made.append(_Created(s, cls))
        for cls, iris in rows.items():
            self._append(cls, iris)

    def _free(self, c: ClassDef, name: str) -> str:
        """An IRI of the class that no row has: keys are digests of the name, as wide as the class's keys."""
        kind = c.table.schema["id"].dataType
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind), 62)
        for k in range(64):
            iri = c.prefix + str(int(hashlib.md5(f"{name}/{k}".encode()).hexdigest(), 16) % (1 << bits))
            if not self.existing([iri], [c.iri]):
                return iri
        raise CatalogError(f"no free key in {c.iri}")

    def _append(self, cls: str, iris: list[str]) -> None:
        c = self.catalog.class_def(cls)
        props = self.catalog.properties(cls)
        if c.read_only:
            raise CatalogError(f"{cls} is read-only")
        if c.rows is None:
            schema = T.StructType([T.StructField("id", T.StringType())] + [T.StructField(p.name, p.type_of(T.StringType())) for p in props.values() if p.computed is None and p.inverse is None])
            c = ClassDef(c.iri, c.extends, c.properties, self.catalog.spark.createDataFrame([], schema), "", c.comment, c.read_only, c.hidden)
            self.catalog = self.catalog.with_tables({cls: (c.table, "")})
        kind = c.table.schema["id"].dataType
        keys = []
        for i in iris:
            if key_of(i, c) is None:
                raise CatalogError(f"{i} cannot be an instance of {cls}: its names are {c.prefix} and a key")
            rest = i[len(c.prefix) :]
            keys.append(int(rest) if isinstance(kind, T.IntegralType) else rest)
        by_name = {p.name: p for p in props.values()}
        new = self.catalog.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("id", kind)]))
        cols = [F.col("id") if f.name == "id" else _default(by_name[f.name], f.dataType).alias(f.name) for f in c.table.schema]
        self.catalog = self.catalog.with_tables({cls: (c.table.unionByName(new.select(*cols)), c.prefix)})

    # triples

    def _instantiate(self, template: list[Triple], names: dict[str, str], s: Solution | None) -> DataFrame:
        """The template's triples for every solution, in order."""
        spark = self.catalog.spark
        if s is None:
            rows = [(_ground(t.s, names)[0], t.p.value, *_ground(t.o, names), n) for n, t in enumerate(template)]
            return spark.createDataFrame(rows, TRIPLES)

        def term(t: Term) -> tuple[Column, Column]:
            if isinstance(t, Var):
                if t.name not in s.bindings:
                    raise CatalogError(f"?{t.name} is not bound")
                b = s.bindings[t.name]
                c = F.col(f"`{col_of(t.name)}`")
                is_res = F.lit(b.kind == "res") if b.kind != "mixed" else c.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|_:)")
                return text_of(c, b), is_res
            text, r = _ground(t, names)
            return F.lit(text), F.lit(r)

        parts = []
        for n, t in enumerate(template):
            (o, r) = term(t.o)
            parts.append(s.df.select(term(t.s)[0].alias("s"), term(t.p)[0].alias("p"), o.alias("o"), r.alias("r"), F.lit(n).cast("long").alias("n")))
        return reduce(DataFrame.unionByName, parts)

    def _apply(self, triples: DataFrame, template: list[Triple], insert: bool, classes: list[str]) -> None:
        """Change the tables by a batch of triples."""
        cat = self.catalog
        named = {t.p.value for t in template if isinstance(t.p, Iri)}
        any_prop = any(isinstance(t.p, Var) for t in template)
        event = "insert" if insert else "delete"
        for (name, when), hook in cat.triggers.items():
            if when == event and (any_prop or name in named):
                own = hook(triples.filter(F.col("p") == name).select("s", "p", "o", "r", "n"))
                triples = triples.filter(F.col("p") != name).unionByName(own.select("s", "p", "o", "r", "n"))
        tables: dict[str, tuple[DataFrame, str]] = {}
        for c in classes:
            d = cat.classes[c]
            mine = {i: p for i, p in cat.properties(c).items() if (any_prop or i in named) and i not in (TYPE, SELF, ID) and not p.const and p.computed is None and p.inverse is None}
            if not mine or d.read_only or d.rows is None:
                continue
            tables[c] = (self._changed(d, mine, triples, insert), d.prefix)
        self.catalog = cat.with_tables(tables)

    def _targets(self, p: PropertyDef) -> DataFrame:
        """IRIs that a link property may point to."""
        parts = []
        for c in self.catalog.concrete(self.catalog.closure(p.range) if p.range in self.catalog.classes else None):
            d = self.catalog.classes[c]
            parts.append(d.table.select(iri_of(F.col("id"), Binding("res", d.prefix)).alias("o")))
        if not parts:
            return self.catalog.spark.createDataFrame([], "o string")
        return reduce(DataFrame.unionByName, parts)

    def _changed(self, d: ClassDef, props: dict[str, PropertyDef], triples: DataFrame, insert: bool) -> DataFrame:
        """The class table after the batch; a link to nothing and a value of the wrong kind are left out."""
        planner = Planner(self.catalog)
        own = triples.filter(F.col("p").isin(*props) & F.col("s").startswith(d.prefix))
        kinds = F.create_map(*[x for i, p in props.items() for x in (F.lit(i), F.lit(not p.is_literal))])
        own = own.filter(kinds[F.col("p")] == F.col("r"))
        if insert:
            literal = [i for i, p in props.items() if p.is_literal]
            parts = [own.filter(F.col("p").isin(*literal))] if literal else []
            for i, p in props.items():
                if not p.is_literal:
                    parts.append(own.filter(F.col("p") == i).join(self._targets(p), "o", "left_semi").select(*own.columns))
            own = reduce(DataFrame.unionByName, parts)
        id_type = d.table.schema["id"].dataType
        key = F.substring(F.col("s"), len(d.prefix) + 1, 1_000_000).try_cast(id_type)
        aggs = []
        for k, (i, p) in enumerate(props.items()):
            hit = F.when(F.col("p") == i, F.struct("n", "o"))
            aggs.append((F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["o"]) if p.multi or not insert else F.max(hit)["o"]).alias(f"__d{k}"))
        delta = own.groupBy(key.alias("__id")).agg(*aggs).filter(F.col("__id").isNotNull())
        joined = d.table.join(delta, F.col("id") == F.col("__id"), "left")
        out = {f.name: F.col(f"`{f.name}`") for f in d.table.schema}
        for k, (i, p) in enumerate(props.items()):
            old, new = out[p.name], F.col(f"__d{k}")
            kind = d.table.schema[p.name].dataType
            one = kind.elementType if p.multi else kind
            b = planner.binding(p, one)
            read = self._reader(p, b, one)
            if insert:
                out[p.name] = F.when(F.size(new) > 0, F.concat(F.coalesce(old, F.array().cast(kind)), F.transform(new, read))).otherwise(old) if p.multi else F.when(new.isNotNull(), read(new)).otherwise(old)
            elif p.multi:
                out[p.name] = F.when(F.size(new) > 0, F.aggregate(new, old, _dropper(b))).otherwise(old)
            else:
                out[p.name] = F.when(F.array_contains(new, text_of(old, b)), _default(p, kind)).otherwise(old)
        mark = self.catalog.properties(d.iri).get(PROVENANCE)
        if mark is not None and mark.name in out:
            out[mark.name] = F.when(F.col("__id").isNotNull(), F.lit(self.provenance)).otherwise(out[mark.name]).cast(d.table.schema[mark.name].dataType)
        if d.versioned in props:
            return self._versions(d, props[d.versioned].name, joined, out)
        return joined.select(*[c.alias(n) for n, c in out.items()])

    def _versions(self, d: ClassDef, changed: str, joined: DataFrame, out: dict[str, Column]) -> DataFrame:
        """Changed rows twice: the new state, whose ``prev`` is a copy of the old state, whose ``next`` is the row."""
        names = list(out)
        if "prev" not in names or "next" not in names or d.prefix:
            raise CatalogError(f"{d.iri} is versioned but has no prev and next, or has native keys")
        copy = F.concat(F.lit("_:v"), F.hex(F.xxhash64(F.lit(self.catalog.version), *[F.col(f"`{n}`") for n in names])))
        new = F.struct(*[(copy if n == "prev" else out[n]).alias(n) for n in names])
        old = F.struct(*[(copy if n == "id" else F.col("id") if n == "next" else F.col(f"`{n}`")).alias(n) for n in names])
        plain = F.struct(*[out[n].alias(n) for n in names])
        is_new = ~out[changed].eqNullSafe(F.col(f"`{changed}`"))
        return joined.select(F.inline(F.when(is_new, F.array(new, old)).otherwise(F.array(plain))))

    def _reader(self, p: PropertyDef, b: Binding, kind: T.DataType):
        return lambda x: self._read(x, p, b, kind)

    @staticmethod
    def _read(x: Column, p: PropertyDef, b: Binding, kind: T.DataType) -> Column:
        if p.is_literal:
            return p.parse(x).cast(kind) if p.parse else parse_prefix(x, kind)
        return F.substring(x, len(b.prefix) + 1, 1_000_000).cast(kind)

    def _classes(self, template: list[Triple], names: dict[str, str], s: Solution | None) -> list[str]:
        """Classes whose instances the template's subjects can be."""
        out: set[str] = set()
        pools = self.catalog.concrete()
        for t in template:
            if isinstance(t.s, Var):
                b = s.bindings[t.s.name]
                out |= set(b.classes) or set(pools)
            else:
                iri = _ground(t.s, names)[0]
                out |= {c for c in pools if key_of(iri, self.catalog.classes[c]) is not None}
        return [c for c in pools if c in out]

    # statements

    def run(self, changes: list[Change]) -> None:
        for c in changes:
            s = None
            if c.where is not None:
                s = Planner(self.catalog).solve(c.where.where, c.where.filters, c.where.variables)
            for template, insert in ((c.delete, False), (c.insert, True)):
                if not template:
                    continue
                names = self._named(template)
                for t in template:
                    if isinstance(t.p, Iri) and insert is False and t.p.value == TYPE:
                        continue
                if insert:
                    self._create(template, names)
                triples = self._instantiate(template, names, s)
                self._apply(triples, template, insert, self._classes(template, names, s))


def clone(catalog: Catalog, iri: str, new: str) -> Catalog:
    """A copy of a resource under another IRI, in the same class."""
    u = Updater(catalog)
    cls = u._exists(iri)
    if cls is None or u._exists(new) is not None:
        raise CatalogError(f"{iri} does not exist, or {new} does")
    d = catalog.classes[cls]
    key, to = key_of(iri, d), key_of(new, d)
    if to is None:
        raise CatalogError(f"{new} cannot be an instance of {cls}")
    row = d.table.filter(F.col("id") == key).select(*[(to.cast(f.dataType) if f.name == "id" else F.col(f"`{f.name}`")).alias(f.name) for f in d.table.schema])
    return catalog.with_tables({cls: (d.table.unionByName(row), d.prefix)})


def rename(catalog: Catalog, iri: str, new: str) -> Catalog:
    """A resource under another IRI, with every link that led to it."""
    u = Updater(catalog)
    cls = u._exists(iri)
    if cls is None or u._exists(new) is not None:
        raise CatalogError(f"{iri} does not exist, or {new} does")
    d = catalog.classes[cls]
    if key_of(new, d) is None:
        raise CatalogError(f"{new} cannot be an instance of {cls}")
    planner = Planner(catalog)
    tables = {}
    for c in catalog.concrete():
        e = catalog.classes[c]
        cols = {f.name: F.col(f"`{f.name}`") for f in e.table.schema}
        if c == cls:
            cols["id"] = F.when(F.col("id") == key_of(iri, d), key_of(new, d)).otherwise(F.col("id")).cast(e.table.schema["id"].dataType)
        for p in catalog.properties(c).values():
            if p.is_literal or p.computed is not None or p.inverse is not None or not catalog.is_a(cls, p.range):
                continue
            prefix = planner.link_prefix(p.range)[0]
            old, to = (key_of(x, d) if prefix else F.lit(x) for x in (iri, new))
            cols[p.name] = _moved(cols[p.name], p.multi, old, to).cast(e.table.schema[p.name].dataType)
        tables[c] = (e.table.select(*[x.alias(n) for n, x in cols.items()]), e.prefix)
    return catalog.with_tables(tables)


def _moved(c: Column, multi: bool, old: Column, new: Column) -> Column:
    return F.transform(c, lambda x: F.when(x == old, new).otherwise(x)) if multi else F.when(c == old, new).otherwise(c)


def _without(a: Column, at: Column) -> Column:
    """An array without the item at position ``at`` (from 1)."""
    return F.filter(a, lambda x, i: i + 1 != at)


def _dropper(b: Binding):
    """Removes the first item of an array whose text is the given one."""

    def drop(a: Column, o: Column) -> Column:
        at = F.array_position(F.transform(a, lambda x: text_of(x, b)), o)
        return F.when(at > 0, _without(a, at)).otherwise(a)

    return drop


def apply_changes(catalog: Catalog, changes: list[Change]) -> tuple[Catalog, list[str]]:
    """The catalog after the changes and the IRIs created; the given catalog stays as it is.

    Reads see the version before the statement that they belong to. Every ``CUT_AFTER`` versions changed tables
    are written to the shared folder, so plans do not grow without end.
    """
    u = Updater(catalog)
    u.run(changes)
    return settled(catalog, u.catalog), [m.iri for m in u.made]


def settled(before: Catalog, out: Catalog) -> Catalog:
    """``out`` with the tables that changed since ``before`` written to the shared folder, every ``CUT_AFTER`` versions."""
    if out.version // CUT_AFTER > before.version // CUT_AFTER:
        changed = {c: (materialize(d.table, "class"), d.prefix) for c, d in out.classes.items() if d.rows is not None and (c not in before.classes or d.rows is not before.classes[c].rows)}
        version = out.version
        out = out.with_tables(changed)
        out.version = version
    return out
