"""Graph patterns to DataFrames.

Patterns are grouped by subject into stars. A star is one scan per candidate class (the classes are found from
types, property domains and the ranges of properties that lead to the subject), united by name; stars are joined
on shared variables. Resources travel as native keys of their class family and become IRIs only in the result or
where families mix, so joins hash small keys and filters reach the scans.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.catalog import CLASS, ID, LITERALS, OBJ, PROPERTY, RDFS, SELF, TYPE, XSD, Catalog, ClassDef, PropertyDef
from ontoloom.functions.lexical import lexical
from ontoloom.plans.terms import Blank, Count, Describe, Filter, Iri, Lit, Select, Term, Triple, Var

DOMAIN, RANGE, SUBCLASS, SUBPROPERTY = RDFS + "domain", RDFS + "range", RDFS + "subClassOf", RDFS + "subPropertyOf"
CARDINALITY = OBJ + "cardinality"

#: Fixed values of joins that multiply rows: rows of a side that share a key and meet the other side's in one task,
#: rows that a task makes, and result rows for each row that is joined from which on the join is spread.
BLOCK, TASK_ROWS, FAN = 1000, 8_000_000, 10


@dataclass(frozen=True)
class Binding:
    """What a variable's column holds: a resource (key after ``prefix``), a literal, or text of either (mixed)."""

    kind: str  # res, lit, mixed
    prefix: str = ""
    classes: frozenset[str] = frozenset()
    type: T.DataType = field(default_factory=T.StringType)
    format: object = None


@dataclass
class Solution:
    """Rows with one column ``v_<name>`` per variable."""

    df: DataFrame
    bindings: dict[str, Binding]
    unique: frozenset[str] | None = None  # variables by which all rows differ, if known


def col_of(name: str) -> str:
    return f"v_{name}"


def iri_of(c: Column, b: Binding) -> Column:
    return F.concat(F.lit(b.prefix), c.cast("string")) if b.kind == "res" and b.prefix else c.cast("string")


def text_of(c: Column, b: Binding) -> Column:
    """Text of any binding: the IRI or the lexical form."""
    if b.kind == "lit":
        return b.format(c) if b.format else lexical(c, b.type)
    return iri_of(c, b)


def key_value(iri: str, c: ClassDef) -> int | str | None:
    """The key of an IRI in the table of ``c``; None if it cannot be one of its instances."""
    if not iri.startswith(c.prefix):
        return None
    rest = iri[len(c.prefix) :]
    if isinstance(c.table.schema["id"].dataType, T.IntegralType):
        return int(rest) if rest.lstrip("-").isdigit() and str(int(rest)) == rest and abs(int(rest)) < 2**63 else None
    return rest


def key_of(iri: str, c: ClassDef) -> Column | None:
    """``key_value`` as a column of the key's type."""
    key = key_value(iri, c)
    return None if key is None else F.lit(key).cast(c.table.schema["id"].dataType)


def _entry(name: str, b: Binding):
    return lambda x: F.struct(F.lit(name).alias("p"), text_of(x, b).alias("o"), F.lit(b.kind == "res").alias("r"))


class Planner:
    """Plans statements against one catalog version."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog if CLASS in catalog.classes else catalog.with_schema_pools()
        self.spark = catalog.spark

    # class inference

    def link_prefix(self, range_iri: str) -> tuple[str, frozenset[str]]:
        """Key prefix and classes of the targets of a link property."""
        if range_iri not in self.catalog.classes:
            return "", frozenset()
        targets = self.catalog.concrete(self.catalog.closure(range_iri))
        prefixes = {self.catalog.classes[c].prefix for c in targets}
        return (prefixes.pop() if len(prefixes) == 1 else ""), frozenset(targets)

    def candidates(self, s: Term, own: list[Triple], triples: list[Triple]) -> list[str]:
        """Concrete classes whose instances can match the star of ``s``."""
        cat = self.catalog
        preds = {t.p.value for t in own if isinstance(t.p, Iri)}
        pools = cat.concrete()
        user = [c for c in pools if c not in (CLASS, PROPERTY)]
        # schema pools answer only where the pattern speaks of the schema
        if preds & {DOMAIN, RANGE, SUBPROPERTY} or any(t.p == Iri(TYPE) and t.o == Iri(PROPERTY) for t in own):
            out = [PROPERTY]
        elif preds & {SUBCLASS, CARDINALITY, OBJ + "superClassOf", OBJ + "sizeOf", OBJ + "hashOf"} or any(t.p == Iri(TYPE) and t.o == Iri(CLASS) for t in own):
            out = [CLASS]
        elif self._is_schema_var(s, triples):
            out = [c for c in (CLASS, PROPERTY) if preds <= set(cat.properties(c)) | {TYPE, SELF, ID}]
        else:
            out = user
        for t in own:
            if isinstance(t.p, Iri):
                if t.p.value == TYPE and isinstance(t.o, Iri):
                    out = [c for c in out if t.o.value in cat.classes and (cat.is_a(c, t.o.value))]
                elif t.p.value not in (TYPE, SELF, ID):
                    out = [c for c in out if t.p.value in cat.properties(c)]
        if isinstance(s, (Var, Blank)):
            for t in triples:
                if t.o == s and isinstance(t.p, Iri) and t.p.value not in (TYPE, SELF, ID, DOMAIN, RANGE, SUBCLASS):
                    ranges = {p.range for c in pools for p in [cat.properties(c).get(t.p.value)] if p is not None}
                    reach = {x for r in ranges if r in cat.classes for x in cat.closure(r)}
                    out = [c for c in out if c in reach]
        iri = self._fixed(s)
        if iri is not None:
            out = [c for c in out if key_of(iri, cat.classes[c]) is not None]
        return out

    @staticmethod
    def _is_schema_var(s: Term, triples: list[Triple]) -> bool:
        """True if the variable is bound as a class or a property elsewhere."""
        return isinstance(s, Var) and any((t.p == s) or (t.o == s and t.p in (Iri(TYPE), Iri(DOMAIN), Iri(RANGE), Iri(SUBCLASS))) for t in triples)

    @staticmethod
    def _fixed(s: Term) -> str | None:
        if isinstance(s, Iri):
            return s.value
        return "_:" + s.name if isinstance(s, Blank) and not s.anonymous else None

    # scans

    def table(self, c: ClassDef, need: set[str]) -> DataFrame:
        df = c.table
        if c.iri == CLASS and CARDINALITY in need:
            df = df.join(self.catalog.cardinalities(), "id")
        return df

    def value(self, p: PropertyDef, c: ClassDef) -> Column:
        if p.computed is not None:
            return p.computed()
        return F.col(f"`{p.name}`")

    def present(self, p: PropertyDef, v: Column) -> Column | None:
        """When a value makes a triple; numbers always do."""
        if not p.is_literal:
            return v.isNotNull()
        kind, default = LITERALS[p.range]
        if default is not None:
            return None
        return (v.isNotNull() & (v != "")) if isinstance(kind, T.StringType) else v.isNotNull()

    def binding(self, p: PropertyDef, field_type: T.DataType | None = None) -> Binding:
        if p.is_literal:
            return Binding("lit", type=field_type or LITERALS[p.range][0], format=p.format)
        prefix, classes = self.link_prefix(p.range)
        return Binding("res", prefix, classes)

    def text(self, p: PropertyDef, v: Column, b: Binding) -> Column:
        return text_of(v, b)

    def scan(self, s: Term, own: list[Triple], cls: str) -> Solution | None:
        """Rows of one class that match the star."""
        cat = self.catalog
        c = cat.classes[cls]
        props = cat.properties(cls)
        df = self.table(c, {t.p.value for t in own if isinstance(t.p, Iri)})
        binds: dict[str, Binding] = {}
        own_b = Binding("res", c.prefix, frozenset([cls]))
        columns: dict[str, Column] = {}

        iri = self._fixed(s)
        if iri is not None:
            df = df.filter(F.col("id") == key_of(iri, c))

        def bind(name: str, value: Column, b: Binding) -> None:
            """Bind a variable, or require it to equal what it is bound to."""
            nonlocal df
            if name in columns:
                df = df.filter(self._same(columns[name], binds[name], value, b))
            else:
                columns[name], binds[name] = value, b

        if isinstance(s, Var):
            bind(s.name, F.col("id"), own_b)
        elif isinstance(s, Blank) and s.anonymous:
            bind(" " + s.name, F.col("id"), own_b)
        n = 0
        for t in own:
            if isinstance(t.p, Var):
                n += 1
                df = df.withColumn(f"__po{n}", F.explode(self.entries(c)))
                p, o, r = (F.col(f"__po{n}.{k}") for k in "por")
                bind(t.p.name, p, Binding("res", "", frozenset([PROPERTY])))
                if isinstance(t.o, Var):
                    bind(t.o.name, o, Binding("mixed"))
                elif isinstance(t.o, Lit):
                    df = df.filter((o == t.o.value) & ~r)
                elif isinstance(t.o, Blank) and t.o.anonymous:
                    bind(" " + t.o.name, o, Binding("mixed"))
                else:
                    df = df.filter((o == self._fixed(t.o)) & r)
                continue
            name = t.p.value
            if name == TYPE:
                if isinstance(t.o, Var):
                    bind(t.o.name, F.lit(cls), Binding("res", "", frozenset([CLASS])))
                elif not isinstance(t.o, Iri):
                    return None
                continue
            if name == SELF:
                if isinstance(t.o, Var):
                    bind(t.o.name, F.col("id"), own_b)
                elif self._fixed(t.o) is not None and key_of(self._fixed(t.o), c) is not None:
                    df = df.filter(F.col("id") == key_of(self._fixed(t.o), c))
                else:
                    return None
                continue
            if name == ID:
                text = iri_of(F.col("id"), own_b)
                if isinstance(t.o, Var):
                    bind(t.o.name, text, Binding("lit"))
                elif isinstance(t.o, Lit):
                    df = df.filter(text == t.o.value)
                else:
                    return None
                continue
            p = props[name]
            b = self.binding(p)
            if name in (DOMAIN, RANGE, SUBCLASS) and isinstance(t.o, Iri):
                match = [t.o.value, *cat.supers(t.o.value)] if name == DOMAIN and t.o.value in cat.classes else cat.closure(t.o.value) if t.o.value in cat.classes else [t.o.value]
                stored = self.value(p, c)
                df = df.filter(F.arrays_overlap(stored, F.array(*map(F.lit, match))) if p.multi else stored.isin(*match))
                continue
            if p.inverse is not None:
                n += 1
                df = df.join(p.inverse().select(F.col("owner").alias("id"), F.col("value").alias(f"__x{n}")), "id")
                v = F.col(f"__x{n}")
            elif p.multi:
                n += 1
                df = df.withColumn(f"__x{n}", F.explode(self.value(p, c)))
                v = F.col(f"__x{n}")
            else:
                v = self.value(p, c)
            if name == SUBPROPERTY and isinstance(t.o, Var):
                bind(t.o.name, v, b)  # the one property that binds nothing instead of failing
                continue
            here = self.present(p, v)
            if here is not None:
                df = df.filter(here)
            if isinstance(t.o, Var) or (isinstance(t.o, Blank) and t.o.anonymous):
                key = t.o.name if isinstance(t.o, Var) else " " + t.o.name
                if b.kind == "lit":
                    kind = df.select(v.alias("x")).schema["x"].dataType
                    b = replace(b, type=kind)
                bind(key, v, b)
            elif isinstance(t.o, Lit):
                if b.kind != "lit":
                    return None
                df = df.filter(self.equals_text(v, p, t.o))
            else:
                if b.kind == "lit":
                    if p.range != XSD + "anyURI":
                        return None
                    df = df.filter(v == self._fixed(t.o))
                    continue
                target = self._target_key(self._fixed(t.o), b)
                if target is None:
                    return None
                df = df.filter(v == target)
        several = any(isinstance(t.p, Var) or ((p := props.get(t.p.value)) is not None and (p.multi or p.inverse is not None)) for t in own)
        subject = frozenset([s.name] if isinstance(s, Var) else [" " + s.name] if iri is None else [])
        return Solution(df.select(*[x.alias(col_of(k)) for k, x in columns.items()]) if columns else df.select(F.lit(1).alias("v_")), binds, None if several else subject)

    def _target_key(self, iri: str, b: Binding) -> Column | None:
        if not b.prefix:
            return F.lit(iri)
        keys = [key_of(iri, self.catalog.classes[c]) for c in b.classes]
        return next((k for k in keys if k is not None), None)

    def equals_text(self, v: Column, p: PropertyDef, o: Lit) -> Column:
        """Equality of the lexical form; whole numbers compare as numbers so that the scan can use the filter."""
        kind = LITERALS[p.range][0]
        if p.format is not None:
            return p.format(v) == o.value
        if isinstance(kind, T.StringType):
            return v == o.value
        if isinstance(kind, T.IntegralType):
            try:
                n = int(o.value)
            except ValueError:
                return F.lit(False)
            return (v == F.lit(n)) if str(n) == o.value and abs(n) < 2**63 else F.lit(False)
        if isinstance(kind, T.BooleanType):
            return v if o.value in ("1",) else ~v if o.value == "0" else F.lit(False)
        return lexical(v, kind) == o.value

    def entries(self, c: ClassDef, system: bool = True) -> Column:
        """All (property, text, is-resource) of a row as one array, absent values left out."""
        one = lambda p, o, r: F.array(F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(r).alias("r")))
        iri = iri_of(F.col("id"), Binding("res", c.prefix))
        parts = [one(TYPE, F.lit(c.iri), True)]
        if system:
            parts += [one(SELF, iri, True), one(ID, iri, False)]
        for name, p in self.catalog.properties(c.iri).items():
            if name == CARDINALITY or p.inverse is not None:
                continue
            b = self.binding(p)
            v = self.value(p, c)
            if p.multi:
                parts.append(F.coalesce(F.transform(v, _entry(name, b)), F.array().cast("array<struct<p:string,o:string,r:boolean>>")))
            else:
                parts.append(one(name, text_of(v, b), b.kind == "res"))
        return F.filter(F.concat(*parts), lambda x: x["o"].isNotNull() & (x["o"] != ""))

    # joins

    def _sides(self, a: Column, x: Binding, b: Column, y: Binding) -> tuple[Column, Column] | None:
        """What has to be equal for two values to be the same; None if they never are."""
        if x.kind == y.kind == "res":
            return (a, b) if x.prefix == y.prefix else (iri_of(a, x), iri_of(b, y))
        if x.kind == y.kind == "lit":
            if type(x.type) is type(y.type):
                return a, b
            if isinstance(x.type, T.NumericType) and isinstance(y.type, T.NumericType):
                return a.cast("double"), b.cast("double")
        if {x.kind, y.kind} == {"res", "lit"}:
            return None
        return text_of(a, x), text_of(b, y)

    def _same(self, a: Column, x: Binding, b: Column, y: Binding) -> Column:
        sides = self._sides(a, x, b, y)
        return F.lit(False) if sides is None else sides[0] == sides[1]

    def unite(self, parts: list[Solution]) -> Solution:
        """Union of the scans of several classes; variables that differ in kind become text."""
        names = list(parts[0].bindings)
        if not names:
            return Solution(reduce(DataFrame.unionByName, [p.df for p in parts]), {}, parts[0].unique)
        out: dict[str, Binding] = {}
        for n in names:
            bs = [p.bindings[n] for p in parts]
            classes = frozenset().union(*(b.classes for b in bs))
            if all(b.kind == "res" for b in bs):
                same = {b.prefix for b in bs}
                out[n] = replace(bs[0], prefix=bs[0].prefix if len(same) == 1 else "", classes=classes)
            elif all(b.kind == "lit" and b.type == bs[0].type and b.format is bs[0].format for b in bs):
                out[n] = bs[0]
            else:
                out[n] = Binding("mixed", classes=classes)
        frames = []
        for p in parts:
            cols = []
            for n in names:
                b, c = p.bindings[n], F.col(f"`{col_of(n)}`")
                want = out[n]
                if want.kind == "mixed" and b.kind != "mixed":
                    c = text_of(c, b)
                elif want.kind == "res" and want.prefix != b.prefix:
                    c = iri_of(c, b)
                cols.append(c.alias(col_of(n)))
            frames.append(p.df.select(*cols))
        return Solution(reduce(DataFrame.unionByName, frames), out, None if any(p.unique is None for p in parts) else parts[0].unique)

    def join(self, a: Solution, b: Solution, shown: Collection[str] = ()) -> Solution:
        """All pairs of rows that agree; ``shown``: variables of which only the result is wanted after this."""
        shared = [n for n in a.bindings if n in b.bindings]
        both = None if a.unique is None or b.unique is None else a.unique | b.unique
        right = b.df
        for n in shared:
            right = right.withColumnRenamed(col_of(n), "r_" + col_of(n))
        if not shared:
            return Solution(a.df.drop("v_").crossJoin(right.drop("v_")) if a.bindings and b.bindings else self._only(a, b), a.bindings | b.bindings, both)
        few = [x.unique is not None and x.unique <= set(shared) for x in (a, b)]
        if not any(few) and (spread := self._spread(a, b, shared, shown)) is not None:
            return replace(spread, unique=both)
        on = [self._same(F.col(f"`{col_of(n)}`"), a.bindings[n], F.col(f"`r_{col_of(n)}`"), b.bindings[n]) for n in shared]
        df = a.df.join(right, reduce(lambda x, y: x & y, on)).drop(*("r_" + col_of(n) for n in shared))
        return Solution(df, b.bindings | a.bindings, a.unique if few[1] else b.unique if few[0] else both)

    def _spread(self, a: Solution, b: Solution, shared: list[str], shown: Collection[str]) -> Solution | None:
        """The join of sides that both have many rows of a key, in tasks of about the same number of result rows; None
        if a count proves that the ordinary join makes few.

        The rows of a key are cut into blocks by hash, and every pair of blocks is a key of its own. IRIs of variables
        that are only shown are built before the rows are multiplied.
        """
        sides = [self._sides(F.col(f"`{col_of(n)}`"), a.bindings[n], F.col(f"`{col_of(n)}`"), b.bindings[n]) for n in shared]
        if None in sides:
            return None
        ka, kb = ([f"__{x}{i}" for i in range(len(sides))] for x in "ab")
        left = a.df.select("*", *[x.alias(k) for (x, _), k in zip(sides, ka)])
        right = b.df.select("*", *[y.alias(k) for (_, y), k in zip(sides, kb)])
        kinds = [(left.schema[i].dataType, right.schema[j].dataType) for i, j in zip(ka, kb)]
        if not all(i == j or (isinstance(i, T.IntegralType) and isinstance(j, T.IntegralType)) for i, j in kinds):
            return None
        equal = reduce(lambda x, y: x & y, [F.col(i) == F.col(j) for i, j in zip(ka, kb)])
        count = F.count(F.lit(1))
        counts = left.groupBy(*ka).agg(count.alias("__na")).join(right.groupBy(*kb).agg(count.alias("__nb")), equal)
        product = F.col("__na").cast("double") * F.col("__nb")
        rows, most, joined = counts.agg(F.sum(product), F.max(product), F.sum(F.col("__na") + F.col("__nb"))).first()
        if (rows or 0) <= TASK_ROWS or (most <= BLOCK * BLOCK and rows <= FAN * joined):
            return None

        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(rows / TASK_ROWS) + 1)
        blocks = lambda n: F.ceil(F.col(n) / BLOCK)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))

        def cut(df: DataFrame, s: Solution, keys: list[str], n: str, other: str, names: list[str]) -> DataFrame:
            """Each row in its block, once for every block of the other side."""
            own = F.pmod(F.xxhash64(*[f"`{c}`" for c in s.df.columns]), blocks(n))
            df = df.join(counts.select(*keys, "__na", "__nb"), keys).select(*[F.col(f"`{col_of(v)}`") for v in names], *keys, own.alias(f"_{n}"), every(other).alias(f"_{other}"))
            df = df.repartition(tasks, *keys, "___na", "___nb")
            return df.withColumns({col_of(v): iri_of(F.col(f"`{col_of(v)}`"), s.bindings[v]) for v in names if v in texts})

        bindings = b.bindings | a.bindings
        texts = {v for v in shown if v in bindings and bindings[v].kind == "res" and bindings[v].prefix}
        left = cut(left, a, ka, "__na", "__nb", list(a.bindings))
        right = cut(right, b, kb, "__nb", "__na", [v for v in b.bindings if v not in a.bindings])
        right = right.withColumnsRenamed({"___na": "___ra", "___nb": "___rb"})
        df = left.join(right.hint("merge"), equal & (F.col("___na") == F.col("___ra")) & (F.col("___nb") == F.col("___rb")))
        df = df.select(*[f"`{col_of(v)}`" for v in bindings])
        return Solution(df, {v: replace(x, prefix="") if v in texts else x for v, x in bindings.items()})

    @staticmethod
    def _only(a: Solution, b: Solution) -> DataFrame:
        """A star without variables keeps or empties the other, once per match."""
        left, right = (a, b) if a.bindings else (b, a)
        return left.df.crossJoin(right.df.drop("v_").select())

    def solve(self, triples: list[Triple], filters: list[Filter], variables: list[str], shown: Collection[str] = ()) -> Solution:
        """All solutions of a pattern, as a bag; resources among ``shown`` may come as IRIs already."""
        stars: dict[Term, list[Triple]] = {}
        for t in triples:
            stars.setdefault(t.s, []).append(t)
        solved: list[Solution] = []
        for s, own in stars.items():
            parts = [x for c in self.candidates(s, own, triples) if (x := self.scan(s, own, c)) is not None]
            if not parts:
                return self.empty(variables)
            solved.append(self.unite(parts) if len(parts) > 1 else parts[0])
        out = solved.pop(0) if solved else Solution(self.spark.range(1).select(F.lit(1).alias("v_")), {})
        while solved:
            k = next((i for i, x in enumerate(solved) if set(x.bindings) & set(out.bindings)), 0)
            b = solved.pop(k)
            out = self.join(out, b, () if solved else shown)
        for f in filters:
            out = Solution(out.df.filter(self.condition(f, out)), out.bindings)
        return out

    def empty(self, variables: list[str]) -> Solution:
        schema = T.StructType([T.StructField(col_of(v), T.StringType()) for v in variables])
        return Solution(self.spark.createDataFrame([], schema), {v: Binding("mixed") for v in variables})

    def condition(self, f: Filter, s: Solution) -> Column:
        """A comparison: numbers as numbers if either side is one, else texts."""

        def side(t: Term) -> tuple[Column, Binding]:
            if isinstance(t, Var):
                if t.name not in s.bindings:
                    return F.lit(None).cast("string"), Binding("mixed")
                return F.col(f"`{col_of(t.name)}`"), s.bindings[t.name]
            if isinstance(t, Lit) and t.number:
                n = float(t.value)
                return (F.lit(int(t.value)) if t.value.lstrip("+-").isdigit() else F.lit(n)), Binding("lit", type=T.DoubleType())
            if isinstance(t, Lit):
                return F.lit(t.value), Binding("lit")
            return F.lit(self._fixed(t)), Binding("res")

        (a, x), (b, y) = side(f.left), side(f.right)
        num = lambda z: z.kind == "lit" and isinstance(z.type, T.NumericType)
        if num(x) or num(y):
            a, b = (c if num(z) else text_of(c, z).try_cast("double") for c, z in ((a, x), (b, y)))
        elif not (x.kind == y.kind == "lit" and type(x.type) is type(y.type)):
            if x.kind == "lit" and isinstance(x.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                b = text_of(b, y).try_cast(x.type)
            elif y.kind == "lit" and isinstance(y.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                a = text_of(a, x).try_cast(y.type)
            else:
                a, b = text_of(a, x), text_of(b, y)
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[f.op]

    # statements

    def result(self, c: Column, b: Binding) -> Column:
        if b.kind == "lit":
            return b.format(c) if b.format else c
        return iri_of(c, b)

    def order_keys(self, name: str, s: Solution, ascending: bool) -> list[Column]:
        """Literals before resources; resources by namespace rank and local name, literals by value."""
        if name not in s.bindings:
            return []
        c, b = F.col(f"`{col_of(name)}`"), s.bindings[name]
        if b.kind == "lit":
            keys = [c]
        else:
            iri = iri_of(c, b)
            ns = F.regexp_extract(iri, "^([^#]*#)", 1)
            rank = F.lit(len(self.catalog.namespaces))
            for i, n in reversed(list(enumerate(self.catalog.namespaces.values()))):
                rank = F.when(ns == n, i).otherwise(rank)
            local = F.when(ns == "", iri).otherwise(F.substring(iri, F.length(ns) + 1, F.lit(1_000_000)))
            keys = [iri.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|_:)"), rank, local] if b.kind == "mixed" else [rank, local]
        return [k.asc() if ascending else k.desc() for k in keys]

    def select(self, q: Select, default_limit: int | None = None) -> DataFrame:
        items = [Var(v) for v in q.variables] if q.items is None else q.items
        counts = [i for i in items if isinstance(i, Count)]
        s = self.solve(q.where, q.filters, q.variables, [] if counts else [i.name for i in items])
        if counts:
            groups = [i.name for i in items if isinstance(i, Var) and i.name in s.bindings]
            aggs = [(F.count(F.col(f"`{col_of(c.var)}`")) if c.var in s.bindings else F.lit(0).cast("long")).alias(col_of(c.alias)) for c in counts]
            df = s.df.groupBy(*[f"`{col_of(g)}`" for g in groups]).agg(*aggs)
            s = Solution(df, {g: s.bindings[g] for g in groups} | {c.alias: Binding("lit", type=T.LongType()) for c in counts})
            items = [Var(i.alias) if isinstance(i, Count) else i for i in items]
        df = s.df
        keys = [k for name, up in q.order for k in self.order_keys(name, s, up)]
        if keys:
            df = df.orderBy(*keys)
        limit = q.limit if q.limit is not None else default_limit
        if q.offset:
            df = df.offset(q.offset)
        if limit is not None:
            df = df.limit(limit)
        shown = list(dict.fromkeys(i.name for i in items if i.name in s.bindings))
        return df.select(*[self.result(F.col(f"`{col_of(n)}`"), s.bindings[n]).alias(n) for n in shown])

    def describe_class(self, c: ClassDef, rows: DataFrame) -> DataFrame:
        iri = iri_of(F.col("id"), Binding("res", c.prefix))
        return rows.select(iri.alias("s"), F.inline(self.entries(c, system=False))).select("s", "p", "o", F.col("r").alias("is_resource"))

    def describe(self, q: Describe) -> DataFrame:
        """``s, p, o, is_resource`` of the resources; every one once."""
        cat = self.catalog
        none = self.spark.createDataFrame([], "s string, p string, o string, is_resource boolean")
        if q.iri is not None:
            parts = []
            for c in cat.concrete():
                key = key_of(q.iri.value, cat.classes[c])
                if key is not None:
                    parts.append(self.describe_class(cat.classes[c], cat.classes[c].table.filter(F.col("id") == key)))
            return reduce(DataFrame.unionByName, parts, none)
        s = self.solve(q.select.where, q.select.filters, q.select.variables)
        names = q.select.variables if q.names is None else q.names
        parts = []
        ids: dict[tuple[str, frozenset], list[DataFrame]] = {}
        for n in names:
            if n not in s.bindings or s.bindings[n].kind == "lit":
                continue
            b = s.bindings[n]
            classes = b.classes if b.kind == "res" and b.classes else frozenset(cat.concrete())
            for c in classes:
                d = cat.classes[c]
                key = F.col(f"`{col_of(n)}`") if b.kind == "res" and b.prefix == d.prefix else iri_of(F.col(f"`{col_of(n)}`"), b)
                ids.setdefault((c, frozenset([b.kind == "res" and b.prefix == d.prefix])), []).append(s.df.select(key.alias("k")))
        for (c, native), frames in ids.items():
            d = cat.classes[c]
            keys = reduce(DataFrame.unionByName, frames).distinct()
            own = F.col("id") if True in native else iri_of(F.col("id"), Binding("res", d.prefix))
            parts.append(self.describe_class(d, d.table.join(keys, own == F.col("k"), "left_semi")))
        out = reduce(DataFrame.unionByName, parts, none)
        return out.distinct() if len(names) > 1 else out
