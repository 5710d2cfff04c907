"""The engine: query and update text against a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ontoloom.catalog import Catalog
from ontoloom.plans.parser import parse
from ontoloom.plans.planner import Planner, key_of
from ontoloom.plans.terms import Describe, Select
from ontoloom.plans.update import Updater, apply_changes, clone, rename, settled


class Engine:
    """Holds the current catalog version; ``update`` replaces it only when the whole text succeeds."""

    def __init__(self, catalog: Catalog, default_limit: int | None = None) -> None:
        self.catalog = catalog
        self.default_limit = default_limit

    def query(self, text: str) -> DataFrame:
        """Rows of a SELECT (a column per variable) or DESCRIBE (``s, p, o, is_resource``)."""
        q = parse(text, self.catalog.namespaces, self.catalog.base)
        planner = Planner(self.catalog)
        if isinstance(q, Select):
            return planner.select(q, self.default_limit)
        if isinstance(q, Describe):
            return planner.describe(q)
        raise ValueError("this is an update; use update()")

    def update(self, text: str) -> list[str]:
        """Apply a change; returns the IRIs of the resources that it created."""
        q = parse(text, self.catalog.namespaces, self.catalog.base)
        if isinstance(q, (Select, Describe)):
            raise ValueError("this is a query; use query()")
        self.catalog, made = apply_changes(self.catalog, q)
        return made

    def describe(self, iri: str) -> DataFrame:
        return self.query(f"DESCRIBE <{iri}>")

    def clone(self, iri: str, new: str) -> None:
        """Copy a resource under another IRI."""
        self.catalog = clone(self.catalog, iri, new)

    def rename(self, iri: str, new: str) -> None:
        """Change a resource's IRI, and every link to it."""
        self.catalog = rename(self.catalog, iri, new)

    def load(self, triples: DataFrame) -> DataFrame:
        """Merge triples (``src, n, s, p, o, r``) as one version; returns those that were not used, with the reason."""
        from ontoloom.sources.rdf import load_triples

        loaded = load_triples(self.catalog, triples)
        self.catalog = settled(self.catalog, loaded.catalog)
        return loaded.rejected

    def lookup(self, iri: str, cls: str | None = None) -> DataFrame:
        """The row of a resource, as its class stores it; of the given class or the one that has it."""
        found = Updater(self.catalog).existing([iri], self.catalog.concrete([cls] if cls else None)).get(iri)
        if found is None:
            raise KeyError(iri)
        d = self.catalog.classes[found]
        return d.table.filter(d.table["id"] == key_of(iri, d))
