"""A catalog's tables in a folder: a table per class and version in the format of the class, opened for reading or for updates."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import SparkSession

from ontoloom.catalog import Catalog, CatalogError, split_iri


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of a folder, and a maker of paths below it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *x: make("/".join([path.rstrip("/"), *x]))


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _folder(spark, path)
    if not fs.exists(at("versions")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at("versions"))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _read(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    fs, at = _folder(spark, path)
    stream = fs.open(at("versions", f"{version:08d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def save(catalog: Catalog, path: str, keep: int = 2) -> int:
    """Write every class table but the volatile ones below ``path`` as the next version and return its number.

    Tables go to new folders; the version counts once all are whole and its list of tables is renamed into place, so
    a save that fails leaves the version before as it was, and a catalog that was loaded from this folder can be
    saved to it. Of two saves at once one is refused. The last ``keep`` versions are kept (at least the two that a
    reader can be at); tables of older ones are deleted.
    """
    spark = catalog.spark
    fs, at = _folder(spark, path)
    number = max(_versions(spark, path), default=0) + 1
    tag = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    tables = {c: f"{split_iri(c)[1]}/{tag}" for c in catalog.concrete() if catalog.classes[c].storage != "volatile"}
    for c, folder in tables.items():
        catalog.classes[c].table.write.format(catalog.classes[c].storage).save(f"{path}/{folder}")
    draft = at("versions", f".{tag}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    if fs.exists(at("versions", f"{number:08d}.json")) or not fs.rename(draft, at("versions", f"{number:08d}.json")):
        raise CatalogError(f"version {number} of {path} was saved by another")
    for old in _versions(spark, path)[: -max(2, keep)]:
        for folder in _read(spark, path, old).values():
            fs.delete(at(folder), True)
        fs.delete(at("versions", f"{old:08d}.json"), False)
    return number


def load(catalog: Catalog, path: str, read_only: bool = False, version: int | None = None) -> Catalog:
    """The catalog with the tables of a version, by default the last; updates of a read-only class are refused or passed over."""
    spark = catalog.spark
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        raise CatalogError(f"no such version in {path}")
    tables = _read(spark, path, known[-1] if version is None else version)
    for c in catalog.concrete():
        if c in tables:
            d = catalog.classes[c]
            rows = spark.read.schema(d.table.schema).format(d.storage).load(f"{path}/{tables[c]}")
            catalog = catalog.with_class(dataclasses.replace(d, rows=rows, read_only=read_only or d.read_only))
    return catalog
