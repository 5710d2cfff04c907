import dataclasses

import pytest
from pyspark.sql import functions as F

from ontoloom import store
from ontoloom.catalog import OBJ, XSD, Catalog, CatalogError, ClassDef, PropertyDef
from ontoloom.engine import Engine
from ontoloom.functions.xml import canonical_digest, signature_valid
from ontoloom.shop import shop
from ontoloom.sinks import writers
from tests.graphs import EX, catalog

EX_SHOP = "http://example.org/shop#"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_save_and_load(spark, tmp_path):
    cat = catalog(spark)
    store.save(cat, str(tmp_path))
    back = store.load(cat, str(tmp_path), read_only=True)
    for c in cat.concrete():
        assert rows(back.classes[c].table) == rows(cat.classes[c].table)
    with pytest.raises(CatalogError):
        Engine(back).update("INSERT DATA { ex:z a ex:A }")


def test_save_where_it_was_loaded_from(spark, sf, tmp_path):
    path = str(tmp_path / "s")
    first = shop(spark, sf)
    assert store.save(first, path) == 1
    names = lambda c: rows(Engine(c).query("SELECT ?x ?n WHERE { ?x a ex:Region ; ex:name ?n }"))
    for k in (2, 3, 4):
        e = Engine(store.load(first, path))
        e.update(f"INSERT DATA {{ ex:region_1 ex:name 'name {k}' }}")
        assert store.save(e.catalog, path) == k
        assert (EX_SHOP + "region_1", f"name {k}") in names(store.load(first, path))
    assert len(names(store.load(first, path))) == 5
    assert (EX_SHOP + "region_1", "name 3") in names(store.load(first, path, version=3))
    with pytest.raises(CatalogError):  # only the last two are kept
        store.load(first, path, version=1)


def test_a_failed_save_leaves_the_version_before(spark, tmp_path):
    cat = catalog(spark)
    store.save(cat, str(tmp_path))
    c = cat.classes[EX + "C"]
    bad = c.table.withColumn("n", F.raise_error(F.lit("lost")).cast(c.table.schema["n"].dataType))
    with pytest.raises(Exception, match="lost"):
        store.save(cat.with_tables({EX + "C": (bad, c.prefix)}), str(tmp_path))
    assert rows(store.load(cat, str(tmp_path)).classes[EX + "C"].table) == rows(c.table)
    with pytest.raises(CatalogError):
        store.load(cat, str(tmp_path / "nothing"))


def test_lookup_finds_the_class_that_has_the_row(spark, sf):
    e = Engine(catalog(spark))
    assert e.lookup(EX + "c1").first()["n"] == 7
    with pytest.raises(KeyError):
        e.lookup(EX + "nobody")
    assert Engine(shop(spark, sf)).lookup("http://example.org/shop#nation_3").count() == 1


def test_clone_and_rename(spark, sf):
    e = Engine(catalog(spark))
    e.clone(EX + "a1", EX + "copy")
    assert rows(e.query("SELECT ?s ?y WHERE { ex:copy ex:s ?s ; ex:link ?y }")) == [("x", EX + "a2")]
    e.rename(EX + "a1", EX + "first")
    assert rows(e.query("SELECT ?x WHERE { ?x ex:link ex:first }")) == [(EX + "c1",)]
    assert rows(e.query("SELECT ?x WHERE { ?x ex:many ex:first }")) == [(EX + x,) for x in ("a1", "b1", "b1", "copy")][1:] + [(EX + "first",)]
    with pytest.raises(CatalogError):
        e.clone(EX + "nobody", EX + "x")
    s = Engine(shop(spark, sf))
    s.rename("http://example.org/shop#nation_3", "http://example.org/shop#nation_333")
    n = s.query("SELECT ?c WHERE { ?c a ex:Customer ; ex:nation ex:nation_333 }").count()
    assert n == Engine(shop(spark, sf)).query("SELECT ?c WHERE { ?c a ex:Customer ; ex:nation ex:nation_3 }").count() > 0


def test_versions_keep_the_old_state(spark):
    item = EX + "Item"
    props = (PropertyDef(EX + "place", XSD + "string"), PropertyDef(OBJ + "prev", item), PropertyDef(OBJ + "next", item))
    table = spark.createDataFrame([(EX + "i1", "here", None, None), (EX + "i2", "there", None, None)], "id string, place string, prev string, next string")
    e = Engine(Catalog(spark).with_namespace("ex", EX).with_class(ClassDef(item, None, props, table, versioned=EX + "place")))
    e.update("INSERT DATA { ex:i1 ex:place 'moved' }")
    e.update("INSERT DATA { ex:i1 ex:place 'moved' }")  # no change, no version
    e.update("INSERT DATA { ex:i1 ex:place 'again' }")
    assert rows(e.query("SELECT ?p ?q WHERE { ex:i1 ex:place ?p ; obj:prev ?x . ?x ex:place ?q }")) == [("again", "moved")]
    assert rows(e.query("SELECT ?q WHERE { ex:i1 obj:prev ?x . ?x obj:prev ?y . ?y ex:place ?q ; obj:next ?n }")) == [("here",)]
    assert e.catalog.classes[item].table.count() == 4


def test_render_and_digests(spark):
    cat = catalog(spark)
    d = dataclasses.replace(cat.classes[EX + "C"], render=lambda df: df.select(F.concat(F.lit("n="), "n")))
    assert writers.rendered(cat.with_class(d), EX + "c1") == "n=7" and writers.rendered(cat.with_class(d), EX + "a1") is None
    a, b = canonical_digest("<a x='1' y='2'><b/></a>"), canonical_digest('<a  y="2" x="1"> <b></b></a>')
    assert a == b and canonical_digest("<a") is None and canonical_digest(None) is None
    df = spark.createDataFrame([("<a x='1' y='2'><b/></a>", a), ("<a", a), (None, a)], "t string, d string")
    assert [r[0] for r in df.select(signature_valid(F.col("t"), F.col("d"))).collect()] == [True, False, False]
