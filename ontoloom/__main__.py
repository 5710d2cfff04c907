"""``python -m ontoloom VERB FOLDER``: dump, schema, query (text from standard input), load FILES, serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ontoloom.engine import Engine
from ontoloom.server import answer, serve
from ontoloom.shop import shop
from ontoloom.sinks import writers
from ontoloom.sources import rdf


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="ontoloom", description=__doc__)
    a.add_argument("verb", choices=["dump", "schema", "query", "load", "serve"])
    a.add_argument("folder", help="folder of the Parquet tables")
    a.add_argument("--files", help="RDF/XML or Turtle files to load first")
    a.add_argument("--format", default="rdfxml", choices=["rdfxml", "turtle"])
    a.add_argument("--csv", action="store_true")
    a.add_argument("--port", type=int, default=1080)
    x = a.parse_args(argv)
    spark = SparkSession.builder.appName("ontoloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = shop(spark, x.folder)
    if x.files:
        loaded = rdf.load(catalog, x.files, x.format)
        catalog = loaded.catalog
        if x.verb == "load":
            print(f"rejected triples: {loaded.rejected.count()}")
    engine = Engine(catalog)
    if x.verb == "dump":
        for line in writers.rdf_xml(catalog):
            print(line)
    elif x.verb == "schema":
        print(writers.schema_rdf_xml(catalog))
    elif x.verb == "query":
        print(answer(engine, sys.stdin.read(), "csv" if x.csv else "xml")[1])
    elif x.verb == "serve":
        serve(engine, x.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
