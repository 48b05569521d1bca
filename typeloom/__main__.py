"""Command line: parse schemas, validate documents, print a row type."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="typeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("parse", "compile a schema and list its components"), ("validate", "assess XML files against a schema"), ("gen", "print the Spark type of a global element")):
        c = sub.add_parser(name, help=text)
        c.add_argument("schema")
        if name == "validate":
            c.add_argument("documents", help="a path or pattern of files")
            c.add_argument("--out", help="a folder for the violations as Parquet; printed if absent")
        if name == "gen":
            c.add_argument("element", help="{namespace}name")
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.model import SchemaError
    from .plans.xsd import compile_schema, directory

    spark = SparkSession.builder.appName("typeloom").getOrCreate()
    root, name = os.path.split(os.path.abspath(args.schema))
    try:
        schema = compile_schema(name, directory(root))
    except SchemaError as e:
        print(e, file=sys.stderr)
        return 1
    if args.command == "parse":
        for kind, frame in schema.catalog(spark).items():
            for r in frame.collect():
                print(kind, *["" if v is None else v for v in r])
        return 0
    if args.command == "gen":
        from .sources.structs import schema_to_struct

        ns, _, local = args.element.rpartition("}")
        print(schema_to_struct(schema, (ns.lstrip("{"), local)).json())
        return 0
    from .operators.assess import Assessment, in_document_order
    from .sources.reports import rendered
    from .sources.xml_nodes import shred_files

    found = Assessment(schema).assess(shred_files(spark, args.documents))
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
        return 0
    lines = in_document_order(found).select(rendered(F.col("doc_id"), F.col("line"), F.col("column"), F.col("rule"), F.concat_ws(" ", "clause", "cause")).alias("text"))
    bad = 0
    for r in lines.toLocalIterator():
        bad = 1
        print(r.text)
    return bad


if __name__ == "__main__":
    sys.exit(main())
