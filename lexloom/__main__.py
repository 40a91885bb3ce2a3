"""python -m lexloom VERB ...: normalize, query, index, evaluate, export, validate, init. Exit 0: done, 1: faults found, 2: bad input."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lexloom.engine import Engine
from lexloom.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("normalize", "index"):
        p = verbs.add_parser(verb)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--kind")
        p.add_argument("--pattern", default="*")
    p = verbs.add_parser("query")
    p.add_argument("text")
    p = verbs.add_parser("evaluate")
    p.add_argument("tables", help="folder with documents.parquet and benchmark.parquet")
    p = verbs.add_parser("export")
    p.add_argument("what", choices=["skos", "synonyms", "manifest"])
    p.add_argument("output")
    verbs.add_parser("validate")
    p = verbs.add_parser("init")
    p.add_argument("folder")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lexloom").getOrCreate()
    try:
        if given.verb in ("normalize", "index"):
            engine = Engine(spark, files.scan(spark, given.input, given.pattern, given.output, given.kind))
            if given.verb == "normalize":
                files.write_jsonl(engine.normalize(), given.output, ["doc_id", "seg_no"])
            else:
                engine.index(given.output)
        elif given.verb == "query":
            table = Engine(spark, files.inline(spark, given.text)).normalize()
            for row in table.select(files.canonical_json(table).alias("x")).toLocalIterator():
                print(row.x)
        elif given.verb == "evaluate":
            engine = Engine(spark, spark.read.parquet(f"{given.tables}/documents.parquet"), benchmark=spark.read.parquet(f"{given.tables}/benchmark.parquet"))
            engine.run("e_ablation_summary").show(truncate=False)
        elif given.verb == "export":
            Engine(spark).export(given.what, given.output)
        elif given.verb == "validate":
            faults = Engine(spark).violations().collect()
            for f in faults:
                print(f"{f.rule}: {f.n}")
            return int(bool(faults))
        elif given.verb == "init":
            spark.createDataFrame([], "request_id string, occurrence string, attempt int").write.mode("errorifexists").parquet(f"{given.folder}/requests")
            spark.createDataFrame([], "request_id string, state string").write.mode("errorifexists").parquet(f"{given.folder}/decisions")
    except (files.ContractError, PySparkException) as error:
        print(f"lexloom: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
