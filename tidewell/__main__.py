"""Command line: playlists of a folder, scanned, validated, rewritten.

    python -m tidewell validate PATH [--rules rfc8216|appleHLS|all] [--strict]
    python -m tidewell info PATH
    python -m tidewell regenerate PATH OUT
    python -m tidewell boxes PATH
    python -m tidewell cues PATH

validate ends with 2 if there is an error (with --strict, also a warning).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("validate", "info", "regenerate", "boxes", "cues"))
    parser.add_argument("path")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--rules", default="all", choices=("rfc8216", "appleHLS", "all"))
    parser.add_argument("--strict", action="store_true")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()

    from . import engine
    from .sources import binary, manifest, ttml

    if a.command == "boxes":
        binary.box_tree(binary.read_files(spark, a.path)).select("path", "box_path", "offset", "size").orderBy("path", "offset").show(1000, False)
        return 0
    docs = manifest.read_manifests(spark, a.path).withColumnRenamed("path", "doc_id")
    if a.command == "cues":
        ttml.cues(docs).orderBy("doc_id", "pos").show(1000, False)
        return 0
    if a.command == "regenerate":
        if not a.out:
            parser.error("regenerate needs OUT")
        engine.regenerate(docs).write.parquet(a.out)
        return 0
    if a.command == "info":
        tables = engine.parse(docs)
        tables["kinds"].join(
            tables["segments"].groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum("duration").alias("seconds")), "doc_id", "left"
        ).join(tables["variants"].groupBy("doc_id").agg(F.count("*").alias("variants")), "doc_id", "left").show(1000, False)
        return 0
    found = engine.validate(docs, a.rules)
    rows = found.groupBy("doc_id", "severity", "rule_id", "field", "message").count().orderBy("doc_id", F.desc("severity"), "rule_id")
    rows.show(1000, False)
    bad = ["error", "warning"] if a.strict else ["error"]
    return 2 if found.where(F.col("severity").isin(bad)).limit(1).count() else 0


if __name__ == "__main__":
    raise SystemExit(main())
