"""python -m lokalens --source FILE_OR_GLOB [--source ...] --langs de,fr [--out DIR] [--pattern P] [--glossary A,B] [--strict] [--json] [--sarif PATH]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import paths as A
from .plans import projects as R
from .plans.check import verdict
from .plans.files import check_files, config, report, result_json
from .sources import sinks
from .sources.decode import texts
from .staging import staged


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lokalens", description="Check translations against their source.")
    p.add_argument("--source", action="append")
    for name in ("--langs", "--out", "--pattern", "--glossary", "--source-lang", "--config", "--sarif"):
        p.add_argument(name)
    for name in ("--strict", "--json"):
        p.add_argument(name, action="store_true")
    a = p.parse_args(args)
    text = open(a.config, encoding="utf-8").read() if a.config else None
    split = lambda x: [t.strip() for t in x.split(",") if t.strip()] if x is not None else None
    c = config(text, source=a.source, langs=split(a.langs), out=a.out, keep=split(a.glossary), source_lang=a.source_lang)
    spark = SparkSession.builder.appName("lokalens").getOrCreate()
    try:
        found, project = check_files(spark, c["source"], c["langs"], c["out"] if a.out or a.config else "", c["source_lang"], a.pattern, c["keep"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    found = staged(found, "findings")
    for r in project.problems.toLocalIterator():
        print(f"{r['lang']}: {r['path']}: {r['error']} — treated as missing", file=sys.stderr)
    failed = verdict(found, project.files, a.strict).where("NOT ok").select("file").distinct()
    if a.sarif:
        root = R.working_folder(spark)
        placed = found.withColumn("path", F.when(F.col("kind") == "missing_file", F.col("file")).otherwise(F.col("path")))
        named = found.where("kind NOT IN ('missing', 'missing_file')").select("path").distinct()
        lines = sinks.key_lines(texts(R.listed(spark, R._globs(named), "content").join(named, "path", "left_semi")).where("error IS NULL")) if not named.isEmpty() else None
        results = sinks.sarif_results(placed, lines).withColumn("uri", A.relative(F.col("uri"), F.lit(root)))
        sinks.write_whole(a.sarif, sinks.sarif_document(results))
    if a.json:
        bad = {r["file"] for r in failed.toLocalIterator()}
        files = [r["file"] for r in project.files.select("file").distinct().orderBy("file").toLocalIterator()]
        for i, file in enumerate(files):  # one result is one line; of several files an object of results
            head = f"{'{' if i == 0 else ', '}{json.dumps(file, ensure_ascii=False)}: " if len(files) > 1 else ""
            print(head, end="")
            for part in result_json(found.where(F.col("file") == file) if len(files) > 1 else found, file not in bad):
                print(part, end="")
        print("}" if len(files) > 1 else "")
    else:
        for line in report(found, project):
            print(line)
    return 0 if failed.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
