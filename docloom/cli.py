"""Command line for spark-submit or python -m docloom.cli."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from docloom.config import load_config
from docloom.operators.cleaning import load_rules
from docloom.plans import answer as answers
from docloom.plans import ingest
from docloom.plans.store import Index
from docloom.sources.files import read_documents


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("chunk", "print a folder's or file's chunks as JSON"), ("md", "write a folder's documents as markdown"), ("ingest", "index markdown files"), ("index", "index any files"), ("process", "md, then ingest")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("path")
        if name != "chunk":
            s.add_argument("out")
        if name == "process":
            s.add_argument("index")
    q = sub.add_parser("query", help="answer a question from an index")
    q.add_argument("index")
    q.add_argument("question")
    q.add_argument("-k", type=int, default=5)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    if args.command == "chunk":
        rules = load_rules(config.clean_rules) if config.clean_rules else None
        rows = ingest.chunk_files(read_documents(spark, args.path), config.chunk_size, config.chunk_overlap, rules)
        for line in rows.toJSON().toLocalIterator():
            print(line)
        return 0
    if args.command in ("md", "process"):
        ingest.write_markdown(ingest.to_markdown(read_documents(spark, args.path).where("status = 'ok'"), config), args.out)
    if args.command in ("ingest", "process"):
        files = read_documents(spark, args.out if args.command == "process" else args.path, ["md", "mkd", "markdown"])
        Index(spark, args.index if args.command == "process" else args.out, config.embedding_dim).replace(*ingest.ingest_markdown(files, config))
    if args.command == "index":
        for r in ingest.ingest_folder(spark, args.path, Index(spark, args.out, config.embedding_dim), config).toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    if args.command == "query":
        index = Index(spark, args.index, config.embedding_dim)
        asked = spark.createDataFrame([(0, args.question)], "query_id bigint, question string")
        r = answers.answer(asked, index.chunks, index.documents, args.k, config=config).first()
        print(r["answer"])
        print("Sources: " + ", ".join(r["sources"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
