"""Command line: index, search, stats, reset, reindex; bench list and run."""

from __future__ import annotations

import argparse
import json
import sys

from .config import IndexConfig, split_extensions
from .operators.enrich import NOTHING_FOUND
from .plans.pipeline import Indexer
from .session import build_session, let_workers_import
from .sources.scan import scan


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkseek", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "stats", "reset", "reindex"):
        sub = commands.add_parser(name)
        if name == "search":
            sub.add_argument("query", nargs="?", help="without one, queries are read line by line until exit, quit or an empty line")
            sub.add_argument("--top-k", type=int, default=5)
        sub.add_argument("--dir", default=".")
        sub.add_argument("--index-dir")
        sub.add_argument("--collection")
        sub.add_argument("--extensions", default=".ts,.tsx")
    commands.add_parser("list")
    run = commands.add_parser("run")
    for part in ("corpus", "queries", "qrels"):
        run.add_argument(part, help="JSON lines or parquet")
    run.add_argument("--max-corpus", type=int)
    run.add_argument("--max-queries", type=int)
    run.add_argument("--out", help="folder for the result as JSON")
    run.add_argument("--name", default="", help="name of the dataset in the result")
    run.add_argument("--split", help="split of the judgements, where they are parquet")
    run.add_argument("--cache-dir", help="folder that keeps embeddings for the next run")
    args = parser.parse_args(argv)
    spark = build_session()
    let_workers_import(spark)
    if args.command == "list":
        from .sources.dataset import registry

        registry(spark).show(truncate=False)
        return 0
    if args.command == "run":
        from .embed.hashing import HashingProvider
        from .operators.store import VectorStore
        from .plans.evaluation import evaluate
        from .sources.dataset import load, read_rows

        data = load(*[read_rows(spark, getattr(args, part), part, args.split if part == "qrels" else None) for part in ("corpus", "queries", "qrels")], args.max_corpus, args.max_queries)
        provider = HashingProvider(256)
        cache = VectorStore(spark, args.cache_dir, provider.dim, provider.model) if args.cache_dir else None
        result = evaluate(data, provider, cache, args.name).cache()
        if args.out:
            result.coalesce(1).write.mode("overwrite").json(args.out)
        result.show(vertical=True)
        return 0
    config = IndexConfig.from_environment(root_dir=args.dir, index_dir=args.index_dir or f"{args.dir}/.cache/index", collection=args.collection, extensions=split_extensions(args.extensions))
    indexer = Indexer(spark, config)
    if args.command in ("index", "reindex"):
        print(json.dumps(getattr(indexer, args.command)(progress=lambda stage, counts: print(stage, json.dumps(counts), file=sys.stderr))))
    elif args.command == "stats":
        print(json.dumps(indexer.stats()))
    elif args.command == "reset":
        indexer.reset()
    else:
        files = scan(spark, config.root_dir, config.extensions, config.skip_dirs)

        def ask(text: str) -> None:
            hits = indexer.search_enriched(spark.createDataFrame([("q", text)], "query_id string, text string"), files, args.top_k)
            found = hits.orderBy("rank", "file_path", "start_line").collect()  # the k hits of one query
            if not found:
                print(NOTHING_FOUND)
            for r in found:
                print(f"--- #{r['rank']} {r['file_path']}:{r['start_line']}-{r['end_line']} (score: {r['score']:.3f}) {'[' + r['symbol_name'] + '] ' if r['symbol_name'] else ''}---\n{r['content']}\n")

        if args.query:
            ask(args.query)
        else:
            while (line := input("query> ").strip()) not in ("", "exit", "quit"):
                ask(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
