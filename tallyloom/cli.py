"""Command line over a deployment: python -m tallyloom.cli --root DIR --instance NAME [--app MODULE] COMMAND ...

An app module holds what a specification cannot: extractors() and, for commands that read sources, sources().

  schema get                                print the schema as YAML, its revision on stderr
  schema update --path F --revision N       put a schema in place of revision N
  query --path F                            run a query specification, print tab-separated rows
  sync [--running F] [--apply F] [--yes]    print which streams to start and stop; --apply writes the new list, on a terminal after a question
  backfill specify --name X --starts F      print tasks, one JSON a line (--max-age 6h: recent files only)
  backfill load --name X --id N --path F    run tasks; a second load of the same job is ignored
  backfill map --path F --out D             write the tasks' partial aggregates as key and value text
  backfill combine --in D... --out D        merge such text to one row a key
  backfill merge --name X --id N --in D...  merge such text into the views (--sketches exact); a second merge of the same job is ignored
  ingest --view V [--source S] --checkpoint D
                                            bring a view up to date with a source's stream, or with all that its relation selects, then stop
  publish --quotes F --out D [--begin N] [--end N]
                                            write numbered quotes (author TAB text lines) as JSON lines for a source to read
  vacuum                                    drop expired rows, orphaned views and unreferenced files
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.plans import backfill
from tallyloom.plans.catalog import Catalog, Config
from tallyloom.plans.reconcile import Stream, reconcile, wanted
from tallyloom.plans.store import ViewStore
from tallyloom.sources.registry import Source
from tallyloom.sources.tsv import read_quotes, rows_as_tsv
from tallyloom.streaming.ingest import maintain
from tallyloom.types import QuerySpec, SchemaSpec, dumps, loads, parse_duration


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", required=True)
    p.add_argument("--instance", required=True)
    p.add_argument("--app")
    p.add_argument("--sketches", default="sketch", choices=("sketch", "exact"))
    p.add_argument("--max-rows", type=int)
    commands = p.add_subparsers(dest="command", required=True)
    schema = commands.add_parser("schema").add_subparsers(dest="action", required=True)
    schema.add_parser("get")
    update = schema.add_parser("update")
    update.add_argument("--path", required=True)
    update.add_argument("--revision", type=int, required=True)
    commands.add_parser("query").add_argument("--path", required=True)
    sync = commands.add_parser("sync")
    sync.add_argument("--running")
    sync.add_argument("--apply")
    sync.add_argument("--yes", action="store_true")
    fill = commands.add_parser("backfill").add_subparsers(dest="action", required=True)
    specify = fill.add_parser("specify")
    specify.add_argument("--name", required=True)
    specify.add_argument("--starts", required=True)
    specify.add_argument("--max-age")
    load = fill.add_parser("load")
    load.add_argument("--name", required=True)
    load.add_argument("--id", type=int, default=0)
    load.add_argument("--path", required=True)
    pairs = fill.add_parser("map")
    pairs.add_argument("--path", required=True)
    pairs.add_argument("--out", required=True)
    both = fill.add_parser("combine")
    both.add_argument("--in", dest="paths", nargs="+", required=True)
    both.add_argument("--out", required=True)
    join = fill.add_parser("merge")
    join.add_argument("--name", required=True)
    join.add_argument("--id", type=int, default=0)
    join.add_argument("--in", dest="paths", nargs="+", required=True)
    publish = commands.add_parser("publish")
    publish.add_argument("--quotes", required=True)
    publish.add_argument("--out", required=True)
    publish.add_argument("--begin", type=int, default=0)
    publish.add_argument("--end", type=int)
    ingest = commands.add_parser("ingest")
    for x in ("--view", "--checkpoint"):
        ingest.add_argument(x, required=True)
    ingest.add_argument("--source")
    ingest.add_argument("--continues", action="store_true")
    commands.add_parser("vacuum")
    return p


def _log_rejected(spark: SparkSession, read: list[tuple[Source, list[str]]]) -> None:
    """How many lines of what is about to be read will be dropped, with a first one to look at."""
    for source, paths in read:
        row = source.rejected(spark, paths).agg(F.count("*").alias("n"), F.min("line").alias("line")).first()
        if row["n"]:
            print(f"source={source.name} dropped lines={row['n']} such as {row['line'][:80]!r}", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    app = importlib.import_module(args.app) if args.app else None
    config = Config(args.root, args.instance, args.max_rows, args.sketches)
    catalog = Catalog(spark, config, app.extractors() if app else None)
    text = lambda path: Path(path).read_text(encoding="utf-8")

    if args.command == "schema" and args.action == "get":
        revision, spec = catalog.get()
        print(f"revision {revision}", file=sys.stderr)
        out.write(dumps(spec))
    elif args.command == "schema":
        print(catalog.update(loads(SchemaSpec, text(args.path)), args.instance, args.revision), file=out)
    else:
        schema = catalog.schema()
        store = ViewStore(spark, f"{config.root}/views", schema, config.sketches)
        if args.command == "query":
            for line in rows_as_tsv(store.query(loads(QuerySpec, text(args.path)), max_rows=config.max_rows)):
                print(line, file=out)
        elif args.command == "sync":
            running = [Stream(**x) for x in json.loads(text(args.running))] if args.running else []
            out.write(str(reconcile(schema, app.sources(), args.instance, running)))
            if args.apply and (args.yes or not sys.stdin.isatty() or input("apply? [y/N] ").strip().lower() in ("y", "yes")):
                Path(args.apply).write_text(json.dumps([dataclasses.asdict(s) for s in wanted(schema, app.sources(), args.instance)]))
        elif args.command == "backfill" and args.action == "specify":
            starts = {(schema.view(x["view"]).tag, x["source"]): float(x["until"]) for x in json.loads(text(args.starts))}
            out.write(backfill.dumps(backfill.specify(spark, schema, app.sources(), starts, max_age=parse_duration(args.max_age) if args.max_age else None)))
        elif args.command == "backfill" and args.action == "map":
            tasks = backfill.loads(text(args.path))
            _log_rejected(spark, [(app.sources()[t.source], list(t.paths)) for t in tasks])
            backfill.map_tasks(spark, schema, app.sources(), tasks, args.out)
        elif args.command == "backfill" and args.action == "combine":
            backfill.combine(spark, schema, args.paths, args.out)
        elif args.command == "backfill":
            if args.action == "merge":
                done = backfill.load(store, args.paths, args.name, args.id)
            else:
                tasks = backfill.loads(text(args.path))
                _log_rejected(spark, [(app.sources()[t.source], list(t.paths)) for t in tasks])
                done = backfill.run(store, app.sources(), tasks, args.name, args.id)
            for view, merged in done.items():
                print(f"view={view} {'loaded' if merged else 'ignored'}", file=out)
        elif args.command == "publish":
            quotes = read_quotes(spark, args.quotes, args.begin, args.end)
            quotes.select("id", "author", "text", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")).write.mode("append").json(args.out)
        elif args.command == "ingest":
            view = schema.view(args.view)
            found = [app.sources()[args.source]] if args.source else app.sources().select(schema.relation(view.relation).selector)
            for source in found:
                checkpoint = args.checkpoint if args.source else f"{args.checkpoint}/{source.name}"
                maintain(source.stream(spark), store, [view.tag], checkpoint, continues=args.continues or len(found) > 1).awaitTermination()
        elif args.command == "vacuum":
            store.vacuum()
    return 0


if __name__ == "__main__":
    sys.exit(main())
