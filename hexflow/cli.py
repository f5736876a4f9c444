"""Command line: ``python -m hexflow.cli version | info | generate | datasets | cluster | serve``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="hexflow")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("info")
    make = sub.add_parser("generate", help="players and events below a folder")
    make.add_argument("folder")
    for name, kind in (("n_players", int), ("n_days", int), ("start", str), ("noise", float), ("seed", int)):
        make.add_argument("--" + name.replace("_", "-"), dest=name, type=kind)
    make.add_argument("--partitions", type=int, default=8)
    data = sub.add_parser("datasets", help="ranking datasets of the events in a folder of tables")
    data.add_argument("tables")
    data.add_argument("folder")
    data.add_argument("--start", required=True)
    data.add_argument("--cutoff", required=True)
    group = sub.add_parser("cluster", help="clusters and their metrics of a feature matrix")
    group.add_argument("matrix")
    group.add_argument("folder")
    group.add_argument("--label", default="archetype")
    group.add_argument("--min-cluster-size", type=int, default=500)
    serve = sub.add_parser("serve", help="HTTP front of a serving folder")
    serve.add_argument("folder")
    serve.add_argument("--port", type=int, default=8000)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "info":
        from hexflow.config import generation
        from hexflow.plans import registry

        print(json.dumps({"version": VERSION, "queries": len(registry.QUERIES), "generator": asdict(generation())}, sort_keys=True))
        return 0
    from hexflow.session import build_session

    spark = build_session(f"hexflow {args.command}")
    if args.command == "generate":
        from hexflow import sinks
        from hexflow.config import generation
        from hexflow.sources import synthetic

        settings = generation({k: getattr(args, k) for k in ("n_players", "n_days", "start", "noise", "seed")})
        people = synthetic.players(spark, settings)
        sinks.write_players(people, f"{args.folder}/players")
        synthetic.write_events(synthetic.events(spark, people, settings), f"{args.folder}/events", args.partitions)
        print(json.dumps(asdict(settings) | sinks.written_summary(spark, f"{args.folder}/events").first().asDict(), sort_keys=True))
    elif args.command == "datasets":
        from hexflow import sinks
        from hexflow.sources import tables

        sinks.write_datasets(spark, tables.events(spark, args.tables), tables.players(spark, args.tables), args.start, args.cutoff, args.folder)
    elif args.command == "cluster":
        from hexflow.plans import clustering

        print(json.dumps(clustering.run(spark, args.matrix, args.folder, label=args.label, min_cluster_size=args.min_cluster_size), sort_keys=True))
    else:
        from hexflow import serving

        serving.server(serving.Service(spark, args.folder), port=args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
