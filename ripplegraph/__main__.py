"""python -m ripplegraph facts|impact|grpc-impact|endpoint-assets|schema: documents on standard output."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from ripplegraph.operators.budgets import AnalysisError, InvalidInput, Limits, stage_times, within

CONFIG = ".ripplegraph.json"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="ripplegraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("facts", "impact", "grpc-impact", "endpoint-assets"):
        c = commands.add_parser(name)
        c.add_argument("--project", required=True, help="absolute path of the project")
        c.add_argument("--goos", default="linux")
        c.add_argument("--goarch", default="amd64")
        c.add_argument("--tags", default="", help="further build tags, by commas")
        c.add_argument("--cgo", action="store_true", help="with files that import C")
        c.add_argument("--timings", action="store_true", help="seconds on standard error")
        c.add_argument("--diagnostics-output", help="file for diagnostics, absolute")
        c.add_argument("--format", choices=["json"], default="json")
        if name in ("impact", "grpc-impact"):
            c.add_argument("--diff", required=name == "grpc-impact", help="absolute path of a unified diff")
            c.add_argument("--impact-config", help="absolute path of the configuration")
        if name == "impact":
            c.add_argument("--grpc", action="append", default=[], help="an operation, `<import path>.<Service>/<Method>`")
        if name == "endpoint-assets":
            c.add_argument("--endpoint", action="append", required=True, help="`METHOD /path`")
    commands.add_parser("schema").add_argument("--type", choices=["facts", "impact", "grpc-impact", "endpoint-assets"], required=True)
    return top.parse_args(argv)


def absolute(path: str | None, what: str) -> str | None:
    if path is not None and not os.path.isabs(path):
        raise InvalidInput(f"{what} must be an absolute path: {path}")
    return path


def run(args: argparse.Namespace) -> dict:
    from ripplegraph.plans import documents, schemas

    if args.command == "schema":
        return schemas.SCHEMAS[args.type]
    from ripplegraph.session import local_session
    from ripplegraph.sources import project, services

    root = absolute(args.project, "--project")
    spark = local_session()
    build = {"goos": args.goos, "goarch": args.goarch, "cgo": args.cgo, "tags": tuple(filter(None, args.tags.split(",")))}
    load = lambda: within(spark, Limits().load_seconds, "load", lambda: project.load(spark, root, **build))
    if args.command == "facts":
        fb = load()
        return within(spark, Limits().walk_seconds, "facts", lambda: documents.facts_document(fb))
    if args.command == "endpoint-assets":
        fb = load()
        return documents.endpoint_assets(spark, fb, args.endpoint, services.client_calls(fb, strict=True))
    path = absolute(args.diff, "--diff")
    if path is None:
        if not args.grpc:
            raise InvalidInput("impact needs --diff or --grpc")
        fb = load()
        return {"summary": {"impactedEndpointCount": 0, "impactedEndpoints": [], "impactedIMCount": 0, "impactedIMEvents": []}, "fileSources": [], "grpcSources": documents.operation_sources(spark, fb, args.grpc), "endpointSourcesSummary": []}
    config = documents.Config.read(absolute(args.impact_config, "--impact-config") or os.path.join(root, CONFIG))
    with open(path, encoding="utf-8", newline="") as f:
        diff = f.read()
    if args.command == "impact":
        return documents.impact_document(spark, root, diff, config, operations=args.grpc, build=build)
    return documents.service_document(spark, root, diff, config, build=build)


def main(argv: list[str] | None = None) -> int:
    args, began = arguments(argv), time.perf_counter()
    try:
        with stage_times() as stages:
            out = run(args)
    except AnalysisError as e:
        error = {"error": {"code": e.code, "message": str(e)}}
        if path := getattr(args, "diagnostics_output", None):
            from ripplegraph.plans.documents import write_json

            write_json(error, absolute(path, "--diagnostics-output"))
        print(json.dumps(error), file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, ensure_ascii=False))
    if getattr(args, "timings", False):
        for stage, seconds in [*stages, (args.command, time.perf_counter() - began)]:
            print(f"{stage} {seconds:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
