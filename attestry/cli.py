"""attestry: `eval score|train-evaluator`, `annotation import|export|status|iaa`, `querygen gen-queries`, over a local or submitted
Spark session. Models are interfaces: a command that needs one takes it as `module:name`, an object or a class without arguments."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import datetime, timezone
from typing import Any

from .paths import Workspace
from .schemas import TASKS
from .settings import AnnotationSettings, EvalScoreSettings, EvalTrainSettings, QueryGenSettings, resolve

__version__ = "0.1.0"


def parse_value(text: str) -> Any:
    """JSON lists of texts or objects, and objects, are decoded; anything else is text."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    if isinstance(value, dict) or isinstance(value, list) and (all(isinstance(v, str) for v in value) or all(isinstance(v, dict) for v in value)):
        return value
    return text


def parse_time(text: str) -> str:
    """ISO 8601; a time without a zone is UTC."""
    t = datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return t.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")


def parse_tasks(text: str) -> list[str]:
    names = [t.strip() for t in text.split(",") if t.strip()]
    if bad := [t for t in names if t not in TASKS]:
        raise argparse.ArgumentTypeError(f"unknown tasks {bad}")
    return names


def load_object(text: str) -> Any:
    """The object that `module:name` names; of a class one is made."""
    module, _, name = text.partition(":")
    if not module or not name:
        raise argparse.ArgumentTypeError(f"{text!r} isn't module:name")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


#: What a query's spec can name, each by an option of its own.
SPEC_OPTIONS = ("domains", "roles", "languages", "topics", "intents", "tasks", "disallowed_topics", "difficulty", "formats")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("attestry", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--workspace", default=".")
    top.add_argument("--config", default=None, help="YAML settings")
    groups = top.add_subparsers(dest="group", required=True)
    ev = groups.add_parser("eval").add_subparsers(dest="command", required=True)
    s = ev.add_parser("score")
    s.add_argument("task", choices=TASKS)
    s.add_argument("--path")
    s.add_argument("--export")
    s.add_argument("--n-resamples", type=int)
    s.add_argument("--ci", type=float)
    s.add_argument("--seed", type=int)
    s.add_argument("--bootstrap", choices=("exact", "scale"), default="exact")
    s.add_argument("--score-id", help="write the report under the workspace")
    s.add_argument("--out")
    tr = ev.add_parser("train-evaluator")
    tr.add_argument("task", choices=TASKS)
    tr.add_argument("--classifier", required=True, type=load_object)
    tr.add_argument("--path")
    tr.add_argument("--export")
    qg = groups.add_parser("querygen").add_subparsers(dest="command", required=True)
    g = qg.add_parser("gen-queries")
    for name in SPEC_OPTIONS:
        g.add_argument(f"--{name.replace('_', '-')}", type=parse_value)
    g.add_argument("--planner", required=True, type=load_object)
    g.add_argument("--realizer", required=True, type=load_object)
    g.add_argument("--summarizer", type=load_object)
    g.add_argument("--embedder", type=load_object)
    g.add_argument("--run-id", default="run")
    g.add_argument("--n-queries", type=int)
    g.add_argument("--batch-size", type=int)
    g.add_argument("--near-duplicate-tolerance", type=float)
    an = groups.add_parser("annotation").add_subparsers(dest="command", required=True)
    i = an.add_parser("import")
    i.add_argument("source")
    i.add_argument("--store", required=True)
    i.add_argument("--format", default="auto")
    e = an.add_parser("export")
    e.add_argument("--store", required=True)
    e.add_argument("--export-id")
    e.add_argument("--tasks", type=parse_tasks)
    e.add_argument("--include-discarded", action="store_true")
    t = an.add_parser("status")
    t.add_argument("--store", required=True)
    t.add_argument("--tag-partial-panels", action="store_true")
    a = an.add_parser("iaa")
    a.add_argument("export_id")
    a.add_argument("--tasks", type=parse_tasks, default=list(TASKS))
    a.add_argument("--exclude", type=lambda x: x.split(","), default=None)
    a.add_argument("--after", type=parse_time)
    a.add_argument("--before", type=parse_time)
    a.add_argument("--seed", type=int)
    a.add_argument("--bootstrap", choices=("exact", "scale"), default="exact")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans import exchange, generate, iaa, score
    from .schemas import export_schema
    from .sources.readers import read_typed_csv
    from .sources.writers import atomic_json

    spark = SparkSession.builder.appName("attestry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ws = Workspace(args.workspace)
    if args.group == "querygen":
        given = {k: v for k, v in (("n_queries", args.n_queries), ("batch_size", args.batch_size), ("near_duplicate_tolerance", args.near_duplicate_tolerance)) if v is not None}
        spec = {k: getattr(args, k) for k in SPEC_OPTIONS if getattr(args, k) is not None}
        conf = resolve(QueryGenSettings, args.config, given)
        out = generate.gen_queries(spark, spec, args.planner, args.realizer, args.summarizer, args.embedder, conf, args.run_id, ws)
        json.dump({"run_id": args.run_id, "queries": str(ws.queries(args.run_id) / "queries.csv"), "n": out.count()}, sys.stdout, indent=2)
        print()
        return 0
    if args.group == "eval" and args.command == "train-evaluator":
        conf = resolve(EvalTrainSettings, args.config)
        print(generate.train_evaluator(None, args.task, args.classifier, workspace=ws, settings=conf, path=args.path, export=args.export))
        return 0
    if args.group == "eval":
        given = {k: v for k, v in (("n_resamples", args.n_resamples), ("ci", args.ci), ("seed", args.seed)) if v is not None}
        conf = resolve(EvalScoreSettings, args.config, given)
        report = score.score(spark, args.task, path=args.path, export=args.export, workspace=ws, score_id=args.score_id, bootstrap=args.bootstrap, n_resamples=conf.n_resamples, ci=conf.ci, seed=conf.seed, notes=conf.notes)
        if args.out:
            atomic_json(args.out, report.to_dict())
        print(score.table(report))
        return 0
    if args.command == "iaa":
        folder = ws.export(args.export_id)
        frames = {t: read_typed_csv(spark, str(folder / f"{t}.csv"), export_schema(t)) for t in args.tasks if (folder / f"{t}.csv").exists()}
        out = iaa.agreement_report(frames, seed=args.seed, exclude_annotators=args.exclude, after=args.after, before=args.before, export_id=args.export_id, bootstrap=args.bootstrap)
        atomic_json(folder / "iaa.json", out)
    else:
        store = exchange.ParquetStore(spark, args.store)
        if args.command == "import":
            out = exchange.import_records(spark, args.source, store, resolve(AnnotationSettings, args.config), ws, args.format).__dict__
        elif args.command == "export":
            out = exchange.export_annotations(store, ws, args.export_id, args.tasks, args.include_discarded)
        else:
            found = exchange.report_status(store, tag_partial_panels=args.tag_partial_panels)
            print(exchange.status_table(found["progress"]), file=sys.stderr)
            out = {k: v for k, v in found.items() if k in ("totals", "progress", "tags")}
    json.dump(out, sys.stdout, indent=2, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
