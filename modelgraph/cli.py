"""Command line: ``python -m modelgraph.cli COMMAND FILE ...``."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
import time
from pathlib import Path

from .errors import ModelError, PinError
from .importer import import_project
from .lineage import blast_radius, changes, consumers, graph
from .lint import lint
from .plans import Project
from .syntax import read_module
from .syntax.grammar import gbnf
from .syntax.recogniser import accepts
from .syntax.printer import module as printed


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("modelgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _runner(a: argparse.Namespace, project: Project):  # noqa: ANN202
    from .runs import Runner, Store
    from .sources import Sources

    spark = _session()
    tables = dict(t.split("=", 1) for t in a.table or [])
    sources = Sources(spark, {n: tables.get(n, f"{a.data}/{n}.parquet" if a.data else n) for n in project.sources})
    return Runner(project, Store(spark, a.store), sources)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="modelgraph")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, data: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        p.add_argument("file")
        if data:
            p.add_argument("--store", required=True, help="folder of runs")
            p.add_argument("--data", help="folder of <source>.parquet")
            p.add_argument("--table", action="append", metavar="SOURCE=PATH")
        return p

    command("check", "check definitions").add_argument("--strict", action="store_true")
    p = command("compile", "the plan of each model")
    p.add_argument("models", nargs="*")
    p.add_argument("--data", required=True, help="folder of <source>.parquet")
    p.add_argument("--mode", choices=["simple", "extended", "formatted", "cost"], default="formatted")
    p = command("profile", "time of reading, checking and, with --data, computing")
    p.add_argument("--data", help="folder of <source>.parquet")
    p = command("dashboard", "models, promises, what changes reach, warnings")
    p.add_argument("--json", action="store_true")
    p.add_argument("--store")
    p.add_argument("--data")
    p.add_argument("--table", action="append", metavar="SOURCE=PATH")
    p = sub.add_parser("init", help="a new project that reads the demo tables")
    p.add_argument("file", metavar="FOLDER")
    p = sub.add_parser("seed", help="write the demo tables")
    p.add_argument("file", metavar="FOLDER")
    sub.add_parser("lsp", help="editor service on standard input and output")
    p = command("schedule", "a scheduler's file that checks, tests and runs a module")
    p.add_argument("kind", choices=["airflow", "prefect"])
    p.add_argument("--store", required=True)
    p.add_argument("--data", required=True)
    p = command("golden", "hold canonical texts, schemas and lineage against kept ones")
    p.add_argument("golden", help="file to compare with")
    p.add_argument("--update", action="store_true")
    p = command("plan", "schema, lineage and reads of models")
    p.add_argument("models", nargs="*")
    command("graph", "what reads what").add_argument("--style", choices=["text", "dot", "mermaid"], default="text")
    command("blast", "what a column change reaches").add_argument("columns", nargs="+", metavar="NODE.COLUMN")
    command("diff", "changes from an older file").add_argument("old")
    command("lint", "warnings")
    command("fmt", "canonical text").add_argument("--write", action="store_true")
    command("import", "definitions from a schema file and SQL files").add_argument("sql", nargs="*")
    sub.add_parser("grammar", help="the language as GBNF").add_argument("--check", metavar="FILE", help="whether the grammar accepts a file")
    p = command("run", "compute and publish", data=True)
    p.add_argument("models", nargs="*")
    p.add_argument("--only-stale", action="store_true")
    p.add_argument("--pipeline")
    p.add_argument("--reason", default="")
    p = command("stage", "compute aside, without publishing", data=True)
    p.add_argument("--branch", default="main")
    p = command("test", "run declarative tests on staged models", data=True)
    p.add_argument("models", nargs="*")
    p.add_argument("--fixtures", metavar="FILE", help="SQL statements that make the tables")
    p = command("publish", "a run's snapshots as tables of a catalog", data=True)
    p.add_argument("run")
    p.add_argument("--database", default="default")
    p.add_argument("--format", default="parquet")
    p = command("catalog", "what a catalog holds", data=True)
    p.add_argument("--database", default="default")
    p.add_argument("--format", default="parquet")
    p.add_argument("--verify", metavar="RUN")
    p.add_argument("--independent", action="store_true", help="verify by reading the files without Spark")
    p.add_argument("--rollback", metavar="RUN")
    p.add_argument("--keep", type=int, help="drop runs beyond the last so many")
    for name, what in (("replay", "compute a past run again"), ("rollback", "make a past run current")):
        command(name, what, data=True).add_argument("run")
    p = command("backfill", "a past run with other rows", data=True)
    p.add_argument("run")
    p.add_argument("--override", action="append", required=True, metavar="SOURCE=PATH")
    p.add_argument("--reason", required=True)
    command("history", "published runs", data=True)
    command("branches", "staged models", data=True)
    command("migrate", "bring the history to this version", data=True)
    p = command("gc", "runs that nothing needs", data=True)
    p.add_argument("--keep", type=int, default=5)
    p.add_argument("--keep-days", type=float)
    p.add_argument("--apply", action="store_true")
    return top


def _run(a: argparse.Namespace) -> int:
    if a.command == "grammar":
        if a.check:
            ok = accepts(gbnf(), Path(a.check).read_text())
            print("accepted" if ok else "rejected")
            return 0 if ok else 2
        print(gbnf(), end="")
        return 0
    if a.command == "lsp":
        from .tooling.service import serve

        return serve()
    if a.command in ("init", "seed"):
        from .tooling import demo

        print(demo.start(a.file) if a.command == "init" else ", ".join(demo.seed(_session(), a.file)))
        return 0
    if a.command == "import":
        print(printed(import_project(Path(a.file).read_text(), {Path(f).stem: Path(f).read_text() for f in a.sql})), end="")
        return 0
    if a.command == "fmt":
        text = printed(read_module(Path(a.file).read_text()))
        if a.write:
            Path(a.file).write_text(text)
        else:
            print(text, end="")
        return 0
    project = Project.from_file(a.file)
    match a.command:
        case "check":
            began = time.perf_counter()
            models = project.check(strict=a.strict)
            print(f"{len(models)} models, {len(project.tests)} tests checked in {1000 * (time.perf_counter() - began):.0f} ms")
        case "plan":
            for name, m in project.check(a.models or None).items():
                print(f"{name} [{m.fingerprint}] reads {', '.join(m.inputs)}")
                for c in m.schema.values():
                    origins = ", ".join(f"{o.node}.{o.column} ({o.kind})" for o in m.lineage[c.name])
                    print(f"  {c.name}: {c.type}{'' if c.nullable else ' nonnull'}  <- {origins or 'nothing'}")
        case "graph":
            print(graph(project.check(), a.style), end="")
        case "blast":
            for node, column in sorted(blast_radius(project.check(), [tuple(c.split(".", 1)) for c in a.columns])):  # type: ignore[misc]
                print(f"{node}.{column}")
        case "diff":
            old = Project.from_file(a.old)
            found = changes(old.check(), project.check(), old.contracts, project.contracts)
            for c in found:
                print(f"{'BREAKING ' if c.breaking else ''}{c.kind} {c.model}.{c.column}: {c.detail}")
            breaking = [(c.model, c.column) for c in found if c.breaking]
            if breaking:
                read = consumers(old.compiled, breaking)
                print(f"E030: {len(breaking)} breaking changes; {len(read)} columns are made from them" + "".join(f"\n  {m}.{c}" for m, c in read))
            return 1 if breaking else 0
        case "compile":
            from .sources import Sources

            sources = Sources.folder(_session(), a.data, list(project.sources))
            for name in project.order(a.models or None):
                print(f"== {name}")
                project.frame(name, sources).explain(a.mode)
        case "profile":
            from .tooling.overview import profile

            for phase, ms, rows in profile(a.file, _computed(a.data) if a.data else None):
                print(f"{phase}: {ms:.0f} ms" + ("" if rows is None else f", {rows} rows"))
        case "dashboard":
            from .tooling.overview import overview, shown

            found = overview(project, _runner(a, project) if a.store else None)
            print(json.dumps(found, indent=1, sort_keys=True) if a.json else shown(found), end="")
        case "schedule":
            from .tooling import templates

            print(getattr(templates, a.kind)(Path(a.file).stem, a.file, a.store, a.data), end="")
        case "golden":
            return _golden(a, project)
        case "lint":
            print("".join(f"{w}\n" for w in lint(project)), end="")
        case _:
            return _data_command(a, project)
    return 0


def _computed(data: str):  # noqa: ANN202
    """Computes each model of a project over the tables of a folder."""

    def run(project: Project) -> dict[str, tuple[float, int]]:
        from .sources import Sources

        sources, out = Sources.folder(_session(), data, list(project.sources)), {}
        for name in project.order(None):
            began = time.perf_counter()
            rows = project.frame(name, sources).count()
            out[name] = (time.perf_counter() - began, rows)
        return out

    return run


def _golden(a: argparse.Namespace, project: Project) -> int:
    """0 where the kept text is the same, 1 where it differs."""
    parts = [printed(read_module(Path(a.file).read_text()))]
    for name, m in project.check().items():
        parts.append(f"{name} [{m.fingerprint}]\n" + "".join(f"  {c.name}: {c.type}{'' if c.nullable else ' nonnull'} <- {', '.join(f'{o.node}.{o.column} {o.kind}' for o in m.lineage[c.name])}\n" for c in m.schema.values()))
    text, kept = "\n".join(parts), Path(a.golden)
    if a.update:
        kept.write_text(text)
        return 0
    same = kept.exists() and kept.read_text() == text
    if not same:
        old = kept.read_text().splitlines() if kept.exists() else []
        print("\n".join(difflib.unified_diff(old, text.splitlines(), "kept", "now", lineterm="")))
    return 0 if same else 1


def _data_command(a: argparse.Namespace, project: Project) -> int:
    r = _runner(a, project)
    match a.command:
        case "run":
            out = r.run(a.models or None, only_stale=a.only_stale, pipeline=a.pipeline, reason=a.reason)
            print(f"run {out.run}: {', '.join(out.models)}" if out.models else "nothing is stale")
        case "stage":
            print("\n".join(r.stage(branch=a.branch)))
        case "test":
            if a.fixtures:
                from .tooling.demo import fixtures

                fixtures(r.store.spark, Path(a.fixtures).read_text())
            print("\n".join(r.stage(a.models or None, branch="test")))
        case "publish":
            from .runs.catalog import Catalog

            print(json.dumps(Catalog(r.store, a.database, a.format).publish(a.run)))
        case "catalog":
            from .runs.catalog import Catalog

            catalog = Catalog(r.store, a.database, a.format)
            if a.rollback:
                catalog.rollback(a.rollback)
            if a.keep is not None:
                print("\n".join(catalog.gc(a.keep, apply=True)))
            print(json.dumps(catalog.verify(a.verify, a.independent) if a.verify else catalog.record(), sort_keys=True))
        case "replay":
            print(f"run {a.run} gives the same rows of {', '.join(r.replay(a.run).models)}")
        case "rollback":
            print(f"current from run {a.run}: {', '.join(r.rollback(a.run))}")
        case "backfill":
            print(f"run {r.backfill(a.run, dict(o.split('=', 1) for o in a.override), a.reason).run}")
        case "history":
            for e in r.store.history():
                print(json.dumps({k: e.get(k) for k in ("run", "at", "models", "reason")}))
        case "branches":
            print(json.dumps(r.branches()))
        case "migrate":
            print(f"{r.store.migrate()} entries")
        case "gc":
            gone = r.gc(a.keep, a.keep_days, a.apply)
            print("\n".join(gone) if gone else "nothing to collect")
    return 0


def main(args: list[str] | None = None) -> int:
    """0: done; 1: definitions are wrong, or a diff breaks; 3: data breaks a
    promise; 2: anything else about data."""
    a = _parser().parse_args(args)
    try:
        return _run(a)
    except PinError as e:
        print(e, file=sys.stderr)
        return 3
    except ModelError as e:
        print(e, file=sys.stderr)
        return 2 if e.code.startswith("E08") or e.code == "E095" else 1


if __name__ == "__main__":
    sys.exit(main())
