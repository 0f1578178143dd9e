"""Run, replay, roll back, backfill, clean up.

A run copies the rows of its sources, computes its models from the copies, holds
them against contracts, join promises and tests, and only then makes them
current: one rename for the data, one for the pointer.  Whatever fails before
leaves the current snapshots as they are.  A run is named by what it is made of,
its definitions and the content of its sources, so the same work has one name.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ir
from ..errors import ModelError, PinError
from ..metrics import METRICS, Metrics
from ..operators import incremental
from ..operators.relational import col
from ..plans import Project
from ..quality import hold_join, pin, run_tests
from ..sources import Sources
from .store import LAYOUT, Store

_LIMIT = {"daily": dt.timedelta(hours=24), "weekly": dt.timedelta(days=7), "monthly": dt.timedelta(days=30)}
_UNIT = {"h": "hours", "d": "days", "w": "weeks"}


def limit_of(value: str) -> dt.timedelta:
    """The age that a freshness word allows: daily, weekly, monthly, 6h, 2d, 1w."""
    if value in _LIMIT:
        return _LIMIT[value]
    m = re.fullmatch(r"(\d+)([hdw])", value)
    if not m:
        raise ModelError("E095", f"unknown freshness {value!r}")
    return dt.timedelta(**{_UNIT[m[2]]: int(m[1])})


def guarded(condition: str) -> str:
    """A freshness condition, if it is one expression and no more."""
    if re.search(r";|--|/\*", condition) or re.search(r"(?i)\b(select|insert|update|delete|drop|alter|create|merge|copy|reflect|java_method)\b", condition) or not re.search(r"[<>=(]", condition):
        raise ModelError("E095", f"unknown freshness {condition!r}")
    return condition


def content_hash(df: DataFrame) -> str:
    """Hash of a table's schema and rows, whatever their order; repeated rows
    count.  One pass, and one row comes back."""
    return named(df.schema, list(df.agg(*sums_of(df)).first()))


def sums_of(df: DataFrame) -> list[Column]:
    """Aggregates that tell a table's rows, whatever their order.  Those of two
    tables together follow from those of each, see ``together``."""
    cells = [F.to_json(F.map_entries(col(f.name))) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema.fields]
    h = F.xxhash64(*cells) if cells else F.lit(0).cast("long")
    wide = F.pmod(h, F.lit(2147483647)) * F.pmod(F.shiftright(h, 31), F.lit(2147483647)).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("parity"), F.sum(wide).alias("wide")]


def together(a: list, b: list) -> list:
    return [a[0] + b[0], (a[1] or 0) + (b[1] or 0), (a[2] or 0) ^ (b[2] or 0), (a[3] or 0) + (b[3] or 0)]


def named(schema: T.StructType, sums: list) -> str:
    shape = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return hashlib.sha256(repr((shape, [str(x or 0) for x in sums])).encode()).hexdigest()[:16]


@dataclass
class RunResult:
    run: str
    models: list[str]
    tests: list[str] = field(default_factory=list)
    reused: bool = False


class Runner:
    def __init__(self, project: Project, store: Store, sources: Sources, now: dt.datetime | None = None, metrics: Metrics = METRICS):
        self.project, self.store, self.sources = project, store, sources
        self._now, self.metrics = now, metrics

    def now(self) -> dt.datetime:
        return self._now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    # -- what to run
    def sources_of(self, models: list[str]) -> list[str]:
        names: list[str] = []
        for m in models:
            names += [i for i in self.project.compiled[m].inputs if i in self.project.sources and i not in names]
        return names

    def hashes(self, names: list[str], sources: Sources) -> dict[str, str]:
        """What tells whether a source has changed: the listing of its files where
        it has files, else its rows."""
        return {n: sources.identity(self.project.sources[n]) or content_hash(sources.get(self.project.sources[n])) for n in names}

    def stale(self, models: list[str], hashes: Mapping[str, str]) -> list[str]:
        """Models to compute again: new or changed ones, those whose sources
        changed or that are too old, and all that read them."""
        live, out = self.store.live(), []
        entries = {run: self.store.entry(run) for run in set(live.values())}
        for name in models:
            c, decl = self.project.compiled[name], self.project.models[name]
            entry = entries.get(live.get(name, ""))
            if entry is None or not self.store.exists("runs", live[name], "models", name):
                out.append(name)
                continue
            changed = entry["fingerprints"].get(name) != c.fingerprint
            moved = any(entry["sources"].get(s) != hashes[s] for s in c.inputs if s in hashes) or any(d in out for d in c.depends)
            old = bool(decl.upkeep.ages) and self._aged(name, decl.upkeep, dt.datetime.fromisoformat(entry["at"]))
            if changed or ((moved or old) and decl.attributes.get("staleness_ok") not in ("true", "yes")):
                out.append(name)
        return out

    def _aged(self, name: str, up: ir.Upkeep, ran: dt.datetime) -> bool:
        """Whether a snapshot is older than a word of its freshness allows, or a
        condition on its rows, as ``max(ts) > now() - interval 2 days``, fails."""
        words = [v for v in up.ages if v in _LIMIT or re.fullmatch(r"\d+[hdw]", v)]
        if any(self.now() - ran > limit_of(v) for v in words):
            return True
        cells = [F.max(col(up.age_of)).cast("timestamp_ntz")] if up.age_of and words else []
        now = f"timestamp_ntz'{self.now().isoformat(sep=' ')}'"
        conditions = [F.expr(re.sub(r"(?i)\b(now|current_timestamp)\(\)", now, guarded(v))) for v in up.ages if v not in words]
        if not cells and not conditions:
            return False
        found = list(self.snapshot(name).agg(*cells, *conditions).first())
        latest = found.pop(0) if cells else self.now()
        return latest is None or any(self.now() - latest > limit_of(v) for v in words if cells) or not all(found)

    # -- reading
    def snapshot(self, model: str, run: str | None = None) -> DataFrame:
        """The current rows of a model, or those of a run."""
        run = run or self.store.live().get(model)
        if run is None:
            raise ModelError("E085", f"model {model!r} isn't published")
        return self.store.read("runs", run, "models", model)

    # -- computing
    def _merged(self, name: str, full: DataFrame, previous: DataFrame | None) -> DataFrame:
        """The rows of an incremental model: those before and what is new by the
        watermark."""
        up = self.project.models[name].upkeep
        if previous is None or not up.merges:
            return full
        if up.merge is ir.Merge.APPEND:
            return incremental.append(previous, full, up.watermark or "")
        return incremental.upsert(previous, full, up.watermark or "", [k.name for k in up.merge_on])  # type: ignore[attr-defined]

    def _appendable(self, name: str, full: DataFrame, previous: DataFrame | None, run: str | None) -> list | None:
        """The sums of the rows that an append leaves where they are, or nothing if
        the rows have to be written anew."""
        if previous is None or run is None or self.project.models[name].upkeep.merge is not ir.Merge.APPEND:
            return None
        same = [(f.name, f.dataType) for f in previous.schema.fields] == [(f.name, f.dataType) for f in full.schema.fields]
        known = self.store.entry(run).get("sums", {}).get(name)
        return [int(x) for x in known] if same and known else None

    def _compute(self, models: list[str], folder: str, inputs: dict[str, DataFrame], before: Mapping[str, str], above: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
        """Write the models' rows under ``folder``.  ``before``: the run whose
        snapshot each merged model starts from; ``above``: the run whose snapshot
        stands for a model that isn't among them, by default the current one."""
        made: dict[str, DataFrame] = {}
        self.sums: dict[str, list] = {}

        def get(node: str) -> DataFrame:
            if node in inputs:
                return inputs[node]
            return made[node] if node in made else self.snapshot(node, (above or {}).get(node))

        for name in models:
            c, decl = self.project.compiled[name], self.project.models[name]
            for check in c.joins:
                hold_join(check, get(c.inputs[0]), get(check.table), name)
            previous = self.snapshot(name, before[name]) if name in before else None
            parts = [p.name for p in decl.upkeep.partitions if isinstance(p, ir.Ref) and p.name in c.schema]
            with self.metrics.timed("model", model=name):
                full = c.lower(get)
                base = self._appendable(name, full, previous, before.get(name))
                new = full if base is None else incremental.delta(previous, full, decl.upkeep.watermark or "")
                rows = self._merged(name, full, previous) if base is None else new
                made[name], self.sums[name] = self.store.write(rows, folder, "models", name, partition_by=parts, sums=sums_of(rows), behind=None if base is None else ("runs", before[name], "models", name))
                if base is not None:
                    self.sums[name] = together(base, self.sums[name])
            if decl.contract:
                pin(made[name], self.project.contracts[decl.contract], name)
        return made

    def stage(self, models: list[str] | None = None, branch: str = "test") -> list[str]:
        """Compute models aside and run their tests; nothing is published."""
        self.project.check(None)
        order = self.project.order(models)
        inputs = {n: self.sources.get(self.project.sources[n]) for n in self.sources_of(order)}
        folder = f"branches/{branch}"
        self.store.delete(folder)
        made = self._compute(order, folder, inputs, {})
        return run_tests(self.project.tests, made.__getitem__, set(made))

    def run(self, models: list[str] | None = None, *, only_stale: bool = False, overrides: Mapping | None = None, reason: str = "", pipeline: str | None = None) -> RunResult:
        """Compute and publish models (by default all, or those of a pipeline)."""
        p = self.project.pipeline(pipeline) if pipeline else None
        if p is not None:
            models, overrides = models or self.project.pipeline_models(p), {**p.overrides, **(overrides or {})}
        self.project.check(None)
        sources = self.sources.overridden(overrides or {})
        with self.store.locked():
            self.recover()
            order = self.project.order(models)
            hashes = self.hashes(self.sources_of(order), sources)
            if only_stale:
                order = self.stale(order, hashes)
                if not order:
                    return RunResult("", [])
            frames = {n: sources.get(self.project.sources[n]) for n in self.sources_of(order)}
            return self._publish(order, frames, hashes, sources, reason)

    def _publish(self, order: list[str], frames: dict[str, DataFrame], hashes: Mapping[str, str], sources: Sources | None = None, reason: str = "", of: str = "") -> RunResult:
        live = self.store.live()
        merged = {m: live[m] for m in order if m in live and self.project.models[m].upkeep.merges and self.store.exists("runs", live[m], "models", m)}
        used = {n: hashes[n] for n in self.sources_of(order)}
        above = {d: live[d] for m in order for d in self.project.compiled[m].depends if d not in order and d in live}
        entry: dict = {"layout": LAYOUT, "models": order, "fingerprints": {m: self.project.compiled[m].fingerprint for m in order}, "sources": used, "above": above, "merged": merged, "reason": reason, "of": of}
        run = hashlib.sha256(json.dumps(entry, sort_keys=True).encode()).hexdigest()[:12]
        entry |= {"run": run, "at": self.now().isoformat(timespec="seconds")}
        folder = f"runs/.{run}-{uuid.uuid4().hex[:6]}"
        try:
            inputs, entry["inputs"] = {}, {}
            for n, df in frames.items():  # the rows are hashed as they are copied
                inputs[n], sums = self.store.write(df, folder, "inputs", n, sums=sums_of(df))
                entry["inputs"][n] = named(inputs[n].schema, sums)
                listed = sources.identity(self.project.sources[n]) if sources else None
                if (listed or entry["inputs"][n]) != hashes[n]:
                    raise PinError("E098", f"source {n!r} changed while it was copied")
            made = self._compute(order, folder, inputs, merged)
            entry["content"] = {m: named(df.schema, self.sums[m]) for m, df in made.items()}
            entry["sums"] = {m: [str(x or 0) for x in self.sums[m]] for m in made}
            tests = run_tests(self.project.tests, lambda m: made[m] if m in made else self.snapshot(m), set(order))
            reused = self.store.exists("runs", run)
            if reused:
                for m in order:
                    if content_hash(self.store.read("runs", run, "models", m)) != entry["content"][m]:
                        raise PinError("E098", f"run {run} exists with other rows of {m!r}: identity conflict")
                self.store.delete(folder)
            else:
                self.store.move(folder, f"runs/{run}")
        except BaseException:
            self.store.delete(folder)
            raise
        self.store.put("pending.json", json.dumps(entry, sort_keys=True))
        self.recover()
        self.metrics.count("runs")
        self.metrics.count("models_published", len(order))
        return RunResult(run, order, tests, reused)

    def recover(self) -> bool:
        """Finish a publication that was cut off: its data is complete, only the
        pointer or the history may be missing."""
        text = self.store.text("pending.json")
        if text is None:
            return False
        entry = json.loads(text)
        self.store.set_live(self.store.live() | {m: entry["run"] for m in entry["models"]})
        self.store.add_history(entry)
        self.store.delete("pending.json")
        return True

    # -- going back
    def rollback(self, run: str, models: list[str] | None = None) -> list[str]:
        """Make a past run's snapshots current again; nothing is computed."""
        with self.store.locked():
            self.recover()
            names = models or self.store.entry(run)["models"]
            for m in names:
                if not self.store.exists("runs", run, "models", m):
                    raise ModelError("E085", f"run {run} has no snapshot of {m!r} any more")
            self.store.set_live(self.store.live() | {m: run for m in names})
            return names

    def verify(self, run: str) -> list[str]:
        """Models of a past run whose definitions have changed since."""
        self.project.check(None)
        entry = self.store.entry(run)
        return [m for m in entry["models"] if m not in self.project.compiled or self.project.compiled[m].fingerprint != entry["fingerprints"][m]]

    def _frozen(self, run: str) -> dict[str, DataFrame]:
        entry, out = self.store.entry(run), {}
        for n, wanted in entry.get("inputs", entry["sources"]).items():
            df = self.store.read("runs", run, "inputs", n)
            if content_hash(df) != wanted:
                raise PinError("E098", f"the rows of {n!r} that run {run} read have changed")
            out[n] = df
        return out

    def replay(self, run: str) -> RunResult:
        """Compute a past run again from the rows it read and hold the result
        against what it published."""
        changed = self.verify(run)
        if changed:
            raise ModelError("E084", f"changed since run {run}: {', '.join(changed)}")
        entry, inputs = self.store.entry(run), self._frozen(run)
        folder = f"runs/.replay-{uuid.uuid4().hex[:8]}"
        try:
            made = self._compute(entry["models"], folder, inputs, entry["merged"], entry["above"])
            for m, df in made.items():
                if named(df.schema, self.sums[m]) != entry["content"][m]:
                    raise PinError("E098", f"replay of run {run} gives other rows of {m!r}")
        finally:
            self.store.delete(folder)
        return RunResult(run, list(made))

    def backfill(self, run: str, overrides: Mapping[str, DataFrame | str], reason: str) -> RunResult:
        """Run a past run's models with other rows for some sources."""
        if not reason.strip():
            raise ModelError("E084", "a backfill needs a reason")
        self.project.check(None)
        with self.store.locked():
            self.recover()
            entry = self.store.entry(run)
            frames = self._frozen(run)
            unknown = [n for n in overrides if n not in frames]
            if unknown:
                raise ModelError("E020", f"run {run} didn't read {', '.join(unknown)}")
            other = self.sources.overridden(overrides)
            frames |= {n: other.get(self.project.sources[n]) for n in overrides}
            return self._publish(entry["models"], frames, {n: content_hash(df) for n, df in frames.items()}, reason=reason, of=run)

    # -- cleaning up
    def gc(self, keep: int = 5, keep_days: float | None = None, apply: bool = False) -> list[str]:
        """Runs that nothing needs: not current, not pending, not among the last
        ``keep``, nor younger than ``keep_days``.  They are listed, and deleted
        with ``apply``; the history stays."""
        with self.store.locked():
            present = [n for n in self.store.names("runs") if not n.startswith(".")]
            entries = {e["run"]: e for e in self.store.history()}
            pending = json.loads(self.store.text("pending.json") or "{}").get("run")
            live = self.store.live()
            kept = {pending, *live.values(), *[e["run"] for e in self.store.history()[-keep:]]} if keep else {pending, *live.values()}
            for run in set(live.values()):
                kept |= set(entries.get(run, {}).get("merged", {}).values())
            if keep_days is not None:
                kept |= {r for r, e in entries.items() if self.now() - dt.datetime.fromisoformat(e["at"]) < dt.timedelta(days=keep_days)}
            for run in [r for r in kept if r]:
                kept |= self.store.behind(run)
            gone = [r for r in present if r not in kept]
            if apply:
                for r in gone:
                    self.store.delete("runs", r)
                for n in self.store.names("runs"):
                    if n.startswith("."):
                        self.store.delete("runs", n)
            return gone

    def branches(self) -> dict[str, list[str]]:
        return {b: self.store.names("branches", b, "models") for b in self.store.names("branches")}
