"""Counters and timings of runs, for Prometheus, StatsD or JSON."""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Iterator

Labels = tuple[tuple[str, str], ...]


class Metrics:
    """Thread-safe counters, gauges and summaries by name and labels."""

    def __init__(self, prefix: str = "modelgraph"):
        self.prefix = prefix
        self._lock = threading.Lock()
        self.counters: dict[tuple[str, Labels], float] = {}
        self.gauges: dict[tuple[str, Labels], float] = {}
        self.timings: dict[tuple[str, Labels], list[float]] = {}

    @staticmethod
    def _key(name: str, labels: dict[str, str]) -> tuple[str, Labels]:
        return name, tuple(sorted(labels.items()))

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        with self._lock:
            key = self._key(name, labels)
            self.counters[key] = self.counters.get(key, 0) + by

    def gauge(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self.gauges[self._key(name, labels)] = value

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        with self._lock:
            self.timings.setdefault(self._key(name, labels), []).append(seconds)

    @contextlib.contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        except BaseException:
            self.count(f"{name}_failures", **labels)
            raise
        finally:
            self.observe(f"{name}_seconds", time.perf_counter() - began, **labels)

    def prometheus(self) -> str:
        """The text exposition format."""

        def shown(labels: Labels) -> str:
            escape = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
            return "{" + ",".join(f'{k}="{escape(v)}"' for k, v in labels) + "}" if labels else ""

        lines, typed = [], set()

        def add(kind: str, name: str, suffix: str, labels: Labels, value: float) -> None:
            full = f"{self.prefix}_{name}"
            if full not in typed:
                typed.add(full)
                lines.append(f"# TYPE {full} {kind}")
            lines.append(f"{full}{suffix}{shown(labels)} {value:g}")

        for (name, labels), v in sorted(self.counters.items()):
            add("counter", f"{name}_total", "", labels, v)
        for (name, labels), v in sorted(self.gauges.items()):
            add("gauge", name, "", labels, v)
        for (name, labels), vs in sorted(self.timings.items()):
            add("summary", name, "_count", labels, len(vs))
            add("summary", name, "_sum", labels, sum(vs))
        return "\n".join(lines) + "\n" if lines else ""

    def statsd(self) -> list[str]:
        tags = lambda labels: "|#" + ",".join(f"{k}:{v}" for k, v in labels) if labels else ""
        out = [f"{self.prefix}.{n}:{v:g}|c{tags(lab)}" for (n, lab), v in sorted(self.counters.items())]
        out += [f"{self.prefix}.{n}:{v:g}|g{tags(lab)}" for (n, lab), v in sorted(self.gauges.items())]
        return out + [f"{self.prefix}.{n}:{1000 * v:g}|ms{tags(lab)}" for (n, lab), vs in sorted(self.timings.items()) for v in vs]

    def json(self) -> str:
        flat = lambda d: [{"name": n, "labels": dict(lab), "value": v} for (n, lab), v in sorted(d.items())]
        return json.dumps({"counters": flat(self.counters), "gauges": flat(self.gauges), "timings": flat(self.timings)}, sort_keys=True)


#: What runs report to unless they are given their own.
METRICS = Metrics()
