"""Texts that others run: tasks for schedulers, and modules for tests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..types import Type

_AIRFLOW = '''"""Checks a module and computes what is stale."""

import datetime

from airflow import DAG
from airflow.operators.bash import BashOperator

with DAG({name!r}, schedule={schedule!r}, start_date=datetime.datetime(2026, 1, 1), catchup=False) as dag:
    check = BashOperator(task_id="check", bash_command={check!r})
    test = BashOperator(task_id="test", bash_command={test!r})
    run = BashOperator(task_id="run", bash_command={run!r})
    check >> test >> run
'''
_PREFECT = '''"""Checks a module and computes what is stale."""

import subprocess

from prefect import flow, task


@task(retries={retries})
def step(command: str) -> None:
    subprocess.run(command, shell=True, check=True)


@flow(name={name!r})
def main() -> None:
    for command in ({check!r}, {test!r}, {run!r}):
        step(command)


if __name__ == "__main__":
    main()
'''


def _commands(module: str, store: str, data: str) -> dict[str, str]:
    base = "python -m modelgraph.cli"
    where = f"--store {store} --data {data}"
    return {"check": f"{base} check {module}", "test": f"{base} test {module} {where}", "run": f"{base} run {module} {where} --only-stale"}


def airflow(name: str, module: str, store: str, data: str, schedule: str = "@daily") -> str:
    return _AIRFLOW.format(name=name, schedule=schedule, **_commands(module, store, data))


def prefect(name: str, module: str, store: str, data: str, retries: int = 1) -> str:
    return _PREFECT.format(name=name, retries=retries, **_commands(module, store, data))


def source_text(name: str, columns: Mapping[str, Type | str], nonnull: Iterable[str] = ()) -> str:
    """A source declaration."""
    known = set(nonnull)
    return f"source {name} {{ columns: {{ " + ", ".join(f"{c}: {t}{' nonnull' if c in known else ''}" for c, t in columns.items()) + " } }"


def model_text(name: str, table: str, outputs: Mapping[str, str] | None = None, where: str = "", contract: str = "", owner: str = "") -> str:
    """A model that reads one table."""
    lines = [f'  owner: "{owner}"'] * bool(owner) + [f"  from {table}"] + [f"  filter {where}"] * bool(where)
    if outputs:
        lines.append("  select { " + ", ".join(f"{c} = {e}" for c, e in outputs.items()) + " }")
    return f"model {name}{f' -> contract {contract}' if contract else ''} {{\n" + "\n".join(lines) + "\n}"


def module_text(*parts: str) -> str:
    return "\n\n".join(parts) + "\n"
