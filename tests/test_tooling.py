"""The grammar against the reader, the editor service, the command line, sinks and
publication in a catalog."""

import io
import json

import pytest

from modelgraph import ir
from modelgraph.cli import main
from modelgraph.errors import ModelError
from modelgraph.plans import Project
from modelgraph.queries import MODELS, SOURCES
from modelgraph.runs import Runner, Store
from modelgraph.runs.catalog import Catalog
from modelgraph.sources import Sources, sinks
from modelgraph.syntax.grammar import gbnf
from modelgraph.syntax.recogniser import accepts, unused
from modelgraph.tooling import demo, templates
from modelgraph.tooling.service import Service, serve


# -- grammar
@pytest.mark.parametrize("name", list(MODELS))
def test_the_grammar_accepts_what_the_reader_reads(name):
    assert accepts(gbnf(), MODELS[name][0])


def test_the_grammar_rejects_what_the_reader_rejects():
    for text in ("model m {", "model { from x }", "source s { columns: { a int64 } }", "model m { from x filter }", "model m { from x select { a: b } }", "test t { expect }"):
        assert not accepts(gbnf(), text)
        with pytest.raises(ModelError):
            Project.from_text(text)
    assert accepts(gbnf(), SOURCES) and not list(unused(gbnf()))


def test_recogniser_of_ambiguous_grammars():
    g = 'root ::= a* "b"? [0-9]+\na ::= "x" | "xx" | "x" a'
    assert accepts(g, "x" * 60 + "b12") and accepts(g, "7") and not accepts(g, "xb") and not accepts(g, "x7y")
    with pytest.raises(ModelError):
        accepts("root ::= nothing", "x")


# -- editor service
def test_service_answers_an_editor():
    text = demo.STARTER
    uri = "file:///x.model"
    out = io.BytesIO()

    def framed(*messages):
        return io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(b), b) for b in (json.dumps(m).encode() for m in messages)))

    def at(word, nth=0):
        places = [(n, line.index(word)) for n, line in enumerate(text.splitlines()) if word in line]
        return {"textDocument": {"uri": uri}, "position": {"line": places[nth][0], "character": places[nth][1] + 1}}

    ask = lambda i, method, params: {"id": i, "method": f"textDocument/{method}", "params": params}
    document = {"textDocument": {"uri": uri}}
    messages = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "initialized"}, {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": uri, "text": text}}},
        ask(2, "hover", at("coalesce")), ask(3, "hover", at("refunds", 1)), ask(4, "completion", at("filter")), ask(5, "definition", at("Daily {", 1)), ask(6, "formatting", document),
        ask(7, "documentSymbol", document), ask(8, "rename", document), {"method": "textDocument/didChange", "params": document | {"contentChanges": [{"text": text.replace("country,", "land,")}]}},
        {"id": 9, "method": "shutdown"}, {"method": "exit"},
    ]
    assert serve(framed(*messages), out) == 0
    answers = [json.loads(x[x.index(b"{"):]) for x in out.getvalue().split(b"Content-Length: ")[1:]]
    by = {a["id"]: a for a in answers if "id" in a}
    told = [a["params"]["diagnostics"] for a in answers if a.get("method")]
    assert told[0] == [] and told[1][0]["code"] == "E040"
    assert "coalesce(" in by[2]["result"]["contents"]["value"] and "discount_usd: money" in by[3]["result"]["contents"]["value"]
    labels = {x["label"] for x in by[4]["result"]}
    assert {"filter", "upper", "orders", "gross_amount_usd", "net"} <= labels
    assert text.splitlines()[by[5]["result"]["range"]["start"]["line"]].startswith("contract Daily")
    assert Project.from_text(by[6]["result"][0]["newText"]).check()
    assert [s["name"] for s in by[7]["result"]] == ["orders", "refunds", "Daily", "daily_orders"] and by[8]["error"]["code"] == -32601
    assert serve(framed({"method": "exit"}), io.BytesIO()) == 1 and Service().handle({"method": "$/any"}) == []


# -- command line, demo, templates
def test_command_line_on_a_new_project(spark, tmp_path, capsys):
    assert main(["init", str(tmp_path)]) == 0
    file, data, store = str(tmp_path / "daily_orders.model"), str(tmp_path / "data"), str(tmp_path / "store")
    with pytest.raises(FileExistsError):
        demo.start(str(tmp_path))
    assert main(["seed", data]) == 0 and main(["check", file, "--strict"]) == 0 and main(["grammar", "--check", file]) == 0
    assert main(["compile", file, "--data", data]) == 0 and "Scan parquet" in capsys.readouterr().out
    where = ["--store", store, "--data", data]
    assert main(["test", file, "daily_orders", *where]) == 0 and main(["run", file, *where]) == 0
    run = Store(spark, store).history()[-1]["run"]
    capsys.readouterr()
    assert main(["dashboard", file, "--json", *where]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["models"]["daily_orders"]["run"] == run and found["models"]["daily_orders"]["stale"] is False
    assert main(["profile", file, "--data", data]) == 0 and "daily_orders" in capsys.readouterr().out
    kept = str(tmp_path / "golden")
    assert main(["golden", file, kept, "--update"]) == 0 and main(["golden", file, kept]) == 0
    old = tmp_path / "old.model"
    old.write_text(demo.STARTER + "model later { from daily_orders select { c = country, n = orders } }\n")
    changed = tmp_path / "new.model"
    changed.write_text(demo.STARTER.replace("orders = count()", "n = count()").replace("orders: int64 nonnull ", "n: int64 nonnull").replace("expect orders > 0", ""))
    assert main(["golden", str(changed), kept]) == 1
    capsys.readouterr()
    assert main(["diff", str(changed), str(old)]) == 1
    out = capsys.readouterr().out
    assert "E030" in out and "later.n" in out
    assert main(["schedule", file, "airflow", *where]) == 0 and "DAG('daily_orders'" in capsys.readouterr().out
    compile(templates.airflow("a", "m", "s", "d"), "x", "exec")
    compile(templates.prefect("a", "m", "s", "d"), "x", "exec")
    assert main(["run", file, *where]) == 0 and main(["replay", file, *where, "nothing"]) == 2


def test_fixtures_are_statements(spark, tmp_path, capsys):
    sql = tmp_path / "rows.sql"
    sql.write_text("-- orders of a test\nCREATE OR REPLACE TEMP VIEW s AS SELECT 1L AS id;\n\nCREATE OR REPLACE TEMP VIEW t AS SELECT 2L AS id;")
    file = tmp_path / "m.model"
    file.write_text(templates.module_text(templates.source_text("s", {"id": "int64"}, ["id"]), templates.model_text("m", "s", {"id": "id"}, "id > 0"), "test m { expect id == 1  expect row_count == 1 }"))
    assert main(["test", str(file), "--store", str(tmp_path / "store"), "--fixtures", str(sql)]) == 0
    assert "row_count == 1" in capsys.readouterr().out


# -- sinks and catalogs
def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    for ending in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / f"x.{ending}")
        sinks.write(df, path)
        assert Sources(spark, {"x": path}).raw("x").count() == 2
    sinks.write(df, "sink_table")
    assert spark.table("sink_table").count() == 2
    spark.sql("DROP TABLE sink_table")
    with pytest.raises(Exception, match="(?i)driver"):
        sinks.write(df, "jdbc:none://x", {"dbtable": "t"})


def test_catalog_publishes_all_of_a_run_or_nothing(spark, tmp_path):
    project = Project.from_text("source s { columns: { id: int64 } } model a { from s } model b { from a filter id > 1 }")
    store, db = Store(spark, str(tmp_path / "store")), f"published_{tmp_path.name.replace('-', '_')}"
    runner = Runner(project, store, Sources(spark, {"s": spark.createDataFrame([(1,), (2,)], "id long")}))
    first = runner.run().run
    catalog = Catalog(store, db)
    try:
        assert catalog.publish(first) == {"a": 2, "b": 1} == catalog.verify(first) == catalog.verify(first, independent=True)
        runner.sources = Sources(spark, {"s": spark.createDataFrame([(1,), (2,), (3,)], "id long")})
        second = runner.run().run
        with pytest.raises(ModelError, match="E100"):
            Catalog(store, db, "no_such_format").publish(second)
        assert catalog.record()["current"] == first and spark.table(f"{db}.a").count() == 2
        catalog.publish(second)
        assert spark.table(f"{db}.a").count() == 3
        catalog.rollback(first)
        assert spark.table(f"{db}.b").count() == 1
        assert catalog.gc(keep=0) == [second] == catalog.gc(keep=0, apply=True)
        for call in (catalog.verify, catalog.rollback, catalog.publish):
            with pytest.raises(ModelError):
                call("nothing" if call == catalog.publish else second)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_codes_of_rare_faults():
    source = "source s { columns: { id: int64, v: decimal(50,2) } } "
    with pytest.raises(ModelError, match="E070"):
        Project.from_text(source + "model m { from s }").check()
    with pytest.raises(ModelError, match="E095"):
        Project.from_text(source + "model m { partition_by [v] freshness 1h from s select { id = id } }").check()
    project = Project.from_text("source s { columns: { id: int64 } } model m { from s }")
    project.tests.append(ir.Test("m", [ir.ExpectValues("id", "like", 1)]))
    with pytest.raises(ModelError, match="E093"):
        project.check()
