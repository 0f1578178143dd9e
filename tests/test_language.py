"""Text front end, checker, error codes, lineage, diff, lint, printing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelgraph import ir
from modelgraph.dsl import model as build
from modelgraph.errors import ModelError
from modelgraph.functions import CATALOG
from modelgraph.lineage import blast_radius, changes, graph
from modelgraph.lint import lint
from modelgraph.plans import Project
from modelgraph.syntax import read_expression, read_module
from modelgraph.syntax.printer import expression, module

BASE = """
source s { columns: { id: int64 nonnull, k: string, a: string, n: int64, f: float64, m: money, e: money(EUR), d: date nonnull, t: timestamp, b: bool, j: json,
  xs: array(int64), ys: array(string) nonnull, js: array(json), mm: map(string, int64), st: struct<p: int64, q: string> } }
source r { columns: { id: int64 nonnull, name: string nonnull } }
contract C { id: int64 nonnull }
"""


def compiled(body, extra=""):
    return Project.from_text(f"{BASE}{extra}model x {{ {body} }}").check()["x"]


def code(body, extra=""):
    with pytest.raises(ModelError) as e:
        compiled(body, extra)
    return e.value.code


def kind(text):
    c = compiled("from s group {k} ( aggregate { v = %s } )" % text if text.startswith(("count", "sum", "avg", "max", "min", "array_agg")) and "over" not in text else "from s select { v = %s }" % text).schema["v"]
    return f"{c.type}{'' if c.nullable else '!'}"


@pytest.mark.parametrize(("text", "want"), [
    ("n + 1", "int64"), ("id * 2", "int64!"), ("n / 2", "float64"), ("f + n", "float64"), ("m + m", "money(USD)"), ("m * n", "money(USD)"), ("m / m", "float64"),
    ("a || k", "string"), ('a + "x"', "string"), ("n == 1 and b", "bool"), ("not b", "bool"), ("-n", "int64"), ("null == n", "bool"), ('a like "%"', "bool"),
    ("coalesce(n, 0)", "int64!"), ("coalesce(m, 0)", "money(USD)!"), ("if(b, 1, 2.5)", "float64!"), ("case(b, 1)", "int64"), ("case(b, 1, 0)", "int64!"),
    ('cast(n, "decimal(10,2)")', "decimal(10,2)"), ("length(a)", "int64"), ("substring(a, 1)", "string"), ('split_part(a, ",", 1)', "string"),
    ("date_add(d, days: 1)", "date!"), ("date_add(d, days: n)", "date"), ("date_trunc(t, month)", "timestamp"), ("date_diff(d, d, week)", "int64!"),
    ("array_construct(1, null)", "array(int64)!"), ("array_get(xs, 0)", "int64"), ("array_length(ys)", "int64!"), ("array_contains(ys, \"x\")", "bool!"), ("array_append(ys, \"x\")", "array(string)"),
    ('map("a", 1)', "map(string,int64)!"), ('map_get(mm, "a")', "int64"), ('struct("p", n)', "struct<p:int64>!"), ('struct_get(st, "q")', "string"), ('struct_get(st, "zz")', "unknown"),
    ('json_get(j, "k")', "json"), ('json_value(j, a)', "string"), ('json_path(j, "$.a[0].b")', "json"), ('json_build("k", n)', "json"), ("json_is_null(j)", "bool"),
    ("count()", "int64!"), ("count(distinct n)", "int64!"), ("sum(m)", "money(USD)"), ("avg(n)", "float64"), ("array_agg(n)", "array(int64)"),
    ("row_number() over ()", "int64!"), ("lag(id) over (sort: [id])", "int64"), ("sum(id) over (partition_by: [k])", "int64!"),
])
def test_types(text, want):
    assert kind(text) == want


@pytest.mark.parametrize(("body", "want"), [
    ("from nowhere", "E020"), ("from s select { v = zz }", "E040"), ("from s select { v = q.id }", "E041"), ("from s select { v = s.zz }", "E040"),
    ("from s filter a > 1", "E051"), ("from s filter m > 1", "E051"), ("from s filter n and b", "E052"), ("from s select { v = m + n }", "E053"), ("from s select { v = m + e }", "E053"),
    ("from s select { v = nosuch(n) }", "E059"), ("from s select { v = sum(n) }", "E056"), ("from s group {k} ( aggregate { v = n + 1 } )", "E050"),
    ("from s select { v = upper() }", "E062"), ("from s select { v = upper(n) }", "E063"), ("from s select { v = count(*) over () }", "E064"), ("from s select { v = upper(*) }", "E064"),
    ("from s select { v = row_number() }", "E065"), ("from s filter row_number() over () > 1", "E065"), ("from s let v = rank() over () select { v = v }", "E065"),
    ("from s select { v = upper(a) over () }", "E065"), ("from s select { v = sum(rank() over ()) over () }", "E065"), ("from s sort { rank() over () }", "E065"),
    ("from s select { v = coalesce(a, n) }", "E058"), ("from s select { v = if(n, 1, 2) }", "E090"), ("from s select { v = case(b, a, 1) }", "E058"),
    ("from s select { v = date_add(d, hours: 1) }", "E071"), ("from s select { v = date_add(d, 1) }", "E072"), ("from s select { v = date_diff(d, t, day) }", "E073"), ("from s select { v = date_trunc(d, hour) }", "E071"),
    ('from s select { v = json_get(j, "a.b") }', "E074"), ('from s select { v = json_path(j, "$..a") }', "E074"), ("from s select { v = json_path(j, a) }", "E074"), ('from s select { v = json_build("a b", 1) }', "E074"),
    ("from s expand n", "E075"), ("from s expand xs expand ys", "E075"), ("from s expand xs as id", "E075"), ("from s union r", "E076"), ("from s dedup by n + 1", "E076"), ("from s select { v = n } dedup by id", "E076"),
    ("from s join_inner r on s.id < r.id expect many_to_one", "E079"), ("from s join_semi r on s.id == r.id expect many_to_one", "E079"), ("from s join_inner r on s.id == r.id or b expect one_to_one", "E079"),
    ("from s select { v = sum(distinct n) }", "E096"), ("from s select { v = count(distinct n) over () }", "E096"), ("from s select { v = array_contains(js, j) }", "E063"), ("from s select { v = array_sort(js) }", "E063"),
    ('from s select { v = map(n, 1) }', "E063"), ("from s select { v = array_construct(1, a) }", "E063"), ("from s from r", "E076"), ("from s select { v = array_get(null, 0) }", "E063"),
    ("incremental merge_strategy: twist cdc_column: id from s", "E086"), ("incremental merge_strategy: append cdc_column: v from s group {k} ( aggregate { v = max(id) } )", "E087"),
    ("incremental merge_strategy: append from s", "E088"), ("incremental merge_strategy: upsert cdc_column: id from s", "E089"), ("from s select { v = b: 1 }", "F003"),
])
def test_error_codes(body, want):
    assert code(body) == want


def test_contract_codes():
    make = lambda c, body="from s": Project.from_text(f"{BASE} contract D {{ {c} }} model x -> contract D {{ {body} }}").check()
    for text, want in (("zz: int64", "E010"), ("id: string", "E011"), ("n: int64 nonnull", "E012"), ("n: int64 enum {a}", "E013"), ("id: float64 nonnull", None), ("a: string enum {x, y}", None)):
        if want is None:
            make(text)
        else:
            with pytest.raises(ModelError) as e:
                make(text)
            assert e.value.code == want
    with pytest.raises(ModelError) as e:
        Project.from_text(BASE + "model x -> contract Nope { from s }").check()
    assert e.value.code == "E061"
    with pytest.raises(ModelError) as e:
        Project.from_text(BASE + "model x { from s }").check(strict=True)
    assert e.value.code == "E014"


def test_set_operation_codes():
    extra = "model p { from s select { x = id, y = a } } model q { from s select { y = a, x = id } } model w { from s select { x = id, y = m } } model g { from s select { x = f, y = a } }"
    assert code("from p union q", extra) == "E077"
    assert code("from p union w", extra) == "E077"
    assert code("from p join_left r on p.x == r.id union g", extra) == "E076"
    assert code("from p union g filter x > 1 union g", extra) == "E076"
    c = compiled("from p union all g union g select { x = x, y = g.y }", extra)
    assert str(c.schema["x"].type) == "float64"


def test_test_codes():
    for text, want in (("test zz { expect row_count > 1 }", "E091"), ("test x { expect zz > 1 }", "E092"), ('test x { expect n > "1" }', "E094"), ("test x { expect id in y.id }", "E101"), ("test x { expect id in x.zz }", "E102")):
        with pytest.raises(ModelError) as e:
            Project.from_text(BASE + "model x { from s } " + text).check()
        assert e.value.code == want


def test_cycles_domains_imports_and_functions():
    for text, want in (
        ("model p { from q } model q { from p }", "F001"), ("domain a = b domain b = a", "E078"), ("domain a = nosuch", "E078"), ("import other.thing", "E022"), ("nosuch(1)", "F041"),
        ("fn f(x: Str) -> Model { x } f(1)", "F043"), ("fn f() -> Model { y } f()", "F040"), ("pipeline p { env: prod, models: [x] }", None), ("model v { from bare } source bare", "E021"),
    ):
        if want is None:
            Project.from_text(BASE + text).check()
            continue
        with pytest.raises(ModelError) as e:
            Project.from_text(BASE + text).check()
        assert e.value.code == want, text
    files = {"a": "import b model x { from y }", "b": "import c source y { columns: { id: key } }", "c": "domain key = int64"}
    p = Project(read_module("import a"), lambda n: read_module(files[n]))
    assert str(p.check()["x"].schema["id"].type) == "int64"
    files["c"] += " import a"
    with pytest.raises(ModelError) as e:
        Project(read_module("import a"), lambda n: read_module(files[n]))
    assert e.value.code == "F045"
    p = Project.from_text(BASE + 'fn pick(ns: List<Str>) -> List<Model> { [ model "m_${n}" { from s filter s.k == n take 3 } for n in ns ] } pick(["x", "y"]) pipeline p { models: [pick(["x"])], env: prod }')
    assert list(p.check()) == ["m_x", "m_y"] and p.pipeline_models(p.pipelines[0]) == ["m_x"]


def test_lineage_and_blast_radius():
    p = Project.from_text(BASE + "model x { from s join_left r on s.id == r.id let u = upper(a) group {k, r.name} ( aggregate { v = sum(n), w = count(distinct u) } ) select { z = rank() over (sort: [v]) } } model y { from x select { q = v + 1, k = k } }")
    m = p.check()
    found = {n: [(o.node, o.column, o.kind) for o in os] for n, os in m["x"].lineage.items()}
    assert found == {"k": [("s", "k", "grouped")], "name": [("r", "name", "grouped")], "v": [("s", "n", "aggregated")], "w": [("s", "a", "aggregated")], "z": [("s", "n", "windowed")]}
    assert blast_radius(m, [("s", "n")]) == {("s", "n"), ("x", "v"), ("x", "z"), ("y", "q")}
    assert ("s", "a") in m["x"].reads and ("r", "id") in m["x"].reads
    assert graph(m, "mermaid").count("-->") == 3


def test_semantic_diff_and_lint():
    old = Project.from_text(BASE + "model x { from s select { id = id, n = n, gone = a } }")
    new = Project.from_text(BASE + "model x { from s select { id = n, n = f, more = a } }")
    found = {(c.column, c.kind, c.breaking) for c in changes(old.check(), new.check())}
    assert found == {("id", "narrowed", True), ("n", "retyped", True), ("gone", "removed", True), ("more", "added", False)}
    warnings = lint(Project.from_text(BASE + 'contract P { a: string classification: "pii" } model x { from s } model y -> contract P { owner: "me" from s select { a = a } } model z { from s }'))
    assert [w.split(":")[0] for w in warnings] == ["W001 x", "W001 z", "W002 x", "W002 z", "W003 x", "W003 z", "W004 y.a", "W005 x", "W005 y", "W005 z", "W006 z"]


def test_fingerprint_ignores_layout_and_follows_upstream():
    a = Project.from_text(BASE + "model x { from s filter n > 1 } model y { from x }").check()
    b = Project.from_text(BASE + "// a remark\nmodel x {\n from s\n where (n > 1)\n}\nmodel y { owner: \"o\" from x }").check()
    c = Project.from_text(BASE + "model x { from s filter n > 2 } model y { from x }").check()
    assert a["x"].fingerprint == b["x"].fingerprint and a["y"].fingerprint == b["y"].fingerprint
    assert a["x"].fingerprint != c["x"].fingerprint and a["y"].fingerprint != c["y"].fingerprint


TEXT = BASE + """
domain key = int64
fn f(ns: List<Str>) -> List<Model> { [ model "m_${n}" { from s filter s.k == n } for n in ns ] }
model "x" -> contract C {
  owner: "me \\"quoted\\""
  partition_by [k]
  freshness daily freshness_column: t
  incremental merge_strategy: upsert merge_keys: [id] cdc_column: t
  from s join_left r on s.id == r.id and (s.n > 1 or not s.b) expect many_to_one
  let u = -n * (2 + 3) - 4.5 filter a like "%x\\n" or a in ["p", "q"]
  select { id = id, t = t, v = sum(n) over (partition_by: [k, a], sort: [d desc, n]), w = date_add(d, days: 2), j = json_build("k", null) }
  dedup by id sort { id desc, t } take 3..9
}
model y { from s expand xs as q group {k, upper(a)} ( aggregate { c = count(distinct n), z = count(*) } filter max(n) > 1 sort { k } take 5 ) }
model z { from y union all y except y }
f(["a", "b"])
test y { expect row_count >= 1 expect k in y.k expect c != -3 }
pipeline p { env: prod, models: [y, f(["a"])], sources: { s: from(ns: "n", dataset: "d") } }
"""


def test_printing_reads_back_as_the_same():
    m = read_module(TEXT)
    again = read_module(module(m))
    for x in (*m.models, *again.models):
        x.line = None
    strip = lambda e: repr(e).replace("line=", "")
    assert module(again) == module(m)
    assert [strip(x) for x in again.models] == [strip(x) for x in m.models]
    assert again.tests == m.tests and again.calls == m.calls


names = st.sampled_from(["a", "b", "day"])
leaves = st.one_of(st.integers(0, 99).map(ir.Lit), st.booleans().map(ir.Lit), st.text("ab\"\\\n%$ ", max_size=4).map(ir.Lit), names.map(ir.Ref), st.just(ir.Lit(None)), st.builds(ir.Ref, names, names))
trees = st.recursive(
    leaves,
    lambda e: st.one_of(
        st.builds(ir.Binary, st.sampled_from(["+", "-", "*", "/", "%", "||", "==", "<", "and", "or", "like"]), e, e),
        st.builds(ir.Unary, st.sampled_from(["not", "-"]), e),
        st.builds(lambda n, a: ir.Call(n, tuple(a)), names, st.lists(e, max_size=3)),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_expressions_print_and_read_back(e):
    assert read_expression(expression(e)) == e


@settings(max_examples=200, deadline=None)
@given(st.text("model from s {}()[]=<>!\"\\ \n.,:|&0123abc-", max_size=60))
def test_reader_never_crashes(text):
    try:
        read_module(text)
    except ModelError:
        pass


def test_take_range_spellings_and_builder():
    want = ir.Take(10, 0)
    for text in ("take 1..10", "take 1 .. 10", "take 1.. 10", "take 10"):
        assert read_module("model x { from s %s }" % text).models[0].statements[1] == want
    m = build("x", owner="me").from_("s").join("left", "r", "s.id == r.id").let(u="upper(a)").filter("n > 1").group(["k"], having="count() > 1", c="count()").sort("c desc").take(5).build()
    text = read_module('model x { owner: "me" from s join_left r on s.id == r.id let u = upper(a) filter n > 1 group {k} ( aggregate { c = count() } filter count() > 1 ) sort { c desc } take 5 }').models[0]
    assert m.statements == text.statements
    assert len(CATALOG) == 59


def test_grammar_is_whole_and_metrics_render():
    from modelgraph.metrics import Metrics
    from modelgraph.syntax.grammar import gbnf, undefined

    assert undefined() == set() and gbnf().startswith("root")
    m = Metrics("x")
    m.count("runs", model='a"b')
    m.gauge("rows", 5)
    with pytest.raises(ValueError), m.timed("job"):
        raise ValueError
    text = m.prometheus()
    assert 'x_runs_total{model="a\\"b"} 1' in text and "x_rows 5" in text and "x_job_seconds_count 1" in text and "x_job_failures_total 1" in text
    assert m.statsd()[0].startswith("x.job_failures:1|c") and '"rows"' in m.json()
