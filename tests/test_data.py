"""Results of models on small tables, and the queries against their SQL."""

import datetime as dt
import os
from decimal import Decimal as D

import duckdb
import pytest

from modelgraph.errors import PinError
from modelgraph.plans import Project
from modelgraph.quality import pin, run_tests
from modelgraph.queries import oracle_sql, queries
from modelgraph.sources import Sources
from modelgraph.streaming import append_stream, streamable

SF = "/root/testdata/sf0.001"

TEXT = """
source orders { columns: { order_id: int64 nonnull, customer_id: int64 nonnull, country: string nonnull, gross: money nonnull, is_test: bool, order_day: date nonnull } }
source refunds { columns: { order_id: int64 nonnull, discount: money } }
source odd { columns: { id: int64 nonnull, xs: array(int64), doc: json, s: string, n: int64, f: float64, m: map(string, int64) } }
"""


@pytest.fixture(scope="module")
def tables(spark):
    day = dt.date
    orders = [(1, 1001, "ES", D("120.00"), False, day(2026, 9, 1)), (2, 1001, "ES", D("90.00"), False, day(2026, 9, 1)), (3, 1002, "MX", D("200.00"), False, day(2026, 9, 2)),
              (4, 1003, "BR", D("75.50"), False, day(2026, 9, 2)), (5, 1004, "CO", D("40.00"), True, day(2026, 9, 3))]
    odd = [(1, [3, None, 1], '{"a": {"b": [1, 2]}, "n": null, "x.y": 7, "t": "q\'s", "v": 1.5, "w": true}', "a\\b%c_d", 5, 2.0, {"p": 1}), (2, [], "[]", "", 0, 0.0, {}),
           (3, None, "null", None, None, None, None), (4, [7], "not json", "Été", -3, -1.5, {"q": None}), (5, [7], None, " x ", 5, 2.0, {"p": 1})]
    return Sources(spark, {
        "orders": spark.createDataFrame(orders, "order_id long, customer_id long, country string, gross decimal(38,2), is_test boolean, order_day date"),
        "refunds": spark.createDataFrame([(2, D("10.00")), (4, D("5.50"))], "order_id long, discount decimal(38,2)"),
        "odd": spark.createDataFrame(odd, "id long, xs array<long>, doc string, s string, n long, f double, m map<string,long>"),
    })


def rows(tables, text, name="x"):
    return [tuple(r) for r in Project.from_text(TEXT + text).frame(name, tables).collect()]


def odd(tables, *exprs, where=None):
    body = ", ".join(f"v{i} = {e}" for i, e in enumerate(exprs))
    out = rows(tables, f"model x {{ from odd {'filter ' + where if where else ''} select {{ id = id, {body} }} sort {{ id }} }}")
    return [r[1] if len(exprs) == 1 else r[1:] for r in out]


def test_revenue(tables):
    got = rows(tables, """model x { from orders join_left refunds on orders.order_id == refunds.order_id let net = gross - coalesce(refunds.discount, 0)
      filter coalesce(is_test, false) == false group {country} ( aggregate { n = count(), total = sum(net) } filter sum(gross) > cast(80, "money") ) sort { total desc, country } }""")
    assert got == [("ES", 2, D("200.00")), ("MX", 1, D("200.00"))]
    total = rows(tables, "model x { from orders filter not is_test select { t = sum(gross) over () } take 1 }")
    assert total == [(D("485.50"),)]


def test_division_null_and_casts(tables):
    assert odd(tables, "n / 0", "f / 0.0", "n % 0") == [(None, None, None)] * 5
    assert odd(tables, 'cast(f, "int64")', 'cast("2.5", "int64")', 'cast(cast(n, "string"), "int64")')[0] == (2, 3, 5)
    assert odd(tables, "n == null", "not (n == 5)", where="id == 1") == [(None, False)]
    assert rows(tables, "model x { from odd filter s == null }") == []


def test_strings(tables):
    assert odd(tables, 's like "a\\\\b%"', 's like "%c_d"')[0] == (True, True)
    assert odd(tables, "concat(s, n)") == ["a\\b%c_d5", "0", None, "Été-3", " x 5"]
    assert odd(tables, "substring(s, 0, 2)", "substring(s, -2)", "left(s, -1)", "right(s, 99)", "length(s)")[3] == ("É", "té", "Ét", "Été", 3)
    assert odd(tables, 'split_part(s, "\\\\", 0)', 'split_part(s, "\\\\", 2)', 'split_part(s, "\\\\", 9)')[0] == ("", "b%c_d", "")


def test_arrays(tables):
    assert odd(tables, "array_length(xs)") == [3, 0, None, 1, 1]
    assert odd(tables, "array_get(xs, 1)", "array_get(xs, -1)", "array_get(xs, 9223372036854775807)", "array_get(xs, 2)")[0] == (None, None, None, 1)
    assert odd(tables, "array_contains(xs, 9)", "array_contains(xs, null)") == [(False, None), (False, None), (None, None), (False, None), (False, None)]
    assert odd(tables, "array_append(xs, n)") == [[3, None, 1, 5], [0], None, [7, -3], [7, 5]]
    assert odd(tables, "array_prepend(null, xs)", "array_remove(xs, null)", "array_remove(xs, 7)", "array_index_of(xs, 1)", "array_sort(xs)")[0] == (None, [3, None, 1], [3, None, 1], 2, [1, 3, None])
    assert rows(tables, "model x { from odd expand xs as e select { id = id, e = e } sort { id, e } }") == [(1, 1), (1, 3), (1, None), (4, 7), (5, 7)]
    assert rows(tables, "model x { from odd expand xs select { xs = xs } dedup sort { xs } }") == [(1,), (3,), (7,), (None,)]
    assert rows(tables, "model x { from odd group {} ( aggregate { v = array_agg(n), none = array_agg(cast(null, \"string\")) } ) select { k = array_sort(v), z = none } }")[0][2] == [-3, 0, 5, 5]


def test_json(tables):
    assert odd(tables, 'json_get(doc, "n")', 'json_is_null(json_get(doc, "n"))', 'json_get(doc, "zz")', 'json_value(doc, "v")', 'json_value(doc, "w")', 'json_value(doc, "a")')[0] == ("null", True, None, "1.5", "true", None)
    assert odd(tables, 'json_path(doc, "$.a.b[1]")', 'json_value(doc, concat("x", ".y"))', 'json_value(doc, "t")', 'json_value(doc, concat("a", ""))')[0] == ("2", "7", "q's", None)
    assert odd(tables, "json_is_null(doc)")[:3] == [False, False, True]
    assert odd(tables, 'json_build("a", n, "b", s, "c", null)')[2] == '{"a":null,"b":null,"c":null}'


def test_maps_and_structs(tables):
    assert odd(tables, 'map_get(m, "p")', 'map_get(m, "")', 'struct_get(struct("k", n), "k")') == [(1, None, 5), (None, None, 0), (None, None, None), (None, None, -3), (1, None, 5)]
    got = rows(tables, "model p { from odd select { m = m } } model x { from p union p } ")
    assert len(got) == 4
    assert len(rows(tables, "model x { from odd select { m = m, n = n } dedup by n }")) == 4


def test_dates(tables):
    e = lambda s: f'cast("{s}", "date")'
    got = odd(tables, f"date_add({e('2024-02-29')}, years: 1)", f"date_add({e('2024-03-31')}, months: 1)", f"date_diff({e('2023-12-31')}, {e('2024-01-01')}, week)", f"date_diff({e('2024-01-31')}, {e('2024-02-01')}, month)",
              f"date_trunc({e('2024-05-16')}, week)", f"date_diff({e('2024-02-01')}, {e('2023-01-31')}, month)", f"date_add({e('2024-01-01')}, days: n)")[0]
    assert got == (dt.date(2025, 2, 28), dt.date(2024, 4, 30), 1, 1, dt.date(2024, 5, 13), -13, dt.date(2024, 1, 6))


def test_dedup_and_sort_put_nulls_last(tables):
    assert rows(tables, "model x { from odd select { n = n, f = f, id = id } dedup by n sort { n desc } }") == [(5, 2.0, 1), (0, 0.0, 2), (-3, -1.5, 4), (None, None, 3)]


def test_maps_compare_at_any_depth(spark):
    from modelgraph.operators import relational as rel

    df = spark.sql("""
      SELECT 1 AS id, map('a', 1, 'b', 2) AS m, named_struct('x', array(map('k', map('p', 1)))) AS s UNION ALL
      SELECT 1, map('b', 2, 'a', 1), named_struct('x', array(map('k', map('p', 1)))) UNION ALL
      SELECT 1, map('a', 1, 'b', 2), named_struct('x', array(map('k', map('p', 2)))) UNION ALL SELECT 2, NULL, NULL UNION ALL SELECT 2, NULL, NULL""")
    assert rel.distinct_rows(df).count() == 3 and rel.distinct_rows(df).schema.simpleString() == df.schema.simpleString()
    few = df.limit(1)
    assert rel.combine(df, few, "except", False).count() == 2 and rel.combine(df, few, "intersect", False).collect()[0].s.x == [{"k": {"p": 1}}]
    assert rel.combine(df, few, "union", False).count() == 3 and rel.dedup_by(df, ["id"]).count() == 2


def test_json_is_parsed_once_for_all_outputs(tables):
    text = """model x { from odd let d = json_get(doc, "a") select { a = json_get(d, "b"), n = json_is_null(json_get(doc, "n")), t = json_value(doc, "t"), c = json_build("q", d) } }"""
    df = Project.from_text(TEXT + text).frame("x", tables)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert [tuple(r) for r in df.collect()][0] == ("[1,2]", True, "q's", '{"q":{"b":[1,2]}}')


def test_windows_without_order(tables):
    assert odd(tables, "rank() over (partition_by: [n])", "sum(id) over (sort: [id])")[-1] == (1, 15)


def test_windows_that_follow_from_keys_hold_no_partition(spark):
    for name in ("window_ranking", "window_aggregates"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("windowspecdefinition(o_custkey") == {"window_ranking": 1, "window_aggregates": 4}[name]
        assert "windowspecdefinition(o_orderstatus" not in plan and plan.count("Join LeftOuter") == 1  # a row for each key, beside the rows


def test_windows_by_odd_keys(spark):
    part, sort = [None, "a", "b", ""], [1.5, 0.0, -0.0, None, float("nan"), -2.0]
    data = [(i, part[i % 4], sort[i % 6], [None, 3, 1][i % 3]) for i in range(60)]
    text = "source s { columns: { id: int64 nonnull, k: string, f: float64, n: int64 } } "
    sources = Sources(spark, {"s": spark.createDataFrame(data, "id long, k string, f double, n long")})
    up = lambda f: (f is None, f != f, 0.0 if f is None or f != f else f)  # noqa: E731  nulls last, NaN before them
    down = lambda f: (f is None, f == f, 0.0 if f is None or f != f else -f)
    got = Project.from_text(text + """model x { from s select { id = id, u = rank() over (partition_by: [k], sort: [f]), d = dense_rank() over (partition_by: [k], sort: [f desc]), w = rank() over (sort: [f desc]),
      t = sum(n) over (partition_by: [upper(k), n]), c = count(n) over (partition_by: [f]), v = u + d } sort { id } }""").frame("x", sources).collect()
    assert len(got) == 60
    for (i, k, f, n), r in zip(data, got, strict=True):
        peers = [x for x in data if x[1] == k]
        u, d = 1 + sum(up(x[2]) < up(f) for x in peers), 1 + len({down(x[2]) for x in peers if down(x[2]) < down(f)})
        t = [x[3] for x in peers if x[3] == n and n is not None]
        c = sum(x[3] is not None for x in data if x[2] == f or (x[2] != x[2] and f != f and None not in (x[2], f)))
        assert tuple(r) == (i, u, d, 1 + sum(down(x[2]) < down(f) for x in data), sum(t) if t else None, c, u + d)
    one = Project.from_text(text + "model x { from s filter id > 99 select { u = rank() over (partition_by: [k], sort: [f]), t = sum(n) over (partition_by: [k]) } }")
    assert one.frame("x", sources).collect() == []


def test_windows_of_rows_that_may_differ_or_of_windows_stay(tables):
    plan = lambda text: Project.from_text(TEXT + text).frame("x", tables)._jdf.queryExecution().optimizedPlan().toString()
    ranked = "select { id = id, r = rank() over (partition_by: [s], sort: [n]) }"
    assert "Join" in plan(f"model x {{ from odd {ranked} }}")
    assert "Join" not in plan(f"model y {{ from odd take 3 }} model z {{ from y }} model x {{ from z {ranked} }}")
    assert "Join" not in plan(f"model y {{ from odd select {{ id = row_number() over (partition_by: [s], sort: [n]), n = n, s = s }} }} model x {{ from y {ranked} }}")
    assert "Join" not in plan("model y { from odd group {n} ( aggregate { s = avg(f), id = count() } ) } model x { from y select { r = rank() over (sort: [s]), t = sum(id) over (partition_by: [s]) } }")
    assert "Join" not in plan(f"model y {{ from odd select {{ id = id, n = row_number() over (), s = s }} }} model x {{ from y {ranked} }}")
    assert "Join" not in plan("model x { from odd select { v = row_number() over (partition_by: [s]), t = sum(n) over (partition_by: [s]), r = rank() over (partition_by: [s], sort: [n]) } }")
    assert odd(tables, "rank() over (partition_by: [n], sort: [f])", "row_number() over (sort: [id])", "sum(v0) over (partition_by: [f])", "sum(v1) over (partition_by: [n])") == [(1, 1, 2, 6), (1, 2, 1, 2), (1, 3, 1, 3), (1, 4, 1, 4), (1, 5, 2, 6)]


def test_pins_and_tests(tables):
    p = Project.from_text(TEXT + """contract C { order_id: int64 nonnull unique  country: string nonnull enum {ES, MX, BR, CO} }
      model x -> contract C { from orders } model y { from refunds } test x { expect row_count == 5  expect order_id > 0  expect country != "FR" } test y { expect order_id in x.order_id  expect row_count < 3 }""")
    p.check()
    frame = lambda n: p.frame(n, tables)
    pin(frame("x"), p.contracts["C"], "x")
    assert len(run_tests(p.tests, frame)) == 5
    df = frame("x")
    for bad, what in ((df.union(df), "unique"), (df.drop("country"), "missing"), (df.selectExpr("order_id", "'FR' AS country"), "isn't one of"), (df.selectExpr("CAST(NULL AS BIGINT) AS order_id", "country"), "null"), (df.selectExpr("CAST(order_id AS STRING) AS order_id", "country"), "string")):
        with pytest.raises(PinError, match=what):
            pin(bad, p.contracts["C"], "x")
    pin(df.selectExpr("CAST(order_id AS INT) AS order_id", "country"), p.contracts["C"], "x")


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["filter_position"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_stream_appends(spark, tables, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string").write.parquet(f"{tmp_path}/in")
    p = Project.from_text('source s { columns: { id: int64 nonnull, k: string } } source r { columns: { id: int64, name: string } } model x { from s join_left r on s.id == r.id filter id > 1 select { id = id, name = r.name } } model g { from s group {k} ( aggregate { n = count() } ) }')
    assert streamable(p, "x") and not streamable(p, "g")
    sources = Sources(spark, {"r": spark.createDataFrame([(2, "two"), (3, "three")], "id long, name string")})
    for _ in range(2):
        stream = spark.readStream.schema("id long, k string").parquet(f"{tmp_path}/in")
        append_stream(p, "x", stream, sources, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
        spark.createDataFrame([(3, "c")], "id long, k string").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(2, "two"), (3, "three")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(oracle_sql()[name])
    titles = [d[0] for d in cursor.description]
    assert sorted(titles) == columns
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(norm(dict(zip(titles, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(norm(v) for v in r) for r in got.select(columns).collect()), key=repr) == want
