"""Queries that exercise each operator on the star schema, with their SQL.

Each entry is a model in the text language and the SQL that gives its rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .errors import ModelError, PinError
from .importer import import_project
from .metrics import Metrics
from .operators import incremental
from .plans import Project
from .quality import pin, violations
from .runs import Runner, Store
from .sources import Sources
from .syntax import read_module
from .syntax.grammar import gbnf
from .syntax.printer import module as print_module
from .syntax.recogniser import accepts
from .tooling import demo

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = """
source region   { columns: { r_regionkey: int64 nonnull, r_name: string nonnull } }
source nation   { columns: { n_nationkey: int64 nonnull, n_name: string nonnull, n_regionkey: int64 nonnull } }
source customer { columns: { c_custkey: int64 nonnull, c_name: string nonnull, c_nationkey: int64 nonnull, c_acctbal: float64, c_mktsegment: string } }
source supplier { columns: { s_suppkey: int64 nonnull, s_name: string, s_nationkey: int64, s_acctbal: float64 } }
source part     { columns: { p_partkey: int64 nonnull, p_name: string, p_brand: string, p_type: string, p_size: int64, p_retailprice: float64 } }
source orders   { columns: { o_orderkey: int64 nonnull, o_custkey: int64 nonnull, o_orderstatus: string nonnull, o_totalprice: float64, o_orderdate: timestamp nonnull, o_orderpriority: string } }
source lineitem { columns: { l_orderkey: int64 nonnull, l_partkey: int64, l_suppkey: int64, l_linenumber: int64, l_quantity: float64, l_extendedprice: float64,
                             l_discount: float64, l_tax: float64, l_returnflag: string nonnull, l_linestatus: string nonnull, l_shipdate: timestamp } }
source events   { columns: { event_id: int64 nonnull, ts: timestamp nonnull, user_id: int64, event_type: string, value: float64, props: json } }
"""

#: name: (models in the text language; the one of that name is the query, SQL)
MODELS: dict[str, tuple[str, str]] = {}


def _add(name: str, text: str, sql: str) -> None:
    MODELS[name] = (text, sql)


# -- scans, projections, predicates ------------------------------------------

_add("daily_revenue", """
model daily_revenue {
  from orders
  join_left lineitem on orders.o_orderkey == lineitem.l_orderkey
  let day = cast(orders.o_orderdate, "date")
  let gross = cast(lineitem.l_extendedprice, "money")
  let off = gross * cast(coalesce(lineitem.l_discount, 0.0), "decimal(4,2)")
  filter orders.o_orderstatus != "P"
  group {day, upper(o_orderstatus)} (
    aggregate { lines = count(lineitem.l_linenumber), orders = count(distinct o_orderkey), gross_total = sum(gross), net_total = sum(gross - off) }
  )
  sort {day, g1}
}""", """
SELECT CAST(o_orderdate AS DATE) AS day, upper(o_orderstatus) AS g1, count(l_linenumber) AS lines, count(DISTINCT o_orderkey) AS orders,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(38,2))) AS DECIMAL(38,2)) AS gross_total,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(38,2)) - CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(coalesce(l_discount, 0.0) AS DECIMAL(4,2)) AS DECIMAL(38,2))) AS DECIMAL(38,2)) AS net_total
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")

_add("scan_passthrough", "model scan_passthrough { from nation }", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")

_add("filter_position", """
model filter_position {
  from lineitem
  filter l_quantity > 10.0
  select { k = l_orderkey, n = l_linenumber, price = l_extendedprice }
  where l_returnflag == "R" or l_returnflag == "A" and not (l_linenumber == 1)
}""", """
SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_extendedprice AS price FROM lineitem
WHERE l_quantity > 10 AND (l_returnflag = 'R' OR l_returnflag = 'A' AND NOT l_linenumber = 1)""")

_add("let_derive", """
model let_derive {
  from lineitem
  let net = l_extendedprice * (1.0 - l_discount)
  derive { k = l_orderkey, n = l_linenumber, net = net, taxed = net * (1.0 + l_tax), neg = -l_linenumber, rest = l_linenumber % 3, half = l_linenumber / 2 }
}""", """
SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_extendedprice * (1.0 - l_discount) AS net,
  l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax) AS taxed, CAST(-l_linenumber AS BIGINT) AS neg, CAST(l_linenumber % 3 AS BIGINT) AS rest, l_linenumber / 2 AS half FROM lineitem""")

_add("let_shadowing", """
model let_shadowing {
  from part
  let p_brand = lower(p_brand)
  filter p_brand != "brand#11"
  select { p_partkey = p_partkey, p_brand = p_brand, original = part.p_brand, both = p_brand || "/" || part.p_brand }
}""", """
SELECT p_partkey, lower(p_brand) AS p_brand, p_brand AS original, lower(p_brand) || '/' || p_brand AS "both" FROM part WHERE p_brand <> 'brand#11'""")

_add("let_passthrough", """
model let_passthrough {
  from region
  let loud = upper(r_name)
}""", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, upper(r_name) AS loud FROM region")

_add("lateral_alias", """
model lateral_alias {
  from supplier
  select { s_suppkey = s_suppkey, twice = s_suppkey * 2, fourfold = twice * 2 }
}""", "SELECT s_suppkey, s_suppkey * 2 AS twice, s_suppkey * 4 AS fourfold FROM supplier")

_add("conditionals", """
model conditionals {
  from events
  select { event_id = event_id, size = if(value > 50.0, "big", "small"), kind = case(event_type == "view", 1, event_type == "click", 2, event_type == "error", null, 9),
           bare = case(event_type == "purchase", "paid"), filled = coalesce(value, 0), never = if(value == null, 1, 2) }
}""", """
SELECT event_id, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS size,
  CAST(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'error' THEN NULL ELSE 9 END AS BIGINT) AS kind,
  CASE WHEN event_type = 'purchase' THEN 'paid' END AS bare, coalesce(value, 0.0) AS filled, CAST(2 AS BIGINT) AS never FROM events""")

_add("casts", """
model casts {
  from lineitem
  select { k = l_orderkey, n = l_linenumber, whole = cast(l_extendedprice, "int64"), text = cast(l_linenumber, "string"), exact = cast(l_extendedprice, "decimal(12,2)"),
           day = cast(l_shipdate, "date"), back = cast(cast(l_orderkey, "string"), "int64"), ratio = cast(l_linenumber, "float64") }
}""", """
SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(CAST(l_extendedprice AS DECIMAL(38,10)) AS BIGINT) AS whole, CAST(l_linenumber AS VARCHAR) AS text,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS exact, CAST(l_shipdate AS DATE) AS day, l_orderkey AS back, CAST(l_linenumber AS DOUBLE) AS ratio FROM lineitem""")

_add("money_math", """
model money_math {
  from supplier
  let m = cast(s_acctbal, "money")
  select { s_suppkey = s_suppkey, plus = m + m, minus = m - cast(1, "money"), times = m * 3, ratio = m / cast(4, "money"), above = m > cast(100, "money") }
}""", """
SELECT s_suppkey, CAST(m + m AS DECIMAL(38,2)) AS plus, CAST(m - 1 AS DECIMAL(38,2)) AS minus, CAST(m * 3 AS DECIMAL(38,2)) AS times,
  CAST(m AS DOUBLE) / 4.0 AS ratio, m > 100 AS above FROM (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(38,2)) AS m FROM supplier)""")

_add("null_logic", """
model null_logic {
  from events
  let v = if(event_type == "view", null, value)
  select { event_id = event_id, big = v > 10.0, both = v > 10.0 and event_type == "view", either = v > 10.0 or event_type == "view", joined = event_type || cast(v, "string") == null }
}""", """
SELECT event_id, v > 10 AS big, v > 10 AND event_type = 'view' AS "both", v > 10 OR event_type = 'view' AS either, CAST(NULL AS BOOLEAN) AS joined
FROM (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events)""")

_add("in_list", 'model in_list { from orders filter o_orderstatus in ["F", "O"] select { o_orderkey = o_orderkey } }', "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")

# -- joins ---------------------------------------------------------------------

_add("join_inner_multi", """
model join_inner_multi {
  from customer
  join_inner nation on customer.c_nationkey == nation.n_nationkey expect many_to_one
  join_inner region on nation.n_regionkey == region.r_regionkey expect many_to_one
  filter region.r_name != "ASIA"
  select { c_custkey = c_custkey, nation = nation.n_name, region = region.r_name }
}""", "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")

_add("join_left_passthrough", """
model join_left_passthrough {
  from nation
  join_left supplier on nation.n_nationkey == supplier.s_nationkey
}""", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, s_suppkey AS __j1_s_suppkey, s_name AS __j1_s_name,
  CAST(s_nationkey AS BIGINT) AS __j1_s_nationkey, s_acctbal AS __j1_s_acctbal FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""")

_add("join_semi", "model join_semi { from customer join_semi orders on customer.c_custkey == orders.o_custkey and orders.o_totalprice > 300000.0 select { c_custkey = c_custkey } }",
     "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")

_add("join_anti", 'model join_anti { from customer join_anti orders on customer.c_custkey == orders.o_custkey and orders.o_orderpriority == "1-URGENT" }',
     "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")

_add("join_theta", """
model join_theta {
  from region
  join_inner nation on region.r_regionkey < nation.n_regionkey and nation.n_nationkey > 3
  select { r = r_name, n = nation.n_name }
}""", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey < n_regionkey AND n_nationkey > 3")

_add("join_after_union", """
model asian { from nation filter n_regionkey == 2 }
model african { from nation filter n_regionkey == 0 }
model join_after_union {
  from asian
  union african
  join_left region on asian.n_regionkey == region.r_regionkey
  filter n_nationkey > 1
  select { n_nationkey = n_nationkey, region = region.r_name }
}""", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey IN (0, 2) AND n_nationkey > 1")

# -- groups ---------------------------------------------------------------------

_add("group_having", """
model group_having {
  from lineitem
  group {l_suppkey, l_returnflag} (
    aggregate { lines = count(), filled = count(l_tax), qty = sum(l_quantity), least = min(l_shipdate), most = max(l_shipdate), mean = avg(l_linenumber), lines_sum = sum(l_linenumber) }
    filter count(distinct l_orderkey) > 3 and sum(l_linenumber) > 10
  )
}""", """
SELECT l_suppkey, l_returnflag, count(*) AS lines, count(l_tax) AS filled, sum(l_quantity) AS qty, min(l_shipdate) AS least, max(l_shipdate) AS most,
  avg(l_linenumber) AS mean, CAST(sum(l_linenumber) AS BIGINT) AS lines_sum FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 3 AND sum(l_linenumber) > 10""")

_add("global_aggregate", """
model global_aggregate {
  from orders
  filter o_orderstatus == "F"
  group {} ( aggregate { n = count(*), customers = count(distinct o_custkey), last = max(o_orderdate) } )
}""", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F'")

_add("group_by_expression", """
model group_by_expression {
  from orders
  group {date_trunc(o_orderdate, month), o_orderstatus} ( aggregate { n = count(), o_status = o_orderstatus } )
  select { share = n * 2 }
}""", "SELECT date_trunc('month', o_orderdate) AS g0, o_orderstatus, count(*) AS n, o_orderstatus AS o_status, count(*) * 2 AS share FROM orders GROUP BY g0, o_orderstatus")

_add("group_keys_only", "model group_keys_only { from lineitem group {l_returnflag, l_linestatus} () }", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

_add("array_aggregate", """
model lists { from events group {user_id} ( aggregate { ids = array_agg(event_id), nothing = array_agg(cast(null, "int64")) } ) }
model array_aggregate {
  from lists
  select { user_id = user_id, n = array_length(ids), first = array_get(array_sort(ids), 0), none = array_length(nothing) }
}""", "SELECT user_id, count(event_id) AS n, min(event_id) AS first, CAST(NULL AS BIGINT) AS none FROM events GROUP BY user_id")

_add("group_sort_take", """
model group_sort_take {
  from lineitem
  group {l_partkey} ( aggregate { n = count() } sort { n desc, l_partkey } take 7 )
}""", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 7")

# -- windows ---------------------------------------------------------------------

_add("window_ranking", """
model window_ranking {
  from orders
  select { o_orderkey = o_orderkey,
    rn = row_number() over (partition_by: [o_custkey], sort: [o_orderdate desc, o_orderkey]),
    rk = rank() over (partition_by: [o_orderstatus], sort: [o_orderpriority]),
    dr = dense_rank() over (sort: [o_orderpriority desc], partition_by: [o_orderstatus]),
    flat = rank() over (partition_by: [o_orderstatus]) }
}""", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk,
  dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC) AS dr, rank() OVER (PARTITION BY o_orderstatus) AS flat FROM orders""")

_add("window_offsets", """
model window_offsets {
  from events
  select { event_id = event_id,
    before = lag(event_id) over (partition_by: [user_id], sort: [ts, event_id]),
    after = lead(event_id, 2) over (partition_by: [user_id], sort: [ts, event_id]),
    filled = lag(event_id, 1, 0) over (partition_by: [user_id], sort: [ts, event_id]),
    head = first_value(event_id) over (partition_by: [user_id], sort: [ts, event_id]),
    tail = last_value(event_id) over (partition_by: [user_id], sort: [ts, event_id]) }
}""", """
SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, lag(event_id, 1, 0) OVER w AS filled, first_value(event_id) OVER w AS head, last_value(event_id) OVER w AS tail
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

_add("window_aggregates", """
model window_aggregates {
  from orders
  select { o_orderkey = o_orderkey,
    running = sum(o_orderkey) over (partition_by: [o_custkey], sort: [o_orderkey]),
    n = count() over (partition_by: [o_custkey]),
    least = min(o_totalprice) over (partition_by: [o_custkey]), most = max(o_totalprice) over (partition_by: [o_custkey]),
    mean = avg(o_orderkey) over (partition_by: [o_orderstatus]) }
}""", """
SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running, count(*) OVER (PARTITION BY o_custkey) AS n,
  min(o_totalprice) OVER (PARTITION BY o_custkey) AS least, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, avg(o_orderkey) OVER (PARTITION BY o_orderstatus) AS mean FROM orders""")

_add("window_after_group", """
model window_after_group {
  from lineitem
  group {l_returnflag, l_suppkey} ( aggregate { n = count() } )
  select { place = row_number() over (partition_by: [l_returnflag], sort: [n desc, l_suppkey]), total = sum(n) over () }
}""", """
SELECT l_returnflag, l_suppkey, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS place, CAST(sum(n) OVER () AS BIGINT) AS total
FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""")

# -- set operations, dedup, expand, sort, take --------------------------------------

_SETS = """
model buyers { from orders filter o_totalprice > 200000.0 select { k = o_custkey, w = o_orderstatus } }
model early  { from orders filter o_orderdate < cast("1996-01-01", "timestamp") select { k = o_custkey, w = o_orderstatus } }
"""
_SETS_SQL = "WITH buyers AS (SELECT o_custkey AS k, o_orderstatus AS w FROM orders WHERE o_totalprice > 200000), early AS (SELECT o_custkey AS k, o_orderstatus AS w FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') "
for _op, _sql in (("union", "UNION"), ("union all", "UNION ALL"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    _name = "set_" + _op.replace(" ", "_")
    _add(_name, _SETS + f"model {_name} {{ from buyers {_op} early }}", f"{_SETS_SQL} SELECT * FROM buyers {_sql} SELECT * FROM early")

_add("set_chain_widening", """
model ints { from nation select { v = n_nationkey, t = n_name } }
model floats { from supplier select { v = s_acctbal, t = s_name } }
model few { from nation filter n_nationkey < 5 select { v = n_nationkey, t = n_name } }
model set_chain_widening { from ints union all floats except few filter v > 0.0 select { v = v, t = t, double = v * 2 } }
""", """
SELECT v, t, v * 2 AS double FROM (
  (SELECT CAST(n_nationkey AS DOUBLE) AS v, n_name AS t FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier) EXCEPT SELECT CAST(n_nationkey AS DOUBLE), n_name FROM nation WHERE n_nationkey < 5) WHERE v > 0""")

_add("dedup_rows", "model dedup_rows { from lineitem select { f = l_returnflag, s = l_linestatus, n = l_linenumber } dedup }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s, CAST(l_linenumber AS BIGINT) AS n FROM lineitem")

_add("dedup_by_key", """
model dedup_by_key {
  from events
  select { user_id = user_id, event_type = event_type, value = value, event_id = event_id }
  dedup by user_id, event_type
  sort { user_id desc }
}""", """
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value NULLS LAST, event_id NULLS LAST) AS r FROM events) WHERE r = 1""")

_add("expand_array", """
model split { from part let words = array_construct(p_brand, p_type, p_name) select { p_partkey = p_partkey, words = if(p_size < 5, array_remove(array_construct(p_brand), p_brand), if(p_size < 10, null, words)) } }
model expand_array { from split expand words as word select { p_partkey = p_partkey, word = word, n = array_length(words) } }
""", "SELECT p_partkey, unnest([p_brand, p_type, p_name]) AS word, CAST(3 AS BIGINT) AS n FROM part WHERE NOT coalesce(p_size < 10, FALSE)")

_add("sort_take", "model sort_take { from orders select { o_orderkey = o_orderkey, o_totalprice = o_totalprice } sort { o_custkey desc, o_orderkey } take 25 }",
     "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25")

_add("take_range", "model take_range { from orders select { o_orderkey = o_orderkey } sort { o_orderkey } take 11..30 }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")

_add("sort_nulls_last", """
model sort_nulls_last {
  from events
  let v = if(event_type == "view", null, value)
  select { event_id = event_id, v = v }
  sort { v desc, event_id }
  take 40
}""", "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events ORDER BY v DESC NULLS LAST, event_id LIMIT 40")

# -- functions ----------------------------------------------------------------------

_add("strings", """
model strings {
  from part
  select { p_partkey = p_partkey, up = upper(p_name), low = lower(p_brand), cat = concat(p_brand, "-", p_size), len = length(p_name), sub = substring(p_name, 2, 3), sub0 = substring(p_name, 0, 2),
    tail = substring(p_name, -3), cut = trim("  x "), l = ltrim("  x"), r = rtrim("x  "), rep = replace(p_brand, "Brand", "B"), lp = lpad(p_brand, 12, "*"), rp = rpad(p_brand, 5, "*"),
    st = startswith(p_type, "S"), lk = p_type like "%A_%", rl = rlike(p_name, "[aeiou]{2}"), rl2 = p_brand rlike "#[0-9]+$", sp = split_part(p_brand, "#", 2), sp0 = split_part(p_brand, "#", 0),
    re = regexp_replace(p_name, "[aeiou]", "_"), le = left(p_name, 3), ri = right(p_name, 3), len_l = left(p_name, -2), len_r = right(p_name, -2) }
}""", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, p_brand || '-' || CAST(p_size AS VARCHAR) AS cat, length(p_name) AS len, substring(p_name, 2, 3) AS sub, substring(p_name, 0, 2) AS sub0,
  substring(p_name, -3) AS tail, trim('  x ') AS cut, ltrim('  x') AS l, rtrim('x  ') AS r, replace(p_brand, 'Brand', 'B') AS rep, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 5, '*') AS rp,
  starts_with(p_type, 'S') AS st, p_type LIKE '%A_%' AS lk, regexp_matches(p_name, '[aeiou]{2}') AS rl, regexp_matches(p_brand, '#[0-9]+$') AS rl2, split_part(p_brand, '#', 2) AS sp, '' AS sp0,
  regexp_replace(p_name, '[aeiou]', '_', 'g') AS re, left(p_name, 3) AS le, right(p_name, 3) AS ri, left(p_name, -2) AS len_l, right(p_name, -2) AS len_r FROM part""")

_add("dates", """
model dates {
  from orders
  let d = cast(o_orderdate, "date")
  let e = date_add(d, days: 40)
  select { o_orderkey = o_orderkey, y = date_add(d, years: 1), q = date_sub(d, quarters: 1), m = date_add(d, months: 1), w = date_add(d, weeks: 2), dd = date_sub(d, days: 3), ts = date_add(o_orderdate, months: 13),
    ty = date_trunc(d, year), tq = date_trunc(d, quarter), tm = date_trunc(o_orderdate, month), tw = date_trunc(d, week), td = date_trunc(o_orderdate, "day"),
    dy = date_diff(d, e, year), dq = date_diff(d, e, quarter), dm = date_diff(d, e, month), dw = date_diff(d, e, week), dn = date_diff(e, d, day) }
}""", """
SELECT o_orderkey, CAST(d + INTERVAL 1 YEAR AS DATE) AS y, CAST(d - INTERVAL 3 MONTH AS DATE) AS q, CAST(d + INTERVAL 1 MONTH AS DATE) AS m, CAST(d + INTERVAL 14 DAY AS DATE) AS w, CAST(d - INTERVAL 3 DAY AS DATE) AS dd,
  o_orderdate + INTERVAL 13 MONTH AS ts, CAST(date_trunc('year', d) AS DATE) AS ty, CAST(date_trunc('quarter', d) AS DATE) AS tq, date_trunc('month', o_orderdate) AS tm, CAST(date_trunc('week', d) AS DATE) AS tw,
  date_trunc('day', o_orderdate) AS td, date_diff('year', d, e) AS dy, date_diff('quarter', d, e) AS dq, date_diff('month', d, e) AS dm,
  CAST((CAST(date_trunc('week', e) AS DATE) - CAST(date_trunc('week', d) AS DATE)) / 7 AS BIGINT) AS dw, date_diff('day', e, d) AS dn
FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 40 AS e FROM orders)""")

_add("arrays", """
model xs { from events select { event_id = event_id, user_id = user_id, xs = array_construct(user_id, null, event_id, user_id) } }
model arrays {
  from xs
  select { event_id = event_id, n = array_length(xs), a0 = array_get(xs, 0), a1 = array_get(xs, 1), a9 = array_get(xs, 9), am = array_get(xs, -1), has = array_contains(xs, event_id), hasnt = array_contains(xs, -5),
    unknown = array_contains(xs, null), cat = array_length(array_concat(xs, xs)), app = array_get(array_append(xs, 7), 4), pre = array_get(array_prepend(7, xs), 0), gone = array_length(array_remove(xs, user_id)),
    same = array_length(array_remove(xs, null)), at = array_index_of(xs, event_id), nowhere = array_index_of(xs, -5), low = array_get(array_sort(xs), 0) }
}""", """
SELECT event_id, CAST(4 AS BIGINT) AS n, user_id AS a0, CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS a9, CAST(NULL AS BIGINT) AS am, TRUE AS has, FALSE AS hasnt, CAST(NULL AS BOOLEAN) AS unknown, CAST(8 AS BIGINT) AS cat,
  CAST(7 AS BIGINT) AS app, CAST(7 AS BIGINT) AS pre, CAST(CASE WHEN user_id = event_id THEN 1 ELSE 2 END AS BIGINT) AS gone, CAST(4 AS BIGINT) AS same,
  CAST(CASE WHEN user_id = event_id THEN 0 ELSE 2 END AS BIGINT) AS at, CAST(NULL AS BIGINT) AS nowhere, least(user_id, event_id) AS low FROM events""")

_add("maps_structs", """
model boxed { from nation select { n_nationkey = n_nationkey, m = map("name", n_name, "upper", upper(n_name)), s = struct("key", n_nationkey, "region", n_regionkey) } }
model maps_structs {
  from boxed
  select { n_nationkey = n_nationkey, name = map_get(m, "name"), missing = map_get(m, "other"), empty = map_get(m, ""), key = struct_get(s, "key"), region = struct_get(s, "region") }
}""", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS empty, CAST(n_nationkey AS BIGINT) AS key, CAST(n_regionkey AS BIGINT) AS region FROM nation")

_add("json_values", """
model docs { from events select { event_id = event_id, props = props, built = json_build("id", event_id, "kind", event_type, "none", null, "inner", json_get(props, "k")) } }
model json_values {
  from docs
  select { event_id = event_id, k = json_value(props, "k"), missing = json_value(props, "zzz"), id = json_value(built, "id"), kind = json_value(built, "kind"), nul = json_is_null(json_get(built, "none")),
    not_nul = json_is_null(json_get(built, "kind")), inner_k = json_value(json_path(built, "$"), "inner"), dyn = json_value(props, substring("k", 1, 1)), text = json_value(json_get(built, "none"), "x") }
}""", """
SELECT event_id, props ->> '$.k' AS k, CAST(NULL AS VARCHAR) AS missing, CAST(event_id AS VARCHAR) AS id, event_type AS kind, TRUE AS nul, FALSE AS not_nul, props ->> '$.k' AS inner_k, props ->> '$.k' AS dyn,
  CAST(NULL AS VARCHAR) AS text FROM events""")

_add("generated_models", """
fn flags() -> List<Str> { ["R", "A"] }
fn by_flag(names: List<Str>) -> List<Model> { [ model "lines_${f}" { from lineitem filter lineitem.l_returnflag == f derive { k = l_orderkey, n = l_linenumber } } for f in names ] }
by_flag(flags())
model generated_models { from lines_R union all lines_A }
""", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A')")

_add("model_chain", """
domain key = int64
contract Busy { o_custkey: key nonnull  n: int64 nonnull }
model per_customer -> contract Busy { owner: "sales" from orders group {o_custkey} ( aggregate { n = count() } ) }
model model_chain {
  from per_customer
  join_inner customer on per_customer.o_custkey == customer.c_custkey expect one_to_one
  filter n > 12
  select { c_name = customer.c_name, n = n }
}""", "SELECT c_name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE n > 12")


_LATER = """
model before { from orders filter o_orderdate < cast("1997-01-01", "timestamp") select { o_orderkey = o_orderkey, o_custkey = o_custkey, price = o_totalprice * 2.0, placed = o_orderdate } }
model now { from orders select { o_orderkey = o_orderkey, o_custkey = o_custkey, price = o_totalprice, placed = o_orderdate } }
"""
_LATER_SQL = """
WITH before AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS price, o_orderdate AS placed FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
delta AS (SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderdate AS placed FROM orders WHERE o_orderdate > (SELECT max(placed) FROM before))
"""


def _incremental(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        project = Project.from_text(SOURCES + _LATER)
        sources = Sources.folder(spark, sf_dir, list(project.sources))
        before, now = project.frame("before", sources), project.frame("now", sources)
        return incremental.append(before, now, "placed") if strategy == "append" else incremental.upsert(before, now, "placed", ["o_custkey"])

    return run


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = Project.from_text(SOURCES + "contract C { o_orderkey: int64 nonnull unique  o_custkey: int64 nonnull unique  o_orderstatus: string nonnull enum {F, O} }")
    found = violations(Sources.folder(spark, sf_dir, list(project.sources)).get(project.sources["orders"]), project.contracts["C"])
    return found.toDF("key_null", "key_twice", "cust_null", "cust_twice", "status_null", "status_other")


# -- what is known of definitions ----------------------------------------------

_SHOP = """
contract Daily { day: date nonnull  total: money  who: string enum {a, b} classification: pii }
model lines { owner: "ops" from lineitem filter l_quantity > 1.0 select { k = l_orderkey, part = l_partkey, price = l_extendedprice * (1.0 - l_discount) } }
model priced { from orders join_left lines on orders.o_orderkey == lines.k expect many_to_one
  let day = cast(orders.o_orderdate, "date") select { id = orders.o_orderkey, day = day, price = lines.price, rn = row_number() over (partition_by: [o_custkey], sort: [o_orderkey]) } }
model daily { owner: "finance" from priced group {day} ( aggregate { total = sum(price), n = count() } ) }
model people { from customer join_inner nation on customer.c_nationkey == nation.n_nationkey expect many_to_one select { c = c_custkey, n = nation.n_name } }
test daily { expect n > 0  expect total > 1.0  expect row_count >= 10  expect row_count < 3 }
test priced { expect id in lines.k  expect rn >= 1 }
"""


def _shop(spark: SparkSession, sf_dir: str) -> tuple[Project, Callable[[str], DataFrame]]:
    project = Project.from_text(SOURCES + _SHOP)
    sources, ready = Sources.folder(spark, sf_dir, list(project.sources)), {}
    project.check()
    return project, lambda name: sources.get(project.sources[name]) if name in project.sources else project.frame(name, sources, ready)


def column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineage(spark, _shop(spark, sf_dir)[0]).filter("model <> 'lines'")


def radius_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.radius(spark, _shop(spark, sf_dir)[0], [("lineitem", "l_discount"), ("nation", "n_name")])


def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _SHOP.replace("n = count() } )", "orders = count(), most = max(price) } )").replace("total: money", "total: money nonnull").replace('day = day, price', 'day = upper("x"), price').replace("test daily { expect n > 0 ", "test daily {")
    return tables.differences(spark, Project.from_text(SOURCES + _SHOP), Project.from_text(SOURCES + changed.replace("group {day}", "group {id}").replace("id = orders.o_orderkey", "id = orders.o_orderkey, extra = 1")))


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SOURCES + _SHOP.replace("model people {", "model people -> contract Secret {") + "contract Secret { n: string classification: pii }\nmodel twin { from orders }\nmodel twin2 { from orders }"
    return tables.findings(spark, Project.from_text(text))


def declarative_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    project, frame = _shop(spark, sf_dir)
    return tables.expectations(spark, project.tests, frame)


def join_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    project, frame = _shop(spark, sf_dir)
    return tables.broken_joins([(n, j) for n, c in project.compiled.items() for j in c.joins], frame)


#: A definition that isn't accepted, and the code that says why.
REJECTED = [
    ("contract C { o_orderkey: int64  zzz: string } model m -> contract C { from orders }", "E010"),
    ("contract C { o_orderkey: string } model m -> contract C { from orders }", "E011"),
    ("contract C { o_totalprice: float64 nonnull } model m -> contract C { from orders }", "E012"),
    ("contract C { o_orderkey: int64 enum {a} } model m -> contract C { from orders }", "E013"),
    ("model m -> contract Nowhere { from orders }", "E061"),
    ("model m { from nowhere }", "E020"),
    ("source s(x: y) { } model m { from s }", "E021"),
    ("model m { from orders filter zzz == 1 }", "E040"),
    ("model m { from orders filter zzz.o_orderkey == 1 }", "E041"),
    ('model m { from orders filter o_orderkey == "x" }', "E051"),
    ('model m { from orders filter o_orderkey and true }', "E052"),
    ('model m { from orders select { v = o_orderkey + "x" } }', "E053"),
    ("model m { from orders select { v = sum(o_orderkey) } }", "E056"),
    ("model m { from orders group {o_custkey} ( aggregate { v = sum(o_orderkey) + 1 } ) }", "E050"),
    ("model m { from orders select { v = zzz(1) } }", "E059"),
    ("model m { from orders select { v = upper(o_orderstatus, 1) } }", "E062"),
    ("model m { from orders select { v = upper(o_orderkey) } }", "E063"),
    ("model m { from orders group {} ( aggregate { v = count(*) } ) select { w = max(*) } }", "E064"),
    ("model m { from orders filter row_number() over () == 1 }", "E065"),
    ("model m { from orders select { v = date_add(o_orderdate, hours: 1) } }", "E071"),
    ('model m { from events select { v = json_get(props, "a.b") } }', "E074"),
    ("model m { from orders expand o_orderkey }", "E075"),
    ("model m { from orders union customer }", "E076"),
    ("model a { from customer } model m { from orders union a }", "E077"),
    ("domain a = b domain b = a model m { from orders }", "E078"),
    ("model m { from orders join_left lineitem on orders.o_orderkey > lineitem.l_orderkey expect many_to_one }", "E079"),
    ("model m { incremental merge_strategy: twist cdc_column: o_orderdate from orders }", "E086"),
    ("model m { incremental merge_strategy: append from orders }", "E088"),
    ("model m { incremental merge_strategy: upsert cdc_column: o_orderdate from orders }", "E089"),
    ("model m { from orders } test other { expect row_count > 1 }", "E091"),
    ("model m { from orders } test m { expect zzz > 1 }", "E092"),
    ('model m { from orders } test m { expect o_orderkey > "x" }', "E094"),
    ("model m { from orders group {} ( aggregate { v = sum(distinct o_orderkey) } ) }", "E096"),
    ("model m { from orders } test m { expect o_orderkey in zzz.k }", "E101"),
    ("model m { from orders } test m { expect o_orderkey in m.zzz }", "E102"),
    ("model a { from b } model b { from a }", "F001"),
]


def rejected_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code that each definition of ``REJECTED`` is rejected with."""
    rows = []
    for text, _ in REJECTED:
        try:
            Project.from_text(SOURCES + text).check()
            rows.append((text, "accepted"))
        except ModelError as e:
            rows.append((text, e.code))
    return spark.createDataFrame(rows, "definition string, code string")


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the printed text of each query's models reads as the same module,
    and its fingerprint is the one of the first reading."""
    rows = []
    for name, (text, _) in MODELS.items():
        first = Project.from_text(SOURCES + text)
        again = Project.from_text(print_module(read_module(SOURCES + text)))
        rows.append((name, {n: c.fingerprint for n, c in first.check().items()} == {n: c.fingerprint for n, c in again.check().items()}))
    return spark.createDataFrame(rows, "name string, same boolean")


def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, value): what runs, a rollback, a replay and a clean-up do."""
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp()).rstrip('/')}/lifecycle-{uuid.uuid4().hex[:12]}"
    text = SOURCES + """
contract Known { n_nationkey: int64 nonnull unique  name: string nonnull }
model names -> contract Known { partition_by [n_nationkey] from nation select { n_nationkey = n_nationkey, name = upper(n_name) } }
model counts { freshness 1h from names group {} ( aggregate { n = count() } ) }
model kept { incremental merge_strategy: upsert merge_keys: [r_regionkey] cdc_column: r_regionkey from region select { r_regionkey = r_regionkey, name = r_name } }
test names { expect row_count == 25 }
"""
    project = Project.from_text(text)
    store, sources = Store(spark, root), Sources.folder(spark, sf_dir, list(project.sources))
    noon = dt.datetime(2026, 1, 1, 12)
    rows: list[tuple[str, str]] = []
    try:
        first = Runner(project, store, sources, noon).run()
        rows.append(("models", ",".join(first.models)))
        same = Runner(project, store, sources, noon).run(["names", "counts"])
        again = Runner(project, store, sources, noon).run(["names", "counts"])
        rows += [("the same work has one name", str(same.run == again.run)), ("and isn't published twice", str(again.reused))]
        rows.append(("nothing is stale", ",".join(Runner(project, store, sources, noon).run(only_stale=True).models)))
        rows.append(("too old after two hours", ",".join(Runner(project, store, sources, noon + dt.timedelta(hours=2)).run(only_stale=True).models)))
        fewer = sources.get(project.sources["nation"]).filter("n_nationkey < 24")
        try:
            Runner(project, store, sources, noon).run(overrides={"nation": fewer})
            rows.append(("a failing test", "published"))
        except ModelError as e:
            rows.append(("a failing test", e.code))
        rows.append(("rows after it", str(Runner(project, store, sources).snapshot("names").count())))
        extra = spark.createDataFrame([(4, "changed"), (5, "added")], "r_regionkey int, r_name string")
        second = Runner(project, store, sources, noon).run(["kept"], overrides={"region": extra})
        rows.append(("after an upsert", ",".join(f"{r.r_regionkey}={r.name}" for r in Runner(project, store, sources).snapshot("kept").orderBy("r_regionkey").collect())))
        rows.append(("replay", ",".join(Runner(project, store, sources).replay(second.run).models)))
        Runner(project, store, sources).rollback(first.run, ["kept"])
        rows.append(("rows after a rollback", str(Runner(project, store, sources).snapshot("kept").count())))
        backfilled = Runner(project, store, sources, noon).backfill(second.run, {"region": extra.filter("r_regionkey = 5")}, "late rows")
        rows.append(("backfill", ",".join(backfilled.models)))
        gone = Runner(project, store, sources, noon).gc(keep=0, apply=True)
        rows += [("some runs are cleaned up", str(bool(gone))), ("what is current stays", str(Runner(project, store, sources).snapshot("names").count()))]
        rows.append(("staged tests", ",".join(Runner(project, store, sources).stage(["names"]))))
        rows.append(("branches", ",".join(f"{b}:{'+'.join(ms)}" for b, ms in Runner(project, store, sources).branches().items())))
        rows += [("entries to migrate", str(store.migrate())), ("history", str(len(store.history()) >= 4))]
        cut = Runner(project, store, sources, noon)
        recover, cut.recover = cut.recover, lambda: False
        late = cut.run(["counts"], overrides={"nation": sources.get(project.sources["nation"]).withColumn("n_name", F.lit("x"))}, reason="cut off")
        rows += [("current while cut off", str(store.live()["counts"] == late.run)), ("recovered", str(recover())), ("current then", str(store.live()["counts"] == late.run))]
    finally:
        store.delete()
    return spark.createDataFrame(rows, "step string, value string")


def grammar_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exported grammar accepts the models of each query, as written
    and as printed, by a recogniser that knows nothing of the reader."""
    rows = [(name, accepts(gbnf(), text) and accepts(gbnf(), print_module(read_module(text)))) for name, (text, _) in MODELS.items()]
    return spark.createDataFrame(rows, "name string, accepted boolean")


def demo_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starter project over the demo tables."""
    return Project.from_text(demo.STARTER).frame("daily_orders", Sources(spark, demo.tables(spark)))


_SCHEMA = {
    "sources": [{"name": "shop", "tables": [{"name": "orders", "columns": [{"name": "o_orderkey", "data_type": "bigint", "tests": ["not_null"]}, {"name": "o_custkey", "data_type": "bigint"}, {"name": "o_orderstatus", "data_type": "varchar(1)"}]}]}],
    "models": [{"name": "busy", "columns": [{"name": "o_custkey", "data_type": "bigint"}, {"name": "n", "data_type": "bigint", "tests": ["not_null"]}]}],
}
_SELECT = """
with done as (select o.o_custkey, o.o_orderkey, case when o.o_orderstatus = 'F' then 1 else 0 end as finished from {{ source('shop', 'orders') }} o where o.o_orderkey between 1 and 40000)
select o_custkey, count(distinct o_orderkey) as n from done where finished = 1 group by 1 having count(*) > 2
"""


def imported_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models read from a schema file and a SELECT statement of another tool."""
    project = Project(import_project(_SCHEMA, {"busy": _SELECT}))
    return project.frame("busy", Sources.folder(spark, sf_dir, list(project.sources)))


def contract_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, says) of rows that are held against a contract: its columns, their
    types, nulls, values and keys."""
    contract = Project.from_text("contract C { id: int64 nonnull primary_key  kind: string enum {a, b}  total: money }").contracts["C"]
    good = spark.sql("SELECT 1L AS id, 'a' AS kind, CAST(1.5 AS DECIMAL(38,2)) AS total UNION ALL SELECT 2, NULL, NULL")
    cases = {
        "holds": good, "smaller integers hold": good.withColumn("id", F.col("id").cast("int")), "a column is missing": good.drop("kind"), "another type": good.withColumn("total", F.col("total").cast("decimal(38,3)")),
        "a null": good.withColumn("id", F.when(F.col("id") > 1, F.col("id"))), "another value": good.withColumn("kind", F.lit("c")), "a key twice": good.withColumn("id", F.lit(1).cast("long")),
    }
    rows = []
    for case, df in cases.items():
        try:
            pin(df, contract, "m")
            rows.append((case, "holds"))
        except PinError as e:
            rows.append((case, e.message))
    return spark.createDataFrame(rows, "case string, says string")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines in which metrics are reported."""
    m = Metrics("mg")
    m.count("runs")
    m.count("rows", 5, model="a")
    m.count("rows", 2, model="a")
    m.gauge("live", 3)
    lines = [x for x in m.prometheus().splitlines() if not x.startswith("#")] + m.statsd()
    return spark.createDataFrame([(x,) for x in lines], "line string")


def _values(rows: list[tuple], *names: str) -> str:
    """SQL of fixed rows."""
    text = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({', '.join(names)})"


#: Queries that aren't a model, with their SQL.
OTHERS: dict[str, tuple[Query, str]] = {
    "incremental_append": (_incremental("append"), _LATER_SQL + "SELECT * FROM before UNION ALL SELECT * FROM delta"),
    "incremental_upsert": (_incremental("upsert"), _LATER_SQL + "SELECT * FROM before WHERE o_custkey NOT IN (SELECT o_custkey FROM delta) UNION ALL SELECT * FROM delta"),
    "contract_violations": (contract_violations, """
SELECT count(*) FILTER (o_orderkey IS NULL) AS key_null, count(*) - count(DISTINCT o_orderkey) AS key_twice, count(*) FILTER (o_custkey IS NULL) AS cust_null, count(*) - count(DISTINCT o_custkey) AS cust_twice,
  count(*) FILTER (o_orderstatus IS NULL) AS status_null, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS status_other FROM orders"""),
    "column_lineage": (column_lineage, _values([
        ("priced", "id", "orders", "o_orderkey", "passthrough"), ("priced", "day", "orders", "o_orderdate", "derived"), ("priced", "price", "lines", "price", "joined"),
        ("priced", "rn", "orders", "o_custkey", "windowed"), ("priced", "rn", "orders", "o_orderkey", "windowed"), ("daily", "day", "priced", "day", "grouped"),
        ("daily", "total", "priced", "price", "aggregated"), ("people", "c", "customer", "c_custkey", "passthrough"), ("people", "n", "nation", "n_name", "joined"),
    ], "model", "\"column\"", "from_node", "from_column", "kind")),
    "radius_of_change": (radius_of_change, _values([("daily", "total"), ("lineitem", "l_discount"), ("lines", "price"), ("nation", "n_name"), ("people", "n"), ("priced", "price")], "node", "\"column\"")),
    "semantic_diff": (semantic_diff, _values([
        ("daily", "day", "removed", True), ("daily", "id", "added", False), ("daily", "most", "added", False), ("daily", "n", "removed", True), ("daily", "orders", "added", False),
        ("priced", "day", "retyped", True), ("priced", "extra", "added", False), ("contract Daily", "total", "widened", False),
    ], "model", "\"column\"", "kind", "breaking")),
    "lint_findings": (lint_findings, _values([
        *[("W001", m, "no contract") for m in ("daily", "lines", "priced", "twin", "twin2")], *[("W002", m, "no owner") for m in ("people", "priced", "twin", "twin2")],
        ("W003", "twin", "passes all columns on"), ("W003", "twin2", "passes all columns on"), ("W004", "people.n", "classified pii but not protected"),
        *[("W005", m, "read by no model or pipeline") for m in ("daily", "people", "twin", "twin2")], ("W006", "twin2", "the same as twin"),
    ], "code", "place", "what")),
    "declarative_tests": (declarative_tests, """
WITH line AS (SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS price FROM lineitem WHERE l_quantity > 1),
priced AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders LEFT JOIN line ON o_orderkey = k),
daily AS (SELECT day, sum(price) AS total, count(*) AS n FROM priced GROUP BY day)
SELECT 'daily' AS model, 'n > 0' AS expects, count(*) FILTER (NOT n > 0) = 0 AS holds FROM daily
UNION ALL SELECT 'daily', 'total > 1.0', count(*) FILTER (NOT total > 1) = 0 FROM daily
UNION ALL SELECT 'daily', 'row_count >= 10', count(*) >= 10 FROM daily
UNION ALL SELECT 'daily', 'row_count < 3', count(*) < 3 FROM daily
UNION ALL SELECT 'priced', 'id in lines.k', count(*) = 0 FROM priced WHERE NOT EXISTS (SELECT 1 FROM line WHERE k = id)
UNION ALL SELECT 'priced', 'rn >= 1', count(*) FILTER (NOT rn >= 1) = 0 FROM priced"""),
    "join_promises": (join_promises, """
SELECT 'priced' AS model, 'lines' AS joins, 'many_to_one' AS expects, count(*) AS keys_twice FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 1 GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'people', 'nation', 'many_to_one', count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)"""),
    "rejected_definitions": (rejected_definitions, _values(REJECTED, "definition", "code")),
    "canonical_text": (canonical_text, _values([(name, True) for name in MODELS], "name", "same")),
    "grammar_accepts": (grammar_accepts, _values([(name, True) for name in MODELS], "name", "accepted")),
    "demo_orders": (demo_orders, """
SELECT country, CAST(day AS DATE) AS order_day, CAST(net AS DECIMAL(38,2)) AS net, CAST(orders AS BIGINT) AS orders
FROM (VALUES ('ES', '2026-09-01', 200.00, 2), ('BR', '2026-09-02', 70.00, 1), ('MX', '2026-09-02', 200.00, 1)) t(country, day, net, orders)"""),
    "imported_models": (imported_models, "SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey BETWEEN 1 AND 40000 AND o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 2"),
    "contract_pins": (contract_pins, _values([
        ("holds", "holds"), ("smaller integers hold", "holds"), ("a column is missing", "m: column 'kind' is missing"), ("another type", "m.total is decimal(38,3), the contract says money(USD)"),
        ("a null", "m.id is null in 1 rows; m.id isn't unique in 1 rows"), ("another value", "m.kind isn't one of a, b in 2 rows"), ("a key twice", "m.id isn't unique in 1 rows"),
    ], "\"case\"", "says")),
    "run_metrics": (run_metrics, _values([(x,) for x in ('mg_rows_total{model="a"} 7', "mg_runs_total 1", "mg_live 3", "mg.rows:7|c|#model:a", "mg.runs:1|c", "mg.live:3|g")], "line")),
    "run_lifecycle": (run_lifecycle, _values([
        ("models", "names,counts,kept"), ("the same work has one name", "True"), ("and isn't published twice", "True"), ("nothing is stale", ""), ("too old after two hours", "counts"),
        ("a failing test", "E081"), ("rows after it", "25"), ("after an upsert", "0=AFRICA,1=AMERICA,2=ASIA,3=EUROPE,4=MIDDLE EAST,5=added"), ("replay", "kept"), ("rows after a rollback", "5"),
        ("backfill", "kept"), ("some runs are cleaned up", "True"), ("what is current stays", "25"), ("staged tests", "names: row_count == 25"),
        ("branches", "test:names"), ("entries to migrate", "0"), ("history", "True"), ("current while cut off", "False"), ("recovered", "True"), ("current then", "True"),
    ], "step", "value")),
}


def _query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        project = Project.from_text(SOURCES + MODELS[name][0])
        return project.frame(name, Sources.folder(spark, sf_dir, list(project.sources)))

    return run


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in MODELS} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (MODELS | OTHERS).items()}
