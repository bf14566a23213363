"""Named queries over the star-schema tables, each with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.values import as_text
from .sources.files import register_tables

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@dataclass(frozen=True)
class Named:
    """A program over the tables it names, a goal, and the columns (with types) of its answers."""

    program: str
    goal: str
    columns: str
    sql: str
    demand: bool = False
    add: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()

    def engine(self, spark: SparkSession, sf_dir: str) -> Engine:
        engine = Engine(spark=spark)
        used = [t for t in TABLES if f"{t}(" in self.program or f"{t}(" in self.goal]
        register_tables(engine, sf_dir, used)
        engine.load(self.program)
        return engine

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = self.engine(spark, sf_dir)
        if self.add or self.remove:
            engine.run()
            engine.update(add=self.add, remove=self.remove)
        result = engine.query(self.goal, demand=self.demand)
        return typed(result.df, self.columns)


def typed(df: DataFrame, columns: str) -> DataFrame:
    wanted = [c.split() for c in columns.split(", ")]
    mixed = {f.name for f in df.schema if f.dataType.typeName() == "struct"}
    cols = [as_text(F.col(f"`{c}`")) if c in mixed else F.col(f"`{c}`") for c in df.columns]
    return df.select(*[c.cast(kind).alias(name) for c, (name, kind) in zip(cols, wanted)])


UP = "up(X, Y) :- part(X, _, _, _, _, _), X > 1, Y = (X - X % 2) / 2. "
LINEAR = UP + "anc(X, Y) :- up(X, Y). anc(X, Y) :- anc(X, Z), up(Z, Y)."
UP_SQL = "up AS (SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 1)"
ANC_SQL = f"WITH RECURSIVE {UP_SQL}, anc AS (SELECT x, y FROM up UNION SELECT a.x, u.y FROM anc a JOIN up u ON a.y = u.x) "
XY = "x bigint, y bigint"
RING = "e(S, D) :- nation(S, _, _), D = (S * 7 + 3) % 25. "
RING_SQL = "e AS (SELECT n_nationkey::BIGINT AS s, ((n_nationkey * 7 + 3) % 25)::BIGINT AS d FROM nation)"

QUERIES: dict[str, Named] = {
    # recursion
    "tc_hierarchy": Named(LINEAR, "anc(X, Y)", XY, ANC_SQL + "SELECT x, y FROM anc"),
    "tc_right_linear": Named(UP + "anc(X, Y) :- up(X, Y). anc(X, Y) :- up(X, Z), anc(Z, Y).", "anc(X, Y)", XY, ANC_SQL + "SELECT x, y FROM anc"),
    "tc_nonlinear": Named(UP + "anc(X, Y) :- up(X, Y). anc(X, Y) :- anc(X, Z), anc(Z, Y).", "anc(X, Y)", XY, ANC_SQL + "SELECT x, y FROM anc"),
    "cyclic_closure": Named(
        RING + "r(S, D) :- e(S, D). r(S, D) :- r(S, M), e(M, D).", "r(S, D)", "s bigint, d bigint",
        f"WITH RECURSIVE {RING_SQL}, r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s) SELECT s, d FROM r",
    ),
    "same_generation": Named(
        "p(X, Y) :- nation(X, _, _), X > 0, Y = (X - X % 2) / 2. sg(X, X) :- nation(X, _, _). sg(X, Y) :- p(X, A), sg(A, B), p(Y, B).", "sg(X, Y)", XY,
        "WITH RECURSIVE p AS (SELECT n_nationkey::BIGINT AS x, (n_nationkey // 2)::BIGINT AS y FROM nation WHERE n_nationkey > 0), sg AS (SELECT n_nationkey::BIGINT AS x, n_nationkey::BIGINT AS y FROM nation UNION SELECT a.x, b.x FROM sg JOIN p a ON a.y = sg.x JOIN p b ON b.y = sg.y) SELECT x, y FROM sg",
    ),
    "mutual_even_odd": Named(
        "next(C, T, U) :- conversations(C, T, _, _), conversations(C, U, _, _), U = T + 1. even(C, T) :- conversations(C, T, _, _), T = 0. odd(C, U) :- even(C, T), next(C, T, U). even(C, U) :- odd(C, T), next(C, T, U).",
        "odd(C, T)", "conv bigint, turn bigint",
        "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations), w AS (SELECT c, t, 0 AS odd FROM t WHERE t = 0 UNION SELECT w.c, t.t, 1 - w.odd FROM w JOIN t ON t.c = w.c AND t.t = w.t + 1) SELECT DISTINCT c AS conv, t AS turn FROM w WHERE odd = 1",
    ),
    "conv_reach": Named(
        "next(C, T, U) :- conversations(C, T, _, _), conversations(C, U, _, _), U = T + 1. reach(C, T, U) :- next(C, T, U). reach(C, T, V) :- reach(C, T, U), next(C, U, V).",
        "reach(C, T, U)", "conv bigint, a bigint, b bigint",
        "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations), n AS (SELECT a.c, a.t, b.t AS u FROM t a JOIN t b ON a.c = b.c AND b.t = a.t + 1), r AS (SELECT c, t, u FROM n UNION SELECT r.c, r.t, n.u FROM r JOIN n ON r.c = n.c AND r.u = n.t) SELECT c AS conv, t AS a, u AS b FROM r",
    ),
    "bounded_cost_shortest": Named(
        "size(N) :- N = count { supplier(_, _, _, _) }. e(S, D, W) :- supplier(S, _, _, _), size(N), D = (S + 1) % N, W = 1 + S % 4. cost(S, D, W) :- e(S, D, W). cost(S, D, C) :- cost(S, M, A), e(M, D, B), C = A + B, C <= 20. shortest(S, D, C) :- cost(S, D, _), C = min X { cost(S, D, X) }.",
        "shortest(S, D, C)", "s bigint, d bigint, c bigint",
        "WITH RECURSIVE k AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS s, (s_suppkey + 1) % n AS d, 1 + s_suppkey % 4 AS w FROM supplier, k), c AS (SELECT s, d, w FROM e UNION SELECT c.s, e.d, c.w + e.w FROM c JOIN e ON c.d = e.s WHERE c.w + e.w <= 20) SELECT s, d, min(w) AS c FROM c GROUP BY s, d",
    ),
    "unreachable": Named(
        RING + "r(D) :- e(0, D). r(D) :- r(M), e(M, D). far(S) :- nation(S, _, _), not r(S).", "far(S)", "s bigint",
        f"WITH RECURSIVE {RING_SQL}, r AS (SELECT d FROM e WHERE s = 0 UNION SELECT e.d FROM r JOIN e ON r.d = e.s) SELECT n_nationkey::BIGINT AS s FROM nation WHERE n_nationkey NOT IN (SELECT d FROM r)",
    ),
    # joins
    "join_star": Named(
        "", "customer(C, _, N, _, _), nation(N, Nation, R), region(R, Region)", "c bigint, n bigint, nation string, r bigint, region string",
        "SELECT c_custkey AS c, n_nationkey::BIGINT AS n, n_name AS nation, r_regionkey::BIGINT AS r, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_fact_tables": Named(
        "", "lineitem(O, P, S, _, Q, _, _, _, 'R', _, _), orders(O, C, _, _, _, _)", "o bigint, p bigint, s bigint, q double, c bigint",
        "SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_quantity AS q, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    ),
    "self_join": Named("", "nation(A, _, R), nation(B, _, R), A < B", "a bigint, r bigint, b bigint", "SELECT a.n_nationkey::BIGINT AS a, a.n_regionkey::BIGINT AS r, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "theta_join": Named("", "nation(A, _, _), region(B, _), A * 2 < B + 5", "a bigint, b bigint", "SELECT n_nationkey::BIGINT AS a, r_regionkey::BIGINT AS b FROM nation JOIN region ON n_nationkey * 2 < r_regionkey + 5"),
    "cross_product": Named("", "nation(A, _, _), region(B, _)", "a bigint, b bigint", "SELECT n_nationkey::BIGINT AS a, r_regionkey::BIGINT AS b FROM nation, region"),
    "semi_join": Named("buyer(C, Name) :- customer(C, Name, _, _, _), orders(_, C, _, _, _, _).", "buyer(C, Name)", "c bigint, name string", "SELECT c_custkey AS c, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "const_filter": Named("", "orders(O, C, 'F', _, _, '1-URGENT')", "o bigint, c bigint", "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "repeat_var": Named("", "nation(N, _, N)", "n bigint", "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_nationkey = n_regionkey"),
    "const_head": Named("kind(big, P) :- part(P, _, _, _, S, _), S > 40. kind(small, P) :- part(P, _, _, _, S, _), S <= 40.", "kind(K, P)", "k string, p bigint", "SELECT CASE WHEN p_size > 40 THEN 'big' ELSE 'small' END AS k, p_partkey AS p FROM part"),
    "zero_arity": Named("some :- region(_, _). none :- region(99, _).", "some, not none, region(R, _)", "r bigint", "SELECT r_regionkey::BIGINT AS r FROM region"),
    "undefined_predicate": Named("kept(R) :- region(R, _), not hidden(R).", "kept(R)", "r bigint", "SELECT r_regionkey::BIGINT AS r FROM region"),
    # negation and sets
    "anti_orders": Named("idle(O) :- orders(O, _, _, _, _, _), not lineitem(O, _, _, _, _, _, _, _, _, _, _).", "idle(O)", "o bigint", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "docs_unlabelled": Named("bare(D) :- documents(D, _, _, _, _), not labels(D, _, _).", "bare(D)", "d bigint", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "union_nations": Named("used(N) :- customer(_, _, N, _, _). used(N) :- supplier(_, _, N, _).", "used(N)", "n bigint", "SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "intersect_nations": Named("c(N) :- customer(_, _, N, _, _). s(N) :- supplier(_, _, N, _).", "c(N), s(N)", "n bigint", "SELECT c_nationkey::BIGINT AS n FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier"),
    "except_flags": Named("open(O) :- lineitem(O, _, _, _, _, _, _, _, 'N', _, _). back(O) :- lineitem(O, _, _, _, _, _, _, _, 'R', _, _).", "back(O), not open(O)", "o bigint", "SELECT l_orderkey AS o FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N'"),
    # aggregates
    "count_zero_fill": Named(
        "urgent(C, N) :- customer(C, _, _, _, _), N = count { orders(_, C, _, _, _, '1-URGENT') }.", "urgent(C, N)", "c bigint, n bigint",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT DISTINCT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey GROUP BY c_custkey",
    ),
    "sum_by_key": Named(
        "q(F, T) :- lineitem(_, _, _, _, _, _, _, _, F, _, _), T = sum Q { lineitem(O, P, S, L, Q, _, _, _, F, _, _) }.", "q(F, T)", "f string, t double",
        "SELECT l_returnflag AS f, sum(l_quantity) AS t FROM (SELECT DISTINCT * FROM lineitem) GROUP BY l_returnflag",
    ),
    "min_max_by_key": Named(
        "r(C, A, B) :- customer(C, _, _, _, _), A = min T { orders(_, C, _, T, _, _) }, B = max T { orders(_, C, _, T, _, _) }.", "r(C, A, B)", "c bigint, a double, b double",
        "SELECT o_custkey AS c, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
    ),
    "avg_by_key": Named("a(B, A) :- part(_, _, B, _, _, _), A = avg S { part(P, _, B, _, S, _) }.", "a(B, A)", "b string, a double", "SELECT p_brand AS b, sum(p_size)::DOUBLE / count(*) AS a FROM (SELECT DISTINCT * FROM part) GROUP BY p_brand"),
    "global_agg": Named(
        "g(N, S, A, B) :- N = count { part(_, _, _, _, _, _) }, S = sum X { part(_, _, _, _, X, _) }, A = min X { part(_, _, _, _, X, _) }, B = max X { part(_, _, _, _, X, _) }.", "g(N, S, A, B)", "n bigint, s bigint, a bigint, b bigint",
        "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, min(p_size)::BIGINT AS a, max(p_size)::BIGINT AS b FROM (SELECT DISTINCT * FROM part)",
    ),
    "agg_expression": Named("g(T) :- T = sum X * 10 + 1 { region(X, _) }.", "g(T)", "t bigint", "SELECT sum(r_regionkey * 10 + 1)::BIGINT AS t FROM region"),
    "count_distinct_locals": Named(
        "pair(N, M) :- supplier(_, _, N, _), customer(_, _, M, _, _). c(N, K) :- nation(N, _, _), K = count { pair(N, _) }.", "c(N, K)", "n bigint, k bigint",
        "SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN (SELECT count(DISTINCT c_nationkey) FROM customer) ELSE 0 END AS k FROM nation",
    ),
    "nested_agg": Named("t(R, T) :- region(R, _), T = sum K { nation(N, _, R), K = count { customer(_, _, N, _, _) } }.", "t(R, T)", "r bigint, t bigint", "SELECT r_regionkey::BIGINT AS r, count(c_custkey) AS t FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey"),
    "agg_chain": Named(
        "c(N, K) :- nation(N, _, _), K = count { supplier(_, _, N, _) }. top(M, W) :- M = max K { c(N, K) }, W = count { c(X, M) }.", "top(M, W)", "m bigint, w bigint",
        "WITH c AS (SELECT n_nationkey, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey) SELECT max(k) AS m, (SELECT count(*) FROM c WHERE k = (SELECT max(k) FROM c)) AS w FROM c",
    ),
    "having": Named("c(N, K) :- nation(N, _, _), K = count { customer(_, _, N, _, _) }, K > 50.", "c(N, K)", "n bigint, k bigint", "SELECT c_nationkey::BIGINT AS n, count(*) AS k FROM customer GROUP BY c_nationkey HAVING count(*) > 50"),
    "agg_equals_bound": Named("five(R) :- region(R, _), K = 5, K = count { nation(_, _, R) }.", "five(R)", "r bigint", "SELECT n_regionkey::BIGINT AS r FROM nation GROUP BY n_regionkey HAVING count(*) = 5"),
    "agg_over_negation": Named(
        "idle(N, K) :- nation(N, _, _), K = count { customer(C, _, N, _, _), not orders(_, C, _, _, _, _) }.", "idle(N, K)", "n bigint, k bigint",
        "SELECT n_nationkey::BIGINT AS n, count(c_custkey) AS k FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) ON c_nationkey = n_nationkey GROUP BY n_nationkey",
    ),
    "agg_over_recursion": Named(LINEAR + " depth(X, N) :- up(X, _), N = count { anc(X, _) }.", "depth(X, N)", "x bigint, n bigint", ANC_SQL + "SELECT x, count(*) AS n FROM anc GROUP BY x"),
    "corr_agg": Named("rank(N, K) :- nation(N, _, _), K = count { nation(M, _, _), M > N }.", "rank(N, K)", "n bigint, k bigint", "SELECT a.n_nationkey::BIGINT AS n, (SELECT count(*) FROM nation b WHERE b.n_nationkey > a.n_nationkey) AS k FROM nation a"),
    # scalars
    "arith": Named("a(P, X, Y, Z) :- part(P, _, _, _, S, _), X = S * 3 - 1, Y = -S, Z = (S + P) * (S - 2).", "a(P, X, Y, Z)", "p bigint, x bigint, y bigint, z bigint", "SELECT p_partkey AS p, (p_size * 3 - 1)::BIGINT AS x, (-p_size)::BIGINT AS y, ((p_size + p_partkey) * (p_size - 2))::BIGINT AS z FROM part"),
    "floor_mod": Named(
        "m(N, A, B, C) :- nation(N, _, _), A = (N - 12) % 5, B = (N - 12) % -5, C = (N + 0.5) % 4.", "m(N, A, B, C)", "n bigint, a bigint, b bigint, c double",
        "SELECT n_nationkey::BIGINT AS n, ((((n_nationkey - 12) % 5) + 5) % 5)::BIGINT AS a, ((((n_nationkey - 12) % 5) - 5) % 5)::BIGINT AS b, ((n_nationkey + 0.5)::DOUBLE % 4::DOUBLE) AS c FROM nation",
    ),
    "exact_div": Named("d(N, H) :- nation(N, _, _), H = N / 4.", "d(N, H)", "n bigint, h double", "SELECT n_nationkey::BIGINT AS n, n_nationkey::DOUBLE / 4 AS h FROM nation"),
    "concat": Named("c(N, T) :- nation(N, Name, R), region(R, Region), T = Region + '/' + Name.", "c(N, T)", "n bigint, t string", "SELECT n_nationkey::BIGINT AS n, r_name || '/' || n_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "total_order": Named(
        "v(X) :- region(X, _). v(X) :- region(_, X). low(X) :- v(X), X < b. first(X) :- X = min Y { v(Y) }.", "low(X), first(F), X >= F", "x string, f string",
        "SELECT r_regionkey::VARCHAR AS x, (SELECT min(r_regionkey) FROM region)::VARCHAR AS f FROM region UNION SELECT r_name, (SELECT min(r_regionkey) FROM region)::VARCHAR FROM region WHERE r_name < 'b'",
    ),
    "comparisons": Named(
        "c(N, R) :- nation(N, _, R), N >= 5, N != 7, R <= 3, N = N + 0.0, R < 4, N > 4.", "c(N, R)", "n bigint, r bigint",
        "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation WHERE n_nationkey >= 5 AND n_nationkey <> 7 AND n_regionkey <= 3",
    ),
    "assign_reverse": Named("c(X, Y) :- Y = X, nation(X, _, _).", "c(X, Y)", XY, "SELECT n_nationkey::BIGINT AS x, n_nationkey::BIGINT AS y FROM nation"),
    # demand, changes
    "demand_closure": Named(LINEAR.replace("anc(X, Z), up(Z, Y)", "up(X, Z), anc(Z, Y)"), "anc(199, W)", "w bigint", ANC_SQL + "SELECT y AS w FROM anc WHERE x = 199", demand=True),
    "demand_same_generation": Named(
        "p(X, Y) :- part(X, _, _, _, _, _), X > 0, Y = (X - X % 4) / 4. sg(X, Y) :- p(X, A), p(Y, A). sg(X, Y) :- p(X, A), sg(A, B), p(Y, B).", "sg(20, Y)", "y bigint",
        "WITH RECURSIVE p AS (SELECT p_partkey AS x, p_partkey // 4 AS y FROM part WHERE p_partkey > 0), sg AS (SELECT a.x, b.x AS y FROM p a JOIN p b ON a.y = b.y WHERE a.x <= 20 UNION SELECT a.x, b.x FROM sg JOIN p a ON a.y = sg.x JOIN p b ON b.y = sg.y WHERE a.x <= 20) SELECT y FROM sg WHERE x = 20",
        demand=True,
    ),
    "incr_insert": Named(LINEAR + " up(X, Y) :- extra(X, Y). extra(0, 0).", "anc(X, Y)", XY, f"WITH RECURSIVE {UP_SQL}, v AS (SELECT x, y FROM up UNION SELECT 1, 0 UNION SELECT 0, 0), anc AS (SELECT x, y FROM v UNION SELECT a.x, v.y FROM anc a JOIN v ON a.y = v.x) SELECT x, y FROM anc", add=("extra(1, 0)",)),
    "incr_retract": Named(LINEAR + " up(X, Y) :- extra(X, Y). extra(1, 0).", "anc(X, Y)", XY, ANC_SQL + "SELECT x, y FROM anc", remove=("extra(1, 0)",)),
    "incr_negation": Named("blocked(1). active(C) :- customer(C, _, _, _, _), not blocked(C).", "active(C)", "c bigint", "SELECT c_custkey AS c FROM customer WHERE c_custkey <> 5", add=("blocked(5)",), remove=("blocked(1)",)),
    "incr_aggregate": Named("in(N, R) :- nation(N, _, R). in(N, R) :- joined(N, R). total(R, K) :- region(R, _), K = count { in(_, R) }.", "total(R, K)", "r bigint, k bigint", "SELECT n_regionkey::BIGINT AS r, count(*) + CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END AS k FROM nation GROUP BY n_regionkey", add=("joined(99, 0)",)),
}


def incr_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asserting one edge adds to the closure."""
    engine = QUERIES["incr_insert"].engine(spark, sf_dir)
    engine.run()
    return typed(engine.update(add=["extra(1, 0)"]).added_table("anc"), XY)


def explain_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rows that one fact of the closure rests on."""
    proof = QUERIES["tc_hierarchy"].engine(spark, sf_dir).explain("anc(199, 1)")
    return spark.createDataFrame([(a.terms[0].value, a.terms[5].value) for a in proof.support()], "part bigint, price double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "incr_delta": incr_delta, "explain_support": explain_support}


def oracle_sql() -> dict[str, str]:
    more = {
        "incr_delta": f"WITH RECURSIVE {UP_SQL}, anc AS (SELECT x, y FROM up UNION SELECT a.x, u.y FROM anc a JOIN up u ON a.y = u.x) SELECT x, 0::BIGINT AS y FROM (SELECT DISTINCT x FROM anc WHERE y = 1 UNION SELECT 1) t(x)",
        "explain_support": "WITH RECURSIVE w AS (SELECT 199::BIGINT AS k UNION SELECT k // 2 FROM w WHERE k > 3) SELECT p_partkey AS part, p_retailprice AS price FROM part JOIN w ON k = p_partkey WHERE k > 1",
    }
    return {name: q.sql for name, q in QUERIES.items()} | more
