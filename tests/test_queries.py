import duckdb
import pytest

from hornbeam.queries import QUERIES, TABLES, oracle_sql, queries

DIR = "/root/testdata/sf0.001"
SLOW = {"tc_right_linear", "agg_over_recursion", "demand_same_generation", "incr_retract"}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW])
def test_same_rows_as_sql(spark, con, name):
    got, want = queries()[name](spark, DIR), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["const_filter"](spark, DIR)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "ReadSchema" in line)
    assert "o_totalprice" not in scan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["tc_hierarchy", "tc_right_linear", "agg_over_recursion", "except_flags", "incr_insert", "incr_retract"])
def test_stored_tuples_are_not_made_distinct_again(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_answers_differ_where_tuples_lose_columns_or_repeat(spark):
    from hornbeam import Engine

    engine = Engine(spark=spark)
    engine.register("t", spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a int, b int"))
    engine.load("p(X, Y) :- t(X, Y). p(X, Y) :- t(Y, X). gone(3).")
    for goal, want in {
        "p(X, Y)": [(1, 2), (1, 3), (2, 1), (3, 1)], "p(X, Y), not gone(Y)": [(1, 2), (2, 1), (3, 1)], "p(X, _)": [(1,), (2,), (3,)],
        "t(X, Y)": [(1, 2), (1, 3)], "p(1, Y), p(Y, _)": [(2,), (3,)], "p(X, Y), X < Y": [(1, 2), (1, 3)],
    }.items():
        assert sorted(map(tuple, engine.query(goal).df.collect())) == want, goal


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["x", "y"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Queries over tables from which more than 5,000,000 tuples follow, which once was a default limit.
BEYOND = ["agg_over_recursion", "except_flags", "tc_nonlinear", "tc_hierarchy", "tc_right_linear", "explain_support", "incr_insert", "incr_retract"]


@pytest.fixture(scope="module")
def beyond(spark, tmp_path_factory):
    at, most = str(tmp_path_factory.mktemp("beyond")), 2_600_000
    keys = spark.range(200).union(spark.range(1 << 23, (1 << 23) + most))
    keys.selectExpr("id p_partkey", "'' p_name", "'' p_brand", "'' p_type", "1 p_size", "id + 0.5D p_retailprice").write.parquet(f"{at}/part.parquet")
    line = "id + k l_orderkey, id l_partkey, id l_suppkey, 1 l_linenumber, 1D l_quantity, 1D l_extendedprice, 0D l_discount, 0D l_tax, CASE k WHEN 0 THEN 'R' ELSE 'N' END l_returnflag, 'O' l_linestatus, timestamp '2000-01-01' l_shipdate"
    spark.range(most).selectExpr("id", "explode(array(0, 1000)) k").selectExpr(*line.split(", ")).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", BEYOND)
def test_beyond_five_million_tuples(spark, beyond, name):
    df = queries()[name](spark, beyond)
    got = df.selectExpr("count(*)", *[f"cast(sum({c}) as double)" for c in df.columns]).first()
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{beyond}/{table}.parquet/*.parquet'")
    sums = ", ".join(f"sum({c})::DOUBLE" for c in df.columns)
    assert tuple(got) == con.execute(f"SELECT count(*), {sums} FROM ({oracle_sql()[name]})").fetchone()
