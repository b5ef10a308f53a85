"""Plain SQL over registered views: what users type runs as it is."""

from __future__ import annotations

from ..operators.shell import query_only
from ..session import TABLES, register
from .catalog import query

# name -> (tables, Spark SQL, SQL of the oracle where it is written differently)
STATEMENTS: dict[str, tuple[str, str, str | None]] = {
    "sql_rollup_totals": ("lineitem", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "sql_grouping_sets": ("lineitem", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())", None),
    "sql_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "sql_correlated_subquery": ("orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "sql_exists": ("supplier lineitem", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount > 0.09)", None),
    "sql_in_list": ("nation", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_name NOT IN ('JAPAN', 'FRANCE')", None),
    "sql_cte": ("orders customer", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n >= 3) SELECT c_name, n FROM top JOIN customer ON c_custkey = o_custkey", None),
    "sql_case": ("part", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, count(*) AS n, CAST(min(p_retailprice) AS DECIMAL(12,2)) AS least FROM part GROUP BY 1", None),
    "sql_like": ("part", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '%9'", None),
    "sql_null_filter": ("customer orders", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL", None),
    "sql_join_inner": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'", None),
    "sql_join_left": ("nation supplier", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name", None),
    "sql_join_right": ("nation supplier", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal < 0 GROUP BY n_name", None),
    "sql_join_full": ("supplier customer", "SELECT coalesce(s_suppkey, c_custkey) AS k, s_suppkey IS NULL AS no_supplier, c_custkey IS NULL AS no_customer FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s FULL JOIN (SELECT * FROM customer WHERE c_custkey < 150) c ON s_suppkey = c_custkey", None),
    "sql_join_cross_small": ("region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 5", None),
    "sql_join_natural": ("region", "SELECT r_regionkey, r_name, n FROM region NATURAL JOIN (SELECT r_regionkey, length(r_name) AS n FROM region) x", None),
    "sql_join_self": ("nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "sql_join_theta": ("region nation", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey < n_regionkey GROUP BY r_name", None),
    "sql_lateral_best": ("customer orders", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) best WHERE c_custkey < 300", None),
    "sql_topk_limit": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40", None),
    "sql_order_multi": ("orders", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 100", None),
    "sql_offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40", None),
    "sql_union_all": ("customer supplier", "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0", None),
    "sql_intersect_except": ("customer supplier", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0", None),
    "sql_having_distinct": ("orders", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5", None),
    "sql_string_agg": ("nation region", "SELECT r_name, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "sql_recursive": ("region", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, count(*) AS c FROM t, region WHERE r_regionkey < n GROUP BY n", None),
    "sql_min_max_by": ("orders", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey", None),
    "sql_pivot": ("orders", "SELECT * FROM (SELECT o_orderstatus, substring(o_orderpriority, 1, 1) AS p FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p_))", "SELECT substring(o_orderpriority, 1, 1) AS p, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p_ FROM orders GROUP BY 1"),
    "sql_pricing_summary": ("lineitem", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "sql_embedding_stats": ("embeddings", "SELECT label, count(*) AS n, min(array_size(embedding)) AS dims FROM embeddings GROUP BY label", "SELECT label, count(*) AS n, min(len(embedding)) AS dims FROM embeddings GROUP BY label"),
}


def _add(name: str, tables: str, sql: str, other: str | None) -> None:
    def run(spark, d):
        register(spark, d, tables.split())
        return query_only(spark, sql)

    query(other or sql, name)(run)


for _name, (_tables, _sql, _other) in STATEMENTS.items():
    assert set(_tables.split()) <= set(TABLES)
    _add(_name, _tables, _sql, _other)
