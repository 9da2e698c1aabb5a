"""Generic relational coverage on the star schema: one text serves both engines."""

from __future__ import annotations

from cuelake.registry import query, table

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

SQL = {
    "rel_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "rel_region_revenue": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "rel_semi_orders": """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)""",
    "rel_anti_customers": """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "rel_rollup": """SELECT n_regionkey, c_nationkey, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)""",
    "rel_cube": """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "rel_set_operations": """SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) b
UNION ALL SELECT 'except', CAST(count(*) AS BIGINT) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) c""",
    "rel_ranking_windows": """SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS following FROM orders) t WHERE place <= 3""",
    "rel_top_parts": """SELECT l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_partkey ORDER BY qty DESC, l_partkey LIMIT 20""",
    "rel_full_outer": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS only_label, l.doc_id IS NULL AS only_doc FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL OUTER JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""",
    "rel_conditional_counts": """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large, round(avg(coalesce(value, 0)), 6) AS mean FROM events GROUP BY event_type""",
    "rel_range_join": """SELECT c.event_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') c JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND v.ts <= c.ts AND v.ts > c.ts - INTERVAL '1' DAY GROUP BY c.event_id""",
    "rel_correlated": """SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AND p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 25)""",
}


def _register(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


for _name, _sql in SQL.items():
    _register(_name, _sql)
