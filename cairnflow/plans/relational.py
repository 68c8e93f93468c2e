"""Relational queries over the driver's tables: Spark SQL, and DuckDB SQL where the spelling differs."""

from __future__ import annotations

#: name -> text that runs on both engines, or (Spark SQL, DuckDB SQL)
QUERIES: dict[str, str | tuple[str, str]] = {
    "flagship_event_rates": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value,
        round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY event_type""",
    # sources
    "values_clause": "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
    "select_without_from": "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INTEGER) AS nothing",
    "scan_pushdown": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "scan_time_range": "SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'",
    # filters and scalar expressions
    "filter_3vl": """SELECT c_custkey, c_acctbal FROM customer
        WHERE NOT (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY') AND c_acctbal > 0""",
    "projection": "SELECT o_orderkey, o_totalprice * 2 AS doubled, concat(o_orderstatus, '-', o_orderpriority) AS tag FROM orders",
    "negative": "SELECT c_custkey, -c_acctbal AS minus FROM customer",
    "compare_ops": """SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le,
        p_size > 10 AS gt, p_size >= 10 AS ge FROM part""",
    "like_ilike": """SELECT p_partkey, p_type LIKE '%A%' AS has_a, p_type NOT LIKE '%E_' AS not_e, p_name ILIKE '%PART%' AS named,
        p_brand NOT ILIKE 'brand#1%' AS other FROM part""",
    "regex_anchored": ("SELECT p_partkey FROM part WHERE p_brand RLIKE '^(?s:Brand#[1-2].*)$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^(?s:Brand#[1-2].*)$')"),
    "bool_ops": "SELECT c_custkey, (c_acctbal > 0 AND c_nationkey > 5) OR NOT (c_nationkey < 20) AS ok FROM customer",
    "is_null": "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS open, nullif(o_orderstatus, 'O') IS NOT NULL AS closed FROM orders",
    "cast_numeric": ("SELECT l_orderkey, CAST(l_extendedprice AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem", "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem"),
    "try_cast": "SELECT x, try_cast(x AS INTEGER) AS n FROM (VALUES ('1'), ('x'), (NULL), ('42')) AS t(x)",
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
    "in_list_null": "SELECT n_nationkey, n_nationkey IN (1, 2, NULL) AS hit FROM nation",
    "between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_quantity NOT BETWEEN 10 AND 40",
    "case_searched": """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class FROM orders""",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "arithmetic_int": ("SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS s, l_orderkey - l_linenumber AS d, l_orderkey * 3 AS m, l_orderkey div l_linenumber AS q, l_orderkey % l_linenumber AS r FROM lineitem",
                       "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS s, l_orderkey - l_linenumber AS d, l_orderkey * 3 AS m, l_orderkey // l_linenumber AS q, l_orderkey % l_linenumber AS r FROM lineitem"),
    "arithmetic_float": "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, round(power(l_discount, 2), 9) AS sq, round(atan2(l_tax, l_discount + 1), 9) AS a FROM lineitem",
    "current_time_bound": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 6 HOUR AND ts < TIMESTAMP '2024-01-20 00:00:00'",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "scalar_subquery_empty": "SELECT r_regionkey, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey < 0) AS nothing FROM region",
    "exists_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "exists_uncorrelated": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)",
    "exists_or": "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "not_in_null": "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)",
    "not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "correlated_scalar": """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c""",
    "clamp_greatest_least": "SELECT l_orderkey, l_linenumber, greatest(least(l_quantity, 40.0), 10.0) AS q FROM lineitem",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": """SELECT a.k AS ak, b.k AS bk FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) a
        FULL JOIN (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9800) b ON a.k = b.k""",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_semi": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self_alias": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_derived": """SELECT c_custkey, t.total FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t
        ON c_custkey = t.o_custkey""",
    "join_three_way": """SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON r_regionkey = n_regionkey
        JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name""",
    # aggregates
    "agg_basic": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, min(l_extendedprice) AS low,
        max(l_extendedprice) AS high, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "agg_count_column": "SELECT o_custkey, count(nullif(o_orderstatus, 'F')) AS n FROM orders GROUP BY o_custkey",
    "agg_empty_global": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "agg_sum_int": "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY n_regionkey",
    "agg_min_max_text": "SELECT p_brand, min(p_name) AS low, max(p_type) AS high FROM part GROUP BY p_brand",
    "agg_stddev_variance": """SELECT c_mktsegment, round(stddev_samp(c_acctbal), 5) AS ss, round(stddev_pop(c_acctbal), 5) AS sp,
        round(var_samp(c_acctbal) / 1e6, 6) AS vs, round(var_pop(c_acctbal) / 1e6, 6) AS vp FROM customer GROUP BY c_mktsegment""",
    "agg_stddev_single": "SELECT k, stddev_samp(v) AS s, stddev_pop(v) AS p FROM (VALUES (1, 2.0), (2, 3.0), (2, 5.0)) AS t(k, v) GROUP BY k",
    "agg_corr": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "agg_corr_constant": ("""SELECT g, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(try_divide(covar_pop(x, y), stddev_pop(x) * stddev_pop(y)), 6) END AS c
        FROM (VALUES (1, 1D, 5D), (1, 2D, 5D), (2, 1D, 2D), (2, 2D, 4D), (2, 3D, 7D)) AS t(g, x, y) GROUP BY g""",
                          """SELECT g, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) END AS c
        FROM (VALUES (1, 1::DOUBLE, 5::DOUBLE), (1, 2, 5), (2, 1, 2), (2, 2, 4), (2, 3, 7)) AS t(g, x, y) GROUP BY g"""),
    "agg_quantile": """SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50,
        round(percentile_cont(0.99) WITHIN GROUP (ORDER BY value), 6) AS p99, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value DESC), 6) AS p75 FROM events GROUP BY event_type""",
    "agg_median": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct_tuple": ("SELECT count(DISTINCT l_suppkey, nullif(l_returnflag, 'N')) AS n FROM lineitem",
                                 "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'N')"),
    "agg_frequency_l2": "SELECT l_returnflag, round(sqrt(sum(c * c)), 6) AS l2 FROM (SELECT l_returnflag, l_suppkey, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY l_returnflag, l_suppkey) t GROUP BY l_returnflag",
    "agg_frequency_entropy": ("""SELECT event_type, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 9) AS bits
        FROM (SELECT event_type, user_id, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY event_type, user_id) GROUP BY event_type""",
                              "SELECT event_type, round(entropy(user_id), 9) AS bits FROM events GROUP BY event_type"),
    "agg_group": "SELECT event_type, 1.0E0 AS value FROM events GROUP BY event_type",
    "agg_arg_max_min": ("""SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_custkey""",
                        """SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS dearest, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS cheapest FROM orders GROUP BY o_custkey"""),
    "agg_count_if": "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS n FROM orders GROUP BY o_orderpriority",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 450000) AS n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS m FROM orders GROUP BY o_orderpriority",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND o_custkey > 100",
    "agg_expression_keys": ("SELECT date_part('year', o_orderdate) AS y, round(sum(o_totalprice * 0.1), 2) AS s FROM orders GROUP BY date_part('year', o_orderdate)",
                            "SELECT CAST(date_part('year', o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice * 0.1), 2) AS s FROM orders GROUP BY 1"),
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "agg_sum_distinct": "SELECT n_regionkey, CAST(sum(DISTINCT n_nationkey % 3) AS BIGINT) AS s FROM nation GROUP BY n_regionkey",
    "agg_topk_heavy_hitters": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "agg_count_values": "SELECT event_type, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR(20)) AS value, count(*) AS n FROM events GROUP BY event_type, CAST(floor(value / 50) AS BIGINT)",
    "agg_bonus": "SELECT n_regionkey, bool_and(n_nationkey > 3) AS every, bool_or(n_nationkey > 20) AS some, round(covar_pop(n_nationkey, n_nationkey), 6) AS cv FROM nation GROUP BY n_regionkey",
    # window functions
    "win_rank_family": """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rk,
        dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS dr FROM lineitem
        WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate)""",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_lag_in_frame": """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, CASE WHEN lead(o_orderstatus) OVER w = o_orderstatus THEN lead(o_orderkey) OVER w END AS peer
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)""",
    "win_first_last_nth": """SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS s FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_running": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n,
        min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "win_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS m FROM events",
    "win_range_numeric": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "win_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_whole_partition": "SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation",
    "win_default_range_peers": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM part",
    # sort, limit, sets
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25",
    "sort_by_expression": "SELECT p_partkey FROM part ORDER BY p_size % 7, p_partkey DESC LIMIT 15",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "limit_per_group": "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) t WHERE rn > 1 AND rn <= 3",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey AS k FROM nation",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey AS k FROM nation",
    "intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer",
    "intersect_all": "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey AS k FROM customer",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "set_nulls_equal": "SELECT x FROM (VALUES (1), (NULL), (NULL)) AS a(x) INTERSECT SELECT x FROM (VALUES (NULL), (2)) AS b(x)",
    # scalar functions
    "fn_rounding": "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r FROM customer",
    "fn_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS s, round(exp(l_discount), 9) AS e, round(ln(l_quantity), 9) AS n, round(log2(l_quantity), 9) AS b, round(log10(l_quantity), 9) AS d, round(sin(l_tax), 9) AS si, round(cos(l_tax), 9) AS co, round(tan(l_tax), 9) AS ta FROM lineitem",
    "fn_text": "SELECT p_partkey, lower(p_name) AS lo, upper(p_type) AS up, trim(concat(' ', p_brand, ' ')) AS t, ltrim(concat(' ', p_brand)) AS lt, rtrim(concat(p_brand, ' ')) AS rt, CAST(length(p_name) AS BIGINT) AS n FROM part",
    "fn_octet_length": ("SELECT p_partkey, CAST(octet_length(p_name) AS BIGINT) AS n FROM part", "SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS n FROM part"),
    "fn_date_trunc": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders",
    "fn_extract": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "fn_epoch": ("SELECT event_id, round(unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D, 3) AS e FROM events", "SELECT event_id, round(epoch(ts), 3) AS e FROM events"),
    "fn_regexp": ("SELECT p_partkey, regexp_like(p_type, '[AEIOU]{1}L') AS hit, regexp_replace(p_name, '[0-9]', '#') AS every FROM part",
                  "SELECT p_partkey, regexp_matches(p_type, '[AEIOU]{1}L') AS hit, regexp_replace(p_name, '[0-9]', '#', 'g') AS every FROM part"),
    "fn_regexp_replace_first": ("SELECT p_partkey, CASE WHEN regexp_instr(p_name, '[0-9]') > 0 THEN overlay(p_name PLACING '#' FROM regexp_instr(p_name, '[0-9]') FOR length(regexp_substr(p_name, '[0-9]'))) ELSE p_name END AS one FROM part",
                                "SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#') AS one FROM part"),
    "fn_nullif_coalesce": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s FROM orders",
    "fn_interval": "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS earlier FROM orders",
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "ch_map_access": ("SELECT c_custkey, coalesce(try_element_at(map('a', c_nationkey, 'b', 7), 'a'), 0) AS a, coalesce(try_element_at(map('a', c_nationkey), 'z'), 0) AS z FROM customer",
                      "SELECT c_custkey, coalesce(MAP {'a': c_nationkey, 'b': 7}['a'], 0) AS a, coalesce(MAP {'a': c_nationkey}['z'], 0) AS z FROM customer"),
    "ch_map_concat_first": ("SELECT n_nationkey, coalesce(try_element_at(map('x', n_regionkey), 'x'), try_element_at(map('x', 99, 'y', n_nationkey), 'x')) AS x, element_at(map('x', 99, 'y', n_nationkey), 'y') AS y FROM nation",
                            "SELECT n_nationkey, coalesce(MAP {'x': n_regionkey}['x'], 99) AS x, n_nationkey AS y FROM nation"),
    "ch_array_element": ("SELECT n_nationkey, coalesce(try_element_at(array(n_regionkey, n_nationkey), 1), 0) AS first, coalesce(try_element_at(array(n_regionkey, n_nationkey), -1), 0) AS last, coalesce(try_element_at(array(n_regionkey), 5), 0) AS none FROM nation",
                         "SELECT n_nationkey, n_regionkey AS first, n_nationkey AS last, 0 AS none FROM nation"),
    "ch_tuple_element": ("SELECT n_nationkey, struct(n_name, n_regionkey).n_regionkey AS r FROM nation", "SELECT n_nationkey, n_regionkey AS r FROM nation"),
    "ch_split_by_char": (r"SELECT o_orderkey, split(o_orderpriority, '\\Q-\\E', 2)[0] AS head FROM orders", "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS head FROM orders"),
    "ch_to_date": ("SELECT event_id, to_date(ts) AS d FROM events", "SELECT event_id, CAST(ts AS DATE) AS d FROM events"),
    "ch_match": ("SELECT p_partkey, p_type RLIKE '^[A-M]' AS hit FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS hit FROM part"),
    "ch_start_of": ("""SELECT event_id, unix_seconds(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS h, unix_seconds(CAST(date_trunc('minute', ts) AS TIMESTAMP)) AS m, unix_seconds(CAST(ts AS TIMESTAMP)) div 300 * 300 AS five,
        date_sub(to_date(ts), dayofweek(ts) - 1) AS sunday, to_date(date_trunc('week', ts)) AS monday FROM events""",
                    """SELECT event_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS m, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 AS five,
        CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS sunday, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events"""),
    "ch_start_of_interval": ("SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) div 1800 * 1800 AS half FROM events", "SELECT event_id, CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS half FROM events"),
    "ch_starts_with": ("SELECT p_partkey, startswith(p_brand, 'Brand#1') AS hit FROM part", "SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS hit FROM part"),
    "ch_position_ci": ("SELECT p_partkey, CAST(locate('b', lower(p_name)) AS BIGINT) AS at FROM part", "SELECT p_partkey, CAST(instr(lower(p_name), 'b') AS BIGINT) AS at FROM part"),
    "ch_modulo": "SELECT o_orderkey, o_orderkey % 7 AS m FROM orders",
    # business queries
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    # data-quality and traffic shapes
    "dq_completeness": "SELECT count(*) AS n, round(count(nullif(l_returnflag, 'N')) / count(*), 9) AS completeness, count(DISTINCT l_orderkey) AS keys FROM lineitem",
    "dq_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dq_drift": """SELECT a.l_returnflag, round(a.share - b.share, 9) AS drift FROM (SELECT l_returnflag, count(*) / CAST((SELECT count(*) FROM lineitem WHERE l_quantity < 25) AS DOUBLE) AS share FROM lineitem WHERE l_quantity < 25 GROUP BY l_returnflag) a
        JOIN (SELECT l_returnflag, count(*) / CAST((SELECT count(*) FROM lineitem WHERE l_quantity >= 25) AS DOUBLE) AS share FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag) b ON a.l_returnflag = b.l_returnflag""",
    "traffic_top_talkers": "SELECT l_suppkey AS srcip, count(DISTINCT l_partkey) AS fanout, round(sum(l_quantity), 2) AS bytes FROM lineitem GROUP BY l_suppkey ORDER BY fanout DESC, srcip LIMIT 20",
    "web_hits_by_hour": ("SELECT to_date(ts) AS day, hour(ts) AS hour, event_type, count(*) AS n FROM events GROUP BY to_date(ts), hour(ts), event_type", "SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3"),
}
