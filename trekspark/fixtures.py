"""Input views over the base tables, as one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# {EPOCH_US:col} is the time of a timestamp in microseconds.
VIEWS = {
    "fx_p": """
WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
             CAST(floor(({EPOCH_US:ts} - 1704067200000000) / 6e8) AS BIGINT) AS ti FROM events),
w AS (SELECT user_id AS track_id, CAST(user_id % 4 AS INT) AS scene, event_id, ti,
        CAST(SUM(k % 11 - 5) OVER win AS BIGINT) AS ix,
        CAST(SUM(CAST(floor(k / 11e0) AS INT) % 9 - 4) OVER win AS BIGINT) AS iy,
        CAST(SUM(k % 41 - 20) OVER win AS BIGINT) AS iz,
        value / 2e1 AS speed_kmh, CASE WHEN value > 250 THEN 1 ELSE 0 END AS glitch
      FROM e WINDOW win AS (PARTITION BY user_id ORDER BY ti, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT track_id, scene, event_id, CAST(ti AS DOUBLE) AS t_s, 103.3e0 + 5e-1 * scene + ix * 5e-5 + glitch * 1.5e-3 AS lon,
       29.5e0 + 3e-1 * scene + iy * 5e-5 AS lat, 1e3 + iz AS ele, speed_kmh FROM w
""",
    "fx_c": """
SELECT CAST(r_regionkey AS INT) AS scene, CAST(n_nationkey AS INT) AS region_id,
       103.3e0 + 5e-1 * r_regionkey + (n_nationkey % 4 - 1.5e0) * 1e-3 AS lon,
       29.5e0 + 3e-1 * r_regionkey + (floor(n_nationkey / 4e0) - 5e-1) * 1e-3 AS lat
FROM region CROSS JOIN nation WHERE r_regionkey < 4 AND n_nationkey < 8
""",
    "fx_b": """
SELECT CAST(r_regionkey AS INT) AS scene, i, 103.3e0 + 5e-1 * r_regionkey + dx AS lon, 29.5e0 + 3e-1 * r_regionkey + dy AS lat
FROM region CROSS JOIN (VALUES (0,-2e-3,-3e-3),(1,2.5e-3,-2e-3),(2,3e-3,1e-3),(3,5e-4,3e-3),(4,-1e-3,1e-3),(5,-3e-3,1.5e-3)) AS v(i,dx,dy)
WHERE r_regionkey < 4
""",
    "fx_poi": """
SELECT CAST(p_partkey % 4 AS INT) AS scene, p_partkey AS poi_id, p_name AS name,
  CASE p_partkey % 9 WHEN 0 THEN '050100' WHEN 1 THEN '060100' WHEN 2 THEN '080300' WHEN 3 THEN '100000' WHEN 4 THEN '110200'
    WHEN 5 THEN '140100' WHEN 6 THEN '141200' WHEN 7 THEN '170100' ELSE '200300' END AS type_code,
  103.3e0 + 5e-1 * (p_partkey % 4) + ((p_partkey * 7919) % 121 - 60) * 5e-5 AS lon,
  29.5e0 + 3e-1 * (p_partkey % 4) + ((p_partkey * 104729) % 81 - 40) * 5e-5 AS lat FROM part
""",
    "fx_dem": """
SELECT CAST(g.r_regionkey AS INT) AS tile, CAST(a.n_nationkey AS INT) AS row_i, CAST(b.n_nationkey AS INT) AS col_i,
  CASE WHEN (a.n_nationkey * 7 + b.n_nationkey) % 29 = 0 THEN NULL ELSE 8e2 + ((a.n_nationkey * 31 + b.n_nationkey * 17) % 97) * 1e1 END AS z
FROM region g CROSS JOIN nation a CROSS JOIN nation b WHERE g.r_regionkey < 4
""",
    "fx_r": """
WITH v AS (SELECT o_custkey, floor({EPOCH_US:l_shipdate} / 864e8) * 6e1 AS t_s, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey AS track_id, CAST(o_custkey % 5 AS INT) AS scene, CAST(o_custkey % 6 AS INT) AS route_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY t_s, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS event_id, t_s,
  CAST(l_suppkey % 12 AS INT) AS region_id, CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END AS is_stop FROM v
""",
    "fx_s": """
SELECT CAST(l_orderkey % 20 AS INT) AS scene, l_orderkey AS track,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INT) AS seg_idx,
  5e2 + l_quantity AS dist_m, l_extendedprice / 1e3 AS up_m, l_discount * 5e2 AS down_m,
  (l_extendedprice / 1e3 - l_discount * 5e2) / (5e2 + l_quantity) AS mean_grade, l_tax + 1e-1 AS max_grade,
  5e2 + l_partkey % 1500 AS elev_mean, 4.5e2 + l_partkey % 1500 AS start_ele, (l_partkey % 240) / 1e1 AS tod_hour,
  3e2 + 4 * (l_extendedprice / 1e3) + l_discount * 5e2 + (l_orderkey % 20) * 10 + (l_suppkey % 50) * 4 AS dur_s,
  ((5e2 + l_quantity) / 1e3 / 5 + (l_extendedprice / 1e3) / 6e2) * 3.6e3 AS naismith_s FROM lineitem
""",
    "fx_res": """
SELECT scene AS target, CAST(seg_idx % 5 AS INT) AS seed, g AS grp, 'zero-shot' AS setting, 'lin' AS model,
  round(avg(abs(dur_s - CASE WHEN g = 'full' THEN 3.9e2 + 4 * up_m + down_m ELSE 6e2 + scene * 5e0 END)) / 6e1, 6) AS mae_min,
  CAST(count(*) AS BIGINT) AS n_seg, CAST(count(DISTINCT track) AS BIGINT) AS n_track
FROM fx_s CROSS JOIN (VALUES ('full'),('no_slope')) AS v(g) GROUP BY scene, seg_idx % 5, g
""",
    "fx_pred": """
WITH s AS (SELECT *, lead(region_id) OVER o AS nxt, (lead(t_s) OVER o) - t_s AS dur, row_number() OVER o AS pos FROM fx_r WINDOW o AS (PARTITION BY track_id ORDER BY t_s, event_id)),
c AS (SELECT region_id, nxt, count(*) AS n, avg(dur) AS mu, stddev_samp(dur) AS sd FROM s WHERE nxt IS NOT NULL AND track_id % 10 < 7 GROUP BY region_id, nxt),
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, nxt) AS rk FROM c)
SELECT s.track_id, s.scene, s.pos, s.region_id, s.nxt AS true_next, r.nxt AS pred_next, s.dur AS true_dur, r.mu, r.sd + 1e0 AS sigma
FROM s JOIN r ON s.region_id = r.region_id AND r.rk = 1 WHERE s.nxt IS NOT NULL AND s.track_id % 10 >= 7
""",
}


def _epoch(sql: str, spark: bool) -> str:
    return re.sub(r"\{EPOCH_US:(\w+)\}", r"unix_micros(CAST(\1 AS TIMESTAMP))" if spark else r"epoch_us(\1)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a view over base tables and other views."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _epoch(VIEWS[name], True)
    used = sorted({x for x in re.findall(r"\w+", text) if x in TABLES or (x in VIEWS and x != name)})
    for x in used:
        view(spark, sf_dir, x).createOrReplaceTempView(x)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views that it uses as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for x in re.findall(r"\bfx_\w+", text):
            if x in VIEWS and x not in need:
                visit(VIEWS[x])
                if x not in need:
                    need.append(x)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{x} AS ({_epoch(VIEWS[x], False)})" for x in need)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own[1] or ''}{head}, {sql[own.end():]}" if own else f"WITH {head} {sql}"
