"""Views of points of interest over the base tables.

The texts are portable SQL: Spark runs them for the queries, any other SQL engine can run them for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "places": """
SELECT p_partkey AS place_id, concat(p_name, ' ', p_brand) AS place_name, n_name AS district,
  CAST(n_regionkey AS BIGINT) AS region_id, p_type AS category_name, concat(p_type, ' ', p_name) AS description,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(8 AS DOUBLE) + CAST((p_partkey * 7919) % 5600 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(76 AS DOUBLE) + CAST((p_partkey * 104729) % 4500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS entry_fee,
  CAST(20 + p_size * 2 AS BIGINT) AS avg_visit_duration,
  CAST(p_partkey % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS popularity_score,
  CAST(p_partkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS tourism_relevance
FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
    "categories": """
SELECT category_id, category_name, concat('Places of kind ', category_name) AS description
FROM (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'MEDIUM' THEN 5 END AS category_id, p_type AS category_name FROM part) kinds
WHERE category_id IS NOT NULL""",
    "place_table": """
SELECT p_partkey AS place_id, concat(p_name, ' ', p_brand) AS place_name, n_name AS district,
  CASE WHEN p_partkey % 4 <> 0 THEN concat('Town ', CAST(p_partkey % 60 AS STRING)) END AS city_town,
  CASE WHEN p_partkey % 9 = 0 THEN 'Far State' ELSE 'Home State' END AS state,
  CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'MEDIUM' THEN 5 ELSE 6 END AS category_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat('Kind of ', p_name) END AS subcategory,
  CASE WHEN p_partkey % 13 <> 0 THEN concat(p_type, ' ', p_name, CASE WHEN p_partkey % 3 = 1 THEN ' by the old road' ELSE '' END) END AS description,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(8 AS DOUBLE) + CAST((p_partkey * 7919) % 5600 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(76 AS DOUBLE) + CAST((p_partkey * 104729) % 4500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude,
  CASE WHEN p_partkey % 10 = 3 THEN 'locality' END AS location_precision,
  CASE WHEN p_partkey % 6 = 1 THEN concat(CAST(p_partkey AS STRING), ' Main Road') END AS address,
  CASE WHEN p_partkey % 5 <> 2 THEN '09:00' END AS opening_time, CASE WHEN p_partkey % 5 <> 2 THEN '17:30' END AS closing_time,
  CASE WHEN p_partkey % 2 = 0 THEN 'Daily' ELSE 'Tue-Sun' END AS opening_days,
  CAST(20 + p_size * 2 AS BIGINT) AS avg_visit_duration,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS entry_fee,
  CASE WHEN p_partkey % 3 = 2 THEN 'Winter' END AS best_season,
  CAST(p_partkey % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS popularity_score,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) END AS tourism_relevance,
  p_partkey % 2 = 0 AS verified, CAST(p_partkey % 7 AS BIGINT) AS source_id,
  CAST('2024-01-01' AS DATE) AS created_at, CAST('2024-02-01' AS DATE) AS updated_at,
  CASE WHEN p_partkey % 5 = 1 THEN concat('Q', CAST(p_partkey AS STRING)) END AS external_id,
  CASE WHEN p_partkey % 7 = 2 THEN concat('way/', CAST(p_partkey AS STRING)) END AS map_id,
  concat('https://src.example/', CAST(p_partkey AS STRING)) AS source_url,
  CASE WHEN p_partkey % 50 = 1 THEN concat('Old ', p_name) END AS merged_names
FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
    "place_features": "SELECT p_partkey AS place_id, p_type AS feature FROM part",
    "crowd_data": "SELECT l_partkey AS place_id, l_orderkey AS visit_id, l_linenumber AS crowd_level FROM lineitem WHERE l_linenumber <= 3",
    "ratings": """
SELECT l_partkey AS place_id, CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS rating,
  CAST(l_linenumber AS BIGINT) AS rating_count, l_shipdate AS rating_date, l_suppkey AS source_id
FROM lineitem""",
    "place_sources": """
SELECT l_partkey AS place_id, l_suppkey AS source_id, max(l_shipdate) AS last_seen
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "images": """
SELECT l_partkey AS place_id,
  concat('https://img.example/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING)) AS image_url,
  l_linenumber = 1 AS is_primary, l_suppkey AS source_id
FROM lineitem WHERE l_returnflag = 'R'""",
    "related_districts": """
SELECT a.n_name AS district, b.n_name AS related
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
    "trips": """
SELECT o_orderkey AS trip_id, 1 + o_custkey % 4 AS travelers, 1 + o_orderkey % 5 AS days,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'premium' WHEN o_orderpriority LIKE '5%' THEN 'budget' ELSE 'standard' END AS budget_level,
  CAST(o_orderdate AS DATE) AS start_date
FROM orders""",
    "trip_stops": """
SELECT l_orderkey AS trip_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS stop_no,
  l_partkey AS place_id
FROM lineitem""",
    "festivals": """
SELECT o_orderkey AS festival_id, concat('Festival ', CAST(o_custkey % 50 AS STRING)) AS festival_name,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE n_name END AS district,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
  CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS month
FROM orders JOIN nation ON n_nationkey = o_custkey % 25
WHERE o_orderstatus = 'P'""",
    "place_status": """
SELECT event_id AS status_id, user_id AS place_id,
  CASE event_type WHEN 'error' THEN 'Closed today' WHEN 'signup' THEN 'Path unsafe' ELSE 'Open' END AS status,
  CASE WHEN event_type = 'purchase' THEN value / CAST(500 AS DOUBLE) ELSE NULL END AS suitability_score,
  ts AS checked_at, ts + INTERVAL '24' HOUR AS expires_at
FROM events""",
    "search_points": """
SELECT event_id AS search_id, CAST(8 AS DOUBLE) + CAST((user_id * 37) % 56 AS DOUBLE) / CAST(10 AS DOUBLE) AS latitude,
  CAST(76 AS DOUBLE) + CAST((user_id * 11) % 45 AS DOUBLE) / CAST(10 AS DOUBLE) AS longitude, ts AS search_timestamp
FROM events WHERE event_type = 'view'""",
    "users": """
SELECT c_custkey AS user_id, n_name AS district,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PROMO' WHEN 'BUILDING' THEN 'LARGE' WHEN 'FURNITURE' THEN 'STANDARD' WHEN 'HOUSEHOLD' THEN 'SMALL' ELSE 'ECONOMY' END AS interest
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "source_records": """
SELECT DISTINCT l_suppkey % 8 AS source_rank, l_suppkey AS source_id, l_partkey AS record_key,
  CASE l_suppkey % 4 WHEN 0 THEN concat(p_name, ' ', p_brand) WHEN 1 THEN upper(concat(p_name, ' ', p_brand))
    WHEN 2 THEN concat('Sri ', p_name, ' ', p_brand) ELSE concat(replace(p_name, 'ng', 'nng'), ' ', p_brand) END AS place_name,
  n_name AS district,
  CASE WHEN l_suppkey % 3 = 0 THEN concat('Q', CAST(l_partkey AS STRING)) ELSE NULL END AS external_id
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = p_partkey % 25""",
    "messages": "SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or base table) as a DataFrame; plans are resolved at once, so folders don't mix."""
    if name not in VIEWS:
        return base(spark, sf_dir, name)
    for table in BASE:
        if table in VIEWS[name]:
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views as common table expressions, for another engine."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
