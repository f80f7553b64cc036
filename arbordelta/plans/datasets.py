"""Trees of the rows of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import SEQ, fields_seq, node


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys) -> DataFrame:
    """df over more tasks than there are cores, by the keys if there are any: a small file is read by few tasks, and makes many trees.

    A count given so is kept by adaptive execution, which would join the partitions again by their bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _slug(name: str, key: str) -> Column:
    return F.concat(F.lit(f"{name}_"), F.lpad(F.col(key).cast("string"), 9, "0"))


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(_slug("part", "p_partkey").alias("tree_id"), "p_brand", "p_name", "p_size", "p_type")


def _part_seq(slug: Column, row) -> Column:
    return fields_seq("part", {"slug": slug}, {"brand": row("p_brand"), "name": row("p_name"), "size": row("p_size"), "type": row("p_type")})


def part_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_part_rows(spark, sf_dir)).select("tree_id", _part_seq(F.col("tree_id"), F.col).alias("seq"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_part_rows(spark, sf_dir), _part_seq)


def _customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders in a list. Orders are grouped before the join, so a customer is one row."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    order = F.struct("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    items = spread(o.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(order)).alias("orders"))
    rows = c.join(items.hint("merge"), c.c_custkey == items.o_custkey, "left")
    return rows.select(_slug("customer", "c_custkey").alias("tree_id"), "c_name", "c_mktsegment", "c_nationkey", "orders")


def _customer_seq(slug: Column, row) -> Column:
    item = lambda x: F.array(node("orders_item", None, 3), node("priority", x["priority"], 4), node("status", x["status"], 4)).cast(SEQ)
    orders = row("orders")
    below = F.when(orders.isNull(), F.expr(f"cast(array() as {SEQ})")).otherwise(F.concat(F.array(node("orders", None, 2)).cast(SEQ), F.flatten(F.transform(orders, item))))
    return fields_seq("customer", {"slug": slug}, {"name": row("c_name"), "market_segment": row("c_mktsegment"), "nation": row("c_nationkey")}, below)


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as repeated items."""
    return _customer_rows(spark, sf_dir).select("tree_id", _customer_seq(F.col("tree_id"), F.col).alias("seq"))


def customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_customer_rows(spark, sf_dir), _customer_seq)


def neighbours(rows: DataFrame, seq=lambda slug, row: row("seq")) -> DataFrame:
    """Pairs of each tree with the next one by id: source_id, target_id, a, b. Ids end in a number, so it is an equi-join.

    rows: tree_id and the columns of which seq(tree_id, column by name) makes the tree; these are shuffled, not the trees.
    The join is never a broadcast: Spark would judge a side by the size of its file, which says little about its trees.
    """
    number = F.regexp_extract("tree_id", r"([0-9]+)$", 1).cast("long")
    row = F.struct(*[c for c in rows.columns if c != "tree_id"])
    a = spread(rows.select(F.col("tree_id").alias("source_id"), row.alias("_a"), (number + 1).alias("k")), "k")
    b = spread(rows.select(F.col("tree_id").alias("target_id"), row.alias("_b"), number.alias("k")), "k")
    made = [seq(F.col(i), lambda c, x=x: F.col(x)[c]).alias(n) for n, i, x in (("a", "source_id", "_a"), ("b", "target_id", "_b"))]
    return a.join(b.hint("merge"), "k").select("source_id", "target_id", *made)


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, k, document: a JSON document {meta, normalized} of each supplier."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    slug = F.concat(F.lit("supplier_"), F.lpad(text(k), 9, "0"))
    meta = F.struct(
        F.col("s_name").alias("country_name"), F.concat(F.lit("2024-01-0"), text(k % 9 + 1)).alias("retrieved_at"), slug.alias("slug"), F.lit("table").alias("source"), F.concat(F.lit("http://w/"), text(k)).alias("wikipedia_url"),
    )
    fields = F.struct(
        F.struct(F.concat(text(F.col("s_nationkey")), F.lit(".5")).alias("water_percent"), (k * 37 + 1).alias("total_km2")).alias("area"),
        F.col("n_name").alias("capital"), F.col("s_name").alias("country_name"),
        F.when(k % 4 != 3, F.struct(F.concat(text(k + 1), F.lit(" 500 billion")).alias("gdp_nominal_total"))).alias("economy"),
        F.struct(F.when(k % 3 == 0, "republic").otherwise("monarchy").alias("type")).alias("government"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit(".s"), text(F.col("s_nationkey"))))).otherwise(F.array(F.concat(F.lit(".s"), text(F.col("s_nationkey"))), F.lit(".x"))).alias("internet_tld"),
        F.array(F.concat(F.lit("l"), text(k % 4)), F.lit("en"), F.lit(" ")).alias("languages"),
    )
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nation has 25 rows at any size
    return rows.select(slug.alias("tree_id"), k.alias("k"), F.to_json(F.struct(meta.alias("meta"), F.struct(fields.alias("comparison_fields")).alias("normalized"))).alias("document"))


#: The same trees in DuckDB.
PART_SQL = """parts AS (SELECT 'part_' || lpad(p_partkey::VARCHAR, 9, '0') AS tree_id, [
  {'label': 'part', 'value': NULL::VARCHAR, 'depth': 0}, {'label': 'meta', 'value': NULL, 'depth': 1},
  {'label': 'slug', 'value': 'part_' || lpad(p_partkey::VARCHAR, 9, '0'), 'depth': 2}, {'label': 'fields', 'value': NULL, 'depth': 1},
  {'label': 'brand', 'value': p_brand, 'depth': 2}, {'label': 'name', 'value': p_name, 'depth': 2},
  {'label': 'size', 'value': p_size::VARCHAR, 'depth': 2}, {'label': 'type', 'value': p_type, 'depth': 2}] AS seq FROM part)"""
CUSTOMER_SQL = """items AS (SELECT o_custkey, flatten(list([
  {'label': 'orders_item', 'value': NULL::VARCHAR, 'depth': 3}, {'label': 'priority', 'value': o_orderpriority, 'depth': 4},
  {'label': 'status', 'value': o_orderstatus, 'depth': 4}] ORDER BY o_orderkey)) AS nodes FROM orders GROUP BY o_custkey),
customers AS (SELECT 'customer_' || lpad(c_custkey::VARCHAR, 9, '0') AS tree_id, list_concat([
  {'label': 'customer', 'value': NULL::VARCHAR, 'depth': 0}, {'label': 'meta', 'value': NULL, 'depth': 1},
  {'label': 'slug', 'value': 'customer_' || lpad(c_custkey::VARCHAR, 9, '0'), 'depth': 2}, {'label': 'fields', 'value': NULL, 'depth': 1},
  {'label': 'market_segment', 'value': c_mktsegment, 'depth': 2}, {'label': 'name', 'value': c_name, 'depth': 2},
  {'label': 'nation', 'value': c_nationkey::VARCHAR, 'depth': 2}],
  CASE WHEN nodes IS NULL THEN [] ELSE list_concat([{'label': 'orders', 'value': NULL::VARCHAR, 'depth': 2}], nodes) END) AS seq
  FROM customer LEFT JOIN items ON c_custkey = o_custkey)"""
_NAME = "replace(s_name, '#', ' ')"
SUPPLIER_SQL = f"""suppliers AS (SELECT 'supplier_' || lpad(s_suppkey::VARCHAR, 9, '0') AS tree_id, s_suppkey AS k, s_nationkey AS nk, n_name AS capital, {_NAME} AS name, list_concat([
  {{'label': 'supplier_' || lpad(s_suppkey::VARCHAR, 9, '0'), 'value': NULL::VARCHAR, 'depth': 0}}, {{'label': 'meta', 'value': NULL, 'depth': 1}}, {{'label': 'country_name', 'value': {_NAME}, 'depth': 2}},
  {{'label': 'retrieved_at', 'value': '2024-01-0' || (s_suppkey % 9 + 1), 'depth': 2}}, {{'label': 'slug', 'value': 'supplier_' || lpad(s_suppkey::VARCHAR, 9, '0'), 'depth': 2}},
  {{'label': 'source', 'value': 'table', 'depth': 2}}, {{'label': 'wikipedia_url', 'value': 'http://w/' || s_suppkey, 'depth': 2}}, {{'label': 'fields', 'value': NULL, 'depth': 1}},
  {{'label': 'area', 'value': NULL, 'depth': 2}}, {{'label': 'total_km2', 'value': (s_suppkey * 37 + 1)::VARCHAR, 'depth': 3}}, {{'label': 'water_percent', 'value': s_nationkey || '.5', 'depth': 3}},
  {{'label': 'capital', 'value': n_name, 'depth': 2}}, {{'label': 'country_name', 'value': {_NAME}, 'depth': 2}}],
  CASE WHEN s_suppkey % 4 <> 3 THEN [{{'label': 'economy', 'value': NULL, 'depth': 2}}, {{'label': 'gdp_nominal_total', 'value': (s_suppkey + 1) || '.500 billion', 'depth': 3}}] ELSE [] END,
  [{{'label': 'government', 'value': NULL, 'depth': 2}}, {{'label': 'type', 'value': CASE WHEN s_suppkey % 3 = 0 THEN 'republic' ELSE 'monarchy' END, 'depth': 3}},
   {{'label': 'internet_tld', 'value': NULL, 'depth': 2}}, {{'label': 'internet_tld_item', 'value': 's' || s_nationkey, 'depth': 3}}],
  CASE WHEN s_suppkey % 2 = 1 THEN [{{'label': 'internet_tld_item', 'value': '', 'depth': 3}}] ELSE [] END,
  [{{'label': 'languages', 'value': NULL, 'depth': 2}}, {{'label': 'languages_item', 'value': 'l' || s_suppkey % 4, 'depth': 3}}, {{'label': 'languages_item', 'value': 'en', 'depth': 3}}]) AS seq
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
