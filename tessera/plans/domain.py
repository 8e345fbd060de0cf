"""The ownership domain over the benchmark's tables, by integer rules; SQL holds the same rules for the checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import closure


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def countries(self) -> DataFrame:
        return self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))

    @cached_property
    def persons(self) -> DataFrame:
        c, k = self.table("customer"), F.col("c_custkey")
        level = F.when(k % 4 == 0, "minister").when(k % 4 == 1, "judge").when(k % 4 == 2, "diplomat").otherwise("senior_official")
        pep = k % 13 == 0
        return c.join(self.countries, c["c_nationkey"] == F.col("n_nationkey")).select(
            F.concat(F.lit("P"), k).alias("id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("full_name"),
            "country", pep.alias("is_pep"), F.when(pep, level).alias("pep_level"), F.lit(False).alias("is_offshore"),
            F.lit(None).cast("int").alias("employee_count"), (1 + k % 4).cast("int").alias("source_count"),
        )

    @cached_property
    def companies(self) -> DataFrame:
        s, k = self.table("supplier"), F.col("s_suppkey")
        return s.join(self.countries, s["s_nationkey"] == F.col("n_nationkey")).select(
            F.concat(F.lit("C"), k).alias("id"), F.lit("company").alias("entity_type"), F.col("s_name").alias("full_name"),
            "country", F.lit(False).alias("is_pep"), F.lit(None).cast("string").alias("pep_level"),
            (F.col("s_nationkey") % 3 == 0).alias("is_offshore"),
            F.when(k % 11 != 5, (k % 7).cast("int")).alias("employee_count"), (1 + k % 3).cast("int").alias("source_count"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return self.persons.unionByName(self.companies)

    @cached_property
    def owns(self) -> DataFrame:
        s, k = self.table("supplier").select("s_suppkey"), F.col("s_suppkey")
        people = self.table("customer").count()  # from the files' footers
        ring = F.expr("(s_suppkey div 10) * 10 + 7 + (s_suppkey % 10 - 6) % 3")
        owner = (
            F.when((k % 10).isin(7, 8, 9), F.concat(F.lit("C"), ring))
            .when((k % 10).isin(0, 4), F.concat(F.lit("P"), k * 11 % people))
            .otherwise(F.concat(F.lit("C"), F.expr("s_suppkey div 2")))
        )
        made = s.select(
            owner.alias("src"), F.concat(F.lit("C"), k).alias("dst"), F.lit("owns").alias("rel"),
            (k * 37 % 100 + 1).cast("double").alias("ownership_percentage"),
        )
        return made.join(self.nodes.select(F.col("id").alias("src")), "src", "left_semi")

    @cached_property
    def boards(self) -> DataFrame:
        lines = self.table("lineitem").filter("l_quantity >= 46").select("l_orderkey", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
            F.concat(F.lit("P"), "o_custkey").alias("src"), F.concat(F.lit("C"), "l_suppkey").alias("dst"),
            F.lit("directorOf").alias("rel"), F.lit(None).cast("double").alias("ownership_percentage"),
        ).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return self.owns.unionByName(self.boards)

    @cached_property
    def closed(self) -> DataFrame:
        return closure(self.owns)

    def named(self, prefix: str, source: DataFrame | None = None) -> DataFrame:
        """The nodes with a prefix before each column."""
        source = self.nodes if source is None else source
        return source.select([F.col(c).alias(f"{prefix}_{c}") for c in source.columns])


SQL = """WITH RECURSIVE
persons AS (SELECT 'P' || c_custkey AS id, 'person' AS entity_type, c_name AS full_name, n_name AS country,
  c_custkey % 13 = 0 AS is_pep, CASE WHEN c_custkey % 13 = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'minister' WHEN 1 THEN 'judge'
  WHEN 2 THEN 'diplomat' ELSE 'senior_official' END END AS pep_level, false AS is_offshore, NULL::INT AS employee_count,
  (1 + c_custkey % 4)::INT AS source_count FROM customer JOIN nation ON c_nationkey = n_nationkey),
companies AS (SELECT 'C' || s_suppkey AS id, 'company' AS entity_type, s_name AS full_name, n_name AS country,
  false AS is_pep, NULL::VARCHAR AS pep_level, s_nationkey % 3 = 0 AS is_offshore,
  CASE WHEN s_suppkey % 11 <> 5 THEN (s_suppkey % 7)::INT END AS employee_count, (1 + s_suppkey % 3)::INT AS source_count
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nodes AS (SELECT * FROM persons UNION ALL SELECT * FROM companies),
made AS (SELECT CASE WHEN s_suppkey % 10 IN (7, 8, 9) THEN 'C' || ((s_suppkey // 10) * 10 + 7 + (s_suppkey % 10 - 6) % 3)
  WHEN s_suppkey % 10 IN (0, 4) THEN 'P' || (s_suppkey * 11 % (SELECT count(*) FROM customer))
  ELSE 'C' || (s_suppkey // 2) END AS src, 'C' || s_suppkey AS dst, 'owns' AS rel,
  (s_suppkey * 37 % 100 + 1)::DOUBLE AS ownership_percentage FROM supplier),
owns AS (SELECT made.* FROM made JOIN nodes ON src = id),
boards AS (SELECT DISTINCT 'P' || o_custkey AS src, 'C' || l_suppkey AS dst, 'directorOf' AS rel,
  NULL::DOUBLE AS ownership_percentage FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 46),
edges AS (SELECT * FROM owns UNION ALL SELECT * FROM boards),
walks AS (SELECT src, dst, 1 AS depth FROM owns UNION
  SELECT walks.src, owns.dst, depth + 1 FROM walks JOIN owns ON walks.dst = owns.src WHERE depth < 25),
closed AS (SELECT src, dst, min(depth) AS depth FROM walks GROUP BY src, dst),
cyclic AS (SELECT src AS id FROM closed WHERE src = dst),
outs AS (SELECT src AS id, count(*) FILTER (rel = 'directorOf') AS director_count, count(*) FILTER (rel = 'owns') AS owned_count
  FROM edges GROUP BY src),
flags AS (SELECT n.*, coalesce(director_count, 0) AS director_count, coalesce(owned_count, 0) AS owned_count,
  c.id IS NOT NULL AS has_circular_ownership, entity_type = 'person' AND coalesce(director_count, 0) >= 5 AS is_nominee_director,
  coalesce(entity_type = 'company' AND is_offshore AND employee_count <= 2, false) AS is_shell
  FROM nodes n LEFT JOIN outs o ON o.id = n.id LEFT JOIN cyclic c ON c.id = n.id),
risk AS (SELECT *, least(100, CASE WHEN is_nominee_director THEN 35 ELSE 0 END + CASE WHEN is_pep THEN 20 ELSE 0 END
  + CASE WHEN is_shell THEN 30 ELSE 0 END + CASE WHEN entity_type = 'company' AND owned_count >= 5 THEN 15 ELSE 0 END
  + CASE WHEN has_circular_ownership THEN 35 ELSE 0 END)::INT AS risk_score, list_filter([
  CASE WHEN is_nominee_director THEN 'NOMINEE_DIRECTOR' END, CASE WHEN is_pep THEN 'POLITICALLY_EXPOSED' END,
  CASE WHEN is_shell THEN 'SHELL_COMPANY' END, CASE WHEN entity_type = 'company' AND owned_count >= 5 THEN 'COMPLEX_OWNERSHIP' END,
  CASE WHEN has_circular_ownership THEN 'CIRCULAR_OWNERSHIP' END], lambda f: f IS NOT NULL) AS factors FROM flags)
"""
