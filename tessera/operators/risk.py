"""Risk rules over nodes and edges, as column expressions after three aggregations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import on_cycles


@dataclass(frozen=True)
class RiskRules:
    # Fixed values.
    nominee: int = 5
    nominee_score: int = 35
    pep_score: int = 20
    shell_employees: int = 2
    shell_score: int = 30
    complex_edges: int = 5
    complex_score: int = 15
    circular_score: int = 35
    high: int = 20
    medium: int = 10
    high_risk: int = 50  #: of the class HighRisk


def score(nodes: DataFrame, edges: DataFrame, rules: RiskRules = RiskRules(), cyclic: DataFrame | None = None) -> DataFrame:
    """The nodes with counts, flags, risk_score, risk_level and risk_factors.

    nodes: id, entity_type, is_pep, is_offshore, employee_count. edges: src, dst, rel. Flags are computed anew each time,
    and 0 employees is a number like others.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(
        F.count_if(F.col("rel") == "directorOf").alias("director_count"), F.count_if(F.col("rel") == "owns").alias("owned_count")
    )
    cyclic = on_cycles(edges) if cyclic is None else cyclic
    flagged = cyclic.select("id", F.lit(True).alias("has_circular_ownership"))
    joined = nodes.join(out, "id", "left").join(flagged, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    person, company = F.col("entity_type") == "person", F.col("entity_type") == "company"
    joined = joined.withColumns(
        {
            "director_count": zero("director_count"),
            "owned_count": zero("owned_count"),
            "has_circular_ownership": false("has_circular_ownership"),
        }
    )
    shell = company & false("is_offshore") & (F.col("employee_count") <= rules.shell_employees)
    listed = [
        (person & (F.col("director_count") >= rules.nominee), "NOMINEE_DIRECTOR", "HIGH", rules.nominee_score),
        (person & false("is_pep"), "POLITICALLY_EXPOSED", "HIGH", rules.pep_score),
        (F.coalesce(shell, F.lit(False)), "SHELL_COMPANY", "HIGH", rules.shell_score),
        (company & (F.col("owned_count") >= rules.complex_edges), "COMPLEX_OWNERSHIP", "MEDIUM", rules.complex_score),
        (F.col("has_circular_ownership"), "CIRCULAR_OWNERSHIP", "HIGH", rules.circular_score),
    ]
    detail = {
        "NOMINEE_DIRECTOR": F.concat(F.lit("director of "), F.col("director_count").cast("string"), F.lit(" companies")),
        "COMPLEX_OWNERSHIP": F.concat(F.lit("owns "), F.col("owned_count").cast("string"), F.lit(" entities")),
    }
    factors = [
        F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), detail.get(kind, F.lit(kind.lower())).alias("detail")))
        for test, kind, level, _ in listed
    ]
    total = sum((F.when(test, points).otherwise(0) for test, _, _, points in listed), F.lit(0))
    capped = F.least(total, F.lit(100))
    scored = joined.withColumns(
        {
            "is_nominee_director": listed[0][0],
            "is_shell": listed[2][0],
            "risk_score": capped,
            "risk_level": F.when(capped >= rules.high, "HIGH").when(capped >= rules.medium, "MEDIUM").otherwise("LOW"),
            "risk_factors": F.array_compact(F.array(*factors)),
        }
    )
    high = false("is_pep") & person | F.col("is_nominee_director") | F.col("is_shell") | (capped >= rules.high_risk)
    return scored.withColumn("is_high_risk_class", high)


def decision(is_shell, owner_is_pep):
    """REJECT a shell with an exposed owner, enhanced due diligence (EDD) for either, else APPROVE."""
    return F.when(is_shell & owner_is_pep, "REJECT").when(is_shell | owner_is_pep, "EDD").otherwise("APPROVE")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: boards held by companies, targets that are no companies, ends without a node, ids of several nodes."""
    ends = [nodes.select(F.col("id").alias(f"{c}_id"), F.col("entity_type").alias(f"{c}_type")) for c in ("src", "dst")]
    met = edges.join(ends[0], F.col("src") == F.col("src_id"), "left").join(ends[1], F.col("dst") == F.col("dst_id"), "left")
    counts = met.agg(
        F.count_if((F.col("rel") == "directorOf") & (F.col("src_type") != "person")).alias("boards_of_companies"),
        F.count_if(F.col("dst_type") != "company").alias("not_of_companies"),
        F.count_if(F.col("src_id").isNull() | F.col("dst_id").isNull()).alias("unknown_ends"),
    )
    repeated = nodes.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
    return counts.join(F.broadcast(repeated))  # one row each


def first_of(rows: DataFrame, n: int, order: str, *shown: str) -> DataFrame:
    """The first n rows of a report, and the number of all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(order).limit(n).select(order, *shown).join(F.broadcast(total))


def growth(before: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """nodes_before, nodes_after and nodes_new of a batch, by distinct keys."""
    had, came = before.select(key, F.lit(1).alias("old")), batch.select(key, F.lit(0).alias("old"))
    nodes = had.unionByName(came).groupBy(key).agg(F.max("old").alias("old"))
    return nodes.agg(F.sum("old").alias("nodes_before"), F.count(F.lit(1)).alias("nodes_after"), F.count_if(F.col("old") == 0).alias("nodes_new"))


def single_entity(nodes: DataFrame, *parts: str) -> DataFrame:
    """part, entities, most_sources, is_single: entities whose name holds all parts."""
    found = nodes.filter(reduce(lambda a, b: a & b, [F.col("full_name").contains(p) for p in parts]))
    counted = found.agg(F.count(F.lit(1)).alias("entities"), F.max("source_count").alias("most_sources"))
    return counted.select(F.lit("".join(parts)).alias("part"), "entities", "most_sources", (F.col("entities") == 1).alias("is_single"))
