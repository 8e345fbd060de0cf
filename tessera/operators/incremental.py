"""Batches of new records against golden ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import golden as survivors
from tessera.operators.components import Scratch, linked_components
from tessera.operators.matching import Matcher
from tessera.operators.risk import RiskRules
from tessera.operators.risk import score as risk_score


@dataclass(frozen=True)
class State:
    records: DataFrame  #: all source records seen, with cluster_id
    golden: DataFrame  #: golden records with block_key
    edges: DataFrame | None = None  #: between golden records
    risk: DataFrame | None = None  #: golden records with flags, scores and factors


def unseen(batch: DataFrame, known: DataFrame, key: str = "record_id") -> DataFrame:
    """The records of a batch whose key is not known, so a batch that comes again changes nothing."""
    return batch.join(known.select(key), key, "left_anti")


def linked(state: State, rules: RiskRules = RiskRules()) -> State:
    """The state with edges between its golden records, resolved by the aliases of all records, and with risk."""
    wanted = {"owned_by_entity_id": "string", "ownership_percentage": "double", "director_of_entity_ids": "string",
              "is_pep": "boolean", "is_offshore": "boolean", "employee_count": "int"}
    more = {c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in state.golden.columns}
    golden = state.golden.withColumns(more) if more else state.golden
    scratch = Scratch(golden.sparkSession, "linked")
    edges = scratch.table(survivors.edges(golden, survivors.aliases(state.records, golden)), "edges")
    nodes = golden.withColumn("id", F.col("golden_id"))
    return State(state.records, state.golden, edges, scratch.table(risk_score(nodes, edges, rules), "risk"))


def clusters(records: DataFrame, matched: DataFrame) -> DataFrame:
    """records with cluster_id: the least record id that matches (src, dst) reach; singles are their own."""
    parts = linked_components(matched)
    joined = records.join(parts, records["record_id"] == parts["node"], "left")
    return joined.withColumn("cluster_id", F.coalesce("component", "record_id")).drop("node", "component")


def links_of(blocked: DataFrame, matcher: Matcher) -> DataFrame:
    """src, dst: links that connect just what matching records of one block do; blocked: a written table with block keys.

    Each record meets the least one of its block, type and number first; then all pairs that this left apart are compared,
    so a block of alike records costs its rows, not its square.
    """
    scratch = Scratch(blocked.sparkSession, "pairs")
    link = [F.col("l_record_id").alias("src"), F.col("r_record_id").alias("dst")]
    led = scratch.table(matcher.matches(matcher.led(blocked)).select(*link), "led")
    parts = led.select(F.col("dst").alias("record_id"), F.col("src").alias("_part")).distinct()
    apart = blocked.join(parts, "record_id", "left").withColumn("_part", F.coalesce("_part", "record_id"))
    rest = matcher.matches(matcher.linkable(scratch.table(apart, "apart"), apart="_part"))
    return led.unionByName(rest.select(*link))


def resolve(
    records: DataFrame, matcher: Matcher = Matcher(), rules: survivors.Survivorship = survivors.Survivorship(), graph: bool = True
) -> State:
    """One batch from nothing: block, match, cluster, merge. Without ``graph`` the state has no edges and no risk."""
    scratch = Scratch(records.sparkSession, "resolve")
    blocked = scratch.table(matcher.with_block(records), "blocked")
    grouped = scratch.table(clusters(blocked.select(*records.columns), links_of(blocked, matcher)), "records")
    state = State(grouped, scratch.table(matcher.with_block(survivors.build(grouped, rules=rules)), "golden"))
    return linked(state) if graph else state


def process(
    state: State, batch: DataFrame, matcher: Matcher = Matcher(), rules: survivors.Survivorship = survivors.Survivorship(), graph: bool = True
) -> State:
    """The state after a batch. Records seen before are skipped; new ones join the golden record of the best match or
    each other; the order of records has no influence. Golden records and block keys are made anew, from lineage, where
    a record came in or clusters merged; all others stay as they are. Edges and risk are those of the whole new
    graph; without ``graph`` there are none."""
    scratch = Scratch(batch.sparkSession, "batch")
    fresh = unseen(batch, state.records)
    blocked = scratch.table(matcher.with_block(fresh), "fresh")
    fresh = blocked.select(*fresh.columns)
    onto = matcher.best(blocked, state.golden.withColumn("source_type", F.element_at("source_types", 1)))
    links = onto.unionByName(links_of(blocked, matcher))
    parts = linked_components(links)
    known = state.records.withColumn("_new", F.lit(False))
    every = known.unionByName(fresh.withColumn("cluster_id", F.col("record_id")).withColumn("_new", F.lit(True)))
    joined = every.join(parts, every["cluster_id"] == parts["node"], "left").withColumn("_was", F.col("cluster_id"))
    grouped = joined.withColumn("cluster_id", F.coalesce("component", "cluster_id")).drop("node", "component")
    grouped = scratch.table(grouped, "records")
    moved = grouped.filter("_new OR _was <> cluster_id")
    touched = scratch.table(moved.select("cluster_id").distinct(), "touched")
    gone = touched.unionByName(moved.select(F.col("_was").alias("cluster_id"))).distinct()
    records = grouped.drop("_new", "_was")
    made = matcher.with_block(survivors.build(records.join(touched, "cluster_id", "left_semi"), rules=rules))
    kept = state.golden.join(gone, "cluster_id", "left_anti")
    after = State(records, scratch.table(kept.unionByName(made.select(*kept.columns)), "golden"))
    return linked(after) if graph else after


def changes(before: State, after: State) -> DataFrame:
    """cluster_id, change (inserted, updated, unchanged), source_count: an audit of golden records."""
    old = before.golden.select(F.col("cluster_id").alias("was"), F.col("source_count").alias("had"))
    now = after.golden.select("cluster_id", "source_count")
    kind = F.when(F.col("had").isNull(), "inserted").when(F.col("had") < F.col("source_count"), "updated").otherwise("unchanged")
    return now.join(old, now["cluster_id"] == old["was"], "left").select("cluster_id", kind.alias("change"), "source_count")
