"""Golden records: survivorship over the records of a cluster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priorities of sources, and which strategy resolves a field.
PRIORITIES = {
    "xml_companies_house": 100,
    "json_land_registry": 90,
    "csv_internal": 80,
    "regulatory": 100,
    "internal": 80,
    "external_verified": 60,
    "external": 40,
    "synthetic": 20,
}
STRATEGIES = {
    "full_name": "most_complete",
    "dob": "most_complete",
    "address": "most_recent",
    "nationality": "source_priority",
    "company_number": "source_priority",
    "country": "source_priority",
    "is_offshore": "source_priority",
    "employee_count": "source_priority",
    "is_pep": "source_priority",
    "pep_level": "source_priority",
}
UNKNOWN_PRIORITY = 40
SKIPPED = ("record_id", "entity_id", "source", "source_type", "batch_id", "ingested_at", "entity_type", "director_of_entity_ids")


_PRINTABLE = "".join(map(chr, range(32, 127)))


def _descending(text: Column) -> Column:
    """A text of ASCII that sorts the other way round, NULL last."""
    turned = F.translate(text, _PRINTABLE, _PRINTABLE[::-1])
    return F.coalesce(F.concat(turned, F.lit("\x7f")), F.lit("\uffff"))


@dataclass(frozen=True)
class Survivorship:
    priorities: dict[str, int] = field(default_factory=lambda: dict(PRIORITIES))
    strategies: dict[str, str] = field(default_factory=lambda: dict(STRATEGIES))
    default: str = "most_complete"
    drop_falsy: bool = False  #: treat false and 0 as missing

    def resolve(self, name: str, ordinal: Column) -> Column:
        """An aggregate; ties go to the least ordinal."""
        value = F.col(name)
        if self.drop_falsy:
            value = F.when(~value.cast("string").isin("false", "0", "0.0", ""), value)
        kept = value.isNotNull()
        strategy = self.strategies.get(name, self.default)
        if strategy == "most_complete":
            order = F.struct(-F.length(value.cast("string")), ordinal)
        elif strategy == "source_priority":
            rank = F.lit(UNKNOWN_PRIORITY)
            for source, priority in self.priorities.items():
                rank = F.when(F.col("source_type") == source, priority).otherwise(rank)
            order = F.struct(-rank, ordinal)
        elif strategy == "most_recent":
            order = F.struct(_descending(F.col("ingested_at")), ordinal)
        else:
            order = F.struct(ordinal)
        return F.min_by(value, F.when(kept, order)).alias(name)


def build(records: DataFrame, cluster: str = "cluster_id", rules: Survivorship = Survivorship()) -> DataFrame:
    """One row per cluster: resolved fields, lineage and counts. Order of records: (ingested_at, record_id)."""
    ordinal = F.struct("ingested_at", "record_id")
    fields = [c for c in records.columns if c not in (*SKIPPED, cluster)]
    types = records.groupBy(cluster, "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    best = Window.partitionBy(cluster).orderBy(F.desc("n"), "first")
    majority = types.withColumn("place", F.row_number().over(best)).filter("place = 1").select(cluster, "entity_type")
    aggregates = [rules.resolve(c, ordinal) for c in fields]
    if "director_of_entity_ids" in records.columns:
        split = F.filter(F.transform(F.split("director_of_entity_ids", ";"), lambda c: F.trim(c)), lambda c: c != "")
        joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list(split))))
        aggregates.append(F.array_join(joined, ";").alias("director_of_entity_ids"))
    merged = records.groupBy(cluster).agg(
        *aggregates,
        F.array_sort(F.collect_set("record_id")).alias("source_record_ids"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
        F.count_distinct("record_id").alias("source_count"),
        F.min("record_id").alias("first_record"),
    )
    return merged.join(majority, cluster).withColumn("golden_id", F.concat(F.lit("GOLDEN_"), F.col("first_record"))).drop("first_record")


def aliases(records: DataFrame, golden: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """alias, golden_id: by record, entity, company number and ENT_CO_ number."""
    named = records.join(golden.select(cluster, "golden_id"), cluster)
    listed = F.array("golden_id", "record_id", "entity_id", "company_number", F.concat(F.lit("ENT_CO_"), F.col("company_number")))
    return named.select(F.explode(F.array_compact(listed)).alias("alias"), "golden_id").distinct()


def resolve_aliases(wanted: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The rows of ``wanted`` with golden_id: the first spelling of the id that is known; rows without one are left out."""
    raw = F.col(column)
    spellings = F.array(
        raw,
        F.concat(F.lit("ENT_CO_"), raw),
        F.regexp_replace(raw, "^ENT_COMPANY_", ""),
        F.regexp_replace(raw, "^ENT_PERSON_", ""),
    )
    tried = wanted.select("*", F.posexplode(spellings).alias("spelling", "alias"))
    met = tried.join(known, "alias")
    place = Window.partitionBy(*wanted.columns).orderBy("spelling", "golden_id")
    return met.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place", "spelling", "alias")


def edges(golden: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst, rel, ownership_percentage, ownership_type, role: one row for each pair and relation."""
    owned = golden.filter("owned_by_entity_id IS NOT NULL").select(
        F.col("golden_id").alias("dst"), "owned_by_entity_id", "ownership_percentage"
    )
    owns = resolve_aliases(owned, known, "owned_by_entity_id").select(
        F.col("golden_id").alias("src"), "dst", F.lit("owns").alias("rel"), "ownership_percentage",
        F.lit("beneficial").alias("ownership_type"), F.lit(None).cast("string").alias("role"),
    )
    boards = golden.filter("entity_type = 'person'").select(
        F.col("golden_id").alias("src"), F.explode(F.split("director_of_entity_ids", ";")).alias("board")
    )
    directs = resolve_aliases(boards.filter("board <> ''"), known, "board").select(
        "src", F.col("golden_id").alias("dst"), F.lit("directorOf").alias("rel"),
        F.lit(None).cast("double").alias("ownership_percentage"), F.lit(None).cast("string").alias("ownership_type"),
        F.lit("director").alias("role"),
    )
    return owns.unionByName(directs).dropDuplicates(["src", "dst", "rel"])


def unresolved(golden: DataFrame, known: DataFrame) -> DataFrame:
    """golden_id, wanted: owners that no alias names."""
    owned = golden.filter("owned_by_entity_id IS NOT NULL").select("golden_id", F.col("owned_by_entity_id").alias("wanted"))
    met = resolve_aliases(owned.withColumnRenamed("golden_id", "of"), known, "wanted")
    return owned.join(met.select(F.col("of").alias("golden_id"), "wanted"), ["golden_id", "wanted"], "left_anti")
