"""The contract of the wide table: fields, aliases, types, rules; and records normalised and validated by it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank_to_null

# The contract's fields and types, aliases and rules.
TYPES = {
    "record_id": "string",
    "entity_id": "string",
    "entity_type": "string",
    "full_name": "string",
    "dob": "string",
    "nationality": "string",
    "is_pep": "boolean",
    "pep_level": "string",
    "company_number": "string",
    "date_incorporated": "string",
    "employee_count": "int",
    "is_offshore": "boolean",
    "address": "string",
    "city": "string",
    "country": "string",
    "owned_by_entity_id": "string",
    "ownership_percentage": "double",
    "director_of_entity_ids": "string",
    "source_type": "string",
    "batch_id": "string",
    "ingested_at": "string",
}
ALIASES = {
    "full_name": ("full_name", "fullName", "Name", "CompanyName", "PersonName"),
    "company_number": ("company_number", "companyNumber", "CompanyNumber", "registration_number"),
    "dob": ("dob", "date_of_birth", "dateOfBirth", "DateOfBirth"),
    "country": ("country", "Country", "jurisdiction"),
    "is_pep": ("is_pep", "isPEP", "pep_flag"),
    "pep_level": ("pep_level", "pepLevel", "position_level"),
}
REQUIRED = ("record_id", "entity_type", "full_name")
RULES = (
    {"field": "entity_type", "rule": "must_be_one_of", "values": ("person", "company")},
    {"field": "full_name", "rule": "min_length", "value": 2},
    {"field": "ownership_percentage", "rule": "range", "min": 0, "max": 100},
    {"field": "employee_count", "rule": "min_value", "value": 0},
    {"field": "company_number", "rule": "pattern", "value": "^[0-9]{8}$"},
)
_TRUE = ("true", "1", "yes", "y")


@dataclass(frozen=True)
class Contract:
    types: dict[str, str] = field(default_factory=lambda: dict(TYPES))
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALIASES))
    required: tuple[str, ...] = REQUIRED
    rules: tuple[dict, ...] = RULES

    @classmethod
    def load(cls, path: str) -> Contract:
        """From a YAML file with field_types, field_mappings, required_fields and validation_rules."""
        import yaml

        with open(path, encoding="utf-8") as file:
            raw = yaml.safe_load(file)
        kinds = {"integer": "int", "float": "double", "boolean": "boolean"}
        return cls(
            {name: kinds.get(kind, "string") for name, kind in raw["field_types"].items()},
            {name: tuple(found) for name, found in raw.get("field_mappings", {}).items()},
            tuple(raw["required_fields"]),
            tuple(raw["validation_rules"]),
        )

    def errors(self, columns: list[str]) -> Column:
        """Messages of the broken rules, in their order. Empty values break only the required ones."""
        found = []
        for name in self.required:
            value = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
            found.append(F.when(value.isNull() | (value == ""), F.lit(f"{name}: required")))
        for rule in self.rules:
            name, kind = rule["field"], rule["rule"]
            if name not in columns:
                continue
            value, number = F.col(name).cast("string"), F.expr(f"try_cast(`{name}` AS DOUBLE)")
            if kind == "must_be_one_of":
                good = value.isin(list(rule["values"]))
            elif kind == "min_length":
                good = F.length(value) >= rule["value"]
            elif kind == "range":
                good = number.between(rule["min"], rule["max"])
            elif kind == "min_value":
                good = number >= rule["value"]
            elif kind == "pattern":
                good = value.rlike("^(?:" + rule["value"] + ")")
            else:
                raise ValueError(f"unknown rule {kind}")
            given = value.isNotNull() & (value != "")
            if kind in ("range", "min_value"):
                found.append(F.when(given & number.isNull(), F.lit(f"{name}: not a number")))
                given = given & number.isNotNull()
            found.append(F.when(given & ~F.coalesce(good, F.lit(False)), F.lit(f"{name}: {kind}")))
        return F.array_compact(F.array(*found))

    def validated(self, records: DataFrame) -> DataFrame:
        return records.withColumn("_errors", self.errors(records.columns))

    def _typed(self, name: str, value: Column) -> Column:
        kind = self.types[name]
        if kind == "int":
            return F.expr("CAST(NULL AS INT)") if value is None else value.try_cast("double").cast("int")
        if kind == "double":
            return value.try_cast("double")
        if kind == "boolean":
            return F.when(value.isNotNull(), F.lower(F.trim(value)).isin(*_TRUE))
        return value

    def normalise(
        self, raw: DataFrame, source_type: str, batch_id: str, ordinal: Column | None = None, ingested_at: Column | None = None
    ) -> DataFrame:
        """All fields of the contract from aliased columns, typed, stamped and with ids, plus _errors and _converted.

        ``ordinal``: numbers of the rows from 0, for the ids of those without one. _converted names the fields whose
        value could not be converted and is NULL.
        """
        value = {}
        for name in self.types:
            spelled = [a for a in self.aliases.get(name, (name,)) if a in raw.columns]
            listed = [blank_to_null(F.col(f"`{a}`")) for a in spelled]
            value[name] = F.coalesce(*listed) if listed else F.lit(None).cast("string")
        form = source_type.split("_")[0].upper()
        if ordinal is None:
            raw, ordinal = numbered(raw), F.col("_ordinal")
        number = ordinal
        made = F.format_string(f"{batch_id}_{form}_REC_%06d", number.cast("long"))
        value["record_id"] = F.coalesce(value["record_id"], made)
        value["source_type"] = F.coalesce(value["source_type"], F.lit(source_type))
        value["batch_id"] = F.coalesce(value["batch_id"], F.lit(batch_id))
        stamp = ingested_at if ingested_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        value["ingested_at"] = F.coalesce(value["ingested_at"], stamp)
        lost = [
            F.when(v.isNotNull() & self._typed(n, v).isNull(), F.lit(n)) for n, v in value.items() if self.types[n] in ("int", "double")
        ]
        typed = raw.select(
            *[self._typed(n, v).alias(n) for n, v in value.items()], F.array_compact(F.array(*lost)).alias("_converted")
        )
        return self.validated(typed)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with _ordinal, numbers from 0 without gaps in the order of partitions.

    Partitions are counted first; only one row for each of them is summed up in a window and broadcast.
    """
    parted = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    starts = sizes.select(F.col("_part").alias("_of"), before.alias("_start"))
    joined = parted.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("_ordinal", F.col("_start") + place).drop("_part", "_place", "_of", "_start")


def statistics(validated: DataFrame) -> DataFrame:
    """total_parsed, normalized, failed, success_rate (0 without rows)."""
    bad = F.count_if(F.size("_errors") > 0)
    total = F.count(F.lit(1))
    return validated.agg(
        total.alias("total_parsed"),
        (total - bad).alias("normalized"),
        bad.alias("failed"),
        F.when(total > 0, F.round((total - bad) / total, 4)).otherwise(0.0).alias("success_rate"),
    )


def explode_boards(records: DataFrame, column: str = "director_of_entity_ids", suffix: bool = True) -> DataFrame:
    """One row for each company of a ``;`` list; later ones get ``_01``, ``_02`` … after the record id."""
    listed = F.filter(F.transform(F.split(column, ";"), lambda c: F.trim(c)), lambda c: c != "")
    others = [c for c in records.columns if c not in (column, "record_id")]
    spread = records.select("record_id", *others, F.posexplode_outer(listed).alias("_at", "_board"))
    numbered = F.format_string("%s_%02d", F.col("record_id"), F.col("_at"))
    ident = F.when((F.col("_at") > 0) & F.lit(suffix), numbered).otherwise(F.col("record_id"))
    return spread.select(ident.alias("record_id"), *others, F.col("_board").alias(column))
