"""Deterministic synthetic records: persons, companies, ownership and boards, as many as asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FIRST = ("Anna", "Boris", "Carla", "David", "Elena", "Felix", "Grace", "Hugo")
LAST = ("Adams", "Brown", "Costa", "Dubois", "Evans", "Fischer", "Garcia", "Holm")
COUNTRIES = ("United Kingdom", "Germany", "Panama", "France", "Bermuda", "Netherlands")
LEVELS = ("central_bank", "military", "state_enterprise", "minister")


def _draw(seed: int, what: str, options: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(options)).cast("int")


def _one(seed: int, what: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(seed, what, len(values)) + 1)


def records(spark: SparkSession, persons: int, companies: int, seed: int = 1) -> DataFrame:
    """Rows of the wide table's fields, as strings where a raw file has them.

    A tenth of the persons are exposed; persons sit on up to three boards; a company belongs to a company of a smaller
    number or, one in three, to a person; the last three own each other in a ring.
    """
    number = F.format_string("%08d", F.col("id"))
    named = F.concat_ws(" ", _one(seed, "first", FIRST), _one(seed, "last", LAST), F.col("id").cast("string"))
    boards = F.transform(
        F.sequence(F.lit(0), _draw(seed, "boards", 4)),
        lambda n: F.concat(F.lit("ENT_CO_"), F.format_string("%08d", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), n), F.lit(max(1, companies))))),
    )
    people = spark.range(persons).select(
        F.concat(F.lit("SYN_P_"), number).alias("record_id"), F.concat(F.lit("ENT_PERSON_"), number).alias("entity_id"),
        F.lit("person").alias("entity_type"), named.alias("full_name"),
        F.date_add(F.lit("1950-01-01").cast("date"), _draw(seed, "born", 18000)).cast("string").alias("dob"),
        (_draw(seed, "pep", 10) == 0).cast("string").alias("is_pep"),
        F.when(_draw(seed, "pep", 10) == 0, _one(seed, "level", LEVELS)).alias("pep_level"), _one(seed, "land", COUNTRIES).alias("country"),
        F.array_join(F.slice(boards, 2, 3), ";").alias("director_of_entity_ids"),
    )
    ring = F.when(F.col("id") == companies - 1, companies - 3).otherwise(F.col("id") + 1)
    company = lambda c: F.concat(F.lit("ENT_CO_"), F.format_string("%08d", c.cast("long")))
    person = F.concat(F.lit("ENT_PERSON_"), F.format_string("%08d", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(1, persons)))))
    below = F.pmod(F.xxhash64(F.lit(seed), F.lit("owner"), F.col("id")), F.greatest(F.col("id"), F.lit(1)))
    owner = (
        F.when((F.col("id") >= companies - 3) & F.lit(companies >= 3), company(ring))
        .when(_draw(seed, "kind", 3) == 0, person)
        .when(F.col("id") > 0, company(below))
    )
    firms = spark.range(companies).select(
        F.concat(F.lit("SYN_C_"), number).alias("record_id"), F.concat(F.lit("ENT_CO_"), number).alias("entity_id"),
        F.lit("company").alias("entity_type"), F.concat(_one(seed, "last", LAST), F.lit(" Holdings "), F.col("id").cast("string")).alias("full_name"),
        number.alias("company_number"), _one(seed, "land", COUNTRIES).alias("country"), _draw(seed, "staff", 40).cast("string").alias("employee_count"),
        (_draw(seed, "offshore", 4) == 0).cast("string").alias("is_offshore"), owner.alias("owned_by_entity_id"),
        (10 + _draw(seed, "share", 91)).cast("string").alias("ownership_percentage"),
    )
    return people.unionByName(firms, allowMissingColumns=True)
