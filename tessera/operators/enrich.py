"""Fields that follow from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NATIONALITIES = {
    "United Kingdom": "British",
    "UK": "British",
    "United States": "American",
    "USA": "American",
    "Germany": "German",
    "France": "French",
    "Netherlands": "Dutch",
}
HAVENS = (
    "Cayman Islands", "British Virgin Islands", "BVI", "Bermuda", "Panama", "Jersey", "Guernsey", "Isle of Man",
    "Luxembourg", "Switzerland", "Liechtenstein", "Monaco", "Bahamas",
)
COUNTRIES = {"UK": "United Kingdom", "USA": "United States", "US": "United States"}


def _looked_up(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    found = otherwise
    for name, answer in table.items():
        found = F.when(value == name, answer).otherwise(found)
    return found


def enrich(records: DataFrame) -> DataFrame:
    """Nationality, ids, is_pep and is_offshore where missing, then normalised countries, with _enriched: how many."""
    person, company = F.col("entity_type") == "person", F.col("entity_type") == "company"
    country = F.col("country")
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    name = F.substring(F.upper(F.replace("full_name", F.lit(" "), F.lit("_"))), 1, 20)
    born = F.coalesce(F.replace(F.substring("dob", 1, 10), F.lit("-"), F.lit("")), F.lit("UNKNOWN"))
    steps = {
        "nationality": (person & missing("nationality") & country.isNotNull(), _looked_up(country, NATIONALITIES, F.concat(country, F.lit("an")))),
        "entity_id": (
            missing("entity_id") & F.when(person, F.col("full_name").isNotNull()).otherwise(company & F.col("company_number").isNotNull()),
            F.when(person, F.concat(F.lit("ENT_"), name, F.lit("_"), born)).otherwise(F.concat(F.lit("ENT_CO_"), F.col("company_number"))),
        ),
        "is_pep": (person & F.col("is_pep").isNull(), F.lit(False)),
        "is_offshore": (company & F.col("is_offshore").isNull() & country.isNotNull(), country.isin(*HAVENS)),
        "country": (country.isin(list(COUNTRIES)), _looked_up(country, COUNTRIES, country)),
    }
    tests = {c: F.coalesce(test, F.lit(False)) for c, (test, _) in steps.items()}
    made = {c: F.when(tests[c], value).otherwise(F.col(c)) for c, (_, value) in steps.items()}
    made["_enriched"] = sum((t.cast("int") for t in tests.values()), F.lit(0))
    return records.withColumns(made)


def statistics(enriched: DataFrame) -> DataFrame:
    """records, records_enriched and fields_enriched, one row."""
    return enriched.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("_enriched") > 0).alias("records_enriched"),
        F.coalesce(F.sum("_enriched"), F.lit(0)).alias("fields_enriched"),
    )
