"""Readers and writers over files that the queries write from the benchmark's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import contract, enrich, incremental
from tessera.operators.components import Scratch
from tessera.plans.domain import Domain
from tessera.plans.registry import query
from tessera.sources import generator, readers, sinks

_BATCH = 500  # records of a JSON file


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("s1_csv_scan", """SELECT c_custkey::VARCHAR AS record_id, c_name || ' é' AS full_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END
  AS note FROM customer""", domain=False)
def s1(d: Domain) -> DataFrame:
    """Even keys in UTF-8, odd ones in ISO-8859-1."""
    root, k = Scratch(d.spark, "csv").root, F.col("c_custkey")
    rows = d.table("customer").select(
        k.cast("string").alias("record_id"), _text(F.col("c_name"), " é").alias("full_name"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("note")
    )
    for name, rest, code in (("utf", 0, "UTF-8"), ("latin", 1, "ISO-8859-1")):
        rows.filter(F.col("record_id").cast("long") % 2 == rest).write.csv(f"{root}/{name}", header=True, encoding=code)
    return readers.csv(d.spark, [f"{root}/utf", f"{root}/latin"])


def _json_records(d: Domain) -> DataFrame:
    """Customers as nested records, ``_BATCH`` to a file below an envelope."""
    root, k = Scratch(d.spark, "json").root, F.col("c_custkey")
    record = F.struct(
        _text("R", k).alias("record_id"), F.col("c_name").alias("full_name"),
        F.struct(_text(k % 90, " Road").alias("line1"), F.when(k % 3 == 0, "Floor 2").alias("line2"), F.col("c_mktsegment").alias("city"),
                 F.lit("Wales").alias("country")).alias("address"),
        F.when(k % 4 == 0, F.struct(_text("ENT_CO_", k % 50).alias("entity_id"), (k % 100).alias("percentage"), F.lit("direct").alias("type"))).alias("ownership"),
        F.array(_text("C", k % 7), _text("C", k % 11)).alias("director_of"), F.array(F.lit("a"), _text(k % 3)).alias("tags"),
        F.struct((k % 5).alias("level")).alias("meta"),
    )
    files = d.table("customer").groupBy(F.expr(f"c_custkey div {_BATCH}").alias("file")).agg(F.collect_list(record).alias("records"))
    files.select("file", F.to_json(F.struct("records")).alias("value")).write.partitionBy("file").text(f"{root}/in")
    return readers.json(d.spark, f"{root}/in")


@query("p8_flatten_json", """SELECT 'R' || c_custkey AS record_id, c_name AS full_name, (c_custkey % 90) || ' Road, ' ||
  CASE WHEN c_custkey % 3 = 0 THEN 'Floor 2, ' ELSE '' END || c_mktsegment || ', Wales' AS address, c_mktsegment AS city, 'Wales' AS country,
  CASE WHEN c_custkey % 4 = 0 THEN 'ENT_CO_' || c_custkey % 50 END AS owned_by_entity_id, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 100)::VARCHAR END
  AS ownership_percentage, 'a; ' || c_custkey % 3 AS tags, (c_custkey % 5)::VARCHAR AS meta_level FROM customer""", domain=False)
def p8(d: Domain) -> DataFrame:
    return _json_records(d).select(
        "record_id", "full_name", "address", "city", "country", "owned_by_entity_id", "ownership_percentage", "tags", "meta_level"
    )


@query("p10_json_boards", """SELECT 'R' || c_custkey AS record_id, unnest(['C' || c_custkey % 7, 'C' || c_custkey % 11]) AS director_of_entity_ids
  FROM customer""", domain=False)
def p10(d: Domain) -> DataFrame:
    """One row for each board; ids get no suffix here."""
    return contract.explode_boards(_json_records(d), suffix=False).select("record_id", "director_of_entity_ids")


def _xml(d: Domain) -> str:
    """A folder of files with Person and Company elements."""
    root = Scratch(d.spark, "xml").root
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    place = lambda n: F.struct(
        _text(n % 70, " Lane").alias("Line1"), F.when(n % 2 == 0, "Annex").alias("Line2"), F.lit("Leeds").alias("City"), F.lit("UK").alias("Country")
    )
    people = d.table("customer").select(
        F.when(k % 9 != 0, _text(" ", F.col("c_name"))).alias("FullName"), F.when(k % 2 == 0, "1970-01-02").alias("DateOfBirth"),
        F.when(k % 13 == 0, "true").alias("IsPEP"), F.when(k % 13 == 0, "Minister").alias("Position"), place(k).alias("Address"),
        F.struct(F.when(k % 4 != 0, F.array(_text(k % 30), _text(k % 40))).alias("CompanyNumber")).alias("DirectorOf"),
    )
    firms = d.table("supplier").select(
        F.when(s % 8 != 0, F.col("s_name")).alias("CompanyName"), _text(s).alias("CompanyNumber"),
        F.when(s % 5 == 0, "many").otherwise((s % 60).cast("string")).alias("EmployeeCount"), F.when(s % 3 == 0, "true").alias("IsOffshore"),
        F.struct(_text("E", s % 9).alias("EntityID"), F.when(s % 6 == 0, "half").otherwise((s % 100).cast("string")).alias("Percentage")).alias("OwnedBy"),
    )
    people.write.format("xml").option("rowTag", "Person").option("rootTag", "Data").save(f"{root}/persons")
    firms.write.format("xml").option("rowTag", "Company").option("rootTag", "Data").save(f"{root}/companies")
    return root


@query("p12_xml_persons", """SELECT c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN '1970-01-02' END AS dob, CASE WHEN c_custkey % 13 = 0 THEN 'true' END
  AS is_pep, CASE WHEN c_custkey % 13 = 0 THEN 'Minister' END AS pep_position, (c_custkey % 70) || ' Lane, ' || CASE WHEN c_custkey % 2 = 0 THEN 'Annex, ' ELSE ''
  END || 'Leeds, UK' AS address, CASE WHEN c_custkey % 4 <> 0 THEN 'ENT_CO_' || b END AS board FROM customer,
  unnest(CASE WHEN c_custkey % 4 <> 0 THEN [c_custkey % 30, c_custkey % 40] ELSE [0] END) u(b) WHERE c_custkey % 9 <> 0""", domain=False)
def p12(d: Domain) -> DataFrame:
    found = readers.xml_persons(d.spark, f"{_xml(d)}/persons")
    return found.select("full_name", "dob", "is_pep", "pep_position", "address", F.col("director_of_entity_ids").alias("board"))


@query("s5_xml_companies", """SELECT s_name AS full_name, s_suppkey::VARCHAR AS company_number, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 60)::VARCHAR END
  AS employee_count, CASE WHEN s_suppkey % 3 = 0 THEN 'true' END AS is_offshore, 'E' || s_suppkey % 9 AS owned_by_entity_id,
  CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 100)::DOUBLE END AS share FROM supplier WHERE s_suppkey % 8 <> 0""", domain=False)
def s5(d: Domain) -> DataFrame:
    found = readers.xml_companies(d.spark, f"{_xml(d)}/companies")
    return found.select(
        "full_name", "company_number", "employee_count", "is_offshore", "owned_by_entity_id", F.col("ownership_percentage").cast("double").alias("share")
    )


@query("k1_wide_export", """SELECT c_custkey::VARCHAR AS record_id, 'person' AS entity_type, c_name AS full_name, '' AS dob,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS city FROM customer""", domain=False)
def k1(d: Domain) -> DataFrame:
    """Written as CSV with all the contract's fields and read back; what is empty there is empty here."""
    k = F.col("c_custkey")
    rows = d.table("customer").select(
        k.cast("string").alias("record_id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("full_name"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("city"),
    )
    path = f"{Scratch(d.spark, 'wide').root}/out"
    sinks.export_wide(rows, path)
    found = readers.csv(d.spark, path)
    return found.select("record_id", "entity_type", "full_name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("dob", "city")])


@query("e5_havens_and_countries", """WITH named AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'UK' WHEN 1 THEN 'Panama' WHEN 2 THEN 'USA'
  WHEN 3 THEN 'Germany' WHEN 4 THEN 'Bermuda' ELSE n_name END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT k, k % 2 = 0 AS is_company, CASE c WHEN 'UK' THEN 'United Kingdom' WHEN 'USA' THEN 'United States' ELSE c END AS country,
  CASE WHEN k % 2 = 0 THEN c IN ('Panama', 'Bermuda') END AS is_offshore, CASE WHEN k % 2 <> 0 THEN CASE c WHEN 'UK' THEN 'British' WHEN 'USA' THEN 'American'
  WHEN 'Germany' THEN 'German' ELSE c || 'an' END END AS nationality, CASE WHEN k % 2 <> 0 THEN 'ENT_P' || k || '_' || CASE WHEN k % 5 = 0 THEN 'UNKNOWN' ELSE '19700102'
  END END AS entity_id FROM named""", domain=False)
def e5(d: Domain) -> DataFrame:
    c, k = d.table("customer"), F.col("c_custkey")
    land = F.when(k % 6 == 0, "UK").when(k % 6 == 1, "Panama").when(k % 6 == 2, "USA").when(k % 6 == 3, "Germany").when(k % 6 == 4, "Bermuda")
    null = lambda kind: F.lit(None).cast(kind)
    rows = c.join(d.countries, c["c_nationkey"] == F.col("n_nationkey")).select(
        k.alias("k"), F.when(k % 2 == 0, "company").otherwise("person").alias("entity_type"), _text("p", k).alias("full_name"),
        F.coalesce(land, F.col("country")).alias("country"), F.when(k % 5 != 0, "1970-01-02").alias("dob"), null("string").alias("nationality"),
        null("string").alias("entity_id"), null("boolean").alias("is_pep"), null("boolean").alias("is_offshore"), null("string").alias("company_number"),
    )
    made = enrich.enrich(rows)
    return made.select("k", (F.col("entity_type") == "company").alias("is_company"), "country", "is_offshore", "nationality", "entity_id")


@query("i2_skip_seen", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0", domain=False)
def i2(d: Domain) -> DataFrame:
    """A batch of every third event against a state that holds the even ones."""
    e = d.table("events").select("event_id")
    return incremental.unseen(e.filter("event_id % 3 = 0"), e.filter("event_id % 2 = 0"), "event_id")


@query("s10_generated_records", None)
def s10(d: Domain) -> DataFrame:
    """As many records as there are customers and suppliers, under the contract."""
    made = generator.records(d.spark, d.table("customer").count(), d.table("supplier").count())
    return contract.Contract().normalise(made, "synthetic", "S", ordinal=F.lit(0), ingested_at=F.lit("2024-01-01")).select(
        "record_id", "entity_type", "full_name", "owned_by_entity_id", "ownership_percentage", F.size("_errors").alias("n_errors")
    )
