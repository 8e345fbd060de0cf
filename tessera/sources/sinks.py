"""Outputs: the graph as triples and nested JSON, quarantined rows, and versions of the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.contract import TYPES

ENTITY, UBO = "http://example.org/entity/", "http://example.org/ubo#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PIPELINE = "urn:pipeline:ubo-graph-v1"  # a fixed value
PROV, XSD = "http://www.w3.org/ns/prov#", "http://www.w3.org/2001/XMLSchema#"


def _literal(predicate: str, value: Column, datatype: str = "string", when: Column | None = None) -> Column:
    text = value.cast("string")
    made = F.struct(
        F.lit(UBO + predicate if "://" not in predicate else predicate).alias("p"),
        text.alias("o"),
        F.lit("literal").alias("o_kind"),
        F.lit(XSD + datatype).alias("datatype"),
    )
    return F.when(text.isNotNull() & (when if when is not None else F.lit(True)), made)


def _iri(predicate: str, value: Column, when: Column | None = None) -> Column:
    made = F.struct(
        F.lit(predicate).alias("p"), value.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype")
    )
    return F.when(value.isNotNull() & (when if when is not None else F.lit(True)), made)


def node_triples(nodes: DataFrame) -> DataFrame:
    """s, p, o, o_kind, datatype of scored nodes (id, full_name, entity_type, …); absent columns give no triples."""
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    person, company = F.col("entity_type") == "person", F.col("entity_type") == "company"
    true = lambda c: F.coalesce(has(c).cast("boolean"), F.lit(False))
    kind = lambda name, test: _iri(RDF_TYPE, F.lit(UBO + name), test)
    listed = [
        kind("Entity", person | company),
        kind("Person", person),
        kind("PoliticallyExposedPerson", person & true("is_pep")),
        kind("NomineeDirector", person & true("is_nominee_director")),
        kind("Company", company),
        kind("OffshoreCompany", company & true("is_offshore")),
        kind("ShellCompany", company & true("is_shell")),
        _literal("hasName", F.coalesce(has("full_name"), F.lit("Unknown"))),
        _literal("hasGoldenId", F.col("id")),
        _literal("dateOfBirth", has("dob"), "date", person),
        _literal("hasNationality", has("nationality"), when=person),
        _literal("isPEP", true("is_pep"), "boolean", person),
        _literal("pepLevel", has("pep_level"), when=person),
        _literal("directorCount", has("director_count"), "integer", person),
        _literal("isNominee", true("is_nominee_director"), "boolean", person),
        _literal("companyNumber", has("company_number"), when=company),
        _literal("dateIncorporated", has("date_incorporated"), "date", company),
        _literal("employeeCount", has("employee_count"), "integer", company),
        _literal("isOffshore", true("is_offshore"), "boolean", company),
        _literal("hasAddress", has("address")),
        _literal("hasCountry", has("country")),
        _literal("hasCity", has("city")),
        _literal("riskScore", has("risk_score"), "decimal"),
        _literal("riskLevel", has("risk_level")),
        _literal("hasCircularOwnership", true("has_circular_ownership"), "boolean", true("has_circular_ownership")),
        _literal("sourceCount", has("source_count"), "integer"),
        _literal(PROV + "generatedAtTime", has("created_at"), "dateTime"),
        _iri(PROV + "wasAttributedTo", F.lit(PIPELINE)),
        _literal(PROV + "invalidatedAtTime", has("updated_at"), "dateTime"),
    ]
    subject = F.concat(F.lit(ENTITY), F.col("id"))
    rows = nodes.select(subject.alias("s"), F.explode(F.array_compact(F.array(*listed))).alias("t")).select("s", "t.*")
    if "risk_factors" in nodes.columns:
        each = nodes.select(subject.alias("s"), F.explode("risk_factors").alias("f"))
        text = _literal("riskFactor", F.concat_ws(": ", "f.type", "f.detail"))
        rows = rows.unionByName(each.select("s", text.alias("t")).select("s", "t.*"))
    if "source_record_ids" in nodes.columns:
        each = nodes.select(subject.alias("s"), F.explode("source_record_ids").alias("r"))
        record = F.concat(F.lit(ENTITY + "RECORD_"), F.col("r"))
        derived = _iri(PROV + "wasDerivedFrom", record)
        rows = rows.unionByName(each.select("s", derived.alias("t")).select("s", "t.*"))
        about = [
            _iri(RDF_TYPE, F.lit(PROV + "Entity")),
            _literal(PROV + "atLocation", F.concat(F.lit("urn:source:record:"), F.col("r"))),
            _literal(PROV + "label", F.concat(F.lit("Original record "), F.col("r"))),
        ]
        told = each.select("r").distinct().select(record.alias("s"), F.explode(F.array(*about)).alias("t"))
        rows = rows.unionByName(told.select("s", "t.*"))
    return rows


def edge_triples(edges: DataFrame) -> DataFrame:
    """Direct relations and reified stakes and appointments; a blank node is named by a hash of its edge."""
    has = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string")
    owns, directs = F.col("rel") == "owns", F.col("rel") == "directorOf"
    src, dst = (F.concat(F.lit(ENTITY), F.col(c)) for c in ("src", "dst"))
    stake = owns & has("ownership_percentage").isNotNull()
    held = stake | directs
    blank = F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat_ws("|", "src", "dst", "rel"), 256), 1, 24))
    of = lambda subject, t: F.when(t.isNotNull(), F.struct(subject.alias("s"), t.alias("t")))
    made = [
        of(src, _iri(UBO + "owns", dst, owns)),
        of(src, _iri(UBO + "directorOf", dst, directs)),
        of(src, _iri(UBO + "hasStake", blank, stake)),
        of(src, _iri(UBO + "hasAppointment", blank, directs)),
        of(blank, _iri(RDF_TYPE, F.when(owns, UBO + "OwnershipStake").otherwise(UBO + "Appointment"), held)),
        of(blank, _iri(UBO + "inCompany", dst, stake)),
        of(blank, _literal("percentage", has("ownership_percentage"), "decimal", stake)),
        of(blank, _literal("ownershipType", has("ownership_type"), when=stake)),
        of(blank, _iri(UBO + "atCompany", dst, directs)),
        of(blank, _literal("role", has("role"), when=directs)),
        of(blank, _literal("isActive", F.lit(True), "boolean", directs)),
        of(blank, _iri(PROV + "wasDerivedFrom", src, held)),
    ]
    rows = edges.select(F.explode(F.array_compact(F.array(*made))).alias("x"))
    return rows.select("x.s", "x.t.*")


def statement_triples(edges: DataFrame, date: str) -> DataFrame:
    """One statement of beneficial owners for each owned company: its type, company, date and stakes."""
    stakes = edges.filter((F.col("rel") == "owns") & F.col("ownership_percentage").isNotNull())
    company = F.concat(F.lit(ENTITY), F.col("dst"))
    subject = F.concat(F.lit(ENTITY + "statement/"), F.col("dst"))
    about = [_iri(RDF_TYPE, F.lit(UBO + "UBOStatement")), _iri(UBO + "forCompany", company), _literal("reportDate", F.lit(date), "date")]
    once = stakes.select("dst").distinct().select(subject.alias("s"), F.explode(F.array(*about)).alias("t"))
    blank = F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat_ws("|", "src", "dst", "rel"), 256), 1, 24))
    each = stakes.select(subject.alias("s"), _iri(UBO + "hasStake", blank).alias("t"))
    return once.unionByName(each).select("s", "t.*")


def n_triples(triples: DataFrame) -> DataFrame:
    """One line each, for ``write.text``."""
    resource = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    escaped = F.col("o")
    for raw, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(by))
    literal = F.concat(F.lit('"'), escaped, F.lit('"^^<'), F.col("datatype"), F.lit(">"))
    shown = F.when(F.col("o_kind") == "literal", literal).otherwise(resource(F.col("o")))
    return triples.select(F.concat_ws(" ", resource(F.col("s")), resource(F.col("p")), shown, F.lit(".")).alias("value"))


def golden_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with owns, owned_by, director_of and has_director as lists of structs."""
    out = nodes
    for name, rel, mine, other in (
        ("owns", "owns", "src", "dst"),
        ("owned_by", "owns", "dst", "src"),
        ("director_of", "directorOf", "src", "dst"),
        ("has_director", "directorOf", "dst", "src"),
    ):
        entry = F.struct(F.col(other).alias("id"), F.col("ownership_percentage").alias("percentage"))
        lists = edges.filter(F.col("rel") == rel).groupBy(F.col(mine).alias("id")).agg(F.sort_array(F.collect_list(entry)).alias(name))
        out = out.join(lists, "id", "left")
    empty = "array<struct<id:string,percentage:double>>"
    lists = ("owns", "owned_by", "director_of", "has_director")
    return out.withColumns({n: F.coalesce(n, F.array().cast(empty)) for n in lists})


def dead_letters(validated: DataFrame) -> DataFrame:
    """record (JSON), error, batch_id of rows with errors."""
    fields = [c for c in validated.columns if not c.startswith("_")]
    return validated.filter(F.size("_errors") > 0).select(
        F.to_json(F.struct(*fields)).alias("record"), F.col("_errors").alias("error"), "batch_id"
    )


def export_wide(records: DataFrame, path: str, fields: list[str] | None = None) -> int:
    """Write the contract's fields as CSV, empty where missing or NULL; nothing if there are no rows. Rows written."""
    if records.isEmpty():
        return 0
    names = fields if fields is not None else list(TYPES)
    shown = [F.coalesce(F.col(n).cast("string"), F.lit("")) if n in records.columns else F.lit("") for n in names]
    wide = records.select(*[c.alias(n) for c, n in zip(shown, names)])
    wide.write.mode("overwrite").csv(path, header=True, emptyValue="", quoteAll=False, escape='"')
    return wide.count()


def write_dead_letters(validated: DataFrame, path: str) -> None:
    dead_letters(validated).write.mode("overwrite").json(path)


def save_state(path: str, version: int, **tables: DataFrame) -> None:
    """Each table under its name and version."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/v={version}")


def load_state(spark: SparkSession, path: str, version: int, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}/v={version}") for name in names}
