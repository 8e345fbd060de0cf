"""Raw files as tables of strings: CSV, JSON with or without an envelope, XML; schemas are read, never guessed by value."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Source(Protocol):
    """What a reader of another format looks like: a path in, a table of string columns out."""

    def __call__(self, spark: SparkSession, path: str) -> DataFrame: ...


ENVELOPES = ("data", "records", "results")
BOARDS = ("director_of", "directorships", "director_of_entity_ids", "directorOf")

_ADDRESS = "struct<Line1:string,Line2:string,City:string,Country:string>"
PERSON = (
    "FullName string, DateOfBirth string, Nationality string, IsPEP string, PEPLevel string, Position string, StartDate string, "
    f"EndDate string, Address {_ADDRESS}, DirectorOf struct<CompanyNumber:array<string>>"
)
COMPANY = (
    "CompanyNumber string, CompanyName string, IncorporationDate string, EmployeeCount string, IsOffshore string, "
    f"Address {_ADDRESS}, OwnedBy struct<EntityID:string,Percentage:string>"
)


def csv(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """All columns as strings. Without ``encoding`` a file is UTF-8, or ISO-8859-1 if it holds bytes that UTF-8 has not."""

    def load(files: str | list[str], code: str) -> DataFrame:
        return spark.read.csv(files, header=True, inferSchema=False, mode="PERMISSIVE", encoding=code, escape='"')

    if encoding:
        return load(path, encoding)
    found = load(path, "UTF-8")
    odd = F.lit(False)
    for name in found.columns:
        odd = odd | F.coalesce(F.col(f"`{name}`").contains("\ufffd"), F.lit(False))
    files = [r[0] for r in found.filter(odd).select(F.input_file_name()).distinct().collect()]  # names of files
    if not files:
        return found
    others = [f for f in found.inputFiles() if f not in files]
    latin = load(files, "ISO-8859-1")
    return load(others, "UTF-8").unionByName(latin, allowMissingColumns=True) if others else latin


def json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a list at the root or of the first envelope there is, flattened; anything else at the root is an error."""
    raw = spark.read.option("primitivesAsString", True).json(path, multiLine=True)
    if raw.columns == ["_corrupt_record"]:
        raise ValueError(f"{path}: neither a list nor an object")
    for name in ENVELOPES:
        if name in raw.columns and isinstance(raw.schema[name].dataType, T.ArrayType):
            raw = raw.select(F.explode(name).alias("record")).select("record.*")
            break
    return flatten(raw)


def flatten(raw: DataFrame) -> DataFrame:
    """Nested fields one level up; directorships as a ``;`` list, other lists joined by ``; ``; addresses as one text."""
    made: dict[str, Column] = {}
    for f in raw.schema:
        c = F.col(f"`{f.name}`")
        if f.name == "address" and isinstance(f.dataType, T.StructType):
            parts = [n for n in ("line1", "line2", "city", "country") if n in f.dataType.names]
            made["address"] = F.concat_ws(", ", *[F.nullif(F.trim(c[n]), F.lit("")) for n in parts])
            for n in ("city", "country"):
                if n in parts:
                    made.setdefault(n, c[n])
        elif f.name == "ownership" and isinstance(f.dataType, T.StructType):
            for n, to in (("entity_id", "owned_by_entity_id"), ("percentage", "ownership_percentage"), ("type", "ownership_type")):
                if n in f.dataType.names:
                    made[to] = c[n]
        elif f.name in BOARDS:
            made["director_of_entity_ids"] = _board(c, f.dataType)
        elif isinstance(f.dataType, T.StructType):
            for n in f.dataType.names:
                made.setdefault(f"{f.name}_{n}", c[n].cast("string"))
        elif isinstance(f.dataType, T.ArrayType):
            made[f.name] = F.array_join(c.cast("array<string>"), "; ")
        else:
            made[f.name] = c
    return raw.select(*[column.alias(name) for name, column in made.items()])


def _board(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ";")
    if isinstance(kind, T.StructType):
        listed = next((n for n in ("company_ids", "companies") if n in kind.names), None)
        return F.array_join(c[listed], ";") if listed else F.lit(None).cast("string")
    return c.cast("string")


def xml_persons(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Person and directorship."""
    raw = spark.read.format("xml").option("rowTag", "Person").schema(PERSON).load(path)
    return persons(raw)


def persons(raw: DataFrame) -> DataFrame:
    boards = F.transform(F.col("DirectorOf.CompanyNumber"), lambda n: F.concat(F.lit("ENT_CO_"), F.trim(n)))
    return raw.filter(_text("FullName").isNotNull()).select(
        F.lit("person").alias("entity_type"),
        _text("FullName").alias("full_name"),
        _text("DateOfBirth").alias("dob"),
        _text("Nationality").alias("nationality"),
        _text("IsPEP").alias("is_pep"),
        _text("PEPLevel").alias("pep_level"),
        _text("Position").alias("pep_position"),
        _text("StartDate").alias("pep_start"),
        _text("EndDate").alias("pep_end"),
        *_address(),
        F.explode_outer(boards).alias("director_of_entity_ids"),
    )


def xml_companies(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "Company").schema(COMPANY).load(path)
    return companies(raw)


def companies(raw: DataFrame) -> DataFrame:
    return raw.filter(_text("CompanyName").isNotNull()).select(
        F.lit("company").alias("entity_type"),
        _text("CompanyName").alias("full_name"),
        _text("CompanyNumber").alias("company_number"),
        F.concat(F.lit("ENT_CO_"), _text("CompanyNumber")).alias("entity_id"),
        _text("IncorporationDate").alias("date_incorporated"),
        _text("EmployeeCount").try_cast("int").cast("string").alias("employee_count"),
        _text("IsOffshore").alias("is_offshore"),
        *_address(),
        _text("OwnedBy.EntityID").alias("owned_by_entity_id"),
        _text("OwnedBy.Percentage").try_cast("double").cast("string").alias("ownership_percentage"),
    )


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.col(path)), F.lit(""))


def _address() -> list[Column]:
    parts = [_text(f"Address.{n}") for n in ("Line1", "Line2", "City", "Country")]
    whole = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return [whole.alias("address"), parts[2].alias("city"), parts[3].alias("country")]
