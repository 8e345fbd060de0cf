"""Names, places and dates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is stripped from names, in this order.
TITLES = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sir", "lord", "lady", "mr", "mrs", "ms", "dr")
SUFFIXES = ("jr.", "sr.", "ii", "iii", "iv", "esq.", "jr", "sr")

# Place abbreviations, in this order.
PLACES = (("ST.", "SAINT"), ("ST", "SAINT"), ("MT.", "MOUNT"), ("MT", "MOUNT"), ("FT.", "FORT"), ("FT", "FORT"))

# An industry and the words that hint at it, in this order.
INDUSTRIES = (
    ("TECH", ("technology", "tech", "software", "digital")),
    ("BANK", ("bank", "banking", "financial", "finance")),
    ("TRADE", ("trading", "trade", "import", "export")),
    ("PROP", ("property", "properties", "real estate", "holdings")),
)

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd")


def blank_to_null(value: Column) -> Column:
    """NULL for what counts as empty: nothing, blanks, nan, none and null in any case."""
    trimmed = F.trim(value.cast("string"))
    return F.when(~F.lower(trimmed).isin("", "nan", "none", "null"), value.cast("string"))


def normalise_name(name: Column) -> Column:
    """Lower case without titles and suffixes, ``last, first`` turned, single blanks."""
    value = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    # Each title is stripped once, in order, so one pattern of optional parts does it; suffixes go from the end.
    titles = "".join(rf"(?:{_quoted(t)}(?=[ .])[ .]*)?" for t in TITLES)
    suffixes = "".join(rf"(?:[, ]+{_quoted(s)})?" for s in reversed(SUFFIXES))
    value = F.regexp_replace(F.regexp_replace(value, f"^{titles}", ""), f"{suffixes}$", "")
    value = F.regexp_replace(value, r"^([^,]*),([^,]*)$", "$2 $1")
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def _quoted(text: str) -> str:
    return text.replace(".", r"\.")


def _words(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def first_initial(normalised: Column) -> Column:
    return F.upper(F.substring(F.replace(F.split(normalised, " ")[0], F.lit("."), F.lit("")), 1, 1))


def last_word(normalised: Column) -> Column:
    found = F.upper(F.element_at(F.split(normalised, " "), -1))
    return F.when(found != "", found)


def place(address: Column) -> Column:
    """The first word of an address; it defines blocks."""
    return F.upper(F.get(_words(F.coalesce(address, F.lit(""))), F.lit(0)))


def jurisdiction(country: Column, nationality: Column, address: Column) -> Column:
    tail = F.try_element_at(_words(F.coalesce(address, F.lit(""))), F.lit(-1))
    return F.upper(F.coalesce(blank_to_null(country), blank_to_null(nationality), tail))


def normalise_place(value: Column) -> Column:
    start = F.trim(F.upper(value))
    expanded = reduce(lambda v, p: F.regexp_replace(v, f"^{_quoted(p[0])}", p[1]), PLACES, start)
    joined = F.translate(expanded, " -", "__")
    return F.regexp_replace(joined, "[.,]", "")


def number_prefix(number: Column) -> Column:
    clean = F.trim(number)
    n = F.length(clean)
    return F.when(n >= 8, F.substring(clean, 1, 3)).when(n >= 6, F.substring(clean, 1, 2)).otherwise(F.substring(clean, 1, 1))


def industry(name: Column) -> Column:
    lowered = F.lower(name)
    found = F.lit(None).cast("string")
    for label, words in reversed(INDUSTRIES):
        found = F.when(lowered.rlike("|".join(words)), F.lit(label)).otherwise(found)
    return found


def with_blocking_key(records: DataFrame) -> DataFrame:
    """The records with name_key (normalised), birth_date (read from dob) and block_key: the first rung of a ladder whose values are there,
    the last is UNKNOWN. Steps are columns of their own, so each is computed once."""
    c = F.col
    made = records.withColumn("name_key", normalise_name(c("full_name")))
    made = made.withColumns(
        {
            "_first": F.nullif(first_initial(c("name_key")), F.lit("")),
            "_last": last_word(c("name_key")),
            "_born": blank_to_null(c("dob")),
            "_number": blank_to_null(c("company_number")),
            "_city": place(c("address")),
            "_ctry": jurisdiction(c("country"), c("nationality"), c("address")),
            "_sound": F.soundex("name_key"),
            "_industry": industry(c("full_name")),
        }
    )
    made = made.withColumns(
        {
            "_prefix": number_prefix(c("_number")),
            "_city": normalise_place(c("_city")),
            "_land": normalise_place(c("_ctry")),
            "_hint": F.coalesce("_industry", F.upper(F.substring("_last", 1, 3))),
            "_initials": F.upper(F.concat(F.substring("name_key", 1, 1), F.substring("_last", 1, 1))),
        }
    )
    person = [
        _keyed("P", F.substring("_last", 1, 1), c("_born")), _keyed("P", c("_first"), c("_last"), c("_ctry")),
        _keyed("P", c("_last"), c("_ctry")), _keyed("P", c("_ctry")),
    ]
    company = [
        _keyed("CO", "NUM", c("_prefix")), _keyed("CO", c("_city"), c("_land")), _keyed("CO", c("_ctry"), c("_hint")),
        _keyed("CO", c("_ctry")),
    ]
    last = lambda p: [
        F.when(c("_sound").rlike("^[A-Z][0-9]{3}$"), _keyed(p, "SOUNDEX", c("_sound"))),
        F.when(c("name_key") != "", _keyed(p, "NAME", c("_initials"))),
        F.lit(f"{p}:UNKNOWN"),
    ]
    is_company = F.lower(F.coalesce("entity_type", F.lit(""))) == "company"
    key = F.when(is_company, F.coalesce(*company, *last("CO"))).otherwise(F.coalesce(*person, *last("P")))
    return made.withColumn("block_key", key).withColumn("birth_date", loose_date(c("dob"))).select(
        *records.columns, "name_key", "birth_date", "block_key"
    )


def _keyed(*parts: str | Column) -> Column:
    """Parts joined by colons, NULL if one is NULL."""
    listed = [F.lit(p) if isinstance(p, str) else p for p in parts]
    joined = listed[0]
    for part in listed[1:]:
        joined = F.concat(joined, F.lit(":"), part)
    return joined


def loose_date(value: Column) -> Column:
    """The first of DATE_FORMATS that fits, or NULL."""
    head = F.trim(value.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DATE_FORMATS])


def indel(a: Column, b: Column) -> Column:
    """The share of characters in a longest common subsequence, twice over both lengths, in hundredths; for short texts.

    One row of the table of lengths follows from the one before: the greatest so far of what a column can reach.
    """
    left, right = F.split(a, ""), F.split(b, "")
    places = F.sequence(F.lit(1), F.length(b))
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(old: Column, char: Column) -> Column:
        def extended(new: Column, j: Column) -> Column:
            hit = F.get(right, j - 1) == char
            reach = F.when(hit, F.get(old, j - 1) + 1).otherwise(F.get(old, j))
            return F.concat(new, F.array(F.greatest(reach, F.element_at(new, -1))))

        return F.aggregate(places, F.array(F.lit(0)), extended)

    common = F.element_at(F.aggregate(left, start, row), -1)
    total = F.length(a) + F.length(b)
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, F.bround(F.lit(200) * common / total) / 100).when(total == 0, 1.0).when(total > 0, 0.0)


def compare_dates(a: Column, b: Column, text_score: Column) -> Column:
    """Of dates: 1 for one day, .7 for one month, .3 for one year; ``text_score`` where a date is NULL."""
    return (
        F.when(a.isNull() | b.isNull(), text_score)
        .when(a == b, 1.0)
        .when(F.trunc(a, "month") == F.trunc(b, "month"), 0.7)
        .when(F.year(a) == F.year(b), 0.3)
        .otherwise(0.0)
    )
