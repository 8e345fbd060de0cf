import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity, text


@pytest.mark.parametrize(
    "name,wanted",
    [
        ("Dr. J. Smith Jr.", "j. smith"), ("Smith, John", "john smith"), ("  MARY   Ann ", "mary ann"), ("Mr Bean", "bean"),
        ("lady Gaga II", "gaga"), ("Sirius Black", "sirius black"), (None, ""), ("one", "one"), ("Prof. Dr. Who", "who"), ("Lord Prof. X", "prof. x"),
    ],
)
def test_normalised_names(spark, name, wanted):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.normalise_name(F.col("n"))).first()[0] == wanted


def test_block_keys(spark):
    rows = [
        ("person", "John Smith", "1980-01-02", None, None, "UK", None, "P:S:1980-01-02"),
        ("person", "John Smith", None, None, None, "UK", None, "P:J:SMITH:UK"),
        ("person", "John Smith", None, None, "British", None, None, "P:J:SMITH:BRITISH"),
        ("person", None, None, None, None, "UK", None, "P:UK"),
        ("person", None, None, None, None, None, None, "P:UNKNOWN"),
        ("person", "John Smith", None, None, None, None, None, "P:SOUNDEX:J525"),
        ("company", "Acme Trading", None, None, None, "UK", "12345678", "CO:NUM:123"),
        ("company", "Acme Trading", None, None, None, "UK", "123456", "CO:NUM:12"),
        ("company", "Acme Trading", None, "12 St. Anne-Road, Leeds", None, "UK", None, "CO:12:UK"),
        ("company", "Acme Trading", None, None, None, "UK", "nan", "CO:UK:TRADE"),
        ("company", "Acme Widgets", None, None, None, "UK", None, "CO:UK:WID"),
    ]
    columns = "entity_type string, full_name string, dob string, address string, nationality string, country string, company_number string, wanted string"
    found = text.with_blocking_key(spark.createDataFrame(rows, columns))
    assert [(r.block_key, r.wanted) for r in found.collect() if r.block_key != r.wanted] == []


def test_dates(spark):
    pairs = [("2020-01-02", "02/01/2020", 1.0), ("2020-01-02", "2020-01-30", 0.7), ("2020-01-02", "2020-09-02", 0.3),
             ("2020-01-02", "2021-01-02", 0.0), ("2020-01-02", "some day", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, wanted double")
    score = text.compare_dates(text.loose_date(F.col("a")), text.loose_date(F.col("b")), F.lit(0.5))
    assert all(r[0] == r[1] for r in df.select(score, "wanted").collect())


def test_indel_in_columns(spark):
    words = ["", "a", "abc", "kitten", "sitting", "12 May 1980", "May 80", "1980-13-45", "80/1/1"]
    pairs = [(a, b, similarity.indel(a, b) / 100) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string, wanted double")
    assert [tuple(r) for r in df.select("a", "b", text.indel(F.col("a"), F.col("b")).alias("x"), "wanted").collect() if r.x != r.wanted] == []


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_by_brute_force():
    words = ["", "a", "abc", "kitten", "sitting", "x" * 80, "ab" * 50, "john smith", "smith john"]
    for a in words:
        for b in words:
            assert similarity.common_length(a, b) == brute_common(a, b)


def test_similarities():
    assert similarity.indel("kitten", "sitting") == 62
    assert similarity.token_sort("John Smith", "smith, john") == 100
    assert similarity.token_set("john smith", "john smith esquire") == 100
    assert similarity.partial("smith", "john smith") == 100
    assert similarity.abbreviation("j. smith", "john smith") == 1.0
    assert similarity.abbreviation("a b c", "a") == 0.0


@pytest.mark.parametrize(
    "word,code",
    [
        ("Jackson", "JKSN"), ("Smith", "SM0"), ("Knight", "NT"), ("Philip", "FLP"), ("Schmidt", "SKMTT"), ("Which", "WX"), ("Wright", "RT"),
        ("Church", "XRX"), ("Dodge", "TJ"), ("Thumb", "0M"), ("Xavier", "SFR"), ("Aeon", "EN"), ("Science", "SNS"), ("Nation", "NXN"),
        ("Sign", "SN"), ("Match", "MX"), ("Bigger", "BKR"), ("Queen Mary", "KN MR"), ("Yes", "YS"), ("Fox", "FKS"), ("Social", "SXL"),
    ],
)
def test_metaphone_by_its_rules(word, code):
    assert similarity.metaphone(word) == code


def test_addresses(spark):
    pairs = [("1 High St, Leeds", "9 Low Rd, Leeds", 0.4), ("1 High St, Leeds", "1 high st, leeds", 1.0), ("1 High St", "9 Low Rd", None), ("a", None, 0.0), ("", "a", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, wanted double")
    for r in df.select("a", "b", "wanted", similarity.compare_addresses(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (r.wanted if r.wanted is not None else similarity.token_set(r.a.lower(), r.b.lower()) / 200)


def test_registered_functions(spark):
    similarity.register(spark)
    assert spark.sql("SELECT indel_ratio('kitten', 'sitting'), token_sort_ratio(NULL, 'a')").first() == (0.62, None)
