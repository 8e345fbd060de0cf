"""Normalisation, matching, survivorship and incremental queries over records derived from the benchmark's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import contract, enrich, evaluate, golden, incremental
from tessera.operators.components import Scratch, connected_components
from tessera.operators.matching import Matcher
from tessera.plans.domain import Domain
from tessera.plans.registry import query
from tessera.sources import sinks
from tessera.streaming import upsert

# --- raw records: customers in another spelling ------------------------------------------------------------------------

RAW_SQL = """WITH raw AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN 'REC_' || c_custkey END AS record_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'robot' WHEN c_custkey % 3 = 0 THEN 'company' ELSE 'person' END AS entity_type,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'x' ELSE c_name END AS "fullName",
  CASE WHEN c_custkey % 7 = 0 THEN 'None' ELSE n_name END AS jurisdiction,
  CASE c_custkey % 4 WHEN 0 THEN '5.0' WHEN 1 THEN '-1' WHEN 2 THEN 'many' ELSE '12' END AS employee_count,
  (c_custkey % 140)::VARCHAR AS ownership_percentage, CASE WHEN c_custkey % 9 = 0 THEN 'BVI1' ELSE lpad(c_custkey::VARCHAR, 8, '0')
  END AS registration_number, CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' END AS "isPEP",
  CASE WHEN c_custkey % 2 = 0 THEN 'C1; C2;;C' || c_custkey END AS director_of_entity_ids
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
typed AS (SELECT k, coalesce(record_id, 'B1_CRM_REC_' || lpad(k::VARCHAR, 6, '0')) AS record_id, entity_type,
  "fullName" AS full_name, CASE WHEN jurisdiction <> 'None' THEN jurisdiction END AS country,
  trunc(TRY_CAST(employee_count AS DOUBLE))::INT AS employee_count, ownership_percentage::DOUBLE AS ownership_percentage,
  registration_number AS company_number, CASE WHEN "isPEP" IS NOT NULL THEN lower("isPEP") IN ('true', '1', 'yes', 'y') END AS is_pep,
  director_of_entity_ids, CASE WHEN employee_count = 'many' THEN 'employee_count' ELSE '' END AS converted FROM raw),
checked AS (SELECT *, list_filter([CASE WHEN full_name IS NULL THEN 'full_name: required' END,
  CASE WHEN entity_type NOT IN ('person', 'company') THEN 'entity_type: must_be_one_of' END,
  CASE WHEN length(full_name) < 2 THEN 'full_name: min_length' END,
  CASE WHEN ownership_percentage NOT BETWEEN 0 AND 100 THEN 'ownership_percentage: range' END,
  CASE WHEN employee_count < 0 THEN 'employee_count: min_value' END,
  CASE WHEN NOT regexp_full_match(company_number, '[0-9]{8}') THEN 'company_number: pattern' END], lambda e: e IS NOT NULL) AS errors
  FROM typed)
"""


def raw(d: Domain) -> DataFrame:
    c, k = d.table("customer"), F.col("c_custkey")
    kind = F.when(k % 17 == 0, "robot").when(k % 3 == 0, "company").otherwise("person")
    staff = F.when(k % 4 == 0, "5.0").when(k % 4 == 1, "-1").when(k % 4 == 2, "many").otherwise("12")
    return c.join(d.countries, c["c_nationkey"] == F.col("n_nationkey")).select(
        k.alias("k"), F.when(k % 5 != 0, F.concat(F.lit("REC_"), k)).alias("record_id"), kind.alias("entity_type"),
        F.when(k % 19 == 0, None).when(k % 23 == 0, "x").otherwise(F.col("c_name")).alias("fullName"),
        F.when(k % 7 == 0, "None").otherwise(F.col("country")).alias("jurisdiction"), staff.alias("employee_count"),
        (k % 140).cast("string").alias("ownership_percentage"),
        F.when(k % 9 == 0, "BVI1").otherwise(F.lpad(k.cast("string"), 8, "0")).alias("registration_number"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0").alias("isPEP"),
        F.when(k % 2 == 0, F.concat(F.lit("C1; C2;;C"), k)).alias("director_of_entity_ids"),
    )


def normalised(d: Domain) -> DataFrame:
    return contract.Contract().normalise(raw(d), "crm_csv", "B1", ordinal=F.col("k"), ingested_at=F.lit("2024-01-01T00:00:00"))


@query("p1_normalise", RAW_SQL + """SELECT record_id, entity_type, full_name, country, employee_count, ownership_percentage, company_number,
  is_pep, converted, 'crm_csv' AS source_type, 'B1' AS batch_id, '2024-01-01T00:00:00' AS ingested_at FROM typed""", domain=False)
def p1(d):
    return normalised(d).select(
        "source_type", "batch_id", "ingested_at", "record_id", "entity_type", "full_name", "country", "employee_count", "ownership_percentage", "company_number", "is_pep",
        F.array_join("_converted", ",").alias("converted"),
    )


@query("p7_explode_boards", RAW_SQL + """, parts AS (SELECT record_id, unnest(list_filter(list_transform(string_split(director_of_entity_ids, ';'),
  lambda x: trim(x)), lambda x: x <> '')) AS board, generate_subscripts(list_filter(list_transform(string_split(director_of_entity_ids, ';'),
  lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS pos FROM typed WHERE director_of_entity_ids IS NOT NULL)
  SELECT record_id || CASE WHEN pos > 0 THEN '_' || lpad(pos::VARCHAR, 2, '0') ELSE '' END AS record_id, board AS director_of_entity_ids FROM parts
  UNION ALL SELECT record_id, NULL FROM typed WHERE director_of_entity_ids IS NULL""", domain=False)
def p7(d):
    return contract.explode_boards(normalised(d)).select("record_id", "director_of_entity_ids")


@query("v0_validation", RAW_SQL + "SELECT record_id, len(errors)::INT AS n_errors, array_to_string(errors, ',') AS errors FROM checked",
       domain=False)
def v0(d):
    return normalised(d).select("record_id", F.size("_errors").alias("n_errors"), F.array_join("_errors", ",").alias("errors"))


@query("k2_normalisation_stats", RAW_SQL + """SELECT count(*) AS total_parsed, count(*) FILTER (len(errors) = 0) AS normalized,
  count(*) FILTER (len(errors) > 0) AS failed, round(count(*) FILTER (len(errors) = 0) / count(*), 4) AS success_rate FROM checked""",
       domain=False)
def k2(d):
    return contract.statistics(normalised(d))


@query("k3_dead_letters", RAW_SQL + """SELECT array_to_string(errors, ',') AS errors, count(*) AS n FROM checked WHERE len(errors) > 0 GROUP BY 1""",
       domain=False)
def k3(d):
    return sinks.dead_letters(normalised(d)).groupBy(F.array_join("error", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("e1_enrichment", RAW_SQL + """SELECT record_id, CASE WHEN entity_type = 'person' AND country IS NOT NULL THEN country || 'an' END AS nationality,
  CASE WHEN entity_type = 'person' AND full_name IS NOT NULL THEN 'ENT_' || substr(upper(replace(full_name, ' ', '_')), 1, 20) || '_UNKNOWN'
  WHEN entity_type = 'company' THEN 'ENT_CO_' || company_number END AS entity_id, coalesce(is_pep, CASE WHEN entity_type = 'person' THEN false END)
  AS is_pep, CASE WHEN entity_type = 'company' AND country IS NOT NULL THEN false END AS is_offshore FROM typed""", domain=False)
def e1(d):
    return enrich.enrich(normalised(d)).select("record_id", "nationality", "entity_id", "is_pep", "is_offshore")


@query("e8_enrichment_stats", RAW_SQL + """, counted AS (SELECT (entity_type = 'person' AND country IS NOT NULL)::INT + (CASE entity_type WHEN 'person' THEN full_name IS NOT NULL
  WHEN 'company' THEN company_number IS NOT NULL ELSE false END)::INT + (entity_type = 'person' AND is_pep IS NULL)::INT + (entity_type = 'company' AND country IS NOT NULL)::INT
  + coalesce(country IN ('UK', 'USA', 'US'), false)::INT AS n FROM typed) SELECT count(*) AS records, count(*) FILTER (n > 0) AS records_enriched, sum(n)::BIGINT AS fields_enriched
  FROM counted""", domain=False)
def e8(d):
    return enrich.statistics(enrich.enrich(normalised(d)))


# --- text and blocking ------------------------------------------------------------------------------------------------

PEOPLE_SQL = """WITH people AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Dr. Ann Lee' || c_custkey % 97 WHEN 1 THEN 'LEE' || c_custkey % 97
  || ', Ann' WHEN 2 THEN 'ann  lee' || c_custkey % 97 || ' Jr.' ELSE 'Bob Stone' || c_custkey % 89 END AS full_name,
  CASE WHEN c_custkey % 3 <> 0 THEN '19' || lpad((50 + c_custkey % 40)::VARCHAR, 2, '0') || '-0' || (1 + c_custkey % 9) || '-11' END AS dob,
  n_name AS country, CASE WHEN c_custkey % 6 = 0 THEN 'company' ELSE 'person' END AS entity_type,
  CASE WHEN c_custkey % 12 = 0 THEN lpad((c_custkey * 7 % 1000)::VARCHAR, 8, '1') END AS company_number,
  CASE WHEN c_custkey % 5 <> 0 THEN 'St. ' || c_custkey % 50 || ' High Street, Town' || c_custkey % 10 END AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
norm AS (SELECT *, CASE k % 4 WHEN 3 THEN 'bob stone' || k % 89 ELSE 'ann lee' || k % 97 END AS name FROM people),
keyed AS (SELECT *, upper(split_part(name, ' ', 2)) AS last, upper(country) AS ctry FROM norm),
blocks AS (SELECT *, CASE WHEN entity_type = 'person' THEN CASE WHEN dob IS NOT NULL THEN 'P:' || last[1] || ':' || dob
    ELSE 'P:' || upper(name[1]) || ':' || last || ':' || ctry END
  WHEN company_number IS NOT NULL THEN 'CO:NUM:' || company_number[:3]
  WHEN address IS NOT NULL THEN 'CO:SAINT:' || ctry ELSE 'CO:' || ctry || ':' || last[:3] END AS block_key FROM keyed)
"""


def people(d: Domain) -> DataFrame:
    c, k = d.table("customer"), F.col("c_custkey")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    name = (
        F.when(k % 4 == 0, s("Dr. Ann Lee", k % 97)).when(k % 4 == 1, s("LEE", k % 97, ", Ann"))
        .when(k % 4 == 2, s("ann  lee", k % 97, " Jr.")).otherwise(s("Bob Stone", k % 89))
    )
    return c.join(d.countries, c["c_nationkey"] == F.col("n_nationkey")).select(
        k.alias("k"), s("R", F.lpad(k.cast("string"), 9, "0")).alias("record_id"), name.alias("full_name"),
        F.when(k % 3 != 0, s("19", F.lpad((50 + k % 40).cast("string"), 2, "0"), "-0", 1 + k % 9, "-11")).alias("dob"), "country",
        F.when(k % 6 == 0, "company").otherwise("person").alias("entity_type"), F.lit(None).cast("string").alias("nationality"),
        F.when(k % 12 == 0, F.lpad((k * 7 % 1000).cast("string"), 8, "1")).alias("company_number"),
        F.when(k % 5 != 0, s("St. ", k % 50, " High Street, Town", k % 10)).alias("address"),
        F.when(k % 2 == 0, "csv_internal").otherwise("json_land_registry").alias("source_type"),
        s("2024-01-0", 1 + k % 9).alias("ingested_at"),
    )


@query("t2_normalised_names", PEOPLE_SQL + "SELECT k, name FROM norm", domain=False)
def t2(d):
    return people(d).select("k", text.normalise_name(F.col("full_name")).alias("name"))


@query("j2_blocking_keys", PEOPLE_SQL + "SELECT k, block_key FROM blocks", domain=False)
def j2(d):
    return Matcher().with_block(people(d)).select("k", "block_key")


@query("j2b_block_sizes", PEOPLE_SQL + "SELECT block_key, count(*) AS n FROM blocks GROUP BY 1", domain=False)
def j2b(d):
    return Matcher().with_block(people(d)).groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))


@query("j1_block_pairs", PEOPLE_SQL + """SELECT a.k AS a, b.k AS b FROM blocks a JOIN blocks b ON a.block_key = b.block_key
  AND a.entity_type = b.entity_type AND a.k < b.k""", domain=False)
def j1(d):
    return Matcher().pairs(people(d)).select(F.col("l_k").alias("a"), F.col("r_k").alias("b"))


@query("m1_exact_components", PEOPLE_SQL + """SELECT a.k AS a, b.k AS b, CASE WHEN a.entity_type = 'company' AND a.company_number = b.company_number
  THEN 0.15 ELSE 0.0 END::DOUBLE AS c_company_number, CASE WHEN a.country = b.country THEN 0.05 ELSE 0.0 END::DOUBLE AS c_country,
  CASE WHEN a.dob IS NULL OR b.dob IS NULL THEN 0.0 WHEN a.dob = b.dob THEN 0.25 WHEN a.dob[:7] = b.dob[:7] THEN 0.7::DOUBLE * 0.25::DOUBLE
  WHEN a.dob[:4] = b.dob[:4] THEN 0.3::DOUBLE * 0.25::DOUBLE ELSE 0.0 END::DOUBLE AS c_dob FROM blocks a JOIN blocks b ON a.block_key = b.block_key
  AND a.entity_type = b.entity_type AND a.k < b.k""", domain=False)
def m1(d):
    m = Matcher()
    return m.exact_parts(m.pairs(people(d))).select(F.col("l_k").alias("a"), F.col("r_k").alias("b"), "c_company_number", "c_country", "c_dob")


@query("t13_places", PEOPLE_SQL + """SELECT k, CASE WHEN address IS NOT NULL THEN 'ST.' END AS place, upper(country) AS jurisdiction,
  CASE WHEN address IS NOT NULL THEN 'SAINT' END AS normal FROM people""", domain=False)
def t13(d):
    p = people(d)
    city = text.place(F.col("address"))
    land = text.jurisdiction(F.col("country"), F.col("nationality"), F.col("address"))
    return p.select("k", city.alias("place"), land.alias("jurisdiction"), text.normalise_place(city).alias("normal"))


@query("t15_number_prefixes", PEOPLE_SQL + "SELECT k, company_number[:3] AS prefix FROM people WHERE company_number IS NOT NULL", domain=False)
def t15(d):
    return people(d).filter("company_number IS NOT NULL").select("k", text.number_prefix(F.col("company_number")).alias("prefix"))


@query("t16_industry_hints", """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'tech|software|digital') THEN 'TECH'
  WHEN regexp_matches(lower(p_name), 'bank|financ') THEN 'BANK' WHEN regexp_matches(lower(p_name), 'trad|import|export') THEN 'TRADE'
  WHEN regexp_matches(lower(p_name), 'propert|real estate|holdings') THEN 'PROP' END AS hint FROM (SELECT p_partkey,
  p_name || CASE p_partkey % 5 WHEN 0 THEN ' Software' WHEN 1 THEN ' Banking' WHEN 2 THEN ' Export' WHEN 3 THEN ' Holdings' ELSE '' END AS p_name FROM part)""",
       domain=False)
def t16(d):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, " Software").when(k % 5 == 1, " Banking").when(k % 5 == 2, " Export").when(k % 5 == 3, " Holdings").otherwise("")
    return d.table("part").select("p_partkey", text.industry(F.concat("p_name", tail)).alias("hint"))


@query("j3_candidates", PEOPLE_SQL + """SELECT DISTINCT a.k AS fresh, b.k AS golden FROM blocks a JOIN blocks b ON a.entity_type = b.entity_type
  AND a.k % 5 = 3 AND b.k % 5 < 3 AND (a.block_key = b.block_key OR ((a.entity_type = 'person' OR a.company_number = b.company_number
  OR (a.k % 2 = b.k % 2 AND a.address IS NOT NULL AND b.address IS NOT NULL))
  AND NOT EXISTS (SELECT 1 FROM blocks c WHERE c.k % 5 < 3 AND c.block_key = a.block_key)))""", domain=False)
def j3(d):
    m, p = Matcher(), people(d)
    found = m.candidate_keys(p.filter("k % 5 = 3"), m.with_block(p.filter("k % 5 < 3")), "k", "k")
    return found.select(F.col("l_k").alias("fresh"), F.col("r_k").alias("golden"))


#: Indel ratios of asked(x, y): rows of the table of common lengths, one character of the first text after the other.
WALK_SQL = """walk AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS row FROM asked UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda k: list_max(list_transform(range(0, k), lambda j: CASE WHEN j = 0 THEN 0
    WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN row[j] + 1 ELSE row[j + 1] END))) FROM walk WHERE i < length(x)),
scores AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE round_even(200.0::DOUBLE * row[length(y) + 1] / (length(x) + length(y)), 0) / 100 END AS score
  FROM walk WHERE i = length(x)),
"""

SIMILAR_SQL = PEOPLE_SQL.replace("WITH people", "WITH RECURSIVE people") + """, names AS (SELECT DISTINCT full_name AS a, 'Ann Lee7' AS b FROM people),
cut AS (SELECT a, b, list_filter(string_split_regex(lower(a), '[^0-9a-z]+'), lambda t: t <> '') AS ta,
  list_filter(string_split_regex(lower(b), '[^0-9a-z]+'), lambda t: t <> '') AS tb FROM names),
sets AS (SELECT *, list_sort(list_distinct(list_intersect(ta, tb))) AS common, list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))) AS l,
  list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))) AS r FROM cut),
joined AS (SELECT a, b, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb, array_to_string(common, ' ') AS m,
  array_to_string(list_concat(common, l), ' ') AS ml, array_to_string(list_concat(common, r), ' ') AS mr,
  CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM sets),
windows AS (SELECT a, b, short, substr(long, greatest(0, s) + 1, s + length(short) - greatest(0, s)) AS part FROM joined,
  unnest(range(1 - length(short), length(long))) u(s)),
asked AS (SELECT a AS x, b AS y FROM names UNION SELECT sa, sb FROM joined UNION SELECT ml, mr FROM joined UNION SELECT m, ml FROM joined
  UNION SELECT m, mr FROM joined UNION SELECT short, part FROM windows),
""" + WALK_SQL + """partials AS (SELECT a, b, CASE WHEN any_value(contains(long_, short)) THEN 1.0 ELSE max(score) END AS partial FROM (SELECT w.*, CASE WHEN length(a) <= length(b) THEN b ELSE a END
  AS long_, score FROM windows w JOIN scores ON x = short AND y = part) GROUP BY a, b)
"""


@query("t3_similarities", SIMILAR_SQL + """SELECT p.k, i.score AS indel, s.score AS token_sort, greatest(t.score, CASE WHEN m <> '' THEN greatest(u.score, v.score) ELSE 0 END)
  AS token_set, partial FROM people p JOIN joined j ON j.a = p.full_name JOIN scores i ON i.x = j.a AND i.y = j.b JOIN scores s ON s.x = sa AND s.y = sb
  JOIN scores t ON t.x = ml AND t.y = mr JOIN scores u ON u.x = m AND u.y = ml JOIN scores v ON v.x = m AND v.y = mr JOIN partials q ON q.a = j.a""", domain=False)
def t3(d):
    p = people(d).select("k", "full_name", F.lit("Ann Lee7").alias("other"))
    a, b = F.col("full_name"), F.col("other")
    return p.select(
        "k", similarity.indel_ratio(a, b).alias("indel"), similarity.token_sort_ratio(a, b).alias("token_sort"),
        similarity.token_set_ratio(a, b).alias("token_set"), similarity.partial_ratio(a, b).alias("partial"),
    )


@query("t6_sounds", None)
def t6(d):
    return people(d).select("k", similarity.metaphone_code(F.col("full_name")).alias("metaphone"), F.soundex("full_name").alias("soundex"))


#: Pairs of one block with the parts of their scores; stems are the names' letters, which sound alike if they are equal.
MATCH_SQL = PEOPLE_SQL.replace("WITH people", "WITH RECURSIVE people") + """, pairs AS (SELECT a.k AS ak, b.k AS bk, a.entity_type = 'company' AS firm, a.k % 2 = b.k % 2 AS one_source,
  a.name AS an, b.name AS bn, lower(a.address) AS aa, lower(b.address) AS ba, a.company_number AS anum, b.company_number AS bnum, a.country = b.country AS one_country,
  a.dob AS ad, b.dob AS bd FROM blocks a JOIN blocks b ON a.block_key = b.block_key AND a.entity_type = b.entity_type AND a.k < b.k
  WHERE a.entity_type = 'person' OR a.k % 2 = b.k % 2 OR a.company_number = b.company_number),
names AS (SELECT DISTINCT an, bn, string_split(an, ' ') AS wa, string_split(bn, ' ') AS wb, CASE WHEN length(an) <= length(bn) THEN an ELSE bn END AS short,
  CASE WHEN length(an) <= length(bn) THEN bn ELSE an END AS long FROM pairs),
windows AS (SELECT an, bn, short, long, substr(long, greatest(0, s) + 1, s + length(short) - greatest(0, s)) AS part FROM names, unnest(range(1 - length(short), length(long))) u(s)),
places AS (SELECT DISTINCT aa, ba, list_sort(list_distinct(list_filter(string_split_regex(aa, '[^0-9a-z]+'), lambda t: t <> ''))) AS ta,
  list_sort(list_distinct(list_filter(string_split_regex(ba, '[^0-9a-z]+'), lambda t: t <> ''))) AS tb FROM pairs WHERE aa IS NOT NULL AND ba IS NOT NULL),
sets AS (SELECT aa, ba, array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS m, array_to_string(list_concat(list_filter(ta, lambda t: list_contains(tb, t)),
  list_filter(ta, lambda t: NOT list_contains(tb, t))), ' ') AS ml, array_to_string(list_concat(list_filter(ta, lambda t: list_contains(tb, t)),
  list_filter(tb, lambda t: NOT list_contains(ta, t))), ' ') AS mr, trim(string_split(aa, ',')[-1]) AS ea, trim(string_split(ba, ',')[-1]) AS eb FROM places),
asked AS (SELECT array_to_string(list_sort(wa), ' ') AS x, array_to_string(list_sort(wb), ' ') AS y FROM names UNION SELECT short, part FROM windows
  UNION SELECT wa[1], wb[1] FROM names UNION SELECT wa[2], wb[2] FROM names UNION SELECT ml, mr FROM sets UNION SELECT m, ml FROM sets UNION SELECT m, mr FROM sets
  UNION SELECT ea, eb FROM sets),
""" + WALK_SQL + """partials AS (SELECT an, bn, CASE WHEN any_value(contains(long, short)) THEN 1.0 ELSE max(score) END AS partial FROM windows JOIN scores ON x = short AND y = part GROUP BY an, bn),
named AS (SELECT n.an, n.bn, greatest(s.score, partial, ((CASE WHEN wa[1] = wb[1] THEN 1.0 WHEN f.score >= 0.85 THEN 0.9 ELSE 0.0 END) + (CASE WHEN wa[2] = wb[2] THEN 1.0
  WHEN g.score >= 0.85 THEN 0.9 ELSE 0.0 END)) / 2, CASE WHEN regexp_replace(n.an, '[0-9]', '', 'g') = regexp_replace(n.bn, '[0-9]', '', 'g') THEN 0.9 ELSE 0.0 END)::DOUBLE AS sim
  FROM names n JOIN scores s ON s.x = array_to_string(list_sort(wa), ' ') AND s.y = array_to_string(list_sort(wb), ' ') JOIN partials p ON p.an = n.an AND p.bn = n.bn
  JOIN scores f ON f.x = wa[1] AND f.y = wb[1] JOIN scores g ON g.x = wa[2] AND g.y = wb[2]),
placed AS (SELECT aa, ba, greatest(t.score, CASE WHEN m <> '' THEN greatest(u.score, v.score) ELSE 0 END) AS whole, e.score AS tail FROM sets
  JOIN scores t ON t.x = ml AND t.y = mr JOIN scores u ON u.x = m AND u.y = ml JOIN scores v ON v.x = m AND v.y = mr JOIN scores e ON e.x = ea AND e.y = eb),
parts AS (SELECT p.*, sim * 0.35::DOUBLE AS c_name, CASE WHEN ad IS NULL OR bd IS NULL THEN 0.0 WHEN ad = bd THEN 0.25 WHEN ad[:7] = bd[:7] THEN 0.7::DOUBLE * 0.25::DOUBLE
  WHEN ad[:4] = bd[:4] THEN 0.3::DOUBLE * 0.25::DOUBLE ELSE 0.0 END::DOUBLE AS c_dob, CASE WHEN whole IS NULL THEN 0.0 WHEN whole > 0.8 THEN whole::DOUBLE * 0.15::DOUBLE
  WHEN tail > 0.8 THEN 0.4::DOUBLE * 0.15::DOUBLE ELSE whole::DOUBLE * 0.5::DOUBLE * 0.15::DOUBLE END::DOUBLE AS c_address,
  CASE WHEN firm AND anum = bnum THEN 0.15 ELSE 0.0 END::DOUBLE AS c_number, CASE WHEN one_country THEN 0.05 ELSE 0.0 END::DOUBLE AS c_country
  FROM pairs p JOIN named USING (an, bn) LEFT JOIN placed USING (aa, ba)),
judged AS (SELECT *, least(1.0::DOUBLE, c_name + c_dob + c_address + c_number + 0.0 + c_country) AS score, c_name / 0.35::DOUBLE AS name FROM parts),
ruled AS (SELECT *, CASE WHEN firm AND NOT one_source AND c_number = 0 THEN NULL WHEN firm AND anum IS NOT NULL AND bnum IS NOT NULL AND c_number = 0 THEN NULL
  WHEN firm AND c_number > 0 THEN 'HIGH:company_number' WHEN firm AND one_source AND name >= 0.92 AND c_address > 0 AND score >= 0.45 THEN 'HIGH:name_address'
  WHEN firm AND one_source AND name >= 0.85 AND c_address > 0 AND score >= 0.38 THEN 'MEDIUM:name_address' WHEN firm THEN NULL
  WHEN c_dob > 0 AND score >= 0.60 THEN 'HIGH:dob' WHEN name >= 0.95 AND c_address > 0 AND score >= 0.50 THEN 'HIGH:name_address'
  WHEN name >= 0.85 AND c_address > 0 AND score >= 0.40 THEN 'MEDIUM:name_address' WHEN c_dob > 0 AND name >= 0.85 AND score >= 0.45 THEN 'MEDIUM:dob_name'
  WHEN name >= 0.92 AND score >= 0.33 THEN 'MEDIUM:name' END AS verdict FROM judged)
"""


@query("m8_matches", MATCH_SQL + """SELECT 'R' || lpad(ak::VARCHAR, 9, '0') AS l_record_id, 'R' || lpad(bk::VARCHAR, 9, '0') AS r_record_id, round(score, 6) AS score,
  string_split(verdict, ':')[1] AS tier, string_split(verdict, ':')[2] AS rule FROM ruled WHERE verdict IS NOT NULL""", domain=False)
def m8(d):
    m = Matcher()
    found = m.scored(m.pairs(people(d))).filter("is_match")
    return found.select("l_record_id", "r_record_id", F.round("score", 6).alias("score"), "tier", "rule")


# --- clusters and golden records --------------------------------------------------------------------------------------

RECORDS_SQL = """WITH records AS (SELECT o_orderkey AS k, 'O' || lpad(o_orderkey::VARCHAR, 9, '0') AS record_id, o_custkey AS cluster_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'xml_companies_house' WHEN 1 THEN 'json_land_registry' WHEN 2 THEN 'csv_internal' ELSE 'other' END AS source_type,
  strftime(o_orderdate, '%Y-%m-%d') AS ingested_at, 'Name' || repeat('x', (o_orderkey % 5)::INT) AS full_name,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'A' || o_orderkey % 100 END AS address, o_orderpriority AS nationality, (o_orderkey % 3)::INT AS employee_count,
  CASE WHEN o_orderkey % 3 = 0 THEN 'company' ELSE 'person' END AS entity_type, 'C' || o_orderkey % 5 || '; C' || o_orderkey % 7 AS boards FROM orders),
types AS (SELECT cluster_id, entity_type, count(*) AS n, min(ingested_at || record_id) AS f FROM records GROUP BY ALL),
majority AS (SELECT cluster_id, first(entity_type ORDER BY n DESC, f) AS entity_type FROM types GROUP BY ALL)
"""


def records(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    source = F.when(k % 4 == 0, "xml_companies_house").when(k % 4 == 1, "json_land_registry").when(k % 4 == 2, "csv_internal").otherwise("other")
    return d.table("orders").select(
        s("O", F.lpad(k.cast("string"), 9, "0")).alias("record_id"), F.col("o_custkey").alias("cluster_id"), source.alias("source_type"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("ingested_at"), s("Name", F.expr("repeat('x', int(o_orderkey % 5))")).alias("full_name"),
        F.when(k % 7 != 0, s("A", k % 100)).alias("address"), F.col("o_orderpriority").alias("nationality"),
        (k % 3).cast("int").alias("employee_count"), F.when(k % 3 == 0, "company").otherwise("person").alias("entity_type"),
        s("C", k % 5, "; C", k % 7).alias("director_of_entity_ids"),
    )


@query("a2_golden_records", RECORDS_SQL + """SELECT cluster_id, m.entity_type, 'GOLDEN_' || min(record_id) AS golden_id,
  first(full_name ORDER BY -length(full_name), ingested_at, record_id) AS full_name,
  first(address ORDER BY ingested_at DESC, record_id) FILTER (address IS NOT NULL) AS address,
  first(nationality ORDER BY -CASE source_type WHEN 'xml_companies_house' THEN 100 WHEN 'json_land_registry' THEN 90 WHEN 'csv_internal' THEN 80
    ELSE 40 END, ingested_at, record_id) AS nationality,
  first(employee_count ORDER BY -CASE source_type WHEN 'xml_companies_house' THEN 100 WHEN 'json_land_registry' THEN 90 WHEN 'csv_internal' THEN 80
    ELSE 40 END, ingested_at, record_id) AS employee_count, count(*) AS source_count,
  array_to_string(list_sort(list_distinct(flatten(list(list_transform(string_split(boards, ';'), lambda x: trim(x)))))), ';') AS director_of_entity_ids
  FROM records JOIN majority m USING (cluster_id) GROUP BY ALL""", domain=False)
def a2(d):
    made = golden.build(records(d))
    return made.select(
        "cluster_id", "entity_type", "golden_id", "full_name", "address", "nationality", "employee_count", "source_count", "director_of_entity_ids"
    )


@query("a16_source_types", RECORDS_SQL + """SELECT cluster_id, array_to_string(list_sort(list_distinct(list(source_type))), ',') AS source_types
  FROM records GROUP BY 1""", domain=False)
def a16(d):
    return golden.build(records(d)).select("cluster_id", F.array_join("source_types", ",").alias("source_types"))


@query("j6_alias_edges", """WITH wanted AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'ENT_CO_' || s_suppkey WHEN 1 THEN s_suppkey::VARCHAR
  WHEN 2 THEN 'ENT_PERSON_ENT_CO_' || s_suppkey ELSE 'nobody' END AS owner FROM supplier)
  SELECT k, 'G' || k AS golden_id FROM wanted WHERE owner <> 'nobody'""", domain=False)
def j6(d):
    k = F.col("s_suppkey")
    s = d.table("supplier")
    owner = (
        F.when(k % 4 == 0, F.concat(F.lit("ENT_CO_"), k)).when(k % 4 == 1, k.cast("string"))
        .when(k % 4 == 2, F.concat(F.lit("ENT_PERSON_ENT_CO_"), k)).otherwise("nobody")
    )
    known = s.select(F.concat(F.lit("ENT_CO_"), k).alias("alias"), F.concat(F.lit("G"), k).alias("golden_id"))
    return golden.resolve_aliases(s.select(k.alias("k"), owner.alias("owner")), known, "owner").select("k", "golden_id")


@query("j7_unresolved_owners", """SELECT 'G' || s_suppkey AS golden_id, 'nobody' AS wanted FROM supplier WHERE s_suppkey % 4 = 3""", domain=False)
def j7(d):
    k = F.col("s_suppkey")
    s = d.table("supplier").select(
        F.concat(F.lit("G"), k).alias("golden_id"), F.when(k % 4 == 3, "nobody").otherwise(F.concat(F.lit("ENT_CO_"), k)).alias("owned_by_entity_id"),
        F.concat(F.lit("ENT_CO_"), k).alias("alias"),
    )
    return golden.unresolved(s.select("golden_id", "owned_by_entity_id"), s.select("alias", "golden_id"))


@query("a12_pairwise_f1", """WITH t AS (SELECT c_custkey AS r, c_custkey // 4 AS e, c_custkey // 6 AS c FROM customer),
  pairs AS (SELECT a.e = b.e AS same, a.c = b.c AS found FROM t a JOIN t b ON a.r < b.r AND (a.e = b.e OR a.c = b.c)),
  n AS (SELECT count(*) FILTER (same AND found) AS tp, count(*) FILTER (found AND NOT same) AS fp, count(*) FILTER (same AND NOT found) AS fn FROM pairs)
  SELECT tp, fp, fn, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, (2 * tp) / (2 * tp + fp + fn) AS f1 FROM n""", domain=False)
def a12(d):
    t = d.table("customer").select(
        F.col("c_custkey").alias("record_id"), F.expr("c_custkey div 4").alias("entity_id"), F.expr("c_custkey div 6").alias("cluster_id")
    )
    return evaluate.pairwise(t.select("record_id", "entity_id"), t.select("record_id", "cluster_id"))


@query("a14_purity", """WITH t AS (SELECT c_custkey // 4 AS e, c_custkey // 6 AS c FROM customer), v AS (SELECT c, e, count(*) AS n FROM t GROUP BY ALL)
  SELECT c AS cluster_id, sum(n)::BIGINT AS size, first(e ORDER BY n DESC, e) AS dominant, max(n) / sum(n)::BIGINT AS purity FROM v GROUP BY c""",
       domain=False)
def a14(d):
    t = d.table("customer").select(
        F.col("c_custkey").alias("record_id"), F.expr("c_custkey div 4").alias("entity_id"), F.expr("c_custkey div 6").alias("cluster_id")
    )
    return evaluate.purity(t.select("record_id", "entity_id"), t.select("record_id", "cluster_id"))


@query("a1b_record_clusters", """WITH RECURSIVE links AS (SELECT user_id AS a, event_type AS t, row_number() OVER (PARTITION BY event_type, (event_id // 50)
  ORDER BY event_id) AS n, event_id // 50 AS g FROM events), pairs AS (SELECT DISTINCT x.a, y.a AS b FROM links x JOIN links y ON x.t = y.t AND x.g = y.g
  AND y.n = x.n + 1 WHERE x.t = 'error'), both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON reach.b = w.a)
  SELECT a AS node, min(b) AS component FROM reach GROUP BY a""", domain=False)
def a1b(d):
    from pyspark.sql import Window

    e = d.table("events").filter("event_type = 'error'")
    order = Window.partitionBy(F.expr("event_id div 50")).orderBy("event_id")
    pairs = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(order).alias("dst"))
    return connected_components(pairs)


# --- batches and streams ----------------------------------------------------------------------------------------------


@query("i1_incremental_changes", None)
def i1(d):
    every = people(d).withColumn("entity_id", F.lit(None).cast("string"))
    first, second = every.filter("k % 5 < 4").drop("k"), every.filter("k % 5 >= 3").drop("k")  # a fifth is sent again
    before = incremental.resolve(first, graph=False)  # the audit is of golden records
    return incremental.changes(before, incremental.process(before, second, graph=False))


@query("i7_state_risk", None)
def i7(d):
    """Edges and risk of the state after a second batch: owners are named by record ids, boards too."""
    k = F.col("k")
    owner = F.when((k % 6 == 0) & (k > 1), F.concat(F.lit("R"), F.lpad((k / 2).cast("int").cast("string"), 9, "0")))
    board = F.when(k % 6 != 0, F.concat(F.lit("R"), F.lpad((k * 6 % 1200).cast("string"), 9, "0")))
    every = people(d).withColumns(
        {"entity_id": F.lit(None).cast("string"), "owned_by_entity_id": owner, "ownership_percentage": F.lit(60.0), "director_of_entity_ids": board,
         "is_pep": k % 13 == 0, "is_offshore": k % 12 == 0, "employee_count": (k % 7).cast("int")}
    )
    first, second = every.filter("k % 5 < 4").drop("k"), every.filter("k % 5 >= 3").drop("k")
    after = incremental.process(incremental.resolve(first, graph=False), second)
    return after.risk.select("golden_id", "entity_type", "source_count", "director_count", "owned_count", "risk_score", "risk_level")


@query("i8_stream_upsert", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)
  AS n FROM events) WHERE n = 1""", domain=False)
def i8(d):
    """Each user's last event, by a stream of files into a versioned table."""
    scratch = Scratch(d.spark, "stream")
    e = d.table("events").select("user_id", "event_id", "event_type", "value")
    e.repartition(2).write.parquet(f"{scratch.root}/in")
    done = upsert.follow(
        d.spark, f"{scratch.root}/in", e.schema, f"{scratch.root}/checkpoint-{uuid.uuid4().hex}", f"{scratch.root}/state", upsert.latest("user_id", "event_id")
    )
    done.awaitTermination()
    last = done.lastProgress["batchId"]
    return d.spark.read.parquet(f"{scratch.root}/state/v={last}")


@query("i9_windowed_events", """SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n,
  round(sum(value), 4) AS total FROM events GROUP BY 1, 2""", domain=False)
def i9(d):
    found = upsert.windowed_counts(d.table("events"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
