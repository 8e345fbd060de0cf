"""Graph, risk and compliance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, risk
from tessera.operators.components import Scratch, connected_components
from tessera.plans.domain import Domain
from tessera.plans.registry import query
from tessera.sources import sinks


def scored(d: Domain, nodes: DataFrame | None = None, cycles: bool = True) -> DataFrame:
    """Risk of the nodes. ``cycles``: False where only persons or flags that don't depend on cycles are asked for."""
    # Boards and owners end at companies, so only companies that own and are owned lie on cycles.
    cyclic = graph.on_cycles(d.owns) if cycles else d.nodes.select("id").limit(0)
    return risk.score(d.nodes if nodes is None else nodes, d.edges, cyclic=cyclic)


def _pairs(d: Domain, pairs: DataFrame) -> DataFrame:
    """src/dst pairs with s_ and t_ columns of both nodes."""
    return pairs.join(d.named("s"), F.col("src") == F.col("s_id")).join(d.named("t"), F.col("dst") == F.col("t_id"))


@query("q1_ubo", """SELECT c.src AS person_id, p.full_name AS person, c.dst AS company_id, t.full_name AS company,
  depth::INT AS path_length FROM closed c JOIN persons p ON p.id = c.src JOIN companies t ON t.id = c.dst""")
def q1(d):
    return _pairs(d, graph.closure(d.owns, seeds=d.persons.select("id"))).select(
        F.col("src").alias("person_id"), F.col("s_full_name").alias("person"), F.col("dst").alias("company_id"),
        F.col("t_full_name").alias("company"), F.col("depth").alias("path_length"),
    )


@query("q1b_ubo_of_targets", """SELECT c.dst AS company_id, c.src AS owner_id, entity_type AS owner_type, depth::INT AS path_length
  FROM closed c JOIN nodes n ON n.id = c.src WHERE c.dst IN ('C25', 'C53', 'C88')""")
def q1b(d):
    targets = d.companies.filter(F.col("id").isin("C25", "C53", "C88")).select("id")
    up = graph.closure(d.owns, seeds=targets, backwards=True)
    return up.join(d.nodes, F.col("src") == F.col("id")).select(
        F.col("dst").alias("company_id"), F.col("src").alias("owner_id"), F.col("entity_type").alias("owner_type"),
        F.col("depth").alias("path_length"),
    )


@query("q2_pep_offshore", """SELECT p.id AS person_id, p.pep_level, t.id AS company_id, t.country,
  CASE WHEN t.employee_count <= 2 THEN 'YES' WHEN t.employee_count > 2 THEN 'NO' END AS is_shell
  FROM closed c JOIN persons p ON p.id = c.src JOIN companies t ON t.id = c.dst WHERE p.is_pep AND t.is_offshore""")
def q2(d):
    met = _pairs(d, graph.closure(d.owns, seeds=d.persons.filter("is_pep").select("id"))).filter("t_is_offshore")
    shell = F.when(F.col("t_employee_count") <= 2, "YES").when(F.col("t_employee_count") > 2, "NO")
    return met.select(
        F.col("src").alias("person_id"), F.col("s_pep_level").alias("pep_level"), F.col("dst").alias("company_id"),
        F.col("t_country").alias("country"), shell.alias("is_shell"),
    )


@query("q2b_pep_exposure_exists", """SELECT id, EXISTS (SELECT 1 FROM closed c JOIN companies t ON t.id = c.dst
  WHERE c.src = persons.id AND t.is_offshore) AS has_offshore FROM persons WHERE is_pep""")
def q2b(d):
    closed = graph.closure(d.owns, seeds=d.persons.filter("is_pep").select("id"))
    off = closed.join(d.companies.filter("is_offshore"), F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("x")).distinct()
    return d.persons.filter("is_pep").join(off, F.col("id") == F.col("x"), "left").select("id", F.col("x").isNotNull().alias("has_offshore"))


@query("q3_circular", "SELECT id, full_name, depth::INT AS cycle_length FROM closed JOIN companies ON id = src WHERE src = dst")
def q3(d):
    loops = d.closed.filter("src = dst")
    return loops.join(d.companies, F.col("src") == F.col("id")).select("id", "full_name", F.col("depth").alias("cycle_length"))


@query("q3b_cycle_entities", "SELECT n.id, n.entity_type FROM cyclic c JOIN nodes n ON n.id = c.id")
def q3b(d):
    return d.nodes.join(graph.on_cycles(d.owns), "id", "left_semi").select("id", "entity_type")


@query("q4_high_risk_dashboard", """SELECT id, entity_type, full_name, country, risk_score, risk_level_ AS risk_level,
  array_to_string(list_sort(factors), '; ') AS factors, owned_count FROM (SELECT *, CASE WHEN risk_score >= 20 THEN 'HIGH'
  WHEN risk_score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level_ FROM risk) WHERE risk_level_ = 'HIGH'
  ORDER BY risk_score DESC, id LIMIT 20""")
def q4(d):
    listed = F.array_join(F.array_sort(F.transform("risk_factors", lambda f: f["type"])), "; ").alias("factors")
    top = scored(d).filter("risk_level = 'HIGH'").orderBy(F.desc("risk_score"), "id").limit(20)
    return top.select("id", "entity_type", "full_name", "country", "risk_score", "risk_level", listed, "owned_count")


@query("q5_cross_border", """SELECT a.src AS first_id, a.dst AS second_id, b.dst AS third_id, x.country AS c1, y.country AS c2,
  z.country AS c3 FROM owns a JOIN owns b ON a.dst = b.src JOIN nodes x ON x.id = a.src JOIN nodes y ON y.id = a.dst
  JOIN nodes z ON z.id = b.dst WHERE x.country <> y.country AND y.country <> z.country AND x.country <> z.country""")
def q5(d):
    walk = graph.chains(d.owns, 2)
    for n in range(3):
        walk = walk.join(d.nodes.select(F.col("id").alias(f"n{n}"), F.col("country").alias(f"c{n + 1}")), f"n{n}")
    return walk.filter("c1 <> c2 AND c2 <> c3 AND c1 <> c3").select(
        F.col("n0").alias("first_id"), F.col("n1").alias("second_id"), F.col("n2").alias("third_id"), "c1", "c2", "c3"
    )


@query("q6_boards", """SELECT p.id, p.full_name, count(DISTINCT b.dst) AS n_boards, string_agg(DISTINCT t.full_name, '; '
  ORDER BY t.full_name) AS boards FROM boards b JOIN persons p ON p.id = b.src JOIN companies t ON t.id = b.dst
  GROUP BY p.id, p.full_name HAVING count(DISTINCT b.dst) >= 3""")
def q6(d):
    met = _pairs(d, d.boards).groupBy(F.col("src").alias("id"), F.col("s_full_name").alias("full_name"))
    names = F.array_join(F.array_sort(F.collect_set("t_full_name")), "; ")
    return met.agg(F.count_distinct("dst").alias("n_boards"), names.alias("boards")).filter("n_boards >= 3")


@query("q7_network_transactions", """, star AS (SELECT id AS src, id AS dst FROM nodes UNION SELECT src, dst FROM closed),
  orders2 AS (SELECT o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
  SELECT p.id, count(DISTINCT star.dst) AS network, (SELECT count(*) FROM orders2 WHERE 'P' || o_custkey = p.id) AS n,
  coalesce((SELECT sum(cents) FROM orders2 WHERE 'P' || o_custkey = p.id), 0)::BIGINT AS total_cents,
  (SELECT round(sum(cents)::DOUBLE / count(*), 4) FROM orders2 WHERE 'P' || o_custkey = p.id) AS avg_cents,
  (SELECT max(cents) FROM orders2 WHERE 'P' || o_custkey = p.id) AS max_cents
  FROM persons p JOIN star ON star.src = p.id WHERE p.is_pep GROUP BY p.id""")
def q7(d):
    peps = d.persons.filter("is_pep").select("id")
    star = graph.reflexive(graph.closure(d.owns, seeds=peps), peps)
    sizes = star.groupBy("src").agg(F.count_distinct("dst").alias("network"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    paid = d.table("orders").groupBy(F.concat(F.lit("P"), "o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total_cents"), F.max(cents).alias("max_cents"), F.round(F.avg(cents), 4).alias("avg_cents")
    )
    return sizes.withColumnRenamed("src", "id").join(paid, "id", "left").select(
        "id", "network", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total_cents", F.lit(0)).alias("total_cents"), "max_cents", "avg_cents"
    )


@query("q8_recent_pep_changes", """SELECT p.id, p.pep_level, max(event_id) AS last_event, count(*) AS n_events FROM events
  JOIN persons p ON p.id = 'P' || user_id WHERE p.is_pep AND ts > TIMESTAMP '2024-01-05 00:00:00' GROUP BY p.id, p.pep_level""")
def q8(d):
    late = d.table("events").filter("ts > TIMESTAMP_NTZ '2024-01-05 00:00:00'").withColumn("id", F.concat(F.lit("P"), "user_id"))
    return late.join(d.persons.filter("is_pep"), "id").groupBy("id", "pep_level").agg(
        F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n_events")
    )


@query("b1a_pep_profiles", "SELECT id, full_name, country, pep_level, risk_score FROM risk WHERE is_pep")
def b1a(d):
    return scored(d, d.persons.filter("is_pep"), cycles=False).select("id", "full_name", "country", "pep_level", "risk_score")


@query("b2a_pep_owned_offshore", """SELECT p.id AS person_id, t.id AS company_id, o.ownership_percentage, t.employee_count
  FROM owns o JOIN persons p ON p.id = o.src JOIN companies t ON t.id = o.dst WHERE p.is_pep AND t.is_offshore""")
def b2a(d):
    return _pairs(d, d.owns).filter("s_is_pep AND t_is_offshore").select(
        F.col("src").alias("person_id"), F.col("dst").alias("company_id"), "ownership_percentage",
        F.col("t_employee_count").alias("employee_count"),
    )


@query("j11_pep_offshore_shells", """SELECT p.id AS person_id, t.id AS company_id FROM owns o JOIN persons p ON p.id = o.src JOIN companies t ON t.id = o.dst
  WHERE p.is_pep AND t.is_offshore AND t.employee_count <= 2""")
def j11(d):
    met = _pairs(d, d.owns).filter("s_is_pep AND t_is_offshore AND t_employee_count <= 2")
    return met.select(F.col("src").alias("person_id"), F.col("dst").alias("company_id"))


@query("b3a_circular_companies", """SELECT id, full_name, risk_score FROM risk WHERE has_circular_ownership AND entity_type = 'company'""")
def b3a(d):
    return scored(d).filter("has_circular_ownership AND entity_type = 'company'").select("id", "full_name", "risk_score")


@query("b4a_three_level_chains", """SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM owns a
  JOIN owns b ON a.dst = b.src JOIN owns c ON b.dst = c.src ORDER BY 1, 2, 3, 4 LIMIT 20""")
def b4a(d):
    return graph.chains(d.owns, 3).orderBy("n0", "n1", "n2", "n3").limit(20)


@query("b5a_nominees", """SELECT r.id, director_count, string_agg(b.dst, '; ' ORDER BY b.dst) AS companies FROM risk r
  JOIN boards b ON b.src = r.id WHERE is_nominee_director GROUP BY r.id, director_count""")
def b5a(d):
    lists = d.boards.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), "; ").alias("companies"))
    return scored(d, d.persons, cycles=False).filter("is_nominee_director").join(lists, "id").select("id", "director_count", "companies")


@query("b6a_name_check", """SELECT id, full_name, entity_type, is_pep, risk_score, EXISTS (SELECT 1 FROM owns WHERE src = risk.id) AS owns_any
  FROM risk WHERE contains(lower(full_name), lower('R#00000001'))""")
def b6a(d):
    owners = d.owns.select(F.col("src").alias("o")).distinct()
    hit = scored(d).filter(F.lower("full_name").contains("R#00000001".lower()))
    return hit.join(owners, F.col("id") == F.col("o"), "left").select(
        "id", "full_name", "entity_type", "is_pep", "risk_score", F.col("o").isNotNull().alias("owns_any")
    )


@query("b7a_provenance", """SELECT id, source_count, replace('http://example.org/entity/' || id, 'http://example.org/entity/', '') AS entity,
  array_to_string(list_transform(range(0, source_count), lambda i: 'REC_' || id || '_' || i), '; ') AS sources FROM nodes
  WHERE source_count >= 2 ORDER BY source_count DESC, id LIMIT 50""")
def b7a(d):
    names = F.expr("array_join(transform(sequence(0, source_count - 1), i -> concat('REC_', id, '_', i)), '; ')")
    iri = F.concat(F.lit(sinks.ENTITY), "id")
    top = d.nodes.filter("source_count >= 2").orderBy(F.desc("source_count"), "id").limit(50)
    return top.select("id", "source_count", F.replace(iri, F.lit(sinks.ENTITY), F.lit("")).alias("entity"), names.alias("sources"))


@query("b8a_shell_flags", """SELECT t.id, t.employee_count, o.src AS owner_id, coalesce(n.is_pep, false) AS owner_is_pep,
  CASE WHEN t.is_shell AND coalesce(n.is_pep, false) THEN 'REJECT' WHEN t.is_shell OR coalesce(n.is_pep, false) THEN 'EDD'
  ELSE 'APPROVE' END AS decision FROM flags t LEFT JOIN owns o ON o.dst = t.id LEFT JOIN nodes n ON n.id = o.src
  WHERE t.entity_type = 'company' AND t.is_offshore""")
def b8a(d):
    shells = scored(d, d.companies.filter("is_offshore"), cycles=False).select("id", "employee_count", "is_shell")
    owners = d.owns.select("src", "dst").join(d.nodes.select(F.col("id").alias("src"), "is_pep"), "src", "left")
    exposed = F.coalesce("is_pep", F.lit(False))
    return shells.join(owners, F.col("id") == F.col("dst"), "left").select(
        "id", "employee_count", F.col("src").alias("owner_id"), exposed.alias("owner_is_pep"), risk.decision(F.col("is_shell"), exposed).alias("decision")
    )


@query("b9_dashboard", """SELECT count(*) AS entities, count(*) FILTER (is_pep) AS peps, count(*) FILTER (is_nominee_director) AS nominees,
  count(*) FILTER (is_shell) AS shells, count(*) FILTER (has_circular_ownership) AS circular,
  count(*) FILTER (risk_score >= 20) AS high_risk, count(*) FILTER (is_pep OR is_nominee_director OR is_shell OR risk_score >= 50)
  AS high_risk_class FROM risk""")
def b9(d):
    tests = {"peps": "is_pep", "nominees": "is_nominee_director", "shells": "is_shell", "circular": "has_circular_ownership",
             "high_risk": "risk_level = 'HIGH'", "high_risk_class": "is_high_risk_class"}
    return scored(d).agg(F.count(F.lit(1)).alias("entities"), *[F.expr(f"count_if({t})").alias(n) for n, t in tests.items()])


@query("r1_stakes_over_25", "SELECT src, dst, ownership_percentage FROM owns WHERE ownership_percentage > 25")
def r1(d):
    return d.owns.filter("ownership_percentage > 25").select("src", "dst", "ownership_percentage")


@query("r3_pep_provenance", """SELECT p.id, 'REC_' || p.id || '_' || i AS record FROM persons p, unnest(range(0, source_count)) u(i) WHERE is_pep""")
def r3(d):
    return d.persons.filter("is_pep").select("id", F.expr("explode(transform(sequence(0, source_count - 1), i -> concat('REC_', id, '_', i)))").alias("record"))


@query("r4_recursive_cte", "SELECT DISTINCT src, dst FROM walks WHERE depth < 10")
def r4(d):
    """Walks of bounded depth; they may pass a cycle again, ``q1_ubo`` and ``g10_closure`` never do."""
    return d.spark.sql("""
        WITH RECURSIVE walk(src, dst, depth) AS (
          SELECT src, dst, 1 FROM {owns}
          UNION ALL SELECT w.src, o.dst, depth + 1 FROM walk w JOIN {owns} o ON w.dst = o.src WHERE depth < 9)
        SELECT DISTINCT src, dst FROM walk""", owns=d.owns.select("src", "dst"))


@query("r5_controls", "SELECT src, dst, 'controls' AS rel FROM closed")
def r5(d):
    return d.closed.select("src", "dst", F.lit("controls").alias("rel"))


@query("o8_inverse_views", "SELECT dst AS src, src AS dst, 'ownedBy' AS rel FROM owns UNION ALL SELECT dst, src, 'controlledBy' FROM closed")
def o8(d):
    turned = lambda e, rel: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(rel).alias("rel"))
    return turned(d.owns, "ownedBy").unionByName(turned(d.closed, "controlledBy"))


@query("g2_cycle_enumeration", """, paths AS (SELECT [src] AS path, dst FROM owns UNION
  SELECT list_append(path, paths.dst), owns.dst FROM paths JOIN owns ON paths.dst = owns.src
  WHERE paths.dst > path[1] AND NOT list_contains(path, paths.dst))
  SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM paths WHERE dst = path[1]""")
def g2(d):
    return graph.cycles(d.owns).select(F.array_join("path", ">").alias("cycle"), "length")


@query("g10_closure", "SELECT src, dst, depth::INT AS depth FROM closed")
def g10(d):
    return d.closed


@query("g11_reflexive_closure", "SELECT id AS src, id AS dst, 0 AS depth FROM nodes UNION ALL SELECT src, dst, depth FROM closed WHERE src <> dst")
def g11(d):
    return graph.reflexive(d.closed, d.nodes)


@query("g12_bounded_paths", "SELECT src, dst, depth::INT AS depth FROM closed WHERE depth <= 3")
def g12(d):
    return graph.closure(d.owns, max_depth=3)


@query("a1_ownership_groups", """, both_ways AS (SELECT src, dst FROM owns UNION SELECT dst, src FROM owns),
  linked AS (SELECT src, dst FROM both_ways UNION SELECT linked.src, b.dst FROM linked JOIN both_ways b ON linked.dst = b.src)
  SELECT src AS node, min(dst) AS component FROM linked GROUP BY src""")
def a1(d):
    return connected_components(d.owns)


@query("g3_risk_scores", """SELECT id, director_count, owned_count, is_nominee_director, is_shell, has_circular_ownership, risk_score,
  CASE WHEN risk_score >= 20 THEN 'HIGH' WHEN risk_score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  array_to_string(factors, ',') AS factors FROM risk""")
def g3(d):
    kinds = F.array_join(F.transform("risk_factors", lambda f: f["type"]), ",").alias("factors")
    return scored(d).select(
        "id", "director_count", "owned_count", "is_nominee_director", "is_shell", "has_circular_ownership", "risk_score", "risk_level", kinds
    )


@query("a15_type_counts", """SELECT country, count(*) FILTER (entity_type = 'person') AS person, count(*) FILTER (entity_type = 'company')
  AS company, count(*) FILTER (risk_score >= 20) AS high FROM risk GROUP BY country""")
def a15(d):
    counted = scored(d).groupBy("country").agg(
        F.count_if(F.col("entity_type") == "person").alias("person"), F.count_if(F.col("entity_type") == "company").alias("company"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
    )
    return counted


@query("a15b_risk_pivot", """SELECT entity_type, count(*) FILTER (l = 'HIGH') AS HIGH, count(*) FILTER (l = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (l = 'LOW') AS LOW FROM (SELECT entity_type, CASE WHEN risk_score >= 20 THEN 'HIGH' WHEN risk_score >= 10
  THEN 'MEDIUM' ELSE 'LOW' END AS l FROM risk) GROUP BY entity_type""")
def a15b(d):
    return scored(d).groupBy("entity_type").pivot("risk_level", ["HIGH", "MEDIUM", "LOW"]).count().na.fill(0)


@query("c1_top_by_sources", "SELECT id, source_count FROM nodes ORDER BY source_count DESC, id LIMIT 5")
def c1(d):
    return d.nodes.orderBy(F.desc("source_count"), "id").limit(5).select("id", "source_count")


@query("c5_multi_layer_chains", """SELECT DISTINCT a.src AS n0, c.dst AS n3 FROM edges a JOIN edges b ON a.dst = b.src
  JOIN edges c ON b.dst = c.src JOIN companies t ON t.id = c.dst""")
def c5(d):
    walk = graph.chains(d.edges, 3).select("n0", "n3").distinct()
    return walk.join(d.companies.select(F.col("id").alias("n3")), "n3", "left_semi").select("n0", "n3")


@query("c6_growth", """SELECT count(*) FILTER (event_id % 2 = 0) AS before, count(*) AS after, count(*) - count(*) FILTER (event_id % 2 = 0)
  AS growth FROM events""", domain=False)
def c6(d):
    return d.table("events").agg(
        F.count_if(F.col("event_id") % 2 == 0).alias("before"), F.count(F.lit(1)).alias("after"),
        (F.count(F.lit(1)) - F.count_if(F.col("event_id") % 2 == 0)).alias("growth"),
    )


@query("k5_golden_json", """SELECT n.id, (SELECT count(*) FROM owns WHERE src = n.id) AS n_owns, (SELECT count(*) FROM owns WHERE dst = n.id)
  AS n_owned_by, (SELECT count(*) FROM boards WHERE src = n.id) AS n_director_of, (SELECT count(*) FROM boards WHERE dst = n.id)
  AS n_has_director FROM nodes n""")
def k5(d):
    made = sinks.golden_json(d.nodes, d.edges)
    return made.select("id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("owns", "owned_by", "director_of", "has_director")])


@query("k6_rdf_edge_triples", """, named AS (SELECT 'http://example.org/entity/' || src AS s, 'http://example.org/entity/' || dst AS o,
    '_:b' || substr(sha256(src || '|' || dst || '|' || rel), 1, 24) AS b, rel, ownership_percentage AS pct FROM edges)
  SELECT s, 'owns' AS p, o FROM named WHERE rel = 'owns' UNION ALL SELECT s, 'directorOf', o FROM named WHERE rel = 'directorOf'
  UNION ALL SELECT s, 'hasStake', b FROM named WHERE rel = 'owns' UNION ALL SELECT s, 'hasAppointment', b FROM named WHERE rel = 'directorOf'
  UNION ALL SELECT b, 'inCompany', o FROM named WHERE rel = 'owns' UNION ALL SELECT b, 'atCompany', o FROM named WHERE rel = 'directorOf'""")
def k6(d):
    made = sinks.edge_triples(d.edges).withColumn("p", F.element_at(F.split("p", "[#]"), -1))
    kept = made.filter(F.col("p").isin("owns", "directorOf", "hasStake", "hasAppointment", "inCompany", "atCompany"))
    return kept.select("s", "p", "o")


@query("k6_rdf_node_triples", """SELECT p, count(*) AS n FROM (
  SELECT unnest(list_filter(['type', 'type', 'wasAttributedTo', 'hasName', 'hasGoldenId', 'hasCountry', 'riskScore', 'riskLevel', 'sourceCount',
    CASE WHEN is_pep THEN 'type' END, CASE WHEN is_nominee_director THEN 'type' END,
    CASE WHEN entity_type = 'company' AND is_offshore THEN 'type' END, CASE WHEN is_shell THEN 'type' END,
    CASE WHEN entity_type = 'person' THEN 'isPEP' END, CASE WHEN is_pep THEN 'pepLevel' END,
    CASE WHEN entity_type = 'person' THEN 'directorCount' END, CASE WHEN entity_type = 'person' THEN 'isNominee' END,
    CASE WHEN entity_type = 'company' AND employee_count IS NOT NULL THEN 'employeeCount' END,
    CASE WHEN entity_type = 'company' THEN 'isOffshore' END,
    CASE WHEN has_circular_ownership THEN 'hasCircularOwnership' END], lambda x: x IS NOT NULL)) AS p FROM risk
  UNION ALL SELECT 'riskFactor' FROM risk, unnest(factors)) GROUP BY p""")
def k6_nodes(d):
    made = sinks.node_triples(scored(d))
    return made.groupBy(F.element_at(F.split("p", "[#]"), -1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("o2_disjoint_check", "SELECT count(*) AS violations FROM persons JOIN companies USING (id)")
def o2(d):
    return d.persons.select("id").intersect(d.companies.select("id")).agg(F.count(F.lit(1)).alias("violations"))


@query("o12_value_checks", """SELECT count(*) FILTER (ownership_percentage NOT BETWEEN 0 AND 100) AS bad_percentages, count(*) AS stakes FROM owns""")
def o12(d):
    return d.owns.agg(F.count_if(~F.col("ownership_percentage").between(0, 100)).alias("bad_percentages"), F.count(F.lit(1)).alias("stakes"))


@query("gt_record_search", """SELECT doc_id, source, regexp_extract(text, '(?i)(license|copyright|rights reserved)', 1) AS hit
  FROM documents WHERE regexp_matches(text, '(?i)license|copyright|rights reserved')""", domain=False)
def gt(d):
    hit = F.regexp_extract("text", "(?i)(license|copyright|rights reserved)", 1)
    return d.table("documents").filter(F.col("text").rlike("(?i)license|copyright|rights reserved")).select("doc_id", "source", hit.alias("hit"))


@query("r2_stakes_with_dates", """SELECT src, dst, ownership_percentage, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE 'P' || o_custkey = src)
  AS last_order FROM owns WHERE ownership_percentage > 25 AND starts_with(src, 'P')""")
def r2(d):
    last = d.table("orders").groupBy(F.concat(F.lit("P"), "o_custkey").alias("src")).agg(F.substring(F.max("o_orderdate").cast("string"), 1, 10).alias("last_order"))
    big = d.owns.filter("ownership_percentage > 25 AND src LIKE 'P%'")
    return big.join(last, "src", "left").select("src", "dst", "ownership_percentage", "last_order")


@query("r6_as_of_batch", """SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events
  WHERE event_id % 3 <= 1 GROUP BY user_id""", domain=False)
def r6(d):
    """Three batches as versions of a state, each with all before it; the second one is read."""
    path = Scratch(d.spark, "as-of").root
    events = d.table("events").select("user_id", "event_id")
    for version in range(3):
        sinks.save_state(path, version, events=events.filter(F.col("event_id") % 3 <= version))
    seen = sinks.load_state(d.spark, path, 1, "events")["events"]
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("o3_class_flags", """SELECT id, entity_type = 'person' AND is_pep AS pep, is_nominee_director AS nominee,
  entity_type = 'company' AND is_offshore AS offshore, is_shell AS shell,
  is_pep OR is_nominee_director OR is_shell OR risk_score >= 50 AS high_risk FROM risk""")
def o3(d):
    return scored(d).select(
        "id", ((F.col("entity_type") == "person") & F.col("is_pep")).alias("pep"), F.col("is_nominee_director").alias("nominee"),
        ((F.col("entity_type") == "company") & F.col("is_offshore")).alias("offshore"), F.col("is_shell").alias("shell"),
        F.col("is_high_risk_class").alias("high_risk"),
    )


@query("o10_appointments", """SELECT DISTINCT 'http://example.org/entity/' || src AS person, 'http://example.org/entity/' || dst AS company FROM boards""")
def o10(d):
    """directorOf from hasAppointment and atCompany, joined over the triples."""
    made = sinks.edge_triples(d.edges)
    has = made.filter(F.col("p") == sinks.UBO + "hasAppointment").select(F.col("s").alias("person"), F.col("o").alias("appointment"))
    at = made.filter(F.col("p") == sinks.UBO + "atCompany").select(F.col("s").alias("appointment"), F.col("o").alias("company"))
    return has.join(at, "appointment").select("person", "company").distinct()


@query("o11_domains_and_ranges", """SELECT count(*) FILTER (rel = 'directorOf' AND a.entity_type <> 'person') AS boards_of_companies,
  count(*) FILTER (b.entity_type <> 'company') AS not_of_companies, count(*) FILTER (a.id IS NULL OR b.id IS NULL) AS unknown_ends,
  (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)) AS repeated_ids FROM edges LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst""")
def o11(d):
    """What the vocabulary's domains, ranges and functional properties forbid, counted."""
    return risk.violations(d.nodes, d.edges)


@query("o13_statements", """SELECT 'http://example.org/entity/statement/' || dst AS statement, 'http://example.org/entity/' || dst AS company, count(*) AS stakes
  FROM owns GROUP BY dst""")
def o13(d):
    made = sinks.statement_triples(d.edges, "2024-01-01")
    of = made.filter(F.col("p") == sinks.UBO + "forCompany").select(F.col("s").alias("statement"), F.col("o").alias("company"))
    stakes = made.filter(F.col("p") == sinks.UBO + "hasStake").groupBy(F.col("s").alias("statement")).agg(F.count(F.lit(1)).alias("stakes"))
    return of.join(stakes, "statement")


@query("c2_exposed_persons", """SELECT id, full_name, pep_level, (SELECT count(*) FROM persons WHERE is_pep) AS total FROM persons WHERE is_pep
  ORDER BY id LIMIT 5""")
def c2(d):
    """The first exposed persons, and how many there are."""
    return risk.first_of(d.persons.filter("is_pep"), 5, "id", "full_name", "pep_level")


@query("c3_batch_growth", """SELECT count(*) FILTER (event_id % 4 < 3) AS nodes_before, count(*) AS nodes_after, count(*) FILTER (event_id % 4 = 3) AS nodes_new
  FROM (SELECT DISTINCT event_id FROM events)""", domain=False)
def c3(d):
    """Nodes before and after a batch that sends a quarter of the known events again."""
    e = d.table("events").select("event_id")
    return risk.growth(e.filter("event_id % 4 < 3"), e.filter("event_id % 4 >= 2"), "event_id")


@query("c4_single_entity_check", """SELECT 'Customer#00000001' AS part, count(*) AS entities, max(source_count)::INT AS most_sources, count(*) = 1 AS is_single
  FROM nodes WHERE contains(full_name, 'Customer#') AND contains(full_name, '00000001')""")
def c4(d):
    """Whether a name is one entity across sources."""
    return risk.single_entity(d.nodes, "Customer#", "00000001")


@query("a10_relation_counts", """SELECT src AS id, count(*) FILTER (rel = 'directorOf') AS director_count,
  count(*) FILTER (rel = 'owns') AS owned_count FROM edges GROUP BY src""")
def a10(d):
    return d.edges.groupBy(F.col("src").alias("id")).agg(
        F.count_if(F.col("rel") == "directorOf").alias("director_count"), F.count_if(F.col("rel") == "owns").alias("owned_count")
    )


@query("c7_ring_shares", """SELECT o.src, o.dst, o.ownership_percentage FROM owns o JOIN cyclic a ON a.id = o.src JOIN cyclic b ON b.id = o.dst""")
def c7(d):
    on = graph.on_cycles(d.owns)
    inner = d.owns.join(on.withColumnRenamed("id", "src"), "src", "left_semi").join(on.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "ownership_percentage")
