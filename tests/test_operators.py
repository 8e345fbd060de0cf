import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, golden, graph, incremental, risk
from tessera.operators.components import connected_components
from tessera.operators.config import Config
from tessera.operators.contract import Contract, explode_boards, statistics
from tessera.operators.enrich import enrich
from tessera.operators.matching import Matcher
from tessera.sources import generator, readers, sinks
from tessera.streaming import upsert

# An ownership graph with a chain, a fork and a ring.
OWNS = [("P1", "C1"), ("C1", "C2"), ("P2", "C3"), ("P3", "C4"), ("C4", "C5"), ("C2", "C6"), ("C8", "C7"), ("C9", "C8"), ("C7", "C9")]


@pytest.fixture(scope="module")
def owns(spark):
    return spark.createDataFrame(OWNS, "src string, dst string")


def test_closure(owns, spark):
    closed = {(r.src, r.dst): r.depth for r in graph.closure(owns).collect()}
    assert len(closed) == 19 and closed["P1", "C6"] == 3 and closed["C7", "C7"] == 3
    seeds = spark.createDataFrame([("C6",)], "id string")
    assert {r.src for r in graph.closure(owns, seeds, backwards=True).collect()} == {"P1", "C1", "C2"}
    assert graph.closure(owns, max_depth=1).count() == 9
    assert graph.closure(owns.limit(0)).count() == 0


def test_cycles(owns):
    assert [r.path for r in graph.cycles(owns).collect()] == [["C7", "C9", "C8"]]
    assert {r.id for r in graph.on_cycles(owns).collect()} == {"C7", "C8", "C9"}


def test_components(owns, spark):
    parts = {r.node: r.component for r in connected_components(owns).collect()}
    assert parts["C6"] == parts["P1"] == "C1" and parts["C9"] == "C7" and parts["P2"] == "C3"
    chain = spark.range(0, 200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(chain).select("component").distinct().collect()} == {0}


def test_risk(owns, spark):
    nodes = [(f"P{n}", "person", n < 3, False, None) for n in (1, 2, 3)]
    nodes += [(f"C{n}", "company", False, n not in (4, 5), 0 if n != 5 else 9) for n in range(1, 10)]
    table = spark.createDataFrame(nodes, "id string, entity_type string, is_pep boolean, is_offshore boolean, employee_count int")
    found = {r.id: r for r in risk.score(table, owns.withColumn("rel", F.lit("owns"))).collect()}
    assert [found[n].risk_score for n in ("C1", "C7", "P1", "P3", "C4")] == [30, 65, 20, 0, 0]
    assert [f.type for f in found["C7"].risk_factors] == ["SHELL_COMPANY", "CIRCULAR_OWNERSHIP"]
    assert found["P3"].risk_level == "LOW" and found["P1"].risk_level == "HIGH"


def record(n, **more):
    base = dict(record_id=f"R{n}", entity_id=f"E{n}", entity_type="person", full_name="John Smith", dob="1980-01-02", nationality="British", is_pep=None,
                pep_level=None, company_number=None, date_incorporated=None, employee_count=None, is_offshore=None, address="1 High St, Leeds", city=None,
                country="UK", owned_by_entity_id=None, ownership_percentage=None, director_of_entity_ids=None, source_type="csv_internal", batch_id="b",
                ingested_at=f"2024-01-{n:02d}")
    return base | more


COLUMNS = ", ".join(f"{n} {t}" for n, t in Contract().types.items())


def records(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in Contract().types) for r in rows], COLUMNS)


def test_matching_clusters_and_incremental(spark):
    first = records(spark, record(1), record(2, full_name="J. Smith", ingested_at="2024-01-09"), record(3, full_name="Ann Lee", dob="1970-05-05", address=None))
    state = incremental.resolve(first)
    found = {r.record_id: r.cluster_id for r in state.records.collect()}
    assert found == {"R1": "R1", "R2": "R1", "R3": "R3"}
    second = records(spark, record(1), record(4, full_name="Smith, John"), record(5, full_name="New Person", dob="1999-09-09", address=None))
    after = incremental.process(state, second)
    assert {r.record_id: r.cluster_id for r in after.records.collect()} == {"R1": "R1", "R2": "R1", "R3": "R3", "R4": "R1", "R5": "R5"}
    assert {r.cluster_id: r.change for r in incremental.changes(state, after).collect()} == {"R1": "updated", "R3": "unchanged", "R5": "inserted"}


def test_company_rules(spark):
    firm = dict(entity_type="company", dob=None, nationality=None)
    rows = [record(1, **firm, full_name="Acme Ltd", company_number="12345678"), record(2, **firm, full_name="Acme Limited", company_number="12345678", source_type="x"),
            record(3, **firm, full_name="Acme Ltd", company_number="12399999")]
    m = Matcher()
    found = {(r.l_record_id, r.r_record_id): (r.is_match, r.tier) for r in m.scored(m.pairs(records(spark, *rows))).collect()}
    assert found["R1", "R2"] == (True, "HIGH") and found["R1", "R3"] == (False, None) and ("R2", "R3") not in found


def test_survivorship_and_edges(spark):
    rows = [record(1, address="old", source_type="json_land_registry", nationality="A", is_pep=False), record(2, address="new", nationality="B", full_name="Johnny Smith"),
            record(3, entity_type="company", full_name="Acme", owned_by_entity_id="E1", ownership_percentage=60.0, company_number="77")]
    rows[0]["director_of_entity_ids"] = "E3; nobody"
    table = records(spark, *rows).withColumn("cluster_id", F.when(F.col("record_id") == "R3", "k2").otherwise("k1"))
    made = golden.build(table)
    one = {r.cluster_id: r for r in made.collect()}["k1"]
    assert (one.address, one.nationality, one.full_name, one.source_count, one.is_pep) == ("new", "A", "Johnny Smith", 2, False)
    known = golden.aliases(table, made)
    assert {(r.src, r.dst, r.rel) for r in golden.edges(made, known).collect()} == {("GOLDEN_R1", "GOLDEN_R3", "owns"), ("GOLDEN_R1", "GOLDEN_R3", "directorOf")}


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "record_id string, entity_id int")
    found = spark.createDataFrame([("a", 9), ("b", 9), ("c", 8), ("d", 8)], "record_id string, cluster_id int")
    r = evaluate.pairwise(truth, found).first()
    assert (r.tp, r.fp, r.fn, r.precision) == (1, 1, 2, 0.5)
    assert {r.cluster_id: r.purity for r in evaluate.purity(truth, found).collect()} == {9: 1.0, 8: 0.5}
    assert evaluate.pairwise(truth.limit(0), found.limit(0)).first().f1 == 0.0


def test_contract_and_enrichment(spark):
    raw = spark.createDataFrame([("Ann", "person", "2x", "UK", "a;;b"), (None, "robot", "3", "Panama", None)], "fullName string, entity_type string, employee_count string, Country string, director_of_entity_ids string")
    made = Contract().normalise(raw, "csv_internal", "B", ordinal=F.when(F.col("fullName").isNull(), 1).otherwise(0))
    rows = {r.record_id: r for r in made.collect()}
    assert rows["B_CSV_REC_000000"]._errors == [] and rows["B_CSV_REC_000000"]._converted == ["employee_count"]
    assert rows["B_CSV_REC_000001"]._errors == ["full_name: required", "entity_type: must_be_one_of"]
    assert statistics(made).first().failed == 1
    assert [r.record_id for r in explode_boards(made.filter("full_name = 'Ann'")).orderBy("record_id").collect()] == ["B_CSV_REC_000000", "B_CSV_REC_000000_01"]
    e = enrich(made.filter("full_name = 'Ann'")).first()
    assert (e.nationality, e.country, e.entity_id, e.is_pep) == ("British", "United Kingdom", "ENT_ANN_UNKNOWN", False)


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"full_name": "Ann", "address": {"line1": "1 Rd", "city": "Leeds"}, "ownership": {"entity_id": "E", "percentage": 5}, "director_of": ["x", "y"]}]}))
    r = readers.json(spark, str(tmp_path / "a.json")).first()
    assert (r.address, r.city, r.owned_by_entity_id, r.ownership_percentage, r.director_of_entity_ids) == ("1 Rd, Leeds", "Leeds", "E", "5", "x;y")
    (tmp_path / "a.xml").write_text("<d><Person><FullName> Ann </FullName><DirectorOf><CompanyNumber>1</CompanyNumber><CompanyNumber>2</CompanyNumber></DirectorOf></Person><Company><CompanyName>A</CompanyName><CompanyNumber>7</CompanyNumber><EmployeeCount>n/a</EmployeeCount></Company></d>")
    assert {r.director_of_entity_ids for r in readers.xml_persons(spark, str(tmp_path / "a.xml")).collect()} == {"ENT_CO_1", "ENT_CO_2"}
    c = readers.xml_companies(spark, str(tmp_path / "a.xml")).first()
    assert (c.entity_id, c.employee_count, c.address) == ("ENT_CO_7", None, None)
    (tmp_path / "a.csv").write_bytes("full_name,dob\nJosé,01\n".encode("latin-1"))
    assert readers.csv(spark, str(tmp_path / "a.csv"), "ISO-8859-1").first() == ("José", "01")


def test_sinks(spark, owns, tmp_path):
    edges = owns.select("src", "dst", F.lit("owns").alias("rel"), F.lit(60.0).alias("ownership_percentage"))
    lines = [r.value for r in sinks.n_triples(sinks.edge_triples(edges)).collect()]
    assert all(line.endswith(" .") for line in lines) and sum("hasStake" in line for line in lines) == 9
    sinks.save_state(str(tmp_path), 3, edges=edges)
    assert sinks.load_state(spark, str(tmp_path), 3, "edges")["edges"].count() == 9


def test_stream_upsert(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(k, n) for k in range(n, n + 3)], "k int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = upsert.follow(spark, f"{tmp_path}/in", "k int, v int", f"{tmp_path}/c", f"{tmp_path}/s", upsert.latest("k", "v"))
    query.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/s/v={query.lastProgress['batchId']}")
    assert {r.k: r.v for r in last.collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}


def test_most_recent_ties_go_to_the_least_record(spark):
    rows = [record(2, address="b", ingested_at="2024-05-05"), record(1, address="a", ingested_at="2024-05-05"), record(3, address="c", ingested_at="2024-05"),
            record(4, address=None, ingested_at="2025-01-01"), record(5, address="e", ingested_at=None)]
    made = golden.build(records(spark, *rows).withColumn("cluster_id", F.lit("k")))
    assert made.first().address == "a"


def test_numbers_follow_partitions(spark):
    raw = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("fullName"), F.lit("person").alias("entity_type"))
    made = Contract().normalise(raw, "csv_internal", "B").select("full_name", "record_id").collect()
    assert all(r.record_id == f"B_CSV_REC_{int(r.full_name):06d}" for r in made)


def test_cycle_membership_by_brute_force(spark):
    import random

    rng = random.Random(1)
    for n in range(6):
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(rng.choice((4, 12, 18)))}
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        df = spark.createDataFrame([*pairs, (99, None)], "src int, dst int")
        assert {r.id for r in graph.on_cycles(df).collect()} == {a for a, b in reach if a == b}
    assert graph.on_cycles(df.limit(0)).count() == 0


def test_orphans_meet_all_golden_records(spark):
    known = records(spark, *[record(n, full_name=f"Person {n}", dob=f"19{50 + n}-01-01") for n in range(1, 9)])
    fresh = records(spark, record(20, full_name="Mr. Person 3", dob="2000-05-05"), record(21, full_name="Person 4", dob="1954-01-01"))
    m = Matcher(block_rows=2)
    golden_ = m.with_block(known).withColumn("golden_id", F.concat(F.lit("G"), "record_id"))
    met = {(r.l_record_id, r.r_record_id) for r in m.candidates(fresh, golden_).collect()}
    assert {b for a, b in met if a == "R20"} == {f"R{n}" for n in range(1, 9)} and {b for a, b in met if a == "R21"} == {"R4"}


def test_csv_falls_back_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("full_name,dob\nZoë,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("full_name,dob\nJosé,2\n".encode("latin-1"))
    found = readers.csv(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("Zoë", "1"), ("José", "2")}


def test_json_root_must_hold_records(spark, tmp_path):
    (tmp_path / "a.json").write_text("42")
    with pytest.raises(ValueError):
        readers.json(spark, str(tmp_path / "a.json"))


def test_wide_export_and_dead_letters(spark, tmp_path):
    raw = spark.createDataFrame([("Ann", "person"), (None, "robot")], "fullName string, entity_type string")
    made = Contract().normalise(raw, "csv_internal", "B")
    assert sinks.export_wide(made.limit(0), f"{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
    assert sinks.export_wide(made, f"{tmp_path}/wide") == 2
    assert spark.read.csv(f"{tmp_path}/wide", header=True).columns == list(Contract().types)
    sinks.write_dead_letters(made, f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/bad").first().error == ["full_name: required", "entity_type: must_be_one_of"]


def test_generated_records_follow_the_contract(spark):
    made = generator.records(spark, 60, 40, seed=3)
    again = generator.records(spark, 60, 40, seed=3).repartition(5)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    valid = Contract().normalise(made, "synthetic", "S", ordinal=F.lit(0))
    assert valid.filter("size(_errors) > 0").count() == 0 and valid.count() == 100
    firms = made.filter("entity_type = 'company'")
    own = firms.select(F.col("owned_by_entity_id").alias("src"), F.col("entity_id").alias("dst"))
    assert own.join(made.select(F.col("entity_id").alias("src")), "src", "left_anti").filter("src IS NOT NULL").count() == 0
    assert {r.id for r in graph.on_cycles(own).collect()} == {f"ENT_CO_{n:08d}" for n in (37, 38, 39)}
    assert generator.records(spark, 0, 0).count() == 0


def test_provenance_triples(spark):
    nodes = spark.createDataFrame([("G1", "person", ["r1", "r2"])], "id string, entity_type string, source_record_ids array<string>")
    made = {(r.s.split("/")[-1], r.p.split("#")[-1], r.o) for r in sinks.node_triples(nodes).collect()}
    assert {("G1", "wasAttributedTo", "urn:pipeline:ubo-graph-v1"), ("RECORD_r1", "atLocation", "urn:source:record:r1"), ("RECORD_r2", "label", "Original record r2"),
            ("G1", "type", sinks.UBO + "Entity")} <= made


def test_versions_are_pruned_and_gaps_are_skipped(spark, tmp_path):
    write = upsert.versioned(spark, f"{tmp_path}/s", upsert.latest("k", "v"), keep=2)
    for number in (0, 1, 4, 5, 4):  # 2 and 3 never came, 4 comes again
        write(spark.createDataFrame([(number, number)], "k int, v int"), number)
    assert upsert.versions(spark, f"{tmp_path}/s") == [4, 5]
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/s/v=5").collect()} == {0, 1, 4, 5}


def test_batches_equal_a_rebuild(spark):
    """Golden records, edges and risk after batches are those of all records together; order and repeats don't matter."""
    rows = [record(n, full_name=f"Person {n % 7}", dob=f"19{60 + n % 7}-03-04", is_pep=n % 7 == 2, director_of_entity_ids=f"E{40 + n % 3}", address=f"{n % 7} Rd, Leeds") for n in range(1, 22)]
    rows += [record(40 + n, entity_type="company", full_name=f"Firm {n}", dob=None, company_number=f"1234567{n}", owned_by_entity_id="E2", ownership_percentage=60.0,
                    is_offshore=True, employee_count=1) for n in range(3)]
    first, second = records(spark, *rows[:12], *rows[21:23]), records(spark, *rows[8:])
    state = incremental.process(incremental.resolve(first), second)
    same = incremental.process(state, second.orderBy(F.rand(3)))
    full = golden.build(state.records)
    columns = [c for c in full.columns]
    seen = lambda df, names: sorted(str([r[c] for c in names]) for r in df.collect())
    assert seen(state.golden, columns) == seen(full, columns) == seen(same.golden, columns)
    assert state.records.count() == 24 and state.golden.count() == 10
    held = {(r.src, r.dst, r.rel) for r in state.edges.collect()}
    assert held == {(r.src, r.dst, r.rel) for r in golden.edges(full, golden.aliases(state.records, full)).collect()} and len(held) > 3
    scores = {r.golden_id: (r.risk_score, r.is_shell) for r in state.risk.collect()}
    assert sum(shell for _, shell in scores.values()) == 3 and max(score for score, _ in scores.values()) >= 30


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("entity_resolution: {weights: {name: 0.5}}\ngolden_record: {strategies: {full_name: most_recent}}\nrisk_scoring: {nominee_director_threshold: 9, risk_levels: {high: 40}}")
    found = Config.load(str(tmp_path / "c.yaml"))
    assert (found.matcher.weights.name, found.matcher.weights.dob, found.risk.nominee, found.risk.high, found.risk.medium) == (0.5, 0.25, 9, 40, 10)
    assert found.survivorship.strategies == {"full_name": "most_recent"} and found.survivorship.priorities == golden.PRIORITIES
    (tmp_path / "none.yaml").write_text("")
    assert Config.load(str(tmp_path / "none.yaml")) == Config()


def test_values_that_are_no_numbers_break_their_rule(spark):
    df = spark.createDataFrame([("r", "person", "Ann", "many", "120")], "record_id string, entity_type string, full_name string, employee_count string, ownership_percentage string")
    assert Contract().validated(df).first()._errors == ["ownership_percentage: range", "employee_count: not a number"]


def test_matches_are_the_accepted_pairs_of_all(spark):
    """Numbers in the join, parts of large blocks and looked-up texts lose no match and repeat none."""
    names = ["Ann Lee", "Lee, Ann", "Bob Stone", "Anne Leigh"]
    rows = [record(n, full_name=names[n % 4], dob=[None, "1980-01-02", "1980-01-03"][n % 3], address=[None, "1 High St, Leeds", "2 High St, Leeds"][n % 5 % 3]) for n in range(1, 25)]
    rows += [record(100 + n, entity_type="company", full_name="Acme Ltd", company_number=[None, "12345678", " 12345678", "12399999"][n % 4], address="1 NUM, Leeds",
                    source_type=["csv_internal", "x"][n % 3 % 2]) for n in range(12)]
    table = records(spark, *rows)
    seen = lambda df: sorted((r.l_record_id, r.r_record_id, r.score, r.rule) for r in df.collect())
    plain = Matcher()
    expected = seen(plain.scored(plain.pairs(table)).filter("is_match"))
    blocked = plain.with_block(table)
    assert len(expected) > 20 and any(a.startswith("R10") for a, *_ in expected)
    assert seen(Matcher(part_rows=3).matches(Matcher(part_rows=3).linkable(blocked))) == expected
    assert seen(Matcher(text_pairs=0).matches(plain.linkable(blocked))) == expected


def test_orphans_are_searched_by_many_tasks(spark):
    high, wide = Matcher().grid(2000, 1900)
    assert high * wide > 8 and Matcher().grid(120_000, 540_000)[0] * Matcher().grid(120_000, 540_000)[1] < 1100
    m = Matcher(cell_pairs=4)
    known = m.with_block(records(spark, *[record(n, dob=f"19{50 + n}-01-01") for n in range(1, 9)])).withColumn("golden_id", F.concat(F.lit("G"), "record_id"))
    fresh = records(spark, *[record(20 + n, dob=f"20{10 + n}-05-05") for n in range(6)])
    met = [(r.l_record_id, r.r_record_id) for r in m.candidates(fresh, known).collect()]
    assert len(met) == len(set(met)) == 48


def test_orphans_search_is_written_once(spark):
    m = Matcher(cell_pairs=4, column_rows=2)
    known = m.with_block(records(spark, *[record(n, dob=f"19{50 + n}-01-01", full_name=["Ann Lee", None][n % 4 == 3]) for n in range(1, 9)])).withColumn("golden_id", F.concat(F.lit("G"), "record_id"))
    fresh = records(spark, *[record(20 + n, dob=f"20{10 + n}-05-05", full_name=["Ann Lee", None][n % 3 == 2]) for n in range(6)])
    met = m.candidates(fresh, known)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert m.grid(6, 8)[0] > 1 and m.grid(6, 8)[1] > 1 and "CartesianProduct" in plan and "Generate explode" not in plan
    found = [(r.l_record_id, r.r_record_id) for r in met.collect()]
    assert sorted(found) == sorted((f"R{20 + a}", f"R{b}") for a in range(6) for b in range(1, 9) if (a % 3 == 2) == (b % 4 == 3))  # no names: one block
    assert set(met.columns) == {f"l_{c}" for c in m.with_block(fresh).columns} | {f"r_{c}" for c in known.columns}


def test_thinned_links_connect_the_same(spark):
    from tessera.operators.components import linked_components

    links = [(f"n{a}", f"n{b}") for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3] + [("z", "z"), ("y", None)]
    df = spark.createDataFrame(links, "src string, dst string").repartition(5)
    expected = {r.node: r.component for r in connected_components(df).filter("node <> 'z'").collect()}
    for few in (0, 1000):
        found = linked_components(df, few).collect()
        assert {r.node: r.component for r in found} == expected and len(found) == 40


def test_alike_records_are_linked_without_their_square(spark):
    """i1_incremental_changes, i7_state_risk: links connect what all matches of a block do, and are few where records are alike."""
    rows = [record(n, full_name=["Ann Lee", "Lee, Ann", "Xavier Lopez"][n % 9 // 4], address=[None, "1 High St, Leeds"][n % 2]) for n in range(1, 41)]
    rows += [record(100 + n, entity_type="company", full_name=f"Acme {n % 3}", dob=None, company_number=[None, "12345678", " 12345678", "12399999"][n % 4], address=["1 NUM, Leeds", None][n % 5 // 4],
                    source_type=["csv_internal", "x"][n % 3 % 2]) for n in range(16)]
    m = Matcher(part_rows=7)
    blocked = m.with_block(records(spark, *rows))
    every = m.matches(m.linkable(blocked)).select(F.col("l_record_id").alias("src"), F.col("r_record_id").alias("dst"))
    links = incremental.links_of(blocked, m)
    parts = lambda df: {r.node: r.component for r in connected_components(df).collect()}
    assert parts(links) == parts(every) and len(set(parts(every).values())) > 3
    assert {tuple(r) for r in links.collect()} <= {tuple(r) for r in every.collect()}
    assert every.count() > 300 and links.count() < 100


def test_best_golden_record_is_that_of_all_pairs(spark):
    """i1_incremental_changes, i7_state_risk: orphans that meet golden records in arrays find the one that rows of pairs give, ties included."""
    names = ["Ann Lee", "Anne Leigh", "Bob Stone", None, "Ann Lea"]
    known = [record(n, full_name=names[n % 5], dob=[None, f"19{50 + n}-01-01", "1980-01-02"][n % 3], address=[None, f"{n % 3} High St, Leeds"][n % 2], nationality=[None, "A", " a"][n % 4 % 3]) for n in range(1, 31)]
    known += [record(60 + n, entity_type="company", full_name=f"Acme {n % 2}", dob=None, company_number=[None, "12345678", " 12345678"][n % 3], address=["1 NUM, Leeds", None][n % 5 // 4],
                     source_type=["csv_internal", None, "x"][n % 3 % 2 + n % 2]) for n in range(12)]
    fresh = [dict(r, record_id=f"N{r['record_id']}", dob=r["dob"] and f"{r['dob'][:4]}-01-02", country=r["country"] if n % 2 else f"{r['country']}x", address=r["address"] and f"{n % 2} {r['address'][2:]}",
                  company_number=[r["company_number"], "1234567"][n % 4 == 3] if r["entity_type"] == "company" else None) for n, r in enumerate(known)]
    plain = Matcher(text_pairs=0)
    golden_ = plain.with_block(records(spark, *known)).withColumn("golden_id", F.concat(F.lit("G"), "record_id")).withColumn("cluster_id", F.col("record_id"))
    blocked = plain.with_block(records(spark, *fresh))
    met = plain.scored(plain.candidates(blocked, golden_)).filter("is_match")
    expected = {r.l_record_id: r.best for r in met.groupBy("l_record_id").agg(F.min_by("r_cluster_id", F.struct(-F.col("score"), F.col("r_golden_id"))).alias("best")).collect()}
    orphans = {r.l_record_id for r in plain._orphans(*plain._met(blocked, golden_)).collect()}
    assert len(expected.keys() & orphans) > 5 and len(expected.keys() - orphans) > 1
    for m in (Matcher(cell_pairs=16, chunk_rows=(2, 3)), Matcher(), plain):
        assert {r.src: r.dst for r in m.best(blocked, golden_).collect()} == expected


def test_state_risk_by_arrays_is_that_of_rows(spark):
    """i7_state_risk: edges and risk after a batch whose orphans meet golden records in arrays."""
    person = lambda n, year: record(n, full_name=["Ann Lee", "Bob Stone", "Lee, Ann"][n % 3], dob=f"{year + n % 4}-03-04", is_pep=n % 5 == 2, director_of_entity_ids=f"E{50 + n % 3}", address=f"{n % 2} Rd, Leeds")
    firms = [record(50 + n, entity_type="company", full_name=f"Firm {n}", dob=None, company_number=f"1234567{n}", owned_by_entity_id=f"E{1 + 3 * n}", ownership_percentage=60.0,
                    is_offshore=True, employee_count=1) for n in range(3)]
    first, second = records(spark, *[person(n, 1960) for n in range(1, 13)], *firms), records(spark, *[person(n, 1980) for n in range(10, 25)])
    seen = []
    for m in (Matcher(cell_pairs=16, chunk_rows=(2, 3)), Matcher(text_pairs=0)):
        after = incremental.process(incremental.resolve(first, m, graph=False), second, m)
        risks = sorted((r.golden_id, r.source_count, r.director_count, r.owned_count, r.risk_score, r.risk_level) for r in after.risk.collect())
        seen.append((risks, sorted((r.src, r.dst, r.rel) for r in after.edges.collect()), sorted((r.record_id, r.cluster_id) for r in after.records.collect())))
    assert seen[0] == seen[1] and len(seen[0][1]) > 3 and max(r[4] for r in seen[0][0]) >= 30
    joined = {r: c for r, c in seen[0][2] if c != r}
    assert any(int(r[1:]) > 12 and int(c[1:]) < 13 for r, c in joined.items())  # an orphan found its golden record


def test_candidate_keys_are_those_of_candidates(spark):
    """j3_candidates: pairs that arrays unfold to are those of rows, each once, for orphans, large and small blocks."""
    firm = lambda n, **more: record(n, **(dict(entity_type="company", dob=None, full_name=f"Acme {n % 3}", company_number=[None, "12345678", " 12345678", "1234567"][n % 4],
                                               address=["1 NUM, Leeds", None][n % 5 // 4], source_type=["csv_internal", None, "x"][n % 3]) | more))
    known = [record(n, full_name=["Ann Lee", None, "Bob Stone"][n % 3], dob=f"19{50 + n % 9}-01-01") for n in range(1, 31)] + [firm(100 + n) for n in range(9)]
    fresh = [record(n, full_name=["Ann Lee", None][n % 4 // 3], dob=f"19{50 + n % 12}-01-01") for n in range(40, 70)] + [firm(200 + n, **({"company_number": "1 2345"} if n > 8 else {})) for n in range(14)]
    fresh += [record(90, dob="1951-01-01", entity_type=None)]
    for sizes in ({}, {"cell_pairs": 4, "unfolded_rows": (3, 2)}):
        m = Matcher(**sizes)
        golden_ = m.with_block(records(spark, *known)).withColumn("golden_id", F.concat(F.lit("G"), "record_id"))
        expected = sorted((r.l_record_id, r.r_golden_id) for r in m.candidates(records(spark, *fresh), golden_).collect())
        assert sorted(map(tuple, m.candidate_keys(records(spark, *fresh), golden_).collect())) == expected and len(expected) > 200
    plan = m.candidate_keys(records(spark, *fresh), golden_)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "CartesianProduct" in plan
