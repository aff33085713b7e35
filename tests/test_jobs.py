"""Loops, sinks and streams: replays, late events, cycles, empty tables."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tallyweave.operators import decisions as D
from tallyweave.operators import linkage as L
from tallyweave.operators.lineage import scratch_dir, settled
from tallyweave.sources import readers, sinks
from tallyweave.streaming import jobs

FACTS = "sheet_uid string, owner string, q double"


def test_append_twice_adds_nothing(spark):
    path = scratch_dir(spark)
    facts = spark.createDataFrame([("a", "own", 1.0), ("a", "own", 2.0), ("b", "own", 3.0)], FACTS)
    assert {r["outcome"] for r in sinks.append_new(facts, path, "own").collect()} == {"stored"}
    assert {r["outcome"] for r in sinks.append_new(facts, path, "own").collect()} == {"already_there"}
    assert {r["outcome"] for r in sinks.append_new(facts, path, "other").collect()} == {"conflict"}
    assert sinks.archive_rows(spark, path, facts.schema).count() == 3


def test_numbers_are_not_given_twice(spark):
    new = spark.createDataFrame([(f"s{i}", i % 7, 5 if i % 2 else None) for i in range(60)], "sheet_uid string, created_on int, proposed long")
    found = sinks.assign_numbers(new, spark.createDataFrame([(9,), (40,)], "sheet_no long")).collect()
    numbers = sorted(r["sheet_no"] for r in found)
    assert len(set(numbers)) == 60 and numbers == [5, *range(41, 100)]


def test_fixed_point_stable_cycle_and_open(spark):
    rows = spark.createDataFrame([("still", 1, 0), ("grows", 1, 0), ("turns", 1, 0), ("ends", 1, 0)], "sheet_uid string, pos long, x long")
    x = F.col("x")
    move = F.when(F.col("sheet_uid") == "grows", x + 1).when(F.col("sheet_uid") == "turns", 1 - x).when(F.col("sheet_uid") == "ends", F.least(x + 1, F.lit(3))).otherwise(x)
    found = {r["sheet_uid"]: (r["x"], r["rounds"], r["outcome"]) for r in D.fixed_point(rows, lambda df: df.withColumn("x", move)).collect()}
    assert found["still"] == (0, 1, "stable") and found["ends"] == (3, 4, "stable") and found["grows"] == (8, 8, "open") and found["turns"][2] == "cycle"


EDITS = "id long, sheet_uid string, field_path string, old_value string, new_value string, source string"


def test_evidence_stream_takes_late_and_old_events(spark):
    """A lower id that comes later changes nothing; events below the floor never count."""
    folder, path = jobs.new_folder(spark), scratch_dir(spark)
    for batch in ([(9, "a", "rows[0].of", None, "nine", "human"), (2, "b", "rows[0].of", None, "old", "human")], [(8, "a", "rows[0].of", None, "eight", "human"), (12, "b", "rows[0].of", None, "new", "human"), (13, "b", "rows[0].of", None, "engine", "system")]):
        spark.createDataFrame(batch, EDITS).coalesce(1).write.mode("append").parquet(path)
    floors = spark.createDataFrame([("a", 0), ("b", 10)], "sheet_uid string, event_floor long")
    found = jobs.evidence(jobs.table_stream(spark, path), floors, folder).collect()
    assert {r["sheet_uid"]: r["new_value"] for r in found} == {"a": "nine", "b": "new"}


def test_archive_stream_replayed(spark):
    source = settled(spark.createDataFrame([(f"s{i}", "own", float(i)) for i in range(20)], FACTS).repartition(4, "sheet_uid"))
    folder = jobs.new_folder(spark)
    held, status = jobs.archive(jobs.table_stream(spark, source._scratch, 2), folder, "own")
    assert held.count() == 20 and {r["outcome"] for r in status.collect()} == {"stored"}
    jobs.run(jobs.table_stream(spark, source._scratch, 1), lambda b, n: sinks.append_new(b, f"{folder}/archive", "own"), jobs.new_folder(spark))
    assert sinks.archive_rows(spark, f"{folder}/archive", source.schema).count() == 20


def test_two_writers_at_once_store_each_sheet_once(spark):
    path = scratch_dir(spark)
    facts = spark.createDataFrame([(f"s{i}", "own", float(i)) for i in range(40) for _ in range(2)], FACTS)
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda _: {r["sheet_uid"]: r["outcome"] for r in sinks.append_new(facts, path, "own").collect()}, range(3)))
    assert sinks.archive_rows(spark, path, facts.schema).count() == 80
    assert all(sorted(f[f"s{i}"] for f in found) == ["already_there", "already_there", "stored"] for i in range(40))


def test_what_a_writer_left_behind_does_not_count(spark):
    path = scratch_dir(spark)
    facts = spark.createDataFrame([("a", "own", 1.0)], FACTS)
    facts.selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/data/stopped")  # no entry was made
    assert sinks.archive_rows(spark, path, facts.schema).count() == 0
    assert {r["outcome"] for r in sinks.append_new(facts, path, "own").collect()} == {"stored"} and sinks.archive_rows(spark, path, facts.schema).count() == 1
    assert sinks._claim(spark, path, 31, 0, "x") and not sinks._claim(spark, path, 31, 0, "y") and sinks._entries(spark, path, 31) == ["x"]
    none = facts.limit(0)
    assert sinks.append_new(none, path, "own").count() == 0


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_evidence_goes_on_after_a_restart(spark):
    """Three runs on one folder, the last one without news; then a floor that rises; then old parts folded."""
    folder, path = jobs.new_folder(spark), scratch_dir(spark)
    floors = spark.createDataFrame([("a", 0), ("b", 0)], "sheet_uid string, event_floor long")
    run = lambda f: {(r["sheet_uid"], r["field_path"]): (r["id"], r["new_value"]) for r in jobs.evidence(jobs.table_stream(spark, path), f, folder).collect()}
    arrive(spark, path, [(1, "a", "rows[0].of", None, "one", "human"), (5, "a", "rows[1].of", None, "five", "human"), (6, "a", "rows[1].of", None, "engine", "system")], EDITS)
    assert run(floors) == {("a", "rows[0].of"): (1, "one"), ("a", "rows[1].of"): (5, "five")}
    arrive(spark, path, [(2, "b", "rows[0].of", None, None, "human"), (4, "a", "rows[1].of", None, "late", "human"), (7, "a", "rows[0].of", "one", "seven", "human")], EDITS)
    after = {("a", "rows[0].of"): (7, "seven"), ("a", "rows[1].of"): (5, "five"), ("b", "rows[0].of"): (2, None)}
    assert run(floors) == after and run(floors) == after
    risen = spark.createDataFrame([("a", 6), ("b", 0)], "sheet_uid string, event_floor long")
    assert run(risen) == {k: v for k, v in after.items() if k != ("a", "rows[1].of")}
    jobs.compact(spark, f"{folder}/cells", jobs.CELLS, jobs.last_cells)
    assert run(floors) == after and jobs.parts(spark, f"{folder}/cells", jobs.CELLS).count() == 3


def test_ingest_goes_on_after_a_restart(spark):
    """Repeats in a batch, in a later run, under an earlier name, and of the ledger."""
    folder, path, schema = jobs.new_folder(spark), scratch_dir(spark), "name string, sha string"
    ledger = spark.createDataFrame([("old",)], "sha string")
    run = lambda: sorted((r["sha"], r["name"]) for r in jobs.ingest(jobs.table_stream(spark, path), ledger, folder).collect())
    arrive(spark, path, [("m", "x"), ("n", "x"), ("o", "old"), ("p", None), ("q", "y")], schema)
    assert run() == [("x", "m"), ("y", "q")]
    arrive(spark, path, [("z", "x"), ("r", "w"), ("s", "old")], schema)
    arrive(spark, path, [("b", "y"), ("r2", "w")], schema)
    assert run() == [("w", "r"), ("x", "m"), ("y", "b")] == run()
    jobs.compact(spark, f"{folder}/new", jobs.INGESTED, jobs.last_names)
    assert run() == [("w", "r"), ("x", "m"), ("y", "b")]


def test_archive_goes_on_after_a_restart(spark):
    folder, path = jobs.new_folder(spark), scratch_dir(spark)
    run = lambda: jobs.archive(jobs.table_stream(spark, path), folder, "own")
    arrive(spark, path, [("a", "own", 1.0), ("b", "own", 2.0)], FACTS)
    held, status = run()
    assert held.count() == 2 and status.count() == 2
    arrive(spark, path, [("b", "own", 2.0), ("c", "own", 3.0)], FACTS)
    for _ in range(2):
        held, status = run()
        assert sorted(r["sheet_uid"] for r in held.collect()) == ["a", "b", "c"]
        assert sorted((r["sheet_uid"], r["outcome"]) for r in status.collect()) == [("a", "stored"), ("b", "already_there"), ("b", "stored"), ("c", "stored")]


def test_match_goes_on_after_a_restart(spark):
    folder, path, schema = jobs.new_folder(spark), scratch_dir(spark), "sheet_uid string, pos long"
    run = lambda: sorted(map(tuple, jobs.match(jobs.table_stream(spark, path), lambda df: df.selectExpr("sheet_uid", "pos", "'k' AS plan_key"), f"{schema}, plan_key string", folder).collect()))
    arrive(spark, path, [("a", 1)], schema)
    assert run() == [("a", 1, "k")]
    arrive(spark, path, [("b", 1)], schema)
    assert run() == [("a", 1, "k"), ("b", 1, "k")] == run()


def test_salvage_of_a_cut_transcript(spark):
    texts = ['{"rows":[{"of":"1"},{"of":"2"}]}', '```json\n{"rows":[{"of":"1"},{"of":"2"}]}\n```', '<think>{"rows":[]}</think>{"rows":[{"of":"1"},{"of":"2"},{"of', "", "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = {r["i"]: r["n"] for r in df.select("i", F.size(F.from_json(readers.salvage_json(F.col("t")), readers.DOCUMENT)["rows"]).alias("n")).collect()}
    assert (rows[0], rows[1], rows[2], rows[3], rows[4]) == (2, 2, 2, 0, 0)


def test_files_of_other_sectors(spark):
    names = ["2024-05-01 a.pdf", "2024-05-01 Chapa a.pdf", "24-05-01 a.pdf", "2024-05-01 a.png", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in df.where(readers.is_source_file(F.col("name"), "chapa")).collect()] == names[:1]


def test_operator_by_number_name_and_neighbour(spark):
    staff = spark.createDataFrame([(2105, "FABIO ARAUJO"), (2480, "GURPINDER SINGH"), (77, "MARCO LOPES")], "cod long, full_name string")
    sheets = spark.createDataFrame([("exact", "fabio araujo", "21O5"), ("token", "Fabio", "2105"), ("number", "Flavio Lopes", "77"), ("near", "Gurbinder Singh", "2481"), ("letter", "Fabio Araujo", "21A5"), ("none", "Someone", None)], "sheet_uid string, operador string, n_operador string")
    found = {r["sheet_uid"]: (r["cod"], r["rule"]) for r in D.resolve_operator(sheets, staff).collect()}
    assert found == {"exact": (2105, "exact"), "token": (2105, "token"), "number": (77, "so_numero"), "near": (2480, "corrigido"), "letter": (None, "sem_numero"), "none": (None, "sem_numero")}


def test_whole_profile_example(spark):
    """Remaining 5, 2 and 0: a parent of 7, three refs, two exports; one unknown line makes the group unknown."""
    from tallyweave.operators import balances as B

    plan = [(f"1:{i}", "OF200001", "OV1", "L60X60X5", f"AT{i}", 1000.0, q, True, "r") for i, q in enumerate((5.0, 2.0, 0.0))]
    schema = "plan_key string, of_code string, ov string, perfil string, modelo string, comp_mm double, qtd_restante double, falta_valida boolean, regra_calculo string"
    rows = spark.createDataFrame([("s", 1, "200001", None, "60x5", None, "x", None)], "sheet_uid string, pos long, of_written string, ov_written string, perfil_written string, modelo_written string, perf_comp string, qtd_written string")
    carried = L.carry_down(rows)
    facts = B.materialize_facts(carried, spark.createDataFrame(plan, schema)).collect()
    assert sorted((r["kind"], r["quantity"]) for r in facts) == [("export", 2.0), ("export", 5.0), ("parent", 7.0), ("ref", 0.0), ("ref", 2.0), ("ref", 5.0)]
    unknown = [(*plan[0][:6], None, *plan[0][7:]), *plan[1:]]
    total = B.group_totals(B.whole_profile_lines(carried, spark.createDataFrame(unknown, schema))).first()
    assert (total["valid"], total["quantity"], total["metres"]) == (False, None, None)


def test_joins_of_candidates_are_no_nested_loops(spark):
    plan = spark.createDataFrame([("1:1", "OF200001", "OV1", "L60X60X5", "AT1")], "plan_key string, of_code string, ov string, perfil string, modelo string")
    rows = L.carry_down(spark.createDataFrame([("s", 1, "200001", None, None, "AT1", None, "1")], "sheet_uid string, pos long, of_written string, ov_written string, perfil_written string, modelo_written string, perf_comp string, qtd_written string"))
    for df in (L.exact_candidates(rows, plan, "of_eff", "of_code"), L.anchored_candidates(rows, plan)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
