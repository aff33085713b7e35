"""Folders of files, machines by alias and sector, and sheets that are linked until nothing changes."""

import hashlib
import io
import zipfile

from tallyweave.operators import decisions, sheets
from tallyweave.sources import files


def packed(*pages: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        for i, x in enumerate(pages):
            f.writestr(zipfile.ZipInfo(f"p{i:02}"), x)
    return out.getvalue()


def test_a_folder_with_broken_repeated_and_half_known_files(spark, tmp_path):
    bodies = {"2024-05-01 a.zip": packed(b"one", b"two", b"one"), "2024-05-01 b.zip": packed(b"two", b"three"), "2024-05-02 known.zip": packed(b"four"), "2024-05-03 broken.zip": b"no archive", "2024-05-03 none.zip": packed(), "2024-05-04 copy.zip": packed(b"two", b"three"), "notes.txt": b"x"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    done, pages = [(sha(bodies["2024-05-02 known.zip"]),)], [(sha(b"three"),)]
    run = lambda d, p: files.Ingest(spark, str(tmp_path), spark.createDataFrame(d, "file_sha string"), spark.createDataFrame(p, "page_sha string"), r"^2024.*\.zip$")
    found = run(done, pages)
    assert {(r["name"], r["page"], bytes(r["content"])) for r in found.sheets.collect()} == {("2024-05-01 a.zip", 0, b"one"), ("2024-05-01 a.zip", 1, b"two")}
    assert sorted(r["name"] for r in found.failures.collect()) == ["2024-05-03 broken.zip", "2024-05-03 none.zip"]
    assert found.counters().first().asDict() == {"seen": 5, "files": 2, "sheets": 2, "repeated": 3, "failed": 2}
    again = run(done + [(r["file_sha"],) for r in found.done.collect()], pages + [(r["page_sha"],) for r in found.sheets.collect()])
    assert again.counters().first().asDict() == {"seen": 5, "files": 0, "sheets": 0, "repeated": 0, "failed": 2}  # broken files are tried again


def test_machines_by_alias_sector_and_plan(spark):
    catalog = spark.createDataFrame([(x,) for x in ("Ficep Rapid 20T -2", "Ficep XP T4", "Peddi 8", "Serrote 1", "")], "display_name string")
    written = {"alias": "Rapid 20T - 2", "same": "ficep xp t4", "exact": "Peddi 8", "near": "Pedi 8", "other": "Serrote 1", "family": "FICEP", "blank": None, "odd": "--"}
    sheets_ = spark.createDataFrame(list(written.items()), "sheet_uid string, setor_maquina string")
    found = decisions.resolve_machine(sheets_, catalog, families=("FICEP",), aliases={"RAPID20T2": "Ficep Rapid 20T -2"}, not_in=("SERROTE",))
    got = {r["sheet_uid"]: (r["machine"], r["status"]) for r in found.collect()}
    assert got == {"alias": ("Ficep Rapid 20T -2", "corrected"), "same": ("Ficep XP T4", "corrected"), "exact": ("Peddi 8", "confirmed"), "near": (None, "review"), "other": (None, "ambiguous"), "family": (None, "ambiguous"), "blank": (None, "missing"), "odd": (None, "ambiguous")}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    planned = spark.createDataFrame([("exact", "Ficep XP T4"), ("same", "FICEP XP T4,Peddi 8"), ("odd", "Peddi 8"), ("alias", "")], "sheet_uid string, machines string")
    after = {r["sheet_uid"]: (r["status"], r["suggestions"]) for r in decisions.plan_conflicts(found, planned).collect()}
    assert after["exact"] == ("conflict", "Ficep XP T4") and after["same"][0] == "corrected" and after["odd"] == ("review", "Peddi 8") and after["alias"][0] == "corrected"


ROWS = "sheet_uid string, pos long, of_written string, ov_written string, perfil_written string, modelo_written string, perf_comp string, qtd_written string"
PLAN = "plan_key string, of_code string, ov string, perfil string, modelo string, comp_mm double"


def test_sheets_are_linked_until_nothing_changes(spark):
    """Misread cells take their line's values; a cell that a person wrote stays; linking the result again changes nothing."""
    plan = spark.createDataFrame([(f"{o}:{k}", f"OF20010{o}", f"OV000{o}{o}", f"L{60 + 10 * k}X{60 + 10 * k}X5", f"AT{o}T1{k}5{k}", 1000.0) for o in range(1, 4) for k in range(3)], PLAN)
    rows = spark.createDataFrame([("a", 1, "2OO1O1", None, "60x5", "AT1T1O5O", None, "1"), ("a", 2, None, None, None, "AT1TI151", None, "1"), ("b", 1, "200102", None, None, "KEEP", None, "2")], ROWS)
    human = spark.createDataFrame([("b", 1, "modelo")], "sheet_uid string, pos long, field string")
    found = {(r["sheet_uid"], r["pos"]): r for r in decisions.settle_sheets(rows, plan, human, 4).collect()}
    assert (found["a", 1]["of_written"], found["a", 1]["modelo_written"], found["a", 1]["perfil_written"]) == ("200101", "AT1T1050", "L60X60X5")
    assert (found["a", 2]["of_written"], found["a", 2]["modelo_written"]) == ("200101", "AT1T1151") and found["b", 1]["modelo_written"] == "KEEP"
    assert {r["outcome"] for r in found.values()} == {"stable"} and found["a", 1]["rounds"] == 2
    settled = spark.createDataFrame([tuple(r[f] for f in ("sheet_uid", "pos", "of_written", "ov_written", "perfil_written", "modelo_written", "perf_comp", "qtd_written")) for r in found.values()], ROWS)
    again = {(r["sheet_uid"], r["pos"]): r["plan_key"] for r in sheets.link_sheets(settled, plan).collect()}
    assert again == {("a", 1): "1:0", ("a", 2): "1:1", ("b", 1): again["b", 1]} and again["b", 1].startswith("2:")
