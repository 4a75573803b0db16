"""CSV intake: broken lines are set aside with file and reason, the rest is typed."""
from datetime import date

import pytest

from callwise.plans import kpi
from callwise.sources.intake import intake
from callwise.sources.roles import materialize

HEAD = "visit_id,rep_id,doctor_id,visit_date,month,quarter,product,duration_min,samples_left"
TABLES = {"territories.csv": "territory_id,territory_name,state,region,market_potential\nT01,Zone A,A,West,1000000\n",
          "reps.csv": "rep_id,rep_name,territory_id,experience_yrs,target_calls\nR1,Ann,T01,3,10\n",
          "doctors.csv": "doctor_id,doctor_name,specialty,territory_id,prescribing_potential,potential_score,years_in_practice\nD1,Dr. A,Cardiologist,T01,High,90,10\n",
          "prescriptions.csv": "prescription_id,doctor_id,territory_id,product,month,quarter,units_prescribed,revenue,visit_count\nP1,D1,T01,CardioMax,1,1,10,8500,1\n"}


@pytest.fixture
def folder(tmp_path):
    for name, text in TABLES.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def outcome(spark, folder):
    got = intake(spark, str(folder))
    bad = sorted((r.reason, r.record, r.file.rsplit("/", 1)[1]) for r in got.quarantine.where("table_name = 'visits'").collect())
    return got, sorted(tuple(r) for r in got.tables["visits"].collect()), bad


def test_bad_lines_of_one_file(spark, folder):
    (folder / "visits.csv").write_text("\n".join([
        HEAD, "V1,R1,D1,2024-01-05,1,1,CardioMax,12,3", "V2,R1,D1,2024-02-31,2,1,CardioMax,12,3", "V3,R1,D1,2024-01-07,1,1,CardioMax,12",
        "V4,R1,D1,2024-01-07,1,1,CardioMax,12,3,9", "V5,R1,D1,2024-01-08,one,1,CardioMax,12,3", ",R1,D1,2024-01-08,1,1,CardioMax,12,3",
        'V6,R1,D1,2024-01-09,1,1,"Cardio, Max",12.0,', "V7,R1,D1,2024-01-09,1,1,CardioMax,99999999999,1"]) + "\n")
    got, rows, bad = outcome(spark, folder)
    assert rows == [("V1", "R1", "D1", date(2024, 1, 5), 1, 1, "CardioMax", 12, 3), ("V6", "R1", "D1", date(2024, 1, 9), 1, 1, "Cardio, Max", 12, None)]
    assert [(why, line) for why, line, _ in bad] == [
        ("bad duration_min", "V7,R1,D1,2024-01-09,1,1,CardioMax,99999999999,1"), ("bad month", "V5,R1,D1,2024-01-08,one,1,CardioMax,12,3"),
        ("bad visit_date", "V2,R1,D1,2024-02-31,2,1,CardioMax,12,3"), ("no visit_id", ",R1,D1,2024-01-08,1,1,CardioMax,12,3"),
        ("wrong number of fields", "V3,R1,D1,2024-01-07,1,1,CardioMax,12"), ("wrong number of fields", "V4,R1,D1,2024-01-07,1,1,CardioMax,12,3,9")]
    assert {f for _, _, f in bad} == {"visits.csv"}
    assert got.quarantine.where("table_name <> 'visits'").count() == 0
    assert kpi.rep_scorecard(materialize(spark, got.roles())).first().actual_calls == 2


def test_files_with_headers_of_their_own(spark, folder):
    (folder / "visits.csv").mkdir()
    columns = HEAD.split(",")
    for name, order, lines in (("a.csv", columns, ["V1,R1,D1,2024-01-05,1,1,CardioMax,12,3"]),
                               ("b.csv", columns[::-1], ["4,13,DiabeCure,1,2,2024-02-05,D1,R1,V2", "4,13,DiabeCure,1,2,2024-02-05,D1,R1"]),
                               ("c.csv", [*columns, "note"], ["V3,R1,D1,2024-03-05,3,1,NeuroCalm,14,5,x"]),
                               ("d.csv", columns[:-1], ["V4,R1,D1,2024-03-05,3,1,NeuroCalm,14"]),
                               ("e.csv", ["id", "rep"], ["V5,R1"]), ("f.csv", columns, [])):
        (folder / "visits.csv" / name).write_text("\n".join([",".join(order), *lines]) + "\n")
    _, rows, bad = outcome(spark, folder)
    assert [(r[0], r[3], r[6], r[7], r[8]) for r in rows] == [("V1", date(2024, 1, 5), "CardioMax", 12, 3), ("V2", date(2024, 2, 5), "DiabeCure", 13, 4),
                                                               ("V3", date(2024, 3, 5), "NeuroCalm", 14, 5)]
    assert ("wrong number of fields", "4,13,DiabeCure,1,2,2024-02-05,D1,R1", "b.csv") in bad
    assert ("no column samples_left", "V4,R1,D1,2024-03-05,3,1,NeuroCalm,14", "d.csv") in bad
    assert {f for why, _, f in bad if why.startswith("no column visit_id")} == {"e.csv"}


def test_a_header_alone_and_no_files(spark, folder):
    (folder / "visits.csv").write_text(HEAD + "\n")
    got, rows, bad = outcome(spark, folder)
    assert rows == bad == [] and dict(got.tables["visits"].dtypes)["visit_date"] == "date"
    (folder / "visits.csv").unlink()
    with pytest.raises(Exception, match="visits"):
        intake(spark, str(folder))
