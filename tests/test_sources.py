import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F

from bedwise.operators import quality as V
from bedwise.plans import baseline as B
from bedwise.plans import learning as L
from bedwise.plans import actions as R
from bedwise.plans import scenarios as X
from bedwise.sources import files as S
from bedwise.sources import models as SM


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def csv(tmp_path):
    return write(tmp_path / "daily.csv", "date;total_admissions;note;temperature_c\n03/01/2023;120.0;x;1.5\n01/01/2023;100;é;\n99/01/2023;;z;2\n")


def test_load_data(spark, csv):
    df = S.load_data(spark, csv)
    assert dict(df.dtypes) == {"date": "date", "total_admissions": "int", "note": "string", "temperature_c": "double"}
    rows = S.in_date_order(df).collect()
    assert [r["date"] for r in rows] == [date(2023, 1, 1), date(2023, 1, 3), None]
    assert [r["total_admissions"] for r in rows] == [100, 120, None] and rows[0]["note"] == "é"
    assert S.load_data(spark, csv, parse_dates=False).first()["date"] == "03/01/2023"


def test_missing_files(spark, tmp_path, csv):
    gone = str(tmp_path / "gone.csv")
    with pytest.raises(S.DataNotFoundError):
        S.load_data(spark, gone)
    with pytest.raises(S.DataNotFoundError):
        S.get_data_path(spark, [gone])
    with pytest.raises(FileNotFoundError):
        S.load_training_data(spark, str(tmp_path))
    assert S.get_available_data_path(spark, [gone, csv]) == csv
    assert S.check_data_exists(spark, [csv]) and not S.check_data_exists(spark, [gone])
    assert S.load_reference(spark, gone) is None and S.load_reference(spark, csv).count() == 3
    assert S.load_training_data(spark, str(tmp_path / "none"), fallback=csv).count() == 3


def test_training_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "donnees_A.csv", "hospital_id;date;total_admissions\nA;01/01/2023;1\n")
    write(tmp_path / "donnees_B.csv", "date;total_admissions;hospital_id;available_beds\n02/01/2023;2;B;1400\n")
    write(tmp_path / "donnees_C.csv", "hospital_id;date;total_admissions\nC;03/01/2023;3\n")
    write(tmp_path / "other.csv", "hospital_id\nX\n")
    rows = S.in_date_order(S.load_training_data(spark, str(tmp_path))).collect()
    assert [(r["hospital_id"], r["total_admissions"], r["available_beds"]) for r in rows] == [("A", 1, None), ("B", 2, 1400), ("C", 3, None)]


def test_catalogue(spark, tmp_path):
    write(tmp_path / "donnees_hopital_reference_04_COCHIN.csv", "x\n")
    assert S.hospital_catalogue(spark).count() == 11
    assert [r["hospital_id"] for r in S.get_available_hospitals(spark, str(tmp_path)).collect()] == ["COCHIN"]


def test_writes_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("PITIE", date(2023, 1, 2), 5), ("HEGP", date(2023, 1, 3), 6)], "hospital_id string, date date, total_admissions int")
    S.write_sites(df, str(tmp_path / "sites"))
    back = spark.read.parquet(str(tmp_path / "sites")).select(*df.columns)
    assert sorted(back.collect()) == sorted(df.collect())
    S.write_sites(df, str(tmp_path / "csv"), as_csv=True)
    one = S.load_data(spark, str(tmp_path / "csv" / "hospital_id=HEGP"))
    assert [tuple(r) for r in one.collect()] == [(date(2023, 1, 3), 6)]
    S.write_single_site(df, str(tmp_path / "single"))
    single = S.load_data(spark, str(tmp_path / "single"))
    assert single.columns == ["date", "total_admissions"] and [tuple(r) for r in single.collect()] == [(date(2023, 1, 2), 5)]
    assert S.export_rows(df).orderBy("date").first()["date"] == "02/01/2023"
    assert S.export_rows(df, format_dates=False).orderBy("date").first()["date"] == date(2023, 1, 2)
    assert S.export_name("scenario", "Épidémie Sévère") == "scenario_epidemie_sevère.csv"


def test_baseline_round_trip(spark, tmp_path):
    rows = [(s, date(2023, 1, d), float(d)) for s in "AB" for d in range(1, 6)]
    df = spark.createDataFrame(rows, "hospital_id string, date date, total_admissions double")
    for by in ([], ["hospital_id"]):
        baseline = B.train_baseline(df, by=by)
        path = SM.save_baseline(baseline, str(tmp_path / f"b{len(by)}"), by)
        assert sorted(SM.load_baseline(spark, path, by).select(*baseline.columns).collect()) == sorted(baseline.collect())
    with pytest.raises(S.DataNotFoundError):
        SM.load_baseline(spark, str(tmp_path / "none"))


def test_a_saved_baseline_computes_the_fit_once_and_is_replaced_as_a_whole(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(s, date(2023, 1, 1 + d % 28), float(d)) for s in "AB" for d in range(50)]
    df = spark.createDataFrame(rows, "hospital_id string, date date, total_admissions double")
    path = str(tmp_path / "b")
    fit = B.train_baseline(df.mapInArrow(counted, df.schema), by=["hospital_id"])
    SM.save_baseline(fit, path, ["hospital_id"])
    assert read.value == 100
    only_b = B.train_baseline(df.where("hospital_id = 'B'"), by=["hospital_id"])
    SM.save_baseline(only_b, path, ["hospital_id"])
    assert SM.load_baseline(spark, path, ["hospital_id"]).select(*only_b.columns).collect() == only_b.collect()


def test_model_round_trip(spark, tmp_path):
    df = spark.range(60).select(F.col("id").cast("int").alias("dow"), F.lit("it's").alias("season"), (F.col("id") * 2).alias("total_admissions"))
    model = L.train_model(df, ["dow", "season"], trees=3, depth=4)
    path = SM.save_model(model, str(tmp_path / "m"), L.evaluate_model(model, df))
    again = SM.load_model(spark, path)
    assert sorted(L.predict(again, df).collect()) == sorted(L.predict(model, df).collect())
    assert SM.load_metrics(spark, path).first()["rows"] == 60
    with pytest.raises(S.DataNotFoundError):
        SM.load_model(spark, str(tmp_path / "none"))


def test_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 1, 1), -5)], "date date, total_admissions int")
    path = str(tmp_path / "v")
    for report in (V.validate_dataset(df, df), V.validate_dataset(df)):
        SM.save_validation_report(report, path)
        back = SM.load_validation_report(spark, path)
        for name in SM.REPORT_COLUMNS:
            saved, loaded = getattr(report, name), getattr(back, name)
            assert (saved is None) == (loaded is None)
            if saved is not None:
                assert sorted(map(str, saved.select(loaded.columns).collect())) == sorted(map(str, loaded.collect()))
    with pytest.raises(S.DataNotFoundError):
        SM.load_validation_report(spark, str(tmp_path / "none"))
    recs = R.generate_recommendations(df)
    lines = R.action_report(recs, "x", X.ScenarioParams().to_dict(), date(2020, 1, 1), 7, "now")
    SM.write_action_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == lines.count()


@pytest.mark.parametrize("as_csv", [False, True])
def test_written_sites_are_read_back(spark, tmp_path, as_csv):
    df = spark.createDataFrame([(date(2024, 1, 1), 5, "HA 1"), (date(2024, 1, 2), 6, "HB"), (date(2024, 1, 3), 7, "HB")], "date date, total_admissions int, hospital_id string")
    S.write_sites(df, str(tmp_path / "sites"), as_csv=as_csv)
    back = S.load_training_data(spark, str(tmp_path / "sites"))
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_report_of_two_sites_keeps_entries_together(spark, tmp_path):
    rows = [(date(2024, 1, 1), s, a, "CRITIQUE", f"d{s}{a}", o) for s in ("A", "B") for o, a in enumerate(("x", "y"))]
    recs = spark.createDataFrame(rows, "date date, hospital_id string, action string, priority string, description string, ord int")
    SM.write_action_report(R.action_report(recs, "x", X.ScenarioParams().to_dict(), date(2024, 1, 1), 7, "now"), str(tmp_path / "r"))
    text = [r[0] for f in sorted((tmp_path / "r").glob("part-*.txt")) for r in spark.read.text(str(f)).collect()]
    entries = [t for t in text if t.startswith("[") or t.startswith("  →")]
    assert entries == [t for s in ("A", "B") for a in ("x", "y") for t in (f"[01/01/2024] {s} : {a}", f"  → d{s}{a}")]


def test_a_part_file_with_another_column_order_is_not_misread(spark, tmp_path):
    folder = tmp_path / "donnees.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("date;total_admissions;available_beds\n01/01/2024;5;900\n")
    (folder / "part-1.csv").write_text("date;available_beds;total_admissions\n02/01/2024;901;6\n")
    (folder / "part-2.csv").write_text("")
    (folder / "_SUCCESS").write_text("")
    rows = S.in_date_order(S.load_data(spark, str(folder))).collect()
    assert [(r["total_admissions"], r["available_beds"]) for r in rows] == [(5, 900), (6, 901)]


def test_many_files_take_few_jobs(spark, tmp_path):
    for i in range(200):
        columns, values = ("date;total_admissions;hospital_id", f"01/01/2024;{i};H{i}") if i != 77 else ("hospital_id;date;total_admissions", f"H{i};01/01/2024;{i}")
        (tmp_path / f"donnees_{i:03}.csv").write_text(f"{columns}\n{values}\n")
    context = spark.sparkContext
    context.setJobGroup("many files", "")
    try:
        rows = S.load_training_data(spark, str(tmp_path)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["hospital_id"], r["total_admissions"]) for r in rows) == sorted((f"H{i}", i) for i in range(200))
    assert len(context.statusTracker().getJobIdsForGroup("many files")) <= 3


def test_compressed_quoted_and_unnamed_headers(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt", encoding="utf-8") as f:
        f.write('"date";"total_admissions";"é; x"\n01/01/2024;5;y\n')
    row = S.load_data(spark, str(tmp_path / "a.csv.gz")).first()
    assert (row["date"], row["total_admissions"], row["é; x"]) == (date(2024, 1, 1), 5, "y")
    (tmp_path / "b.csv").write_text("")
    assert S.load_data(spark, str(tmp_path / "b.csv")).columns == []
