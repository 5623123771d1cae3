"""Faults found by probes: file headers, fresh sources, shared folders, odd values."""

import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from punctual.functions.features import time_to_minutes
from punctual.operators import aggregates as A
from punctual.operators.prep import MissingColumnsError, label_trips
from punctual.session import ensure_checkpoint_dir
from punctual.sources import files, fixture


def test_csv_columns_by_name(spark, tmp_path):
    names = [f.name for f in files.TRIP_SCHEMA.fields][::-1]
    path = tmp_path / "trips.csv"
    header = ["arrival_status", "unused", *names]
    values = {"weather": "Clear", "route": "R1", "trip_no": "7", "delay_minutes": "2.5", "date": "2024-05-01"}
    path.write_text(",".join(header) + "\n" + ",".join(["Late", "x", *[values.get(n, "NA") for n in names]]) + "\n")
    row = files.read_csv(spark, str(path)).first()
    assert (row.weather, row.route, row.trip_no, row.delay_minutes, str(row.date)) == ("Clear", "R1", 7, 2.5, "2024-05-01")
    assert row.arrival_status == "Late" and row.destination is None and "unused" not in row
    assert label_trips(files.read_csv(spark, str(path)).drop("delay_minutes")).first()["label"] == 1
    path.write_text("weather,route\nClear,R1\n")
    with pytest.raises(MissingColumnsError):
        files.read_csv(spark, str(path))


def test_fingerprint_sees_a_partition_change(spark, sf, tmp_path):
    for t in fixture.SOURCE_TABLES:
        folder = tmp_path / f"{t}.parquet" / "p=1"
        folder.mkdir(parents=True)
        shutil.copy(f"{sf}/{t}.parquet", folder / "a.parquet")
    before = fixture.source_fingerprint(spark, str(tmp_path))
    assert before == fixture.source_fingerprint(spark, str(tmp_path))
    shutil.copy(f"{sf}/lineitem.parquet", tmp_path / "lineitem.parquet" / "p=1" / "b.parquet")
    assert fixture.source_fingerprint(spark, str(tmp_path)) != before


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_shared_folder_is_required_off_a_local_master(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)


def test_odd_times_and_delays(spark):
    t = spark.createDataFrame([("99999999:00",), ("10:05",), ("x:1",)], "departure_time string")
    assert [r[0] for r in t.select(time_to_minutes()).collect()] == [None, 605, None]
    d = spark.createDataFrame([("a", 1, float("nan")), ("a", 0, 3.0), ("a", 0, None)], "route string, label int, delay_minutes double")
    assert [(r.bin, r.n_trips) for r in A.delay_histogram(d).collect()] == [(0, 1)]
    assert A.route_performance(d).first().mean_delay == 3.0
    assert d.filter(F.isnan("delay_minutes")).count() == 1
