import json
from datetime import date, datetime

import pytest

from footfall.sources import landed_json, tabular


def test_pages_pretty_printed_and_by_line(spark, tmp_path):
    pages = [{"site_id": 1, "results": [
        {"timestamp": "2025-05-01T10:00:00+02:00", "count_enter": 5, "count_exit": None, "more": 1},
        {"timestamp": "2025-05-01T09:00:00+00:00", "count_enter": 7, "count_exit": 2}]},
        {"site_id": 1, "results": []}]
    (tmp_path / "pretty").mkdir()
    for i, page in enumerate(pages):
        (tmp_path / "pretty" / f"p{i}.json").write_text(json.dumps(page, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(p) for p in pages))
    for path, pretty in ((tmp_path / "pretty", True), (tmp_path / "lines.json", False)):
        rows = landed_json.read_count_pages(spark, str(path), keys={"site_id": "BIGINT"},
                                            pretty_printed=pretty).orderBy("ts").collect()
        assert [tuple(r) for r in rows] == [(1, datetime(2025, 5, 1, 8), 5, None),
                                            (1, datetime(2025, 5, 1, 9), 7, 2)]


def test_more_than_ten_thousand_records_are_kept(spark, tmp_path):
    line = json.dumps({"results": [{"timestamp": "2025-05-01T10:00:00+02:00", "count_enter": 1,
                                    "count_exit": 1}] * 100})
    (tmp_path / "pages.json").write_text("\n".join([line] * 150))
    assert landed_json.read_count_pages(spark, str(tmp_path / "pages.json")).count() == 15000


def test_broken_payload_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"results": [{"timestamp": ')
    with pytest.raises(Exception):
        landed_json.read_count_pages(spark, str(tmp_path / "bad.json")).collect()


def test_weather_arrays(spark, tmp_path):
    payload = {"latitude": 1.0, "hourly": {
        "time": ["2025-10-26T01:00", "2025-10-26T03:00", "2025-07-01T00:00"],
        "temperature_2m": [1.5, None, 20.0], "precipitation": [0.0, 0.1, 0.2],
        "weather_code": [0, 3, None], "wind_speed_10m": [1.0, 2.0, 3.0],
        "cloud_cover": [10, 20, 30]}}
    (tmp_path / "w.json").write_text(json.dumps(payload))
    rows = landed_json.read_weather_arrays(spark, str(tmp_path / "w.json")).collect()
    assert [r.ts for r in rows] == [datetime(2025, 10, 25, 23), datetime(2025, 10, 26, 2),
                                    datetime(2025, 6, 30, 22)]
    assert rows[1].temperature_c is None and rows[2].weather_code is None
    assert rows[0].cloud_cover_pct == 10


def test_days_ahead_covers_a_long_local_day(spark):
    hours = spark.sql("""SELECT explode(sequence(TIMESTAMP '2025-10-25 00:00:00',
        TIMESTAMP '2025-10-28 00:00:00', INTERVAL 1 HOUR)) AS ts""")
    assert landed_json.days_ahead(hours, "2025-10-26 15:00:00", 0).count() == 25
    assert landed_json.days_ahead(hours, "2025-10-26", 1).count() == 49


def test_forecast_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "Datum,FORECAST,Low,high\n2026-01-02,10.4,8,12\n2026-01-03,-1,,x\n2026-01-04,bad,1,2\n")
    rows = tabular.read_forecast_csv(spark, str(tmp_path / "f.csv")).orderBy("date_local").collect()
    assert [tuple(r) for r in rows] == [(date(2026, 1, 2), 10.4, 8.0, 12.0),
                                        (date(2026, 1, 3), 0.0, None, None)]


def test_query_errors_reach_the_caller(spark):
    df = spark.range(10)
    got = tabular.query(spark, "SELECT count(*) AS n FROM {t} WHERE id >= :low", {"low": 4}, t=df)
    assert got.first().n == 6
    with pytest.raises(Exception):
        tabular.query(spark, "SELECT nothing FROM {t}", t=df).collect()


def test_forecast_files_of_several_layouts(spark, tmp_path):
    from footfall.sources.tabular import read_forecast_csv

    files = {"a": "datum,forecast\n2026-01-01,10\n", "b": "Forecast,Datum,high,low\n20,2026-01-02,25,15\n",
             "c": 'datum,note,"forecast",low,high\n2026-01-03,"x, y",30,n/a,35\n2026-01-04,,-4,1,2\n'}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r.date_local.day: (r.forecast, r.low, r.high)
           for r in read_forecast_csv(spark, str(tmp_path)).collect()}
    assert got[1][0] == 10 and got[2] == (20, 15, 25)
    assert got[3][0] == 30 and got[3][2] == 35 and set(got) == {1, 2, 3, 4}
    (tmp_path / "d.csv").write_text("no,header\n1,2\n")
    with pytest.raises(Exception, match="no forecast header"):
        read_forecast_csv(spark, str(tmp_path)).collect()
