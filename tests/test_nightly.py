import json
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators.audit import stored_audit
from footfall.operators.features import daily_history
from footfall.plans import nightly
from footfall.plans.nightly import NightlyConfig, run, stored

START = datetime(2025, 4, 24, tzinfo=timezone.utc)
AS_OF = datetime(2025, 5, 22, 3, 0)


def _land(folder, days, enter=lambda site, day, hour: 10 * site + hour):
    counts, weather = folder / "counts", folder / "weather"
    counts.mkdir(exist_ok=True)
    weather.mkdir(exist_ok=True)
    lines = []
    for site in (1, 2):
        for d in range(days):
            lines.append(json.dumps({"site_id": site, "results": [
                {"timestamp": (START + timedelta(days=d, hours=h)).isoformat(),
                 "count_enter": enter(site, d, h), "count_exit": 1} for h in range(6, 20)]}))
    (counts / f"p{days}.json").write_text("\n".join(lines))
    times = [(START + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(24 * days)]
    n = len(times)
    (weather / f"w{days}.json").write_text(json.dumps({"hourly": {
        "time": times, "temperature_2m": [10.0] * n, "precipitation": [0.0] * n,
        "weather_code": [3] * n, "wind_speed_10m": [5.0] * n, "cloud_cover": [50] * n}}))
    return NightlyConfig(str(counts), str(weather), str(folder / "tables"), "2025-04-24")


def test_run_and_run_again(spark, tmp_path):
    cfg = _land(tmp_path, 28)
    run(spark, cfg, AS_OF)
    features = stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
    assert features.count() == 2 * 28 * 14
    holiday = features.filter("is_public_holiday").select("date_local").distinct().collect()
    assert [str(r[0]) for r in holiday] == ["2025-05-01"]
    assert features.filter("temperature_c IS NULL").count() == 0
    predictions = stored(spark, cfg, "predictions", schemas.PREDICTIONS)
    assert predictions.count() == 60
    day_sum = sum(range(6, 20)) + 14 * 10
    assert {r.predicted_visitors for r in predictions.filter("site_id = 1").collect()} == {day_sum}
    staffing = stored(spark, cfg, "staffing_recommendations", schemas.STAFFING_RECOMMENDATIONS)
    assert staffing.count() == 180

    before = {t: sorted(map(tuple, df.collect()), key=repr) for t, df in (
        ("f", features), ("p", predictions), ("s", staffing))}
    run(spark, cfg, AS_OF)
    again = {"f": stored(spark, cfg, "feature_store", schemas.FEATURE_STORE),
             "p": stored(spark, cfg, "predictions", schemas.PREDICTIONS),
             "s": stored(spark, cfg, "staffing_recommendations", schemas.STAFFING_RECOMMENDATIONS)}
    assert {t: sorted(map(tuple, df.collect()), key=repr) for t, df in again.items()} == before
    log = spark.read.parquet(cfg.path("run_log"))
    assert log.count() == 14 and log.select("run_id").distinct().count() == 2
    rows = {r.step: r.rows for r in log.filter("step LIKE 'load%'").groupBy("step").agg(
        F.min("rows").alias("rows")).collect()}
    assert rows == {"load visits": 0, "load weather": 0, "load calendar": 0}


def test_corrections_and_new_days(spark, tmp_path):
    run(spark, _land(tmp_path, 27), AS_OF - timedelta(days=1))
    # the landed files now also hold changed old counts and one new day
    cfg = _land(tmp_path, 28, enter=lambda s, d, h: 999)
    run(spark, cfg, AS_OF)
    features = stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
    changed = features.filter("visitor_count = 999").select("date_local").distinct().collect()
    # first writer wins: only the new day has the new counts
    assert [str(r[0]) for r in changed] == ["2025-05-21"]
    created = {r[0]: r[1] for r in features.groupBy("created_at").count().collect()}
    assert sorted(created.values()) == [28, 27 * 28]


def test_rebuild_from_a_day_on(spark, tmp_path):
    run(spark, _land(tmp_path, 27), AS_OF - timedelta(days=1))
    cfg = replace(_land(tmp_path, 28), since="2025-05-20")
    run(spark, cfg, AS_OF)
    days = stored(spark, cfg, "daily_history", schemas.DAILY_HISTORY)
    full = daily_history(stored(spark, cfg, "feature_store", schemas.FEATURE_STORE))
    columns = ["site_id", "date_local", "visitors", "weekday", "is_public_holiday"]
    got = sorted(map(tuple, days.select(columns).collect()))
    assert len(got) == 56 and got == sorted(map(tuple, full.select(columns).collect()))


def _features(spark, cfg):
    columns = [c for c in schemas.FEATURE_STORE.names if c != "created_at"]
    return sorted(map(tuple, stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
                      .select(columns).collect()), key=repr)


def test_incremental_run_opens_no_file_twice(spark, tmp_path):
    cfg = replace(_land(tmp_path, 26), incremental=True)
    run(spark, cfg, AS_OF - timedelta(days=2))
    old = {f: f.stat().st_mtime_ns for f in (tmp_path / "tables" / "feature_store").rglob("*.parquet")}
    landed = [*(tmp_path / "counts").iterdir(), *(tmp_path / "weather").iterdir()]
    for file in landed:
        file.write_text('{"results": [{')  # an error for whoever opens it again
    # all days again with other counts, and two new days
    _land(tmp_path, 28, enter=lambda s, d, h: 999)
    run(spark, cfg, AS_OF)
    features = stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
    changed = features.filter("visitor_count = 999").select("date_local").distinct().collect()
    assert sorted(str(r[0]) for r in changed) == ["2025-05-20", "2025-05-21"]
    new = {f: f.stat().st_mtime_ns for f in (tmp_path / "tables" / "feature_store").rglob("*.parquet")}
    assert {f.parent.name for f, _ in set(old.items()) ^ set(new.items())} == {
        # the weather up to midnight UTC reaches into the next local day
        "date_local=2025-05-20", "date_local=2025-05-21"}
    assert stored(spark, cfg, "predictions", schemas.PREDICTIONS).count() > 0
    run(spark, cfg, AS_OF)
    log = spark.read.parquet(cfg.path("run_log"))
    steps = {r.step: r.n for r in log.groupBy("step").agg(F.min("rows").alias("n")).collect()}
    assert [steps[s] for s in ("load visits", "load weather", "build features", "sum days")] == [0] * 4


def test_late_old_days_and_a_run_that_failed(spark, tmp_path, monkeypatch):
    """Old days come late; a run that stops before it rebuilds leaves them to the next."""
    whole = tmp_path / "whole"
    whole.mkdir()
    want = _land(whole, 10)
    run(spark, want, datetime(2025, 5, 4, 3))

    part = tmp_path / "part"
    part.mkdir()
    cfg = replace(_land(part, 10), incremental=True)
    lines = (part / "counts" / "p10.json").read_text().splitlines()
    (part / "counts" / "p10.json").write_text("\n".join(lines[4:]))
    nightly.load_and_rebuild(spark, cfg, datetime(2025, 5, 4, 3))
    assert len(_features(spark, cfg)) == 14 * 16
    (part / "counts" / "late.json").write_text("\n".join(lines[:6]))
    with monkeypatch.context() as broken:
        broken.setattr(nightly, "feature_store", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception):
            nightly.load_and_rebuild(spark, cfg, datetime(2025, 5, 5, 3))
    assert len(_features(spark, cfg)) == 14 * 16
    nightly.load_and_rebuild(spark, cfg, datetime(2025, 5, 5, 3))
    assert _features(spark, cfg) == _features(spark, want)


@pytest.mark.parametrize("incremental", [False, True])
def test_weather_and_calendar_of_each_site(spark, tmp_path, incremental):
    """Two sites in regions with different breaks and weather; counts below zero are noted."""
    cfg = _land(tmp_path, 8, enter=lambda s, d, h: -1 if (s, d, h) == (1, 0, 6) else h)
    for file in (tmp_path / "weather").iterdir():
        payload = json.loads(file.read_text())
        lines = []
        for site in (1, 2):
            hourly = dict(payload["hourly"], temperature_2m=[10.0 * site] * len(payload["hourly"]["time"]))
            lines.append(json.dumps({"site_id": site, "hourly": hourly}))
        file.write_text("\n".join(lines))
    cfg = replace(cfg, weather_by_site=True, incremental=incremental,
                  site_regions=[(1, "north"), (2, "south")],
                  region_breaks=[("north", "2025-04-24", "2025-04-25"), ("north", "2025-04-25", "2025-04-26"),
                                 ("south", "2025-04-28", "2025-04-28")])
    run(spark, cfg, datetime(2025, 5, 2, 3))
    features = stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
    assert features.count() == 2 * 8 * 14
    assert {tuple(r) for r in features.select("site_id", "temperature_c").distinct().collect()} == {
        (1, 10.0), (2, 20.0)}
    breaks = features.filter("is_school_holiday").select("site_id", "date_local").distinct().collect()
    assert {(r.site_id, str(r.date_local)) for r in breaks} == {
        (1, "2025-04-24"), (1, "2025-04-25"), (1, "2025-04-26"), (2, "2025-04-28")}
    log = {r.step: r.rows for r in spark.read.parquet(cfg.path("run_log")).collect()}
    assert log["visits_hourly: negative count_enter"] == 1
    assert log["feature_store: negative visitor_count"] == 1


def test_audit_of_stored_tables(spark, tmp_path):
    cfg = _land(tmp_path, 2)
    run(spark, cfg, datetime(2025, 4, 26, 3))
    rows = {r.table_name: r for r in stored_audit(spark, {
        "features": (cfg.path("feature_store"), schemas.FEATURE_STORE, "ts", ["site_id", "ts"]),
        "missing": (cfg.path("nothing"), schemas.FEATURE_STORE, "ts", ["site_id"])}).collect()}
    assert rows["features"].n_rows == 56 and rows["features"].error is None
    assert rows["features"].min_ts == datetime(2025, 4, 24, 6) and rows["features"].null_keys == 0
    assert rows["missing"].error == "PATH_NOT_FOUND" and rows["missing"].n_rows is None


def test_no_history_is_an_error(spark, tmp_path):
    cfg = _land(tmp_path, 0)
    with pytest.raises(ValueError, match="no history"):
        run(spark, cfg, AS_OF)
