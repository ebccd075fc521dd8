"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import adapters as A
from paceline.adapters import sql
from paceline.functions import scalar
from paceline.operators import artifacts, encode, features, filters, impute, joins, ml, profile, session_profiles, standings, validate
from paceline.plans import pipelines
from paceline.session import SESSION
from paceline.sources import commits, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K4 = [*SESSION, "Driver"]
LAP = ["event_id"]
S4 = "Season, RoundNumber, SessionType, Driver"
S3 = "Season, RoundNumber, SessionType"


TIE = 1e-9  # added before rounding, so that halves fall the same way whatever the order of a sum


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle.replace(", 6)", f" + {TIE}, 6)")
        return f

    return add


def r6(*columns: str):
    return [F.round(F.col(c) + TIE, 6).alias(c) for c in columns]


def q6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def preds(s, d) -> DataFrame:
    """A naive predictor: the rolling mean of five laps, and a band of 5 s around it."""
    own = features.rolling_pace(A.laps(s, d).where("Stint is not null"))
    return own.select(*SESSION, "EventName", "Driver", "Team", "LapNumber", "LapTime_s", F.col("roll_laptime_5").alias("pred_s"), (F.col("roll_laptime_5") - 5).alias("pred_p05"), (F.col("roll_laptime_5") + 5).alias("pred_p95"))


def bounded(s, d) -> DataFrame:
    return standings.bounded_standings(preds(s, d), "pred_p05", "pred_s", "pred_p95")


def res(s, d) -> DataFrame:
    return standings.residuals(bounded(s, d), A.laps(s, d))


def ordered(s, d) -> DataFrame:
    return features.predicted_order(bounded(s, d), "median_predicted_s")


# --- sources and sinks

def _store(s) -> str:
    from uuid import uuid4

    base = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tables-{uuid4().hex}"


@query(sql("laps", f"select {S3}, count(*) as n, {q6('sum(LapTime_s)').replace('as sum(LapTime_s)', 'as total_s')} from laps group by all"))
def a1_write_read_table(s, d):
    base = _store(s)
    tables.write_table(A.laps(s, d).drop("Time"), base, "laps")
    back = tables.read_table(s, base, "laps", columns=[*SESSION, "LapTime_s"])
    return back.groupBy(*SESSION).agg(F.count("*").alias("n"), F.round(F.sum("LapTime_s") + TIE, 6).alias("total_s"))


@query(sql("laps", f"select {S3}, count(*) as n from laps group by all"))
def a2_idempotent_write(s, d):
    base, rows = _store(s), A.laps(s, d).select(*SESSION, "event_id")
    tables.write_table(rows.where("RoundNumber <= 10"), base, "laps")
    tables.write_table(rows, base, "laps")
    tables.write_table(rows.where("RoundNumber = 3"), base, "laps", overwrite=True)
    return tables.read_table(s, base, "laps").groupBy(*SESSION).agg(F.count("*").alias("n"))


@query(sql("laps", f"select {S3}, count(*) as n, cast(case when RoundNumber <= 10 then 1 else 2 end as bigint) as writers from laps group by all"))
def a2_session_commits(s, d):
    """Two writers stage at once; the first to commit adds its sessions, the other those that are left; one more replaces some."""
    base, rows = _store(s), A.laps(s, d).select(*SESSION, "event_id")
    one = commits.stage(rows.withColumn("writer", F.lit(2)), base, "laps")
    two = commits.stage(rows.where("RoundNumber <= 10").withColumn("writer", F.lit(1)), base, "laps")
    commits.commit(s, base, "laps", two)
    commits.commit(s, base, "laps", one)
    commits.write_sessions(rows.where("RoundNumber = 3").withColumn("writer", F.lit(1)), base, "laps", overwrite=True)
    return commits.read_sessions(s, base, "laps").groupBy(*SESSION).agg(F.count("*").alias("n"), F.max("writer").cast("long").alias("writers"))


@query(sql("laps", f"select {S3}, count(*) as n, true as refused from laps group by all"))
def a3_refuse_empty_write(s, d):
    base, rows, refused = _store(s), A.laps(s, d).select(*SESSION, "event_id"), False
    tables.write_table(rows, base, "laps")
    try:
        tables.write_table(rows.where("event_id is null"), base, "laps", overwrite=True)
    except ValueError:
        refused = True
    return tables.read_table(s, base, "laps").groupBy(*SESSION).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query(sql("laps", "select Season, RoundNumber, event_id from laps where RoundNumber = 5"))
def a4_pruned_read(s, d):
    base = _store(s)
    tables.write_table(A.laps(s, d).select(*SESSION, "event_id", "LapTime_s"), base, "laps")
    return tables.read_table(s, base, "laps", columns=["Season", "RoundNumber", "event_id"], RoundNumber=5)


@query(sql("laps", "select Season, count(*) as n, count(case when RoundNumber > 15 then TyreLife end) as with_life from laps group by all"))
def a5_load_features(s, d):
    base, rows = _store(s), A.laps(s, d).select("Season", "RoundNumber", "LapTime_s", "TyreLife")
    rows.where("RoundNumber <= 15").drop("TyreLife").write.parquet(f"{base}/gold/part=a")
    rows.where("RoundNumber > 15").write.parquet(f"{base}/gold/part=b")
    return tables.load_features(s, base).groupBy("Season").agg(F.count("*").alias("n"), F.count("TyreLife").alias("with_life"))


@query(sql("laps", "select Season, count(*) as n, count(case when RoundNumber > 10 then TyreLife end) as with_life, count(case when RoundNumber > 15 then LapTime_s end) as with_time from laps where RoundNumber > 5 group by all"))
def a5_registered_schemas(s, d):
    """Sessions of three schemas; columns and folders come from the commit log."""
    base, rows = _store(s), A.laps(s, d).select(*SESSION, "event_id", "TyreLife", "LapTime_s")
    commits.write_sessions(rows.where("RoundNumber <= 10").select(*SESSION, "event_id"), base, "gold")
    commits.write_sessions(rows.where("RoundNumber between 11 and 15").drop("LapTime_s"), base, "gold")
    commits.write_sessions(rows.where("RoundNumber > 15"), base, "gold")
    return commits.read_sessions(s, base, "gold").where("RoundNumber > 5").groupBy("Season").agg(F.count("*").alias("n"), F.count("TyreLife").alias("with_life"), F.count("LapTime_s").alias("with_time"))


@query(sql("bounded", "select replace(EventName, ' ', '_') as event_dir, count(*) as n from (select *, 'GP ' || cast(RoundNumber % 24 as varchar) as EventName from bounded) group by all"))
def a6_csv_by_event(s, d):
    path = _store(s)
    tables.write_event_csv(bounded(s, d).withColumn("EventName", F.concat(F.lit("GP "), (F.col("RoundNumber") % 24).cast("string"))), path)
    back = s.read.csv(path, header=True, schema="Season int, RoundNumber int, SessionType string, Driver string")
    return back.groupBy("event_dir").agg(F.count("*").alias("n"))


@query(sql("grid", f"select {S4}, lap, position from grid"))
def a7_json_artifacts(s, d):
    path, laps = _store(s), A.laps(s, d)
    maps = artifacts.as_maps(artifacts.lap_positions(laps, A.results(s, d), standings.total_laps(laps)))
    tables.write_json(maps, path)
    return artifacts.from_maps(s.read.schema(maps.schema).json(path)).select(*K4, "lap", "position")


@query(sql("laps", "select 2030 as Season, 7 as RoundNumber, 'Q' as SessionType, 'Test GP' as EventName, event_id from laps"))
def a8_session_metadata(s, d):
    return tables.add_session(A.laps(s, d).select("event_id"), 2030, 7, "Q", "Test GP")


@query(sql("laps", "select distinct RoundNumber as round from laps"))
def a9_available_rounds(s, d):
    path = _store(s)
    A.laps(s, d).select("event_id", F.concat(F.lit("round_"), F.col("RoundNumber").cast("string")).alias("name")).write.partitionBy("name").parquet(path)
    return tables.available_rounds(s, path, r"name=round_(\d+)")


# --- checks, filters

@query(sql("laps", f"""select {S3}, c as "column", rule, value from (
 select *, 'LapTime_s' as c, 'required' as rule, cast(null as varchar) as value from laps where LapTime_s is null
 union all select *, 'SpeedI1', 'range', cast(SpeedI1 as varchar) from laps where SpeedI1 > 280
 union all select *, 'Driver', 'length', Driver from laps where length(Driver) > 2)"""))
def b1_validate_laps(s, d):
    rules = [validate.Rule("LapTime_s", "double", True), validate.Rule("SpeedI1", "double", high=280), validate.Rule("Driver", "string", length=(1, 2))]
    return validate.violations(A.laps(s, d), rules)


@query(sql("results", f"""select {S3}, c as "column", rule, n from (
 select {S3}, 'GridPosition' as c, 'range' as rule, count(*) as n from results where GridPosition > 18 group by all
 union all select {S3}, 'Points', 'range', count(*) from results where Points > 20 group by all)"""))
def b2_validate_results(s, d):
    rules = [validate.Rule("Abbreviation", "string", True, length=(2, 3)), validate.Rule("GridPosition", "double", low=0, high=18), validate.Rule("Position", "double", low=1, high=25), validate.Rule("Points", "double", low=0, high=20)]
    return validate.violations(A.results(s, d), rules).groupBy(*SESSION, "column", "rule").agg(F.count("*").alias("n"))


@query(sql("laps", "select event_id, try_cast(Driver as integer) as Driver, try_cast(TrackStatus as integer) as TrackStatus, Team from laps"))
def b3_coerce(s, d):
    return validate.coerce(A.laps(s, d).select("event_id", "Driver", "TrackStatus", "Team"), [validate.Rule("Driver", "int"), validate.Rule("TrackStatus", "int")])


@query(sql("laps", "select event_id from laps where PitOutTime_s is null"))
def b4_filter_out_laps(s, d):
    return filters.without_out_laps(A.laps(s, d)).select(*LAP)


@query(sql("laps", "select event_id from laps where PitInTime_s is null"))
def b5_filter_in_laps(s, d):
    return filters.without_in_laps(A.laps(s, d)).select(*LAP)


@query(sql("laps", "select event_id from laps where TrackStatus is null or TrackStatus not in ('2','4','5','6','7')"))
def b6_filter_neutralised(s, d):
    return filters.without_neutralised(A.laps(s, d)).select(*LAP)


@query(sql("laps", "select event_id from laps where LapTime_s between 50 and 600"))
def b7_filter_impossible(s, d):
    return filters.within_times(A.laps(s, d)).select(*LAP)


@query(sql("laps", """, m as (select *, median(LapTime_s) over g as md, count(LapTime_s) over g as n from laps window g as (partition by Season, RoundNumber, SessionType, Driver, Stint)),
m2 as (select *, median(abs(LapTime_s - md)) over (partition by Season, RoundNumber, SessionType, Driver, Stint) as mad from m)
select event_id from m2 where not coalesce(Stint is not null and n >= 4 and mad > 0 and LapTime_s - md > 2.5 * 1.4826 * mad, false)"""))
def b8_filter_outliers(s, d):
    return filters.without_outliers(A.laps(s, d)).select(*LAP)


@query(sql("tag0", f"""select {S3}, count(*) as total_laps, {', '.join(f"count(*) filter (rule = '{r}') as removed_{r}" for r in ('impossible', 'out_lap', 'in_lap', 'neutralised', 'outlier'))},
 count(*) filter (rule = 'kept') as kept_laps, round(100.0 * count(*) filter (rule = 'kept') / count(*), 2) as retention_pct from tagged group by all"""))
def b9_apply_all_filters(s, d):
    return filters.filter_report(A.laps(s, d))


@query(sql("laps", f"select {S3}, count(*) as laps, count(*) filter (LapTime_s is null) as dropped from laps group by all"))
def b10_null_lap_times(s, d):
    return filters.lap_time_report(A.laps(s, d))


@query(sql("laps", "select event_id from laps where PitInTime_s is null and PitOutTime_s is null and LapTime_s is not null"))
def b11_clean_laps(s, d):
    return filters.clean_laps(A.laps(s, d)).select(*LAP)


NOW = datetime(2024, 1, 12, 12)


@query(sql("schedule", """, t as (select timestamp '2024-01-12 12:00:00' as now), r as (select schedule.*, now from schedule, t where EventFormat <> 'testing')
select max_by(EventName, EventDate) filter (EventDate <= now and EventDate >= now - interval 2 day) as last_event, max_by(RoundNumber, EventDate) filter (EventDate <= now and EventDate >= now - interval 2 day) as last_round,
 min_by(EventName, EventDate) filter (EventDate >= now and EventDate <= now + interval 3 day) as next_event, min_by(RoundNumber, EventDate) filter (EventDate >= now and EventDate <= now + interval 3 day) as next_round from r"""))
def b12_events_in_window(s, d):
    return filters.events_in_window(A.schedule(s, d), NOW)


@query(sql("schedule", "select Season, coalesce(min_by(RoundNumber, EventDate) filter (EventDate >= timestamp '2024-01-12 12:00:00'), max(RoundNumber)) as next_round from schedule group by Season"))
def b13_next_round(s, d):
    return filters.next_round(A.schedule(s, d), NOW)


@query(sql("laps", "select event_id, Driver, TeamRaw from laps where contains(lower(Driver), 'mer') or contains(lower(TeamRaw), 'mer')"))
def b14_text_search(s, d):
    return A.laps(s, d).where(scalar.text_match("Mer", "Driver", "TeamRaw")).select("event_id", "Driver", "TeamRaw")


@query(sql("results", """, w as (select distinct Season, RoundNumber from results union select Season, RoundNumber + 1 from results), own as (select * from results), have as (select distinct Season, RoundNumber from own),
f as (select w.Season, w.RoundNumber, coalesce(h.RoundNumber, w.RoundNumber - 1) as source_round from w left join have h on h.Season = w.Season and h.RoundNumber = w.RoundNumber)
select f.Season, f.RoundNumber, source_round, Abbreviation as Driver, TeamName as Team from f join own on own.Season = f.Season and own.RoundNumber = source_round"""))
def b15_entry_list(s, d):
    r = A.results(s, d).select("Season", "RoundNumber", F.col("Abbreviation").alias("Driver"), F.col("TeamName").alias("Team"))
    # The round after each is asked for as well: after the last one its own results are missing.
    return filters.entry_list(r.union(r.withColumn("RoundNumber", F.col("RoundNumber") + 1)), r)


# --- scalar functions

@query(sql("laps", f"select event_id, {q6('LapTime_s')}, {q6('PitInTime_s')} from laps"))
def c1_times_to_seconds(s, d):
    raw = A.laps(s, d).select("event_id", F.round(F.col("LapTime_s") * 1e9).cast("long").alias("LapTime"), F.col("PitInTime_s").alias("PitInTime"))
    return scalar.times_to_seconds(raw).select("event_id", *r6("LapTime_s", "PitInTime_s"))


@query(sql("laps", """select event_id, case TeamRaw when 'Oracle Red Bull Racing' then 'Red Bull' when 'Mercedes-AMG Petronas' then 'Mercedes' when 'Scuderia Ferrari HP' then 'Ferrari' else TeamRaw end as TeamRaw from laps"""))
def c2_standard_teams(s, d):
    return scalar.standard_teams(A.laps(s, d), "TeamRaw").select("event_id", "TeamRaw")


@query(sql("laps", "select TeamRaw as team, count(*) as laps from laps where TeamRaw = 'Unknown Works' group by all"))
def c2_unknown_teams(s, d):
    return scalar.unknown_teams(A.laps(s, d), "TeamRaw")


@query(sql("laps", "select event_id, Driver from laps"))
def c3_standard_drivers(s, d):
    return scalar.standard_drivers(A.laps(s, d).withColumn("Driver", F.concat(F.lit(" "), F.lower("Driver"), F.lit("  ")))).select("event_id", "Driver")


@query(sql("results", f"select {S3}, Abbreviation, cast(GridPosition <= 2 as integer) as is_front_row, cast(GridPosition <= 10 as integer) as is_top10_start, GridPosition - 1 as grid_gap_to_pole from results"))
def c4_grid_flags(s, d):
    return scalar.grid_flags(A.results(s, d)).select(*SESSION, "Abbreviation", F.col("is_front_row").cast("int").alias("is_front_row"), F.col("is_top10_start").cast("int").alias("is_top10_start"), "grid_gap_to_pole")


_TRACK_SQL = """t as (select EventName as e, case TrackType when 'Street' then 1 when 'Permanent' then 2 when 'Hybrid' then 3 end as tt, case DownforceLevel when 'Ultra-Low' then 1 when 'Low' then 2 when 'Medium' then 3 when 'High' then 4 else 5 end as dl,
 Abrasiveness, FullThrottlePct, AvgSpeed_kph, MaxSpeed_kph, CornerCount from tracks)"""


@query(sql("laps tracks", f""", {_TRACK_SQL} select event_id, coalesce(tt, 0) as TrackType_val, coalesce(dl, 0) as DownforceLevel_val, coalesce(Abrasiveness, 0) as Abrasiveness, round(coalesce(FullThrottlePct, 0), 6) as FullThrottlePct,
 coalesce(AvgSpeed_kph, 0) as AvgSpeed_kph, coalesce(MaxSpeed_kph, 0) as MaxSpeed_kph, coalesce(CornerCount, 0) as CornerCount from laps left join t on e = EventName"""))
def c5_e2_track_metadata(s, d):
    return joins.add_track(A.laps(s, d).select("event_id", "EventName"), A.tracks(s, d)).drop("EventName").withColumn("FullThrottlePct", F.round(F.col("FullThrottlePct") + TIE, 6))


@query(sql("laps tracks", f", {_TRACK_SQL} select event_id, round(case when Season < 2026 then LapTime_s + 1.5 + 0.2 * coalesce(dl, 0) else LapTime_s end, 6) as LapTime_s from laps left join t on e = EventName"))
def c6_era_penalty(s, d):
    return scalar.era_penalty(joins.add_track(A.laps(s, d), A.tracks(s, d))).select("event_id", *r6("LapTime_s"))


@query(sql("laps weather", f"""select event_id, round(coalesce(LapNumber * greatest(0.5, least(2.0, case when TrackTemp is null then null else TrackTemp / 30 end)) + case when TrackTemp is null then null else 0 end, 0), 6) as pu_strain_index
 from laps asof left join weather on laps.Season = weather.Season and laps.RoundNumber = weather.RoundNumber and laps.Time >= weather.Time"""))
def c7_strain_index(s, d):
    return scalar.strain_index(joins.add_weather(A.laps(s, d), A.weather(s, d))).select("event_id", *r6("pu_strain_index"))


@query(sql("laps", """, w as (select event_id, exp(-0.07 * ((2025 - Season) * 24 + (3 - RoundNumber))) as r from laps) select event_id, round(r / (select avg(r) from w), 6) as weight from w"""))
def c8_recency_weights(s, d):
    return scalar.recency_weights(A.laps(s, d), 2025, 3).select("event_id", *r6("weight"))


@query(sql("results", f"""select {S3}, Abbreviation, case when Time is null then case when Status in ('', 'Finished') then null else Status end
 when Position = 1 then printf('%d:%02d:%02d.%03d', cast(floor(Time) as bigint) // 3600, (cast(floor(Time) as bigint) % 3600) // 60, cast(floor(Time) as bigint) % 60, cast(floor(round((Time - floor(Time)) * 1000, 3)) as bigint))
 else printf('+%.3fs', Time) end as result from results"""))
def c9_result_time(s, d):
    return A.results(s, d).select(*SESSION, "Abbreviation", scalar.result_time(F.col("Position"), F.col("Time"), F.col("Status")).alias("result"))


@query(sql("results", f"select {S3}, Abbreviation, cast(case when Position <= 10 then ([25,18,15,12,10,8,6,4,2,1])[cast(Position as integer)] else 0 end as integer) as points from results"))
def c10_points(s, d):
    return A.results(s, d).select(*SESSION, "Abbreviation", scalar.points_for(F.col("Position")).alias("points"))


@query(sql("preds", f"select {S4}, LapNumber, round((pred_s + pred_p05) / 2, 6) as predicted_laptime_ensemble_s from preds"))
def c11_ensemble(s, d):
    return scalar.ensemble(preds(s, d), ["pred_s", "pred_p05"]).select(*K4, "LapNumber", *r6("predicted_laptime_ensemble_s"))


@query(sql("laps", "select event_id, least(SpeedI1, SpeedST) as SpeedI1, SpeedST, greatest(SpeedFL, SpeedST) as SpeedFL from laps"))
def c12_ordered_bounds(s, d):
    return scalar.ordered_bounds(A.laps(s, d), "SpeedI1", "SpeedST", "SpeedFL").select("event_id", "SpeedI1", "SpeedST", "SpeedFL")


@query(sql("laps", "select event_id, case when LapTime_s / 1000 < 0.2 then 'excellent' when LapTime_s / 1000 < 0.35 then 'good' else 'needs_improvement' end as status, coalesce(LapTime_s / 1000 > 0.3, false) as retrain from laps"))
def c13_c14_accuracy(s, d):
    mae = F.col("LapTime_s") / 1000
    return A.laps(s, d).select("event_id", scalar.accuracy_class(mae).alias("status"), scalar.needs_retraining(mae).alias("retrain"))


@query(sql("laps", "select distinct printf('%d_R%02d_%s', Season, RoundNumber, SessionType) || case when RoundNumber % 2 = 0 then ' - ' || EventName else '' end as label from laps"))
def c15_session_label(s, d):
    event = F.when(F.col("RoundNumber") % 2 == 0, F.col("EventName"))
    return A.laps(s, d).select(scalar.session_label(F.col("Season"), F.col("RoundNumber"), F.col("SessionType"), event).alias("label")).distinct()


# --- fills

@query(sql("filled", "select event_id, Stint, TyreLife from ft"))
def d1_d2_fill_tyres(s, d):
    return impute.fill_tyre_life(impute.fill_stint(filters.with_lap_times(A.laps(s, d)))).select("event_id", "Stint", "TyreLife")


@query(sql("filled", "select event_id, Compound from fc"))
def d3_fill_compound(s, d):
    return impute.fill_compound(impute.fill_tyre_life(impute.fill_stint(filters.with_lap_times(A.laps(s, d))))).select("event_id", "Compound")


_F = ["Stint", "TyreLife", "Compound", "SpeedI1", "SpeedI2", "SpeedFL", "SpeedST"]


@query(sql("filled", f"select event_id, Stint, TyreLife, Compound, {q6('SpeedI1', 'SpeedI2', 'SpeedFL', 'SpeedST')} from filled"))
def d4_d5_impute_all(s, d):
    # What is written takes no column that neither fills nor result need; a lap's position alone costs two exchanges.
    laps = A.laps(s, d).select("event_id", *K4, "EventName", "LapNumber", "LapTime_s", *_F)
    return impute.impute(laps, store=True).select("event_id", "Stint", "TyreLife", "Compound", *r6("SpeedI1", "SpeedI2", "SpeedFL", "SpeedST"))


@query(sql("filled", f""", b as (select {S3}, {', '.join(f'count(*) filter ({c} is null) as b_{c}' for c in _F)} from laps where LapTime_s is not null group by all),
a as (select {S3}, count(*) as laps, {', '.join(f'count(*) filter ({c} is null) as a_{c}' for c in _F)} from filled group by all)
select {S3}, laps, {', '.join(f'b_{c} - a_{c} as filled_{c}' for c in _F)} from b join a using ({S3})"""))
def d5_impute_report(s, d):
    return impute.impute_report(A.laps(s, d))


# --- joins

_WEATHER_SQL = sql("laps weather", """select event_id, AirTemp, TrackTemp, Humidity, Rainfall, WindSpeed from laps
 asof left join weather on laps.Season = weather.Season and laps.RoundNumber = weather.RoundNumber and laps.Time >= weather.Time""")


@query(_WEATHER_SQL)
def e1_weather_as_of(s, d):
    return joins.add_weather(A.laps(s, d), A.weather(s, d)).select("event_id", *joins.WEATHER)


@query(_WEATHER_SQL)
def e1_weather_as_of_bucketed(s, d):
    return joins.add_weather(A.laps(s, d), A.weather(s, d), bucket_seconds=3600).select("event_id", *joins.WEATHER)


@query(sql("res", f"select {S4}, {q6('actual_median_s', 'median_predicted_s')} from res"))
def e3_prediction_actual(s, d):
    return res(s, d).select(*K4, *r6("actual_median_s", "median_predicted_s"))


@query(sql("ordered results", f"select o.Season, o.RoundNumber, o.SessionType, o.Driver, predicted_position, Position from ordered o join results r on r.Season = o.Season and r.RoundNumber = o.RoundNumber and r.Abbreviation = o.Driver"))
def e4_prediction_results(s, d):
    r = A.results(s, d).select(*SESSION, F.col("Abbreviation").alias("Driver"), "Position")
    return ordered(s, d).join(r, K4).select(*K4, "predicted_position", "Position")


@query(sql("laps results", """select event_id, cast(coalesce((select sum(Points) from results r where r.Season = l.Season and r.Abbreviation = l.Driver and r.RoundNumber < l.RoundNumber), 0) as double) as DriverPointsPreRace,
 cast(coalesce((select sum(Points) from results r where r.Season = l.Season and r.TeamName = l.Team and r.RoundNumber < l.RoundNumber), 0) as double) as TeamPointsPreRace from laps l"""))
def e5_historical_points(s, d):
    out = joins.add_points(A.laps(s, d), A.results(s, d))
    return out.select("event_id", F.col("DriverPointsPreRace").cast("double").alias("DriverPointsPreRace"), F.col("TeamPointsPreRace").cast("double").alias("TeamPointsPreRace"))


@query(sql("laps results", "select event_id, GridPosition from laps l left join results r on r.Season = l.Season and r.RoundNumber = l.RoundNumber and r.Abbreviation = l.Driver"))
def e6_grid_join(s, d):
    return joins.add_grid(A.laps(s, d), A.results(s, d)).select("event_id", "GridPosition")


@query(sql("laps schedule", "select event_id, coalesce(s.EventName, 'Round ' || cast(l.RoundNumber as varchar)) as event_title, replace(coalesce(s.EventName, 'Round ' || cast(l.RoundNumber as varchar)), ' ', '_') as event_dir from laps l left join schedule s on s.Season = l.Season and s.RoundNumber = l.RoundNumber"))
def e8_event_names(s, d):
    return joins.add_event_names(A.laps(s, d).drop("EventName"), A.schedule(s, d)).select("event_id", "event_title", "event_dir")


# --- windows

@query(sql("laps", f"""select event_id, {q6('r3', 'r5', 's3').replace('as r3', 'as roll_laptime_3').replace('as r5', 'as roll_laptime_5').replace('as s3', 'as roll_std_3')}, round(r3 - r5, 6) as delta_roll_pace from (
 select event_id, case when Stint is not null then avg(LapTime_s) over (w rows between 2 preceding and current row) end as r3, case when Stint is not null then avg(LapTime_s) over (w rows between 4 preceding and current row) end as r5,
 case when Stint is not null then stddev_samp(LapTime_s) over (w rows between 2 preceding and current row) end as s3 from laps window w as (partition by Season, RoundNumber, SessionType, Driver, Stint order by LapNumber))"""))
def f1_rolling_pace(s, d):
    return features.rolling_pace(A.laps(s, d)).select("event_id", *r6("roll_laptime_3", "roll_laptime_5", "roll_std_3", "delta_roll_pace"))


@query(sql("laps", "select event_id, round(LapTime_s - min(LapTime_s) over (partition by Season, RoundNumber, SessionType, Driver, EventName), 6) as delta_to_fastest_s from laps"))
def f2_gap_to_fastest(s, d):
    return features.gap_to_fastest(A.laps(s, d)).select("event_id", *r6("delta_to_fastest_s"))


@query(sql("laps", """, g as (select Season, RoundNumber, SessionType, Driver, Stint, regr_slope(LapTime_s, TyreLife) as sl, regr_intercept(LapTime_s, TyreLife) as ic, count(*) filter (LapTime_s is not null and TyreLife is not null) as n from laps where Stint is not null group by all)
select event_id, round(case when isnan(sl) or n < 2 then null else sl end, 5) as tyre_deg_slope, round(case when isnan(ic) or isnan(sl) or n < 2 then null else ic end, 5) as tyre_deg_intercept from laps left join g using (Season, RoundNumber, SessionType, Driver, Stint)"""))
def f3_degradation_slope(s, d):
    out = features.degradation_slope(A.laps(s, d), intercept=True)
    return out.select("event_id", F.round("tyre_deg_slope", 5).alias("tyre_deg_slope"), F.round("tyre_deg_intercept", 5).alias("tyre_deg_intercept"))


@query(sql("laps", """select event_id, round(case when Stint is null then null when hi = lo then 0.0 when hi > lo then (TyreLife - lo) / (hi - lo) end, 6) as tyre_life_norm
 from (select *, min(TyreLife) over w as lo, max(TyreLife) over w as hi from laps window w as (partition by Season, RoundNumber, SessionType, Driver, Stint))"""))
def f4_tyre_life_norm(s, d):
    return features.normalised_tyre_life(A.laps(s, d)).select("event_id", *r6("tyre_life_norm"))


@query(sql("laps", """, k as (select *, row_number() over (partition by Season, RoundNumber, SessionType, LapNumber order by LapTime_s nulls last) as rn from laps),
p as (select Season, RoundNumber, SessionType, LapNumber, median(LapTime_s) filter (rn <= 3) as pace from k group by all),
e as (select Season, RoundNumber, LapNumber, coalesce(pace - lag(pace, 5) over (partition by Season, RoundNumber, SessionType order by LapNumber), 0) as f from p)
select event_id, round(f, 6) as track_evolution_factor from laps join e using (Season, RoundNumber, LapNumber)"""))
def f5_e7_track_evolution(s, d):
    return features.track_evolution(A.laps(s, d)).select("event_id", *r6("track_evolution_factor"))


@query(sql("laps", "select event_id, round(coalesce(var_samp(Sector3Time_s) over (partition by Season, RoundNumber, SessionType, Driver order by LapNumber rows between 2 preceding and current row), 0) + 1e-7, 4) as brake_wear_proxy from laps"))
def f6_brake_wear(s, d):
    return features.brake_wear(A.laps(s, d)).select("event_id", F.round(F.col("brake_wear_proxy") + 1e-7, 4).alias("brake_wear_proxy"))


@query(sql("results", f"""select {S3}, Abbreviation as Driver, n as teammate_index, case when n = 1 then 'solid' else 'dashed' end as line_style from (
 select *, row_number() over (partition by {S3}, TeamName order by Position, Abbreviation) as n from results)"""))
def f8_teammates(s, d):
    r = A.results(s, d).withColumnsRenamed({"Abbreviation": "Driver", "TeamName": "Team"})
    return features.teammate_index(r).select(*K4, "teammate_index", "line_style")


@query(sql("ordered", f"select {S4}, predicted_position from ordered"))
def f9_predicted_order(s, d):
    return ordered(s, d).select(*K4, "predicted_position")


# --- aggregations

@query(sql("preds", """select Season, EventName, Driver, Team, scope, round(m, 6) as median_predicted_s, round(a, 6) as mean_predicted_s, n as lap_count, round(sd, 6) as std_predicted_s,
 row_number() over (partition by Season, scope, EventName order by m, Driver, Team) as rank from (
 select Season, null as EventName, Driver, Team, 'season' as scope, median(pred_s) as m, avg(pred_s) as a, count(pred_s) as n, stddev_samp(pred_s) as sd from preds where pred_s is not null group by Season, Driver, Team
 union all select Season, EventName, Driver, Team, 'event', median(pred_s), avg(pred_s), count(pred_s), stddev_samp(pred_s) from preds where pred_s is not null group by Season, EventName, Driver, Team)"""))
def g1_f7_driver_standings(s, d):
    return standings.driver_standings(preds(s, d), "pred_s").select("Season", "EventName", "Driver", "Team", "scope", *r6("median_predicted_s", "mean_predicted_s"), "lap_count", *r6("std_predicted_s"), "rank")


@query(sql("bounded", f"select {S4}, Team, {q6('lower_bound_s', 'median_predicted_s', 'upper_bound_s')}, rank from bounded"))
def g2_bounded_standings(s, d):
    return bounded(s, d).select(*K4, "Team", *r6("lower_bound_s", "median_predicted_s", "upper_bound_s"), "rank")


@query(sql("actual", f"select {S4}, round(actual_median_s, 6) as actual_median_s from actual"))
def g3_actual_pace(s, d):
    return standings.actual_pace(A.laps(s, d)).select(*K4, *r6("actual_median_s"))


@query(sql("res", f"select {S4}, {q6('residual_s', 'abs_error_s')}, in_range from res"))
def g4_residuals(s, d):
    return res(s, d).select(*K4, *r6("residual_s", "abs_error_s"), "in_range")


_G5 = f"""select {S3}, round(avg(abs_error_s), 6) as mae, round(sqrt(avg(residual_s ** 2)), 6) as rmse, round(100 * avg(cast(in_range as integer)), 6) as coverage_pct,
 case when avg(abs_error_s) < 0.2 then 'excellent' when avg(abs_error_s) < 0.35 then 'good' else 'needs_improvement' end as accuracy, avg(abs_error_s) > 0.3 as retrain from res group by all"""


@query(sql("res", _G5))
def g5_residual_metrics(s, d):
    return standings.residual_metrics(res(s, d)).select(*SESSION, *r6("mae", "rmse", "coverage_pct"), "accuracy", "retrain")


@query(sql("ordered results", f""", b as (select o.Season, o.RoundNumber, o.SessionType, o.Driver, predicted_position as pred, Position as act from ordered o join results r on r.Season = o.Season and r.RoundNumber = o.RoundNumber and r.Abbreviation = o.Driver),
c as (select *, row_number() over (partition by {S3} order by pred, Driver) as p, row_number() over (partition by {S3} order by act, Driver) as a, abs(pred - act) as e, row_number() over (partition by {S3} order by abs(pred - act) desc, Driver) as m from b),
v as (select {S3}, avg(e) as mae, 100 * avg(e / act) as mape, bool_or(p = 1 and a = 1) as winner_correct, count(*) filter (p <= 3 and a <= 3) * 100.0 / 3 as pod, count(*) filter (p <= 10 and a <= 10) * 10.0 as ten, string_agg(Driver, ',' order by m) filter (m <= 3) as misses from c group by all)
select {S3}, round(coalesce(mae, 999), 4) as mae, round(coalesce(mape, 999), 2) as mape_pct, coalesce(winner_correct, false) as winner_correct, round(coalesce(pod, 0), 1) as podium_pct, round(coalesce(ten, 0), 1) as top10_pct, coalesce(misses, '') as key_misses,
 case when round(coalesce(mae, 999), 4) < 0.2 then 'excellent' when round(coalesce(mae, 999), 4) < 0.35 then 'good' else 'needs_improvement' end as status from (select distinct {S3} from results) left join v using ({S3})"""))
def g6_race_verdict(s, d):
    return standings.verdict(ordered(s, d), A.results(s, d))


_M = "round(avg(abs(LapTime_s - pred_s)), 6) as mae, round(sqrt(avg((LapTime_s - pred_s) ** 2)), 6) as rmse, round(avg(abs(LapTime_s - pred_s) / greatest(abs(LapTime_s), 2.220446049250313e-16)), 6) as mape, count(*) as n"


@query(sql("preds", f"select {_M} from preds where LapTime_s is not null and pred_s is not null"))
def g7_regression_metrics(s, d):
    return standings.regression_metrics(preds(s, d), "LapTime_s", "pred_s").select(*r6("mae", "rmse", "mape"), "n")


_FORM = ["SpeedI1", "SpeedI2", "SpeedFL", "SpeedST", "Sector3Time_s", "LapTime_s"]


@query(sql("laps", f"select Driver, {', '.join(f'round(median({c}), 6) as {c}' for c in _FORM)}, min_by(Team, Season * 1000000 + RoundNumber * 10000 + LapNumber) as Team from laps group by Driver"))
def g8_driver_form(s, d):
    return standings.driver_form(A.laps(s, d)).select("Driver", *r6(*_FORM), "Team")


@query(sql("laps", "select Driver, 2026 as Season, 4 as RoundNumber, 'GP 4' as EventName, 15 as LapNumber, 1 as Stint, 10.0::double as TyreLife, 'MEDIUM' as Compound, round(median(LapTime_s), 6) as roll_laptime_3, 0.0::double as LapTime_s from laps group by Driver"))
def g9_scenario(s, d):
    out = standings.scenario(standings.driver_form(A.laps(s, d)), 2026, 4, "GP 4")
    return out.select("Driver", "Season", "RoundNumber", "EventName", "LapNumber", "Stint", "TyreLife", "Compound", *r6("roll_laptime_3"), "LapTime_s")


@query(sql("stints", f"select {S4}, stint_no, Stint, compound, laps, first_lap from stints"))
def g10_stint_summary(s, d):
    return standings.stints(A.laps(s, d))


@query(sql("ordered", f"select {S4}, predicted_position as place, stint, compound, laps from ordered, (values (1, 'MEDIUM', 23), (2, 'HARD', 34)) t(stint, compound, laps)"))
def g11_predicted_stints(s, d):
    return standings.predicted_stints(ordered(s, d), 57)


@query(sql("results laps", f""", p as (select {S3}, min(LapTime_s) as pole from laps group by all)
select {S3}, Abbreviation as Driver, round(coalesce(Q3, Q2, Q1), 6) as best_quali_s, round(coalesce(Q3, Q2, Q1) - pole, 6) as gap_to_pole_s, GridPosition from results left join p using ({S3})"""))
def g12_qualifying(s, d):
    return standings.qualifying(A.results(s, d), A.laps(s, d)).select(*K4, *r6("best_quali_s", "gap_to_pole_s"), "GridPosition")


@query(sql("preds", """, l as (select Season, Driver, 'pred_s' as model, pred_s as t from preds union all select Season, Driver, 'pred_p05', pred_p05 from preds),
m as (select Season, model, Driver, median(t) as m, count(*) as n from l group by all), k as (select *, sum(n) over (partition by Season, model) as total_laps, row_number() over (partition by Season, model order by m nulls last, Driver) as rank from m)
select Season, model, cast(total_laps as bigint) as total_laps, rank, Driver, round(m, 6) as median_predicted_s from k where rank <= 5 and m is not null"""))
def g13_season_summary(s, d):
    return standings.season_summary(preds(s, d), ["pred_s", "pred_p05"]).withColumn("median_predicted_s", F.round(F.col("median_predicted_s") + TIE, 6))


@query(sql("tag0", f"select {S3}, count(*) as raw_rows, count(*) filter (rule = 'kept') as clean_rows, round(100.0 * count(*) filter (rule = 'kept') / count(*), 2) as retention_pct from tagged group by all"))
def g14_cleaning_report(s, d):
    return pipelines.cleaning_report(A.laps(s, d))


@query(sql("totals", f"select {S3}, total_laps from totals"))
def g15_total_laps(s, d):
    return standings.total_laps(A.laps(s, d))


@query(sql("preds", f"select Season, EventName, {_M} from preds where LapTime_s is not null and pred_s is not null group by Season, EventName"))
def g16_event_metrics(s, d):
    return standings.event_metrics(preds(s, d), "LapTime_s", "pred_s").select("Season", "EventName", *r6("mae", "rmse", "mape"), "n")


@query(sql("stints totals", f""", x as (select {S4}, string_agg(substr(compound, 1, 1), '-' order by stint_no) as st from stints group by all), y as (select *, row_number() over (partition by {S3} order by Driver) as n from x)
select stints.Season, stints.RoundNumber, stints.SessionType, stints.Driver, stint_no, laps, round(100.0 * laps / total_laps, 4) as share_pct, case when n <= 5 then stints.Driver || ' (' || st || ')' end as strategy from stints join totals using ({S3}) left join y using ({S4})"""))
def g17_stint_shares(s, d):
    return standings.stint_shares(A.laps(s, d)).select(*K4, "stint_no", "laps", "share_pct", "strategy")


@query(sql("results", f"select {S3}, max(Abbreviation) filter (Position = 1) as winner, max(Abbreviation) filter (Position = 2) as runner_up from results group by all"))
def g18_top_two(s, d):
    return standings.top_two(A.results(s, d).withColumnRenamed("Abbreviation", "Driver"), "Position")


# --- profiles

@query(sql("laps", " union all ".join(f"""select '{c}' as "column", '{t}' as dtype, count(*) - count({c}) as nulls, round(100.0 * (count(*) - count({c})) / count(*), 4) as null_pct, count(distinct {c}) as n_unique from laps""" for c, t in (("Driver", "string"), ("Stint", "int"), ("Compound", "string"), ("LapTime_s", "double")))))
def h1_profile(s, d):
    return profile.profile_columns(A.laps(s, d).select("Driver", "Stint", "Compound", "LapTime_s"))


_PROFILED = ("Driver", "Stint", "Compound", "LapTime_s", "event_id")


@query(sql("laps", " union all ".join(f"""select Season, '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls, round(100.0 * (count(*) - count({c})) / count(*), 4) as null_pct, case when count(distinct {c}) < 4096 then count(distinct {c}) end as n_unique,
 {', '.join(f"round({e}, 6) as {n}" for e, n in ((f"min({c})::double", "least"), (f"max({c})::double", "greatest"), (f"avg({c})", "mean"), (f"stddev_samp({c})", "std"))) if c in ("Stint", "LapTime_s", "event_id") else "null as least, null as greatest, null as mean, null as std"} from laps group by Season""" for c in _PROFILED)))
def h1_session_profiles(s, d):
    """Sketches kept by session, extended by new sessions and made anew for a replaced one, merged by season; the number of different values only where it is exact."""
    return session_profiles.merged_columns(_profiled(s, d), ["Season"]).select(
        "Season", "column", "rows", "nulls", "null_pct", F.when(F.col("unique_exact"), F.col("n_unique")).alias("n_unique"), *r6("least", "greatest", "mean", "std"))


def _profiled(s, d) -> DataFrame:
    base, rows = _store(s), A.laps(s, d).select(*SESSION, *_PROFILED)
    for part, replace in ((rows.where("RoundNumber <= 10"), False), (rows, False), (rows.where("RoundNumber = 3"), True)):
        commits.write_sessions(part, base, "laps", overwrite=replace)
        session_profiles.refresh(s, base, "laps")
    return session_profiles.profiles(s, base, "laps")


@query(sql("laps", """, r as (select Season, Driver, Stint, Compound from laps), c as (select Season, count(*) as n from (select distinct * from r) group by all)
select Season, count(*) as rows, any_value(c.n) as n_unique, count(*) - any_value(c.n) as duplicates from laps join c using (Season) group by Season"""))
def h4_session_duplicates(s, d):
    """Duplicates over all sessions of a season, from sketches of whole rows where these are exact, else counted."""
    base = _store(s)
    commits.write_sessions(A.laps(s, d).select(*SESSION, *_PROFILED), base, "laps")
    session_profiles.refresh(s, base, "laps", ["Driver", "Stint", "Compound"])
    return session_profiles.exact_rows(s, base, "laps", ["Season"], ["Driver", "Stint", "Compound"]).select("Season", "rows", "n_unique", "duplicates")


@query(sql("laps", " union all ".join(f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c})::double, 6) as min, {', '.join(f'round(quantile_cont({c}, {q}), 6) as {n}' for q, n in ((.05, 'p05'), (.25, 'p25'), (.5, 'p50'), (.75, 'p75'), (.95, 'p95')))}, round(max({c})::double, 6) as max from laps""" for c in ("LapTime_s", "TyreLife", "SpeedI1"))))
def h2_describe(s, d):
    return profile.describe_numeric(A.laps(s, d).select("LapTime_s", "TyreLife", "SpeedI1")).select("column", "count", *r6("mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max"))


@query(sql("laps", """, l as (select 'Driver' as "column", Driver as value from laps union all select 'Compound', Compound from laps), c as (select "column", value, count(*) as n from l where value is not null group by all)
select "column", value, n, rank from (select *, row_number() over (partition by "column" order by n desc, value) as rank from c) where rank <= 5"""))
def h3_top_values(s, d):
    return profile.top_values(A.laps(s, d).select("Driver", "Compound"))


@query("select count(*) as rows, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates from lineitem")
def h4_duplicates(s, d):
    return profile.duplicate_rows(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query(sql("laps", """select * from (select 'Stint' as "column", round(100.0 * (count(*) - count(Stint)) / count(*), 4) as null_pct from laps union all select 'Compound', round(100.0 * (count(*) - count(Compound)) / count(*), 4) from laps
 union all select 'Driver', round(100.0 * (count(*) - count(Driver)) / count(*), 4) from laps) where null_pct > 0"""))
def h5_missing_share(s, d):
    return profile.missing_share(A.laps(s, d).select("Driver", "Stint", "Compound"))


_BIN = "case when hi > lo then least(greatest(cast(ceil((x - lo) / ((hi - lo) / {n})) as integer) - 1, 0), {n} - 1) else 0 end"


@query(f"""with e as (select l_quantity as x, l_extendedprice as y from lineitem), m as (select min(x)::double as lo, max(x)::double as hi from e)
select {_BIN.format(n=10)} as bin, round(avg(y), 4) as mean_y, count(*) as rows from e, m where x is not null group by 1""")
def h6_binned_mean(s, d):
    return profile.binned_mean(A.table(s, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("mean_y", F.round("mean_y", 4))


@query(sql("laps", """, c as (select * from laps where LapTime_s is not null and TyreLife is not null and SpeedI1 is not null)
select 'LapTime_s' as x, 'TyreLife' as y, round(corr(LapTime_s, TyreLife), 6) as r from c union all select 'LapTime_s', 'SpeedI1', round(corr(LapTime_s, SpeedI1), 6) from c union all select 'TyreLife', 'SpeedI1', round(corr(TyreLife, SpeedI1), 6) from c"""))
def h7_correlations(s, d):
    return profile.correlations(A.laps(s, d), ["LapTime_s", "TyreLife", "SpeedI1"]).withColumn("r", F.round(F.col("r") + TIE, 6))


@query(sql("laps", """select Driver as "group", count(*) as rows, round(quantile_cont(LapTime_s, 0.0), 6) as min, round(quantile_cont(LapTime_s, 0.25), 6) as q1, round(quantile_cont(LapTime_s, 0.5), 6) as median, round(quantile_cont(LapTime_s, 0.75), 6) as q3,
 round(quantile_cont(LapTime_s, 1.0), 6) as max from laps group by Driver order by rows desc, Driver limit 5"""))
def h8_group_boxes(s, d):
    return profile.group_boxes(A.laps(s, d), "Driver", "LapTime_s").select("group", "rows", *r6("min", "q1", "median", "q3", "max"))


@query(f"with e as (select l_quantity as x from lineitem), m as (select min(x)::double as lo, max(x)::double as hi from e) select {_BIN.format(n=60)} as bin, count(*) as rows from e, m where x is not null group by 1")
def h9_histogram(s, d):
    return profile.histogram(A.table(s, d, "lineitem"), "l_quantity")


@query(sql("res", f"select {S3}, round(avg(residual_s), 6) as bias_s, round(stddev_pop(residual_s), 6) as std_s from res group by all"))
def h10_residual_spread(s, d):
    return standings.residual_spread(res(s, d)).select(*SESSION, *r6("bias_s", "std_s"))


@query(sql("laps", "select event_id, Driver, LapTime_s from laps order by md5(cast(event_id as varchar) || ':42'), event_id limit 500"))
def h11_seeded_sample(s, d):
    return profile.seeded_sample(A.laps(s, d).select("event_id", "Driver", "LapTime_s"), ["event_id"], 500)


# --- set operations

@query("select l_suppkey as k, l_quantity as quantity, null::integer as size from lineitem union all select p_partkey, null, p_size from part")
def i3_union_by_name(s, d):
    a = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("quantity"))
    b = A.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query(sql("laps", f"select {S3}, LapNumber, Driver from (select *, row_number() over (partition by {S3}, LapNumber order by LapTime_s, event_id) as n from laps where LapTime_s is not null) where n <= 3"))
def i2_fastest_of_lap(s, d):
    return filters.first_of(A.laps(s, d).where("LapTime_s is not null"), [*SESSION, "LapNumber"], ["LapTime_s", "event_id"], 3).select(*SESSION, "LapNumber", "Driver")


# --- features and models

_HOT = ["HARD", "INTERMEDIATE", "MEDIUM", "None", "SOFT", "WET"]


@query(sql("laps", f"""select event_id, Compound, {', '.join(f'cast(coalesce(Compound, {chr(39)}None{chr(39)}) = {chr(39)}{v}{chr(39)} as integer)::double as "Compound_{v}"' for v in _HOT)} from laps"""))
def j1_one_hot(s, d):
    laps = A.laps(s, d).select("event_id", "Compound")
    hot = encode.OneHot(("Compound",)).fit(laps)
    return hot.transform(laps).select("event_id", "Compound", *(F.col(c).cast("double").alias(c) for c in hot.names()))


@query(sql("laps", "select event_id, Season, RoundNumber, LapNumber, Position, Stint, TyreLife, PitInTime_s, PitOutTime_s, SpeedI1, SpeedI2, SpeedFL, SpeedST, Sector3Time_s, LapTime_s from laps where LapTime_s is not null"))
def j2_feature_matrix(s, d):
    return encode.feature_matrix(A.laps(s, d))


def _seasons(s, d) -> DataFrame:
    """Laps with odd rounds counted as one season and even ones as the next."""
    return A.laps(s, d).withColumn("Season", 2024 + (F.col("RoundNumber") % 2 == 0).cast("int"))


@query(sql("laps", "select case when RoundNumber % 2 = 0 then 'test' else 'train' end as part, count(*) as n from laps group by all"))
def j3_j4_chronological_split(s, d):
    train, test, _ = encode.chronological_split(_seasons(s, d), [2023, 2024], 2025)
    names = encode.aligned_columns(train, test)
    count = lambda df, part: df.select(*names).agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(train, "train").union(count(test, "test"))


@query(sql("laps", "select event_id, TyreLife, null::double as missing, SpeedI1 from laps"))
def j5_reindexed(s, d):
    return encode.reindexed(A.laps(s, d), ["TyreLife", "missing", "SpeedI1"], keep=("event_id",))


_X = ["LapNumber", "TyreLife", "SpeedI1", "SpeedST", "Sector3Time_s"]


def _xy(s, d):
    return ml.dense(A.laps(s, d).where("LapTime_s is not null"), _X)


@query(sql("laps", "select event_id, round(LapTime_s, 4) as predicted from laps where LapTime_s is not null"))
def j6_linear_baseline(s, d):
    # A third of the target is a feature, so least squares must find the target itself.
    x, names = _xy(s, d)
    return ml.scored(ml.linear(names).fit(x), x, "predicted").select("event_id", F.round("predicted", 4).alias("predicted"))


@query()
def j7_j10_boosted_importances(s, d):
    x, names = _xy(s, d)
    return ml.importances(ml.fit_boosted(x, names), names, s)


@query(sql("laps", "select event_id, cast(floor((row_number() over (order by event_id) - 1) * 5.0 / count(*) over ()) as integer) as fold from laps where LapTime_s is not null"))
def j8_folds(s, d):
    return ml.folds(_xy(s, d)[0], ["event_id"]).select("event_id", "fold")


@query()
def j8_stacked(s, d):
    x, names = _xy(s, d)
    models = ml.stacked(x, names, ["event_id"], step=0.3, tol=0.01)
    return ml.predict_stacked(models, x, "predicted").select("event_id", "LapTime_s", "predicted")


@query()
def j9_search(s, d):
    x, names = _xy(s, d)
    return ml.searched(x, names, ["event_id"], [{"depth": n, "step": step} for n in (3, 5) for step in (0.1, 0.3)], rungs=2, tol=0.01)[1]


# As in j6 the target is found itself, so its band has no width.
@query(sql("laps", f"select event_id, Driver, {', '.join(f'round(LapTime_s, 4) as {c}' for c in ('predicted', 'predicted_p05', 'predicted_p50', 'predicted_p95'))} from laps where LapTime_s is not null"))
def j11_j12_save_load_quantiles(s, d):
    x, names = _xy(s, d)
    path = _store(s)
    ml.linear(names).fit(x).write().save(path)
    out = ml.scored(ml.PipelineModel.load(path), x, "predicted")
    band = ml.quantile_band(out, out, "predicted", "Driver")
    return band.select("event_id", "Driver", *(F.round(c, 4).alias(c) for c in ("predicted", "predicted_p05", "predicted_p50", "predicted_p95")))


@query(sql("preds", f""", q as (select Driver, quantile_cont(LapTime_s - pred_s, [0.05, 0.5, 0.95]) as q from preds where LapTime_s is not null and pred_s is not null group by all)
select {S4}, LapNumber, {q6('least(pred_s + coalesce(q[1], 0), pred_s + coalesce(q[2], 0))').split(' as ')[0]} as pred_s_p05, round(pred_s + coalesce(q[2], 0), 6) as pred_s_p50, round(greatest(pred_s + coalesce(q[3], 0), pred_s + coalesce(q[2], 0)), 6) as pred_s_p95
from preds left join q using (Driver)"""))
def j12_quantile_band(s, d):
    own = preds(s, d).drop("pred_p05", "pred_p95")
    return ml.quantile_band(own, own, "pred_s", "Driver").select(*K4, "LapNumber", *r6("pred_s_p05", "pred_s_p50", "pred_s_p95"))


# The quantile lines find the target itself too, and no held-out row lies outside them.
@query(sql("laps", f"select event_id, {', '.join(f'round(LapTime_s, 3) as {c}' for c in ('predicted_p05', 'predicted_p50', 'predicted_p95'))} from laps where LapTime_s is not null"))
def j12_calibrated_band(s, d):
    x, names = _xy(s, d)
    return ml.calibrated_band(x, x, names, ["event_id"]).select("event_id", *(F.round(c, 3).alias(c) for c in ("predicted_p05", "predicted_p50", "predicted_p95")))


@query(sql("laps", """, w as (select event_id, LapTime_s, exp(-0.07 * ((2025 - Season) * 24 + (1 - RoundNumber))) as r from laps where LapTime_s is not null)
select event_id, round(r / (select avg(r) from w), 6) as weight, round(LapTime_s, 4) as predicted from w"""))
def j13_weighted_fit(s, d):
    x, names = _xy(s, d)
    x = scalar.recency_weights(x, 2025, 1)
    out = ml.scored(ml.linear(names, weight="weight").fit(x), x, "predicted")
    return out.select("event_id", *r6("weight"), F.round("predicted", 4).alias("predicted"))


# --- artifacts

@query(sql("grid", f"select {S4}, lap, position from grid"))
def k1_lap_positions(s, d):
    laps = A.laps(s, d)
    return artifacts.lap_positions(laps, A.results(s, d), standings.total_laps(laps))


@query(sql("ordered results", f"""select o.Season, o.RoundNumber, o.SessionType, o.Driver, cast(lap as integer) as lap, cast(round_even(case when GridPosition > 0 then GridPosition else 20 end + (coalesce(predicted_position, 20) - case when GridPosition > 0 then GridPosition else 20 end) * lap / 57, 0) as integer) as position
 from ordered o left join results r on r.Season = o.Season and r.RoundNumber = o.RoundNumber and r.Abbreviation = o.Driver, range(1, 58) t(lap)"""))
def k2_predicted_positions(s, d):
    return artifacts.predicted_positions(joins.add_grid(ordered(s, d), A.results(s, d)), 57)


_DRIVERS = [f"D{i:02d}" for i in range(20)]


@query(sql("grid", f"select {S3}, lap, {', '.join(f"max(position) filter (Driver = '{x}') as {x}" for x in _DRIVERS)} from grid group by all"))
def k3_pivot(s, d):
    laps = A.laps(s, d)
    return artifacts.pivot_laps(artifacts.lap_positions(laps, A.results(s, d), standings.total_laps(laps)), _DRIVERS)


@query(sql("results", f"select {S3}, count(*) as n, string_agg(Abbreviation, ',' order by Position) as drivers from results group by all"))
def k4_official_results(s, d):
    out = artifacts.official_results(A.results(s, d))
    return out.select(*SESSION, F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda x: x["driver"]), ",").alias("drivers"))


# --- whole jobs

_SPEEDS = ["SpeedI1", "SpeedI2", "SpeedFL", "SpeedST"]


@query(sql("clean", f"select * exclude (Time) replace ({q6(*_SPEEDS)}) from clean"))
def l1_run_cleaning(s, d):
    return pipelines.run_cleaning(A.laps(s, d), store=True).drop("Time").withColumns(dict(zip(_SPEEDS, r6(*_SPEEDS))))


def _over_clean(name: str, needs: str = "laps") -> str:
    """The SQL of another query, over clean laps."""
    body = ORACLE_SQL[name].removeprefix(sql(needs, "").replace(", 6)", f" + {TIE}, 6)")).replace(f" + {TIE}, 6)", ", 6)")
    return f"(with laps as (select * from clean) {body})"


_STEPS = {
    "f1_rolling_pace": "laps", "f2_gap_to_fastest": "laps", "f4_tyre_life_norm": "laps", "f5_e7_track_evolution": "laps", "f6_brake_wear": "laps", "c7_strain_index": "laps weather",
    "e1_weather_as_of": "laps weather", "e5_historical_points": "laps results", "e6_grid_join": "laps results",
}
_ROUND6 = ["roll_laptime_3", "roll_laptime_5", "roll_std_3", "delta_roll_pace", "delta_to_fastest_s", "tyre_life_norm", "track_evolution_factor", "pu_strain_index"]
_L2 = ", ".join(["", *(f"{n} as {_over_clean(n, needs)}" for n, needs in _STEPS.items()), f"f3 as (select event_id, tyre_deg_slope from {_over_clean('f3_degradation_slope')})"])
_L2 += f""" select * exclude (Time) replace ({q6(*_SPEEDS)}), cast(GridPosition <= 2 as integer) as is_front_row, cast(GridPosition <= 10 as integer) as is_top10_start, GridPosition - 1 as grid_gap_to_pole,
 {', '.join(f"cast(coalesce(Compound, 'None') = '{v}' as integer) as Compound_{v}" for v in _HOT)}, {', '.join(f"cast(Team = 'T{i}' as integer) as Team_T{i}" for i in range(10))}
 from clean {' '.join(f'join {n} using (event_id)' for n in [*_STEPS, 'f3'])}"""


@query(sql("clean weather results", _L2))
def l2_run_features(s, d):
    laps = A.laps(s, d)
    hot = encode.OneHot(("Compound", "Team")).fit(laps)
    out = pipelines.clean_features(laps, A.weather(s, d), A.results(s, d), encoder=hot).drop("Time")
    shown = {c: F.round(F.col(c) + TIE, 6) for c in [*_SPEEDS, *_ROUND6]} | {"tyre_deg_slope": F.round("tyre_deg_slope", 5), "brake_wear_proxy": F.round(F.col("brake_wear_proxy") + 1e-7, 4)}
    return out.withColumns(shown | {c: F.col(c).cast("double") for c in ("DriverPointsPreRace", "TeamPointsPreRace")})


@query(sql("laps", f"select {S3}, count(*) as laps, count(*) filter (SpeedI1 > 295) as violations, count(*) filter (SpeedI1 > 295) = 0 as success from laps group by all"))
def l3_ingest(s, d):
    rules = [validate.Rule("Driver", "string", True, length=(2, 3)), validate.Rule("SpeedI1", "double", low=0, high=295)]
    return pipelines.ingest(A.laps(s, d), None, rules)[1]


@query()
def l4_predict_season(s, d):
    return pipelines.predict_season(_seasons(s, d), [2024], 2025, step=0.3, tol=0.01)


# Least squares finds that a lap is three times its third sector; a lap without a time has 0 there.
@query(sql("laps", f"select 2025 as Season, RoundNumber, SessionType, EventName, Driver, Team, LapNumber, round(coalesce(LapTime_s, 0), 3) as predicted_laptime_linear_s, round(coalesce(LapTime_s, 0), 3) as predicted_laptime_ensemble_s from laps where RoundNumber % 2 = 0"))
def l4_linear_season(s, d):
    out = pipelines.predict_season(_seasons(s, d), [2024], 2025, models=("linear",), ridge=0.0)
    return out.withColumns({c: F.round(F.col(c) + 0.0, 3) for c in ("predicted_laptime_linear_s", "predicted_laptime_ensemble_s")})


@query(sql("res", _G5))
def l5_validate_race(s, d):
    out = pipelines.validate_race(preds(s, d), A.laps(s, d), "pred_p05", "pred_s", "pred_p95")
    return out.select(*SESSION, *r6("mae", "rmse", "coverage_pct"), "accuracy", "retrain")
