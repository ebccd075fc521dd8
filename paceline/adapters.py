"""Session tables over the test tables: laps, weather, results and schedules made from ``events``, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import points_for

COMPOUNDS = {"signup": "SOFT", "purchase": "MEDIUM", "error": "HARD", "view": "INTERMEDIATE", "click": "WET"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unless(divisor: int, value):
    return F.when(F.col("event_id") % divisor != 0, value)


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    base = ev.select(
        "event_id", F.year("ts").alias("Season"), F.dayofmonth("ts").alias("RoundNumber"), F.lit("R").alias("SessionType"),
        F.concat(F.lit("GP "), (F.dayofmonth("ts") % 24).cast("string")).alias("EventName"),
        F.concat(F.lit("D"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("Driver"),
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("Team"),
        F.expr("element_at(array('Oracle Red Bull Racing','Mercedes-AMG Petronas','Scuderia Ferrari HP','McLaren','Unknown Works'), cast(user_id % 5 as int) + 1)").alias("TeamRaw"),
        F.col("ts").alias("Time"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("user_id") % 20).alias("u"),
    )
    w = Window.partitionBy("Season", "RoundNumber", "Driver").orderBy("Time", "event_id")
    base = base.withColumn("LapNumber", F.row_number().over(w))
    base = base.withColumn("Position", F.row_number().over(Window.partitionBy("Season", "RoundNumber", "LapNumber").orderBy("Time", "event_id")))
    n = F.col("LapNumber")
    return base.select(
        "event_id", "Season", "RoundNumber", "SessionType", "EventName", "Driver", "Team", "TeamRaw", "LapNumber", "Position", "Time",
        unless(23, F.floor((n - 1) / 6).cast("int") + 1).alias("Stint"), unless(13, ((n - 1) % 6 + 1).cast("double")).alias("TyreLife"),
        unless(11, F.create_map(*(F.lit(x) for p in COMPOUNDS.items() for x in p))[F.col("event_type")]).alias("Compound"),
        unless(29, 45 + F.col("value")).alias("LapTime_s"), unless(29, (45 + F.col("value")) / 3).alias("Sector3Time_s"),
        F.when(F.col("event_id") % 17 == 0, F.col("value")).alias("PitInTime_s"), F.when(F.col("event_id") % 19 == 0, F.col("value")).alias("PitOutTime_s"),
        F.expr("case event_id % 8 when 5 then '2' when 6 then '4' when 7 then '6' else '1' end").alias("TrackStatus"),
        unless(7, 200 + F.col("k")).alias("SpeedI1"), unless(5, 190 + F.col("k")).alias("SpeedI2"), unless(3, 210 + F.col("k")).alias("SpeedFL"),
        F.when(F.col("u") != 7, 220 + F.col("k")).alias("SpeedST"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.year("ts").alias("Season"), F.dayofmonth("ts").alias("RoundNumber"), F.lit("R").alias("SessionType"), F.col("ts").alias("Time"), F.col("value").alias("AirTemp"),
        (F.col("value") / 10 + 10).alias("TrackTemp"), k.alias("Humidity"), (F.col("event_id") % 2 == 0).alias("Rainfall"), (F.col("value") / 10).alias("WindSpeed"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy(
        F.year("ts").alias("Season"), F.dayofmonth("ts").alias("RoundNumber"), F.lit("R").alias("SessionType"),
        F.concat(F.lit("D"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("Abbreviation"), F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("TeamName"),
    ).agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.min("value").alias("least"), F.count("*").alias("n"))
    by = Window.partitionBy("Season", "RoundNumber")
    out = own.withColumns({"p": F.row_number().over(by.orderBy(F.desc("total"), "Abbreviation")), "g": F.row_number().over(by.orderBy(F.desc("most"), "Abbreviation"))})
    return out.select(
        "Season", "RoundNumber", "SessionType", "Abbreviation", "TeamName", F.col("p").cast("double").alias("Position"), F.when(F.col("n") % 7 != 0, F.col("g").cast("double")).alias("GridPosition"),
        points_for(F.col("p")).cast("double").alias("Points"), F.when(F.col("p") % 7 == 0, "Retired").otherwise("Finished").alias("Status"),
        F.when(F.col("p") == 1, 5400 + F.col("p") * 1.5).when(F.col("p") % 7 != 0, F.col("p") * 1.5).alias("Time"),
        (60 + F.col("least")).alias("Q1"), F.when(F.col("p") <= 15, 59 + F.col("least")).alias("Q2"), F.when(F.col("p") <= 10, 58 + F.col("least")).alias("Q3"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day of the events but those that 5 divides; every seventh is a test."""
    return table(spark, sf_dir, "events").where(F.dayofmonth("ts") % 5 != 0).groupBy(F.year("ts").alias("Season"), F.dayofmonth("ts").alias("RoundNumber")).agg(F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz").alias("EventDate")).select(
        "Season", "RoundNumber", F.concat(F.lit("GP "), (F.col("RoundNumber") % 24).cast("string")).alias("EventName"), "EventDate", F.when(F.col("RoundNumber") % 7 == 0, "testing").otherwise("conventional").alias("EventFormat"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track data by event name, from the suppliers' keys; the events meet those of their own names."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("GP "), s.cast("string")).alias("EventName"), F.expr("element_at(array('Street','Permanent','Hybrid','Other'), cast(s_suppkey % 4 as int) + 1)").alias("TrackType"),
        F.expr("element_at(array('Ultra-Low','Low','Medium','High','Ultra-High'), cast(s_suppkey % 5 as int) + 1)").alias("DownforceLevel"), (s % 5 + 1).cast("int").alias("Abrasiveness"),
        (0.5 + s / 100).cast("double").alias("FullThrottlePct"), (200 + s).cast("double").alias("AvgSpeed_kph"), (300 + s).cast("double").alias("MaxSpeed_kph"), (10 + s % 9).cast("int").alias("CornerCount"),
    )


_K = "cast(regexp_extract(props, '([0-9]+)', 1) as double)"
SQL = {
    "laps": f"""laps0 as (
 select event_id, cast(year(ts) as integer) as Season, cast(day(ts) as integer) as RoundNumber, 'R' as SessionType, 'GP ' || cast(day(ts) % 24 as varchar) as EventName,
  'D' || lpad(cast(user_id % 20 as varchar), 2, '0') as Driver, 'T' || cast(user_id % 10 as varchar) as Team,
  (['Oracle Red Bull Racing','Mercedes-AMG Petronas','Scuderia Ferrari HP','McLaren','Unknown Works'])[user_id % 5 + 1] as TeamRaw,
  ts as Time, event_type, value, {_K} as k, user_id % 20 as u from events),
laps1 as (select *, cast(row_number() over (partition by Season, RoundNumber, Driver order by Time, event_id) as integer) as LapNumber from laps0),
laps as (select event_id, Season, RoundNumber, SessionType, EventName, Driver, Team, TeamRaw, LapNumber,
  cast(row_number() over (partition by Season, RoundNumber, LapNumber order by Time, event_id) as integer) as Position, Time,
  case when event_id % 23 <> 0 then cast((LapNumber - 1) // 6 + 1 as integer) end as Stint, case when event_id % 13 <> 0 then cast((LapNumber - 1) % 6 + 1 as double) end as TyreLife,
  case when event_id % 11 <> 0 then case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in COMPOUNDS.items())} end end as Compound,
  case when event_id % 29 <> 0 then 45 + value end as LapTime_s, case when event_id % 29 <> 0 then (45 + value) / 3 end as Sector3Time_s,
  case when event_id % 17 = 0 then value end as PitInTime_s, case when event_id % 19 = 0 then value end as PitOutTime_s,
  case event_id % 8 when 5 then '2' when 6 then '4' when 7 then '6' else '1' end as TrackStatus,
  case when event_id % 7 <> 0 then 200 + k end as SpeedI1, case when event_id % 5 <> 0 then 190 + k end as SpeedI2, case when event_id % 3 <> 0 then 210 + k end as SpeedFL,
  case when u <> 7 then 220 + k end as SpeedST from laps1)""",
    "weather": f"""weather as (select cast(year(ts) as integer) as Season, cast(day(ts) as integer) as RoundNumber, 'R' as SessionType, ts as Time, value as AirTemp, value / 10 + 10 as TrackTemp,
  {_K} as Humidity, event_id % 2 = 0 as Rainfall, value / 10 as WindSpeed from events where event_type = 'view')""",
    "results": """results0 as (select cast(year(ts) as integer) as Season, cast(day(ts) as integer) as RoundNumber, 'R' as SessionType, 'D' || lpad(cast(user_id % 20 as varchar), 2, '0') as Abbreviation,
  'T' || cast(user_id % 10 as varchar) as TeamName, round(sum(value), 4) as total, max(value) as most, min(value) as least, count(*) as n from events group by 1, 2, 3, 4, 5),
results1 as (select *, row_number() over (partition by Season, RoundNumber order by total desc, Abbreviation) as p, row_number() over (partition by Season, RoundNumber order by most desc, Abbreviation) as g from results0),
results as (select Season, RoundNumber, SessionType, Abbreviation, TeamName, cast(p as double) as Position, case when n % 7 <> 0 then cast(g as double) end as GridPosition,
  cast(case when p <= 10 then ([25,18,15,12,10,8,6,4,2,1])[p] else 0 end as double) as Points, case when p % 7 = 0 then 'Retired' else 'Finished' end as Status,
  cast(case when p = 1 then 5400 + p * 1.5 when p % 7 <> 0 then p * 1.5 end as double) as Time, 60 + least as Q1, case when p <= 15 then 59 + least end as Q2, case when p <= 10 then 58 + least end as Q3 from results1)""",
    "schedule": """schedule as (select Season, RoundNumber, 'GP ' || cast(RoundNumber % 24 as varchar) as EventName, EventDate, case when RoundNumber % 7 = 0 then 'testing' else 'conventional' end as EventFormat
  from (select cast(year(ts) as integer) as Season, cast(day(ts) as integer) as RoundNumber, min(cast(date_trunc('day', ts) as timestamp)) as EventDate from events where day(ts) % 5 <> 0 group by 1, 2))""",
    "tracks": """tracks as (select 'GP ' || cast(s_suppkey as varchar) as EventName, (['Street','Permanent','Hybrid','Other'])[s_suppkey % 4 + 1] as TrackType,
  (['Ultra-Low','Low','Medium','High','Ultra-High'])[s_suppkey % 5 + 1] as DownforceLevel, cast(s_suppkey % 5 + 1 as integer) as Abrasiveness, cast(0.5 + s_suppkey / 100 as double) as FullThrottlePct,
  cast(200 + s_suppkey as double) as AvgSpeed_kph, cast(300 + s_suppkey as double) as MaxSpeed_kph, cast(10 + s_suppkey % 9 as integer) as CornerCount from supplier)""",
    # Chains of further steps, each a table that later ones read.
    "tag0": """tag0 as (select *, case when LapTime_s is null or not (LapTime_s between 50 and 600) then 'impossible' when PitOutTime_s is not null then 'out_lap' when PitInTime_s is not null then 'in_lap'
  when TrackStatus in ('2','4','5','6','7') then 'neutralised' end as r0 from laps),
tag1 as (select *, case when r0 is null then LapTime_s end as t0 from tag0),
tag2 as (select *, median(t0) over g as md, count(t0) over g as n from tag1 window g as (partition by Season, RoundNumber, SessionType, Driver, Stint)),
tag3 as (select *, median(abs(t0 - md)) over (partition by Season, RoundNumber, SessionType, Driver, Stint) as mad from tag2),
tagged as (select * exclude (r0, t0, md, n, mad), coalesce(r0, case when Stint is not null and n >= 4 and mad > 0 and t0 - md > 2.5 * 1.4826 * mad then 'outlier' end, 'kept') as rule from tag3)""",
    "filled": """fs as (select * replace (coalesce(Stint, last_value(Stint ignore nulls) over (w rows between unbounded preceding and current row), first_value(Stint ignore nulls) over (w rows between current row and unbounded following)) as Stint)
  from laps where LapTime_s is not null window w as (partition by Season, RoundNumber, SessionType, Driver order by LapNumber)),
ft as (select * replace (case when Stint is null then TyreLife else coalesce(TyreLife, last_value(TyreLife ignore nulls) over (w rows between unbounded preceding and current row), first_value(TyreLife ignore nulls) over (w rows between current row and unbounded following)) end as TyreLife)
  from fs window w as (partition by Season, RoundNumber, SessionType, Driver, Stint order by LapNumber)),
fm as (select Season, RoundNumber, Driver, Stint, Compound from (select *, row_number() over (partition by Season, RoundNumber, Driver, Stint order by c desc, Compound) as rn from
  (select Season, RoundNumber, Driver, Stint, Compound, count(*) as c from ft where Compound is not null and Stint is not null group by all)) where rn = 1),
fc as (select ft.* replace (coalesce(ft.Compound, fm.Compound) as Compound) from ft left join fm using (Season, RoundNumber, Driver, Stint)),
sg as (select Season, RoundNumber, Driver, EventName, median(SpeedI1) as a, median(SpeedI2) as b, median(SpeedFL) as c, median(SpeedST) as d from fc group by all),
sf as (select fc.* replace (coalesce(SpeedI1, a) as SpeedI1, coalesce(SpeedI2, b) as SpeedI2, coalesce(SpeedFL, c) as SpeedFL, coalesce(SpeedST, d) as SpeedST) from fc left join sg using (Season, RoundNumber, Driver, EventName)),
ss as (select Season, RoundNumber, median(SpeedI1) as a, median(SpeedI2) as b, median(SpeedFL) as c, median(SpeedST) as d from sf group by all),
filled as (select sf.* replace (coalesce(SpeedI1, a) as SpeedI1, coalesce(SpeedI2, b) as SpeedI2, coalesce(SpeedFL, c) as SpeedFL, coalesce(SpeedST, d) as SpeedST) from sf left join ss using (Season, RoundNumber))""",
    "preds": """preds0 as (select *, avg(LapTime_s) over (partition by Season, RoundNumber, SessionType, Driver, Stint order by LapNumber rows between 4 preceding and current row) as r5 from laps where Stint is not null),
preds as (select Season, RoundNumber, SessionType, EventName, Driver, Team, LapNumber, LapTime_s, r5 as pred_s, r5 - 5 as pred_p05, r5 + 5 as pred_p95 from preds0)""",
    "bounded": """bounded0 as (select Season, RoundNumber, SessionType, Driver, Team, median(pred_p05) as lo, median(pred_s) as median_predicted_s, median(pred_p95) as hi from preds group by all having median(pred_s) is not null),
bounded as (select Season, RoundNumber, SessionType, Driver, Team, least(lo, median_predicted_s) as lower_bound_s, median_predicted_s, greatest(hi, median_predicted_s) as upper_bound_s,
  row_number() over (partition by Season, RoundNumber, SessionType order by median_predicted_s, Driver) as rank from bounded0)""",
    "actual": """actual as (select Season, RoundNumber, SessionType, Driver, median(LapTime_s) as actual_median_s from laps where PitInTime_s is null and PitOutTime_s is null and LapTime_s is not null group by all)""",
    "res": """res as (select bounded.*, actual_median_s, actual_median_s - median_predicted_s as residual_s, abs(actual_median_s - median_predicted_s) as abs_error_s, actual_median_s between lower_bound_s and upper_bound_s as in_range
  from bounded join actual using (Season, RoundNumber, SessionType, Driver))""",
    "ordered": """ordered as (select *, row_number() over (partition by Season, RoundNumber, SessionType order by median_predicted_s, Driver) as predicted_position from bounded)""",
    "stints": """stints0 as (select Season, RoundNumber, SessionType, Driver, Stint, upper(Compound) as compound, count(*) as laps, min(LapNumber) as first_lap from laps where Stint is not null and Compound is not null group by all),
stints as (select Season, RoundNumber, SessionType, Driver, row_number() over (partition by Season, RoundNumber, SessionType, Driver order by first_lap, Stint, compound) as stint_no, Stint, compound, laps, first_lap from stints0)""",
    "totals": """totals as (select Season, RoundNumber, SessionType, coalesce(max(LapNumber), 50) as total_laps from laps group by all)""",
    "grid": """grid as (select d.Season, d.RoundNumber, d.SessionType, d.Driver, cast(d.lap as integer) as lap, cast(case when d.lap = d.total_laps then coalesce(r.Position, 22) else coalesce(l.Position, 22) end as integer) as position
  from (select *, unnest(range(1, total_laps + 1)) as lap from (select distinct Season, RoundNumber, SessionType, Driver from laps) join totals using (Season, RoundNumber, SessionType)) d
  left join laps l on l.Season = d.Season and l.RoundNumber = d.RoundNumber and l.Driver = d.Driver and l.LapNumber = d.lap
  left join results r on r.Season = d.Season and r.RoundNumber = d.RoundNumber and r.Abbreviation = d.Driver)""",
}
# The same fills over the laps that the filters keep.
SQL["clean"] = re.sub(r"\b(fs|ft|fm|fc|sg|sf|ss)\b", r"c\1", SQL["filled"]).replace("filled as (", "clean as (").replace("from laps where LapTime_s is not null", "from (select * exclude (rule) from tagged where rule = 'kept')")
_NEEDS = {
    "clean": ["tag0"],
    "tag0": ["laps"], "filled": ["laps"], "preds": ["laps"], "bounded": ["preds"], "actual": ["laps"], "res": ["bounded", "actual"], "ordered": ["bounded"], "stints": ["laps"], "totals": ["laps"],
    "grid": ["totals", "results"],
}


def sql(needs: str, body: str) -> str:
    """``body`` after the tables that it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    return "with " + ",\n".join(SQL[n] for n in order) + "\n" + body
