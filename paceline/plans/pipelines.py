"""Jobs over all sessions at once: cleaning, features, season predictions, race audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import scalar
from paceline.operators import encode, features, filters, impute, joins, ml, standings, validate
from paceline.session import SESSION, session_keys
from paceline.sources.scratch import written


def run_cleaning(raw: DataFrame, store: bool = False) -> DataFrame:
    """Raw laps to clean laps: seconds, names, filters, fills.

    The rows are dealt out by session and driver once; all windows of the filters and fills keep to that.  What is left of the
    session is a median of each speed, an aggregate joined back; with ``store`` the rows are written before it, so that filters and fills run once.
    """
    laps = scalar.standard_teams(scalar.standard_drivers(scalar.times_to_seconds(raw)))
    if keys := [*session_keys(laps), *(["Driver"] if "Driver" in laps.columns else [])]:
        laps = laps.repartition(*keys)
    return impute.impute(filters.apply_filters(laps), store=store)


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Raw and kept laps by session, and retention in per cent."""
    laps = scalar.standard_drivers(scalar.times_to_seconds(raw))
    return filters.filter_report(laps).select(*session_keys(laps), F.col("total_laps").alias("raw_rows"), F.col("kept_laps").alias("clean_rows"), "retention_pct")


def run_features(clean: DataFrame, weather: DataFrame, results: DataFrame, strain_before_weather: bool = False, encoder: encode.OneHot | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Clean laps to the feature matrix.

    Track evolution comes first, from a narrow table of lap times, then the as-of join, in time buckets of ``bucket_seconds`` so that a long
    series spreads.  Then rows are dealt out by session and driver once; the windows keep to that, and further joins are with small tables.
    """
    laps = features.track_evolution(clean)
    laps = scalar.strain_index(laps) if strain_before_weather else laps
    laps = joins.add_weather(laps, weather, bucket_seconds=bucket_seconds)
    laps = laps.repartition(*session_keys(laps), "Driver")
    laps = laps if strain_before_weather else scalar.strain_index(laps)
    laps = features.gap_to_fastest(features.rolling_pace(laps))
    laps = features.normalised_tyre_life(features.degradation_slope(laps))
    laps = features.brake_wear(laps)
    results = scalar.standard_teams(results, "TeamName") if "TeamName" in results.columns else results
    laps = scalar.grid_flags(joins.add_grid(joins.add_points(laps, results), results))
    return encoder.transform(laps) if encoder else laps


def clean_features(raw: DataFrame, weather: DataFrame, results: DataFrame, **options) -> DataFrame:
    """Raw laps to the feature matrix; ``options`` as in ``run_features``.

    Features read the clean laps three times, twice for a few columns.  They are written once, so that cleaning, which
    shuffles whole rows, is not run for each.
    """
    return run_features(written(run_cleaning(raw, store=True), "clean-laps"), weather, results, **options)


def ingest(raw: DataFrame, rounds: list[int] | None = None, rules: list[validate.Rule] = validate.LAPS) -> tuple[DataFrame, DataFrame]:
    """(rows of sessions without a violation, one row per session with its number of violations and success)."""
    rows = raw if rounds is None else raw.where(F.col("RoundNumber").isin(rounds))
    bad = validate.violations(rows, rules, SESSION).groupBy(*SESSION).agg(F.count("*").alias("violations"))
    status = rows.groupBy(*SESSION).agg(F.count("*").alias("laps")).join(bad, SESSION, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    status = status.withColumn("success", F.col("violations") == 0)
    return validate.coerce(rows.join(status.where("success").select(*SESSION), SESSION, "left_semi"), rules), status


def predict_season(gold: DataFrame, train_seasons: list[int], test_season: int, models: tuple[str, ...] = ("linear", "boosted"), ridge: float = 0.01, **options) -> DataFrame:
    """Predictions of the test season by models of the training seasons, with their ensemble; ``options`` go to the boosted one."""
    train, test, _ = encode.chronological_split(gold, train_seasons, test_season)
    names = encode.aligned_columns(train, test)
    train = train.where(F.col(ml.TARGET).isNotNull())
    x, cols = ml.dense(train, names)
    out, _ = ml.dense(test, names)
    fits = {"linear": lambda: ml.linear(cols, ridge=ridge).fit(x), "boosted": lambda: ml.fit_boosted(x, cols, **options)}
    told = {m: f"predicted_laptime_{m}_s" for m in models}
    for m, column in told.items():
        out = ml.scored(fits[m](), out, column)
    out = scalar.ensemble(out, list(told.values()))
    return out.select(*SESSION, "EventName", "Driver", "Team", "LapNumber", *told.values(), "predicted_laptime_ensemble_s")


def validate_race(preds: DataFrame, laps: DataFrame, lower: str, middle: str, upper: str) -> DataFrame:
    """Errors by session of predicted against actual pace, and whether to train anew."""
    return standings.residual_metrics(standings.residuals(standings.bounded_standings(preds, lower, middle, upper), laps))
