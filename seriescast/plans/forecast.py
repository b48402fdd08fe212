"""Recursive multi-step forecasts for all series at once.

Each step derives features for the last bar of every series, scores them, and appends a
synthetic bar.  Only a tail of each series takes part: as many rows as the longest window
reaches back, plus the exponential averages carried into it.  What a step adds is written
to the shared folder, so neither the plan nor the recovery after a lost executor grows
with the horizon.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.functions.calendar import business_days, calendar_days
from seriescast.operators import scale, split
from seriescast.operators import windows as W
from seriescast.operators.ema import Ema, emas, seeded_emas
from seriescast.operators.layout import blocks, in_order, index_series, own_rows
from seriescast.operators.metrics import draws_interval, historical_volatility
from seriescast.operators.quantiles import exact_quantiles
from seriescast.plans import recipes as R
from seriescast.plans.models import TrainedModel, flatten_sequences, tree_predictions
from seriescast.sources.storage import fresh_path, materialize

ATR = Ema("true_range", "atr_14", 1 / 14)
SIGNAL = Ema.span("macd", "macd_signal", 9)
SEEDS = [*(s.name for s in R.CLOSE_EMAS), "macd_signal", "atr_14"]
STATE = ["ticker", "pos", "ds", "open", "high", "low", "close", "green_day"]

BarRule = Callable[[], dict[str, Column]]


def clamped_bar() -> dict[str, Column]:
    """Forest rule: yesterday's body shifted to open at yesterday's close."""
    opening = F.col("close")
    return {
        "open": opening,
        "high": F.greatest(opening + (F.col("high") - F.col("open")), opening),
        "low": F.least(opening - (F.col("open") - F.col("low")), opening),
        "green_day": (F.col("prediction") > F.col("close")).cast("int"),
    }


def spread_bar() -> dict[str, Column]:
    """Boosted rule: one percent around the prediction, the day's colour carried forward."""
    p, opening = F.col("prediction"), F.col("close")
    return {
        "open": opening,
        "high": F.greatest(p * 1.01, opening, p),
        "low": F.least(p * 0.99, opening, p),
        "green_day": F.col("green_day"),
    }


def volatile_bar() -> dict[str, Column]:
    """Return-model rule: half the historical volatility around the prediction."""
    p = F.col("prediction")
    return {
        "open": F.col("close"),
        "high": p * (1 + F.col("daily_range")),
        "low": p * (1 - F.col("daily_range")),
        "green_day": F.col("green_day"),
    }


BAR_RULES: dict[str, BarRule] = {"rf": clamped_bar, "xgb": spread_bar, "seq": volatile_bar}


def tail_rows(model: TrainedModel) -> int:
    return 64 + model.n_lags + model.sequence_length + 2


def _seeds(indexed: DataFrame, rows: int, kind: str, n_lags: int) -> DataFrame:
    """Exponential averages one row before each tail; series shorter than a tail have none."""
    source = indexed.select("ticker", "pos", "n_rows", "close")
    at = F.col("pos") == F.col("n_rows") - rows - 1
    framed = emas(blocks(indexed, 1), R.CLOSE_EMAS, source)
    if kind == "seq":
        ranged = own_rows(blocks(indexed, 1).withColumn("true_range", F.expr(W.true_range())))
        framed = emas(framed.withColumn("true_range", F.expr(W.true_range())), [ATR], ranged)
    framed = own_rows(framed)
    if kind == "rf":
        deep = framed.withColumn("lag_depth", F.expr(W.lag_depth(n_lags))).where("pos >= lag_depth")
        framed = R.add_macd(deep, source.withColumn("lag_depth", F.expr(W.lag_depth(n_lags))), R.BLOCK)
    null = F.lit(None).cast("double")
    return framed.where(at).select("ticker", *[
        (F.col(s) if s in framed.columns else null).alias(f"{s}_seed") for s in SEEDS])


def start_state(bars: DataFrame, model: TrainedModel) -> tuple[DataFrame, DataFrame]:
    """The tails with ``green_day``, and one row of constants per series."""
    indexed = index_series(bars)
    if indexed is not bars:
        indexed = materialize(indexed, "history")
    rows = tail_rows(model)
    framed = blocks(indexed, 1)
    if "green_day" not in indexed.columns:
        framed = W.add(framed, {"green_day": W.green_day()})
    # one row more than the tail, so that its first row still has a row before it
    tails = split.tail(own_rows(framed), rows + 1)
    keep = [*STATE, *(["volume"] if "volume" in bars.columns else [])]
    constants = (
        split.last_row(indexed).select(
            "ticker", "n_rows", F.col("ds").alias("last_ds"),
            F.greatest(F.col("n_rows") - rows, F.lit(0)).alias("tail_start"))
        .join(_seeds(indexed, rows, model.kind, model.n_lags), "ticker", "left")
        .join(historical_volatility(indexed).select("ticker", "daily_range"), "ticker", "left")
    )
    return materialize(tails.select(*keep), "tails"), materialize(constants, "constants")


def _features(tails: DataFrame, model: TrainedModel) -> DataFrame:
    """The recipe of the model on tails; positions are those of the whole series."""
    in_tail = F.col("pos") >= F.col("tail_start")
    frame = tails.withColumn("blk", F.lit(0))
    if model.kind == "seq":
        frame = frame.withColumn("true_range", F.expr(W.true_range())).where(in_tail)
        frame = seeded_emas(frame, [*R.CLOSE_EMAS, ATR])
        return R.trim_to_lags(R.seq_columns(R.base_columns(frame), "close"), "close", model.n_lags)
    frame = frame.where(in_tail)
    frame = R.trim_to_lags(R.base_columns(seeded_emas(frame, R.CLOSE_EMAS)), "close", model.n_lags)
    if model.kind == "xgb":
        return R.xgb_columns(frame, R.XGB_HORIZONS)
    frame = R.rf_columns(frame, R.RF_HORIZONS).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    # a tail that begins before the first kept row starts its signal there
    return seeded_emas(frame, [SIGNAL], start=F.col("lag_depth")).withColumn(
        "macd_histogram", F.col("macd") - F.col("macd_signal"))


def _one_row_each(rows: DataFrame) -> DataFrame:
    """Scoring rows as series of length one, so that scaler look-ups need one block only."""
    return rows.withColumns({"pos": F.lit(0).cast("long"), "n_rows": F.lit(1).cast("long")})


def predict_next(tails: DataFrame, model: TrainedModel) -> DataFrame:
    """``ticker, prediction, lower_bound, upper_bound`` for the bar after each tail.

    A series too short to have every feature of the model gets no forecast.
    """
    last = F.col("pos") == F.col("n_rows") - 1
    features = _features(tails, model)
    if model.kind == "seq":
        length, width = model.sequence_length, len(model.names)
        scored = _sequence_returns(features, model, length, width)
        return scored.select("ticker", *[
            (F.col("last_close") * F.exp(c)).alias(c) for c in ("prediction", "lower_bound", "upper_bound")])
    complete = features.where(last).select("ticker", "pos", "n_rows", *model.names).dropna()
    if model.kind == "xgb":
        p = model.score(_one_row_each(complete))
        return p.select("ticker", F.col("yhat").alias("prediction"), F.col("yhat").alias("lower_bound"),
                        F.col("yhat").alias("upper_bound"))
    # scoring tree by tree adds a stage per tree; on stored rows those stay cheap to plan
    rows = _one_row_each(materialize(complete, "latest"))
    return model.draws(rows).select(
        "ticker", *[c.alias(n) for n, c in draws_interval(F.col("draws")).items()])


def _sequence_returns(features: DataFrame, model: TrainedModel, length: int, width: int) -> DataFrame:
    """Mean and interval of the next log return over the trees, from the last full sequence."""
    # the last complete rows; one with a hole is passed over, as a shorter series would be
    latest_first = Window.partitionBy("ticker").orderBy(F.desc("pos"))  # tails are bounded
    recent = features.dropna(subset=model.names).withColumn("_back", F.row_number().over(latest_first)).where(
        F.col("_back") <= length)
    closing = features.where(F.col("pos") == F.col("n_rows") - 1).select(
        "ticker", F.col("close").alias("last_close"))
    # the tail rows of a series are few, so their look-ups need one block as well
    numbered = recent.withColumns({
        "pos": (F.lit(length) - F.col("_back")).cast("long"), "n_rows": F.lit(length).cast("long")}).drop("_back")
    scaled = scale.apply_with_label(numbered, model.scaler, model.names, model.label)
    packed = F.array_sort(F.collect_list(
        F.struct("pos", F.array(*[F.col(c).cast("double") for c in model.names]).alias("v"))))
    seq = scaled.groupBy("ticker", "_center", "_spread").agg(
        F.transform(packed, lambda r: r["v"]).alias("sequence")).where(F.size("sequence") == length)
    flat, cells = flatten_sequences(materialize(seq, "latest"), length, width)
    staged = model.pipeline.stages[0].transform(flat)
    staged, trees = tree_predictions(model.regressor, staged.drop("sequence", *cells))
    drawn = staged.select("ticker", F.array(*[
        F.col(t) * F.col("_spread") + F.col("_center") for t in trees]).alias("draws"))
    return drawn.select(
        "ticker", *[c.alias(n) for n, c in draws_interval(F.col("draws")).items()]).join(closing, "ticker")


def forecast(model: TrainedModel, bars: DataFrame, horizon: int, calendar: str = "business") -> DataFrame:
    """Rows ``ticker, step, ds, prediction, lower_bound, upper_bound, model_used``."""
    spark = bars.sparkSession
    tails, constants = start_state(bars, model)
    added = fresh_path(spark, "steps")
    schema = None
    next_day = {"business": business_days, "day": calendar_days}[calendar]
    rule = BAR_RULES[model.kind]()
    for step in range(1, horizon + 1):
        state = tails
        if schema is not None:
            new = spark.read.schema(schema).parquet(*[f"{added}/{i}" for i in range(1, step)])
            state = tails.unionByName(new.select(*tails.columns))
        counted = state.join(constants, "ticker").withColumn("n_rows", F.col("n_rows") + (step - 1))
        predicted = predict_next(counted, model)
        bar, latest = dict(rule), counted.withColumn("blk", F.lit(0))
        if "volume" in tails.columns:
            bar["volume"] = F.col("volume")
            if model.kind == "seq":
                latest = W.add(latest, {"volume": W.mean("volume", 5)})
        latest = latest.where(F.col("pos") == F.col("n_rows") - 1).join(predicted, "ticker")
        row = latest.select(
            "ticker", (F.col("pos") + 1).alias("pos"),
            F.element_at(next_day(F.col("ds"), 1), 1).alias("ds"),
            *[c.cast("double" if n != "green_day" else "int").alias(n) for n, c in bar.items()],
            F.col("prediction").alias("close"), F.lit(step).alias("step"), "lower_bound", "upper_bound")
        schema = row.schema
        row.write.parquet(f"{added}/{step}")
    done = spark.read.schema(schema).parquet(*[f"{added}/{i}" for i in range(1, horizon + 1)])
    return done.select("ticker", "step", "ds", F.col("close").alias("prediction"), "lower_bound", "upper_bound",
                       F.lit(model.kind).alias("model_used"))


def with_residual_bounds(rows: DataFrame, residuals: DataFrame) -> DataFrame:
    """Bounds from the 2.5 % and 97.5 % quantiles of the residuals instead of the point itself."""
    q = exact_quantiles(residuals, ["ticker"], "residual", [0.025, 0.975])
    return rows.join(q, "ticker", "left").withColumns({
        "lower_bound": F.col("prediction") + F.coalesce(F.col("q")[0], F.lit(0.0)),
        "upper_bound": F.col("prediction") + F.coalesce(F.col("q")[1], F.lit(0.0)),
    }).drop("q")


def direct_frame(frame: DataFrame, label: str, horizons: int, names: list[str]) -> DataFrame:
    """Rows for every step ahead at once: features, ``step`` and the label ``step`` rows later.

    One model with the step as a feature replaces the recursion where series are many.
    """
    later = blocks(frame, horizons).withColumn(
        "_past", F.array(*[F.struct(F.lit(h).alias("step"), *[F.lag(c, h).over(in_order()).alias(c) for c in names])
                           for h in range(1, horizons + 1)]))
    return own_rows(later).select(
        "ticker", "ds", "pos", "n_rows", F.col(label).cast("double").alias("label"),
        F.inline("_past")).where(F.col("pos") >= F.col("step"))
