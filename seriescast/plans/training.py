"""From bars to a fitted, evaluated and diagnosed model, for all series at once."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.operators import diagnostics, metrics, scale, split
from seriescast.operators.align import previous_price
from seriescast.operators.layout import index_series
from seriescast.plans import models as M
from seriescast.plans.recipes import RF_HORIZONS, SMA_WINDOWS, XGB_HORIZONS, Recipe, recipe
from seriescast.sources.bars import minimum_rows
from seriescast.sources.storage import materialize


@dataclass(frozen=True)
class TrainConfig:
    """What a training request may set."""

    kind: str = "rf"
    n_lags: int | None = None
    train_ratio: float | None = None
    validation: float = 0.1
    sequence_length: int = 30
    params: M.ForestParams | M.BoostParams | None = None
    select: str | float | None = "mean"
    max_features: int | None = 15
    helper_trees: int = 50
    target_mode: str = "same_day"
    early_stopping: float | None = None  # boosted only: share of the train rows that decides when to stop
    custom: Recipe | None = None  # a recipe of the caller's own
    acf_lags: int = diagnostics.LAGS

    @property
    def recipe(self) -> Recipe:
        return self.custom or recipe(self.kind)

    @property
    def lags(self) -> int:
        return self.recipe.n_lags if self.n_lags is None else self.n_lags

    @property
    def ratio(self) -> float:
        return self.recipe.train_ratio if self.train_ratio is None else self.train_ratio


@dataclass
class TrainResult:
    """A trained model with its scored rows; diagnostics are worked out when asked for."""

    model: M.TrainedModel
    metrics: DataFrame
    fitted: DataFrame
    clamp: bool
    acf_lags: int

    @property
    def residuals(self) -> DataFrame:
        return self.fitted.select("ticker", "ds", "y", "yhat", "residual")

    @cached_property
    def acf(self) -> DataFrame:
        return diagnostics.acf(self.fitted, lags=self.acf_lags, clamp=self.clamp)

    @cached_property
    def pacf(self) -> DataFrame:
        return diagnostics.pacf(self.fitted, lags=self.acf_lags, adjusted=not self.clamp, clamp=self.clamp)

    @cached_property
    def importances(self) -> DataFrame:
        return self.model.importances(self.fitted.sparkSession)


def eligible_bars(bars: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Indexed bars of the series long enough to train on and to have every feature."""
    need = minimum_rows(cfg.recipe.name, cfg.lags, cfg.sequence_length)["train"]
    return index_series(bars).where(F.col("n_rows") >= max(need, max(SMA_WINDOWS)))


def prepared(bars: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, list[str]]:
    """Complete feature rows with ``label``, positions counted over the rows that are left."""
    rec = cfg.recipe
    names = rec.names(cfg.lags, bars.columns)
    if rec.name == "seq":
        frame = index_series(rec.build(bars, n_lags=cfg.lags))
        return frame.withColumn("label", F.col("target")), names
    frame = rec.build(bars, n_lags=cfg.lags)
    warm_up = max(RF_HORIZONS) if rec.name == "rf" else 0
    shortest = warm_up if rec.name == "rf" else max(XGB_HORIZONS)
    frame = frame.where((F.col("n_rows") > shortest) & (F.col("pos") >= warm_up)).withColumns(
        {"pos": F.col("pos") - warm_up, "n_rows": F.col("n_rows") - warm_up})
    if cfg.target_mode == "next_day":
        frame = with_next_label(frame, rec.label)
    else:
        frame = frame.withColumn("label", F.col(rec.label).cast("double"))
    return frame, names


def with_next_label(frame: DataFrame, label: str) -> DataFrame:
    """The label of the following row; the last row of a series has none and goes."""
    following = frame.where("pos > 0").select(
        "ticker", (F.col("pos") - 1).alias("pos"), F.col(label).cast("double").alias("label"))
    return frame.join(following, ["ticker", "pos"]).withColumn("n_rows", F.col("n_rows") - 1)


def training_frame(bars: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, list[str]]:
    """Prepared rows with their ``split``, written once because every fit reads them."""
    stored = materialize(eligible_bars(bars, cfg), "bars")
    frame, names = prepared(stored, cfg)
    if cfg.recipe.name == "seq":
        frame = split.split_three(frame, cfg.ratio, cfg.validation)
    else:
        frame = split.split_two(frame, cfg.ratio)
    return materialize(frame, "features"), names


def fit_scaler(frame: DataFrame, names: list[str], cfg: TrainConfig) -> DataFrame | None:
    if cfg.recipe.scaler is None:
        return None
    train = frame.where("split = 'train'")
    return materialize(scale.fit(train, [*names, "label"], cfg.recipe.scaler), "scaler")


def model_input(frame: DataFrame, names: list[str], scaler: DataFrame | None) -> DataFrame:
    """The frame with scaled features and label, ready for the assembler."""
    return frame if scaler is None else scale.apply(frame, scaler, [*names, "label"], same=True)


PART_ROWS = 20_000


def spread_out(rows: DataFrame, keys: tuple[str, ...] = ("ticker", "pos")) -> DataFrame:
    """Rows dealt by key over partitions whose number follows from their own count.

    Tree models draw their samples partition by partition, so a layout that depended on the
    cluster would give another model there.
    """
    parts = max(8, -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def train(bars: DataFrame, cfg: TrainConfig) -> TrainResult:
    """Features, ordered split, scaling, feature selection, fit, residuals, hold-out metrics."""
    if cfg.recipe.name == "seq":
        return train_sequences(bars, cfg)
    frame, names = training_frame(bars, cfg)
    scaler = fit_scaler(frame, names, cfg)
    ready = model_input(frame, names, scaler)
    chosen = [*names, "label", "ticker", "pos"]
    if cfg.early_stopping:
        deciding = split.share(split.share(F.col("n_rows"), cfg.ratio), 1 - cfg.early_stopping)
        ready = ready.withColumn("is_validation", F.col("pos") >= deciding)
        chosen.append("is_validation")
    rows = spread_out(materialize(ready.where("split = 'train'").select(*chosen), "train"))
    params = cfg.params or M.PARAMS[cfg.recipe.name]()
    indices = None
    if cfg.select is not None or cfg.max_features is not None:
        ranked = M.rank_importances(rows, names, helper_for(params, cfg.helper_trees))
        indices = M.choose(ranked, cfg.select, cfg.max_features)
    estimator = params.estimator(validation="is_validation") if cfg.early_stopping else params.estimator()
    pipeline = M.fit_selected(rows, names, indices, estimator)
    model = M.TrainedModel(
        kind=cfg.recipe.name, pipeline=pipeline, names=names,
        selected=[names[i] for i in indices] if indices else names, n_lags=cfg.lags, label="label",
        params=asdict(params) | {"features_index": indices}, scaler=scaler,
        training_end=str(frame.agg(F.max("ds")).first()[0]))
    scored = model.score(frame, same=True).select(
        "ticker", "ds", "pos", "n_rows", "split", F.col("label").alias("y"), "yhat")
    # train rows lead every series, so their positions stand and only the length changes
    return diagnosed(model, materialize(scored, "scored"), cfg, split.share(F.col("n_rows"), cfg.ratio))


def helper_for(params, trees: int):
    """The model that ranks features: same family, default settings, few trees."""
    if isinstance(params, M.BoostParams):
        return M.BoostParams(n_estimators=trees, seed=params.seed).estimator()
    return M.ForestParams(n_estimators=trees, max_depth=5, max_features="all", seed=params.seed).estimator()


def diagnosed(model: M.TrainedModel, scored: DataFrame, cfg: TrainConfig, fitted_rows: Column) -> TrainResult:
    """Hold-out metrics per series and the diagnostics of the train residuals.

    ``fitted_rows`` is the number of train rows of a series; their ``pos`` counts from 0.
    """
    scored = scored.withColumn("residual", F.col("y") - F.col("yhat"))
    fitted = scored.where("split = 'train'").withColumn("n_rows", fitted_rows)
    held_out = scored.where("split = 'test'")
    model.metrics = overall(held_out)
    return TrainResult(model, metrics.regression_metrics(held_out, ["ticker"]), fitted,
                       clamp=cfg.recipe.name == "xgb", acf_lags=cfg.acf_lags)


def overall(scored: DataFrame) -> dict[str, float]:
    row = metrics.regression_metrics(scored, []).first()
    return {k.upper(): row[k] for k in ("mse", "rmse", "mae", "mape")}


def sequence_samples(frame: DataFrame, names: list[str], cfg: TrainConfig,
                     scaler: DataFrame) -> tuple[DataFrame, list[str]]:
    """Scaled sequences per split, one column per cell."""
    ready = scale.apply(frame, scaler, [*names, "label"], same=True)
    seq = split.sequences(ready, names, "label", cfg.sequence_length,
                          start=split.split_start(cfg.ratio, cfg.validation))
    return M.flatten_sequences(seq, cfg.sequence_length, len(names))


def train_sequences(bars: DataFrame, cfg: TrainConfig) -> TrainResult:
    """The return model: trees over flattened sequences, judged on rebuilt prices."""
    frame, names = training_frame(bars, cfg)
    scaler = fit_scaler(frame, names, cfg)
    flat, cells = sequence_samples(frame, names, cfg, scaler)
    flat = spread_out(materialize(flat, "sequences"))
    params = cfg.params or M.ForestParams(max_depth=10)
    pipeline = M.fit_selected(flat.where("split = 'train'"), cells, None, params.estimator())
    model = M.TrainedModel(
        kind="seq", pipeline=pipeline, names=names, selected=cells, n_lags=cfg.lags, label="label",
        params=asdict(params), scaler=scaler, sequence_length=cfg.sequence_length,
        training_end=str(frame.agg(F.max("ds")).first()[0]))
    predicted = pipeline.transform(flat).select(
        "ticker", "ds", "pos", "n_rows", "split", F.col("label").alias("y"), F.col("prediction").alias("yhat"))
    back = scale.invert(predicted, scaler, {"y": "label", "yhat": "label"}, same=True)
    prices = previous_price(bars).select("ticker", "ds", "previous")
    scored = back.join(prices, ["ticker", "ds"]).select(
        "ticker", "ds", "pos", "n_rows", "split", "y", "yhat", "previous")
    scored = materialize(scored, "scored")
    rebuilt = scored.withColumns({"y": F.col("previous") * F.exp("y"), "yhat": F.col("previous") * F.exp("yhat")})
    # residuals are returns; their positions start after the first full sequence
    returns = scored.where("split = 'train'").withColumn("pos", F.col("pos") - cfg.sequence_length)
    head = split.share(split.share(F.col("n_rows"), cfg.ratio), 1 - cfg.validation)
    result = diagnosed(model, returns.drop("previous"), cfg, head - cfg.sequence_length)
    held_out = rebuilt.where("split = 'test'")
    model.metrics = overall(held_out)
    result.metrics = metrics.regression_metrics(held_out, ["ticker"])
    return result


def evaluate_saved(model: M.TrainedModel, bars: DataFrame, cfg: TrainConfig,
                   samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """A stored model on the tail split: metrics with R2, and the last scored rows."""
    frame, _ = prepared(bars, cfg)
    scored = model.score(split.split_two(frame, cfg.ratio).where("split = 'test'")).select(
        "ticker", "ds", "pos", "n_rows", F.col("label").alias("y"), "yhat")
    scored = materialize(scored, "evaluated")
    return metrics.r_squared(scored, ["ticker"]), split.tail(scored, samples)
