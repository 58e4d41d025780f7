"""Comparisons of models over tasks: relative errors, win rates, skill scores, intervals.

Scores stay long (task, model, score); tables are pivoted only for display.  A task is
its 17 key columns, rendered to one string with nulls told apart, so that joins on the
task are plain equi-joins.  Self-joins on the task make tasks x models^2 rows, the size
of what is asked for.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, gmean, known, strict_avg
from ..sources.shared import kept

TASK_TYPES = {
    "dataset_path": "string", "dataset_config": "string", "horizon": "bigint", "initial_cutoff": "string", "min_context_length": "bigint", "max_context_length": "bigint", "seasonality": "bigint", "eval_metric": "string", "extra_metrics": "string", "quantile_levels": "string",
    "id_column": "string", "timestamp_column": "string", "target": "string", "generate_univariate_targets_from": "string", "known_dynamic_columns": "string", "past_dynamic_columns": "string", "static_columns": "string",
}
RESULT_TYPES = TASK_TYPES | {"model_name": "string", "test_error": "double", "training_time_s": "double", "trained_on_this_dataset": "boolean", "inference_time_s": "double", "num_forecasts": "bigint", "engine_version": "string"}
TASK_COLUMNS = list(TASK_TYPES)
#: Summaries of earlier versions may not be comparable.
COMPATIBLE_SINCE = "1.0.0"
TIMES = ("training_time_s", "inference_time_s", "e2e_time_s")


def task_key(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def as_frame(summaries) -> DataFrame:
    """A DataFrame of summaries: itself, or what files, dicts or lists of them hold."""
    if isinstance(summaries, DataFrame):
        return summaries
    from ..sources.summaries import load

    return load(SparkSession.active(), summaries)


def filter_models(summaries: DataFrame, included: Sequence[str] | None = None, excluded: Sequence[str] | None = None) -> DataFrame:
    if included is not None and excluded is not None:
        raise ValueError("Give included_models or excluded_models, not both")
    if included is not None:
        return summaries.filter(F.col("model_name").isin(list(included)))
    return summaries.filter(~F.col("model_name").isin(list(excluded))) if excluded is not None else summaries


def filter_tasks(summaries: DataFrame, names: Sequence[str], column: str = "task_name") -> DataFrame:
    """Only the named tasks; ValueError if one has no result.  Runs one job."""
    kept = summaries.filter(F.col(column).isin(list(names)))
    have = {r[0] for r in kept.select(column).distinct().collect()}  # at most len(names) rows
    if missing := sorted(set(names) - have):
        raise ValueError(f"Tasks without results: {missing}")
    return kept


def check_duplicates(summaries: DataFrame, columns: Sequence[str] = TASK_COLUMNS) -> None:
    """ValueError if a task and model have several rows.  Runs one job."""
    twice = summaries.groupBy(*columns, "model_name").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"Duplicate results for the same task and model, e.g. {[r['model_name'] for r in twice]}")


def check_versions(summaries: DataFrame, column: str = "engine_version") -> None:
    """Warns of results from versions before COMPATIBLE_SINCE; ValueError if one can't be read."""
    parsed = []
    for r in summaries.select(column).distinct().collect():  # one row for each version
        try:
            parsed.append(tuple(int(x) for x in str(r[0]).split("+")[0].replace("rc", ".").replace("dev", ".").split(".") if x))
        except ValueError as e:
            raise ValueError(f"Unable to parse {r[0]!r} as a version") from e
    if parsed and min(parsed) < tuple(map(int, COMPATIBLE_SINCE.split("."))):
        warnings.warn(f"Evaluation summaries contain results from before {COMPATIBLE_SINCE}, which may not be comparable", stacklevel=3)


def models_of(summaries: DataFrame) -> list[str]:
    return sorted(r[0] for r in summaries.select("model_name").distinct().collect())  # one row for each model


def pivot_table(summaries: DataFrame, metric: str = "test_error", baseline_model: str | None = None, columns: Sequence[str] = TASK_COLUMNS) -> DataFrame:
    """A row for each task and a column for each model, divided by the baseline if named."""
    check_duplicates(summaries, columns)
    models = models_of(summaries)
    kind = summaries.schema[metric].dataType
    value = F.col(metric) if kind.simpleString() in ("boolean", "string") else known(metric)
    wide = summaries.groupBy(*columns).pivot("model_name", models).agg(F.first(value, ignorenulls=True))
    if baseline_model is None:
        return wide.orderBy(*(F.asc_nulls_first(c) for c in columns))
    if baseline_model not in models:
        raise ValueError(f"The baseline {baseline_model!r} is missing; there are {models}")
    none = wide.filter(F.col(f"`{baseline_model}`").isNull()).count()
    if none:
        raise ValueError(f"Results of the baseline {baseline_model!r} are missing for {none} tasks")
    base = F.col(f"`{baseline_model}`")
    return wide.select(*columns, *(F.try_divide(F.col(f"`{m}`"), base).alias(m) for m in models)).orderBy(*(F.asc_nulls_first(c) for c in columns))


def grid(summaries: DataFrame, metric: str, models: Sequence[str], columns: Sequence[str] = TASK_COLUMNS, extra: Sequence[str] = ()) -> DataFrame:
    """task, model_name, score (null where missing), and ``extra``, for all tasks and models."""
    rows = summaries.select(task_key(columns).alias("task"), "model_name", known(metric).alias("score"), *extra)
    every = rows.select("task").distinct().select("task", F.explode(F.array(*(F.lit(m) for m in models))).alias("model_name"))
    return every.join(rows, ["task", "model_name"], "left")


def of_model(value: Column | str, model: str) -> Column:
    """The named model's value of the same task."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col("model_name") == model, v)).over(Window.partitionBy("task"))


def relative_errors(scores: DataFrame, baseline_model: str) -> DataFrame:
    return scores.withColumn("score", F.try_divide(F.col("score"), of_model("score", baseline_model)))


def impute_leakage(scores: DataFrame, model: str, flag: str = "trained_on_this_dataset") -> DataFrame:
    """Scores of models trained on the task become the named model's (null flag: not trained)."""
    return scores.withColumn("score", F.when(F.coalesce(F.col(flag), F.lit(False)), of_model("score", model)).otherwise(F.col("score")))


def check_leakage_model(summaries: DataFrame, model: str, models: Sequence[str]) -> None:
    if model not in models:
        raise ValueError(f"The model {model!r}, which is to replace leaked results, is missing; there are {list(models)}")
    if summaries.filter((F.col("model_name") == model) & F.coalesce("trained_on_this_dataset", F.lit(False))).limit(1).count():
        raise ValueError("The model that replaces leaked results must not be trained on a task itself")


def clip_errors(scores: DataFrame, low: float | None, high: float | None) -> DataFrame:
    return scores.withColumn("score", clip(F.col("score"), low, high))


def failures(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_name").agg(F.count_if(F.col("score").isNull()).alias("num_failures"))


def handle_missing(scores: DataFrame, strategy: str, impute: Column | float | None = None) -> DataFrame:
    """'drop' tasks that lack a model, 'impute', or leave (the caller raises for 'error')."""
    if strategy == "drop":
        complete = F.min(F.col("score").isNotNull()).over(Window.partitionBy("task"))
        return scores.withColumn("_all", complete).filter("_all").drop("_all")
    if strategy == "impute":
        return scores.withColumn("score", F.coalesce(F.col("score"), F.lit(float(impute)) if isinstance(impute, (int, float)) else impute))
    if strategy == "error":
        return scores
    raise ValueError(f"Invalid strategy {strategy!r} for missing results: error, drop or impute")


def duels(scores: DataFrame) -> DataFrame:
    """task, model_1, model_2, win (1, 0.5, 0), ratio, for all ordered pairs with themselves."""
    a = scores.select("task", F.col("model_name").alias("model_1"), F.col("score").alias("a"))
    b = scores.select("task", F.col("model_name").alias("model_2"), F.col("score").alias("b"))
    win = F.when(F.coalesce(F.col("a") < F.col("b"), F.lit(False)), 1.0).when(F.coalesce(F.col("a") == F.col("b"), F.lit(False)), 0.5).otherwise(0.0)
    return a.join(b, "task").select("task", "model_1", "model_2", win.alias("win"), F.try_divide(F.col("a"), F.col("b")).alias("ratio"))


def win_rates(scores: DataFrame) -> DataFrame:
    """model_name, win_rate: over all other models and tasks (null for a single model)."""
    pairs = duels(scores).groupBy("model_1", "model_2").agg(F.avg("win").alias("win"))
    return pairs.groupBy(F.col("model_1").alias("model_name")).agg(F.avg(F.when(F.col("model_1") != F.col("model_2"), F.col("win"))).alias("win_rate"))


def skill_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_name").agg((1 - gmean(F.col("score"))).alias("skill_score"))


def pairwise(scores: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """model_1, model_2, win_rate, skill_score for all ordered pairs, with themselves."""
    return duels(scores).groupBy("model_1", "model_2").agg(F.avg("win").alias("win_rate"), (1 - gmean(clip(F.col("ratio"), low, high))).alias("skill_score"))


def mean_ranks(scores: DataFrame) -> DataFrame:
    """model_name, mean_rank: ties share their average rank; missing scores have none."""
    w = Window.partitionBy("task").orderBy("score")
    ties = F.count(F.lit(1)).over(Window.partitionBy("task", "score"))
    ranked = scores.filter("score is not null").withColumn("_rank", F.rank().over(w) + (ties - 1) / 2)
    return ranked.groupBy("model_name").agg(F.avg("_rank").alias("mean_rank"))


# -- intervals ----------------------------------------------------------------------------------


#: Numbers of a block of counts, and of a block of values, in a task.
CELLS = 1 << 22


def resamples(n_tasks: int, n_resamples: int, seed: int) -> list[list[int]]:
    """How often each resample draws each task, by the task's position."""
    return [row.tolist() for block in drawn(n_tasks, n_resamples, seed) for row in block.astype(int)]


def drawn(n_tasks: int, n_resamples: int, seed: int) -> Iterator[np.ndarray]:
    """The counts of ``resamples``, some resamples at a time: a task makes them itself, since
    running through the generator costs less than sending them."""
    rng, step = np.random.default_rng(seed), max(1, CELLS // max(n_tasks, 1))
    for at in range(0, n_resamples, step):
        index = rng.integers(0, n_tasks, size=(min(step, n_resamples - at), n_tasks))
        yield np.stack([np.bincount(row, minlength=n_tasks) for row in index]).astype(float)


def intervals(values: DataFrame, by: Sequence[str], value: str, n_resamples: int, seed: int, alpha: float, geometric: bool) -> DataFrame:
    """``by``, lower, upper: percentiles of the resampled mean (or 1 - geometric mean).

    ``values``: a row for each task_ord of each ``by``, which all share the draws.  The values of
    a ``by`` are one array (as long as there are tasks); a task multiplies blocks of draws with
    blocks of arrays, so neither the driver nor a row ever holds resamples x tasks numbers.
    Undefined (null) where a value is missing.
    """
    per = values.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("task_ord", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("v"))
    schema = ", ".join(f"`{c}` {per.schema[c].dataType.simpleString()}" for c in by) + ", lower double, upper double"

    def bounds(v: np.ndarray) -> np.ndarray:
        """v: arrays of equal length."""
        n = v.shape[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(v > 0, np.log(v), np.where(v <= 0, 0.0, v)).T if geometric else v.T
        none = (v <= 0).T.astype(float)
        stats = []
        for counts in drawn(n, n_resamples, seed):
            means = counts @ x / n
            stats.append(np.where(counts @ none > 0, 1.0, 1 - np.exp(means)) if geometric else means)
        return np.quantile(np.concatenate(stats), [alpha / 2, 1 - alpha / 2], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, float) for v in batch.column("v").to_pylist()]
            out = np.full((2, len(rows)), np.nan)
            for n in sorted({len(v) for v in rows}):
                own = [i for i, v in enumerate(rows) if len(v) == n]
                step = max(1, CELLS // n)
                for at in range(0, len(own), step):
                    out[:, own[at : at + step]] = bounds(np.stack([rows[i] for i in own[at : at + step]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(x, mask=np.isnan(x)) for x in out)], names=[*by, "lower", "upper"])

    return per.mapInArrow(run, schema)


def bootstrap(values: DataFrame, by: Sequence[str], value: str, statistic: Callable[[np.ndarray], np.ndarray], n_resamples: int = 1000, seed: int = 123, alpha: float = 0.05) -> DataFrame:
    """``by``, lower, upper for any statistic: a function from resampled values (resamples x
    tasks) to one number for each resample.

    ``values``: a row for each task_ord of each ``by``.  All of ``by`` share the draws.
    """
    per = values.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("task_ord", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("v"))  # as long as there are tasks

    @F.pandas_udf("struct<lower: double, upper: double>")
    def bounds(v: pd.Series) -> pd.DataFrame:
        out = []
        for x in v:
            x = np.asarray(x, float)
            drawn = x[np.random.default_rng(seed).integers(0, len(x), size=(n_resamples, len(x)))]
            out.append(np.quantile(np.asarray(statistic(drawn), float), [alpha / 2, 1 - alpha / 2]))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return per.select(*by, bounds("v").alias("_b")).select(*by, "_b.lower", "_b.upper")


def number_tasks(scores: DataFrame, summaries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds task_ord: the task's position in the order of its key columns, nulls first."""
    tasks = scores.select("task").distinct().join(summaries.select(*columns, task_key(columns).alias("task")).distinct(), "task")
    ordered = tasks.withColumn("task_ord", F.row_number().over(Window.orderBy(*(F.asc_nulls_first(c) for c in columns))) - 1).select("task", "task_ord")
    return scores.join(ordered, "task")


def _with_intervals(result: DataFrame, scores: DataFrame, summaries: DataFrame, columns, n_resamples, seed, alpha, pairs: bool, low=None, high=None) -> DataFrame:
    placed = kept(number_tasks(scores, summaries, columns), "placed")
    fights = duels(placed).join(placed.select("task", "task_ord").distinct(), "task")
    if pairs:
        by = ["model_1", "model_2"]
        wins, ratios = fights, fights.withColumn("ratio", clip(F.col("ratio"), low, high))
        skill = intervals(ratios, by, "ratio", n_resamples, seed, alpha, True)
    else:
        by = ["model_name"]
        wins = fights.filter("model_1 <> model_2").groupBy("task_ord", F.col("model_1").alias("model_name")).agg(F.avg("win").alias("win"))
        skill = intervals(placed, by, "score", n_resamples, seed, alpha, True)
    win = intervals(wins, by, "win", n_resamples, seed, alpha, False)
    result = result.join(win.withColumnsRenamed({"lower": "win_rate_lower", "upper": "win_rate_upper"}), by, "left")
    return result.join(skill.withColumnsRenamed({"lower": "skill_score_lower", "upper": "skill_score_upper"}), by, "left")


# -- tables --------------------------------------------------------------------------------------


def runtimes(summaries: DataFrame, per: float | None = None, columns: Sequence[str] = TASK_COLUMNS) -> DataFrame:
    """task, model_name and the three times, per so many forecasts if asked."""
    t, i = known("training_time_s"), known("inference_time_s")
    out = summaries.select(task_key(columns).alias("task"), "model_name", t.alias(TIMES[0]), i.alias(TIMES[1]), (t + i).alias(TIMES[2]), "num_forecasts", F.col("trained_on_this_dataset").cast("double").alias("overlap"))
    if per is None:
        return out
    n = F.max("num_forecasts").over(Window.partitionBy("task"))
    return out.withColumns({c: F.try_divide(F.col(c), n.cast("double")) * float(per) for c in TIMES})


def check_num_forecasts(summaries: DataFrame, columns: Sequence[str] = TASK_COLUMNS) -> None:
    bad = summaries.groupBy(*columns).agg(F.count_distinct("num_forecasts").alias("n")).filter("n <> 1").limit(1).count()
    if bad:
        raise ValueError("num_forecasts is inconsistent: models of one task differ in it")


def _raise_failures(scores: DataFrame) -> None:
    bad = {r["model_name"]: r["num_failures"] for r in failures(scores).filter("num_failures > 0").collect()}  # one row for each model
    if bad:
        raise ValueError(f"Some tasks have no result of these models (how many): {bad}")


def leaderboard(
    summaries: DataFrame | str | list,
    metric: str = "test_error",
    baseline_model: str = "seasonal_naive",
    missing_strategy: str = "error",
    min_relative_error: float | None = 1e-2,
    max_relative_error: float | None = 100.0,
    included_models: Sequence[str] | None = None,
    excluded_models: Sequence[str] | None = None,
    leakage_imputation_model: str | None = None,
    n_resamples: int | None = None,
    seed: int = 123,
    alpha: float = 0.05,
    normalize_time_per_n_forecasts: float | None = None,
    columns: Sequence[str] = TASK_COLUMNS,
) -> DataFrame:
    """A row for each model, best win rate first (then by name).

    The checks run small jobs; the table itself is lazy.  Order of steps: relative
    errors, leakage, clipping, failures counted, missing results.
    """
    summaries = filter_models(as_frame(summaries), included_models, excluded_models)
    check_versions(summaries)
    check_duplicates(summaries, columns)
    models = models_of(summaries)
    if baseline_model not in models:
        raise ValueError(f"The baseline {baseline_model!r} is missing; there are {models}")
    if normalize_time_per_n_forecasts is not None:
        check_num_forecasts(summaries, columns)
    scores = grid(summaries, metric, models, columns, ["trained_on_this_dataset"])
    none = scores.filter((F.col("model_name") == baseline_model) & F.col("score").isNull()).count()
    if none:
        raise ValueError(f"Results of the baseline {baseline_model!r} are missing for {none} tasks")
    errors = relative_errors(scores, baseline_model)
    if leakage_imputation_model is not None:
        check_leakage_model(summaries, leakage_imputation_model, models)
        errors = impute_leakage(errors, leakage_imputation_model)
    errors = clip_errors(errors, min_relative_error, max_relative_error)
    failed = failures(errors)
    if missing_strategy == "error":
        _raise_failures(errors)
    errors = handle_missing(errors, missing_strategy, 1.0)
    if missing_strategy == "drop" and not errors.limit(1).count():
        raise ValueError("No task is left that has results of every model")
    times = runtimes(summaries, normalize_time_per_n_forecasts, columns).join(errors.select("task").distinct(), "task", "left_semi")
    suffix = "" if normalize_time_per_n_forecasts is None else f"_per{int(normalize_time_per_n_forecasts)}"
    usage = times.groupBy("model_name").agg(*(F.median(c).alias(f"median_{c}{suffix}") for c in TIMES), F.avg("overlap").alias("training_corpus_overlap"))
    out = win_rates(errors).join(skill_scores(errors), "model_name")
    if n_resamples is not None:
        out = _with_intervals(out, errors, summaries, columns, n_resamples, seed, alpha, False)
    out = out.join(usage, "model_name", "left").join(failed, "model_name", "left")
    bounds = lambda n: [f"{n}_lower", f"{n}_upper"] if n_resamples is not None else []
    return out.select("model_name", "win_rate", *bounds("win_rate"), "skill_score", *bounds("skill_score"), *(f"median_{c}{suffix}" for c in TIMES), "training_corpus_overlap", "num_failures").orderBy(F.desc("win_rate"), "model_name")


def pairwise_comparison(
    summaries: DataFrame | str | list,
    metric: str = "test_error",
    baseline_model: str | None = None,
    missing_strategy: str = "error",
    min_relative_error: float | None = 1e-2,
    max_relative_error: float | None = 100.0,
    included_models: Sequence[str] | None = None,
    excluded_models: Sequence[str] | None = None,
    leakage_imputation_model: str | None = None,
    n_resamples: int | None = None,
    seed: int = 123,
    alpha: float = 0.05,
    columns: Sequence[str] = TASK_COLUMNS,
) -> DataFrame:
    """A row for each ordered pair of models, in the order of their mean ranks.

    Failures are counted before leakage is imputed, so 'error' may speak of results that
    imputation would have filled.
    """
    summaries = filter_models(as_frame(summaries), included_models, excluded_models)
    check_versions(summaries)
    check_duplicates(summaries, columns)
    models = models_of(summaries)
    scores = grid(summaries, metric, models, columns, ["trained_on_this_dataset"])
    if missing_strategy == "error":
        _raise_failures(scores)
    if leakage_imputation_model is not None:
        check_leakage_model(summaries, leakage_imputation_model, models)
        scores = impute_leakage(scores, leakage_imputation_model)
    if missing_strategy == "impute":
        if baseline_model is None:
            raise ValueError("Name the baseline_model whose results stand for missing ones")
        if baseline_model not in models:
            raise ValueError(f"The baseline {baseline_model!r} is missing; there are {models}")
        scores = handle_missing(scores, "impute", of_model("score", baseline_model))
    else:
        scores = handle_missing(scores, missing_strategy)
    if missing_strategy == "drop" and not scores.limit(1).count():
        raise ValueError("No task is left that has results of every model")
    out = pairwise(scores, min_relative_error, max_relative_error)
    if n_resamples is not None:
        out = _with_intervals(out, scores, summaries, columns, n_resamples, seed, alpha, True, min_relative_error, max_relative_error)
    order = mean_ranks(scores)
    first, second = (order.select(F.col("model_name").alias(f"model_{i}"), F.col("mean_rank").alias(f"_r{i}")) for i in (1, 2))
    bounds = lambda n: [f"{n}_lower", f"{n}_upper"] if n_resamples is not None else []
    return out.join(first, "model_1", "left").join(second, "model_2", "left").orderBy("_r1", "model_1", "_r2", "model_2").select("model_1", "model_2", "win_rate", *bounds("win_rate"), "skill_score", *bounds("skill_score"))


def percent(board: DataFrame, n_tasks: int) -> DataFrame:
    """Rates and scores times 100, failures as a percentage of the tasks."""
    scaled = [c for c in board.columns if c.startswith(("win_rate", "skill_score"))]
    out = board.withColumns({c: 100 * F.col(c) for c in scaled})
    return out.withColumn("num_failures", 100 * F.col("num_failures") / n_tasks)


def top_models(board: DataFrame, k: int = 15, always: Sequence[str] = ()) -> DataFrame:
    """The best k and the models named."""
    best = board.orderBy(F.desc("win_rate"), "model_name").limit(k)
    rest = board.filter(F.col("model_name").isin(list(always))).join(best, "model_name", "left_anti")
    return best.unionByName(rest)


def submission_problems(summaries: DataFrame, known_tasks: Sequence[str], required: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """model_name, problem, n: missing columns, duplicates, unknown tasks, undefined metrics."""
    missing = sorted(set(required) - set(summaries.columns))
    spark = summaries.sparkSession
    out = spark.createDataFrame([("*", f"missing column {c}", 1) for c in missing], "model_name string, problem string, n long")
    twice = summaries.groupBy("model_name", "task_name").count().filter("count > 1").groupBy("model_name").agg(F.lit("duplicate tasks").alias("problem"), F.count(F.lit(1)).alias("n"))
    unknown = summaries.filter(~F.col("task_name").isin(list(known_tasks))).groupBy("model_name").agg(F.lit("unknown tasks").alias("problem"), F.count(F.lit(1)).alias("n"))
    undefined = F.lit(False)
    for m in metrics:
        undefined = undefined | known(f"`{m}`").isNull()
    nan = summaries.groupBy("model_name").agg(F.lit("undefined metrics").alias("problem"), F.count_if(undefined).alias("n")).filter("n > 0")
    return out.unionByName(twice).unionByName(unknown).unionByName(nan)


def oversized_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """file, bytes of a submission's files beyond ``most`` bytes; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return found.filter(F.col("bytes") > most)


__all__ = ["leaderboard", "pairwise_comparison", "pivot_table", "strict_avg"]
