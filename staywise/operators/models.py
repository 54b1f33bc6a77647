"""Baseline classifiers on Spark ML, with imputation and scaling fitted on the training rows only."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    PCA,
    Bucketizer,
    ElementwiseProduct,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.functions.columns import ref, require_columns
from staywise.functions.scale import ensure_checkpoint_dir, materialize
from staywise.operators.evaluation import model_metrics, reliability_deciles

LABEL, SCORE = "outcome", "predicted_risk"
METRICS = (
    "auroc",
    "auprc",
    "brier_score",
    "prevalence",
    "calibration_intercept",
    "calibration_slope",
)
# Parts into which a pass of the median search cuts what is left, and more steps than any finite double's logarithm has.
_PARTS, _HUGE = 1 << 12, 1 << 16
# Bins of a feature of the boosted trees; one more holds its missing values.
BINS = 63
# An axis with less than this share of the variance holds rounding only.
NO_VARIANCE = 1e-10
# Rows of a task in a fit of many short passes: fewer are not worth a task, and more are given to another wave of tasks.
FEWEST_ROWS, MOST_ROWS = 20_000, 1_000_000


@dataclass(frozen=True)
class ModelResult:
    """A fitted model with its holdout predictions, the six metrics and the reliability table."""

    name: str
    model: PipelineModel | None
    predictions: DataFrame
    metrics: dict[str, float]
    reliability: DataFrame


def _missing_as_null(frame: DataFrame, name: str):
    return F.nanvl(ref(name).cast("double"), F.lit(None).cast("double"))


def _first_digit(v):
    """A whole number that never falls as v grows: sign and binary logarithm in steps of 1/32; 0 for zero.

    Two values with one such digit differ by less than a factor of two, so their difference is exact.
    """
    size = F.least(F.floor(F.log2(F.abs(v)) * 32), F.lit(_HUGE)) + 2 * _HUGE
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _next_digit(v, low, high):
    """Which of the _PARTS equal parts of low..high holds v; low and high never fall into the same one."""
    return F.when(low == high, F.lit(0).cast("long")).otherwise(F.floor((v - low) / (high - low) * _PARTS))


def _order_statistics(frame: DataFrame, columns: Sequence[str], ranks_of: Callable) -> dict[str, dict[int, float]]:
    """Rank -> exact value per column, for the ranks (from 1) that ``ranks_of`` makes of a column's number of values.

    Radix selection: one aggregate counts the cells of every column by digit, the running count tells which digits
    hold wanted ranks, and the next pass looks only at the cells between the smallest and the largest value of these
    digits. It ends where these are equal: after two or three passes on usual data, and after at most six,
    as a pass leaves 1/_PARTS of the range of a digit and a range has at most 2**52 doubles. Columns that are
    settled are read no more. The frame is read once a pass, so it should be written beforehand.

    One row per (row, column) exists only inside the map tasks; what is shuffled, ordered or collected is bounded by
    columns, ranks and digits, whatever the number of rows. NaN counts as missing; a column without values has no ranks.
    """
    columns = list(columns)
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    ranges: list[tuple] | None = None  # (column, low, high, wanted ranks inside, rows below); None: everything
    while columns and ranges != []:
        open_columns = range(len(columns)) if ranges is None else sorted({r[0] for r in ranges})
        # Adding zero makes one value of both zeros.
        pairs = [F.struct(F.lit(i).alias("i"), (_missing_as_null(frame, columns[i]) + 0.0).alias("v")) for i in open_columns]
        cells = frame.select(F.explode(F.array(*pairs)).alias("cell")).select("cell.*").where("v is not null")
        if ranges is None:
            cells = cells.select("i", F.lit(0).alias("part"), "v", _first_digit(F.col("v")).alias("digit"))
        else:
            # At most one row per column and wanted rank. The ranges of a column do not overlap.
            parts = [(i, k, low, high) for k, (i, low, high, _, _) in enumerate(ranges)]
            wanted = frame.sparkSession.createDataFrame(parts, "j int, part int, low double, high double")
            inside = (F.col("i") == F.col("j")) & F.col("v").between(F.col("low"), F.col("high"))
            cells = cells.join(F.broadcast(wanted), inside).select(
                "i", "part", "v", _next_digit(F.col("v"), F.col("low"), F.col("high")).alias("digit")
            )
        digits = cells.groupBy("i", "part", "digit").agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        group = Window.partitionBy("i", "part")
        digits = digits.withColumn("upto", F.sum("n").over(group.orderBy("digit")))
        if ranges is None:
            digits = digits.withColumn("total", F.sum("n").over(group))
            digits = digits.withColumn("ranks", ranks_of(F.col("total"))).withColumn("below", F.lit(0).cast("bigint"))
        else:
            ranks = [(i, k, inner, below) for k, (i, _, _, inner, below) in enumerate(ranges)]
            asked = frame.sparkSession.createDataFrame(ranks, "i int, part int, ranks array<bigint>, below bigint")
            digits = digits.join(F.broadcast(asked), ["i", "part"])
        here = F.filter("ranks", lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))
        chosen = digits.withColumn("here", here).where(F.size("here") > 0)
        ranges = []
        for row in chosen.orderBy("i", "digit").collect():  # at most one row per column and wanted rank
            before = row.upto - row.n
            if row.low == row.high:
                found[columns[row.i]].update((row.below + r, row.low) for r in row.here)
            else:
                ranges.append((row.i, row.low, row.high, [r - before for r in row.here], row.below + before))
    return found


def exact_medians(frame: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column (None when it holds no value; NaN counts as missing), by radix selection."""
    middle = _order_statistics(frame, columns, lambda n: F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1))
    medians: dict[str, float | None] = {}
    for column, values in middle.items():
        first, second = (values[min(values)], values[max(values)]) if values else (None, None)
        medians[column] = first if first == second else (first + second) / 2
    return medians


def _values_and_estimate(frame: DataFrame, columns: Sequence[str]) -> list[tuple[int, int]]:
    """Number of values and estimated number of distinct ones per column, in one aggregate."""
    if not columns:
        return []
    cells = [_missing_as_null(frame, c) + 0.0 for c in columns]
    row = frame.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(cells)],
        *[F.approx_count_distinct(v, 0.02).alias(f"d{i}") for i, v in enumerate(cells)],
    ).first()
    return [(row[f"n{i}"], row[f"d{i}"]) for i in range(len(columns))]


def bin_cuts(frame: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Cuts per column, ascending: the bin of a value is the number of cuts up to it.

    A column of at most ``bins`` different values is cut at each of them, so that no rare value shares a bin. Any other
    is cut at its order statistics of ranks floor(k n / bins) + 1, k from 1 to bins - 1, and at its largest value; all
    are exact. Missing values (null, NaN) have no bin; a column without values has no cuts.
    """
    if bins < 2:
        raise ValueError("bins must be two at least")
    columns = list(columns)
    estimates = _values_and_estimate(frame, columns)
    cuts: dict[str, list[float]] = {c: [] for c in columns}
    # An estimate of so few is never off by half: what is collected stays below some three values per bin and column.
    few = [i for i, (n, d) in enumerate(estimates) if n and d <= 2 * bins]
    if few:
        pairs = [F.struct(F.lit(i).alias("i"), (_missing_as_null(frame, columns[i]) + 0.0).alias("v")) for i in few]
        cells = frame.select(F.explode(F.array(*pairs)).alias("cell")).select("cell.*").where("v is not null").distinct()
        for row in cells.orderBy("i", "v").collect():
            cuts[columns[row.i]].append(row.v)
    many = [c for c, (n, _) in zip(columns, estimates, strict=True) if n and not 0 < len(cuts[c]) <= bins]
    ranks = lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(bins)), lambda k: F.least(F.floor(k * n / F.lit(bins)) + 1, n)
    )
    for column, values in _order_statistics(frame, many, ranks).items():
        cuts[column] = sorted(set(values.values()))
    return cuts


def check_training_data(frame: DataFrame, split_column: str, label: str = LABEL) -> dict[str, tuple[int, int]]:
    """Rows and positives per side in one aggregate; fails on an empty side or unusable training labels."""
    sides = frame.groupBy(split_column).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(ref(label).cast("bigint")), F.lit(0)).alias("pos"),
        F.count_if(~F.coalesce(ref(label).isin(0, 1), F.lit(False))).alias("odd"),
    )
    found = {r[split_column]: r for r in sides.collect()}
    for side in ("train", "test"):
        if side not in found:
            raise ValueError(f"no rows on the {side} side")
    train = found["train"]
    if train.odd:
        raise ValueError("training labels must be binary 0/1")
    if train.pos in (0, train.n):
        raise ValueError("training labels hold only one class")
    return {side: (r.n, r.pos) for side, r in found.items()}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _filled(name: str, fill: float) -> str:
    return f"coalesce(nanvl(CAST({_quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE)), {_number(fill)})"


def _packed(expressions: Sequence[str], output: str) -> list:
    """Stages that compute SQL expressions and pack them into one vector."""
    inputs = [f"__x{i}" for i in range(len(expressions))]
    listed = ", ".join(f"{text} AS {name}" for text, name in zip(expressions, inputs, strict=True))
    return [
        SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol=output),
    ]


def _run(stages: Sequence, frame: DataFrame) -> DataFrame:
    for stage in stages:
        frame = stage.transform(frame)
    return frame


def _parts(rows: int, cores: int) -> int:
    """Equal parts of the rows: as many as cores, or a whole number of waves of them; fewer where there are few rows."""
    waves = max(1, math.ceil(rows / (cores * MOST_ROWS)))
    return max(1, min(waves * cores, math.ceil(rows / FEWEST_ROWS)))


def _spread(ready: DataFrame, rows: int) -> DataFrame:
    """The rows in equal parts for many passes; few rows stay as they are.

    Adaptive execution makes parts by bytes: model rows are small, so one part would hold all of them where a pass has
    work for every core, and later some cores would have one part more than the others, for which each pass waits.
    """
    if rows <= FEWEST_ROWS:
        return ready
    return ready.repartition(_parts(rows, ready.sparkSession.sparkContext.defaultParallelism))


def class_weights(y: str, n: int, pos: int):
    """Positives weigh as much as all negatives together; the weights sum to twice the negatives."""
    return F.when(F.col(y) == 1, F.lit((n - pos) / max(pos, 1))).otherwise(F.lit(1.0))


def _z_scores(ready: DataFrame, rows: int, output: str) -> list:
    """Fitted stages from the column __raw to z-scores by the population deviation."""
    scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(ready)
    # The scaler divides by the sample deviation; one constant factor turns that into the population one.
    factor = math.sqrt(rows / max(rows - 1, 1))
    rescale = ElementwiseProduct(inputCol="__scaled", outputCol=output, scalingVec=Vectors.dense([factor] * scaler.mean.size))
    return [scaler, rescale]


def principal_stages(train: DataFrame, features: str) -> list:
    """Fitted stages from a complete vector column to its z-scores along their principal axes.

    Turning keeps lengths, so the penalty |w|^2 and with it the optimum of a logistic regression are those of the z-scores
    themselves. The search is short, though: the estimator divides by the deviation of each axis while it searches,
    and the axes are uncorrelated, while the values of neighbouring hours are nearly the same, which asks for more
    steps the more rows there are. One pass over the rows; the driver gets one matrix of the vector's width.
    """
    require_columns(train, [features], "principal axes")
    stages = [VectorAssembler(inputCols=[features], outputCol="__raw")]
    ready = _run(stages, train).select("__raw").persist()
    try:
        scores = _z_scores(ready, ready.count(), "__z")
        width = scores[0].mean.size
        axes = PCA(k=width, inputCol="__z", outputCol="__axes").fit(_run(scores, ready))
    finally:
        ready.unpersist()
    kept = [i for i, share in enumerate(axes.explainedVariance) if share > NO_VARIANCE]
    # Where nothing varies there is no axis; one that is constant takes no part in a fit.
    return [*stages, *scores, axes, VectorSlicer(inputCol="__axes", outputCol="__features", indices=kept or [0])]


def _shorter_along_axes(stages: Sequence, strength: float, share: float) -> bool:
    """Is the search better conditioned along the principal axes than on the z-scores themselves?

    With variances from m to M and curvature h of the loss, the z-scores have the condition (hM + l) / (hm + l) and
    the axes, each divided by its deviation, (h + l/m) / (h + l/M): the smaller one if l < h sqrt(Mm). It is as soon as
    there are enough rows, as the strength l falls with their number.
    """
    _, scaler, _, axes, slicer = stages
    # Every column that varies has variance one.
    variances = [axes.explainedVariance[i] * sum(d > 0 for d in scaler.std) for i in slicer.getIndices()]
    return strength < share * (1 - share) * math.sqrt(max(variances) * min(variances))


def fit_logistic(
    train: DataFrame,
    features: Sequence[str] | str,
    label: str = LABEL,
    penalty: float = 1.0,
    reweight: bool = False,
    tol: float = 1e-10,
    max_iter: int = 1000,
    stages: Sequence | None = None,
) -> PipelineModel:
    """Median imputation, z-scores (population deviation), L2 logistic regression.

    ``penalty`` is the inverse strength: the objective equals the sum of losses plus |w|^2 / (2 * penalty).
    Columns without a single training value are dropped. ``features`` may also name one vector column that is
    complete already; it is fitted along its principal axes where that shortens the search. Several fits may share
    ``stages``, the ``principal_stages`` of these rows.
    """
    vector = isinstance(features, str)
    require_columns(train, [features, label] if vector else [*features, label], "logistic baseline")
    y = ref(label).cast("double")
    size = train.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).first() if vector else None
    if vector:
        stages = list(stages or principal_stages(train, features))
        held = "__features" if _shorter_along_axes(stages, 1.0 / (penalty * size.n), size.pos / size.n) else "__z"
        stages = stages if held == "__features" else stages[:3]
    else:
        medians = {c: m for c, m in exact_medians(train, features).items() if m is not None}
        if not medians:
            raise ValueError("no feature has a training value")
        stages, held = _packed([_filled(c, m) for c, m in medians.items()], "__raw"), "__raw"
    ready = _run(stages, train).select(held, y.alias("__y")).persist()
    try:
        size = size or ready.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos")).first()
        scores = [] if vector else _z_scores(ready, size.n, "__features")
        weight = 2.0 * (size.n - size.pos) if reweight else float(size.n)
        estimator = LogisticRegression(
            featuresCol=held if vector else "__features", labelCol="__y", elasticNetParam=0.0, standardization=False,
            regParam=1.0 / (penalty * weight), maxIter=max_iter, tol=tol,
        )
        scaled = _run(scores, ready)
        if reweight:
            scaled = scaled.withColumn("__w", class_weights("__y", size.n, size.pos))
            estimator = estimator.setWeightCol("__w")
        return PipelineModel(stages=[*stages, *scores, estimator.fit(scaled)])
    finally:
        ready.unpersist()


def _binned(cuts: dict[int, list[float]], gaps: Sequence[int], output: str) -> list:
    """Stages that turn columns into bin codes and pack them; ``cuts`` by place in the list of features, as are ``gaps``.

    Missing values get the code above all bins, so that a split sends them right with the high values. Columns with gaps
    stand twice: in their second form missing values have the code below all bins and go left with the low ones. A
    tree that may use both forms learns the side of missing values at every split, as one that takes nulls does.
    """
    highest = sys.float_info.max
    finite = [sorted({min(c, highest) for c in own if c > -math.inf}) or [-highest] for own in cuts.values()]
    splits = [[-math.inf, *own, math.inf] for own in finite]
    bucketizer = Bucketizer(
        inputCols=[f"__x{i}" for i in cuts], outputCols=[f"__up{i}" for i in cuts], splitsArray=splits, handleInvalid="keep"
    )
    above = {i: len(own) - 1 for i, own in zip(cuts, splits, strict=True)}
    # The sums carry no attribute of the buckets: trees would take a bin with one for a category without order.
    codes = [f"__up{i} + 0D AS __high{i}" for i in cuts] + [f"IF(__up{i} = {above[i]}, -1D, __up{i}) AS __low{i}" for i in gaps]
    return [
        bucketizer,
        SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__"),
        VectorAssembler(inputCols=[*(f"__high{i}" for i in cuts), *(f"__low{i}" for i in gaps)], outputCol=output),
    ]


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    seed: int = 42,
    trees: int = 200,
    step: float = 0.05,
    depth: int = 5,
    is_unbalance: bool = False,
    bins: int = BINS,
) -> PipelineModel:
    """Gradient-boosted trees on exact bins of the training values; missing values are not filled.

    At every split the trees learn the side of the missing values, for columns that have some in training; in other
    columns a missing value counts as the largest. Columns without a single training value are dropped.

    ``is_unbalance`` up-weights the positives; off by default because it ruins calibration.
    """
    require_columns(train, [*features, label], "boosted trees")
    ensure_checkpoint_dir(train.sparkSession)  # long tree sequences cut their lineage there
    features = list(features)
    found = bin_cuts(train, features, bins)
    cuts = {i: found[c] for i, c in enumerate(features) if found[c]}
    if not cuts:
        raise ValueError("no feature has a training value")
    counted = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ref(label).cast("bigint")).alias("pos"),
        *[F.count(_missing_as_null(train, features[i])).alias(f"k{i}") for i in cuts],
    ).first()
    gaps = [i for i in cuts if counted[f"k{i}"] < counted.n]
    # Adding zero makes one value of both zeros, which the bins would tell apart.
    plain = ", ".join(f"coalesce(CAST({_quoted(features[i])} AS DOUBLE) + 0D, CAST('NaN' AS DOUBLE)) AS __x{i}" for i in cuts)
    stages = [SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"), *_binned(cuts, gaps, "__features")]
    estimator = GBTClassifier(
        featuresCol="__features", labelCol="__y", maxIter=trees, stepSize=step, maxDepth=depth, seed=seed, maxBins=bins + 2
    )
    ready = _run(stages, train).select("__features", ref(label).cast("double").alias("__y"))
    if is_unbalance:
        ready = ready.withColumn("__w", class_weights("__y", counted.n, counted.pos))
        estimator = estimator.setWeightCol("__w")
    ready = _spread(ready, counted.n).persist()
    try:
        return PipelineModel(stages=[*stages, estimator.fit(ready)])
    finally:
        ready.unpersist()


def tree_splits(model: PipelineModel, features: Sequence[str], tree: int = 0) -> list[dict]:
    """The splits of one boosted tree in terms of the features it was fitted with, top down, left before right.

    A value below ``cut`` goes left; ``missing`` says where missing ones go. A cut of None sends all values the other
    way. ``gain`` is the fall of the variance of the target. At most 2**depth - 1 rows.
    """
    bucketizer = next(s for s in model.stages if isinstance(s, Bucketizer))
    packed = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    splits = {name.removeprefix("__up"): own for name, own in zip(bucketizer.getOutputCols(), bucketizer.getSplitsArray(), strict=True)}
    rows, waiting = [], [(1, model.stages[-1].trees[tree]._call_java("rootNode"))]
    while waiting:
        number, node = waiting.pop(0)
        if node.subtreeDepth() == 0:
            continue
        name = packed[node.split().featureIndex()]
        low = name.startswith("__low")
        place = name.removeprefix("__low").removeprefix("__high")
        # A threshold lies between two codes; bin b starts at splits[b], and no value lies in bin 0 of a full cut list.
        first = math.floor(node.split().threshold()) + 1
        cut = splits[place][first] if 0 < first < len(splits[place]) - 1 else None
        rows.append(
            {"node": number, "feature": features[int(place)], "cut": cut, "missing": "left" if low else "right", "gain": node.gain()}
        )
        waiting += [(2 * number, node.leftChild()), (2 * number + 1, node.rightChild())]
    return rows


def fit_stopped_trees(
    frame: DataFrame, features: str, held_out: str, label: str = LABEL, seed: int = 42, trees: int = 40, step: float = 0.1,
    depth: int = 3, is_unbalance: bool = False,
) -> PipelineModel:
    """Gradient-boosted trees on one complete vector column; rows marked by ``held_out`` say when to stop.

    They take no part in the growth. It ends as soon as the loss on them gets worse, and the trees up to the best one are kept.
    """
    require_columns(frame, [features, held_out, label], "boosted trees")
    ensure_checkpoint_dir(frame.sparkSession)
    first = VectorAssembler(inputCols=[features], outputCol="__features")
    ready = first.transform(frame).select("__features", ref(label).cast("double").alias("__y"), ref(held_out).alias("__held"))
    estimator = GBTClassifier(
        featuresCol="__features", labelCol="__y", validationIndicatorCol="__held", maxIter=trees, stepSize=step,
        maxDepth=depth, seed=seed, validationTol=0.0,
    )
    if is_unbalance:
        size = ready.where("not __held").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").cast("bigint").alias("pos")).first()
        ready = ready.withColumn("__w", class_weights("__y", size.n, size.pos))
        estimator = estimator.setWeightCol("__w")
    ready = ready.persist()
    try:
        return PipelineModel(stages=[first, estimator.fit(ready)])
    finally:
        ready.unpersist()


def predict(model: PipelineModel, frame: DataFrame, score: str = SCORE) -> DataFrame:
    """The frame with the probability of the positive class."""
    scored = model.transform(frame).withColumn(score, vector_to_array("probability").getItem(1))
    return scored.select(*[ref(c) for c in frame.columns], score)


def evaluate(name: str, model: PipelineModel, test: DataFrame, label: str = LABEL) -> ModelResult:
    """Score the holdout once and write it down: metrics, tables and reports read it again."""
    return scored(name, model, materialize(predict(model, test)), label)


def scored(name: str, model: PipelineModel | None, predictions: DataFrame, label: str = LABEL) -> ModelResult:
    """The result for predictions that exist already, of a model of this library or of any other (None)."""
    row = model_metrics(predictions, label, SCORE).first()
    metrics = {m: float(row[m]) for m in METRICS}
    return ModelResult(name, model, predictions, metrics, reliability_deciles(predictions, label, SCORE))


def comparison(results: Sequence[ModelResult]) -> DataFrame:
    """One row per model with the six metrics."""
    spark = results[0].predictions.sparkSession
    rows = [(r.name, *[r.metrics[m] for m in METRICS]) for r in results]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in METRICS))


def calibration_verdict(metrics: dict[str, float]) -> str:
    near = abs(metrics["calibration_intercept"]) < 0.5 and abs(metrics["calibration_slope"] - 1.0) < 0.5
    return "reasonably calibrated" if near else "miscalibrated"


def better_model(trees: ModelResult, linear: ModelResult) -> ModelResult:
    """Higher AUROC wins; the tree model wins a tie."""
    return trees if trees.metrics["auroc"] >= linear.metrics["auroc"] else linear


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(str(path))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(str(path))
