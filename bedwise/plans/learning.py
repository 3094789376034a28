"""Random forest training, evaluation and inspection on MLlib."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.operators.aggregates import regression_metrics
from bedwise.operators.prep import (
    column_medians, column_modes, get_feature_columns, get_train_test_split, union_all, unshuffled_split,
)
from bedwise.plans.trees import add_votes, grow_trees
from bedwise.schema import numeric_columns, string_columns
from bedwise.settings import MODEL, REALISTIC_FEATURES, STRONG_FEATURES
from bedwise.sources.work import shared_dir, written

PREDICTION = "predicted_admissions"
#: Rows in a partition of the training table, megabytes of node statistics in one pass, passes between checkpoints.
ROWS_PER_PART = 16_000
NODE_MEMORY_MB = 128
CHECKPOINT_EVERY = 10
#: Trees of a forest that are grown in one run or loaded at once, at most, and nodes that they may have; runs side by side.
#: The driver holds the nodes of these trees only.
TREES_PER_RUN = 25
NODES_PER_RUN = 100_000
RUNS = 4
#: Rows up to which MLlib grows whole trees. Its passes over all rows grow with the number of nodes; beyond, nodes are finished in tasks.
MLLIB_ROWS = 4_000


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_preprocessor(train: DataFrame, columns: Sequence[str]) -> list:
    """Stages that impute, one-hot encode and assemble ``columns``.

    Fill values (median, most frequent) come from ``train`` only and are stored in the first
    stage. A category not seen in training becomes all zeros. Columns that are neither
    numeric nor text, or have no value in ``train``, are left out.
    """
    table = train.select(*columns)
    numeric, text = numeric_columns(table), string_columns(table)
    medians = dict(column_medians(table, numeric).collect()) if numeric else {}
    modes = dict(column_modes(table, text).collect()) if text else {}
    numeric, text = [c for c in numeric if c in medians], [c for c in text if c in modes]
    filled = [f"coalesce(cast(`{c}` as double), {float(medians[c])!r}D) AS `{c}__num`" for c in numeric]
    filled += [f"coalesce(`{c}`, {_text(modes[c])}) AS `{c}__txt`" for c in text]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    if text:
        stages += [
            StringIndexer(
                inputCols=[f"{c}__txt" for c in text], outputCols=[f"{c}__idx" for c in text],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=[f"{c}__idx" for c in text], outputCols=[f"{c}__hot" for c in text], dropLast=True),
        ]
    inputs = [f"{c}__num" for c in numeric] + [f"{c}__hot" for c in text]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _forest(
    target: str, trees: int | None, depth: int | None, min_leaf: int | None, seed: int | None, max_bins: int, features: str = "features",
) -> RandomForestRegressor:
    """One run of the configured forest. It considers all features at each split.

    Each row keeps the numbers of its nodes between the passes, so that the growing forest does not travel with
    every task; their lineage is cut by checkpoints.
    """
    return RandomForestRegressor(
        featuresCol=features, labelCol=target, predictionCol=PREDICTION,
        numTrees=MODEL.trees if trees is None else trees,
        maxDepth=MODEL.depth if depth is None else depth,
        minInstancesPerNode=MODEL.min_leaf if min_leaf is None else min_leaf,
        seed=MODEL.seed if seed is None else seed,
        featureSubsetStrategy="all", maxBins=max_bins, cacheNodeIds=True, checkpointInterval=CHECKPOINT_EVERY, maxMemoryInMB=NODE_MEMORY_MB,
    )


class Forest(Model, MLWritable, MLReadable):
    """A forest as MLlib forests of a few trees each, in files: they are loaded for predictions, and given back after."""

    numTrees = Param(Params._dummy(), "numTrees", "trees of all parts")
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth of a tree")
    featuresCol = Param(Params._dummy(), "featuresCol", "vectors")

    def __init__(self, parts: Sequence[str] = (), sizes: Sequence[int] = (), importances: Sequence[float] = ()):
        super().__init__()
        self.parts, self.sizes, self.importances = list(parts), list(sizes), list(importances)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault("numTrees")

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The mean of all trees.

        A few parts are loaded at a time, and the sums of their trees written with the rows before the next ones are, so the
        driver never holds more nodes than while it grows a run or two.
        """
        out = dataset.withColumn("__total", F.lit(0.0))
        for lot in lots(self.sizes, TREES_PER_RUN):
            columns = [f"__part_{i}" for i in lot]
            for c, part in zip(columns, side_by_side(dataset.sparkSession, RandomForestRegressionModel.load, [self.parts[i] for i in lot])):
                out = part.setFeaturesCol(self.getOrDefault("featuresCol")).setPredictionCol(c).transform(out)
            total = reduce(add, [F.col(c) * self.sizes[i] for c, i in zip(columns, lot)], F.col("__total"))
            out = written(out.withColumn("__total", total).drop(*columns), "voted")
        return out.withColumn(PREDICTION, F.col("__total") / sum(self.sizes)).drop("__total")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class DealtForest(Forest):
    """A forest whose rows are dealt to its nodes, for growing (``trees.grow_trees``) and for predictions; its one part is a folder of tables."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getOrDefault("featuresCol")
        rows = written(dataset.withColumn("__number", F.monotonically_increasing_id()), "numbered")
        votes = add_votes(rows.sparkSession, rows.select(column, "__number"), column, "__number", self.parts[0])
        return rows.join(votes.select(F.col("number").alias("__number"), F.col("mean").alias(PREDICTION)), "__number").drop("__number")

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        forest = self.forest
        extra = {"sizes": forest.sizes, "importances": forest.importances}
        DefaultParamsWriter.saveMetadata(forest, path, self.sparkSession, extra)

        # Files are copied as they are, without loading a tree.
        hadoop, conf = self.sparkSession._jvm.org.apache.hadoop.fs, self.sparkSession._jsc.hadoopConfiguration()
        for i, part in enumerate(forest.parts):
            here, there = hadoop.Path(part), hadoop.Path(f"{path}/parts/{i:05d}")
            hadoop.FileUtil.copy(here.getFileSystem(conf), here, there.getFileSystem(conf), there, False, conf)


class _ForestReader(MLReader):
    def __init__(self, kind: type[Forest] = Forest):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Forest:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        forest = self.kind([f"{path}/parts/{i:05d}" for i in range(len(found["sizes"]))], found["sizes"], found["importances"])._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(forest, found)
        return forest


def lots(sizes: Sequence[int], most: int) -> list[list[int]]:
    """The places of ``sizes`` in runs that sum up to ``most`` at the most; a larger one is a run of its own."""
    out, left = [], 0
    for i, size in enumerate(sizes):
        if not out or size > left:
            out.append([])
            left = most
        out[-1].append(i)
        left -= size
    return out


def trees_per_run(rows: int, options: RandomForestRegressor) -> int:
    """Trees that cannot have more than ``NODES_PER_RUN`` nodes: none has more leaves than rows or than its depth allows.

    A row counts more than once where it is drawn again, so a leaf of two may be one row; on average a tree has a leaf
    for ``min_leaf`` rows at most.
    """
    leaves = min(max(1, rows // options.getMinInstancesPerNode()), 2 ** options.getMaxDepth())
    return max(1, min(TREES_PER_RUN, NODES_PER_RUN // (2 * leaves)))


def side_by_side(spark: SparkSession, work, items: Sequence) -> list:
    """``work`` of every item, RUNS at a time, in the order of the items."""
    with ThreadPoolExecutor(max_workers=RUNS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def grow(vectors: DataFrame, forests: Sequence[tuple[str, RandomForestRegressor]]) -> list[Forest]:
    """A forest on each of the named columns of ``vectors``, with the options given beside it.

    A few trees are grown in a run and written to the shared folder, so the driver never holds all nodes, and the fewer
    the more rows there are. Runs have seeds of their own and go on side by side, since the deep passes of a single one do
    not fill a cluster.
    """
    spark, rows = vectors.sparkSession, vectors.count()
    top = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    if rows > MLLIB_ROWS:
        return [dealt_forest(vectors, features, options, f"{top}/{k}") for k, (features, options) in enumerate(forests)]
    runs = []
    for k, (features, options) in enumerate(forests):
        trees, some = options.getNumTrees(), trees_per_run(rows, options)
        for i, first in enumerate(range(0, trees, some)):
            own = {options.featuresCol: features, options.numTrees: min(some, trees - first), options.seed: options.getSeed() + 1_000_003 * i}
            runs.append((k, f"{top}/{k}-{i:05d}", options.copy(own)))

    def fit(run: tuple[int, str, RandomForestRegressor]) -> tuple[int, str, int, float, list[float]]:
        k, path, options = run
        model = options.fit(vectors)
        # A tree without a split has no importances, so it has no weight in the sum of its forest either.
        grown = sum(t.numNodes > 1 for t in model.trees)
        model.save(path)
        return k, path, model.getNumTrees, grown, model.featureImportances.toArray().tolist()

    found = side_by_side(spark, fit, runs)
    out = []
    for k, (features, options) in enumerate(forests):
        own = [f for f in found if f[0] == k]
        sums = [sum(grown * w for (*_, grown, _), w in zip(own, ws)) for ws in zip(*[f[4] for f in own])]
        forest = Forest([f[1] for f in own], [f[2] for f in own], [s / (sum(sums) or 1.0) for s in sums])
        out.append(forest._set(numTrees=options.getNumTrees(), maxDepth=options.getMaxDepth(), featuresCol=features))
    return out


def dealt_forest(vectors: DataFrame, features: str, options: RandomForestRegressor, path: str) -> DealtForest:
    """The forest of ``options`` on the column ``features``, grown with its rows dealt to nodes."""
    shares = grow_trees(
        vectors, features, options.getLabelCol(), options.getNumTrees(), options.getMaxDepth(), options.getMinInstancesPerNode(),
        options.getMaxBins(), options.getSeed(), path)
    forest = DealtForest([path], [options.getNumTrees()], shares)
    return forest._set(numTrees=options.getNumTrees(), maxDepth=options.getMaxDepth(), featuresCol=features)


def _labelled(train: DataFrame, columns: Sequence[str], target: str, rows_per_part: int) -> DataFrame:
    """The rows with a target, computed once into a table of the shared folder, in parts of ``rows_per_part`` rows.

    Every part sends the statistics of all nodes it grows, so it should hold many rows rather than few.
    """
    context = train.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(train.sparkSession))
    rows = written(train.where(F.col(target).isNotNull()).select(*columns, F.col(target).cast("double").alias(target)), "labelled")
    return rows.repartition(max(1, -(-rows.count() // rows_per_part)))


def train_model(
    train: DataFrame, columns: Sequence[str] | None = None, target: str = MODEL.target,
    trees: int | None = None, depth: int | None = None, min_leaf: int | None = None, seed: int | None = None,
    max_bins: int = 64, rows_per_part: int = ROWS_PER_PART,
) -> PipelineModel:
    """Preprocessing and a random forest."""
    columns = get_feature_columns(train) if columns is None else columns
    labelled = _labelled(train, columns, target, rows_per_part)
    # Fill values, category indexes and the forest read the same rows.
    labelled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ready = Pipeline(stages=create_preprocessor(labelled, columns)).fit(labelled)
        vectors = ready.transform(labelled).select("features", target).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return PipelineModel([*ready.stages, *grow(vectors, [("features", _forest(target, trees, depth, min_leaf, seed, max_bins))])])
        finally:
            vectors.unpersist()
    finally:
        labelled.unpersist()


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with a prediction column. The forest writes the rows it sums up for, so it gets no column but theirs and the vectors."""
    kept = [c for c in df.columns if c != PREDICTION]
    ready = PipelineModel(model.stages[:-1]).transform(df).select(*kept, "features")
    return model.stages[-1].transform(ready).select(*kept, PREDICTION)


def evaluate_model(model: PipelineModel, test: DataFrame, target: str = MODEL.target) -> DataFrame:
    return regression_metrics(predict(model, test), target, PREDICTION)


def preprocessed_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The assembled feature vector of each row."""
    return PipelineModel(model.stages[:-1]).transform(df).select(*df.columns, "features")


def feature_sources(model: PipelineModel) -> list[tuple[str, str | None]]:
    """Column and category (none for a number) of each vector position."""
    found = []
    indexed = {}
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            indexed = dict(zip(stage.getInputCols(), stage.labelsArray))
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    for c in assembler.getInputCols():
        base = c[: -len("__num")]
        found += [(base, None)] if c.endswith("__num") else [(base, v) for v in indexed[f"{base}__txt"]]
    return found


def feature_names(model: PipelineModel) -> list[str]:
    """Name of each vector position: numeric columns, then ``column_category``."""
    return [c if v is None else f"{c}_{v}" for c, v in feature_sources(model)]


def feature_importance(model: PipelineModel, spark, top: int | None = 15) -> DataFrame:
    """Importance per expanded feature, largest first. One row per feature of the model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(feature_names(model), weights)]
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)


def train_and_evaluate(
    df: DataFrame, columns: Sequence[str] | None = None, target: str = MODEL.target, **options,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Chronological split, fit and test metrics: ``(model, metrics, test rows)``."""
    train, test = get_train_test_split(df)
    model = train_model(train, columns, target, **options)
    return model, evaluate_model(model, test, target), test


def compare_feature_sets(
    df: DataFrame, sets: Mapping[str, Sequence[str]] | None = None, target: str = MODEL.target,
    trees: int | None = None, depth: int | None = None, min_leaf: int | None = None, seed: int | None = None,
    max_bins: int = 64, rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """One metrics row per feature set, all on the same unshuffled split.

    The columns of all sets are imputed and encoded once; each set's forest reads a slice of the vectors.
    The forests are fitted side by side.
    """
    if sets is None:
        sets = {
            "Full": [c for c in df.columns if c not in (target, "date")],
            "Strong Corr": STRONG_FEATURES,
            "Realistic": REALISTIC_FEATURES,
        }
    sets = {n: [c for c in cs if c in df.columns] for n, cs in sets.items()}
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    train, test = unshuffled_split(df)
    labelled = _labelled(train, columns, target, rows_per_part).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ready = Pipeline(stages=create_preprocessor(labelled, columns)).fit(labelled)
        sources = feature_sources(ready)
        slicers = [
            VectorSlicer(inputCol="features", outputCol=f"features_{k}", indices=[i for i, (c, _) in enumerate(sources) if c in set(sets[n])])
            for k, n in enumerate(sets)
        ]
        sliced = PipelineModel(slicers)
        vectors = sliced.transform(ready.transform(labelled).select("features", target)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            options = _forest(target, trees, depth, min_leaf, seed, max_bins)
            forests = grow(vectors, [(slicer.getOutputCol(), options) for slicer in slicers])
        finally:
            vectors.unpersist()
    finally:
        labelled.unpersist()
    test = written(sliced.transform(ready.transform(test).select("features", target)), "encoded")
    # One forest at a time is loaded, and its predictions written, for the metrics.
    metrics = [written(regression_metrics(forest.transform(test), target, PREDICTION), "metrics") for forest in forests]
    return union_all([m.select(F.lit(n).alias("model"), "*") for n, m in zip(sets, metrics)])
