"""A network with learnt embeddings, trained by gradients that tasks sum over their own rows.

Encoded rows are written once, dealt over mini-batches that are folders, so a step reads its own batch only. Every task adds up the
weighted gradient of its rows and returns it in pieces; the pieces of all tasks are summed by a map-side combining aggregate, and only the
model's own size reaches the driver, which takes the step. ``levels`` bounds that size: a column's most frequent levels get an embedding
each, rare and unseen ones share one, whatever the size of the data. Validation average precision after every epoch picks the epoch kept.

Rows without a label take no part in the fit. Missing numbers are the training median with a flag, missing categories a level of
their own. Training rows without a positive are refused, as for every learner; no rows score to no rows, repeated rows one by one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskspark.operators import encoders
from riskspark.operators.contract import assert_protected
from riskspark.operators.profiling import infer_feature_groups, positive_weight
from riskspark.plans.training import NETWORK_WEIGHT_MODES, SEED, average_precision
from riskspark.schema import LABEL, MISSING
from riskspark.session import scratch_path, write_through

# Sizes of the network.
HIDDEN = (384, 192, 96)
DROPOUT = (0.30, 0.20, 0.10)
SMALLEST_EMBEDDING, LARGEST_EMBEDDING, EMBEDDING_FACTOR = 4, 48, 1.6

LEVELS = 10_000  # embeddings a column, besides the two for missing and for other values
PIECE = 4_096  # gradient values a row of the sums
BLOCK = 4_096  # rows a task works on at once
MISSING_LEVEL, OTHER_LEVEL, FIRST_LEVEL = 0, 1, 2


def embedding_size(levels: int) -> int:
    return min(LARGEST_EMBEDDING, max(SMALLEST_EMBEDDING, round(EMBEDDING_FACTOR * math.sqrt(levels))))


@dataclass(frozen=True)
class Shape:
    """Inputs, embeddings and layers; parameters are one flat vector in this order."""

    numbers: int
    levels: tuple[int, ...]
    hidden: tuple[int, ...]

    @property
    def sizes(self) -> list[tuple[int, int]]:
        """Of every embedding table, then of every layer with its bias as the last row."""
        tables = [(n, embedding_size(n)) for n in self.levels]
        width, layers = self.numbers + sum(d for _, d in tables), []
        for after in (*self.hidden, 1):
            layers.append((width + 1, after))
            width = after
        return tables + layers

    @property
    def size(self) -> int:
        return sum(a * b for a, b in self.sizes)

    def parts(self, flat: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Views of a flat vector as embedding tables and layers."""
        views, at = [], 0
        for a, b in self.sizes:
            views.append(flat[at:at + a * b].reshape(a, b))
            at += a * b
        return views[: len(self.levels)], views[len(self.levels):]

    def start(self, seed: int) -> np.ndarray:
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        tables, layers = self.parts(flat)
        for table in tables:
            table[:] = rng.normal(0, 0.1, table.shape)
        for layer in layers:
            layer[:-1] = rng.normal(0, math.sqrt(2 / max(1, len(layer) - 1)), (len(layer) - 1, layer.shape[1]))
        layers[-1][:-1] *= 0.1
        return flat


def logits(shape: Shape, flat: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _forward(shape, flat, x, c, None)[0]


def _forward(shape: Shape, flat: np.ndarray, x: np.ndarray, c: np.ndarray, masks: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and the input of every layer."""
    tables, layers = shape.parts(flat)
    inputs = [np.concatenate([x, *[table[c[:, j]] for j, table in enumerate(tables)]], axis=1)]
    for at, layer in enumerate(layers[:-1]):
        h = np.maximum(inputs[-1] @ layer[:-1] + layer[-1], 0.0)
        inputs.append(h if masks is None else h * masks[at])
    return (inputs[-1] @ layers[-1][:-1] + layers[-1][-1])[:, 0], inputs


def loss_gradient(
    shape: Shape, flat: np.ndarray, x: np.ndarray, c: np.ndarray, y: np.ndarray, weight: np.ndarray, masks: list[np.ndarray] | None = None
) -> tuple[float, np.ndarray]:
    """Summed weighted log loss of the rows and its gradient; ``masks`` are the dropout factors of the hidden layers."""
    z, inputs = _forward(shape, flat, x, c, masks)
    loss = float((weight * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z)).sum())
    _, layers = shape.parts(flat)
    gradient = np.zeros(shape.size)
    own_tables, own_layers = shape.parts(gradient)
    pull = (weight * (_sigmoid(z) - y))[:, None]
    for at in range(len(layers) - 1, -1, -1):
        own_layers[at][:-1] = inputs[at].T @ pull
        own_layers[at][-1] = pull.sum(axis=0)
        pull = pull @ layers[at][:-1].T
        if at:
            pull *= inputs[at] > 0
            if masks is not None:
                pull *= masks[at - 1]
    left = shape.numbers
    for j, table in enumerate(own_tables):
        np.add.at(table, c[:, j], pull[:, left:left + table.shape[1]])
        left += table.shape[1]
    return loss, gradient


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1, np.exp(-np.abs(z))) / (1 + np.exp(-np.abs(z)))


# --- encoding ---------------------------------------------------------------------------


def fit_inputs(train: DataFrame, groups: dict[str, list[str]] | None = None, *, rare_min_count: int = encoders.RARE_MIN_COUNT, levels: int = LEVELS) -> dict:
    """Medians and scales of the numbers, and of every category the ``levels`` most frequent values with ``rare_min_count`` training rows.

    What is collected is the model's own vocabulary, at most ``levels`` values a column.
    """
    groups = groups or infer_feature_groups(train)
    categories = groups["low_cardinality"] + groups["high_cardinality"]
    assert_protected([*groups["numeric"], *categories])
    numbers = encoders.scaling_values(encoders.fit_scaling(train, groups["numeric"])) if groups["numeric"] else {}
    kept: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        found = encoders.fit_levels(train, categories, rare_min_count=rare_min_count)
        order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        top = found.where(F.col("kept") & (F.col("value") != MISSING)).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= levels)
        for r in top.select("column", "value").orderBy("column", "_place").collect():
            kept[r["column"]].append(r["value"])
    return {"numbers": numbers, "levels": kept}


def shape_of(state: dict, hidden: tuple[int, ...] = HIDDEN) -> Shape:
    return Shape(2 * len(state["numbers"]), tuple(FIRST_LEVEL + len(v) for v in state["levels"].values()), tuple(hidden))


def _inputs(df: DataFrame, state: dict, keep: list[str]) -> DataFrame:
    """(_row, _x, _s): the kept columns, scaled numbers with their flags, and categories as text."""
    names = list(state["numbers"])
    packed = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in keep]))
    scaled = encoders.apply_scaling(packed, state["numbers"], names)
    x = F.array(*[F.col(f"{c}__{part}") for part in ("scaled", "missing") for c in names]).cast("array<double>")
    s = F.struct(F.lit(0).alias("none"), *[encoders.clean(c).alias(f"c{i}") for i, c in enumerate(state["levels"])])
    return scaled.select("_row", x.alias("_x"), s.alias("_s"))


def _arrays(batch: pa.RecordBatch, state: dict) -> tuple[np.ndarray, np.ndarray]:
    x = _matrix(batch.column("_x"), 2 * len(state["numbers"]), np.float64)
    c = np.full((batch.num_rows, len(state["levels"])), OTHER_LEVEL, np.int32)
    texts = batch.column("_s")
    for j, values in enumerate(state["levels"].values()):
        place = pc.index_in(texts.field(j + 1), value_set=pa.array([MISSING, *values], texts.field(j + 1).type))
        at = place.fill_null(-1).to_numpy(zero_copy_only=False)
        c[:, j] = np.where(at < 0, OTHER_LEVEL, np.where(at == 0, MISSING_LEVEL, at + FIRST_LEVEL - 1))
    return x, c


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


# --- training ---------------------------------------------------------------------------


def dealt(train: DataFrame, state: dict, batches: int) -> str:
    """Encoded training rows in one folder a mini-batch; returns the path."""
    spark, path = train.sparkSession, scratch_path(train.sparkSession, "network-rows")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, c = _arrays(batch, state)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(t)) if m.shape[1] else pa.array([[]] * len(m), pa.list_(t))
                     for m, t in ((x, pa.float64()), (c, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("_row").field(0), *lists], ["_y", "_x", "_c"])

    rows = _inputs(train.where(F.col(LABEL).isNotNull()).withColumn("_y", F.col(LABEL).cast("double")), state, ["_y"])
    encoded = rows.mapInArrow(encode, "_y double, _x array<double>, _c array<int>")
    encoded.withColumn("_batch", F.floor(F.rand(SEED) * batches).cast("int")).write.partitionBy("_batch").parquet(path)
    return path


def summed_gradient(
    rows: DataFrame, shape: Shape, flat: np.ndarray, positive: float, dropout: tuple[float, ...] = (), seed: int = 0
) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient summed over (_y, _x, _c) rows; positives weigh ``positive``, exactly as given.

    A task keeps one gradient. Pieces without a change are not sent, so rare embeddings cost what their rows touch.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(flat)  # the model: bounded by its levels and layers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.size + 2)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in parts:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                x, c = _matrix(block.column("_x"), shape.numbers, np.float64), _matrix(block.column("_c"), len(shape.levels), np.int64)
                y = block.column("_y").to_numpy(zero_copy_only=False)
                weight = np.where(y > 0, positive, 1.0)
                masks = [(rng.random((len(y), n)) >= p) / (1 - p) for n, p in zip(shape.hidden, dropout)] if dropout else None
                loss, gradient = loss_gradient(shape, shared.value, x, c, y, weight, masks)
                total[:2] += loss, weight.sum()
                total[2:] += gradient
        for at in range(0, len(total), PIECE):
            if total[at:at + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([total[at:at + PIECE]], pa.list_(pa.float64()))], ["piece", "part"])

    pieces = rows.select("_y", "_x", "_c").coalesce(context.defaultParallelism).mapInArrow(run, "piece int, part array<double>")
    sums = pieces.groupBy("piece").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")).collect()  # the model's size
    total = np.zeros(shape.size + 2)
    for r in sums:
        total[r["piece"] * PIECE:r["piece"] * PIECE + len(r["part"])] = r["part"]
    shared.destroy()
    return float(total[0]), float(total[1]), total[2:]


class _Steps:
    """Adam with decoupled weight decay."""

    def __init__(self, size: int, rate: float, decay: float) -> None:
        self.first, self.second, self.count = np.zeros(size), np.zeros(size), 0
        self.rate, self.decay = rate, decay

    def take(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.count += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        move = (self.first / (1 - 0.9**self.count)) / (np.sqrt(self.second / (1 - 0.999**self.count)) + 1e-8)
        return flat - self.rate * (move + self.decay * flat)


@dataclass
class Network:
    """Encoder state with the parameters of the best epoch; ``history`` has (epoch, training loss, validation average precision)."""

    state: dict
    shape: Shape
    flat: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)
    identifier: str = "neural_network.v2"

    def score(self, df: DataFrame) -> DataFrame:
        """The rows with all their columns and ``probability``."""
        state, shape = self.state, self.shape
        shared = df.sparkSession.sparkContext.broadcast(self.flat)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                found = _sigmoid(logits(shape, shared.value, *_arrays(batch, state)))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.float64())], ["_row", "_p"])

        rows = _inputs(df, state, df.columns)
        schema = StructType([rows.schema["_row"], StructField("_p", DoubleType())])
        return rows.mapInArrow(run, schema).select("_row.*", F.col("_p").alias("probability"))


def train_network(
    train: DataFrame, valid: DataFrame, *, groups: dict | None = None, state: dict | None = None, weight_mode: str = "sqrt_balanced",
    hidden: tuple[int, ...] = HIDDEN, dropout: tuple[float, ...] = DROPOUT, epochs: int = 30, patience: int = 5, batches: int = 16,
    rate: float = 1e-3, decay: float = 1e-5, seed: int = SEED,
) -> Network:
    """Fit on ``train``; the epoch of highest average precision on ``valid`` is kept, the first among equals.

    Stops after ``patience`` epochs without a gain. ``batches`` is the number of steps an epoch, each over that share of the rows.
    """
    if dropout and len(dropout) != len(hidden):
        raise ValueError("give one dropout rate for each hidden layer, or none")
    state = state or fit_inputs(train, groups)
    shape = shape_of(state, hidden)
    positive = positive_weight(train, weight_mode)
    path = dealt(train, state, batches)
    rows = train.sparkSession.read.parquet(path)
    valid = write_through(valid.select(LABEL, *state["numbers"], *state["levels"]), "network-valid")
    flat, steps = shape.start(seed), _Steps(shape.size, rate, decay)
    best, kept, history = -1.0, flat, []
    for epoch in range(1, epochs + 1):
        lost = weighed = 0.0
        for batch in np.random.default_rng([seed, epoch]).permutation(batches):
            loss, weight, gradient = summed_gradient(rows.where(F.col("_batch") == int(batch)), shape, flat, positive, dropout, seed + len(history) * batches + int(batch))
            if weight:  # an empty batch has nothing to learn from
                flat = steps.take(flat, gradient / weight)
                lost, weighed = lost + loss, weighed + weight
        precision = average_precision(Network(state, shape, flat).score(valid))
        history.append((epoch, lost / weighed, precision))
        if precision > best:
            best, kept = precision, flat
        elif epoch - max(history, key=lambda h: (h[2], -h[0]))[0] >= patience:
            break
    return Network(state, shape, kept, history)


def search_weight_mode(train: DataFrame, valid: DataFrame, *, groups: dict, **options) -> DataFrame:
    """Square-root or full class weight, by validation average precision of the best epoch."""
    state = fit_inputs(train, groups)
    results = [(mode, max(h[2] for h in train_network(train, valid, state=state, weight_mode=mode, **options).history)) for mode in NETWORK_WEIGHT_MODES]
    return train.sparkSession.createDataFrame(results, "name string, validation_pr_auc double")


def save(network: Network, spark: SparkSession, path: str) -> None:
    """Parameters in pieces, and one document with everything else."""
    pieces = [(at // PIECE, network.flat[at:at + PIECE].tolist()) for at in range(0, len(network.flat), PIECE)]
    spark.createDataFrame(pieces, "piece int, part array<double>").write.mode("overwrite").parquet(f"{path}/parameters")
    record = {"identifier": network.identifier, "state": network.state, "shape": asdict(network.shape), "history": network.history}
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def load(spark: SparkSession, path: str) -> Network:
    record = json.loads(spark.read.text(f"{path}/record", wholetext=True).first()[0])  # one small document
    parts = [r["part"] for r in spark.read.parquet(f"{path}/parameters").orderBy("piece").collect()]  # the model's size
    shape = Shape(record["shape"]["numbers"], tuple(record["shape"]["levels"]), tuple(record["shape"]["hidden"]))
    return Network(record["state"], shape, np.concatenate(parts), [tuple(h) for h in record["history"]], record["identifier"])
