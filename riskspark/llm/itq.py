"""Embedding near-duplicates: ITQ codes, multi-index Hamming tables, reranking with the original vectors.

On a bounded sample of normalised vectors, principal directions and a rotation are learnt so that the signs of the rotated
coordinates lose little (iterative quantisation) and split the sample evenly. Several rotations from different starts give
several codes. Each code is cut into substrings; two vectors meet where a substring is equal, in one of rotations x substrings
tables. Inside a bucket the cosine of the original vectors, in double precision, decides; nothing else makes a link.

Equal vectors are one entry with a count, so copies are never paired. Large buckets are split into blocks (see ``blocks``); what
leaves a block are link counts per vector and a spanning forest. A pair that meets in several tables is counted in the first
of them only, which both codes tell.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different
lengths with each other. Rows that repeat an id keep a row each; a null id never becomes a component's id unless all ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import blocks
from riskspark.llm.components import components
from riskspark.session import write_through

LEAST_COSINE = 0.9


@dataclass(frozen=True)
class Setting:
    """More rotations find more of the pairs near the least cosine; longer substrings make smaller buckets but miss more.

    Chance to meet at a cosine c: 1 - (1 - (1 - arccos(c) / pi) ** bits) ** tables, 0.94 at 0.9 and above 0.999 from 0.95 on.
    """

    rotations: int = 8
    bits: int = 16
    rounds: int = 25
    sample: int = 8192
    cap: int = 512


def learn(sample: np.ndarray, setting: Setting = Setting()) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections by rotation) from normalised vectors.

    Alternates between the signs of the rotated sample and the rotation that brings it closest to them (orthogonal Procrustes).
    """
    mean = sample.mean(0)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    reduced = centred @ directions
    projections = []
    for number in range(setting.rotations):
        rotation, _ = np.linalg.qr(np.random.default_rng(number).normal(size=(sample.shape[1],) * 2))
        for _ in range(setting.rounds):
            signs = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ reduced)
            rotation = right.T @ left.T
        projections.append(directions @ rotation)
    return mean, np.stack(projections)


def substrings(vectors: np.ndarray, mean: np.ndarray, projections: np.ndarray, bits: int) -> np.ndarray:
    """Substring value of each vector (row) in each table (column). A code's last substring takes what bits are left."""
    powers, found = 1 << np.arange(bits, dtype=np.int64), []
    for projection in projections:
        signs = ((vectors - mean) @ projection >= 0).astype(np.int64)
        found += [signs[:, at:at + bits] @ powers[: min(bits, signs.shape[1] - at)] for at in range(0, signs.shape[1], bits)]
    return np.stack(found, 1)


def _normalised(column: pa.Array, width: int) -> np.ndarray:
    """Rows as unit vectors, shorter ones padded with zeros."""
    out = np.zeros((len(column), width))
    lists = column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    out /= np.abs(out).max(1, keepdims=True)  # so that squares of very large or small components stay finite
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, setting: Setting = Setting()
) -> DataFrame:
    """(vec_id, n_links, component_id) of each row: others linked directly, and the smallest id that links reach."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine & F.exists("vector", lambda x: x != 0), F.lit(False))
    usable = rows.where(fine).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # one spelling of zero
    nodes = usable.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = write_through(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = _node_classes(nodes, least, setting)
    linked = usable.join(found, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def _node_classes(nodes: DataFrame, least: float, setting: Setting) -> DataFrame:
    """(vector, n_links, component_id) of the distinct vectors."""
    width = nodes.select(F.max(F.size("vector"))).first()[0] or 1
    part = nodes.orderBy(F.xxhash64("node")).limit(setting.sample).select("vector")
    sample = _normalised(part.toArrow().column(0).combine_chunks(), width)  # at most setting.sample rows
    mean, projections = learn(sample, setting) if len(sample) else (np.zeros(width), np.zeros((setting.rotations, width, width)))
    compared = write_through(_compare(nodes.select("node", "n", "vector"), width, mean, projections, least, setting), "vector-links")
    degrees = compared.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(compared.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = nodes.join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(ids, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")


def _compare(nodes: DataFrame, width: int, mean: np.ndarray, projections: np.ndarray, least: float, setting: Setting) -> DataFrame:
    """Rows (node, null, links) and (node, other, null): partial link counts, and edges of spanning forests."""
    bits = setting.bits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = np.diff(part.column(2).offsets.to_numpy()).astype(np.int64)
                tables = substrings(_normalised(part.column(2), width), mean, projections, bits)
                for number in range(tables.shape[1]):
                    key = ((sizes * tables.shape[1] + number) << bits) + tables[:, number]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], names=["key", "node", "n", "vector"])

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ["key", "i", "j", "left", "node", "n"]}
        return found | {"vector": _normalised(batch.column("vector"), width)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.groups(batches, arrays):
            # columns: left chunk, rows: right chunk; inside one chunk each pair stands twice, once for either side's count
            vectors, node = block["vector"], block["node"]
            near = vectors @ vectors.T >= least
            np.fill_diagonal(near, False)
            if block["i"][0] != block["j"][0]:
                near &= block["left"][:, None] != block["left"][None, :]
            if not near.any():
                continue
            tables = substrings(vectors, mean, projections, bits)
            number = int(block["key"][0] >> bits) % tables.shape[1]
            a, b = np.nonzero(near)
            first = np.ones(len(a), bool)
            for earlier in range(number):
                first &= tables[a, earlier] != tables[b, earlier]
            links = np.bincount(a[first], block["n"][b[first]], len(node)).astype(np.int64)
            counted = np.flatnonzero(links)
            yield _rows(node[counted], None, links[counted])
            edges = np.array(blocks.forest(len(node), lambda at, others: near[at, others]), np.int64).reshape(-1, 2)
            yield _rows(node[edges[:, 0]], node[edges[:, 1]], None)

    def _rows(node: np.ndarray, other: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(node), empty if other is None else pa.array(other), empty if links is None else pa.array(links)], names=["node", "other", "links"]
        )

    entries = nodes.mapInArrow(spread, "key long, node long, n long, vector array<double>")
    return blocks.in_blocks(entries, "node", setting.cap).mapInArrow(run, "node long, other long, links long")
