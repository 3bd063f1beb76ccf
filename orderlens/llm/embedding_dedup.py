"""Embedding near-dedup: int8 tile products with error bounds.

Vectors of one label whose cosine is at least ``threshold`` are linked. Equal
vectors are one class first. The classes of a label are split into blocks,
and every pair of blocks is one tile. A tile gets unit vectors quantised to
int8 with their scale and error (an eighth of the doubles' bytes); products
of integers (exact in single precision) tell the cosine up to a bound that
follows from each vector's own quantisation error,

    |x.y - x'.y'| <= |x'| |y-y'| + |x-x'| |y'| + |x-x'| |y-y'|.

Pairs whose whole interval reaches the threshold are linked, those whose
interval stays below it are not. Only for the rest a tile asks for doubles:
it names the rows that are in such a pair, never the pairs, and these rows
meet again in a second tile, which computes the open pairs in double
precision. A tile returns how many vectors each of its rows is linked with
and a forest, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing; vectors of
different lengths don't link; rows with equal ids are vectors of their own;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .linking import Forest, block_pairs, components

MARGIN = 1e-9  # for rounding in the bounds themselves


def _clean(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vector): the components as packed doubles, null where nothing can link."""
    rows = rows.select(vec_id, label, embedding)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("vector", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            usable = np.asarray(lists.is_valid()) & np.asarray(b.column(0).is_valid()) & np.asarray(b.column(1).is_valid())
            values = lists.flatten()
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
            ends = np.concatenate(([0], np.cumsum(size)))
            wrong, filled = (np.concatenate(([0], np.cumsum(v))) for v in (~np.isfinite(x), x != 0))
            usable &= (wrong[ends[1:]] == wrong[ends[:-1]]) & (filled[ends[1:]] > filled[ends[:-1]])
            out = [x[s:e].tobytes() if u else None for s, e, u in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], schema=arrow)
    return rows.mapInArrow(run, schema)


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scale, the length of what they stand for, and its distance to the vector."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def _with_codes(classes: DataFrame) -> DataFrame:
    """``classes`` with ``code``, ``scale``, ``size`` and ``error`` of their vectors."""
    schema = T.StructType([*classes.schema.fields, T.StructField("code", T.BinaryType()), *(
        T.StructField(n, T.DoubleType()) for n in ("scale", "size", "error"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(b.schema.get_field_index("vector"))
            length = np.asarray(pc.binary_length(packed))
            for n in np.unique(length).tolist():
                some = b.take(pa.array(np.flatnonzero(length == n)))
                q, *numbers = _codes(_units(_matrix(some.column(b.schema.get_field_index("vector")), np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([r.tobytes() for r in q], pa.binary()), *map(pa.array, numbers)], schema=arrow)
    return classes.mapInArrow(run, schema)


def _matrix(column, dtype) -> np.ndarray:
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1)


def _near(codes: tuple, block: np.ndarray, split: bool, threshold: float,
          rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of all pairs that may reach the threshold, part by part; ``sure`` ones do.

    With ``split`` pairs are between two blocks, else among all rows. A pair's interval
    depends on its two rows' codes alone, in either order."""
    q, scale, size, error = codes
    # integers below 2**24 are exact in single precision; longer vectors take double
    whole = q.astype(np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64)
    first, second = (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())) if split else (
        np.arange(len(q)), np.arange(len(q)))
    for at in range(0, len(first), rows):
        a = first[at:at + rows]
        b = second if split else second[at:]
        product = (whole[a] @ whole[b].T) * np.outer(scale[a], scale[b])
        bound = np.outer(size[a], error[b]) + np.outer(error[a], size[b]) + np.outer(error[a], error[b])
        i, j = np.nonzero(product + bound >= threshold - MARGIN)
        sure = product[i, j] - bound[i, j] >= threshold + MARGIN
        i, j = a[i], b[j]
        if not split:
            once = i < j
            i, j, sure = i[once], j[once], sure[once]
        yield i, j, sure


class _Links:
    """For each row the weight of its links, and a forest of the links."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.linked, self.forest = weight, np.zeros(len(weight), dtype=np.int64), Forest(len(weight))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        n, weight = len(self.weight), self.weight
        self.linked += np.bincount(u, weight[v], n).astype(np.int64) + np.bincount(v, weight[u], n).astype(np.int64)
        self.forest.add(u, v)


def _coded_tile(codes: tuple, block: np.ndarray, split: bool, weight: np.ndarray, threshold: float,
                rows: int = 512) -> tuple[_Links, np.ndarray]:
    """The links that codes are sure of, and whether a row is in a pair that they leave open."""
    links, open_ = _Links(weight), np.zeros(len(weight), dtype=bool)
    for i, j, sure in _near(codes, block, split, threshold, rows):
        links.add(i[sure], j[sure])
        open_[i[~sure]] = open_[j[~sure]] = True
    return links, open_


def _open_tile(vectors: np.ndarray, codes: tuple, block: np.ndarray, split: bool, weight: np.ndarray, threshold: float,
               rows: int = 512, pairs: int = 1 << 16) -> _Links:
    """The links among the pairs that ``codes`` leave open, in double precision."""
    x = _units(vectors)
    links = _Links(weight)
    for i, j, sure in _near(codes, block, split, threshold, rows):
        i, j = i[~sure], j[~sure]
        for k in range(0, len(i), pairs):
            u, v = i[k:k + pairs], j[k:k + pairs]
            near = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            links.add(u[near], v[near])
    return links


def link(rows: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
         label: str = "label", block_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id): vectors linked directly, and the smallest id that links reach."""
    vectors = materialize(_clean(rows, vec_id, embedding, label))
    classes = (vectors.where("vector is not null").groupBy(label, "vector")
               .agg(F.min(vec_id).cast("long").alias("least"), F.count(F.lit(1)).alias("copies"))
               .withColumn("node", F.monotonically_increasing_id())
               .withColumn("key", F.xxhash64(F.col(label).cast("string"), F.octet_length("vector"))))
    classes = materialize(_with_codes(classes))
    tile, codes_of = ["key", "label", "lo", "hi"], ["code", "scale", "size", "error"]
    members = block_pairs(classes.select("key", F.col(label).alias("label"), "node", "copies", *codes_of),
                          "key", "node", block_rows)
    shape = T.StructType([members.schema["key"], members.schema["label"], *(T.StructField(n, T.IntegerType()) for n in (
        "lo", "hi", "block")), *(T.StructField(n, T.LongType()) for n in ("node", "copies", "root", "n")),
        T.StructField("open", T.BooleanType())])
    arrow = to_arrow_schema(shape)

    def given(table: pa.Table):
        node, copies, block = (np.asarray(table.column(c)) for c in ("node", "copies", "block"))
        split = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        codes = (_matrix(table.column("code"), np.int8), *(np.asarray(table.column(c)) for c in codes_of[1:]))
        return node, copies, block, split, codes

    def coded(table: pa.Table) -> pa.Table:
        node, copies, block, split, codes = given(table)
        if split and len(np.unique(block)) < 2:
            return arrow.empty_table()
        links, open_ = _coded_tile(codes, block, split, copies, threshold)
        some = np.flatnonzero((links.linked > 0) | open_)
        out = {c: table.column(c).take(pa.array(some)) for c in (*tile, "block", "node", "copies")}
        out |= {"root": pa.array(node[links.forest.label[some]]), "n": pa.array(links.linked[some]), "open": pa.array(open_[some])}
        return pa.table([out[c].cast(arrow.field(c).type) for c in arrow.names], schema=arrow)

    def exact(table: pa.Table) -> pa.Table:
        node, copies, block, split, codes = given(table)
        links = _open_tile(_matrix(table.column("vector"), np.float64), codes, block, split, copies, threshold)
        some = np.flatnonzero(links.linked)
        return pa.table({"node": node[some], "root": node[links.forest.label[some]], "n": links.linked[some]})

    sure = materialize(members.groupBy(*tile).applyInArrow(coded, shape))
    doubtful = (sure.where("open").select(*tile, "block", "node", "copies")
                .join(classes.select("node", "vector", *codes_of), "node"))
    found = sure.where("n > 0").select("node", "root", "n").unionByName(materialize(
        doubtful.groupBy(*tile).applyInArrow(exact, "node long, root long, n long")))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # the smallest id of a component's vectors
    groups = groups.join(classes.select("node", "least"), "node")
    groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("node", "smallest")
    named = (classes.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(groups, "node", "left")
             .select(label, "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("smallest", "least").alias("component_id")))
    # equal vectors may be very many; the join splits them where they are
    return vectors.join(named, [label, "vector"], "left").select(
        vec_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col(vec_id).cast("long")).alias("component_id"))
