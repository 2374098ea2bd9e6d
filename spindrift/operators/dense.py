"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.lexical import ranked
from spindrift.session import spread

#: Queries that a worker holds at a time, and distances that it computes at once.
QUERY_BLOCK, DISTANCES = 10_000, 1 << 20


def dense_topk(queries: DataFrame, collection: DataFrame, k: int = 50, digits: int = 6) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, nearest first.

    ``queries(query_id, vector)``, ``collection(id, embedding)``. The collection never moves: blocks of
    queries go to it, and each batch of rows hands on its k nearest per query. Rows without a vector,
    or with one of another length than the query's, are near to nothing.
    """
    wanted = queries.select("query_id", "vector")
    blocks = -(-wanted.count() // QUERY_BLOCK)
    rows = spread(collection.select("id", "embedding"))
    kinds = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    near = None
    for i in range(max(1, blocks)):
        part = wanted if blocks <= 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        one = rows.mapInArrow(_nearest(part.toArrow(), k, digits), kinds)
        near = one if near is None else near.unionByName(one)
    return ranked(near, k, F.col("distance"), F.col("id"))


def _nearest(queries: pa.Table, k: int, digits: int):
    """A function from batches (id, embedding) to candidates (query_id, id, distance)."""
    ids = queries.column("query_id").combine_chunks()
    groups: dict[int, list[int]] = {}
    vectors = [None if v is None or None in v else np.array(v, np.float64) for v in queries.column("vector").to_pylist()]
    for at, v in enumerate(vectors):
        if v is not None:
            groups.setdefault(len(v), []).append(at)
    by_length = {n: (np.array(at), np.stack([vectors[i] for i in at])) for n, at in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            sizes = np.array([-1 if v is None or None in v else len(v) for v in found])
            for n, (at, asked) in by_length.items():
                own = np.flatnonzero(sizes == n)
                if not len(own):
                    continue
                held = np.array([found[i] for i in own], np.float64)
                step = max(1, DISTANCES // (len(own) * max(1, n)))
                for start in range(0, len(at), step):
                    block = asked[start : start + step]
                    gaps = ((block[:, None, :] - held[None, :, :]) ** 2).sum(axis=2)
                    # ties at the border stay, so that the final order decides
                    border = np.partition(gaps, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1] if k > 0 else np.full(len(block), -1.0)
                    which, row = np.nonzero(np.round(gaps, digits) <= np.round(border, digits)[:, None])
                    if len(which):
                        columns = [ids.take(pa.array(at[start + which])), batch.column(0).take(pa.array(own[row])), pa.array(np.round(gaps[which, row], digits))]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "distance"])

    return run
