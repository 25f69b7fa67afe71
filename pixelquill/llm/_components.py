"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: Edges that are left to one task, once rounds have brought them down to so many; 128 KB.
FEW = 1 << 13


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of all these edges that is not the least of its component, that least node."""
    root: dict = {}

    def find(x):
        while x in root:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(root), kind), "to": pa.array([find(x) for x in list(root)], kind)})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); the label is the least node of the component.

    Each round every node moves to the neighbour (or itself) that comes first, and edges
    are carried over to where their ends went; edges inside a place vanish.  First is the
    least node in even rounds, which takes a star around its least node at once, and the
    first of an order drawn anew by hashing in odd ones, which shrinks any graph (long
    paths too) by a constant factor.  There is one round at least, and rounds go on until
    no more than FEW edges are left, a number that does not grow with the input; a task
    settles those.  Each round is kept in the shared folder; lost executors cost one.
    `edges` is read three times, so keep it first.
    """
    kind = dict(edges.dtypes)["a"]
    rest, place, turn, left = edges, None, 0, FEW + 1
    while left > FEW:
        both = rest.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        order = (lambda c: F.xxhash64(F.lit(turn), c)) if turn % 2 else F.col  # noqa: B023
        first = lambda c: F.struct(order(c).alias("order"), F.col(c).alias("to"))  # noqa: B023, E731
        move = written(both.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("at"), F.least(first("a"), "m")["to"].alias("to")))
        start = rest.join(move.select(F.col("at").alias("a"), F.col("to").alias("to_a")), "a")
        moved = start.join(move.select(F.col("at").alias("b"), F.col("to").alias("to_b")), "b").where("to_a <> to_b")
        rest = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if place is None:
            place = move.select(F.col("at").alias("node"), F.col("to").alias("label"))
        else:
            place = written(place.join(move, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")))
        turn += 1
        left = rest.count()
    if left:
        move = written(rest.coalesce(1).mapInArrow(_settle, f"at {kind}, to {kind}"))
        place = place.join(F.broadcast(move), F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))
    if turn == 1:  # every step so far went to the least node
        return place
    least = place.groupBy("label").agg(F.min("node").alias("least"))
    return place.join(least, "label").select("node", F.col("least").alias("label"))
