"""Near-duplicate classes with MinHash bands and odd sketches.

A document's set holds its distinct word shingles; documents are linked when
100 * intersection >= 80 * union of their full sets, and a class is what links
reach.  The steps:

1. each text becomes a node (the hash of its set), BANDS band keys of its
   MinHash values and an odd sketch: the parities of those values folded into
   BITS cells, whose XOR counts the values that two texts do not share;
2. in every bucket of a band all nodes meet the bucket's least node only, so a
   bucket of any size gives as many candidates as it has nodes; odd sketches
   drop the dissimilar ones and the full sets decide;
3. buckets join nodes to candidate clusters.  Where a cluster is not one class
   yet, the nodes outside its largest class are compared with all its nodes, in
   blocks of bounded size; a block returns a forest of links, never its pairs.
   Classes and nodes that many rows share get their names by broadcast (join_by_key).

Equal sets share a node from the start, so copies cost one row each.

Cases: a null or empty text, or one without words, has an empty set, no links,
and is a class of its own; a text with fewer words than a shingle has is one
shingle.  Rows that repeat an id are judged by their texts.  A null id never
names a class that has other ids.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._spark import join_by_key, kept, written
from ._text import LOWER, SPACED, U64, Words, mix, ngrams, pieces, signed, texts_of

#: Bands of ROWS MinHash values each: a pair at 0.8 misses all with probability (1 - 0.8^5)^40 = 1e-7.
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 1024
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_CHUNK = 1 << 16


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending inside each text, and each text's range of them."""
    h = words.hashes(LOWER)
    gram, at = ngrams(h, words.first, size)
    text = words.text
    parts, owners = [gram], [text[at]]
    for n in range(1, size):
        if (words.count == n).any():
            short, where = ngrams(h, words.first, n)
            own = text[where]
            parts.append(short[words.count[own] == n])
            owners.append(own[words.count[own] == n])
    gram, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(len(words.count) + 1))


def minhashes(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES MinHash values per text; texts without shingles get the largest value."""
    out = np.full((len(first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    low = (gram >> U64(32)).astype(np.uint32)
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + _CHUNK, "right")) - 1)
        full = np.flatnonzero(np.diff(first[i : j + 1])) + i
        if len(full):
            part, begin = low[first[i] : first[j]], first[full] - first[i]
            buf = np.empty_like(part)
            for k in range(HASHES):
                np.multiply(part, _MUL[k], out=buf)
                np.add(buf, _ADD[k], out=buf)
                out[full, k] = np.minimum.reduceat(buf, begin)
        i = j
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    v = m.astype(U64).reshape(len(m), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(m), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + v[:, :, r])
    return key


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the (position, MinHash value) samples, BITS / 64 words per text."""
    with np.errstate(over="ignore"):
        cell = mix(m.astype(U64) * U64(HASHES) + np.arange(HASHES, dtype=U64)) % U64(BITS)
    flat = (cell.astype(np.int64) + np.arange(len(m))[:, None] * BITS).ravel()
    parity = (np.bincount(flat, minlength=len(m) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(m), BITS), axis=1, bitorder="little").view(U64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from two equal stacks of odd sketches."""
    odd = np.bitwise_count(a ^ b).sum(axis=-1).astype(np.float64)
    return np.maximum(0.0, 1 + BITS / (4 * HASHES) * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9)))


#: Pairs at 0.8 and more have estimates above this but for one in 10^6 (standard error 0.035).
LEAST = 0.62
#: XOR count that this estimate stands for.
MOST_ODD = int(BITS / 2 * (1 - np.exp((LEAST - 1) * 4 * HASHES / BITS)))
#: Nodes a side of a block.
BLOCK = 1024


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = texts_of(piece.column(1))
                gram, first = shingle_sets(Words(data, off, SPACED), size)
                m = minhashes(gram, first)
                yield pa.RecordBatch.from_pydict({
                    "id": piece.column(0), "n": pa.array(np.diff(first), pa.int64()), "node": pa.array(signed(set_hashes(gram, first))),
                    "bands": _lists(signed(band_keys(m))), "sketch": _lists(signed(odd_sketches(m))),
                })

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def set_hashes(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's set."""
    acc = np.zeros(len(gram) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(gram + U64(0x5851F42D4C957F2D)), out=acc[1:])
        return mix(acc[first[1:]] - acc[first[:-1]] + np.diff(first).astype(U64))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: id, n (its set's size), node, bands, sketch."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_signatures(size), f"id {dict(docs.dtypes)[id_col]}, n long, node long, bands array<long>, sketch array<long>")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = texts_of(piece.column(0))
                gram, first = shingle_sets(Words(data, off, SPACED), size)
                yield pa.RecordBatch.from_pydict({"node": pa.array(signed(set_hashes(gram, first))), "members": pa.array([gram[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    return run


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets of hashes."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _block(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near = rows[rows["side"] == 0].drop_duplicates("node")
        far = rows[rows["side"] == 1].drop_duplicates("node")
        sketches = [np.array(x["sketch"].tolist(), np.int64).reshape(len(x), -1).view(U64) for x in (near, far)]
        sets = dict(zip(rows["node"], rows["members"], strict=True))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        kinds, nodes = far["class"].to_numpy(), far["node"].to_numpy()
        out = []
        for k, (node, own) in enumerate(zip(near["node"].tolist(), near["class"].tolist(), strict=True)):
            odd = np.bitwise_count(sketches[1] ^ sketches[0][k]).sum(axis=1)
            at = np.flatnonzero((odd <= MOST_ODD) & (kinds != own))
            for j in at[np.argsort(odd[at], kind="stable")].tolist():
                a, b = find(own), find(int(kinds[j]))
                if a != b and linked(sets[node], sets[int(nodes[j])], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((own, int(kinds[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the least id of its class) and kept (it has that id)."""
    kind = dict(docs.dtypes)[id_col]
    signed_rows = kept(signatures(docs, id_col, text_col, size))
    full = signed_rows.where(F.col("n") > 0)
    nodes = kept(full.groupBy("node").agg(F.min("id").alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))

    keyed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    stars = written(keyed.join(buckets, "band").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    met = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least", "sketch"), "node")
    met = kept(met)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    needed = texts.join(met.select(F.col("least").alias("id")).distinct(), "id", "left_semi").select("text")
    if docs.where(F.col(id_col).isNull()).limit(1).count():  # texts that only rows without an id have
        needed = needed.unionAll(docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")))
    sets = kept(needed.mapInArrow(_sets(size), "node long, members binary").dropDuplicates(["node"]).join(met.select("node"), "node", "left_semi"))

    def side(name: str, what: DataFrame, value: str) -> DataFrame:
        return what.select(F.col("node").alias(name), F.col(value).alias(f"{value}_{name}"))

    odd = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = stars.join(side("a", met, "sketch"), "a").join(side("b", met, "sketch"), "b").where(odd <= MOST_ODD).select("a", "b")
    pairs = likely.join(side("a", sets, "members"), "a").join(side("b", sets, "members"), "b").select("a", "b", "members_a", "members_b")
    links = written(pairs.mapInArrow(_confirm(percent), "a long, b long"))

    clusters = components(stars).select("node", F.col("label").alias("cluster"))
    classes = components(links).select("node", F.col("label").alias("class"))
    placed = written(clusters.join(classes, "node", "left").select("node", "cluster", F.coalesce("class", "node").alias("class")))
    sizes = placed.groupBy("cluster", "class").agg(F.count("*").alias("m"))
    split = sizes.groupBy("cluster").agg(F.count("*").alias("parts"), F.max_by("class", "m").alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).where("parts > 1")
    tall, wide = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    apart = placed.join(split.select("cluster", "main", tall.alias("tall"), wide.alias("wide")), "cluster")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    far = apart.select("cluster", "node", "class", own("tall").alias("i"), every("wide").alias("j"), F.lit(1).alias("side"))
    near = apart.where("class <> main").select("cluster", "node", "class", every("tall").alias("i"), own("wide").alias("j"), F.lit(0).alias("side"))
    both = far.unionAll(near).join(met.select("node", "sketch"), "node").join(sets, "node")
    more = both.groupBy("cluster", "i", "j").applyInPandas(_block(percent), "a long, b long")

    # Blocks link whole classes, so the last pass runs over classes, not over nodes.
    joined = components(written(more)).select(F.col("node").alias("class"), F.col("label").alias("whole"))
    own_class = written(nodes.select("node", "least").join(placed.select("node", "class"), "node", "left").select("node", "least", F.coalesce("class", "node").alias("class")))
    of_class = own_class.groupBy("class").agg(F.min("least").alias("least")).join(joined, "class", "left").select("class", "least", F.coalesce("whole", "class").alias("whole"))
    of_class = written(of_class)
    first = of_class.groupBy("whole").agg(F.min("least").alias("component_id"))
    named = written(join_by_key(of_class.select("class", "whole"), first, "whole").select("class", "component_id"))
    found = written(join_by_key(own_class.select("node", "class"), named, "class").select("node", "component_id"))
    whole = join_by_key(full.select("id", "n", "node"), found, "node").select("id", "n", "component_id")
    alone = signed_rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = whole.unionAll(alone)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with all its columns: of the rows with the class's least id the first by text hash and place.

    Rows are told apart by a number of their own, written with them first so that it stays; ids may repeat or be missing."""
    own, key = "_row_of_near_duplicates", "_key_of_near_duplicates"
    rows = written(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(own).alias("row"))
    gone = near_duplicates(rows.select(order.alias(key), text_col), key, text_col, size, percent).where("NOT kept").select(F.col(f"{key}.row").alias(own))
    return rows.join(gone, own, "left_anti").select(*(rows[f"`{c}`"] for c in docs.columns))
