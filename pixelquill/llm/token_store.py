"""Token ids in grammar-compressed binary shards (Re-Pair).

Documents are dealt out by ranges of their id, so shards follow each other in
ascending id order; each shard is a run of blocks.  A block holds the ids of
consecutive documents as one sequence in which frequent pairs are replaced by
nonterminals, again and again, until no pair pays for its rule; symbols have as many
bits as the block's rules call for.  No rule crosses a document's end.  Beside the sequence it
stores the rules (two symbols each), the length every rule expands to and each
document's first symbol and token, so one document is decoded by expanding its
own symbols only.

One round replaces many pairs: the most frequent ones are ranked, and where two
occurrences overlap the one of better rank is taken.  The best pair of a round always
gets all its uses, so each round shortens the sequence, and rounds go on to the end.

File format: a folder of Parquet files with the columns of SCHEMA, written by
Spark's committer; a row is a block, binary columns are little-endian arrays (symbols and
rules are packed in symbol_bits each).

Texts are encoded by the tokenizers library.  The byte-level split always begins
a token at a space before anything but white space, at a line end after an ASCII
character, and at a punctuation mark after an ASCII letter; texts are cut there
and each distinct piece of a task is encoded once.

Cases: a null or empty text has no ids but the end id; repeated ids keep all
their rows, ordered by text; null ids come first; an empty table gives an empty
store.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import new_path
from ._text import U64, pieces, span_hashes, texts_of

#: Tokens a block holds before it is closed.
BLOCK_TOKENS = 1 << 20
#: Pairs replaced in one round (others wait for the next) while symbols have 16 bits, and the uses that pay for a rule.
ROUND_RULES = 4096
MIN_USES = 4
#: Distinct pieces a Python worker remembers, from task to task.
CACHE = 1_000_000

SCHEMA = "shard int, block int, first_token long, n_tokens long, base int, ids array<{id}>, doc_symbol binary, doc_token binary, rules binary, lengths binary, symbols binary"

_no_cut = np.zeros(256, bool)
_no_cut[:0x21] = True
_no_cut[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of Unicode's white space
_letter = np.isin(_codes := np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_mark = np.isin(_codes, np.frombuffer(b".,!?;:", np.uint8))
_gap = (_codes == 0x20) | (_codes == 0x0A)
_black = (_codes > 0x20) & (_codes < 0x7F)


class Encoder:
    """Ids of whole texts from one tokenizer file, distinct pieces encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.leads = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token[0] in "ĠĊ"  # space, line feed
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.end = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _store(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(lengths) + 1 > len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.end[n + 1 : n + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(ids)

    def _name(self, keys: list[int]) -> None:
        n = len(self.known)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Encode new pieces; plain ones (a space or line feed leads, none follows) many at a time."""
        gaps = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_gap[data], out=gaps[1:])
        plain = _gap[data[start]] & (end > start + 1)
        plain[plain] = gaps[end[plain]] == gaps[start[plain] + 1]
        others = np.flatnonzero(~plain).tolist()
        plain = np.flatnonzero(plain)
        length = end - start
        for group in (plain[i : i + 8192] for i in range(0, len(plain), 8192)):
            joined = gather(data, start[group], length[group]).tobytes().decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            begin = np.flatnonzero(self.leads[ids])
            if len(begin) != len(group):
                others += group.tolist()
                continue
            self._store(np.diff(np.append(begin, len(ids))), ids)
            self._name(keys[group].tolist())
        for group in (others[i : i + 1024] for i in range(0, len(others), 1024)):
            found = self.tokenizer.encode_batch_fast([data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in group], add_special_tokens=False)
            ids = [x.ids for x in found]
            self._store(np.array([len(x) for x in ids]), np.array([t for x in ids for t in x], np.int32))
            self._name(keys[group].tolist())

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's range of them."""
        if len(self.known) > CACHE:
            self.forget()
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n:
            cut[: n - 1] = (data[:-1] == 0x20) & ~_no_cut[data[1:]]
            cut[1:n] |= (_mark[data[1:]] & _letter[data[:-1]]) | ((data[1:] == 0x0A) & _black[data[:-1]])
        inner = off[1:-1]
        cut[inner[inner > 0] - 1] = False  # a text's last byte begins no piece
        cut[off] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n) if len(start) else start
        code, keys = pd.factorize(span_hashes(data, start, end))
        if len(code):
            begins = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
            listed = keys.tolist()
            held = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
            new = np.flatnonzero(held < 0)
            if len(new):
                at = begins[new]
                self._learn(data, start[at], end[at], keys[new])
                held[new] = np.fromiter(map(self.known.__getitem__, keys[new].tolist()), np.int64, len(new))
            piece = held[code]
        else:
            piece = np.zeros(0, np.int64)
        lengths = self.end[piece + 1] - self.end[piece]
        ids = gather(self.flat, self.end[piece], lengths)
        total = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, total[np.searchsorted(start, off)]


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder of a file; what it remembers only saves work."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each, in a row."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return flat[np.arange(total) + np.repeat(start - out, lengths)]


def _taken(at: np.ndarray, rank: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ranks) of the uses that are replaced, and which pairs still pay: where two uses overlap, the one of better rank stays."""
    touch = at[1:] == at[:-1] + 1
    take = np.ones(len(at), bool)
    take[:-1] &= ~touch | (rank[:-1] <= rank[1:])
    take[1:] &= ~touch | (rank[1:] < rank[:-1])
    at, rank = at[take], rank[take]
    pays = np.bincount(rank, minlength=pairs) >= MIN_USES
    good = pays[rank]
    return at[good], rank[good], pays


def _every_second(key: np.ndarray, at: np.ndarray | None, none_such: np.unsignedinteger) -> None:
    """In a run of one symbol only every second pair counts, so uses never overlap themselves."""
    same = key[1:] == key[:-1]
    if at is not None:
        same &= at[1:] == at[:-1] + 1
    again = np.flatnonzero(same) + 1
    if len(again):
        breaks = np.flatnonzero(np.r_[True, again[1:] != again[:-1] + 1])
        nth = np.arange(len(again)) - np.repeat(breaks, np.diff(np.append(breaks, len(again))))
        key[again[nth % 2 == 0]] = none_such


def _counted(key: np.ndarray, none_such: np.unsignedinteger) -> tuple[np.ndarray, np.ndarray]:
    """(pairs used MIN_USES times and more, ascending; their uses)."""
    ordered = np.sort(key)
    begin = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    uses = np.diff(np.append(begin, len(ordered)))
    often = np.flatnonzero(uses >= MIN_USES)
    often = often[ordered[begin[often]] != none_such]
    return ordered[begin[often]], uses[often]


def compress(seq: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, the places of documents' final symbols, rules as rows of two symbols).
    `ends` are those places before; nonterminals count from base.

    Rounds go over all pairs while the next round's rules fit 16-bit symbols.  Later ones only go over
    pairs that can still pay: those that did before, and those with a new symbol, as others' uses only
    become fewer."""
    seq, rules = seq.astype(np.uint32), np.zeros((0, 2), np.int64)

    def replaced(at: np.ndarray, rank: np.ndarray, pays: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Put new symbols at the places; returns which symbols stay."""
        nonlocal rules, ends
        seq[at] = (base + len(rules) + np.cumsum(pays) - 1)[rank]
        rules = np.concatenate([rules, np.stack([first[pays], second[pays]], 1).astype(np.int64)])
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        ends = ends - np.searchsorted(at + 1, ends, "right")
        return stays

    while len(seq) > 1 and base + len(rules) + ROUND_RULES <= 1 << 16:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        none_such = np.iinfo(np.uint32).max  # no pair of symbols has this key
        key[ends[:-1]] = none_such  # pairs of two documents
        _every_second(key, None, none_such)
        pairs, uses = _counted(key, none_such)
        if not len(pairs):
            return seq, ends, rules
        best = np.argpartition(-uses, ROUND_RULES)[:ROUND_RULES] if len(uses) > ROUND_RULES else np.arange(len(uses))
        chosen = pairs[best[np.argsort(-uses[best], kind="stable")]]
        none = len(chosen)
        rank = np.full(1 << 16, none, np.uint16)  # by hash; the better of two in a slot stays
        slot = lambda k: (k * np.uint32(0x9E3779B1)) >> np.uint32(16)
        rank[slot(chosen)[::-1]] = np.arange(none, dtype=np.uint16)[::-1]
        r = rank[slot(key)]
        at = np.flatnonzero(r < none)
        r = r[at]
        right = chosen[r] == key[at]
        at, r, pays = _taken(at[right], r[right].astype(np.int32), none)
        seq = seq[replaced(at, r, pays, chosen >> np.uint32(16), chosen & np.uint32(0xFFFF))]
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        live[-1] = live[ends] = False  # pairs of two documents
        at = np.flatnonzero(live)
        key = (seq[at].astype(U64) << U64(32)) | seq[at + 1]
        none_such = np.iinfo(U64).max
        _every_second(key, at, none_such)
        pairs, uses = _counted(key, none_such) if len(key) else (key, key)
        if not len(pairs):
            break
        order = np.argsort(-uses, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        place = np.searchsorted(pairs, key)
        place[place == len(pairs)] = 0
        right = pairs[place] == key
        known = at[right]
        at, r, pays = _taken(known, rank[place[right]], len(pairs))
        ranked = pairs[order]
        live[:] = False
        live[known] = True
        stays = replaced(at, r, pays, ranked >> U64(32), ranked & U64(0xFFFFFFFF))
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        before = at - 2  # what stands before a place that is replaced may be a new symbol's second part
        live[before[before >= 0]] |= ~stays[np.maximum(at - 1, 0)][before >= 0]
        seq, live = seq[stays], live[stays]
    return seq, ends, rules


def packed(values: np.ndarray, bits: int) -> bytes:
    """Non-negative integers of so many bits each, one after the other from the lowest bit on."""
    if bits in (8, 16, 32):
        return values.astype(f"<u{bits // 8}").tobytes()
    wide = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}").astype(np.int64)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    flags = flags[: len(flags) // bits * bits].reshape(-1, bits)
    whole = np.zeros((len(flags), 32), np.uint8)
    whole[:, :bits] = flags
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def symbol_bits(base: int, rules: int) -> int:
    """The width of a block's symbols."""
    return max(8, (base + rules - 1).bit_length())


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): what every symbol expands to.  Rules name earlier symbols only."""
    n = base + len(rules)
    length = np.ones(n, np.int64)
    flat = [np.arange(base, dtype=np.int32)]
    start = np.zeros(n, np.int64)
    start[:base] = np.arange(base)
    done, size = base, base
    store = flat[0]
    while done < n:
        part = rules[done - base :]
        ready = int(np.argmax((part >= done).any(axis=1))) if (part >= done).any() else len(part)
        a, b = part[:ready, 0], part[:ready, 1]
        length[done : done + ready] = length[a] + length[b]
        both = np.stack([a, b], 1).ravel()
        new = gather(store, start[both], length[both])
        own = length[done : done + ready]
        start[done : done + ready] = size + np.cumsum(own) - own
        store = np.concatenate([store, new])
        size += len(new)
        done += ready
    return store, start, length


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = encoder_for(path)
        base = encoder.size
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        block = first = 0

        def close() -> pa.RecordBatch:
            nonlocal block, first
            ids = pa.concat_arrays([x[0] for x in held])
            counts = np.concatenate([x[2] for x in held])
            tokens = np.concatenate([x[1] for x in held])
            n = len(tokens)
            symbols, ends, rules = compress(tokens, np.cumsum(counts) - 1, base)
            bits = symbol_bits(base, len(rules))
            _, _, length = expansions(rules, base)
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first_token": pa.array([first], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "base": pa.array([base], pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "doc_symbol": pa.array([np.r_[0, ends + 1].astype("<u4").tobytes()], pa.binary()),
                "doc_token": pa.array([np.r_[0, np.cumsum(counts)].astype("<u8").tobytes()], pa.binary()), "rules": pa.array([packed(rules.ravel(), bits)], pa.binary()),
                "lengths": pa.array([length[base:].astype("<u4").tobytes()], pa.binary()), "symbols": pa.array([packed(symbols, bits)], pa.binary()),
            })
            block, first = block + 1, first + n
            held.clear()
            return row

        size = 0
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 22):  # large, so that fewer pieces ask for the same words
                tokens, first_id = encoder.encode(*texts_of(piece.column(1)))
                counts = np.diff(first_id)
                closed = np.insert(tokens, first_id[1:], end_id)
                held.append((piece.column(0), closed, counts + 1))
                size += len(closed)
                if size >= BLOCK_TOKENS:
                    yield close()
                    size = 0
        if held:
            yield close()

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None) -> str:
    """Encode and write docs to `path` in ascending id order; the end id closes each document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    rows.mapInArrow(_write(tokenizer, end_id), SCHEMA.format(id=kind)).write.mode("overwrite").parquet(path)
    return path


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, start, length = table
    s = symbols.astype(np.int64)
    return gather(flat, start[s], length[s])


class Block:
    """One stored block; documents decode on their own."""

    def __init__(self, row: dict):
        rules = len(row["lengths"]) // 4
        bits = symbol_bits(row["base"], rules)
        self.ids = row["ids"]
        self.doc_symbol = np.frombuffer(row["doc_symbol"], "<u4").astype(np.int64)
        self.doc_token = np.frombuffer(row["doc_token"], "<u8").astype(np.int64)
        self.first_token = row["first_token"]
        self.symbols = unpacked(row["symbols"], bits)[: self.doc_symbol[-1]]
        self.table = expansions(unpacked(row["rules"], bits)[: 2 * rules].reshape(-1, 2), row["base"])

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.doc_symbol[k] : self.doc_symbol[k + 1]], self.table)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.table)


def _read(before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                column = batch.column(batch.schema.get_field_index("ids"))
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names) if name != "ids"}
                block = Block(row | {"ids": None})
                tokens = block.all().astype("<u4")
                edges = block.doc_token
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                start = before[row["shard"]] + row["first_token"] + edges[:-1]
                yield pa.RecordBatch.from_pydict({"id": column[k].values, "start": pa.array(start, pa.int64()), "n_tokens": pa.array(np.diff(edges), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_index(spark, path: str, kind: str = "bigint") -> DataFrame:
    """Per stored document: id (of type `kind`), start, n_tokens and the crc32 of its ids, decoded from the files."""
    stored = spark.read.schema(SCHEMA.format(id=kind)).parquet(path)
    totals = {r["shard"]: r["n"] for r in stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a shard
    before, so_far = {}, 0
    for shard in sorted(totals):
        before[shard], so_far = so_far, so_far + totals[shard]
    return stored.mapInArrow(_read(before), f"id {kind}, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write docs to a store in the shared folder and read it back."""
    spark = docs.sparkSession
    path = write_store(docs, tokenizer, new_path(spark, "tokens"), id_col, text_col, end_id)
    return read_index(spark, path, dict(docs.dtypes)[id_col]).withColumnRenamed("id", id_col)
