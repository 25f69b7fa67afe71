"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A word's neighbouring pairs are the leaves of a tree that holds the least of
(rank, position): the root names the leftmost pair of the lowest rank.  A merge
changes three leaves (the pair itself, the one before, the one after), each in
logarithmic time; it goes on until the root is empty.  Many words of one tree
size are merged side by side, one row of a matrix each.

The vocabulary file is that of the tokenizers library with word ends: Unicode
NFC, lower case, the file's split pattern, bytes as characters, "</w>" on the
last.  Special tokens in a text are cut out first.  Decoding joins the tokens
with spaces, as the library does for a file without a decoder.

Cases: a null or empty text has no ids and decodes to the empty text; a very
long word has a larger tree; repeated rows are encoded each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces

#: Cells of one batch of trees.
CELLS = 1 << 22
#: Distinct words a task remembers.
CACHE = 400_000
NONE = np.int64(1) << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, as arrays."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_characters()
        self.plain = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.made, self.rank = key[order], made[order], rank[order]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank NONE where it does not merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[at], NONE), np.where(there, self.made[at], -1)


def merge_words(symbols: np.ndarray, count: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merge each row of symbols (count of them are set) to the end; merged-away places become -1."""
    rows, size = symbols.shape  # size: a power of two
    shift = np.int64(size.bit_length())
    tree = np.full((rows, 2 * size), NONE, np.int64)
    place = np.arange(size, dtype=np.int64)
    into = np.full((rows, size), -1, np.int64)
    sym = symbols.astype(np.int64)
    if size > 1:
        rank, made = vocab.look(sym[:, :-1], sym[:, 1:])
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, (rank << shift) | place[:-1], NONE)
        into[:, :-1] = made
    level = size
    while level > 1:  # build upwards
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    after = np.broadcast_to(place + 1, (rows, size)).copy()
    before = np.broadcast_to(place - 1, (rows, size)).copy()
    live = np.flatnonzero(tree[:, 1] < NONE)

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair_up(row: np.ndarray, leaf: np.ndarray) -> None:
        """Set the leaf to the rank of the symbol there and the one after it."""
        nxt = after[row, leaf]
        right = np.where(nxt < count[row], sym[row, np.minimum(nxt, size - 1)], -1)
        rank, made = vocab.look(sym[row, leaf], right)
        into[row, leaf] = made
        put(row, leaf, np.where(rank < NONE, (rank << shift) | leaf, NONE))

    while len(live):
        at = tree[live, 1] & ((np.int64(1) << shift) - 1)
        gone = after[live, at]
        sym[live, at] = into[live, at]
        sym[live, gone] = -1
        nxt = after[live, gone]
        after[live, at] = nxt
        more = nxt < count[live]
        before[live[more], nxt[more]] = at[more]
        put(live, gone, np.full(len(live), NONE))
        pair_up(live, at)
        left = before[live, at]
        has = left >= 0
        if has.any():
            pair_up(live[has], left[has])
        live = live[tree[live, 1] < NONE]
    return sym


class Coder:
    """Encode and decode whole texts; distinct words are merged once."""

    def __init__(self, vocabulary: str):
        self.vocab = Vocabulary(vocabulary)
        self.known: dict[str, int] = {}
        self.ids: list[list[int]] = []

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Each character on its own: a final sigma is no special case.
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        else:
            text = text.lower()
        return self.vocab.pattern.findall(text)

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
            self.ids.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        raw = [w.encode() for w in new]
        length = np.array([len(x) for x in raw], np.int64)
        width = np.ones(len(raw), np.int64)
        while (low := width < length).any():
            width[low] *= 2
        result: list[list[int]] = [[]] * len(new)
        for size in np.unique(width).tolist():
            own = np.flatnonzero(width == size)
            step = max(1, CELLS // (2 * size))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                n = length[part]
                flat = np.frombuffer(b"".join(raw[k] for k in part.tolist()), np.uint8)
                row = np.repeat(np.arange(len(part)), n)
                column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                symbols = np.full((len(part), size), -1, np.int64)
                symbols[row, column] = self.vocab.plain[flat]
                ends = np.cumsum(n) - 1
                symbols[np.arange(len(part)), n - 1] = self.vocab.final[flat[ends]]
                merged = merge_words(symbols, n, self.vocab)
                kept = merged >= 0
                values, counts = merged[kept].tolist(), kept.sum(axis=1).tolist()
                at = 0
                for k, c in zip(part.tolist(), counts, strict=True):
                    result[k] = values[at : at + c]
                    at += c
        base = len(self.ids)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        self.ids += result

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts: list[list[tuple[int, list[str]]]] = []  # per text: (special id or -1, words)
        for text in texts:
            if self.vocab.special_split and "<|" in text:
                cut = [(self.vocab.special.get(x, -1), x) for x in self.vocab.special_split.split(text)]
                parts.append([(i, [] if i >= 0 else self.words(x)) for i, x in cut])
            else:
                parts.append([(-1, self.words(text))])
        self.learn([w for text in parts for _, words in text for w in words])
        known, ids = self.known, self.ids
        out = []
        for text in parts:
            row: list[int] = []
            for special, words in text:
                if special >= 0:
                    row.append(special)
                else:
                    row += chain.from_iterable([ids[known[w]] for w in words])
            out.append(row)
        return out

    def decode(self, ids: list[int]) -> str:
        tokens = self.vocab.tokens
        return " ".join([tokens[i] for i in ids])


def _coded(vocabulary, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ids = coder.encode([t or "" for t in piece.column(1).to_pylist()])
                text = [coder.decode(x) for x in ids]
                packed = [np.array(x, "<u4").tobytes() for x in ids]
                out = {"id": piece.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                if keep:
                    out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(text, pa.string())}
                else:
                    out |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed]), "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text])}
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode_decode(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, n_tokens, and either ids and decoded text, or the digests of both.
    vocabulary_file is read on the driver; its text (under 2 MB) is broadcast."""
    with open(vocabulary_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(_coded(shared, not digests), f"id {kind}, n_tokens long, {more}").withColumnRenamed("id", id_col)
