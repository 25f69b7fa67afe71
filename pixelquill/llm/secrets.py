"""Secret scans: fixed patterns, and a character convolutional network over candidates.

Every run of CANDIDATE characters of MIN_RUN and more is a candidate (shorter ones are
found by the patterns only), and so is what is left of a run beside a pattern's span,
if it has MIN_RUN characters.  A small convolutional network in numpy reads the candidate and its surroundings (long
candidates in overlapping windows, the worst of which counts) and is trained on all
distinct labelled findings: a candidate that a pattern finds is positive, any other
negative, unless a first fit takes it for a secret that the patterns miss.
So that it learns what secrets look like and not the patterns' own key words, it
also sees random strings over several alphabets, in the negatives' surroundings and
in none; so that it learns what words look like, it sees words of the surroundings
joined as in addresses, paths and names, as negatives.  Scores are calibrated on findings held out of the training, and the
threshold is the highest one that still recalls RECALL of the held-out positives,
as found and varied.

The findings are dealt by hash into shards of about SHARD each.  In a round every shard
goes on from the same weights over its own findings, and their mean, by the shards'
rows, begins the next round.  Quantiles, calibration and threshold are read from
counts of scores over all shards, in steps of 1 / BINS.

Every candidate is scored.  Found are all pattern spans, and the candidates beyond
them that reach the threshold; each with the probability of its candidate, where it
has one.  Offsets are code points, ends exclusive.

Cases: null and empty texts have no spans; where the findings have no positive or no
negative the network adds nothing; repeated rows are scanned each; an empty table
gives no rows.  Shards go by a hash of the window and weights and counts are summed as
integers, so ties, order and partitions do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept
from ._text import Words, pieces, texts_of

# The patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "network")

MIN_RUN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_run_bytes = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8))
#: Code points before, inside and after a window.
BEFORE, INSIDE, AFTER = 16, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
#: Labelled findings of a shard; rounds over more than one shard; steps of a score's unit, and the largest score told apart.
SHARD, ROUNDS, BINS, MOST_SCORE = 8000, 6, 256, 64
#: Strings that are made up in a shard at least.
LEAST_MADE = 1000
#: Unit of the weights' sums.
FIXED = 2.0**-30
RECALL = 0.99
#: Gradient steps at least.
STEPS = 500
#: Negatives above this quantile of random strings' scores are set aside.
ASIDE = 0.1
EMBED, WIDTH, FILTERS = 8, 5, 24

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, runs: bool = True) -> list[Span]:
    """The pattern findings, by start and kind.  runs: whether the text has a run of MIN_RUN candidate bytes."""
    out: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def encode(text: str) -> bytes:
    """ASCII graphic characters and space as themselves, anything else as one of two marks."""
    return bytes(ord(c) if " " <= c <= "~" else (10 if c.isspace() else 127) for c in text)


def windows(text: str, start: int, end: int) -> bytes:
    """The candidate's windows in a row, LENGTH bytes each."""
    out = []
    at = start
    while True:
        stop = min(at + INSIDE, end)
        left, right = text[max(0, at - BEFORE) : at], text[stop : stop + AFTER]
        out.append(encode(left).rjust(BEFORE) + encode(text[at:stop]).ljust(INSIDE, b"\x00") + encode(right).ljust(AFTER))
        if stop == end:
            return b"".join(out)
        at += INSIDE // 2


def beside(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans, some at least, leave of a run, if long enough to be a candidate."""
    edges = [(start, start), *sorted((s[0], s[2]) for s in spans), (end, end)] if spans else []
    out, done = [], start
    for a, b in edges:
        if a - done >= MIN_RUN:
            out.append((done, a))
        done = max(done, b)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, off = texts_of(piece.column(1))
            runs = Words(data, off, _run_bytes)
            long = np.zeros(piece.num_rows, bool)
            long[runs.text[runs.end - runs.start >= MIN_RUN]] = True
            base, found = [], []
            for text, has in zip(piece.column(1).to_pylist(), long.tolist(), strict=True):
                text = text or ""
                spans = base_spans(text, has)
                base.append([x for s in spans for x in s])
                own = []
                if has:
                    for m in CANDIDATE.finditer(text):
                        within = [s for s in spans if s[0] < m.end() and m.start() < s[2]]
                        own.append({"start": m.start(), "end": m.end(), "hit": bool(within), "part": False, "windows": windows(text, m.start(), m.end())})
                        for a, b in beside(m.start(), m.end(), within):
                            own.append({"start": a, "end": b, "hit": False, "part": True, "windows": windows(text, a, b)})
                found.append(own)
            shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hit", pa.bool_()), ("part", pa.bool_()), ("windows", pa.binary())]))
            yield pa.RecordBatch.from_pydict({"id": piece.column(0), "base": pa.array(base, pa.list_(pa.int32())), "found": pa.array(found, shape)})


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base (start, kind, end in a row) and every candidate with its windows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"id {dict(docs.dtypes)[id_col]}, base array<int>, found array<struct<start: int, end: int, hit: boolean, part: boolean, windows: binary>>")


class Network:
    """Embedding, one convolution, the largest and the mean response of each filter, a logistic unit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (128, EMBED)), "w": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS),
            "v": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, np.inf

    def forward(self, x: np.ndarray):
        embedded = self.p["e"][x]
        columns = np.concatenate([embedded[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        z = columns @ self.p["w"] + self.p["b"]
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return columns, z, top, h, h @ self.p["v"] + self.p["c"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, share: float, rounds: int = 1, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """One of several rounds over x.  share: the share of positives in all shards."""
        epochs = max(-(-epochs // rounds), -(-STEPS * batch // max(len(x) * rounds, 1)))
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        m, s = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                columns, z, top, h, score = self.forward(x[own])
                d = weight[own] * (_sigmoid(score) - y[own]) / len(own)
                dh = d[:, None] * self.p["v"]
                da = np.repeat(dh[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
                row = np.arange(len(own))[:, None]
                da[row, top, np.arange(FILTERS)] += dh[:, :FILTERS]
                dz = da * (z > 0)
                dc = dz @ self.p["w"].T
                each = np.zeros((len(own), LENGTH, EMBED))
                for k in range(WIDTH):
                    each[:, k : LENGTH - WIDTH + 1 + k] += dc[:, :, k * EMBED : (k + 1) * EMBED]
                seen = x[own].ravel()
                de = np.stack([np.bincount(seen, each[:, :, j].ravel(), 128) for j in range(EMBED)], 1)
                grads = {"e": de, "w": np.tensordot(columns, dz, ([0, 1], [0, 1])), "b": dz.sum((0, 1)), "v": h.T @ d, "c": np.array([d.sum()])}
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def calibrate(self, score: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """Platt scaling by gradient steps, then the recall-constrained threshold.  times: how often each score occurs."""
        center = np.average(score, weights=times)
        spread = np.sqrt(np.average((score - center) ** 2, weights=times)) + 1e-9
        high, low = times[y > 0].sum(), times[y < 1].sum()
        a, b, z = 1.0, 0.0, (score - center) / spread
        target = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
        for _ in range(500):
            g = _sigmoid(a * z + b) - target
            a, b = a - 0.5 * np.average(g * z, weights=times), b - 0.5 * np.average(g, weights=times)
        self.scale, self.shift = a / spread, b - a * center / spread
        p = self.probability(score[y > 0])
        order = np.argsort(p, kind="stable")
        at = np.searchsorted(np.cumsum(times[y > 0][order]), int(np.floor((1 - RECALL) * high)), "right")
        self.threshold = float(p[order[at]])

    def probability(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * score + self.shift)

    def judge(self, packed: list[bytes]) -> np.ndarray:
        """Each candidate's probability, the largest over its windows."""
        if not packed:
            return np.zeros(0)
        count = np.array([len(w) // LENGTH for w in packed])
        p = self.probability(self.logits(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, LENGTH)))
        return np.maximum.reduceat(p, np.cumsum(count) - count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_ALPHABETS = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")]


_BETWEEN = np.frombuffer(b"._-=", np.uint8)


def varied(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positives in the surroundings of the rows given (half of them in none), their characters drawn
    from one alphabet each, in a length of their own, some in parts with a mark between."""
    out = x.copy()
    bare = rng.random(len(out)) < 0.5
    out[bare, :BEFORE], out[bare, BEFORE + INSIDE :] = 32, 32
    for row in out:
        letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
        n = int(rng.integers(20, INSIDE + 1))
        row[BEFORE : BEFORE + INSIDE] = 0
        row[BEFORE : BEFORE + n] = letters[rng.integers(0, len(letters), n)]
        if rng.random() < 0.3:
            row[BEFORE + int(rng.integers(2, n - 8))] = _BETWEEN[rng.integers(len(_BETWEEN))]
        if n == INSIDE:  # a long one goes on
            row[BEFORE + INSIDE :] = letters[rng.integers(0, len(letters), AFTER)]
    return out


def bare(x: np.ndarray) -> np.ndarray:
    """The rows without their surroundings."""
    out = x.copy()
    out[:, :BEFORE], out[:, BEFORE + INSIDE :] = 32, 32
    return out


#: Letters of the surroundings that joined() takes for a word; what it puts between words.
WORD = re.compile(rb"[A-Za-z]{2,12}")
_JOINTS = (b"/", b"-", b".", b"_", b"=", b"")


def joined(x: np.ndarray, rng: np.random.Generator, count: int) -> np.ndarray:
    """Negatives made of the surroundings' words, joined as in addresses, paths and names, half of them in no surroundings."""
    around = np.concatenate([x[:, :BEFORE], np.full((len(x), 1), 32, np.uint8), x[:, BEFORE + INSIDE :]], axis=1)
    words = sorted({w for row in around for w in WORD.findall(row.tobytes())})
    if not words:
        return x[:0]
    out = x[rng.integers(0, len(x), count)].copy()
    bare_rows = rng.random(count) < 0.5
    out[bare_rows, :BEFORE], out[bare_rows, BEFORE + INSIDE :] = 32, 32
    for row in out:
        shape = (bytes.lower, bytes.lower, bytes.title, bytes.upper)[rng.integers(4)]
        joints = [_JOINTS[i] for i in rng.integers(0, len(_JOINTS), 2)]
        n, made = int(rng.integers(MIN_RUN, INSIDE + 1)), b""
        while len(made) < n:
            word = shape(words[rng.integers(len(words))])
            made += (word if rng.random() < 0.85 else b"%d" % rng.integers(0, 10000)) + joints[rng.integers(2)]
        row[BEFORE : BEFORE + INSIDE] = 0
        row[BEFORE : BEFORE + n] = np.frombuffer(made[:n], np.uint8)
    return out


class Shard:
    """One shard's findings x with labels y, and what is made of them; the same in every pass."""

    def __init__(self, number: int, x: np.ndarray, y: np.ndarray, only: bool):
        self.number, self.x, self.y = number, x, y
        order = self._rng(0).permutation(len(x))
        self.out, self.own = order[: len(x) // 4], order[len(x) // 4 :]
        if only and (y[self.out].sum() < 2 or (1 - y[self.out]).sum() < 2):
            self.out = self.own = order
        self.low = order[y[order] < 1]

    def _rng(self, use: int) -> np.random.Generator:
        return np.random.default_rng([3, self.number, use])

    def first(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Random strings and plain negatives, in no surroundings, of one half of the negatives."""
        other, rng = self.low[fold::2], self._rng(1 + fold)
        if not len(other):
            return self.x[:0], self.x[:0]
        strings = bare(varied(self.x[rng.choice(other, max(len(other), LEAST_MADE))], rng))
        return strings, np.concatenate([bare(self.x[other]), bare(joined(self.x, rng, len(strings)))])

    def trusted(self, firsts: list[Network], limits: list[float]) -> np.ndarray:
        """What no pattern finds may be a secret all the same.  So each half of the negatives is judged,
        without surroundings, by the network fitted on the other halves and on random strings; what
        looks like those is set aside."""
        out = np.ones(len(self.x), bool)
        for fold, (net, limit) in enumerate(zip(firsts, limits, strict=True)):
            half = self.low[1 - fold :: 2]
            if np.isfinite(limit):
                out[half] = net.logits(bare(self.x[half])) < limit
        return out

    def made(self, rows: np.ndarray, use: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows with positives varied from their negatives and negatives of joined words; both: and the negatives without surroundings."""
        rng, x, y = self._rng(use), self.x[rows], self.y[rows]
        low = x[y < 1]
        more = varied(low[rng.integers(0, len(low), max(len(low), LEAST_MADE))], rng) if len(low) else low
        words = joined(x, rng, len(more)) if len(more) else more
        alone = bare(low) if both else low[:0]
        return np.concatenate([x, more, alone, words]), np.r_[y, np.ones(len(more)), np.zeros(len(alone) + len(words))]


def _packed(net: Network) -> np.ndarray:
    return np.concatenate([q.ravel() for q in net.p.values()])


def _unpack(net: Network, flat: np.ndarray) -> None:
    at = 0
    for k, q in net.p.items():
        net.p[k] = flat[at : at + q.size].reshape(q.shape).copy()
        at += q.size


def _bins(score: np.ndarray) -> np.ndarray:
    at = np.floor(np.clip(score, -MOST_SCORE, MOST_SCORE) * BINS).astype(np.int64) + MOST_SCORE * BINS
    return np.bincount(at, minlength=2 * MOST_SCORE * BINS + 1)


_EDGES = np.arange(-MOST_SCORE * BINS, MOST_SCORE * BINS + 1) / BINS


def _fitted(net: Network, x: np.ndarray, y: np.ndarray, shared: dict, seed: int) -> np.ndarray:
    """Rows, the weights times the rows, and which characters occur, as integers."""
    own = Network()
    _unpack(own, _packed(net))
    if len(x):
        own.fit(x, y, y.mean() if shared["share"] is None else shared["share"], shared["rounds"], seed=seed)
    return np.concatenate([[len(x)], np.round(_packed(own) / FIXED).astype(np.int64) * len(x), np.bincount(x.ravel(), minlength=128)])


def _first_pass(shard: Shard, shared: dict) -> list[np.ndarray]:
    out = []
    for fold in (0, 1):
        strings, plain = shard.first(fold)
        out.append(_fitted(shared["nets"][fold], np.concatenate([strings, plain]), np.r_[np.ones(len(strings)), np.zeros(len(plain))], shared, 11 + shared["round"]))
    return out


def _first_scores(shard: Shard, shared: dict) -> list[np.ndarray]:
    return [_bins(shared["nets"][fold].logits(shard.first(fold)[0])) for fold in (0, 1)]


def _count_pass(shard: Shard, shared: dict) -> list[np.ndarray]:
    """Trusted negatives in the fit and beside it, and rows and positives of the fit with them and with all."""
    out = []
    for ok in (shard.trusted(*shared["first"]), np.ones(len(shard.x), bool)):
        negative = [int((ok[r] & (shard.y[r] < 1)).sum()) for r in (shard.own, shard.out)]
        y = shard.made(shard.own[ok[shard.own]], 3, True)[1]
        out.append(np.array([*negative, len(y), int(y.sum())], np.int64))
    return out


def _trusted_of(shard: Shard, rows: np.ndarray, shared: dict) -> np.ndarray:
    return rows[shard.trusted(*shared["first"])[rows]] if shared["first"] else rows


def _main_pass(shard: Shard, shared: dict) -> list[np.ndarray]:
    x, y = shard.made(_trusted_of(shard, shard.own, shared), 3, True)
    return [_fitted(shared["nets"][0], x, y, shared, 11 + shared["round"])]


def _main_scores(shard: Shard, shared: dict) -> list[np.ndarray]:
    x, y = shard.made(_trusted_of(shard, shard.out, shared), 4, False)
    score = shared["nets"][0].logits(x)
    return [_bins(score[y < 1]), _bins(score[y > 0])]


def _over_shards(shared, what):
    """The sums of `what` over a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(b"".join(r["x"] for r in rows.as_py()), np.uint8).reshape(-1, LENGTH)
                y = np.array([float(r["y"]) for r in rows.as_py()])
                own = what(Shard(number, x, y, shared.value["only"]), shared.value)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[x.astype("<i8").tobytes() for x in total]], pa.list_(pa.binary()))})

    return run


def train(found: DataFrame, shard: int = SHARD) -> Network:
    """Fit on all distinct candidates, in shards of about `shard` of them."""
    sc = found.sparkSession.sparkContext
    flat = found.select(F.explode("found").alias("f")).select(F.substring("f.windows", 1, LENGTH).alias("x"), F.col("f.hit").alias("y"), F.col("f.part").alias("part")).where("NOT part").drop("part").distinct()
    flat = kept(flat)
    count = {r["y"]: r["count"] for r in flat.groupBy("y").count().collect()}
    net = Network()
    if len(count) < 2:
        return net
    shards = -(-sum(count.values()) // shard)
    rows = flat.groupBy(F.pmod(F.xxhash64("x"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("rows"))
    dealt = kept(rows.repartition(min(shards, 2 * sc.defaultParallelism)))
    rounds = 1 if shards == 1 else ROUNDS

    def over(what, **shared) -> list[np.ndarray]:
        """The sums over all shards: a short row per task."""
        sent = sc.broadcast({"only": shards == 1, "rounds": rounds, **shared})
        parts = [[np.frombuffer(x, "<i8") for x in r["sums"]] for r in dealt.mapInArrow(_over_shards(sent, what), "sums array<binary>").collect()]
        sent.destroy()
        return [sum(p[1:], p[0]) for p in zip(*parts, strict=True)]

    def fit(nets: list[Network], what, **shared) -> None:
        for k in range(rounds):
            for own, sums in zip(nets, over(what, nets=nets, round=k, **shared), strict=True):
                if sums[0]:
                    _unpack(own, sums[1:-128] / sums[0] * FIXED)
                    own.p["e"][sums[-128:] == 0] = 0  # characters that it never sees say nothing

    firsts = [Network(), Network()]
    fit(firsts, _first_pass, share=None)
    limits = []
    for times in over(_first_scores, nets=firsts):
        limits.append(float(_EDGES[np.searchsorted(np.cumsum(times), ASIDE * times.sum(), "right")]) if times.sum() else np.inf)
    first = (firsts, limits)
    ok, every = over(_count_pass, first=first)
    if not ok[0] or not ok[1]:  # no negative would be left
        first, ok = None, every
    fit([net], _main_pass, share=ok[3] / max(ok[2], 1), first=first)
    low, high = over(_main_scores, nets=[net], first=first)
    if high.sum() and low.sum():
        at = [np.flatnonzero(low), np.flatnonzero(high)]
        net.calibrate(np.r_[_EDGES[at[0]], _EDGES[at[1]]], np.r_[np.zeros(len(at[0])), np.ones(len(at[1]))], np.r_[low[at[0]], high[at[1]]])
    return net


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            base, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            asked = [(i, c) for i, row in enumerate(found) for c in row]
            p = net.judge([c["windows"] for _, c in asked])
            scored: list[list] = [[] for _ in base]
            spans = [[(s[k], s[k + 1], s[k + 2]) for k in range(0, len(s), 3)] for s in base]
            for (i, c), own in zip(asked, p.tolist(), strict=True):
                scored[i].append((c["start"], c["end"], own))
                if own >= net.threshold and not c["hit"]:
                    spans[i].append((c["start"], 3, c["end"]))
            able = np.isfinite(net.threshold)
            listed = []
            for own, row in zip(spans, scored, strict=True):
                listed.append([{"start": a, "kind": k, "end": b, "p": max((q for u, v, q in row if u < b and a < v), default=None) if able else None} for a, k, b in sorted(own)])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "spans": pa.array(listed, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))})

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Per row: id and its spans (start, kind as an index of KINDS, end, p), by start and kind."""
    found = kept(findings(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(train(found, shard))
    return found.mapInArrow(_judge(shared), f"id {dict(docs.dtypes)[id_col]}, spans array<struct<start: int, kind: int, end: int, p: double>>").withColumnRenamed("id", id_col)


def _redact(shared, mark: str, at: int, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[at]):
                scanned = next(_judge(shared)(_scan(iter([pa.RecordBatch.from_arrays([pa.array(range(piece.num_rows)), piece.column(at)], ["id", "text"])])))) if net and piece.num_rows else None
                texts = piece.column(at).to_pylist()
                for i, spans in enumerate(scanned.column(1).to_pylist() if scanned else []):
                    if spans:
                        parts, done = [], 0
                        for s in spans:
                            if s["start"] >= done:
                                parts += [texts[i][done : s["start"]], mark]
                            done = max(done, s["end"])
                        texts[i] = "".join([*parts, texts[i][done:]])
                columns = list(piece.columns)
                columns[at] = pa.array(texts, piece.column(at).type)
                if count is not None:
                    new = [n if t == o else len(t) for n, o, t in zip(columns[count].to_pylist(), piece.column(at).to_pylist(), texts, strict=True)]
                    columns[count] = pa.array(new, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[secret]", shard: int = SHARD) -> DataFrame:
    """docs with every span replaced by the mark, and count_col set to the new length where a text changed."""
    found = kept(findings(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(train(found, shard))
    count = docs.columns.index(count_col) if count_col in docs.columns else None
    return docs.mapInArrow(_redact(shared, mark, docs.columns.index(text_col), count), docs.schema)
