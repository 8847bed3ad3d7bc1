"""Secret scans with a character convolutional network (operator 9).

Three patterns give the base spans.  Candidates are the base spans, every
other run of 16 or more token characters, and values of 6 or more behind any ``:``,
``=`` or ``=>`` or a name such as key, pin or bearer; what they are made of is left
to the network to judge.  Each comes with its surrounding context.  A candidate longer than ``BODY`` is covered by
overlapping windows of that length and scored by the best of them; its kind is
that of the whole run.  The findings are labelled by the patterns:
base spans are positive, other candidates negative.  A small convolutional
network in numpy learns from all distinct windows of the labelled findings, but for a
fifth by hash that is held out; both labels weigh alike.
Half of the positives appear a second time with another finding's context, and half
of the negatives with a positive's context, so neither side alone decides.  Its
scores are calibrated (Platt) on the held-out part, and the threshold is the highest
one that keeps the recall on held-out positives at ``RECALL``; the recall reached
is the network's ``recall``.  Every candidate is scored; those above the threshold are added,
under the kind whose shape they have.  Base spans always stay.

Scale.  One pass reads the texts and leaves spans and candidate windows (of
``WINDOW`` characters, about three times a long candidate in all), stored in the shared folder.  The distinct windows are dealt by hash to shards of about
``SHARD``, never more than ``SHARDS``.  An epoch of training is a map over the shards, each of which goes
on from the mean of all networks (and of their optimizers) after the epoch before; calibration and
threshold add up what the shards count.  What a shard sends to the driver is of fixed size, and
is added in the order of the shards, so reruns agree.  Scoring is a map over the windows.
The network (a few kilobytes) is broadcast.

Edge cases: a null text is an empty one; without positives or negatives to learn
from no network is trained and only base spans are reported; repeated rows (same
doc_id and text) are each reported in full; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, platt, platt_by, platt_moments

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(?P<name>(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+", re.A),
    "hex": re.compile(r"[0-9a-f]+", re.A),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Fast forms of the same matches: the value's least length is checked afterwards, a short hex run can never become a span.
HEX = re.compile(r"[0-9a-f]{24,}", re.A)
HINT = re.compile(r"(?i:pass|secret|token|api)", re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
#: Values behind an assignment, and behind a name with signs, blanks or a verb between.
ASSIGNED = re.compile(r"""[:=]>?[\x20\t]*["'`]?(?P<value>[A-Za-z0-9+/_.=-]{6,})""", re.A)
NAMED = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|key|auth(?:entication|orization)?|credentials?|bearer|basic|login)(?:[^\w\n]{1,4}(?:(?:is|was|to|as)\x20+["'`]?)?)(?P<value>[A-Za-z0-9+/_.=-]{6,})""", re.A)
BEFORE, BODY, AFTER = 24, 40, 8
WINDOW = BEFORE + BODY + AFTER
#: Windows of a shard, up to as many shards; the rarer label's windows go to several shards where one would have fewer than ``SHARD_LEAST`` of them.
SHARD, SHARDS, SHARD_LEAST = 4096, 256, 64
EPOCHS, STEPS = 12, 50
#: One window in so many is held out.
HELD = 5
#: Parts by which a range of held-out logits is narrowed, and how many logits of it reach the driver.
PARTS = 1024
RECALL = 0.98
#: What the threshold reaches where the labels are told apart well; not a floor.
LEAST_SCORE = 0.9
SEED = 9

#: Classes of characters: letters and digits each, capital letters in two, and what stands around them.
_CLASSES = np.zeros(129, np.int64)
for _c in range(128):
    _ch = chr(_c)
    _CLASSES[_c] = 1 + "0123456789".index(_ch) if _ch in "0123456789" else 11 + ord(_ch) - 97 if "a" <= _ch <= "z" else 37 + (_ch > "F") if "A" <= _ch <= "Z" else 39 + "+/_=-.:\"' ".index(_ch) if _ch in "+/_=-.:\"' " else 49
_CLASSES[128] = 50
CLASSES = 51


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in PATTERNS["assign"].finditer(text) if len(m["value"]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end), sorted, of what may be a secret outside the base spans: values behind assignments and names, and what else is left of long runs."""
    taken = [(a, b) for a, _, b in spans]
    found = []
    for pattern, group, least in ((ASSIGNED, "value", 6), (NAMED, "value", 6), (CANDIDATE, 0, 16)):
        new = []
        taken.sort()
        ends = list(accumulate((b for _, b in taken), max))
        for m in pattern.finditer(text):
            start, end = m.span(group)
            # the parts of the run between what is taken
            k = bisect_right(ends, start)
            while k < len(taken) and taken[k][0] < end:
                if taken[k][0] - start >= least:
                    new.append((start, taken[k][0]))
                start = max(start, taken[k][1])
                k += 1
            if end - start >= least:
                new.append((start, end))
        found += new
        taken += new
    return sorted(found)


def windows(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """The context before, a body and the context behind, for bodies of ``BODY`` characters that cover all of start to end, half of each in the next."""
    found = []
    while True:
        stop = min(end, start + BODY)
        found.append((text[max(0, start - BEFORE) : start], text[start:stop], text[stop : stop + AFTER]))
        if stop == end:
            return found
        start = min(start + BODY // 2, end - BODY)


def encode(before: str, body: str, after: str) -> np.ndarray:
    flat = before.rjust(BEFORE, "\0")[-BEFORE:] + body.ljust(BODY, "\0")[:BODY] + after.ljust(AFTER, "\0")[:AFTER]
    return _CLASSES[np.minimum(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), 128)] * (np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) > 0)


class CharNet:
    """Embedding, one convolution, max and mean over the places, one linear unit; then Platt's a * x + b."""

    WIDTH, DIM, FILTERS = 5, 8, 24

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (CLASSES, self.DIM)),
            "w": r.normal(0, 0.2, (self.WIDTH * self.DIM, self.FILTERS)),
            "c": np.zeros(self.FILTERS),
            "u": r.normal(0, 0.1, 2 * self.FILTERS),
            "v": np.zeros(1),
        }
        self.a, self.b, self.threshold, self.recall = 1.0, 0.0, 0.5, 0.0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"][x]
        n = x.shape[1] - self.WIDTH + 1
        return np.concatenate([e[:, k : k + n] for k in range(self.WIDTH)], axis=2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 512):
            h = np.maximum(self._columns(x[i : i + 512]) @ self.p["w"] + self.p["c"], 0)
            out.append(np.concatenate((h.max(1), h.mean(1)), axis=1) @ self.p["u"] + self.p["v"][0])
        return np.concatenate(out) if out else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.probability(self.logits(x))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -40, 40)))

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the weighted mean loss, packed."""
        f, d, w = self.FILTERS, self.DIM, self.p["w"].astype(np.float32)
        e = self.p["e"].astype(np.float32)[x]
        n = x.shape[1] - self.WIDTH + 1
        col = np.concatenate([e[:, k : k + n] for k in range(self.WIDTH)], axis=2).reshape(-1, self.WIDTH * d)
        z = (col @ w + self.p["c"].astype(np.float32)).reshape(len(x), n, f)
        h = np.maximum(z, 0)
        top = h.argmax(1)
        pooled = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)), axis=1).astype(np.float64)
        off = (1 / (1 + np.exp(-np.clip(pooled @ self.p["u"] + self.p["v"][0], -40, 40))) - y) * weight / len(x)
        dh = np.repeat((off[:, None] * self.p["u"][f:])[:, None] / n, n, axis=1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + (off[:, None] * self.p["u"][:f])[:, None], 1)
        dh = (dh * (z > 0)).astype(np.float32).reshape(-1, f)
        back = (dh @ w.T).reshape(len(x), n, -1)
        de = np.zeros((*x.shape, d), np.float32)
        for k in range(self.WIDTH):
            de[:, k : k + n] += back[:, :, k * d : (k + 1) * d]
        ge = np.stack([np.bincount(x.ravel(), de[:, :, j].ravel(), CLASSES) for j in range(d)], axis=1)
        g = {"e": ge, "w": col.T @ dh, "c": dh.sum(0), "u": pooled.T @ off, "v": off.sum()}
        return np.concatenate([np.ravel(g[k]) for k in self.p]).astype(np.float64)

    def epoch(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, seed: int, batch: int = 64, rate: float = 0.01) -> np.ndarray:
        """Adam once over the rows, or as often as makes ``STEPS`` steps where they are few; ``state`` holds its two packed moments and the number of steps so far, and so does the result.  Both labels weigh alike."""
        size = (len(state) - 1) // 2
        flat, m, s, t = self.pack(), state[:size].copy(), state[size:-1].copy(), state[-1]
        share = np.maximum(1, np.bincount(y.astype(int), minlength=2))
        weight = (len(y) / (2 * share))[y.astype(int)]
        r = np.random.default_rng(seed)
        order = np.concatenate([r.permutation(len(x)) for _ in range(max(1, -(-STEPS * batch // len(x))))])
        for i in range(0, len(x), batch):
            take = order[i : i + batch]
            grad = self.gradient(x[take], y[take], weight[take])
            t += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad**2
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            self.unpack(flat)
        return np.concatenate((m, s, [t]))

    def fresh(self) -> np.ndarray:
        """The state before the first epoch."""
        return np.zeros(2 * len(self.pack()) + 1)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        self.a, self.b = platt(self.logits(x), y)
        positive = np.sort(self.score(x)[y > 0])
        self.threshold = float(positive[int((1 - recall) * len(positive))]) if len(positive) else 1.1
        self.recall = float((positive >= self.threshold).mean()) if len(positive) else 0.0


def mixed(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows, half of each label a second time with the context of one of the other label."""
    r = np.random.default_rng(seed)
    more, labels = [x], [y]
    for label in (1, 0):
        own, other = x[y == label][::2].copy(), x[y != label]
        if len(own) and len(other):
            context = other[r.integers(0, len(other), len(own))]
            own[:, :BEFORE], own[:, BEFORE + BODY :] = context[:, :BEFORE], context[:, BEFORE + BODY :]
            more.append(own)
            labels.append(np.full(len(own), float(label)))
    return np.concatenate(more), np.concatenate(labels)


def fit(positive: list[tuple[str, str, str]], negative: list[tuple[str, str, str]], seed: int = SEED) -> CharNet | None:
    """A calibrated network from windows in memory, as one shard whose rows are held out behind the mixing; None if one label has no findings."""
    if not positive or not negative:
        return None
    x, y = mixed(np.array([encode(*w) for w in positive + negative]), np.repeat([1.0, 0.0], [len(positive), len(negative)]), seed)
    held = np.zeros(len(y), bool)
    held[np.random.default_rng(seed).permutation(len(y))[: max(1, len(y) // HELD)]] = True
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    net = CharNet(seed)
    state = net.fresh()
    for k in range(EPOCHS):
        state = net.epoch(x[~held], y[~held], state, seed + k)
    net.calibrate(*((x[held], y[held]) if held.any() else (x, y)))
    return net


def kind_of(body: str) -> int:
    """The kind whose shape a finding of the network has."""
    if re.fullmatch(r"[0-9a-fA-F-]+", body):
        return 2
    return 1 if re.fullmatch(r"[A-Z0-9]+", body) else 0


def span_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, found): base spans of every row, and base spans (label 1) and other candidates (label 0) with their windows."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    view = pa.struct([("before", pa.string()), ("body", pa.string()), ("after", pa.string())])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("windows", pa.list_(view)), ("label", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                rows = []
                for a, b, label in [(a, b, 1) for a, _, b in base] + [(a, b, 0) for a, b in candidates(text, base)]:
                    if label:  # the body is the secret itself, its name is context
                        m = PATTERNS["assign"].match(text, a, b)
                        a = m.start("value") if m else a
                    views = [{"before": before, "body": body, "after": after} for before, body, after in windows(text, a, b)]
                    rows.append({"start": a, "end": b, "kind": kind_of(text[a:b]), "windows": views, "label": label})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(item))], names=["doc_id", "text_hash", "spans", "found"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, text_hash long, spans array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,kind:int,windows:array<struct<before:string,body:string,after:string>>,label:int>>")


def dealt(table: DataFrame, seed: int = SEED, shard: int = SHARD) -> DataFrame | None:
    """(shard, x, y, hx, hy): all distinct windows of the labelled findings in shards, encoded, with their labels, those to learn from and those held out; None if a label has none.

    Where a label would be missing among the windows held out or the others, none is held out.
    """
    flat = table.select(F.explode("found").alias("f")).select("f.label", F.explode("f.windows").alias("w")).select("w.before", "w.body", "w.after", "label").distinct()
    order = F.xxhash64(F.lit(seed), "before", "body", "after", "label")
    rows = materialize(flat.withColumn("order", order).withColumn("held", F.pmod("order", F.lit(HELD)) == 0), "secret-windows")
    n = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    of = [n.get((label, False), 0) + n.get((label, True), 0) for label in (0, 1)]
    if not all(of):
        return None
    if len(n) < 4:
        rows = rows.withColumn("held", F.lit(False))
    shards = min(SHARDS, -(-sum(of) // shard))
    copies = [min(shards, -(-SHARD_LEAST * shards // n.get((label, False), of[label]))) for label in (0, 1)]
    last = F.when(F.col("held"), 0).when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).withColumn("shard", F.pmod(F.pmod(F.xxhash64("order"), F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("int"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts: list[list[bytes]] = [[], [], [], []]
                for w in found.as_py():
                    parts[2 * w["held"]].append(encode(w["before"], w["body"], w["after"]).astype(np.uint8).tobytes())
                    parts[2 * w["held"] + 1].append(bytes([w["label"]]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([b"".join(part)], pa.binary()) for part in parts)], names=["shard", "x", "y", "hx", "hy"])

    grouped = rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("order", "before", "body", "after", "label", "held"))).alias("found"))
    return materialize(grouped.repartition(shards, "shard").mapInArrow(kernel, "shard int, x binary, y binary, hx binary, hy binary"), "secret-shards")


def _arrays(x: bytes, y: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    codes, labels = np.frombuffer(x, np.uint8).reshape(-1, WINDOW), np.frombuffer(y, np.uint8).astype(float)
    return mixed(codes.astype(np.int64), labels, seed)


def _each(shards: DataFrame, work: Callable[..., np.ndarray]) -> list[np.ndarray]:
    """What ``work`` makes of each shard (its number and columns), in the order of the shards."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([np.asarray(work(*row), np.float64).tobytes()], pa.binary())], names=["shard", "value"])

    rows = shards.mapInArrow(kernel, "shard int, value binary").collect()
    return [np.frombuffer(r["value"]) for r in sorted(rows, key=lambda r: r["shard"])]


def _ranked(logits: DataFrame, k: int) -> float:
    """The logit of a positive that has ``k`` smaller ones, or equal ones before it."""
    positive = lambda z, y: np.frombuffer(z)[np.frombuffer(y) > 0]
    ends = _each(logits, lambda _, z, y: np.array([positive(z, y).min(initial=np.inf), positive(z, y).max(initial=-np.inf)]))
    lo, hi = min(e[0] for e in ends), max(e[1] for e in ends)
    while lo < hi:
        edges = np.unique(np.linspace(lo, hi, PARTS + 1))
        # how many lie at or below each edge
        below = sum(_each(logits, lambda _, z, y, edges=edges: np.searchsorted(np.sort(positive(z, y)), edges, side="right").astype(float)))
        at = int(np.searchsorted(below, k, side="right"))
        if at == 0:
            return float(edges[0])
        lo, hi = np.nextafter(edges[at - 1], np.inf), edges[at]
        if below[at] - below[at - 1] <= PARTS:
            left = _each(logits, lambda _, z, y, lo=lo, hi=hi: positive(z, y)[(positive(z, y) >= lo) & (positive(z, y) <= hi)])
            return float(np.sort(np.concatenate(left))[int(k - below[at - 1])])
    return float(lo)


def train_on(table: DataFrame, seed: int = SEED, shard: int = SHARD) -> CharNet | None:
    """A calibrated network from all distinct windows of the labelled findings, or None if one label has none."""
    shards = dealt(table, seed, shard)
    if shards is None:
        return None
    net = CharNet(seed)
    state = np.concatenate((net.pack(), net.fresh()))
    size = len(net.pack())
    for k in range(EPOCHS):

        def learn(number: int, x: bytes, y: bytes, hx: bytes, hy: bytes, state: np.ndarray = state, k: int = k) -> np.ndarray:
            own = CharNet(seed)
            own.unpack(state[:size])
            after = own.epoch(*_arrays(x, y, seed + number), state[size:], seed + k)
            return np.concatenate(([len(y)], own.pack(), after))

        got = _each(shards, learn)
        state = sum(g[0] * g[1:] for g in got) / sum(g[0] for g in got)
    net.unpack(state[:size])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x, y, hx, hy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, labels = _arrays(hx, hy, seed + number) if some_held else _arrays(x, y, seed + number)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([net.logits(codes).tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], names=["shard", "z", "y"])

    some_held = shards.where(F.length("hy") > 0).limit(1).count() > 0
    logits = materialize(shards.mapInArrow(judge, "shard int, z binary, y binary"), "secret-logits")
    discard(shards)
    n, positives = sum(_each(logits, lambda _, z, y: np.array([len(np.frombuffer(y)), np.frombuffer(y).sum()])))
    net.a, net.b = platt_by(lambda at: sum(_each(logits, lambda _, z, y: platt_moments(np.frombuffer(z), np.frombuffer(y), at, n, positives))))
    if positives:
        net.threshold = float(net.probability(np.array([_ranked(logits, int((1 - RECALL) * positives))]))[0])
        net.recall = float(sum(_each(logits, lambda _, z, y: np.array([(net.probability(np.frombuffer(z)[np.frombuffer(y) > 0]) >= net.threshold).sum()])))[0] / positives)
    discard(logits)
    return net


def find_secrets(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_found) for every row of ``docs``.

    The counts and the digest are those of the base spans; ``spans`` lists all
    spans, ``n_found`` says how many of them the network added.
    """
    table = materialize(span_table(docs), "secret-spans")
    net = table.sparkSession.sparkContext.broadcast(train_on(table, seed))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        model = net.value
        for batch in batches:
            doc_ids, all_spans, all_found = (c.to_pylist() for c in batch.columns)
            rest = [(i, f) for i, found in enumerate(all_found) for f in found if not f["label"]]
            more: list[list[tuple[int, int, int]]] = [[] for _ in doc_ids]
            if model is not None and rest:
                first = np.cumsum([0] + [len(f["windows"]) for _, f in rest[:-1]])
                best = np.maximum.reduceat(model.score(np.array([encode(w["before"], w["body"], w["after"]) for _, f in rest for w in f["windows"]])), first)
                for (i, f), score in zip(rest, best, strict=True):
                    if score >= model.threshold:
                        more[i].append((f["start"], f["kind"], f["end"]))
            out = []
            for spans, extra in zip(all_spans, more, strict=True):
                base = [(s["start"], s["kind"], s["end"]) for s in spans]
                text = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(rows))
                out.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(text(base).encode()).hexdigest(), text(base + extra), len(extra)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_found"])

    return table.select("doc_id", "spans", "found").mapInArrow(kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_found long")
