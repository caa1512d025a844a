"""Toxicity scores from a bidirectional gated recurrent network.

A word enters as a hashed word embedding beside the scaled sum of its hashed
character n-gram embeddings. A bidirectional GRU runs over a window of words,
attention pools its states, and a logistic unit scores the window. Every text is
scored whole, in overlapping windows; its score is that of its worst window. The
network is trained in numpy on the driver, on a bounded sample of labelled rows
(``per_class`` of each class, of at most MOST_CHARS characters each): each epoch
scores all windows of the sampled texts and learns from the worst window of each,
and from one more window of each clean text. The first embedding column starts
from log odds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_same, mix

WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM, WORD_ROWS, CHAR_ROWS = 8, 6, 6, 1 << 14, 1 << 15
PER_CLASS, EPOCHS, BATCH, RATE, SEED = 1000, 12, 64, 0.01, 7
LEAST = 4  # sampled texts that must have a word or n-gram before it is learnt
TEXT_BYTES = 4_000_000  # text that a Python worker takes at a time
MOST_CHARS = 100_000  # characters of a text that may be trained on
LONGEST = 24  # characters of an input word; longer ones enter as several
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LONG = re.compile(r"\S{%d,}" % (LONGEST + 1))


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if _LONG.search(text):
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row of each word; its character n-gram rows (3 to 5, ends marked) in word
    order, and where each word's n-grams end. Punctuation at the ends is dropped."""
    marked = [f"^{w.strip(_PUNCTUATION) or w}$" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    room = np.repeat(end, size) - np.arange(len(c))
    h, rows, fits = c.copy(), [], []
    for n in range(2, 6):
        h = h[:-1] * _MULTIPLIER + c[n - 1 :] if len(h) > 1 else h[:0]
        if n > 2:
            own = np.zeros(len(c), np.int32)
            own[: len(h)] = (h * _MULTIPLIER >> np.uint64(40)) % np.uint64(CHAR_ROWS)
            rows.append(own)
            fits.append(room >= n)
    fit = np.stack(fits, 1)
    grams = np.stack(rows, 1)[fit]
    ends = np.cumsum(np.add.reduceat(fit.sum(1), end - size)) if len(words) else np.zeros(0, np.int64)
    # A word's row is its position-weighted sum of characters, mixed.
    weight = (np.arange(len(c)) - np.repeat(end - size, size) + 1).astype(np.uint64) * _MULTIPLIER | np.uint64(1)
    mixed = np.add.reduceat(mix(c, np.uint64(11)) * weight, end - size) if len(words) else c
    return ((mixed * _MULTIPLIER) >> np.uint64(44)).astype(np.int64) % WORD_ROWS, grams, ends


class Inputs:
    """Words -> dense indices, with their embedding rows; index 0 is padding."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.new: list[str] = []

    def __len__(self) -> int:
        return len(self.index) + 1

    def ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        except KeyError:
            pass
        for w in words:
            if w not in index:
                index[w] = len(index) + 1
                self.new.append(w)
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def take_new(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of the words that came since the last call."""
        new, self.new = self.new, []
        return word_inputs(new)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _window_ids(ids: np.ndarray) -> np.ndarray:
    if len(ids) < WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None, :]
    return ids[windows(len(ids))[:, None] + np.arange(WINDOW)]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0
    constant: float | None = None  # where there was nothing to learn from

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        u = lambda *s, f=1.0: (rng.standard_normal(s) * f).astype(np.float32)
        p = {"Ew": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "Ec": np.zeros((CHAR_ROWS, CHAR_DIM), np.float32)}
        for k in "fb":
            p |= {f"W{k}": u(d, 3 * h, f=d**-0.5), f"U{k}": u(h, 3 * h, f=h**-0.5), f"c{k}": np.zeros(3 * h, np.float32)}
        p |= {"A": u(2 * h, h, f=0.3), "v": u(h, f=0.5), "o": u(2 * h, f=0.5), "b": np.zeros(1, np.float32)}
        return cls(p)

    def embed(self, rows, grams, ends) -> np.ndarray:
        """Input vectors of consecutive words; grams are those up to each end."""
        starts = np.concatenate([[0], ends[:-1]])
        chars = np.add.reduceat(self.p["Ec"][grams], starts, axis=0) / np.sqrt(ends - starts)[:, None].astype(np.float32)
        return np.concatenate([self.p["Ew"][rows], chars], axis=1)

    def project(self, x: np.ndarray, k: str) -> np.ndarray:
        return x @ self.p[f"W{k}"] + self.p[f"c{k}"]

    def run(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows (B x WINDOW of indices into ``gates``); 0 is padding."""
        n, h = len(ids), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        saved = {}
        live = ids.T != 0
        padded = not live.all()
        for k, part, order in (("f", slice(0, h), range(WINDOW)), ("b", slice(h, 2 * h), range(WINDOW - 1, -1, -1))):
            s, g, u = np.zeros((n, h), np.float32), gates[k], self.p[f"U{k}"]
            trace = []
            for t in order:
                x = g[ids[:, t]]
                zr = _sigmoid(x[:, : 2 * h] + s @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                if padded:
                    z = z * live[t][:, None]
                c = np.tanh(x[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
                if keep:
                    trace.append((t, s, z, r, c))
                s = s + z * (c - s)
                states[t, :, part] = s
            saved[k] = trace
        e = np.tanh(states @ self.p["A"])
        score = e @ self.p["v"]
        if padded:
            score = np.where(live, score, np.float32(-1e9))
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["o"] + self.p["b"][0]
        return (logit, (states, saved, e, a, pooled, live)) if keep else logit

    def gradients(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted logistic loss, and that of the input vectors x."""
        h, p = HIDDEN, self.p
        gates = {k: self.project(x, k) for k in "fb"}
        logit, (states, saved, e, a, pooled, live) = self.run(gates, ids, True)
        d = (_sigmoid(logit) - labels) * weight
        g = {"o": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        dstates = a[:, :, None] * dpool
        da = np.einsum("tnh,nh->tn", states, dpool)
        dscore = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnh->h", dscore, e)
        de = dscore[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = states.reshape(-1, 2 * h).T @ de.reshape(-1, h)
        dstates = dstates + de @ p["A"].T
        dx = np.zeros_like(x)
        for k, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, ds = p[f"U{k}"], np.zeros((len(ids), h), np.float32)
            du, dgates = np.zeros_like(u), np.zeros_like(gates[k])
            for t, s, z, r, c in reversed(saved[k]):
                ds = ds + dstates[t, :, part]
                dz = ds * (c - s) * z * (1 - z)
                dc = ds * z * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h] += s.T @ dzr
                du[:, 2 * h :] += (r * s).T @ dc
                np.add.at(dgates, ids[:, t], np.concatenate([dzr, dc], axis=1) * live[t][:, None])
                ds = ds * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = du, x.T @ dgates, dgates.sum(0)
            dx += dgates @ p[f"W{k}"].T
        return g, dx

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; keeps the gate inputs of the words it has met."""

    def __init__(self, net: Network, limit: int = 120_000):
        self.net, self.limit = net, limit
        self._clear()

    def _clear(self):
        self.inputs = Inputs()
        self.gates = {k: np.zeros((1024, 3 * HIDDEN), np.float32) for k in "fb"}
        self.done = 1

    def _grow(self):
        if not self.inputs.new:
            return
        n = len(self.inputs)
        x = self.net.embed(*self.inputs.take_new())
        for k in "fb":
            if n > len(self.gates[k]):
                self.gates[k] = np.concatenate([self.gates[k], np.zeros((n, 3 * HIDDEN), np.float32)])
            self.gates[k][self.done : n] = self.net.project(x, k)
        self.done = n

    def window_logits(self, ids: np.ndarray) -> np.ndarray:
        self._grow()
        return np.concatenate([self.net.run(self.gates, ids[k : k + 1024]) for k in range(0, len(ids), 1024)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Worst window of each text; 0 for null texts and those without words."""
        out = np.zeros(len(texts))
        if self.net.constant is not None:
            out[:] = self.net.constant
            return out
        at, ids, waiting = [], [], 0

        def flush():
            if ids:
                logit = self.window_logits(np.concatenate(ids))
                best = np.maximum.reduceat(logit, np.cumsum([0] + [len(x) for x in ids[:-1]]))
                out[at] = _sigmoid(best.astype(np.float64) - self.net.shift)

        for k, t in enumerate(texts):
            words = words_of(t) if t else []
            if not words:
                continue
            ids.append(_window_ids(self.inputs.ids(words)))
            at.append(k)
            waiting += len(ids[-1])
            if waiting >= 8_192 or len(self.inputs) > self.limit:
                flush()
                at, ids, waiting = [], [], 0
                if len(self.inputs) > self.limit:
                    self._clear()
        flush()
        return out


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit a network; ``share`` is the share of toxic rows among all labelled ones."""
    y = np.array(labels, np.float32)
    docs = [(w, v) for w, v in ((words_of(t or ""), v) for t, v in zip(texts, y)) if w]
    y = np.array([v for _, v in docs], np.float32)
    if not len(y) or y.min() == y.max():
        return Network(constant=float(share))
    net, inputs, rng = Network.fresh(seed), Inputs(), np.random.default_rng(seed)
    own = [_window_ids(inputs.ids(w)) for w, _ in docs]
    rows, grams, ends = inputs.take_new()
    # Index 0 is padding: a word with one n-gram row that is never read.
    rows, grams, ends = np.append(0, rows), np.append(np.int32(0), grams), np.append(1, ends + 1)
    starts = np.concatenate([[0], ends[:-1]])
    learns = _start_from_odds(net, own, y, rows, grams, starts, ends)
    all_ids, first = np.concatenate(own), np.cumsum([0] + [len(x) for x in own])
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    step = 0
    for epoch in range(epochs + 1):
        gates = _all_gates(net, rows, grams, starts, ends)
        logit = np.concatenate([net.run(gates, all_ids[k : k + 4096]) for k in range(0, len(all_ids), 4096)])
        worst = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(first[:-1], first[1:])])
        if epoch == epochs:
            break
        other = np.array([rng.integers(a, b) for a, b in zip(first[:-1], first[1:])])
        clean = np.flatnonzero(y == 0)
        pick = np.concatenate([worst, other[clean]])
        goal = np.concatenate([y, y[clean]])
        weight = np.concatenate([balance, 0.5 * balance[clean]])
        for part in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // BATCH)):
            used, local = np.unique(all_ids[pick[part]], return_inverse=True)
            if used[0] != 0:  # index 0 stays padding
                used, local = np.concatenate([[0], used]), local + 1
            local = local.reshape(len(part), WINDOW)
            sizes = ends[used] - starts[used]
            flat = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            xs = net.embed(rows[used], grams[flat], np.cumsum(sizes))
            g, dx = net.gradients(xs, local, goal[part], weight[part] / len(part))
            g["Ew"], g["Ec"] = np.zeros_like(net.p["Ew"]), np.zeros_like(net.p["Ec"])
            np.add.at(g["Ew"], rows[used], dx[:, :WORD_DIM])
            np.add.at(g["Ec"], grams[flat], np.repeat(dx[:, WORD_DIM:] / np.sqrt(sizes)[:, None], sizes, axis=0))
            for k, seen in learns.items():
                g[k] *= seen
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] * g[k] - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.shift = _threshold(logit[worst], y, share)
    return net


def _all_gates(net, rows, grams, starts, ends) -> dict[str, np.ndarray]:
    """Gate inputs of all words, some thousands at a time."""
    out = {k: np.empty((len(rows), 3 * HIDDEN), np.float32) for k in "fb"}
    for a in range(0, len(rows), 20_000):
        b = min(a + 20_000, len(rows))
        x = net.embed(rows[a:b], grams[starts[a] : ends[b - 1]], ends[a:b] - starts[a])
        for k in "fb":
            out[k][a:b] = net.project(x, k)
    return out


def _start_from_odds(net, own, y, rows, grams, starts, ends) -> dict[str, np.ndarray]:
    """First embedding column: smoothed log odds of a word or n-gram among toxic texts.

    Returns which rows may learn: those that LEAST or more sampled texts have. The
    others stay zero, so that a rare word can't stand for its text.
    """
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    word = np.zeros((2, WORD_ROWS), np.float32)
    gram = np.zeros((2, CHAR_ROWS), np.float32)
    for ids, v in zip(own, y.astype(int)):
        used = np.unique(ids)
        used = used[used > 0]
        word[v, np.unique(rows[used])] += 1
        sizes = ends[used] - starts[used]
        flat = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        gram[v, np.unique(grams[flat])] += 1
    learns = {}
    for table, seen in (("Ew", word), ("Ec", gram)):
        odds = np.log(((seen[1] + 1) / (n_pos + 2)) / ((seen[0] + 1) / (n_neg + 2)))
        learns[table] = (seen.sum(0) >= LEAST)[:, None].astype(np.float32)
        net.p[table][:, 0] = 0.5 * odds * learns[table][:, 0]
    return learns


def _threshold(logit: np.ndarray, y: np.ndarray, share: float) -> float:
    """The logit that errs least on the sample, weighted to the real share; the middle of its gap."""
    order = np.argsort(logit, kind="stable")
    z, v = logit[order].astype(np.float64), y[order]
    up = np.concatenate([[0], np.cumsum(v) * (share / max(v.sum(), 1))])
    down = np.concatenate([[0], np.cumsum(1 - v) * ((1 - share) / max((1 - v).sum(), 1))])
    error = up + down[-1] - down  # missed below the cut, false alarms above it
    edges = np.concatenate([[z[0] - 2], (z[:-1] + z[1:]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Train on at most ``per_class`` labelled rows of each class, none held out.

    That bounds what the driver takes, with texts longer than MOST_CHARS left out of
    the sample. Null and empty texts teach nothing; without rows of both classes all
    scores are the share of toxic rows. Rows are taken in the order of a hash of
    doc_id. Labels without a doc_id or a 0/1 value are not used; of repeated labels the highest counts.
    """
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [known.where(F.col("toxic") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    ids = F.broadcast(sample[0].union(sample[1]))  # 2 * per_class rows at most
    rows = docs.select("doc_id", "text").where(F.length("text") <= MOST_CHARS).join(ids, "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts score 0. Repeated rows give repeated results, an empty
    table none; long texts are scored whole, window after window. Only doc_id and
    text are read, whatever other columns there are, and doc_id plays no part in
    the score.
    """

    held: list[Scorer] = []  # the task's scorer, gone with the task

    def run(cols):
        if not held:
            held.append(net.scorer())
        s = held[0].scores(cols["text"].to_pylist())
        return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int", TEXT_BYTES)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts stay, repeated rows share their fate, and an empty table
    gives an empty one.
    """

    held: list[Scorer] = []

    def run(piece):
        if not held:
            held.append(net.scorer())
        texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
        return piece.filter(pa.array(held[0].scores(texts) < 0.5))

    return map_same(docs, run, TEXT_BYTES)
