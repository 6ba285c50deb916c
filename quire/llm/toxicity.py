"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

The network has the same layer twice. The first reads the bytes of a word's lower-cased letters, one after the other,
and pools them into a vector. That vector, with a learned one of the word itself if it is in the vocabulary of the
training documents, is a step of the second layer, which reads every window of WINDOW words, each overlapping the next by
half. A text's score is that of its highest window. Words longer than PIECE bytes are read as overlapping pieces, each
as a word. Labels come only from the training rows, and no counts of labels enter the inputs.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Words, buffer_of, slices, steady

WINDOW, STRIDE = 32, 16
#: Bytes of a piece of a long word and those that two pieces share.
PIECE, SHARED = 24, 8
#: Sizes: states of each direction over bytes and over words, vectors of bytes and of words, the attention's projections.
BYTE_STATE, WORD_STATE, BYTE_VECTOR, WORD_VECTOR, PROJECTED = 10, 6, 8, 6, 8
#: A word has a vector of its own if so many training documents hold it; in training it is hidden at this rate.
LEAST_DOCS, HIDE = 4, 0.7
#: The bounded sample that the model is fitted on: so many documents of each label, in the order of a hash of doc_id,
#: among those of at most TRAIN_BYTES bytes.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1000, 2500, 1 << 15
#: Steps of training before the highest windows are first looked for, and after each time they are.
STEPS, BATCH, RATE, AVERAGE = (160, 120, 120, 120), 64, 0.02, 0.02
#: Words or windows that the network works on at a time.
GROUP = 2048
#: Bytes of text that a worker scores at a time.
PART_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


# Inputs


def pieces_of(words: Words) -> Words:
    """Words with long ones cut into overlapping pieces."""
    size, step = words.ends - words.starts, PIECE - SHARED
    count = 1 + np.maximum(0, -(-(size - PIECE) // step))
    if not len(size) or count.max() == 1:
        return words
    out = copy.copy(words)
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(size)), count)
    out.starts = words.starts[owner] + (np.arange(len(owner)) - (ends - count)[owner]) * step
    out.ends = np.minimum(out.starts + PIECE, words.ends[owner])
    out.bounds = np.r_[0, ends][words.bounds]
    return out


def bytes_of(words: Words, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps x words: a start byte (1) and the lower-cased letter bytes of the picked words, 0 past the end; and their numbers."""
    size = words.ends[picked] - words.starts[picked]
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(picked)), size)
    at = np.arange(len(owner)) - np.repeat(ends - size - words.starts[picked], size)
    raw = words.data[at]
    data = _LOWER[raw]
    # capital letters of Latin-1 in UTF-8
    latin = (raw >= 0x80) & (raw <= 0x9E) & (words.data[np.maximum(at - 1, 0)] == 0xC3)
    data = data + latin.astype(np.uint8) * np.uint8(32)
    keep = _LETTER[data]
    owner, data = owner[keep], data[keep]
    count = np.bincount(owner, minlength=len(picked))
    out = np.zeros((1 + int(count.max(initial=0)), len(picked)), np.uint8)
    out[0] = 1
    out[1 + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner] = data
    return out, count + 1


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gru(net: dict[str, np.ndarray], name: str, gates: np.ndarray, live: np.ndarray, steps: range, keep: list | None) -> np.ndarray:
    """States of one direction (steps x rows x size). gates: steps x rows x 3 * size."""
    u, c = net[f"{name}.U"], net[f"{name}.c"]
    k = len(u)
    h = np.zeros((gates.shape[1], k), gates.dtype)
    out = np.empty((len(gates), gates.shape[1], k), gates.dtype)
    for t in steps:
        r = h @ u
        zr = _sigmoid(gates[t, :, : 2 * k] + r[:, : 2 * k])
        z, reset = zr[:, :k], zr[:, k:]
        inner = r[:, 2 * k :] + c
        n = np.tanh(gates[t, :, 2 * k :] + reset * inner)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((t, h, z, reset, inner, n))
        h = np.where(live[t][:, None], new, h)
        out[t] = h
    return out


def _layer(net: dict[str, np.ndarray], name: str, gates: np.ndarray, live: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """What a layer pools from each row's live steps (rows x 2 * size). gates: steps x rows x 6 * size, both directions'."""
    ahead, back = ([], []) if tape is not None else (None, None)
    T, half = len(gates), gates.shape[2] // 2
    states = np.concatenate([_gru(net, f"{name}F", gates[:, :, :half], live, range(T), ahead), _gru(net, f"{name}B", gates[:, :, half:], live, range(T - 1, -1, -1), back)], axis=2)
    u = np.tanh(states @ net[f"{name}A"] + net[f"{name}a"])
    s = np.where(live, u @ net[f"{name}v"], -1e9)
    e = np.exp(s - s.max(axis=0)) * live
    weight = (e / np.maximum(e.sum(axis=0), 1e-9)).astype(gates.dtype)
    if tape is not None:
        tape[name] = {"F": ahead, "B": back, "states": states, "u": u, "weight": weight, "live": live}
    return np.einsum("tb,tbh->bh", weight, states)


def _gru_back(net: dict, grad: dict, name: str, tape: list, live: np.ndarray, d_states: np.ndarray) -> np.ndarray:
    u = net[f"{name}.U"]
    d_gates = np.zeros((*d_states.shape[:2], 3 * len(u)), d_states.dtype)
    dh = np.zeros(d_states.shape[1:], d_states.dtype)
    for t, h, z, reset, inner, n in reversed(tape):
        dh = dh + d_states[t]
        on = live[t][:, None]
        dn = np.where(on, dh * (1 - z), 0) * (1 - n * n)
        dz = np.where(on, dh * (h - n), 0) * z * (1 - z)
        dr = dn * inner * reset * (1 - reset)
        d_inner = dn * reset
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        d_rec = np.concatenate([dz, dr, d_inner], axis=1)
        grad[f"{name}.U"] += h.T @ d_rec
        grad[f"{name}.c"] += d_inner.sum(axis=0)
        dh = np.where(on, dh * z, dh) + d_rec @ u.T
    return d_gates


def _layer_back(net: dict, grad: dict, name: str, tape: dict, d_pooled: np.ndarray) -> np.ndarray:
    """The gradient of a layer's gates; adds those of its own values to grad."""
    own = tape[name]
    states, u, weight, live = own["states"], own["u"], own["weight"], own["live"]
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_s = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_u = d_s[:, :, None] * net[f"{name}v"] * (1 - u * u)
    grad[f"{name}v"] += np.einsum("tb,tbk->k", d_s, u)
    grad[f"{name}A"] += np.einsum("tbh,tbk->hk", states, d_u)
    grad[f"{name}a"] += d_u.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pooled + d_u @ net[f"{name}A"].T
    k = states.shape[2] // 2
    return np.concatenate([_gru_back(net, grad, f"{name}{way}", own[way], live, part) for way, part in (("F", d_states[:, :, :k]), ("B", d_states[:, :, k:]))], axis=2)


def _added(values: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values by row number."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    some, first = np.unique(at[order], return_index=True)
    if len(some):
        out[some] = np.add.reduceat(values[order], first)
    return out


def word_vectors(net: dict[str, np.ndarray], chars: np.ndarray, ids: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Inputs of the second layer of words: chars by bytes_of, ids of their vectors (0: unknown)."""
    table = net["E"] @ net["cW"] + net["cb"]
    return np.concatenate([_layer(net, "c", table[chars], chars > 0, tape), net["V"][ids]], axis=1)


def word_gates(net: dict[str, np.ndarray], chars: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What each word adds to the gates of both directions of the second layer."""
    return word_vectors(net, chars, ids) @ net["wW"] + net["wb"]


def window_logits(net: dict[str, np.ndarray], gates: np.ndarray, at: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logits of windows; at: the gates' row of each step (-1: none) of each window."""
    pooled = _layer(net, "w", gates[at.T], at.T >= 0, tape)
    if tape is not None:
        tape["pooled"] = pooled
    return pooled @ net["w"] + net["o"][0]


def loss(net: dict[str, np.ndarray], chars: np.ndarray, ids: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of windows and its gradient."""
    grad, tape = {k: np.zeros_like(v) for k, v in net.items()}, {}
    x = word_vectors(net, chars, ids, tape)
    logit = window_logits(net, x @ net["wW"] + net["wb"], at, tape)
    d = ((_sigmoid(logit) - y) / len(y)).astype(x.dtype)
    grad["w"], grad["o"] = tape["pooled"].T @ d, np.array([d.sum()], x.dtype)
    d_gates = _layer_back(net, grad, "w", tape, d[:, None] * net["w"])
    on = at.T >= 0
    d_rows = _added(d_gates[on], at.T[on], len(x))
    grad["wW"], grad["wb"] = x.T @ d_rows, d_rows.sum(axis=0)
    dx = d_rows @ net["wW"].T
    k = 2 * len(net["cF.U"])
    grad["V"] = _added(dx[:, k:], ids, len(net["V"]))
    d_chars = _layer_back(net, grad, "c", tape, dx[:, :k])
    d_table = _added(d_chars.reshape(-1, d_chars.shape[2]), chars.ravel().astype(np.int64), 256)
    grad["cW"], grad["cb"], grad["E"] = net["E"].T @ d_table, d_table.sum(axis=0), d_table @ net["cW"].T
    return float(np.mean(np.logaddexp(0, logit) - y * logit)), grad


def start(rng: np.random.Generator, vocabulary: int) -> dict[str, np.ndarray]:
    """Values before training; vocabulary: words with a vector of their own."""
    sizes = {"E": (256, BYTE_VECTOR), "V": (1 + vocabulary, WORD_VECTOR), "w": (2 * WORD_STATE,), "o": (1,)}
    for name, k, inputs in (("c", BYTE_STATE, BYTE_VECTOR), ("w", WORD_STATE, 2 * BYTE_STATE + WORD_VECTOR)):
        sizes |= {f"{name}W": (inputs, 6 * k), f"{name}b": (6 * k,), f"{name}A": (2 * k, PROJECTED), f"{name}a": (PROJECTED,), f"{name}v": (PROJECTED,)}
        for way in "FB":
            sizes |= {f"{name}{way}.U": (k, 3 * k), f"{name}{way}.c": (k,)}
    scale = {"E": 0.5, "V": 0.1}
    return {k: (rng.normal(0, scale.get(k, 1 / np.sqrt(s[0])), s) if len(s) > 1 or k in ("w", "cv", "wv") else np.zeros(s)).astype(np.float32) for k, s in sizes.items()}


@dataclass
class Model:
    """base: the score where there are no labels of both kinds; vocabulary: sorted hashes of the words with a vector."""

    base: float
    net: dict[str, np.ndarray] | None = None
    vocabulary: np.ndarray | None = None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def gates(self, words: Words, picked: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Gates of the picked words, worked out in groups of like length."""
        out = np.empty((len(picked), self.net["wW"].shape[1]), np.float32)
        order = np.argsort(words.ends[picked] - words.starts[picked], kind="stable")
        ids = self.ids(hashes)
        for at in range(0, len(order), GROUP):
            some = order[at : at + GROUP]
            out[some] = word_gates(self.net, bytes_of(words, picked[some])[0], ids[some])
        return out


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of each window (windows x WINDOW, -1 past the text's end), and the window's text. Texts without words have none."""
    size = np.diff(bounds)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = (bounds[doc] + number * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(at < bounds[doc + 1][:, None], at, -1), doc


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """The model of labelled texts. With labels of one kind only, every score is their share.

    A document's label is that of its highest window. At first windows are taken at random; then, from time to time, the
    highest of each document is looked for, and clean documents go on giving random ones too.
    """
    y = labels.astype(np.float32)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    column = pa.array(texts, pa.string())
    words = pieces_of(Words(*buffer_of(column)))
    doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    parts = slices(pa.RecordBatch.from_arrays([column], ["text"]))
    hashes, first, which = np.unique(np.concatenate([pieces_of(Words(*buffer_of(p.column(0)))).hashes() for p in parts]), return_index=True, return_inverse=True)
    held = np.bincount(np.unique(doc.astype(np.int64) * len(first) + which) % len(first), minlength=len(first))
    rng = np.random.default_rng(seed)
    model = Model(float(y.mean()), start(rng, int((held >= LEAST_DOCS).sum())), hashes[held >= LEAST_DOCS])
    net, ids = model.net, model.ids(hashes)
    net["o"][:] = -1
    at, of = windows_of(words.bounds)
    at = np.where(at >= 0, which[at], -1)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    usable = np.flatnonzero(np.diff(edges) > 0)
    groups = [usable[y[usable] == k] for k in (0, 1)]
    m, v = ({k: np.zeros_like(a) for k, a in net.items()} for _ in range(2))
    best, step, mean = None, 0, None
    for steps in STEPS:
        if step:
            gates = model.gates(words, first, hashes)
            logit = np.concatenate([window_logits(net, gates, at[a : a + GROUP]) for a in range(0, len(at), GROUP)])
            best = np.full(len(texts), -1)
            best[of[np.argsort(logit, kind="stable")]] = np.argsort(logit, kind="stable")
        for _ in range(steps):
            docs = np.concatenate([rng.choice(groups[1], BATCH // 3), rng.choice(groups[0], BATCH - BATCH // 3)])
            some = rng.integers(edges[docs], edges[docs + 1])
            if best is not None:
                some = np.where((y[docs] == 1) | (rng.random(len(docs)) < 0.5), best[docs], some)
            own, back = np.unique(at[some], return_inverse=True)
            back = back.reshape(at[some].shape)
            if own[0] < 0:
                own, back = own[1:], back - 1
            shown = np.where(rng.random(len(own)) < HIDE, 0, ids[own])
            _, g = loss(net, bytes_of(words, first[own])[0], shown, back, y[docs])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k, a in g.items():
                a = a / max(1.0, norm)
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
                net[k] -= (RATE * (1 - 0.9 * step / sum(STEPS)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if 2 * step > sum(STEPS):  # the mean of the later steps' values is steadier than the last ones
                mean = {k: a.astype(np.float64) for k, a in net.items()} if mean is None else {k: mean[k] + AVERAGE * (a - mean[k]) for k, a in net.items()}
    model.net = {k: a.astype(np.float32) for k, a in mean.items()}
    return model


# Scoring


#: Distinct words that a worker holds at a time.
HELD_WORDS = 100_000


class Seen:
    """A growing map from 64-bit keys to the order in which they came."""

    def __init__(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each of the distinct sorted keys, and which of them are new (they get the next rows)."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        hit = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit)
        rows = self.rows[near] if len(self.keys) else np.zeros(len(keys), np.int64)
        rows[new] = len(self.keys) + np.arange(len(new))
        self.keys, self.rows = np.insert(self.keys, at[new], keys[new]), np.insert(self.rows, at[new], rows[new])
        return rows, new


class Scorer:
    """Scores slices of texts; the gates of the words that a worker has met are kept."""

    def __init__(self, model: Model):
        self.model, self.seen, self.rows = model, Seen(), np.zeros((0, 6 * WORD_STATE), np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; a text without words has that of a window of one word without letters."""
        model = self.model
        if model.net is None:
            return np.full(len(texts), model.base)
        words = pieces_of(Words(*buffer_of(texts)))
        if len(self.seen) > HELD_WORDS:
            self.seen, self.rows = Seen(), self.rows[:0]
        keys, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        rows, new = self.seen.rows_of(keys)
        if len(new):
            self.rows = np.concatenate([self.rows, model.gates(words, first[new], keys[new])])
        gates = self.rows[rows]
        at, doc = windows_of(words.bounds)
        empty = float(window_logits(model.net, word_gates(model.net, np.ones((1, 1), np.uint8), np.zeros(1, np.int64)), np.zeros((1, 1), np.int64))[0])
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(at), GROUP):
            part = at[a : a + GROUP]
            logit = window_logits(model.net, gates, np.where(part >= 0, which[part], -1))
            np.maximum.at(best, doc[a : a + GROUP], logit)
        return _sigmoid(np.where(np.isneginf(best), empty, best)).astype(np.float64)


def remainder(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0: held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the bounded sample of labelled rows that are not held out; null labels and ids are left out."""
    marked = labels.where(remainder() != 0).where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= TRAIN_BYTES)
    picked = marked.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionAll(marked.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    ids = [(r.doc_id, r.toxic) for r in picked.collect()]  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    if not ids:
        return Model(0.0)
    small = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    rows = texts.join(F.broadcast(small), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy())


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (0 to 1), one row per row.

    Null and empty texts are scored as a window of one word without letters. Labels of one kind only, or none, give their share
    as every score. Repeated rows get the same score. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in steady(batches):
            for part in slices(batch, limit=PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score below limit, all columns as they were."""
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in steady(batches):
            for part in slices(batch, f"x{at}", PART_BYTES):
                yield part.filter(pa.array(scorer.scores(part.column(at)) < limit))

    flat = docs.toDF(*(f"x{k}" for k in range(len(names))))
    return flat.mapInArrow(run, flat.schema).toDF(*names)
