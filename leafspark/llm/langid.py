"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of ``WINDOW`` bytes. In each window one network reads forward and one backward; at every
byte the two states together give a probability of each language, and a document's probabilities are the mean over
all its bytes. Nothing of a text is left out. Training is backpropagation through time with Adam.

What is learned from is bounded: of each language at most ``PER_LANGUAGE`` labelled documents, those with the least hashes,
so that a rare language is learned however large the table is. All windows of their whole texts, the short ones at the end
too, are drawn from alike: training takes ``STEPS`` batches of ``BATCH`` windows, and the windows with the least hashes of each
language, an equal share of each, are what it draws from. They are chosen on the executors; the driver gets no more than
STEPS * BATCH windows, whatever the input. Every random number is seeded, so training repeats.

Only text and lang are looked at; a prediction sees the text alone. Defined results: a text that is null, or has no
letter (Unicode category L), is ``und`` with score 0; documents without lang are predicted but not learned from; repeated
rows are predicted alike; with no labelled document everything is ``und``; an empty table gives no rows; other columns
are ignored. A text is held whole, and as many bytes again, while it is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .npbytes import U64, mix, slices, text_buffer

WINDOW = 96
HIDDEN = 8
#: At most so many labelled documents of each language are learned from.
PER_LANGUAGE = 600
STEPS = 200
BATCH = 128
FOLDS = 5


def has_letter(text: str) -> bool:
    """Whether a character is of category L, which is what isalpha() tells."""
    return any(map(str.isalpha, text))


def _init(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    model = {}
    for way in "fb":
        model[f"x{way}"] = rng.normal(0, 0.5, (257, 3 * h))  # byte 256 is padding
        model[f"u{way}"] = rng.normal(0, 0.3, (h, 3 * h))
        model[f"c{way}"] = np.zeros(h)  # bias of the state's share of the candidate
    model["o"] = rng.normal(0, 0.3, (2 * h, classes))
    model["p"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(data: np.ndarray, x: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    """The state after each byte, time first, and what the way back needs."""
    h = HIDDEN
    steps, rows = data.shape
    out = np.zeros((steps + 1, rows, h), np.float32)
    saved = []
    for t in range(steps):
        before = out[t]
        given = x[data[t]]
        ahead = before @ u
        gates = _sigmoid(given[:, : 2 * h] + ahead[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        part = ahead[:, 2 * h :] + c
        candidate = np.tanh(given[:, 2 * h :] + r * part)
        out[t + 1] = before + z * (candidate - before)
        saved.append((z, r, part, candidate))
    return out, saved


def _back(data: np.ndarray, out: np.ndarray, saved: list, grad: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of x, u and c from those of the states."""
    h = HIDDEN
    steps, rows = data.shape
    gu, gc = np.zeros_like(u), np.zeros(h, np.float32)
    inputs = np.empty((steps, rows, 3 * h), np.float32)
    later = np.zeros((rows, h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, part, candidate = saved[t]
        before = out[t]
        d = grad[t] + later
        d_candidate = d * z * (1 - candidate * candidate)
        d_z = d * (candidate - before) * z * (1 - z)
        d_r = d_candidate * part * r * (1 - r)
        inner = np.concatenate([d_z, d_r, d_candidate * r], axis=1)
        gu += before.T @ inner
        gc += (d_candidate * r).sum(axis=0)
        inputs[t, :, : 2 * h], inputs[t, :, 2 * h :] = inner[:, : 2 * h], d_candidate
        later = d * (1 - z) + inner @ u.T
    flat, inputs = data.reshape(-1), inputs.reshape(-1, 3 * h)
    gx = np.stack([np.bincount(flat, inputs[:, k], 257) for k in range(3 * h)], axis=1).astype(np.float32)
    return gx, gu, gc


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 0) -> dict:
    """The network's arrays and its languages, learned from windows of WINDOW bytes at most."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = _init(max(1, len(languages)), rng)
    if len(languages) < 2:
        return {"languages": languages, "model": model}
    data = np.full((len(windows), WINDOW), 256)
    for row, raw in zip(data, windows, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    number = {x: i for i, x in enumerate(languages)}
    wanted = np.array([number[x] for x in labels])
    chance = 1 / np.bincount(wanted, minlength=len(languages))[wanted]  # each language as often
    chance /= chance.sum()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(data), BATCH, p=chance)
        seq = np.ascontiguousarray(data[pick].T)
        real = (seq < 256).astype(np.float32)
        fwd, fs = _states(seq, model["xf"], model["uf"], model["cf"])
        bwd, bs = _states(seq[::-1], model["xb"], model["ub"], model["cb"])
        both = np.concatenate([fwd[1:], bwd[1:][::-1]], axis=2)
        logits = both @ model["o"] + model["p"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        prob[:, np.arange(BATCH), wanted[pick]] -= 1
        prob *= real[:, :, None] / real.sum()
        flat = prob.reshape(-1, prob.shape[2])
        grads = {"o": both.reshape(len(flat), -1).T @ flat, "p": flat.sum(axis=0)}
        d = prob @ model["o"].T
        grads["xf"], grads["uf"], grads["cf"] = _back(seq, fwd, fs, d[:, :, :HIDDEN], model["uf"])
        grads["xb"], grads["ub"], grads["cb"] = _back(seq[::-1], bwd, bs, d[::-1, :, HIDDEN:], model["ub"])
        rate = 0.03 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"languages": languages, "model": {k: v.astype(np.float32) for k, v in model.items()}}


def _run(data: np.ndarray, x: np.ndarray, u: np.ndarray, c: np.ndarray, back: bool) -> np.ndarray:
    """States after each byte, as (time, unit, window). Gate weights come halved, so that one tanh makes both gates."""
    h = HIDDEN
    steps, rows = data.shape
    out = np.empty((steps, h, rows), np.float32)
    state = np.zeros((h, rows), np.float32)
    ahead = np.empty((3 * h, rows), np.float32)
    given = np.empty((3 * h, rows), np.float32)
    gates, update, reset = given[: 2 * h], given[:h], given[h : 2 * h]
    candidate, part = given[2 * h :], ahead[2 * h :]
    for t in range(steps - 1, -1, -1) if back else range(steps):
        np.take(x, data[t], axis=1, out=given, mode="clip")
        np.matmul(u, state, out=ahead)
        gates += ahead[: 2 * h]
        np.tanh(gates, out=gates)
        gates += 1  # twice the gate
        part += c
        part *= reset  # u and c of the candidate come halved, too
        part += candidate
        np.tanh(part, out=part)
        part -= state
        part *= update
        part *= 0.5
        np.add(state, part, out=out[t])
        state = out[t]
    return out


def _ready(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays with units first, and halved where _run() takes twice a gate."""
    h = HIDDEN
    out = {"p": model["p"][:, None], "of": np.ascontiguousarray(model["o"][:h].T), "ob": np.ascontiguousarray(model["o"][h:].T)}
    for way in "fb":
        x = model[f"x{way}"].copy()
        x[:, : 2 * h] *= 0.5
        out[f"x{way}"], out[f"u{way}"], out[f"c{way}"] = np.ascontiguousarray(x.T), np.ascontiguousarray(0.5 * model[f"u{way}"].T), 0.5 * model[f"c{way}"][:, None]
    return {k: v.astype(np.float32) for k, v in out.items()}


def probabilities(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Each text's mean probabilities over its bytes; texts without bytes get zeros."""
    ready = _ready(model)
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    start = offsets[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    out = np.zeros((len(sizes), len(model["p"])))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for a in range(0, len(start), 2048):
        mine = owner[a : a + 2048]
        at = start[a : a + 2048][None] + np.arange(WINDOW)[:, None]
        real = at < offsets[mine + 1][None]
        seq = np.where(real, padded[at].astype(np.int64), 256)
        logits = ready["of"] @ _run(seq, ready["xf"], ready["uf"], ready["cf"], False)
        logits += ready["ob"] @ _run(seq, ready["xb"], ready["ub"], ready["cb"], True)
        logits += ready["p"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (real / logits.sum(axis=1))[:, None]
        np.add.at(out, mine, logits.sum(axis=0).T)
    return out / np.maximum(sizes, 1)[:, None]


def _predict(trained: dict):
    languages, model = trained["languages"], trained["model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_buffer(column)
            for row, end in slices(offsets, 1 << 20):
                texts = column[row:end].to_pylist()
                if languages:
                    p = probabilities(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], model)
                else:
                    p = np.zeros((end - row, 1))
                best, score = p.argmax(axis=1), p.max(axis=1)
                known = [bool(languages and t and has_letter(t)) for t in texts]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[row:end],
                    "held_out": batch.column("held_out")[row:end],
                    "lang_pred": pa.array([languages[b] if k else "und" for b, k in zip(best, known, strict=True)]),
                    "score": pa.array([float(min(1.0, s)) if k else 0.0 for s, k in zip(score, known, strict=True)]),
                })

    return run


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _windows(most: int):
    """All windows of each text (lang, key, text) with an order made of its key; of a text with more than ``most`` windows
    those that come first in that order, as no others can be among the first ``most`` of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not has_letter(text):
                    continue
                raw = text.encode()
                order = mix(U64(key % (1 << 64)) + np.arange(-(-len(raw) // WINDOW), dtype=U64) * U64(0x9E3779B97F4A7C15))
                first = np.argsort(order, kind="stable")[:most]
                for at in range(0, len(first), 10_000):
                    some = first[at : at + 10_000]
                    pieces = [raw[i * WINDOW : (i + 1) * WINDOW] for i in some.tolist()]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some)), "order": pa.array(order[some].view(np.int64)), "piece": pa.array(pieces, pa.binary())})

    return run


def train_on(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS, steps: int = STEPS) -> dict:
    """A network trained on whole texts of at most ``per_language`` labelled documents of each language that aren't held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds))
    rows = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return train([], [], steps)
    # Hashes are even: this share of a language holds per_language documents but once in many millions, and few more.
    share = {x: min(1.0, (per_language + 6 * per_language**0.5) / n) for x, n in counts.items()}
    least = F.create_map(*(F.lit(v) for x, p in share.items() for v in (x, int(p * 2.0**63) - 1)))
    some = rows.where((F.col("key").bitwiseAND((1 << 63) - 1)) <= least[F.col("lang")])
    first = Window.partitionBy("lang")
    some = some.withColumn("n", F.row_number().over(first.orderBy("key"))).where(F.col("n") <= per_language).drop("n")
    each = -(-steps * BATCH // len(counts))
    pieces = some.mapInArrow(_windows(each), "lang string, order long, piece binary")
    drawn = pieces.withColumn("n", F.row_number().over(first.orderBy("order", "piece"))).where(F.col("n") <= each)
    drawn = drawn.select("lang", "order", "piece").collect()  # steps * BATCH windows, and a few for rounding, at most
    drawn.sort()
    return train([bytes(r["piece"]) for r in drawn], [r["lang"] for r in drawn], steps)


def predict_language(docs: DataFrame, trained: dict | None = None, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; trains on ``docs`` itself unless a network is given."""
    trained = trained or train_on(docs, folds=folds)
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(trained), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
