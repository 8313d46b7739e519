"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as bytes, in windows of fixed length. Forward and backward gated recurrent
units run over a window, every position gets a distribution over the languages, and the mean
over all positions of the whole text is the document's distribution. The network is trained
in numpy by backpropagation through time with Adam, on windows of a bounded sample of labelled
documents; it learns from their text and label alone.

Gates and candidates use piecewise linear squashing (clipped lines) in training and prediction
alike, which keeps a step to a few array operations over many windows at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import fresh, map_columns

WINDOW = 64  # bytes
UNITS = 8  # per direction
TOGETHER = 2048  # windows of one step
SEED = 42
# bounds of the training sample: documents per language, windows per document
SAMPLE_DOCUMENTS = 300
SAMPLE_WINDOWS = 12
SPARE = 20  # so many times that number is ranked
EPOCHS = 2
BATCH = 128
RATE = 0.01

ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    """Weights per direction: table (byte -> update, reset, candidate inputs), recurrent weights
    of the gates and of the candidate; and the output layer. languages: the labels."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], units: int = UNITS) -> Network:
        draw = np.random.default_rng(SEED)
        normal = lambda *shape, scale: (draw.normal(size=shape) * scale).astype(np.float32)
        weights: dict[str, np.ndarray] = {}
        for way in ("forward", "backward"):
            table = normal(256, 3 * units, scale=0.3)
            table[:, :units] -= 0.5  # slow updates at first: a long memory
            weights[f"{way} table"] = table
            weights[f"{way} gates"] = normal(units, 2 * units, scale=0.3)
            weights[f"{way} candidate"] = normal(units, units, scale=0.3)
        weights["out"] = normal(2 * units, len(languages), scale=0.3)
        weights["bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, weights)

    @property
    def units(self) -> int:
        return len(self.weights["forward candidate"])

    def run(self, x: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [time, window, unit] of one direction over windows of bytes [window, time]."""
        h, n = self.units, len(x)
        table, gates, candidate = (self.weights[f"{way} {k}"] for k in ("table", "gates", "candidate"))
        steps = range(x.shape[1]) if way == "forward" else range(x.shape[1] - 1, -1, -1)
        columns = np.ascontiguousarray(x.T)
        states = np.empty((x.shape[1], n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        inputs = np.empty((n, 3 * h), np.float32)
        trace = []
        for t in steps:
            np.take(table, columns[t], axis=0, out=inputs)
            pre = state @ gates
            pre += inputs[:, : 2 * h]
            pre *= 0.25
            pre += 0.5
            gate = np.clip(pre, 0, 1)
            reset = gate[:, h:] * state
            raw = reset @ candidate
            raw += inputs[:, 2 * h :]
            new = np.clip(raw, -1, 1)
            if keep:
                trace.append((t, state, pre.copy(), gate, reset, raw.copy(), new.copy()))
            new -= state
            new *= gate[:, :h]
            new += state
            states[t] = new
            state = states[t]
        return states, trace

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distributions [time, window, language]."""
        h = self.units
        forward, _ = self.run(x, "forward")
        backward, _ = self.run(x, "backward")
        score = forward.reshape(-1, h) @ self.weights["out"][:h]
        score += backward.reshape(-1, h) @ self.weights["out"][h:]
        score += self.weights["bias"]
        score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score.reshape(x.shape[1], len(x), -1)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions, and its gradient by backpropagation through time.

        x: bytes [window, time]; y: language of each window; mask: positions that count."""
        h = self.units
        sides = {way: self.run(x, way, keep=True) for way in ("forward", "backward")}
        both = np.concatenate([sides["forward"][0], sides["backward"][0]], axis=2)
        score = both @ self.weights["out"] + self.weights["bias"]
        score -= score.max(2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(2, keepdims=True)
        live = mask.T[:, :, None] / max(1.0, float(mask.sum()))
        own = np.arange(len(y))
        loss = float(-(np.log(p[:, own, y] + 1e-12) * live[:, :, 0]).sum())
        p[:, own, y] -= 1
        p *= live
        out: dict[str, np.ndarray] = {"out": both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), "bias": p.sum((0, 1))}
        above = p @ self.weights["out"].T
        for k, (way, (_, trace)) in enumerate(sides.items()):
            gates, candidate = self.weights[f"{way} gates"], self.weights[f"{way} candidate"]
            d_table = np.zeros_like(self.weights[f"{way} table"])
            d_gates, d_candidate = np.zeros_like(gates), np.zeros_like(candidate)
            back = np.zeros((len(x), h), np.float32)
            for t, state, pre, gate, reset, raw, new in reversed(trace):
                d = above[t, :, k * h : (k + 1) * h] + back
                update = gate[:, :h]
                d_raw = d * update * ((raw > -1) & (raw < 1))
                d_reset = d_raw @ candidate.T
                d_gate = np.concatenate([d * (new - state), d_reset * state], axis=1)
                d_pre = d_gate * (0.25 * ((pre > 0) & (pre < 1)))
                d_candidate += reset.T @ d_raw
                d_gates += state.T @ d_pre
                np.add.at(d_table, x[:, t], np.concatenate([d_pre, d_raw], axis=1))
                back = d * (1 - update) + d_reset * gate[:, h:] + d_pre @ gates.T
            out |= {f"{way} table": d_table, f"{way} gates": d_gates, f"{way} candidate": d_candidate}
        return loss, out


def train(windows: np.ndarray, mask: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Network:
    """Adam with a falling rate over shuffled batches; the same network for the same input."""
    network = Network.new(languages)
    draw = np.random.default_rng(SEED)
    first = {k: np.zeros_like(w) for k, w in network.weights.items()}
    second = {k: np.zeros_like(w) for k, w in network.weights.items()}
    total, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for low in range(0, len(y), BATCH):
            some = order[low : low + BATCH]
            _, slope = network.gradients(windows[some], y[some], mask[some])
            size = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, g in slope.items():
                g = g / max(1.0, size)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                network.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return network


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [n, window] of whole texts, padded by zeros; the text of each; its bytes that count."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * window, b"\0") for t, n in zip(texts, counts.tolist()))
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(joined, np.uint8).reshape(-1, window), owner, np.minimum(window, lengths[owner] - place * window)


def probabilities(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text; zeros for an empty one."""
    windows, owner, live = cut(texts)
    total = np.zeros((len(texts), len(network.languages)))
    for low in range(0, len(windows), TOGETHER):
        part = windows[low : low + TOGETHER]
        p = network.positions(part)
        counts = live[low : low + TOGETHER]
        if counts.min() < WINDOW:
            p *= (np.arange(WINDOW)[:, None] < counts)[:, :, None]
        sums = p.sum(0)
        for k in range(sums.shape[1]):
            total[:, k] += np.bincount(owner[low : low + TOGETHER], sums[:, k], len(texts))
    lengths = np.array([max(1, len(t)) for t in texts])
    return total / lengths[:, None]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, window, live: at most SAMPLE_DOCUMENTS documents of each language, chosen by a hash
    of their id, and of each at most SAMPLE_WINDOWS windows, evenly spaced over the whole text."""
    labelled = labelled.select(*[F.col(f"`{c}`").alias(name) for c, name in ((id_col, "own_id"), (lang_col, "own_lang"), (text_col, "text"))])
    ids = labelled.where("own_lang IS NOT NULL AND text IS NOT NULL").select(F.col("own_id").alias("__id"), F.col("own_lang").alias("__lang"))
    # a thin slice of each language by hash first, so that ranking one never takes many rows
    counts = ids.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n"))
    slice_of = F.pmod(F.xxhash64("__id", F.lit(SEED + 1)), F.lit(1_000_000)) * F.col("__n")
    ids = ids.join(F.broadcast(counts), "__lang").where(slice_of < SPARE * SAMPLE_DOCUMENTS * 1_000_000)
    turn = F.row_number().over(Window.partitionBy("__lang").orderBy(F.xxhash64("__id", F.lit(SEED)), "__id"))
    few = ids.withColumn("__turn", turn).where(F.col("__turn") <= SAMPLE_DOCUMENTS).select("__id", "__lang").distinct()
    # a fixed number of ids per language, however many documents there are
    met = labelled.join(F.broadcast(few), (F.col("own_id") == F.col("__id")) & (F.col("own_lang") == F.col("__lang")))
    texts = met.select("__lang", F.col("text").cast("binary").alias("text"))

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for text in columns[0].to_pylist():
                n = -(-len(text) // WINDOW)
                places = sorted({int(k * n / min(n, SAMPLE_WINDOWS)) for k in range(min(n, SAMPLE_WINDOWS))})
                out.append([text[WINDOW * p : WINDOW * (p + 1)] for p in places])
            return [pa.array(out, pa.list_(pa.binary()))]

        return work

    made = map_columns(texts, ["text"], [("windows", T.ArrayType(T.BinaryType()))], make, keep=["__lang"])
    return made.select(F.col("__lang").alias("lang"), F.explode("windows").alias("window"))


def learned(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the bounded sample; None where nothing is labelled."""
    rows = sample(labelled, id_col, text_col, lang_col).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    languages = sorted({r["lang"] for r in rows})
    number = {name: k for k, name in enumerate(languages)}
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for k, r in enumerate(rows):
        windows[k, : len(r["window"])] = np.frombuffer(r["window"], np.uint8)
    live = np.array([len(r["window"]) for r in rows])
    mask = (np.arange(WINDOW) < live[:, None]).astype(np.float32)
    return train(windows, mask, np.array([number[r["lang"]] for r in rows]), languages)


def predict(
    docs: DataFrame, network: Network | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None
) -> DataFrame:
    """The kept columns (default: all) with the language of the whole text and its probability.

    Texts that are NULL, empty or without a letter get ``und`` and 0, and so does everything
    where no network could be trained. Of equally likely languages the first by name wins."""
    # plain values: classes would be looked up by name, and executors have no copy of the package
    plain = None if network is None else (network.languages, network.weights)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def make():
        model = None if shared.value is None else Network(*shared.value)

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            texts = [t or b"" for t in columns[0].to_pylist()]
            known = [model is not None and has_letter(t) for t in texts]
            labels, scores = ["und"] * len(texts), [0.0] * len(texts)
            read = [k for k, ok in enumerate(known) if ok]
            if read:
                p = probabilities(model, [texts[k] for k in read])
                for k, best, row in zip(read, p.argmax(1).tolist(), p):
                    labels[k], scores[k] = model.languages[best], float(min(1.0, row[best]))
            return [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

        return work

    kept = docs.columns if keep is None else keep
    text = fresh(docs, "utf8")
    fields = [(names[0], T.StringType()), (names[1], T.DoubleType())]
    return map_columns(docs.withColumn(text, F.col(f"`{text_col}`").cast("binary")), [text], fields, make, keep=kept)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Held-out documents are not learned from."""
    network = learned(docs.select("doc_id", "text", "lang").where(~held_out()))
    out = predict(docs.select("doc_id", "text"), network, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
