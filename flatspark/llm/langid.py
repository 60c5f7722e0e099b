"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into windows of ``STEPS`` bytes, which all run side by side. In each direction a layer of
``HIDDEN`` gated units reads the window; from both states of a byte a linear layer and a softmax label
that position. The probabilities of all positions of a document, those of every window of the whole
text, are averaged; the largest is the language and the score. Weights are learned by backpropagation
through time with Adam, in about ``UPDATES`` updates, from at most ``SAMPLE`` windows of ``DRAWN`` bytes, one from each of the labelled
training documents with the least hash of its id, at a place given by the hash. Languages are the
label's values in this sample. Gates and candidate use piecewise linear curves, which cost no exponential.

The weights (some kilobytes) are broadcast. Nothing is shuffled but the sample.

Defined results: a null text or one without a letter is ``und`` with score 1; a null label teaches
nothing; without labelled training documents every text is ``und``, with score 0 where it has letters;
ties go to the language first in order; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, least_hashed, mapped, table
from .textops import slices, text_buffer

HIDDEN = 8
STEPS = 48
DRAWN = 192
SAMPLE = 2400
UPDATES = 228
BATCH = 512
HELD_OUT = 5
#: Windows that run side by side; a long text takes several runs.
SIDE = 8192
#: The pipeline rejects texts without letters, and those whose best language is not this much of the way from an even guess to certainty.
REJECT = 0.1


def gate(x, out=None):
    """Piecewise linear sigmoid."""
    out = np.multiply(x, np.float32(0.25), out=out)
    out += np.float32(0.5)
    return np.clip(out, 0, 1, out=out)


class Network:
    """Parameters by name: E (byte inputs), U (recurrent, gates), V (recurrent, candidate) of each direction, W and b."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.labels = labels
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.4, (257, 3 * h)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)
            self.p["V" + d] = rng.normal(0, 0.3, (h, h)).astype(np.float32)
        self.p["W"] = rng.normal(0, 0.3, (2 * h, len(labels))).astype(np.float32)
        self.p["b"] = np.zeros(len(labels), dtype=np.float32)

    def direction(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN); codes are (steps, windows), 256 where a window has no byte."""
        e, u, v, h = self.p["E" + d], self.p["U" + d], self.p["V" + d], HIDDEN
        steps, n = codes.shape
        out = np.empty((steps, n, h), dtype=np.float32)
        state = np.zeros((n, h), dtype=np.float32)
        rows, gates, cand = np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(e, codes[t], axis=0, out=rows, mode="clip")
            np.matmul(state, u, out=gates)
            gates += rows[:, : 2 * h]
            raw = gates.copy() if keep is not None else None
            gate(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            held = r * state
            np.matmul(held, v, out=cand)
            cand += rows[:, 2 * h :]
            raw_cand = cand.copy() if keep is not None else None
            np.clip(cand, -1, 1, out=cand)
            if keep is not None:
                keep.append((t, state, raw, z.copy(), r.copy(), held, raw_cand, cand.copy()))
            state = state + z * (cand - state)
            out[t] = state
        return out

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (steps, windows, labels)."""
        h = HIDDEN
        logits = self.direction(codes, "f") @ self.p["W"][:h]
        logits += self.direction(codes, "b") @ self.p["W"][h:]
        logits += self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions with a byte, and its gradient by backpropagation through time."""
        h, g = HIDDEN, {}
        keeps: dict[str, list] = {"f": [], "b": []}
        states = {d: self.direction(codes, d, keeps[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ self.p["W"] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        real = (codes < 256)[..., None]
        total = max(1, int(real.sum()))
        n = np.arange(codes.shape[1])
        loss = float(-(np.log(prob[:, n, target] + 1e-9) * real[..., 0]).sum() / total)
        delta = prob
        delta[:, n, target] -= 1
        delta *= real / np.float32(total)
        g["W"] = np.einsum("tnh,tnk->hk", both, delta, optimize=True)
        g["b"] = delta.sum(axis=(0, 1))
        into = delta @ self.p["W"].T
        for d, part in (("f", into[..., :h]), ("b", into[..., h:])):
            u, v = self.p["U" + d], self.p["V" + d]
            ge, gu, gv = np.zeros_like(self.p["E" + d]), np.zeros_like(u), np.zeros_like(v)
            back = np.zeros(part.shape[1:], dtype=np.float32)
            for t, before, raw, z, r, held, raw_cand, cand in reversed(keeps[d]):
                back = back + part[t]
                d_cand = back * z * (np.abs(raw_cand) < 1)
                d_held = d_cand @ v.T
                d_gates = np.concatenate([back * (cand - before), d_held * before], axis=1) * (np.abs(raw) < 2) * np.float32(0.25)
                gu += before.T @ d_gates
                gv += held.T @ d_cand
                np.add.at(ge, codes[t], np.concatenate([d_gates, d_cand], axis=1))
                back = back * (1 - z) + d_held * r + d_gates @ u.T
            g["E" + d], g["U" + d], g["V" + d] = ge, gu, gv
        return loss, g


def windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (steps, windows) of all rows and the row of each window."""
    sizes = np.diff(offsets)
    many = -(-sizes // steps)
    row = np.repeat(np.arange(len(sizes)), many)
    first = offsets[:-1][row] + steps * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    at = first + np.arange(steps)[:, None]
    codes = np.where(at < offsets[1:][row], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 256).astype(np.int16)
    return codes, row


def train(texts: list[bytes], labels: list[str], updates: int = UPDATES, seed: int = 7) -> Network:
    names = sorted(set(labels))
    net = Network(names, seed)
    if len(names) < 2:
        return net
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    codes, row = windows(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    target = np.array([names.index(x) for x in labels])[row]
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, whole = 0, updates
    for _ in range(-(-updates // max(1, -(-len(target) // BATCH)))):
        order = rng.permutation(len(target))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            _, g = net.gradients(codes[:, part], target[part])
            scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / whole)
            for k, x in g.items():
                x = x * np.float32(scale)
                mean[k] = 0.9 * mean[k] + 0.1 * x
                square[k] = 0.99 * square[k] + 0.01 * x * x
                net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def has_letter(text: bytes) -> bool:
    return text.isalpha() if text.isascii() and len(text) < 2 else any(c.isalpha() for c in text.decode("utf-8", "replace"))


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter: most have an ASCII one; the others are looked at by character."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
    return out


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the position probabilities of each row (rows, labels); zeros for empty rows."""
    n = len(offsets) - 1
    total = np.zeros((n, len(net.labels)))
    row_lo = 0
    while row_lo < n:
        # As many rows as fill one run; a longer row is cut between its windows.
        limit = offsets[row_lo] + SIDE * STEPS // 2
        row_hi = max(row_lo + 1, int(np.searchsorted(offsets, limit, side="right")) - 1)
        codes, row = windows(data, offsets[row_lo : row_hi + 1])
        for i in range(0, codes.shape[1], SIDE):
            part = codes[:, i : i + SIDE]
            prob = net.positions(part)
            prob *= (part < 256)[..., None]
            sums = prob.sum(axis=0, dtype=np.float64)
            for k in range(len(net.labels)):
                total[row_lo:row_hi, k] += np.bincount(row[i : i + SIDE], weights=sums[:, k], minlength=row_hi - row_lo)
        row_lo = row_hi
    return total / np.maximum(1, np.diff(offsets))[:, None]


def judged(net: Network, column) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, slice by slice."""
    data, offsets = text_buffer(column)
    names: list[str] = []
    scores = [np.zeros(0)]
    for lo, hi in slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        letters = lettered(part, own)
        if not net.labels:
            names += ["und"] * len(letters)
            scores.append(np.where(letters, 0.0, 1.0))
            continue
        prob = document_probabilities(net, part, own)
        names += [net.labels[b] if ok else "und" for b, ok in zip(prob.argmax(axis=1).tolist(), letters.tolist())]
        scores.append(np.where(letters, prob.max(axis=1).clip(0, 1), 1.0))
    return names, np.concatenate(scores)


def predicted(net):
    def run(batches):
        for batch in batches:
            names, score = judged(net.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def kept(net, least: float):
    def run(batches):
        n = len(net.value.labels)
        for batch in batches:
            names, score = judged(net.value, batch.column("text"))
            named = np.array([name != "und" for name in names], dtype=bool)
            if n > 1:
                stays = named & (score >= 1 / n + least * (1 - 1 / n))
            else:
                stays = named if n else score < 1
            yield batch.filter(pa.array(stays))

    return run


def fit(documents: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Network:
    """Learns from at most ``sample`` training documents."""
    spread = F.xxhash64("doc_id")
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    room = F.greatest(F.lit(1), F.length(text) - DRAWN + 1)
    piece = F.substring(text, F.pmod(F.xxhash64(spread), room).cast("int") + 1, F.lit(DRAWN))
    taught = documents.where((fold("doc_id", HELD_OUT) != 0) & F.col(label).isNotNull())
    chosen = least_hashed(taught.select(spread.alias("h")), "h", sample)
    last = chosen.agg(F.max("h")).first()[0]
    rows = taught.where((spread <= (last if last is not None else 0)) & (F.length("text") > 0)).select(spread.alias("h"), piece.alias("text"), F.col(label).cast("string").alias("label")).orderBy("h", "label", "text").limit(sample).collect()
    return train([bytes(r.text) for r in rows], [r.label for r in rows])


def identify(documents: DataFrame, label: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    net = documents.sparkSession.sparkContext.broadcast(fit(documents, label))
    docs = documents.select(F.col("doc_id").cast("long"), (fold("doc_id", HELD_OUT) == 0).alias("held_out"), F.col("text").cast("string"))
    return docs.transform(mapped, predicted(net), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, label: str = "lang", least: float = REJECT) -> DataFrame:
    """The documents with letters whose best language stands out by ``least`` from an even guess; same columns.

    A null or empty text, or one without a letter, goes; if fewer than two languages are learned, other texts stay.
    """
    net = documents.sparkSession.sparkContext.broadcast(fit(documents, label))
    return documents.transform(mapped, kept(net, least), documents.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
