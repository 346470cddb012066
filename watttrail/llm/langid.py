"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole text (ASCII letters lowered) in both directions,
white space and all, and gives every byte a distribution over the languages. A document's
probabilities are the mean over its letter bytes: ASCII letters and all bytes of other characters.
A long text is read in windows of ``CORE`` bytes, in which the state starts ``CONTEXT`` bytes
before the window in its direction; each byte counts in one window, and all bytes count.

Training runs in numpy by backpropagation through time on the whole texts of at most ``DOCUMENTS``
labelled documents of each language, cut into pieces of the lengths ``PIECES`` in turn; half of the
pieces are joined in pairs at random, each byte with the label of its own piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watttrail.llm.memory import released

UNDETERMINED = "und"
HIDDEN = 8
CORE, CONTEXT = 448, 32
DOCUMENTS = 200
PIECES = (96, 24, 48, 12)
EPOCHS, BATCH, RATE = 2, 256, 0.02
#: Small samples are read more often, until this many steps are taken.
STEPS = 250
_WINDOWS_AT_ONCE = 512
#: Bytes that count: ASCII letters and every byte of another character.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])

_FINE, _REACH = 1024, 8
_POINTS = np.arange(2 * _REACH * _FINE) / _FINE - _REACH
_SIGMOID, _TANH = (1 / (1 + np.exp(-_POINTS))).astype(np.float32), np.tanh(_POINTS).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Batch:
    """Byte strings of much the same length as a matrix, longest first."""

    order: np.ndarray
    lengths: np.ndarray
    octets: np.ndarray
    mirror: np.ndarray  # column of the byte at the mirrored place of its string
    active: list[int]  # strings longer than t, for each t

    @staticmethod
    def of(words: list[bytes]) -> Batch:
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        steps = np.arange(int(lengths[0]))
        octets = np.zeros((len(words), len(steps)), np.uint8)
        octets[steps[None, :] < lengths[:, None]] = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        mirror = np.maximum(lengths[:, None] - 1 - steps[None, :], 0)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in steps]
        return Batch(order, lengths, octets, mirror, active)

    @property
    def mask(self) -> np.ndarray:
        return np.arange(self.octets.shape[1])[None, :] < self.lengths[:, None]


@dataclass
class Network:
    """Parameters by name: ``x``/``u`` input table and recurrent matrix of each direction, ``v``/``c`` output."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        p["v"] = rng.normal(0, hidden**-0.5, (2 * hidden, len(languages))).astype(np.float32)
        p["c"] = np.zeros(len(languages), np.float32)
        return Network(languages, p)

    @property
    def hidden(self) -> int:
        return len(self.p["uf"])

    def _run(self, octets: np.ndarray, active: list[int], d: str, tape: list | None) -> np.ndarray:
        """States of one direction, (strings, steps, hidden); ``tape`` gets what backpropagation needs."""
        h_size, u = self.hidden, self.p["u" + d]
        states = np.zeros((*octets.shape, h_size), np.float32)
        h = np.zeros((len(octets), h_size), np.float32)
        for t, n in enumerate(active):
            x, old = self.p["x" + d][octets[:n, t]], h[:n]
            a = old @ u
            gates = _sigmoid(x[:, : 2 * h_size] + a[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            new = np.tanh(x[:, 2 * h_size :] + r * a[:, 2 * h_size :])
            h = new + z * (old - new)
            states[:n, t] = h
            if tape is not None:
                tape.append((old, a[:, 2 * h_size :], z, r, new))
        return states

    def probabilities(self, batch: Batch, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distribution at every byte, (strings, steps, languages), and the joined states."""
        rows = np.arange(len(batch.lengths))[:, None]
        forward = self._run(batch.octets, batch.active, "f", tapes and tapes[0])
        backward = self._run(batch.octets[rows, batch.mirror], batch.active, "b", tapes and tapes[1])
        states = np.concatenate([forward, backward[rows, batch.mirror]], axis=2)
        logits = states @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=2, keepdims=True), states

    def posteriors(self, batch: Batch) -> np.ndarray:
        """As ``probabilities`` without the states, for long strings.

        Gates and candidates come from tables of the two functions at ``_FINE`` points a unit, so
        they are right to ``0.5 / _FINE``; the weights are scaled to give places in the tables.
        """
        n, steps = batch.octets.shape
        size, middle = self.hidden, np.float32(_REACH * _FINE + 0.5)
        logits = np.zeros((n, steps, len(self.languages)), np.float32)
        rows = np.arange(n)[:, None]
        for d, octets, v in (("f", batch.octets, self.p["v"][:size]), ("b", batch.octets[rows, batch.mirror], self.p["v"][size:])):
            x_table, u = (self.p["x" + d] * _FINE + middle).astype(np.float32), (self.p["u" + d] * _FINE).astype(np.float32)
            by_step, out = np.ascontiguousarray(octets.T), np.zeros((steps, n, len(self.languages)), np.float32)
            h = np.zeros((n, size), np.float32)
            for t, m in enumerate(batch.active):
                x, h = np.take(x_table, by_step[t, :m], axis=0), h[:m]
                a = h @ u
                gates = _SIGMOID.take((x[:, : 2 * size] + a[:, : 2 * size]).astype(np.int32), mode="clip")
                new = gates[:, size:] * a[:, 2 * size :]
                new += x[:, 2 * size :]
                new = _TANH.take(new.astype(np.int32), mode="clip")
                h = h - new
                h *= gates[:, :size]
                h += new
                np.matmul(h, v, out=out[t, :m])
            found = out.transpose(1, 0, 2)
            logits += found if d == "f" else found[rows, batch.mirror]
        logits += self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, batch: Batch, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes; ``labels`` are by string or byte, in the batch's order."""
        tapes: tuple[list, list] = ([], [])
        prob, states = self.probabilities(batch, tapes)
        mask = batch.mask
        wrong = prob
        wrong[np.arange(len(labels))[:, None], np.arange(prob.shape[1])[None, :], labels.reshape(len(labels), -1)] -= 1
        wrong *= mask[:, :, None] / mask.sum()
        g = {"v": np.einsum("bti,btk->ik", states * mask[:, :, None], wrong), "c": wrong.sum((0, 1))}
        d_states = wrong @ self.p["v"].T
        rows, h = np.arange(len(labels))[:, None], self.hidden
        mirrored = (d_states[:, :, h:] * mask[:, :, None])[rows, batch.mirror] * mask[:, :, None]
        for d, tape, octets, d_out in (
            ("f", tapes[0], batch.octets, d_states[:, :, :h]),
            ("b", tapes[1], batch.octets[rows, batch.mirror], mirrored),
        ):
            u = self.p["u" + d]
            gu, carried = np.zeros_like(u), np.zeros((len(labels), h), np.float32)
            seen, pushed = [], []
            for t in range(len(batch.active) - 1, -1, -1):
                n = batch.active[t]
                old, a_new, z, r, new = tape[t]
                dh = d_out[:n, t] + carried[:n]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (old - new) * z * (1 - z)
                d_r = d_new * a_new * r * (1 - r)
                da = np.concatenate([d_z, d_r, d_new * r], axis=1)
                gu += old.T @ da
                carried[:n] = dh * z + da @ u.T
                seen.append(octets[:n, t])
                pushed.append(np.concatenate([d_z, d_r, d_new], axis=1))
            at, dx = np.concatenate(seen), np.concatenate(pushed)
            hot = np.zeros((len(at), 256), np.float32)
            hot[np.arange(len(at)), at] = 1
            g["x" + d], g["u" + d] = hot.T @ dx, gu
        return g


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def octets_of(text: str | None) -> bytes:
    return (text or "").encode().lower()


def pieces(data: bytes) -> list[bytes]:
    """A training text cut into parts whose lengths take turns, so that short texts are learned too."""
    out, at, k = [], 0, 0
    while at < len(data):
        out.append(data[at : at + PIECES[k % len(PIECES)]])
        at, k = at + PIECES[k % len(PIECES)], k + 1
    return out


def fit(examples: list[tuple[bytes, str]], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Trains on ``(bytes, language)``; the same examples in the same order give the same network."""
    languages = sorted({lang for _, lang in examples})
    net = Network.start(languages, seed=seed)
    if len(languages) < 1:
        return net
    rng = np.random.default_rng(seed)
    cut = [(part, languages.index(lang)) for data, lang in examples for part in pieces(data)]
    # half of the pieces follow one another at random, so that changes of language are learned
    order = rng.permutation(len(cut))
    pairs = [([cut[i]], len(cut[i][0])) for i in order[: len(order) // 2]]
    rest = order[len(order) // 2 :]
    pairs += [([cut[i] for i in rest[k : k + 2]], sum(len(cut[i][0]) for i in rest[k : k + 2])) for k in range(0, len(rest), 2)]
    lengths = np.array([n for _, n in pairs])
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(pairs))))
    step, total = 0, epochs * -(-len(pairs) // BATCH)
    for _ in range(epochs):
        # near equal lengths share a batch, so few steps run half empty
        order = np.argsort(lengths + rng.random(len(pairs)), kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            chosen = batches[k]
            batch = Batch.of([b"".join(part for part, _ in pairs[i][0]) for i in chosen])
            labels = np.zeros(batch.octets.shape, np.int64)
            for row, o in enumerate(batch.order):
                parts = pairs[chosen[o]][0]
                labels[row, : batch.lengths[row]] = np.repeat([x for _, x in parts], [len(part) for part, _ in parts])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for name, grad in net.gradients(batch, labels).items():
                mean[name] += 0.1 * (grad - mean[name])
                square[name] += 0.01 * (grad * grad - square[name])
                fixed = np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8
                net.p[name] -= (rate * mean[name] / (1 - 0.9**step) / fixed).astype(np.float32)
    return net


def sample_examples(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """At most ``DOCUMENTS`` labelled texts of each language for ``fit``, chosen by hash of id and text."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    picked = rows.withColumn("rank", rank).where(F.col("rank") <= DOCUMENTS).select("lang", "rank", "text").collect()
    return [(octets_of(r.text), r.lang) for r in sorted(picked)]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fits the network to the labelled rows; rows with a null label or text are left out."""
    return fit(sample_examples(labelled, id_col, text_col, lang_col))


@dataclass
class Read:
    """What the network made of some texts."""

    probabilities: np.ndarray  # (texts, languages), zeros where nothing counts
    labels: list[np.ndarray]  # likeliest language of every byte


def read_texts(texts: list[str | None], net: Network) -> Read:
    """Runs the network over whole texts, their windows side by side."""
    data = [octets_of(t) for t in texts]
    sums = np.zeros((len(texts), len(net.languages)))
    labels = [np.zeros(len(d), np.uint8) for d in data]
    windows = [(k, at) for k, d in enumerate(data) for at in range(0, len(d), CORE)]
    cut = [(max(0, at - CONTEXT), min(len(data[k]), at + CORE + CONTEXT)) for k, at in windows]
    order = np.argsort([lo - hi for lo, hi in cut], kind="stable")
    for i in range(0, len(order), _WINDOWS_AT_ONCE):
        chosen = order[i : i + _WINDOWS_AT_ONCE]
        batch = Batch.of([data[windows[w][0]][slice(*cut[w])] for w in chosen])
        prob = net.posteriors(batch)
        best = prob.argmax(axis=2).astype(np.uint8)
        counted = prob * (_LETTER[batch.octets] & batch.mask)[:, :, None]
        for row, o in enumerate(batch.order):
            (k, at), (lo, _) = windows[chosen[o]], cut[chosen[o]]
            stop = min(at + CORE, len(data[k]))
            sums[k] += counted[row, at - lo : stop - lo].sum(axis=0, dtype=np.float64)
            labels[k][at:stop] = best[row, at - lo : stop - lo]
    totals = sums.sum(axis=1, keepdims=True)
    return Read(np.divide(sums, totals, out=sums, where=totals > 0), labels)


def document_probabilities(texts: list[str | None], net: Network) -> np.ndarray:
    """Mean distribution over the letter bytes of each text; zeros for a text without a letter."""
    found = read_texts(texts, net).probabilities
    found[[not has_letter(t or "") for t in texts]] = 0.0
    return found


def _chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters together."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_SPANS = "array<struct<start: bigint, length: bigint, lang: string>>"


def _runs(labels: list[np.ndarray], names: list[str]) -> pa.Array:
    """Runs of equal labels of each text as lists of structs."""
    starts = [np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64) for x in labels]
    lengths = [np.diff(np.append(s, len(x))) for s, x in zip(starts, labels, strict=True)]
    kinds = [x[s] for s, x in zip(starts, labels, strict=True)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in starts]))).astype(np.int32)
    flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (starts, lengths, kinds)]
    lang = pa.array(np.array([*names, UNDETERMINED], object)[flat[2].astype(np.int64)], pa.string())
    values = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), lang], ["start", "length", "lang"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def predict(df: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, ``lang_pred`` and ``score``: the likeliest
    language and its mean probability; with ``spans``, also the label of every position.

    ``spans`` are runs of bytes of the text in UTF-8 with one likeliest language, ``start`` and
    ``length`` each; a text without a letter is ``und`` throughout, a null or empty one has none.
    A null text, a text without a letter, or a network that learned no language gives ``und``
    with score 0. Ties go to the language first in the alphabet. Repeated rows get equal results;
    an empty table gives an empty result. Columns named like a result are replaced.
    """
    results = ["lang_pred", "score", *(["spans"] if spans else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c not in results]
    own = [] if text_col in kept else [text_col]
    rows = df.select(*kept, *own)
    at = rows.columns.index(text_col)
    kinds = {"lang_pred": "string", "score": "double", "spans": _SPANS}
    added = T.StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in results))
    schema = T.StructType([*df.select(*kept).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, UNDETERMINED], object)
        none = len(net.languages)
        with released():
            for batch in batches:
                every = batch.column(at).to_pylist()
                for part in _chunks(every):
                    texts = every[part]
                    silent = [not net.languages or not has_letter(t or "") for t in texts]
                    found = read_texts(texts, net) if net.languages else Read(np.zeros((len(texts), 1)), [np.zeros(len(octets_of(t)), np.uint8) for t in texts])
                    prob = found.probabilities
                    prob[silent] = 0.0
                    best, score = prob.argmax(axis=1), prob.max(axis=1, initial=0.0)
                    best[silent] = none
                    arrays = [*(c.slice(part.start, len(texts)) for c in batch.columns[: len(kept)]), pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))]
                    if spans:
                        arrays.append(_runs([np.full(len(x), none, np.uint8) if s else x for x, s in zip(found.labels, silent, strict=True)], net.languages))
                    yield pa.RecordBatch.from_arrays(arrays, [*kept, *results])

    return rows.mapInArrow(run, schema)


def label_spans(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``spans`` of every row, as ``predict`` gives them."""
    return predict(df, net, text_col, [id_col], spans=True).select(id_col, "spans")
