"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The score of a segmentation is the sum of its pieces' scores. A forward Viterbi pass gives the
best score of every prefix; backward A-star search from the end uses it as an exact heuristic, so
hypotheses leave the queue in the order of their full scores and the first ``n`` complete ones
are the ``n`` best.

No piece holds a space after another character, and none a line break, so a text's lattice falls
apart at those places into units, and within them wherever two neighbouring characters stand in
no piece side by side. Each distinct unit is searched once while it stays in a worker's bounded
cache. A text's N best segmentations combine its units': one that differs from the best
in a unit loses at least that unit's gap to its second best, so only the ``n - 1`` occurrences
with the smallest gaps can take part.

Characters without a piece are spelled in byte pieces. Decoding joins the pieces' bytes and
restores spaces; encoding and decoding a text gives it back exactly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Units a worker keeps, about 300 bytes each.
CACHE = 900_000
_UNIT = re.compile(r" +[^ \n]*|\n|[^ \n]+")

Segmentation = tuple[float, tuple[int, ...]]


class Lattice:
    """Pieces of a model, with search over the lattice of a string."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.octet = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.octet[value] = k
                self.bytes_of.append(bytes([value]))
                continue
            self.bytes_of.append(piece.replace(SPACE, " ").encode())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.scores[piece.replace(SPACE, " ")] = (model.get_score(k), k)
        if any(re.search(r"[^ ] |\n", p) for p in self.scores):
            raise ValueError("a piece crosses a space or a line break")
        # runs of spaces have scores far below all others
        self.unknown = min(s for p, (s, _) in self.scores.items() if p.strip()) - 10
        #: Neighbouring characters within some piece; between any others the lattice falls apart.
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        # a node maps a character to the next node and the piece that ends there
        self.trie: dict = {}
        for piece, (score, k) in self.scores.items():
            node, last = self.trie, None
            for c in piece:
                last = node.setdefault(c, [{}, None])
                node = last[0]
            last[1] = (score, (k,))

    def edges(self, text: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For every end, the pieces that end there (start, score, ids), and the best score up to it."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        ahead = [0.0] + [-np.inf] * n
        for start in range(n):
            base, node, single = ahead[start], self.trie, False
            for stop in range(start + 1, n + 1):
                step = node.get(text[stop - 1])
                if step is None:
                    break
                node, piece = step
                if piece is not None:
                    single = single or stop == start + 1
                    ends[stop].append((start, *piece))
                    if base + piece[0] > ahead[stop]:
                        ahead[stop] = base + piece[0]
            if not single:
                ends[start + 1].append((start, self.unknown, tuple(self.octet[b] for b in text[start].encode())))
                ahead[start + 1] = max(ahead[start + 1], base + self.unknown)
        return ends, ahead

    def best(self, text: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations (all, if fewer), best first; equal scores in a fixed order."""
        ends, ahead = self.edges(text)
        out: list[Segmentation] = []
        ticket = 0
        # of equal estimates the one nearest to the start goes first, so ties reach their end
        queue: list[tuple] = [(-ahead[-1], len(text), 0, 0.0, None)]
        while queue and len(out) < n:
            _, stop, _, behind, tail = heapq.heappop(queue)
            if not stop:
                ids: list[int] = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((behind, tuple(ids)))
                continue
            for start, score, ids_here in ends[stop]:
                total = behind + score
                ticket += 1
                heapq.heappush(queue, (-(total + ahead[start]), start, ticket, total, (ids_here, tail)))
        return out

    def cut(self, text: str) -> list[str]:
        """Parts that no piece crosses."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(text[start:i])
                start = i
        return [*out, text[start:]]

    def decode(self, ids: Iterator[int]) -> str:
        known = len(self.bytes_of)
        text = b"".join([self.bytes_of[i] for i in ids if i is not None and 0 <= i < known]).decode("utf-8", "replace")
        return text.removeprefix(" ")


class Units(dict):
    """Index of each unit into arrays of what its search for the two best found."""

    def __init__(self, lattice: Lattice, n: int):
        super().__init__()
        self.lattice, self.n = lattice, n
        self.ids: list[bytes] = []
        self.sound = bytearray()  # whether decoding gives the unit back
        self.score, self.gap = array("d"), array("d")
        self.whole: dict[str, list[float]] = {}  # losses of units with small gaps

    def __missing__(self, unit: str) -> int:
        parts = self.lattice.cut(unit)
        if len(parts) > 1:
            at = [self[p] for p in parts]
            ids, score = b"".join([self.ids[i] for i in at]), sum(self.score[i] for i in at)
            sound, gap = all(self.sound[i] for i in at), min(self.gap[i] for i in at)
        else:
            found = self.lattice.best(unit, min(2, self.n))
            score, best = found[0]
            ids, gap = array("I", best).tobytes(), score - found[1][0] if len(found) > 1 else np.inf
            sound = b"".join([self.lattice.bytes_of[i] for i in best]) == unit.encode()
        self.ids.append(ids)
        self.sound.append(sound)
        self.score.append(score)
        self.gap.append(gap)
        self[unit] = at = len(self.ids) - 1
        return at

    def losses(self, unit: str) -> list[float]:
        """What each of the ``n`` best segmentations of a unit loses against the best."""
        if unit not in self.whole:
            if len(self.whole) > CACHE // 10:
                self.whole.clear()
            out = [0.0]
            for part in self.lattice.cut(unit):
                found = self.lattice.best(part, self.n)
                out = sorted(x + found[0][0] - s for x in out for s, _ in found)[: self.n]
            self.whole[unit] = out
        return self.whole[unit]

    def ways(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a unit, each with its loss against the best."""
        out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for part in self.lattice.cut(unit):
            found = self.lattice.best(part, self.n)
            longer = ((x + found[0][0] - s, ids + more) for x, ids in out for s, more in found)
            out = sorted(longer, key=lambda way: way[0])[: self.n]
        return out

    def segmentations(self, text: str) -> list[list[int]]:
        """Ids of the ``n`` best segmentations of a text, in the order of the scores that ``text`` gives."""
        self.trim()
        parts = _UNIT.findall(" " + text)
        at = [self[p] for p in parts]
        gaps = np.array([self.gap[i] for i in at])
        out: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for k in np.argsort(gaps, kind="stable")[: self.n - 1].tolist():
            longer = ((x + loss, {**chosen, k: ids}) for x, chosen in out for loss, ids in self.ways(parts[k]))
            out = sorted(longer, key=lambda way: way[0])[: self.n]
        whole = [np.frombuffer(self.ids[i], "<u4").tolist() for i in at]
        return [[i for k, ids in enumerate(whole) for i in chosen.get(k, ids)] for _, chosen in out]

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self.ids, self.sound, self.score, self.gap = [], bytearray(), array("d"), array("d")

    def text(self, text: str) -> tuple[bytes, list[float], bool]:
        """Ids of the best segmentation, the ``n`` best scores, whether decoding gives the text back."""
        self.trim()
        parts = _UNIT.findall(" " + text)
        at = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        best = float(np.frombuffer(self.score)[at].sum())
        gaps = np.frombuffer(self.gap)[at]
        k = self.n - 1
        few = np.argsort(gaps, kind="stable")[:k] if len(gaps) <= 64 else np.argpartition(gaps, k)[:k]
        losses = [0.0]
        for k in few:
            losses = sorted(x + y for x in losses for y in self.losses(parts[k]))[: self.n]
        sound = bool(np.frombuffer(self.sound, np.uint8)[at].all())
        return b"".join([self.ids[i] for i in at.tolist()]), [best - x for x in losses], sound


_units: dict[tuple[str, int], Units] = {}


def units(path: str, n: int) -> Units:
    """The process's searched units for a model, kept while the worker lives."""
    if (path, n) not in _units:
        _units[path, n] = Units(Lattice(path), n)
    return _units[path, n]


def encode_texts(df: DataFrame, model: str, n: int = 4, text_col: str = "text", keep: list[str] | None = None, segmentations: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all), ``piece_ids`` (best segmentation), ``nbest_scores`` (best
    first, at most ``n``) and ``round_trip``; with ``segmentations``, also ``nbest_ids``, the ids
    of the segmentation of each of these scores.

    ``model`` is a model file that every worker can read. A null or empty text is a single space,
    which the model puts before every text. Repeated rows get equal results; an empty table gives
    an empty result. Columns named like a result are replaced.
    """
    results = ("piece_ids", "nbest_scores", "round_trip", *(("nbest_ids",) if segmentations else ()))
    kept = [c for c in (df.columns if keep is None else keep) if c not in results]
    rows = df.select(*kept, *([] if text_col in kept else [text_col]))
    at = rows.columns.index(text_col)
    ids_kind = T.ArrayType(T.LongType())
    kinds = (ids_kind, T.ArrayType(T.DoubleType()), T.BooleanType(), *((T.ArrayType(ids_kind),) if segmentations else ()))
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(n, k) for n, k in zip(results, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(model, n)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [known.text(t or "") for t in part.column(at).to_pylist()]
                ids = [np.frombuffer(g[0], "<u4") for g in got]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int64)))
                arrays = [lists, pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array([g[2] for g in got])]
                if segmentations:
                    arrays.append(pa.array([known.segmentations(t or "") for t in part.column(at).to_pylist()], pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], [*kept, *results])

    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of a column of piece ids; null stays null.

    A null id or one that the model does not have stands for nothing, and bytes that make no
    character become U+FFFD. The space before every text goes, where it is there.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    kept = [c for c in df.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = units(model, 1).lattice
        for batch in batches:
            ids = batch.column(kept.index(ids_col)).to_pylist()
            texts = pa.array([None if x is None else lattice.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, out_col])

    return df.select(*kept).mapInArrow(run, schema)
