"""Language model scoring: a probabilistic suffix tree over words.

The state of a position is the longest retained context of up to ``DEPTH`` words before it. The
empty context is the add-one word distribution. A longer context ``s`` (its parent ``s'`` lacks
the oldest word) smooths its counts with its parent's distribution,

    P(w | s) = (c(sw) + a c(s) P(w | s')) / (c(s) (1 + a)),

and is retained if that beats the parent on its own occurrences by more than ``MARGIN`` nats, each
occurrence judged without itself: the divergence of ``s`` from ``s'``, estimated leave-one-out. The
strength ``a`` is the best of ``STRENGTHS`` under the same estimate. All contexts of one and two words
that occur twice are tested; a longer one if its parent is retained and the context without its
last word was tested, so that levels become small as contexts grow long.

Counting is distributed and exact over all training texts, up to collisions of hashes: 64 bits for
words, 40 bits for contexts within a bucket (of which there are more the more the words), 32 bits
for next words within a context:

1. Each split turns its texts into chunks: a local vocabulary and compressed word numbers.
2. For words, then contexts of length 1 to ``DEPTH``, each chunk sends each distinct pair of
   context and next word once, with its training count, to the bucket of the context. Contexts
   that hold over ``HOT`` of all words, fewer than ``1 / HOT``, are spread over all buckets.
3. A bucket adds the counts up, tests its contexts, and answers every chunk.

The formula holds for every next word of a context that occurs twice, so probabilities sum to 1.
A pair is left out of the exchange only where its count follows from the shorter pair's: that is 0,
or it is 1, the chunk has the one occurrence itself and no other chunk asked for the shorter pair.
Of contexts without a pair to send, the strength alone is asked for, unless the chunk sees that at
most one occurrence can have a repeated next word; such a context never passes the test. Only
counts of tokens and words and the strengths of hot contexts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from watttrail.session import stage

DEPTH = 2
STRENGTHS = np.array([1 / 64, 1 / 16, 1 / 4, 1.0, 4.0])
MARGIN = 2.0
HOT = 1 / 1000
CHUNK_BYTES = 4_000_000
BUCKET_TOKENS = 2_000_000
_END = b"\n"  # no word contains white space
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pack(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes: small numbers leave whole planes empty."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


#: Contexts are told apart by 40 bits beside their bucket.
_SHORT, _CONTEXT = np.uint64(24), "V5"


def _short(keys: np.ndarray) -> np.ndarray:
    octets = (keys >> _SHORT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return np.ascontiguousarray(octets).view(_CONTEXT)[:, 0]


def _coarse(p: np.ndarray) -> np.ndarray:
    """Probabilities to within 6 %, as a byte: enough for the test of a context."""
    return np.clip(np.rint(-6 * np.log2(p)), 0, 255).astype(np.uint8)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * _MIX + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), _END]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _told(total: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Answers to chunks that counted ``own``: 0 to that with the one occurrence if others asked too."""
    return np.where((total == 1) & (own == 1) & others, 0, total).astype("<u4")


def _heard(answered: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and where the counts of longer pairs are to be exchanged, from answers of ``_told``."""
    count = np.maximum(answered, own).astype(np.int64)
    return count, (count > 1) | ((count == 1) & ((own == 0) | (answered == 0)))


def _packed(key: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Sorted keys with their places in the low bits, which sort faster than places alone; None if they do not fit."""
    low = max(1, (len(key) - 1).bit_length())
    if not len(key) or int(key.max()).bit_length() + low > 63:
        return None
    return np.sort((key << low) | np.arange(len(key))), low


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys."""
    packed = _packed(key)
    return np.argsort(key, kind="stable") if packed is None else packed[0] & ((1 << packed[1]) - 1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct key, in the order of keys, and each place's number among them."""
    packed = _packed(key)
    if packed is None:
        return np.unique(key, return_index=True, return_inverse=True)[1:]
    place = packed[0] & ((1 << packed[1]) - 1)
    new = np.diff(packed[0] >> packed[1], prepend=-1) != 0
    number = np.empty(len(key), np.int64)
    number[place] = np.cumsum(new) - 1
    return place[new], number


_BASE = "chunk long, train_tokens long, ids array<{id}>, held array<boolean>, sizes binary, vocabulary binary, words binary"


def _chunks(df: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Rows of up to ``CHUNK_BYTES`` of text (or one longer text), as word numbers."""
    rows = df.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def chunk(number: int, ids: list, helds: list, sizes: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        vocabulary, words, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")  # frequent words get small numbers
        number_of = np.empty_like(order)
        number_of[order] = np.arange(len(order))
        vocabulary, words = vocabulary[order], number_of[words]
        counted = sum(n for n, h in zip(sizes, helds, strict=True) if not h)
        arrays = [
            pa.array([number]),
            pa.array([counted]),
            pa.array([ids], pa.list_(id_type)),
            pa.array([helds], pa.list_(pa.bool_())),
            *(pa.array([_pack(x)], pa.binary()) for x in (np.array(sizes, "<u4"), vocabulary, words.astype("<u4"))),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "train_tokens", "ids", "held", "sizes", "vocabulary", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, _Words()
        own: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for key, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens_of(text)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                for values, value in zip(own, (key, bool(out), len(words), hashes), strict=True):
                    values.append(value)
                size += len(text or "")
                if size >= CHUNK_BYTES:
                    yield chunk(number, *own)
                    number, own, size = number + 1, ([], [], [], []), 0
        if own[0]:
            yield chunk(number, *own)

    return rows.mapInArrow(run, _BASE.format(id=rows.schema["id"].dataType.simpleString()))


class Replay:
    """A chunk with what is known of it after some levels of answers."""

    def __init__(self, base: pa.Table):
        row = {c: base.column(c)[0].as_py() for c in ("chunk", "ids", "held", "sizes", "vocabulary", "words")}
        self.chunk, self.ids, self.held = row["chunk"], row["ids"], np.array(row["held"], bool)
        self.vocabulary = _unpack(row["vocabulary"], "<u8")
        self.sizes = _unpack(row["sizes"], "<u4").astype(np.int64)
        words = _unpack(row["words"], "<u4").astype(np.int64)
        # every document is preceded by an end, the context of its first word
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        end = int(np.flatnonzero(self.vocabulary == np.uint64(xxhash.xxh64_intdigest(_END)))[0])
        n = len(words) + len(self.sizes)
        self.leading = np.zeros(n, bool)
        self.leading[self.first] = True
        self.token = np.full(n, end, np.int64)
        self.token[~self.leading] = words
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        self.doc, self.train = doc, ~self.held[doc]
        self.place = np.arange(n) - self.first[doc]  # words before it, the leading end counted

    def words(self, answered: np.ndarray, tokens: int, distinct: int, hot_from: float) -> None:
        """Takes the training counts of the local vocabulary."""
        own = np.bincount(self.token[self.train & ~self.leading], minlength=len(self.vocabulary))
        total, sent = _heard(answered, own)
        self.known, self.sent = total[self.token], sent[self.token]
        self.base = (self.known + 1) / (tokens + distinct + 1)
        self.p = self.base.copy()
        self.context, self.count, self.local = self.vocabulary[self.token], self.known.copy(), self.token
        self.kept = np.ones(len(self.token), bool)  # positions whose context was retained so far
        self.hot_from = hot_from

    def pairs(self, level: int, buckets: int) -> bool:
        """Finds the distinct pairs of the next level; false if there are none."""
        i = np.flatnonzero((self.place > level - 1) & (self.kept if level > 2 else True))
        i = i[self.count[i - 1] >= 2]
        if not len(i):
            self.at = i
            return False
        # one sort of local numbers finds the pairs, a context's pairs side by side
        key = self.local[i - 1] * len(self.vocabulary) + self.token[i]
        one, pair = _distinct(key)
        own = np.bincount(pair, weights=self.train[i]).astype(np.int64)
        context, hashed = self.context[i[one] - 1], self.vocabulary[self.token[i[one]]]
        total, sent = self.count[i[one] - 1], self.sent[i[one]]
        hot = total >= self.hot_from
        home = (_mix(context, np.where(hot & sent, hashed, np.uint64(0))) % np.uint64(buckets)).astype(np.int64)
        # pairs to send come first, by bucket
        order = _order(home + np.where(sent, 0, buckets))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.at, self.pair, self.n_sent = i, place[pair], int(sent.sum())
        self.pair_home, self.pair_context, self.pair_word = home[order], context[order], hashed[order]
        self.pair_total, self.pair_p, self.pair_count = total[order], self.p[i[one[order]]], own[order]
        self._contexts(self.local[i[one] - 1][order], own[order], total[order], hot[order])
        return True

    def _contexts(self, local: np.ndarray, own: np.ndarray, total: np.ndarray, hot: np.ndarray) -> None:
        """Finds the contexts whose strength is to be asked for alone, by bucket."""
        self.owner = _distinct(local)[1]
        n, k = int(self.owner.max()) + 1, self.n_sent
        first = np.full(n, len(self.owner))
        np.minimum.at(first, self.owner, np.arange(len(self.owner)))
        # pairs left out have one occurrence at most
        single = np.bincount(self.owner[k:], weights=own[k:], minlength=n)
        ask = (first >= k) & ~hot[first] & (total[first] - single >= 2)
        alone = first[ask]
        self.alone = alone[np.argsort(self.pair_home[alone], kind="stable")]

    def requests(self) -> Iterator[tuple[int, list[bytes]]]:
        """Per bucket: contexts, pairs of each, totals of each; next words, counts, parent's probabilities."""
        for home, lo, hi, ctx, alone in self._homes():
            both = np.concatenate((ctx, alone))
            per = np.concatenate((np.diff(np.append(ctx, hi)), np.zeros(len(alone), np.int64)))
            blobs = [_short(self.pair_context[both]), per.astype("<u4"), self.pair_total[both].astype("<u4")]
            word = (self.pair_word[lo:hi] >> np.uint64(32)).astype("<u4")
            blobs += [word, self.pair_count[lo:hi].astype("<u4"), _coarse(self.pair_p[lo:hi])]
            yield home, [_pack(b) for b in blobs]

    def _homes(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Each bucket with its range of pairs, where their contexts start, and contexts asked for alone."""
        homes, context = self.pair_home[: self.n_sent], self.pair_context[: self.n_sent]
        new = (np.diff(context) != 0) | (np.diff(homes) != 0)
        starts = np.flatnonzero(np.concatenate(([True], new))) if self.n_sent else np.zeros(0, np.int64)
        lone = self.pair_home[self.alone]
        for home in np.union1d(homes, lone):
            lo, hi = np.searchsorted(homes, home), np.searchsorted(homes, home, "right")
            ctx = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
            alone = self.alone[np.searchsorted(lone, home) : np.searchsorted(lone, home, "right")]
            yield int(home), int(lo), int(hi), ctx, alone

    def take(self, answers: dict[int, tuple[np.ndarray, np.ndarray]], hot: dict[int, float]) -> None:
        """Takes pair counts and context strengths by bucket; moves on to contexts one word longer."""
        answered, each = self.pair_count.copy(), np.zeros(int(self.owner.max()) + 1)
        for home, lo, hi, ctx, alone in self._homes():
            totals, strengths = answers[home]
            answered[lo:hi] = totals
            each[self.owner[np.concatenate((ctx, alone))]] = strengths
        strength = each[self.owner]
        for k in np.flatnonzero(self.pair_total >= self.hot_from):
            strength[k] = hot.get(int(self.pair_context[k] >> _SHORT), 0.0)
        count, sent = _heard(answered, self.pair_count)
        sent[self.n_sent :] = False
        mixed = (count + strength * self.pair_total * self.pair_p) / (self.pair_total * (1 + strength))
        self.p[self.at] = np.where(strength > 0, mixed, self.pair_p)[self.pair]
        longer, counts = np.zeros_like(self.context), np.zeros_like(self.count)
        longer[self.at] = _mix(self.pair_context, self.pair_word)[self.pair]
        counts[self.at] = count[self.pair]
        self.local, self.sent = np.zeros_like(self.local), np.zeros_like(self.sent)
        self.local[self.at], self.sent[self.at] = self.pair, sent[self.pair]
        self.context, self.count = longer, counts
        kept = np.zeros(len(self.kept), bool)
        kept[self.at] = (strength > 0)[self.pair]
        self.kept = kept

    def result(self) -> list:
        real, docs = ~self.leading, len(self.sizes)
        doc = self.doc[real]
        known = np.bincount(doc, weights=self.known[real] > 0, minlength=docs).astype(np.int64)
        sums = [np.bincount(doc, weights=np.log10(x[real]), minlength=docs) for x in (self.base, self.p)]
        return [self.ids, self.held, self.sizes, known, *sums]


def gains(count: np.ndarray, total: np.ndarray, parent: np.ndarray, owner: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Leave-one-out gain in nats of each context under each strength from pairs that occur twice
    or more, and the occurrences these pairs cover."""
    twice = count >= 2
    c, n, p, own = count[twice][:, None], total[twice][:, None] - 1, parent[twice][:, None], owner[twice]
    each = c * np.log((c - 1 + STRENGTHS * n * p) / (n * (1 + STRENGTHS) * p))
    gain = np.stack([np.bincount(own, weights=each[:, k], minlength=contexts) for k in range(len(STRENGTHS))], axis=1)
    return gain, np.bincount(own, weights=c[:, 0], minlength=contexts)


def best_strength(gain: np.ndarray, covered: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Strength of each context, 0 where the test rejects it."""
    rest = np.maximum(total - covered, 0)[:, None] * np.log(STRENGTHS / (1 + STRENGTHS))
    whole = gain + rest
    return np.where(whole.max(axis=1) > MARGIN, STRENGTHS[whole.argmax(axis=1)], 0.0)


_REQUEST = "bucket long, chunk long, contexts binary, per binary, totals binary, words binary, counts binary, parents binary"
_ANSWER = "chunk long, bucket long, counts binary, strengths binary, hot long, gain array<double>, covered double, total double"


def _answer(requests: pa.Table, hot_from: float) -> pa.Table:
    """Adds the counts of one bucket up, tests its contexts and answers each chunk. Parts of hot
    contexts are reported in rows of their own (``hot`` set, ``chunk`` -1)."""
    rows = requests.to_pylist()
    parts = {c: [_unpack(r[c], k) for r in rows] for c, k in (("contexts", _CONTEXT), ("per", "<u4"), ("totals", "<u4"), ("words", "<u4"), ("counts", "<u4"), ("parents", "u1"))}
    per = np.concatenate(parts["per"])
    context = np.concatenate(parts["contexts"]).view(np.uint8).reshape(-1, 5)
    context = np.pad(context, ((0, 0), (0, 3))).view("<u8")[:, 0]
    keys, context_id = np.unique(context, return_inverse=True)
    total = np.zeros(len(keys))
    total[context_id] = np.concatenate(parts["totals"])
    owner = np.repeat(context_id, per)
    word = np.concatenate(parts["words"]).astype(np.uint64)
    pair = (owner.astype(np.uint64) << np.uint64(32)) | word
    _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
    counted = np.concatenate(parts["counts"])
    count = np.bincount(inverse, weights=counted)
    told = _told(count[inverse], counted, np.bincount(inverse, weights=counted == 0)[inverse] > 0)
    own = owner[first]
    gain, covered = gains(count, total[own], 2.0 ** (np.concatenate(parts["parents"])[first] / -6.0), own, len(keys))
    hot = total >= hot_from
    strength = np.where(hot, 0.0, best_strength(gain, covered, total)).astype("<f4")
    out: list[tuple] = []
    ends, c_ends = np.cumsum([len(x) for x in parts["words"]]), np.cumsum([len(x) for x in parts["contexts"]])
    for k, row in enumerate(rows):
        mine = told[ends[k] - len(parts["words"][k]) : ends[k]]
        ids = context_id[c_ends[k] - len(parts["contexts"][k]) : c_ends[k]]
        out.append((row["chunk"], row["bucket"], _pack(mine), _pack(strength[ids]), None, None, None, None))
    for k in np.flatnonzero(hot):
        out.append((-1, -1, None, None, int(keys[k]), gain[k].tolist(), float(covered[k]), float(total[k])))
    return _table(out, _ANSWER)


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [pa.field(*(lambda name, kind: (name, _TYPES[kind]))(*f.split(" "))) for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _count_words(base: DataFrame, buckets: int) -> DataFrame:
    """Training counts of each chunk's vocabulary, ``(chunk, bucket, counts, distinct)``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                replay = Replay(pa.Table.from_batches([batch.slice(k, 1)]))
                real = replay.train & ~replay.leading
                counts = np.bincount(replay.token[real], minlength=len(replay.vocabulary)).astype("<u4")
                home = replay.vocabulary % np.uint64(buckets)
                rows = [
                    (int(b), replay.chunk, _pack(replay.vocabulary[home == b]), _pack(counts[home == b]))
                    for b in np.unique(home)
                ]
                yield _table(rows, "bucket long, chunk long, keys binary, counts binary").to_batches()[0]

    def add(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        keys = [_unpack(r["keys"], "<u8") for r in rows]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counted = np.concatenate([_unpack(r["counts"], "<u4") for r in rows])
        total = np.bincount(inverse, weights=counted)
        told = _told(total[inverse], counted, np.bincount(inverse, weights=counted == 0)[inverse] > 0)
        ends = np.cumsum([len(k) for k in keys])
        found = int((total > 0).sum())
        out = [
            (r["chunk"], r["bucket"], _pack(told[e - len(k) : e]), found if i == 0 else 0)
            for i, (r, k, e) in enumerate(zip(rows, keys, ends, strict=True))
        ]
        return _table(out, "chunk long, bucket long, counts binary, distinct long")

    asked = base.mapInArrow(ask, "bucket long, chunk long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, counts binary, distinct long")


def score_texts(
    df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot_share: float = HOT
) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows where ``held_out`` is true teach nothing; null counts as false. A null text counts as
    empty: one token, the end. Scores are log10 probabilities. Repeated rows count each. An empty
    table gives an empty result; if all rows are held out every token is unknown.
    """
    base = stage(_chunks(df, id_col, text_col, F.coalesce(held_out, F.lit(False))), "chunks")
    id_type = base.schema["ids"].dataType.elementType.simpleString()
    tokens = base.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    all_tokens = max(1, tokens)
    buckets = -(-all_tokens // BUCKET_TOKENS) * 4
    words = stage(_count_words(base, buckets), "words")
    distinct = words.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    hot_from = max(2.0, hot_share * tokens)
    answers = words.select("chunk", F.lit(0).cast("long").alias("level"), "bucket", "counts", F.lit(None).cast("binary").alias("strengths"))
    hot: list[dict[int, float]] = []

    def replayed(left: pa.Table, right: pa.Table, level: int) -> tuple[Replay, bool]:
        """The chunk after the answers of all levels before ``level``."""
        replay = Replay(left)
        rows = right.to_pylist()
        total = np.zeros(len(replay.vocabulary))
        home = replay.vocabulary % np.uint64(buckets)
        for r in rows:
            if r["level"] == 0:
                total[home == r["bucket"]] = _unpack(r["counts"], "<u4")
        replay.words(total.astype(np.int64), tokens, distinct, hot_from)
        for k in range(1, level):
            if not replay.pairs(k, buckets):
                return replay, False
            got = {r["bucket"]: (_unpack(r["counts"], "<u4"), _unpack(r["strengths"], "<f4")) for r in rows if r["level"] == k}
            replay.take(got, hot[k - 1])
        return replay, True

    def asking(level: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            replay, more = replayed(left, right, level)
            more = more and replay.pairs(level, buckets)
            rows = [(b, replay.chunk, *blobs) for b, blobs in replay.requests()] if more else []
            return _table(rows, _REQUEST)

        return ask

    for level in range(1, depth + 1):
        asked = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(asking(level), _REQUEST)
        found = stage(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, hot_from), _ANSWER), f"level{level}")
        # at most 1 / HOT contexts
        parts = found.where("hot is not null").groupBy("hot").agg(
            *(F.sum(F.col("gain")[k]).alias(f"g{k}") for k in range(len(STRENGTHS))), F.sum("covered").alias("covered"), F.max("total").alias("total")
        )
        rows = parts.collect()
        gain = np.array([[r[f"g{k}"] for k in range(len(STRENGTHS))] for r in rows]).reshape(-1, len(STRENGTHS))
        strength = best_strength(gain, np.array([r.covered for r in rows]), np.array([r.total for r in rows])) if rows else []
        hot.append({r.hot: float(a) for r, a in zip(rows, strength, strict=True)})
        answered = found.where("hot is null").select("chunk", F.lit(level).cast("long").alias("level"), "bucket", "counts", "strengths")
        answers = answers.unionByName(answered)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    kinds = [to_arrow_type(base.schema["ids"].dataType.elementType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        replay, _ = replayed(left, right, depth + 1)
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(replay.result(), kinds, strict=True)], names)

    scored = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
