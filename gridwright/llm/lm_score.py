"""Language-model scores by a hashed, class-factored maximum-entropy model."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import discard, pieces, stored, written

#: Words that workers look up by themselves, at least, and of these the words of the softmax: CLASSES
#: of MEMBERS each. Other words are in one of RARE classes, by their ending. The three hold up to
#: VOCABULARY distinct words; beyond, each grows with the fourth root, so the softmax with the root.
LOOKED_UP = 131_072
CLASSES = 32
MEMBERS = 64
RARE = 16
VOCABULARY = 1 << 20
#: Rows of hashed feature weights, up to TOKENS of training and growing with their root beyond; tokens
#: of a trainer for each of these rows, so what trainers send stays in proportion to the tokens; tokens
#: of a gradient step and of a scoring one; learning rate; bound of a weight; rows of a block of the
#: model on its way to the mean.
ROWS = 1 << 14
TOKENS = 1 << 24
TOKENS_PER_ROW = 128
STEP = 4096
SCORE_STEP = 2048
RATE = 0.5
BOUND = 20.0
BLOCK = 16
#: Bytes of texts that are read at once.
HEAP = 1 << 22

END = b"\n"
_FLUSH = 300_000
_FLUSH_BYTES = 1 << 25
_START = -(1 << 62)
_ONES = np.ones(STEP, np.float32)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def tokens_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, and the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts``, as ``tokens_of`` gives them but for the ends, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, of_text = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end splits off an empty word
    return words.filter(real).cast(pa.binary()), np.bincount(of_text[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def heaps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``HEAP`` bytes of the texts in ``column``, or of one longer text and what is beside it."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(sizes // HEAP)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                yield batch.slice(a, b - a)


def shape_of(size: int) -> tuple[int, int, int]:
    """(classes, members of each, rare classes) over ``size`` distinct words."""
    grown = max(1.0, (size / VOCABULARY) ** 0.25)
    return tuple(math.ceil(x * grown) for x in (CLASSES, MEMBERS, RARE))


def rows_of(n: int) -> int:
    """Rows of each of the two weights over ``n`` training tokens, a power of two."""
    return ROWS << max(0, math.ceil(0.5 * math.log2(max(n, 1) / TOKENS)))


def rare_class(word: bytes, classes: int = CLASSES, rare: int = RARE) -> int:
    return classes + xxhash.xxh32_intdigest(word[-2:]) % rare


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all of ``texts`` (text), each task adding up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def flushed() -> pa.RecordBatch:
            sums = pa.Table.from_batches(seen).group_by("word", use_threads=False).aggregate([("n", "sum")])
            seen.clear()
            return pa.RecordBatch.from_arrays([sums.column(k).combine_chunks() for k in ("word", "n_sum")], ["word", "n"])

        for part in heaps(batches, 0):
            ends = [pa.array([END], pa.binary()), pa.array([part.num_rows], pa.int64())]
            seen += [pa.RecordBatch.from_arrays(x, ["word", "n"]) for x in (words_of(part.column(0))[0].value_counts().flatten(), ends)]
            if sum(x.num_rows for x in seen) > _FLUSH or sum(x.nbytes for x in seen) > _FLUSH_BYTES:
                yield flushed()
        if seen:
            yield flushed()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The looked-up words with their counts, and what the rest of the corpus adds up to."""

    n: int
    size: int
    places: dict[bytes, int] = field(repr=False)
    counts: np.ndarray = field(repr=False)
    rare_n: np.ndarray = field(repr=False)
    rare_size: np.ndarray = field(repr=False)

    def __post_init__(self) -> None:
        words = list(self.places)
        self.n_classes, self.members, self.rare = shape_of(self.size)
        self.in_softmax = min(len(words), self.n_classes * self.members)
        ids = np.arange(len(words), dtype=np.int64)
        self.classes = np.where(ids < self.in_softmax, ids % self.n_classes, 0)
        self.classes[self.in_softmax :] = [rare_class(w, self.n_classes, self.rare) for w in words[self.in_softmax :]]
        self.log_rare = np.log10(self.rare_n + 0.5 * (self.rare_size + 1))
        self.log_base = math.log10(self.n + 0.5 * (self.size + 1))


def learn_vocabulary(counts: DataFrame, looked_up: int | None = None) -> Vocabulary:
    """The ``looked_up`` most frequent words of ``counts`` (at least the softmax), ties by word, and the totals by rare class."""
    ending = F.expr("substring(word, greatest(length(word) - 1, 1), 2)").alias("ending")
    endings = [(bytes(r.ending), r.n, r["size"]) for r in counts.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("size")).collect()]
    n, size = sum(x[1] for x in endings), sum(x[2] for x in endings)
    classes, members, rare = shape_of(size)
    top = most_frequent(counts, looked_up or max(LOOKED_UP, classes * members))
    places = {word: k for k, (word, _) in enumerate(top)}
    rare_n, rare_size = np.zeros(rare), np.zeros(rare)
    for word, c, k in itertools.chain(endings, ((word, -c, -1) for word, c in top[: classes * members])):
        at = rare_class(word, classes, rare) - classes
        rare_n[at] += c
        rare_size[at] += k
    return Vocabulary(n, size, places, np.array([c for _, c in top], np.int64), rare_n, rare_size)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The first ``most`` (word, n) of ``counts`` by n, then by word; only words of the last n are ranked by Spark."""
    left, least = most, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        least = r.n
        if r.words >= left:
            break
        left -= r.words
    rows = counts.where(F.col("n") > least).select("word", "n").collect() + counts.where(F.col("n") == least).select("word", "n").orderBy("word").limit(left).collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    """Class weights by feature row, member weights by feature row, and the biases of both."""

    of_class: np.ndarray
    of_member: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray
    odds: bool = False

    def as_odds(self) -> Model:
        """The model with its exponentials, whose products are odds as sums of weights are their logarithms: three of at most exp(``BOUND``) and a chance fit single precision."""
        return self if self.odds else Model(*map(np.exp, (self.of_class, self.of_member, self.class_bias, self.member_bias)), odds=True)


def unigram_model(v: Vocabulary, rows: int | None = None) -> Model:
    """The model without features: biases are log relative frequencies."""
    rows, width = rows or rows_of(v.n), v.n_classes + v.rare
    mass = np.zeros(width)
    members = np.full((v.n_classes, v.members), -1e9, np.float32)
    for k in range(v.in_softmax):
        mass[v.classes[k]] += v.counts[k]
        members[v.classes[k], k // v.n_classes] = math.log(v.counts[k])
    members[(members < -1e8).all(axis=1)] = 0
    members -= np.log(np.exp(members).sum(axis=1, keepdims=True))
    mass[v.n_classes :] = v.rare_n + 0.5 * (v.rare_size + 1)
    mass = np.maximum(mass, 0.5)
    return Model(np.zeros((rows, width), np.float32), np.zeros((rows, v.members), np.float32), np.log(mass / mass.sum()).astype(np.float32), members)


class Places(dict):
    """Places of looked-up words; other words go below 0 by a hash of the word and its rare class. All fit in 32 bits."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__(v.places)
        self.v, self.width = v, v.n_classes + v.rare
        self.span = (2**31 - 1) // self.width - 1
        self.kinds: dict[bytes, int] = {}

    def below(self, words: Sequence[bytes]) -> np.ndarray:
        """Places of ``words`` that aren't looked up."""
        ends = [w[-2:] for w in words]
        self.kinds.update((end, rare_class(end, self.v.n_classes, self.v.rare)) for end in set(ends) - self.kinds.keys())
        hashes, kinds = (np.fromiter(map(f, x), np.int64, len(words)) for f, x in ((xxhash.xxh32_intdigest, words), (self.kinds.__getitem__, ends)))
        return (-1 - hashes % self.span * self.width - kinds).astype(np.int32)

    def __missing__(self, word: bytes) -> int:
        return int(self.below([word])[0])


class Reader:
    """Turns texts into arrays: class, member and history features of every token."""

    def __init__(self, v: Vocabulary, rows: int | None = None) -> None:
        self.v, self.mask = v, np.uint64((rows or rows_of(v.n)) - 1)
        self.places, self.looked_up = Places(v), pa.array(list(v.places), pa.binary())

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The words' ``Places``."""
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))

    def read(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(number of tokens, ``ids`` of the tokens as bytes, how often each word stands that isn't looked up) of each text."""
        words, sizes = words_of(texts)
        found = pc.index_in(words, value_set=self.looked_up)
        own = pc.fill_null(found, 0).to_numpy().astype(np.int32)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        apart = words.take(pa.array(missing)).dictionary_encode()
        codes, of_text = apart.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)[missing]
        kinds, end = apart.dictionary.to_numpy(zero_copy_only=False), self.places[END]
        own[missing] = self.places.below(kinds)[codes]
        after = np.cumsum(sizes + 1)
        ids = np.empty(len(own) + len(sizes), np.int32)
        ends = np.zeros(len(ids), bool)
        ends[after - 1] = True
        ids[~ends], ids[ends] = own, end
        width = len(kinds) + 1
        if end < 0:
            codes, of_text = (np.concatenate(x) for x in ((codes, np.full(len(sizes), len(kinds))), (of_text, np.arange(len(sizes)))))
        each, times = np.unique(of_text * width + codes, return_counts=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(each // width, minlength=len(sizes)))])
        named = pa.concat_arrays([apart.dictionary, pa.array([END], pa.binary())]).take(pa.array(each % width))
        offsets = pa.array(np.concatenate([[0], 4 * after]), pa.int32()).buffers()[1]
        return (
            pa.array(sizes + 1, pa.int64()),
            pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(ids)]),
            pa.MapArray.from_arrays(pa.array(starts, pa.int32()), named, pa.array(times, pa.int32())),
        )

    def arrays(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, features of the classes (3), features of the members (2)) over texts.

        Histories are the word before (n-gram), the one before that alone (skip) and, for classes, both.
        """
        sizes = np.array([len(x) for x in ids])
        joined = np.concatenate(ids).astype(np.int64)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(joined)) - start
        one = np.where(at >= 1, np.roll(joined, 1), _START).astype(np.uint64)
        two = np.where(at >= 2, np.roll(joined, 2), _START - 1).astype(np.uint64)
        a, b = one * _A, two * _B
        a, b = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(31))
        both = (a * _C + b) * _D
        own = np.where((joined >= 0) & (joined < self.v.in_softmax), self.v.classes[np.maximum(joined, 0)], 0).astype(np.uint64) if len(self.v.classes) else np.zeros(len(joined), np.uint64)
        for_class = np.stack([(x * _D >> np.uint64(40)) & self.mask for x in (a, b * _C, both ^ (both >> np.uint64(29)))])
        for_member = np.stack([((x + (own + np.uint64(1)) * _C) * _D >> np.uint64(40)) & self.mask for x in (a, b * _C)])
        return joined, for_class.astype(np.int64), for_member.astype(np.int64)

    def class_of(self, joined: np.ndarray) -> np.ndarray:
        rare = (-1 - joined) % (self.v.n_classes + self.v.rare)
        if not len(self.v.classes):
            return rare
        return np.where(joined >= 0, self.v.classes[np.maximum(joined, 0)], rare)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ _ONES[: x.shape[1]]


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place. Biases are log chances and weights stay within ``BOUND``, so nothing overflows."""
    np.exp(logits, out=logits)
    logits *= (1 / _sums(logits))[:, None]
    return logits


def _take(rows: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows at ``at``, in the first rows of ``out`` if given."""
    return rows.take(at, axis=0, mode="clip", out=None if out is None else out[: len(at)])


def _totals(slope: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``slope`` in ``order``, longest first, all of them side by side while many are left: most are short."""
    out, left, k = _take(slope, order[starts]), np.count_nonzero(sizes > 1), 1
    while left > 64:
        out[:left] += _take(slope, order[starts[:left] + k], spare)
        k += 1
        left = np.count_nonzero(sizes[:left] > k)
    for j in range(left):
        out[j] += _ONES[: sizes[j] - k] @ _take(slope, order[starts[j] + k : starts[j] + sizes[j]], spare)
    return out


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """Places of ``keys`` (from 0, below ``most``) in their order; by radix where 16 bits hold them."""
    return np.argsort(keys.astype(np.uint16), kind="stable") if most <= 1 << 16 else np.argsort(keys)


def _descend(weights: np.ndarray, spent: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray, spare: np.ndarray) -> None:
    """One step of each row of ``weights`` that ``rows`` names, at the row's own rate."""
    order = _order(rows, len(weights))
    rows = rows[order]
    starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(rows)))
    longest = _order(len(rows) - sizes, len(rows))
    starts, sizes = starts[longest], sizes[longest]
    sums = _totals(slope, order, starts, sizes, spare)
    at = rows[starts]
    grown = spent[at] + np.einsum("ij,ij->i", sums, sums)
    spent[at] = grown
    seen[at] += sizes
    sums *= (RATE / np.sqrt(grown + 1.0))[:, None]
    own = _take(weights, at, spare)
    own -= sums
    if own.max() > BOUND or own.min() < -BOUND:
        np.clip(own, -BOUND, BOUND, out=own)
    weights[at] = own


def train_pass(batches: Iterator[list[np.ndarray]], reader: Reader, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps over all ``batches``, in place; how often each row of the two weights was seen."""
    rows = len(model.of_class)
    spent = [np.zeros(rows, np.float32), np.zeros(rows, np.float32)]
    seen = [np.zeros(rows, np.float32), np.zeros(rows, np.float32)]
    held, spare = ([np.empty((STEP, x.shape[1]), np.float32) for x in (model.of_class, model.of_member)] for _ in range(2))
    n_softmax = reader.v.in_softmax
    for ids in batches:
        joined, for_class, for_member = reader.arrays(ids)
        classes = reader.class_of(joined)
        for a in range(0, len(joined), STEP):
            b = min(a + STEP, len(joined))
            gram, skip, both, target = *for_class[:, a:b], classes[a:b]
            logits = _take(model.of_class, gram, held[0])
            logits += _take(model.of_class, skip, spare[0])
            logits += _take(model.of_class, both, spare[0])
            logits += model.class_bias
            p = _softmax(logits)
            p[np.arange(b - a), target] -= 1
            for own in (gram, skip, both):
                _descend(model.of_class, spent[0], seen[0], own, p, spare[0])
            inside = np.flatnonzero((joined[a:b] >= 0) & (joined[a:b] < n_softmax))
            if len(inside):
                gram, skip, word = *for_member[:, a:b][:, inside], joined[a:b][inside]
                logits = _take(model.of_member, gram, held[1])
                logits += _take(model.of_member, skip, spare[1])
                logits += _take(model.member_bias, classes[a:b][inside], spare[1])
                p = _softmax(logits)
                p[np.arange(len(inside)), word // reader.v.n_classes] -= 1
                for own in (gram, skip):
                    _descend(model.of_member, spent[1], seen[1], own, p, spare[1])
    return seen[0], seen[1]


def read_ids(docs: DataFrame, v: Vocabulary, rows: int) -> DataFrame:
    """(doc_id, learned_from, n_tokens, ids, missing, shard, turn) of ``docs`` (doc_id, text, learned_from).

    ``ids`` are those of ``Reader``, ``missing`` how often each word stands that isn't looked up. Texts are dealt by a
    hash to shards of about ``TOKENS_PER_ROW`` training tokens for each row of weights.
    """
    words = docs.sparkSession.sparkContext.broadcast(v)
    shards = max(1, -(-v.n // (TOKENS_PER_ROW * rows)))
    names = ["doc_id", "learned_from", "n_tokens", "ids", "missing", "shard", "turn"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words.value, rows)
        for part in heaps(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *reader.read(part.column(1)), part.column(3), part.column(4)], names)

    turn = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", "learned_from", F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn"))
    return dealt.mapInArrow(read, "doc_id long, learned_from boolean, n_tokens long, ids binary, missing map<binary,int>, shard int, turn long")


def train(read: DataFrame, v: Vocabulary, rounds: int = 1, rows: int | None = None) -> Model:
    """``rounds`` of distributed gradient descent over all of ``read`` (ids, shard, turn).

    Each trainer takes the round's model, descends over a shard of the texts, in the order of their
    turns, and gives back its weights in half precision; a row's mean goes by how often each trainer
    has seen it. Shards don't depend on the cluster, so neither do scores. What each trainer sends is
    the model's size; only the mean reaches the driver.
    """
    spark = read.sparkSession
    rows = rows or rows_of(v.n)
    words = spark.sparkContext.broadcast(v)
    model = unigram_model(v, rows)
    shards = max(1, -(-v.n // (TOKENS_PER_ROW * rows)))
    trainers = read.select("shard", "turn", "ids").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "turn")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def descend(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def texts() -> Iterator[tuple[int, np.ndarray]]:
                for part in pieces(batches):
                    for shard, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                        yield shard, np.frombuffer(ids, np.int32)

            def steps(group: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[np.ndarray]]:
                held, n = [], 0
                for _, ids in group:
                    held.append(ids)
                    n += len(ids)
                    if n >= 16 * STEP:
                        yield held
                        held, n = [], 0
                if held:
                    yield held

            reader = Reader(words.value, rows)
            for shard, group in itertools.groupby(texts(), key=lambda x: x[0]):
                own = sent.value
                own = Model(own.of_class.copy(), own.of_member.copy(), own.class_bias, own.member_bias)
                seen = train_pass(steps(group), reader, own)
                for kind, (weights, counts) in enumerate(zip((own.of_class, own.of_member), seen, strict=True)):
                    at = np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1))
                    for some in np.array_split(at, max(1, len(at) // 128)):
                        payload = [weights[k * BLOCK : (k + 1) * BLOCK].astype(np.float16).tobytes() for k in some]
                        tally = [counts[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in some]
                        made = [pa.array([x] * len(some), pa.int32()) for x in (shard, kind)] + [pa.array(some, pa.int32()), pa.array(payload, pa.binary()), pa.array(tally, pa.binary())]
                        yield pa.RecordBatch.from_arrays(made, ["shard", "kind", "block", "weights", "seen"])

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("shard")
            tally = np.stack([np.frombuffer(x, np.float32) for x in frame["seen"]])
            weights = np.stack([np.frombuffer(x, np.float16).astype(np.float32).reshape(BLOCK, -1) for x in frame["weights"]])
            total = (weights * tally[:, :, None]).sum(axis=0) / np.maximum(tally.sum(axis=0), 1)[:, None]
            return pd.DataFrame({"kind": frame["kind"].iloc[:1], "block": frame["block"].iloc[:1], "weights": [total.astype(np.float32).tobytes()]})

        means = trainers.mapInArrow(descend, "shard int, kind int, block int, weights binary, seen binary").groupBy("kind", "block").applyInPandas(mean, "kind int, block int, weights binary")
        fresh = [model.of_class.copy(), model.of_member.copy()]
        for row in means.toLocalIterator():
            block = np.frombuffer(row.weights, np.float32).reshape(BLOCK, -1)
            fresh[row.kind][row.block * BLOCK : (row.block + 1) * BLOCK] = block
        model = Model(fresh[0], fresh[1], model.class_bias, model.member_bias)
    return model


class Scorer:
    """log10 probabilities of texts, but for the counts of words that aren't looked up."""

    def __init__(self, v: Vocabulary, model: Model) -> None:
        self.v, self.model, self.reader = v, model.as_odds(), Reader(v, len(model.of_class))
        self.log_counts = np.log10(v.counts + 0.5)

    def of(self, texts: list[str | None]) -> list[tuple[int, int, float, float, list[bytes]]]:
        """(tokens, known, base, score, words whose count is still to come) of each text.

        Each word to come adds log10(its count + 0.5) to both scores, and 1 to known if counted.
        """
        words = [tokens_of(t) for t in texts]
        ids = [self.reader.ids(w) for w in words]
        return [(len(w), known, base, score, [w[j] for j in np.flatnonzero(x < 0)]) for w, x, (known, base, score) in zip(words, ids, self.of_ids(ids), strict=True)]

    def of_ids(self, ids: list[np.ndarray]) -> list[tuple[int, float, float]]:
        """(known, base, score) of each text's ids."""
        joined, for_class, for_member = self.reader.arrays(ids)
        v, m = self.v, self.model
        score = np.zeros(len(joined))
        classes = self.reader.class_of(joined)
        held, spare = ([np.empty((min(SCORE_STEP, len(joined)), x.shape[1]), np.float32) for x in (m.of_class, m.of_member)] for _ in range(2))
        for a in range(0, len(joined), SCORE_STEP):
            b = min(a + SCORE_STEP, len(joined))
            odds = _take(m.of_class, for_class[0, a:b], held[0])
            odds *= _take(m.of_class, for_class[1, a:b], spare[0])
            odds *= _take(m.of_class, for_class[2, a:b], spare[0])
            odds *= m.class_bias
            score[a:b] = np.log(odds[np.arange(b - a), classes[a:b]]) - np.log(_sums(odds))
            inside = np.flatnonzero((joined[a:b] >= 0) & (joined[a:b] < v.in_softmax))
            if len(inside):
                odds = _take(m.of_member, for_member[0, a:b][inside], held[1])
                odds *= _take(m.of_member, for_member[1, a:b][inside], spare[1])
                odds *= _take(m.member_bias, classes[a:b][inside], spare[1])
                score[a + inside] += np.log(odds[np.arange(len(inside)), joined[a:b][inside] // v.n_classes]) - np.log(_sums(odds))
        score /= math.log(10)
        looked = joined >= 0
        if len(v.counts):
            log_c = np.where(looked, self.log_counts[np.maximum(joined, 0)], 0.0)
        else:
            log_c = np.zeros(len(joined))
        rare = (joined < 0) | (joined >= v.in_softmax)
        score += np.where(rare, log_c - v.log_rare[np.where(rare, classes - v.n_classes, 0)], 0.0)
        base = log_c - v.log_base
        ends = np.cumsum([len(x) for x in ids])
        starts = ends - [len(x) for x in ids]
        return [(int(looked[a:b].sum()), float(base[a:b].sum()), float(score[a:b].sum())) for a, b in zip(starts, ends, strict=True)]


def score_texts(docs: DataFrame, is_training: Column, rounds: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, learned_from, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the whole texts of the rows where ``is_training`` is true: word counts over all of
    them, and a maximum-entropy model P(class | history) P(word | class, history) over hashed n-gram
    and skip features by gradient steps over all of their tokens. Words out of the softmax come by
    their class and their smoothed count there. Counts of words that workers don't look up join by
    word, so counts are exact for any vocabulary. Scores are log10 probabilities of the words and an end.

    Null and empty texts are just an end; texts of any length are read whole. Equal counts go by the
    word's bytes. Without training rows words have the smoothing's chance alone. Repeated rows are
    scored each. Other columns aren't looked at, whatever their names. An empty table gives an empty
    result.
    """
    docs = docs.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("learned_from"))
    counts = written(count_words(docs.where("learned_from")), "lm-counts")
    v = learn_vocabulary(counts)
    rows = rows_of(v.n)
    unread = read_ids(docs, v, rows).withColumn("row", F.monotonically_increasing_id())
    path = stored(unread, "lm-ids")
    read = docs.sparkSession.read.schema(unread.schema).parquet(path)
    model = train(read.where("learned_from"), v, rounds, rows) if v.n else unigram_model(v, rows)
    words, learned = (docs.sparkSession.sparkContext.broadcast(x) for x in (v, model.as_odds()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words.value, learned.value)
        for part in pieces(batches, 64):
            known, base, score = zip(*scorer.of_ids([np.frombuffer(x, np.int32) for x in part.column(3).to_pylist()]), strict=True)
            made = [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *made, part.column(4)], ["doc_id", "learned_from", "n_tokens", "known", "base", "model", "row"])

    partial = written(
        read.select("doc_id", "learned_from", "n_tokens", "ids", "row").mapInArrow(label, "doc_id long, learned_from boolean, n_tokens long, known long, base double, model double, row long"),
        "lm-partial",
    )
    wanted = read.select("row", F.explode("missing").alias("word", "times"))
    looked = written(
        wanted.join(counts.select(F.col("word").alias("w"), "n"), F.col("word") == F.col("w"), "left")
        .groupBy(F.col("row").alias("r"))
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"),
        ),
        "lm-looked",
    )
    discard(docs.sparkSession, path)
    more = F.coalesce("more", F.lit(0.0))
    return partial.join(looked, F.col("row") == F.col("r"), "left").select(
        "doc_id",
        "learned_from",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
