"""Exact n-gram Jaccard self-join by a token-group matrix over candidate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import bounded_broadcast, broadcast_up_to, components, pieces, whole, written

#: Documents that share a group's token union, members that are opened together, and documents of a
#: batch of small groups.
GROUP = 32
CHUNK = 2048
BATCH = 4000
#: Numbers of sets from which a shingle counts as more common, up to DOCS documents; beyond, all but
#: the least grow with them. The largest bitmap of one step; parts that the sets of a key of the last
#: step are dealt to.
LEVELS = (2, 8, 64)
DOCS = 1 << 21
MAX_BITS = 30
SALTS = 64

_FLUSH = 2_000_000
_LAST = 65_535
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct hashes of the word shingles of a text (A-Z lower-cased)."""

    def __init__(self, words: int) -> None:
        self.n = words

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        span = min(self.n, len(words))
        out = np.full(len(words) - span + 1, span, np.uint64)
        for j in range(span):
            out = (out ^ h[j : j + len(out)]) * _A
            out ^= out >> np.uint64(31)
        return np.unique(_mix(out * _B))


class Commonness:
    """How many texts' sets hold a shingle, by steps, from bitmaps over hash prefixes.

    A shingle that several sets hold is never taken for a rarer one; some are taken for more common.
    Level 0 is only for shingles of one set, which can't link anything.
    """

    def __init__(self, bitmaps: list[np.ndarray]) -> None:
        self.bitmaps = bitmaps
        self.shifts = [np.uint64(64 - (len(x) * 8).bit_length() + 1) for x in bitmaps]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        level = np.zeros(len(tokens), np.uint8)
        for bits, shift in zip(self.bitmaps, self.shifts, strict=True):
            at = tokens >> shift
            level += (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return level


def _power(n: int) -> int:
    """The exponent of the least power of two from ``n``."""
    return max(0, int(n) - 1).bit_length()


def _gaps(sorted_slots: np.ndarray, start: int) -> np.ndarray:
    """Gaps between slots in 16 bits; the largest value stands for itself and goes on."""
    gaps = np.diff(sorted_slots, prepend=np.uint64(start)).astype(np.int64)
    more, rest = np.divmod(gaps, _LAST)
    out = np.full(len(gaps) + int(more.sum()), _LAST, np.uint16)
    out[np.cumsum(more + 1) - 1] = rest
    return out


def _slots(gaps: np.ndarray, start: int) -> np.ndarray:
    return (np.cumsum(gaps.astype(np.int64)) + start)[gaps != _LAST]


def levels_of(n_docs: int) -> list[int]:
    """The steps for ``n_docs``: beyond ``DOCS`` they grow with the documents, so shingles over a step stay as many."""
    return [x * max(1, -(-n_docs // DOCS)) for x in LEVELS]


def steps_of(n_docs: int) -> list[int]:
    """``levels_of``, but the least is two sets however many documents there are: single shingles are told apart at any size."""
    return [2, *levels_of(n_docs)[1:]]


def commonness(docs: DataFrame, words: int, n_docs: int) -> Commonness:
    """Counts every shingle of all of ``docs``, as hash prefixes, and keeps the steps of ``steps_of``.

    Tasks send sorted prefixes as 16-bit gaps, about two bytes a shingle, by hash range; a range's
    counts become a block of each bitmap. The bitmaps have about 512 bits a document, up to
    2**``MAX_BITS``. From there on the least step's fills slowly, and single shingles whose bits are
    taken stand behind those known as single; the other steps grow with the documents.
    """
    levels = steps_of(n_docs)
    width = 16 + max(14, _power(n_docs))
    ranges = min(20, max(7, _power(n_docs // 2048)))
    sizes = [min(MAX_BITS, max(20, _power(512 * n_docs))) - (3 if k else 0) for k in range(len(levels))]
    first = np.arange(1 << ranges, dtype=np.uint64) << np.uint64(width - ranges)
    flush = max(_FLUSH, 64 << ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, n = Shingler(words), [], 0

        def flushed() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held) >> np.uint64(64 - width))
            ends = np.append(np.searchsorted(slots, first[1:]), len(slots))
            starts = np.concatenate([[0], ends[:-1]])
            there = np.flatnonzero(ends > starts)
            gaps = [_gaps(slots[starts[k] : ends[k]], int(first[k])).tobytes() for k in there]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(gaps, pa.binary())], ["range", "gaps"])

        for part in pieces(batches):
            for text in part.column(0).to_pylist():
                held.append(shingler.of(text))
                n += len(held[-1])
            if n > flush:
                yield flushed()
                held, n = [], 0
        if n:
            yield flushed()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["range"].iloc[0])
        slots = np.sort(np.concatenate([_slots(np.frombuffer(x, np.uint16), int(first[k])) for x in frame["gaps"]]))
        slots, seen = np.unique(slots, return_counts=True)
        blocks = []
        for size, least in zip(sizes, levels, strict=True):
            bits = np.zeros(1 << (size - ranges), np.uint8)
            bits[(slots[seen >= least] >> (width - size)) - (k << (size - ranges))] = 1
            blocks.append(np.packbits(bits, bitorder="little").tobytes())
        return pd.DataFrame({"range": [k], "blocks": [blocks]})

    sent = docs.select("text").mapInArrow(send, "range int, gaps binary").groupBy("range").applyInPandas(count, "range int, blocks array<binary>")
    bitmaps = [np.zeros(1 << (size - 3), np.uint8) for size in sizes]
    for row in sent.toLocalIterator():
        for bits, block in zip(bitmaps, row.blocks, strict=True):
            bits[row.range * len(block) : (row.range + 1) * len(block)] = np.frombuffer(block, np.uint8)
    return Commonness(bitmaps)


def keys_of(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles, rarest first, one of which any set that links with this one has among its own; how many are of the last step.

    Those that only this set has are left out: nothing can meet them.
    """
    prefix = len(tokens) - -(-len(tokens) * percent // 100) + 1
    chosen = np.argsort(level, kind="stable")[:prefix]
    chosen = chosen[level[chosen] > 0]
    return tokens[chosen].view(np.int64), int((level[chosen] == len(LEVELS)).sum())


def signed(docs: DataFrame, words: int, percent: int, common: Commonness) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, keys, n_hot): equal sets have the same class; an empty set has none."""
    steps = docs.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", "text_key", "n_shingles", "class", "keys", "n_hot"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in pieces(batches):
            sets = [shingler.of(t) for t in part.column(1).to_pylist()]
            keys, hot = zip(*(keys_of(s, steps.value.of(s), percent) for s in sets), strict=True)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), lists, pa.array(hot, pa.int32())], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, class long, keys array<long>, n_hot int")


def class_of(tokens: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else None


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, class) sorted by all: each class (v) with the least class (u) of its key and salt.

    A key in several parts (salt from 0) also says its part's least class, with a null v.
    """
    last: tuple[int, int] | None = None
    leader = 0
    for batch in batches:
        keys, salts, classes = (batch.column(k).to_numpy() for k in range(3))
        if not len(keys):
            continue
        first = np.concatenate([[last != (keys[0], salts[0])], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        leaders = np.where(at >= 0, classes[at], leader)
        last, leader = (keys[-1], salts[-1]), leaders[-1]
        differ = leaders != classes
        says = first & (salts >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[differ], y[says]])) for x, y in ((keys, keys), (leaders, classes))] + [pa.array(np.concatenate([classes[differ], classes[says]]), mask=np.repeat([False, True], [differ.sum(), says.sum()]))],
            ["key", "u", "v"],
        )


def nearest_leaders(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, leader): of the least classes of its keys, the one that a class shares most keys with; ``keyed`` has key, hot, class.

    The second table (class) has all those least classes, also those that no class goes to. A key of the last step is dealt to ``SALTS`` parts, whose least classes then meet.
    """
    spread = max(8, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = keyed.select("key", F.when(F.col("hot"), F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(-1).cast("int").alias("salt"), "class")
    found = written(salted.repartition(spread, "key", "salt").sortWithinPartitions("key", "salt", "class").mapInArrow(_stars, "key long, u long, v long"), "jaccard-stars")
    says = found.where("v is null").select("key", "u")
    tops = says.groupBy("key").agg(F.min("u").alias("top"))
    among = says.join(tops, "key").where("u <> top").select(F.col("top").alias("u"), F.col("u").alias("v"))
    pairs = found.where("v is not null").select("u", "v").unionByName(among)
    edges = pairs.groupBy("v", "u").agg(F.count("*").alias("n"))
    best = edges.groupBy(F.col("v").alias("class")).agg(F.max(F.struct("n", F.bitwise_not("u").alias("low"), "u")).alias("best"))
    return best.select("class", F.col("best.u").alias("leader")), pairs.select(F.col("u").alias("class")).distinct()


def linked(classes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what links among ``sets``: a spanning forest, by a token-group matrix.

    Members stand by their least shingle, ``GROUP`` of them to a group. The matrix holds each group's
    token union; a query opens a group only if it shares enough tokens with the union to link with
    any member, and only members of a fitting size that it isn't connected with yet are compared.
    With ``sides`` only members of different sides are; members of the same one of ``parts`` are
    connected from the start.
    """
    order = np.lexsort((classes, [s[0] for s in sets]))
    classes, sets = classes[order], [sets[i] for i in order]
    roots = np.arange(len(sets)) if parts is None else np.unique(parts[order], return_inverse=True)[1]
    sides = None if sides is None else sides[order]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    tokens, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(seen > 1) - 1
    own = np.split(np.where(seen[place] > 1, dense[place], -1), np.cumsum(sizes)[:-1])
    own = [x[x >= 0] for x in own]
    group_of = np.arange(n) // GROUP
    matrix = np.zeros((int(group_of[-1]) + 1, max(1, int((seen > 1).sum()))), np.bool_)
    for k, x in enumerate(own):
        matrix[group_of[k], x] = True
    mark, out = np.zeros(matrix.shape[1], np.bool_), []
    for q in range(n - 1):
        rest = np.arange(q + 1, n)
        fits = (roots[rest] != roots[q]) & (np.minimum(sizes[rest], sizes[q]) * 100 >= percent * np.maximum(sizes[rest], sizes[q]))
        if sides is not None:
            fits &= sides[rest] != sides[q]
        if not fits.any():
            continue
        bound = matrix[group_of[q] :, own[q]].sum(axis=1)
        rest = rest[fits & (bound[group_of[rest] - group_of[q]] * 100 >= percent * sizes[q])]
        if not len(rest):
            continue
        mark[own[q]] = True
        for m in rest:
            if roots[m] == roots[q]:
                continue
            both = int(np.count_nonzero(mark[own[m]]))
            if both * 100 >= percent * (sizes[q] + sizes[m] - both):
                roots[roots == roots[m]] = roots[q]
                out.append((int(classes[q]), int(classes[m])))
        mark[own[q]] = False
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets are the distinct ``words``-word shingles, or the whole sequence of fewer words. Documents link
    if 100 * intersection >= ``percent`` * union; component_id is the least doc_id over links. Shingles
    are 64-bit hashes.

    Equal sets are one class. Sets that link share one of their first shingles, rarest first (see
    ``keys_of``). Groups are opened in two rounds. First each class goes to the group of the leader
    that it shares most keys with, so large groups of near copies connect in parallel. Then only keys
    whose classes aren't all connected stay open: the parts that they hang together form a group, and
    members meet those chunks of it that hold another part under one of their keys. A group's sets are
    compared by a token-group matrix; groups of more than ``chunk`` members are opened in chunks, so
    no task holds more than two, and small groups go in batches. No link is lost and no pair list is
    built.

    Null and empty texts have no set and link with nothing; texts of any length are read whole. Rows
    with a null id join their component and don't name it. Repeated rows are one class. Other columns
    aren't looked at, whatever their names. An empty table gives an empty result.
    """
    return _labelled(docs, words, percent, chunk).drop("text_key")


def _chunks(members: DataFrame, label: str, chunk: int) -> DataFrame:
    """``members`` (label, class, ...) with chunks, into which their label is cut, and own, the one of the class."""
    large = members.groupBy(F.col(label).alias("_l")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1")
    side = bounded_broadcast(large, name="jaccard-large")
    cut = members.join(side, F.col(label) == F.col("_l"), "left").drop("_l").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return cut.withColumn("own", F.pmod(F.xxhash64("class", F.lit(5)), F.col("chunks")).cast("int"))


def _open(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) in the groups of ``dealt`` (label, i, j, class, own, part): chunk i of a label, or i against j."""
    dealt = written(dealt.select("label", "i", "j", "class", "own", "part", "chunks"), "jaccard-dealt")
    batches = max(1, -(-dealt.count() // BATCH))
    batch = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("label"), F.lit(batches))).otherwise(F.xxhash64("label", "i", "j"))
    by_group = ["label", "i", "j"]

    def open_groups(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates([*by_group, "class"]).sort_values(by_group, kind="stable")
        at = frame[by_group].to_numpy()
        found: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            part = frame.iloc[a:b]
            if b - a > 1:
                sides = part["own"].to_numpy() if part["i"].iloc[0] != part["j"].iloc[0] else None
                found += linked(part["class"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in part["tokens"]], sides, percent, part["part"].to_numpy())
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    with_sets = broadcast_up_to(dealt).join(sets.withColumnRenamed("class", "c"), F.col("class") == F.col("c"))
    return with_sets.select(batch.alias("batch"), *by_group, "class", "own", "part", "tokens").groupBy("batch").applyInPandas(lambda f: open_groups(f.drop(columns="batch")), "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, tokens) of ``wanted`` (class, id, key), read from the row of ``docs`` with that id and text."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, given = Shingler(words), set()
        for part in pieces(batches):
            sets = [shingler.of(t) for t in part.column(0).to_pylist()]
            good = []
            for s, c in zip(sets, part.column(1).to_pylist(), strict=True):
                good.append(c not in given and class_of(s) == c)
                given.add(c)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"]).filter(pa.array(good, pa.bool_()))

    side = bounded_broadcast(wanted, name="jaccard-side")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key"))
    return docs.join(side, same).select("text", "class").mapInArrow(fetch, "class long, tokens binary")


def _labelled(docs: DataFrame, words: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """``near_duplicates`` with text_key, a hash of the text."""
    docs = docs.select("doc_id", "text")
    rows = written(signed(docs, words, percent, commonness(docs, words, docs.count())), "jaccard-keys")
    classes = written(
        rows.where("size(keys) > 0")
        .groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("at"), F.first("keys").alias("keys"), F.first("n_hot").alias("n_hot")),
        "jaccard-classes",
    )
    keyed = classes.select("class", F.posexplode("keys").alias("pos", "key"), (F.size("keys") - F.col("n_hot")).alias("calm")).select("key", (F.col("pos") >= F.col("calm")).alias("hot"), "class")

    leaders, met = nearest_leaders(keyed)
    leaders = written(leaders, "jaccard-leaders")
    cut = written(_chunks(leaders, "leader", chunk).select(F.col("leader").alias("label"), "class", "chunks", "own"), "jaccard-first")
    heads = cut.groupBy("label").agg(F.max("chunks").alias("chunks")).select("label", F.col("label").alias("class"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("own"))
    first_round = cut.unionByName(heads.select(*cut.columns)).select("*", F.col("own").alias("i"), F.col("own").alias("j"), F.col("class").alias("part"))
    wanted = cut.select("class").unionByName(met).distinct()
    named = classes.join(wanted, "class", "left_semi").select("class", F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("key"))
    sets = written(_sets(docs, named, words), "jaccard-sets")
    links = written(_open(first_round, sets, percent), "jaccard-links")
    parts = broadcast_up_to(components(links, "jaccard-parts").select(F.col("node").alias("member"), F.col("label").alias("p")))

    placed = keyed.join(parts, F.col("class") == F.col("member"), "left").select("key", "class", F.coalesce("p", "class").alias("part"))
    open_keys = written(placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select(F.col("key").alias("k"), "least"), "jaccard-open-keys")
    if not open_keys.isEmpty():
        still = written(placed.join(broadcast_up_to(open_keys), F.col("key") == F.col("k")).select("key", "class", "part", "least"), "jaccard-open")
        hang = components(still.select(F.col("least").alias("u"), F.col("part").alias("v")), "jaccard-groups").select(F.col("node").alias("n"), "label")
        members = still.select("class", "part").distinct().join(broadcast_up_to(hang), F.col("part") == F.col("n")).select("label", "class", "part")
        cut = written(_chunks(members, "label", chunk), "jaccard-second")
        second_round = _against(cut, still)
        links = links.unionByName(_open(second_round, sets, percent))
    joined = broadcast_up_to(components(links, "jaccard-joined").select(F.col("node").alias("member"), "label"))
    grouped = rows.drop("keys", "n_hot").join(joined, F.col("class") == F.col("member"), "left").withColumn("group", F.coalesce("label", "class"))
    grouped = written(grouped.select("doc_id", "text_key", "n_shingles", "group"), "jaccard-result")
    least = written(grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "jaccard-least")
    return grouped.join(broadcast_up_to(least.select(F.col("group").alias("g"), "least")), F.col("group") == F.col("g"), "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def _against(cut: DataFrame, still: DataFrame) -> DataFrame:
    """Members (label, class, part, chunks, own) with the pairs of chunks (i, j) that they are opened in.

    In a group of several chunks a member meets those that hold, under one of its open keys (``still``
    has key, class, part), a class of another part.
    """
    small = cut.where("chunks = 1").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = cut.where("chunks > 1")
    if large.isEmpty():
        return small
    under = written(still.select("key", F.col("class").alias("c")).join(broadcast_up_to(large), F.col("c") == F.col("class")).drop("c"), "jaccard-under")
    holds = under.groupBy(F.col("key").alias("k"), F.col("own").alias("other")).agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    meets = under.join(holds, (F.col("key") == F.col("k")) & ~((F.col("lo") == F.col("part")) & (F.col("hi") == F.col("part")))).select("label", "class", "part", "chunks", "own", "other").distinct()
    return small.unionByName(meets.select("label", "class", "part", "chunks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those of a component that a smaller doc_id names, by id and text. Rows without an id stay.

    Repeated rows of the least id all stay; nulls, empty and long texts and empty tables go as in
    ``near_duplicates``. All columns come back unchanged, whatever their names.
    """
    gone = _labelled(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    return whole(docs, id=F.col("doc_id"), key=F.xxhash64("text")).join(bounded_broadcast(gone, name="jaccard-gone"), same, "left_anti").select("doc.*")
