"""Best-fit packing of documents into sequences under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import broadcast_up_to, numbered, widened, written
from gridwright.llm.exact_dedup import normalised
from gridwright.llm.mixing import word_count

#: Words of a bin, documents of one source that a bin takes at most, and pieces of a shard.
CAPACITY = 2048
MAX_PER_SOURCE = 2
SHARD_PIECES = 2048


def best_fit(items: list[tuple[int, int, int]], capacity: int, max_per_source: int) -> list[int]:
    """The bin of each (size, source, cluster), items taken in the given order.

    Bins stand by what is left in them, then by number. The search starts at the least that holds
    the item and goes on to its successors until one has room for another document of the source
    and none of the cluster; that is the tightest compatible bin. A bin keeps a bitmap of its
    clusters and one bitmap a level of the sources that it has that often.
    """
    by_room: list[tuple[int, int]] = []
    sources: list[list[int]] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(by_room, (size, -1))
        while at < len(by_room) and (clusters[by_room[at][1]] & c or sources[by_room[at][1]][-1] & s):
            at += 1
        if at < len(by_room):
            room, k = by_room.pop(at)
        else:
            room, k = capacity, len(clusters)
            sources.append([0] * max_per_source)
            clusters.append(0)
        for level, bits in enumerate(sources[k]):
            if not bits & s:
                sources[k][level] |= s
                break
        clusters[k] |= c
        if room > size:
            insort(by_room, (room - size, k))
        out.append(k)
    return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
    shard_pieces: int = SHARD_PIECES,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, first_word, n_words, shard, bin.

    A document of ``capacity`` words or more is cut into full pieces, each a bin of its own in a
    shard of its own (below 0), and a rest. Rests are dealt by a hash to shards of about
    ``shard_pieces``, longest first, ties by hash, into the tightest bin that holds none of their
    cluster and fewer than ``max_per_source`` documents of their source. (shard, bin) names a sequence.

    A cluster is the texts that are equal, white space aside; ``clusters`` (doc_id, component_id), such
    as those of ``near_duplicates``, names larger ones. Its rows are then joined by doc_id.

    Texts without a word have no piece; texts of any length are packed whole. A null source is a source
    of its own, a null id in no larger cluster. Repeated rows are packed as often as they stand there,
    over all shards, never two in one bin. Other columns aren't looked at, whatever their names. Empty
    tables give an empty result.
    """
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(normalised(F.col("text"))).alias("cluster"))
        .where("size > 0")
        .withColumn("key", F.xxhash64("doc_id", "cluster", "size"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pack-sizes",
    )
    if clusters is not None:
        named = written(clusters.where("doc_id is not null and component_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.min("component_id").alias("c")), "pack-clusters")
        sized = sized.join(broadcast_up_to(named), F.col("doc_id") == F.col("d"), "left").withColumn("cluster", F.when(F.col("c").isNull(), F.col("cluster")).otherwise(F.xxhash64("c"))).drop("d", "c")
    full = F.floor(F.col("size") / capacity)
    long_ = (
        sized.where(F.col("size") >= capacity)
        .select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("n_words"), (-1 - F.col("row")).alias("shard"), F.col("piece").alias("bin"))
    )
    rest = sized.select("doc_id", "source", "cluster", "key", "row", full.alias("piece"), (F.col("size") % capacity).alias("n_words")).where("n_words > 0")
    shards = max(1, -(-rest.count() // shard_pieces))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "turn", "row"], ascending=[False, True, True], kind="stable")
        source = pd.factorize(frame["source"], use_na_sentinel=False)[0].tolist()
        cluster = pd.factorize(frame["cluster"])[0].tolist()
        bins = best_fit(list(zip(frame["n_words"].tolist(), source, cluster, strict=True)), capacity, max_per_source)
        return frame.assign(bin=bins)[["doc_id", "piece", "n_words", "shard", "bin"]]

    packed = (
        numbered(rest, "key", "row", "number")
        .withColumn("turn", F.xxhash64("key", "number"))
        .withColumn("shard", F.pmod("turn", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(fit, widened(docs.select("doc_id"), "piece long, n_words long, shard long, bin long"))
    )
    return long_.unionByName(packed.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_word"), "n_words", "shard", "bin"))
