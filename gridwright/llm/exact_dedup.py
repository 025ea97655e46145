"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import SPACE, bounded_broadcast, whole, written

#: Bits of the filter for each row, slots of a range of it (a power of two), and the most 64-bit words
#: of it that are broadcast (about 40 bytes each in the hash relation). The words set grow with a
#: sixteenth of the rows, so this is the filter of about 60 million rows; the slots of larger ones
#: join by a shuffle.
BITS_PER_ROW = 32
RANGE = 1 << 20
MAX_BROADCAST_WORDS = 4_000_000


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one space; null as empty.

    Single spaces already are what they become, so the pattern leaves them out.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")


def _slots(n_rows: int) -> int:
    return 1 << max(16, math.ceil(math.log2(max(1, n_rows) * BITS_PER_ROW)))


def exact_dedup(docs: DataFrame, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Pass one sets two Bloom slots for each hash. Each task sends its slots as one array for a range of
    the filter, so no row of ``docs`` shuffles; a range keeps, in words of 64 bits, the slots that two
    rows or more have set. Pass two looks each row's slots up where the row lies: rows with a slot
    that only they set are unique and pass straight through; only the others shuffle on their hash.

    Null and empty texts are equal to each other; texts of any length are hashed whole. Of rows with
    the same text the least doc_id stays, of repeated rows one; a null doc_id counts as the largest.
    Other columns aren't looked at, whatever their names. An empty table gives an empty result.
    """
    rows = written(
        docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "dedup-hashes",
    )
    bits = _slots(rows.count())
    slot = [F.pmod(F.xxhash64("text_sha256", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    filled = (
        rows.select(F.explode(F.array(*slot)).alias("slot"))
        .select(F.expr(f"slot div {RANGE}").alias("range"), (F.col("slot") % RANGE).cast("int").alias("at"))
        .groupBy("range")
        .agg(F.collect_list("at").alias("seen"))
        .select("range", F.explode("seen").alias("at"))
        .groupBy("range", "at")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    words = written(
        filled.groupBy("range", F.expr("at div 64").alias("part"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("set"))
        .select((F.col("range") * (RANGE // 64) + F.col("part")).alias("word"), "set"),
        "dedup-bloom",
    )
    keyed = rows.withColumn("s0", slot[0]).withColumn("s1", slot[1])
    side = F.broadcast if words.count() <= max_broadcast_words else lambda x: x
    for k in (0, 1):
        keyed = keyed.join(side(words.select(F.col("word").alias(f"w{k}"), F.col("set").alias(f"b{k}"))), F.expr(f"s{k} div 64 = w{k}"), "left")
    keyed = keyed.withColumn("maybe", F.expr("coalesce(getbit(b0, cast(s0 % 64 as int)) & getbit(b1, cast(s1 % 64 as int)) = 1, false)"))
    keyed = keyed.select("doc_id", "text_sha256", "row", "maybe")
    maybe = keyed.where("maybe")
    groups = written(
        maybe.groupBy("text_sha256")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "dedup-groups",
    ).select(F.col("text_sha256").alias("hash"), "first", "group_size")
    repeated = maybe.join(groups, maybe.text_sha256 == groups.hash, "left").select(
        "doc_id",
        F.when(F.col("hash").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    alone = keyed.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(repeated)


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the least doc_id of each group of equal texts.

    Where doc_id does not tell rows apart, one row of each (doc_id, text) stays. Nulls, empty and long
    texts and empty tables go as in ``exact_dedup``; all columns come back unchanged, whatever their names.
    """
    key = F.xxhash64(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    found = written(
        exact_dedup(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("gone_id"), F.xxhash64("text_sha256").alias("gone"), F.expr("doc_id <=> keep_id as twin")),
        "dedup-dropped",
    )
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone"))
    gone, twins = (bounded_broadcast(found.where(x).select("gone_id", "gone").distinct()) for x in ("not twin", "twin"))
    stay = whole(docs, id=F.col("doc_id"), hash=key).join(gone, same, "left_anti")
    if not found.where("twin").isEmpty():
        stay = stay.join(twins, same, "left_anti").unionByName(stay.join(twins, same, "left_semi").dropDuplicates(["id", "hash"]))
    return stay.select("doc.*")
