"""License scans: phrase matches, and templates found by diagonal voting over word k-grams."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import bounded_broadcast, pieces, widened, written

# The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of public license notices, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
]

#: Words of a k-gram; diagonals that still are neighbours; share of its words that a template needs.
K = 3
NEAR = 3
LEAST = 0.8
#: k-grams of the templates that are broadcast.
MAX_GRAMS = 1_000_000

#: A-Z to a-z, other ASCII but digits and letters to a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Rolling:
    """Hashes of all rolling ``k``-grams of words."""

    def __init__(self, k: int = K) -> None:
        self.k = k

    def of(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        out = np.zeros(n, np.uint64)
        for j in range(self.k):
            out = (out ^ h[j : j + n]) * _A
            out ^= out >> np.uint64(31)
        return (out * _B).view(np.int64)


def template_grams(templates: list[tuple[str, str]], k: int = K) -> list[tuple[int, int, int]]:
    """(gram, template, position) of every k-gram of every template."""
    rolling = Rolling(k)
    return [(int(g), t, p) for t, (_, text) in enumerate(templates) for p, g in enumerate(rolling.of(words_of(text)))]


def candidate_spans(docs: DataFrame, templates: list[tuple[str, str]], k: int = K, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """(text_key, spans): where templates may stand, by diagonal voting; ``docs`` has text and text_key.

    All rolling k-grams of all words join the templates' positions. A diagonal is the offset between
    a text's position and the template's; votes on it and on neighbours at most ``near`` apart make a
    run, and neighbouring runs over different stretches of the template, less than its length apart,
    join. A run is a candidate with the votes that ``least`` of the words leave where each missing word breaks k
    k-grams, or one. The joined side has one row for each k-gram of the templates; it is broadcast up
    to ``MAX_GRAMS`` of them and shuffled beyond.
    """
    spark = docs.sparkSession
    found = template_grams(templates, k)
    side = F.broadcast if len(found) <= MAX_GRAMS else lambda x: x
    grams = spark.createDataFrame(found, "gram long, template int, at int")
    lengths = [len(words_of(x)) for _, x in templates]
    needs = spark.createDataFrame([(t, max(1, n - k + 1 - k * int((1 - least) * n + 1e-9)), n) for t, n in enumerate(lengths)], "template int, votes_needed int, length int")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(k)
        for part in pieces(batches):
            found = [rolling.of(words_of(t)) for t in part.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["text_key", "grams"])

    rolled = docs.where("text is not null").select("text_key", "text").mapInArrow(roll, "text_key long, grams array<long>")
    votes = (
        rolled.select("text_key", F.posexplode("grams").alias("pos", "gram"))
        .join(side(grams), "gram")
        .groupBy("text_key", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"))
    )
    order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"), F.lit(1))
    runs = (
        votes.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(order))
        .groupBy("text_key", "template", "run")
        .agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.min(F.col("diagonal") + F.array_min("ats")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("ats") + k).alias("end"),
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        )
        .join(side(needs), "template")
        .withColumn("least", F.array_min("ats"))
        .withColumn("most", F.array_max("ats"))
    )
    order = Window.partitionBy("text_key", "template").orderBy("low")
    overlap = (F.col("least") <= F.lag("most").over(order)) & (F.col("most") >= F.lag("least").over(order))
    own = overlap | (F.col("low") - F.lag("high").over(order) >= F.col("length"))
    merged = (
        runs.withColumn("own", F.coalesce(own.cast("int"), F.lit(1)))
        .withColumn("joined", F.sum("own").over(order))
        .groupBy("text_key", "template", "votes_needed", "joined")
        .agg(F.min("first").alias("first"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"))
        .where("votes >= votes_needed")
    )
    return merged.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("first", "end", "template"))).alias("spans"))


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` (with spaces around) stands in ``joined``."""
    out, at, words, last = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", last, at)
        out.append(words)
        last, at = at, joined.find(phrase, at + 1)
    return out


def verified(words: list[bytes], first: int, end: int, template: list[bytes], least: float = LEAST) -> list[tuple[float, int, int]]:
    """(share, first word, end) of the stretches that hold at least ``least`` of the template's words in order.

    The run is looked at in overlapping windows of twice the template's length, so a stretch is the
    template and gaps of its length at most, however long the run is. Stretches don't overlap.
    """
    n, found = len(template), []
    a, b = max(0, first - n), min(len(words), end + n)
    for start in range(a, max(a + 1, b - n), max(1, n // 2)):
        if found and start < found[-1][2] - n // 2:
            continue
        blocks = [x for x in SequenceMatcher(None, template, words[start : min(b, start + 2 * n)], autojunk=False).get_matching_blocks() if x.size]
        share = sum(x.size for x in blocks) / n
        if share < least:
            continue
        here = (share, start + blocks[0].b, start + blocks[-1].b + blocks[-1].size)
        if found and here[1] < found[-1][2]:
            if share > found[-1][0]:
                found[-1] = here
        else:
            found.append(here)
    return found


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, k: int = K, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``base_labels`` are those of phrases whose words stand consecutively. Templates are found by
    diagonal voting and verified word by word; ``spans`` lists (label, first word, end) of those with
    at least ``least`` of their words, gaps up to the template's length. ``score`` is 1 with a base
    phrase, else the best such share.

    Null and empty texts have no words and no labels, score 0; texts of any length are read whole.
    Templates that stand at the same place all count. Equal texts, so repeated rows too, share their
    candidates and have a row each. Other columns aren't looked at, whatever their names. An empty
    table gives an empty result.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    spans = written(candidate_spans(docs, templates, k, least=least), "license-spans").select(F.col("text_key").alias("span_key"), "spans")
    joined = docs.join(bounded_broadcast(spans, 200_000, "license-side"), F.col("text_key") == F.col("span_key"), "left").select("doc_id", "text", "spans")
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    bodies = [words_of(x) for _, x in templates]
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = widened(docs.select("doc_id"), f"{columns}, spans array<struct<label:string,first:bigint,end:bigint>>")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]
        for batch in pieces(batches):
            out: list[tuple] = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                line = b" " + b" ".join(words) + b" "
                found = [(place, tag) for needle, tag in needles for place in _places(line, needle)]
                base = sorted({tag for _, tag in found})
                best, good = 1.0 if found else 0.0, []
                for m in marks or []:
                    for share, first, end in verified(words, m["first"], m["end"], bodies[m["template"]], least):
                        best = max(best, share)
                        good.append({"label": templates[m["template"]][0], "first": first, "end": end})
                labels = sorted({*base, *(g["label"] for g in good)})
                places = [p for p, _ in found]
                out.append((len(words), len(found), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), best, good))
            made = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema.fieldNames())

    return joined.mapInArrow(label, schema)
