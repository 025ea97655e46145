"""Token counts of a public byte-level BPE by a two-tier, map-side table of pre-token lengths."""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import sample_below, widened

#: Documents that the frequent table is learned from and its entries, at most; entries of a worker's cache.
SAMPLE_DOCS = 2000
TABLE_ENTRIES = 60_000
CACHE_ENTRIES = 400_000
_LONGEST_KEY = 40


@functools.cache
def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _library(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Encoder:
    """Counts tokens; a chunk is what stands between single spaces, so it holds whole pre-tokens.

    A pre-token of a byte-level BPE never reaches over a single space between two other signs: the
    space begins the next one. So the tokens of a text are those of its chunks, each with its space.
    Chunks seen before cost one look-up, in the broadcast table or in the worker's cache; the others
    go to the library together. A text that holds a special string goes to the library whole.
    """

    def __init__(self, path: str, table: dict[str, int], cache_entries: int = CACHE_ENTRIES) -> None:
        self.path, self.table, self.cache_entries = path, table, cache_entries
        self.cache: dict[str, int] = {}
        self.strings = [t.content for t in _library(path).get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in _library(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks, all but the first without the space before them; longer white space stays inside one."""
        parts = text.split(" ")
        if all(parts) and not any(x[0].isspace() or x[-1].isspace() for x in parts):
            return parts
        merged: list[list[str]] = []
        closed = False
        for x in parts:
            if closed and x and not x[0].isspace():
                merged.append([x])
            elif merged:
                merged[-1].append(x)
            else:
                merged.append([x])
            closed = bool(x) and not x[-1].isspace()
        return [" ".join(x) for x in merged]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        out, fresh, later = [0] * len(texts), {}, []
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.strings):
                later.append((k, text, []))
                continue
            head, *rest = self.chunks(text)
            found = list(map(self.table.get, rest))
            if None not in found:
                out[k] = sum(found)
                later.append((k, head, []))
                continue
            out[k] = sum(n for n in found if n is not None)
            missed = []
            for x, n in zip(rest, found, strict=True):
                if n is None:
                    if (known := self.cache.get(x)) is None:
                        missed.append(x)
                        fresh[x] = 0
                    else:
                        out[k] += known
            later.append((k, head, missed))
        for x, n in zip(list(fresh), self._encode([" " + x for x in fresh]), strict=True):
            fresh[x] = n
        for (k, _, missed), n in zip(later, self._encode([head for _, head, _ in later]), strict=True):
            out[k] += n + sum(map(fresh.__getitem__, missed))
        if len(self.cache) + len(fresh) > self.cache_entries:
            self.cache.clear()
        self.cache.update((x, n) for x, n in fresh.items() if len(x) <= _LONGEST_KEY)
        return out


def frequent_table(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The tokens of the most frequent chunks in a bounded sample of ``docs``, dealt by a hash of the id.

    The whole table is scanned at full width; the few sampled texts are dealt to eight tasks, each of
    which returns its most frequent chunks. No pre-token shuffles, and the table only saves work.
    """
    n = docs.count()
    sample = docs.where(F.col("text").isNotNull()).where(sample_below(F.coalesce(F.col("doc_id"), F.xxhash64("text")), min(1.0, sample_docs / max(1, n)))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(x for x in Encoder.chunks(text)[1:] if len(x) <= _LONGEST_KEY)
            if len(seen) > 4 * entries:
                seen = Counter(dict(seen.most_common(entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["chunk", "n"])

    total: Counter = Counter()
    for row in sample.repartition(8).mapInArrow(count, "chunk string, n long").toLocalIterator():
        total[row.chunk] += row.n
    chosen = [x for x, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:entries]]
    lengths = [len(x) for x in _library(path).encode_batch_fast([" " + x for x in chosen], add_special_tokens=False)]
    return dict(zip(chosen, lengths, strict=True))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Whole texts of any length; a null text counts as empty. Repeated rows are counted each; entries of
    the frequent table that are as frequent go by their text. Other columns aren't looked at, whatever
    their names. An empty table gives an empty result.
    """
    path = path or default_path()
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path))
    schema = widened(docs.select("doc_id"), "n_bytes long, n_tokens long, over_limit boolean")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = Encoder(path, table.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                counts = encoder.counts(texts)
                sizes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.mapInArrow(label, schema)
