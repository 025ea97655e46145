"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gridwright.llm.common import fold, table
from gridwright.llm.exact_dedup import exact_dedup
from gridwright.llm.jaccard_join import near_duplicates
from gridwright.llm.language_id import identify, learn_profiles
from gridwright.llm.licenses import scan
from gridwright.llm.lm_score import score_texts
from gridwright.llm.mixing import mix
from gridwright.llm.packing import pack
from gridwright.llm.token_counts import count_tokens
from gridwright.llm.topk_search import top_k
from gridwright.llm.toxicity import learn, sampled, score


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's scores of all texts, learned from those whose remainder is not 1; nulls, long texts, ties and repeats as in ``score_texts``; a null id is learned from by none."""
    out = score_texts(table(spark, sf_dir, "documents"), fold() != 1)
    return out.select("doc_id", (~F.col("learned_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, learned from labels whose remainder is not 0; nulls, long texts and repeats as in ``learn`` and ``score``; a null id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = sampled(table(spark, sf_dir, "labels").where(fold() != 0))
    model = learn(docs.join(F.broadcast(labels), "doc_id"))
    return score(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates of all texts; nulls, long texts, ties and repeats as in ``scan``."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; nulls, long texts, ties and repeats as in ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; nulls, long texts, ties and repeats as in ``mix``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all texts, learned from labelled rows whose remainder is not 0; nulls, long texts, ties and repeats as in ``identify``; a null id counts as held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(fold() != 0))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents' pieces; nulls, long texts, ties and repeats as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates (4 words, 85 %); nulls, long texts and repeats as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows for each twentieth id; nulls, ties and repeated ids as in ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts; nulls, long texts and repeats as in ``count_tokens``."""
    return count_tokens(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's last stage; each stage's docstring says how it takes odd rows."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_score,
        op2_toxicity,
        op3_license_scan,
        op4_exact_dedup,
        op5_source_mixing,
        op6_language_id,
        op7_best_fit_packing,
        op8_ngram_jaccard,
        op9_topk_search,
        op10_token_counts,
        pipeline,
    )
}

_NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        with n as (select doc_id, sha256({_NORMALISED}) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, text_sha256
        from n window w as (partition by text_sha256)
    """,
    "op8_ngram_jaccard": r"""
        with recursive d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ), s as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as shingles from d
        ), e as (
            select doc_id, len(shingles) as n, unnest(shingles) as shingle from s
        ), o as (
            select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as shared
            from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
        ), l as (
            select x, y from o where 100 * shared >= 85 * (nx + ny - shared)
        ), r(a, b) as (
            select doc_id, doc_id from s union select r.a, l.y from r join l on l.x = r.b
        )
        select s.doc_id, len(any_value(s.shingles)) as n_shingles, min(r.b) as component_id from s join r on r.a = s.doc_id group by s.doc_id
    """,
    "op9_topk_search": """
        with v as (
            select vec_id, row_number() over () as own, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.own, q.vec_id as query_id, d.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v d on q.own <> d.own and len(q.v) = len(d.v)
            where q.vec_id % 20 = 0
        ), r as (
            select *, cast(row_number() over (partition by own order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
}
