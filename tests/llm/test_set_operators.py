"""Deduplication, joins, mixing, packing, search and the pipeline against brute force."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwright.llm import exact_dedup, jaccard_join, language_id, mixing, packing, topk_search, toxicity
from gridwright.llm.common import components
from gridwright.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (5, "a b  c", "en", "s1", 1), (3, "a\tb c", None, "s1", None), (9, None, None, None, None), (8, "", "en", "s2", 0), (7, "  ", "en", "s2", 0), (None, "a b c", "en", None, 1),
    (3, "a\tb c", None, "s1", None), (11, "only", "fr", "s3", 1), (12, "y" * 200_000, "fr", "s3", 1), (13, "w " * 30_000, "de", "s1", 1), (14, "a b c ", "en", "s1", 5),
]
CLASHES = (
    "row class score Lang_Pred _score _hash hash gone gone_id gone_key d s k t n copies twins _copy copy doc id of key unit number equal ahead label part own chunks group "
    "size p draw target source_size taken text_sha256 kept keep_id text_key cluster shard bin piece".split()
)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns called like those that operators and stages work with."""
    clashes = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(clashes)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in place)) for r in want.fetchall())


@pytest.mark.parametrize("limit", [exact_dedup.MAX_BROADCAST_WORDS, -1])
def test_exact_dedup_odd_rows_by_both_ways(spark, odd, limit):
    got = exact_dedup.exact_dedup(odd, limit).collect()
    groups = collections.defaultdict(list)
    for r in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    assert len(got) == len(ODD)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == digest]
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)} and sum(r.kept for r in own) == 1
        assert {r.keep_id for r in own} == {min((i for i in ids if i is not None), default=None)}
    assert exact_dedup.exact_dedup(empty(spark), limit).count() == 0


def test_drop_exact_keeps_one_row_of_each_text(spark, odd):
    kept = exact_dedup.drop_exact(odd).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ODD})
    assert exact_dedup.drop_exact(empty(spark)).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = words(low(t))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, passage = {}, [rng.choice(vocabulary) for _ in range(50)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 9, 12, 30, 80, 200)))]
        if rng.random() < 0.4:
            base[2:2] = passage
        for _ in range(rng.choice((1, 1, 4, 9))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, n, percent).collect()} == brute_components(texts, n, percent)


def test_near_duplicates_over_many_chunks(spark):
    texts = near_copies(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, 2, 50, chunk=3).collect()} == brute_components(texts, 2, 50)


def test_near_duplicates_of_the_table_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_jaccard"](spark, SF).collect()} == brute_components(texts, 4, 85)


def test_near_duplicates_odd_rows(spark, odd):
    got = jaccard_join.near_duplicates(odd, 4, 85).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (9, 8, 7)} == {(9, 0, 9), (8, 0, 8), (7, 0, 7)}
    assert {r.component_id for r in got if r.doc_id in (3, 5, 14, None)} == {3}
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    assert jaccard_join.drop_near(odd).where("doc_id in (5, 14)").count() == 0


def test_drop_near_keeps_another_text_of_the_same_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (5, text + " more"), (5, "a text that has nothing to do with the others")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:6]) for r in jaccard_join.drop_near(docs).collect()) == [(1, "w0 w1 "), (5, "a text")]


def test_shingle_gaps_round_trip():
    slots = np.sort(np.random.default_rng(1).integers(1000, 1 << 40, 5000)).astype(np.uint64)
    slots = np.concatenate([slots[:9], slots[:9], slots[9:] % np.uint64(1 << 22)])
    slots.sort()
    assert (jaccard_join._slots(jaccard_join._gaps(slots, 7), 7) == slots.astype(np.int64)).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    assert {r.node: r.label for r in components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = collections.Counter()
    for r in docs.values():
        sizes[r.source] += len(words(r.text))
    rows = QUERIES["op5_source_mixing"](spark, sf).collect()
    again = QUERIES["op5_source_mixing"](spark, sf).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    want, taken = brute_targets(sizes), collections.Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_cube_keeps_sums_and_lands_near(spark):
    rng = random.Random(2)
    sizes = [float(rng.choice((3, 10, 50, 400, 2000))) for _ in range(500)]
    p = [rng.random() for _ in sizes]
    flown = mixing.fly(sizes, p, [rng.random() for _ in sizes])
    assert sum(0 < x < 1 for x in flown) <= 2
    assert abs(sum(flown) - sum(p)) < 1e-6 and abs(sum(s * x for s, x in zip(sizes, flown, strict=True)) - sum(s * x for s, x in zip(sizes, p, strict=True))) < 1e-4
    goal = sum(s * x for s, x in zip(sizes, p, strict=True))
    landed = mixing.land(sizes, flown, goal, sum(p))
    assert set(landed) <= {0.0, 1.0} and abs(sum(s * x for s, x in zip(sizes, landed, strict=True)) - goal) < 10
    assert abs(sum(landed) - sum(p)) <= 1


def test_mixing_in_small_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, chunk=7).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
    assert sum(r.n for r in rows) == docs.count() and all(abs(r.t - r.g) <= r.largest for r in rows)


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r["size"] for r in got)
    assert {r.taken for r in got if r.doc_id in (9, 8, 7)} == {0}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.where("text is null or trim(text) = ''").count() == 0


def packed_ok(rows, docs, capacity, most):
    cover, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        cover[r.doc_id].append((r.first_word, r.n_words))
        bins[r.shard, r.bin].append(r)
    for r in bins.values():
        assert sum(x.n_words for x in r) <= capacity
        texts = [" ".join(words(docs[x.doc_id].text)) for x in r]
        assert len(texts) == len(set(texts))
        assert max(collections.Counter(docs[x.doc_id].source for x in r).values()) <= most
    for d, r in docs.items():
        at = 0
        for first, n in sorted(cover[d]):
            assert first == at and n > 0
            at += n
        assert at == len(words(r.text))


def test_packing_holds_its_constraints(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    packed_ok(rows, docs, packing.CAPACITY, packing.MAX_PER_SOURCE)
    bins = {(r.shard, r.bin) for r in rows}
    assert sum(r.n_words for r in rows) / (packing.CAPACITY * len(bins)) > 0.9


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    items = sorted(((rng.randrange(1, 60), rng.randrange(6), rng.randrange(30)) for _ in range(400)), reverse=True)
    bins, want = [], []
    for size, source, cluster in items:
        fit = [(room, k) for k, (room, held) in enumerate(bins) if room >= size and room > 0 and cluster not in [c for _, c in held] and [s for s, _ in held].count(source) < 2]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append((100, []))
        bins[k] = (bins[k][0] - size, [*bins[k][1], (source, cluster)])
        want.append(k)
    assert packing.best_fit(items, 100, 2) == want


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, capacity=1000).collect()
    total = sum(len(words(r[1])) for r in ODD)
    assert sum(r.n_words for r in rows) == total and all(r.n_words <= 1000 for r in rows)
    assert packing.pack(empty(spark)).count() == 0


def brute_top(rows, k, every):
    out = []
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scores = sorted((-int(v @ w), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k_equals_brute_force_on_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 1 if k < 200 else 0.01, 8)]) for k in range(300)]
    rows += [(300 + k, [0.5] * 8) for k in range(40)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (420, [1.0, 2.0]), (440, [2.0, 1.0]), (None, [0.0] * 8)]
    rows += [(0, [0.3] * 8), (20, rows[20][1]), (7, [0.1] * 8)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, dim string, row int")
    got = topk_search.top_k(df, "vec_id % 20 = 0", 7, data_block=64, query_block=5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7, 20)
    assert topk_search.top_k(df.where("vec_id < 0"), "vec_id % 20 = 0").count() == 0


def test_top_k_with_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BROADCAST_BLOCKS", 2)
    rows = [(k, [float(k * 7 % 11), float(k * 5 % 13)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(df, "vec_id % 2 = 0", 5, data_block=50, query_block=20).collect())) == brute_top(rows, 5, 2)


def test_top_k_says_when_scores_do_not_fit(spark):
    big = spark.createDataFrame([(0, [1e15] * 4), (1, [1e15] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        topk_search.top_k(big, "vec_id % 20 = 0").collect()


@pytest.mark.parametrize("spread", [60, 3])
def test_cover_tree_covers_and_separates(spread):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-spread, spread, (50, 6)) + c for c in rng.integers(-500, 500, (12, 6))] + [np.zeros((100, 6), int)])
    tree = topk_search.cover_tree(x, np.arange(len(x)), leaf=8)
    inner = 0
    for k in range(len(tree.radius)):
        part = tree.points[tree.start[k] : tree.end[k]]
        assert np.sqrt(((part - tree.center[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        assert sum(tree.end[c] - tree.start[c] for c in tree.children[k]) in (0, tree.end[k] - tree.start[k])
        if not tree.children[k]:
            continue
        inner += 1
        nodes = [c for c in tree.children[k] if not tree.bucket[c]]
        singles = [p for c in tree.children[k] if tree.bucket[c] for p in tree.points[tree.start[c] : tree.end[c]]]
        net = np.array([*tree.center[nodes], *singles], float)
        apart = np.sqrt(((net[:, None] - net[None]) ** 2).sum(axis=2)) + np.eye(len(net)) * 1e9
        assert apart.min() > tree.scale[k] - 1e-9 and all(tree.radius[c] <= tree.scale[k] + 1e-9 for c in nodes)
    assert inner > 3


def test_search_prunes_clusters():
    rng = np.random.default_rng(7)
    centers = rng.integers(-400, 400, (20, 6))
    x = np.concatenate([rng.integers(-5, 5, (100, 6)) + c for c in centers])
    tree, asked = topk_search.cover_tree(x, np.arange(2000), leaf=16), topk_search.cover_tree(x[:30], np.arange(30), leaf=16)
    opened = []
    found, products = None, topk_search._products
    try:
        topk_search._products = lambda a, b: opened.append(len(a) * len(b)) or products(a, b)
        found = topk_search.search(tree, asked, np.full(30, -np.inf), 5)
    finally:
        topk_search._products = products
    assert sum(opened) < 0.5 * 30 * 2000
    for k, (ids, scores) in enumerate(found):
        q = asked.points[k]
        want = sorted((-int(q @ w), j) for j, w in enumerate(x) if j != asked.ids[k])[:5]
        assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, SF)
        if k < 4:
            assert out.columns == columns, name
        rows = out.collect()
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in rows]
            assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in seen.collect()})
        if name == "ngram_jaccard_join":
            want = brute_components({r.doc_id: r.text for r in seen.collect()}, 5, 80)
            assert {r.doc_id for r in rows} == {c for _, c in want.values()}
        if name == "best_fit_packing":
            assert sum(r.n_words for r in rows) == sum(len(words(r.text)) for r in seen.collect())
        seen = spark.createDataFrame(rows, out.schema)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_without_labels_keeps_what_has_a_letter(spark):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 11), (2, "12 !", None, "s", 4), (3, None, None, "s", None), (4, "été", None, "s", 3)], SCHEMA)
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 4}


def test_pipeline_odd_and_empty_tables(spark, odd):
    for table in (odd.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            table = spark.createDataFrame((out := stage(spark, table, SF)).collect(), out.schema)


def test_pipeline_leaves_columns_of_any_name_alone(spark, odd):
    table = odd.where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        rows = out.collect()
        assert out.columns == odd.columns and rows, name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHES), name
        table = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.packing(spark, table, SF).columns == ["doc_id", "piece", "first_word", "n_words", "shard", "bin"]


def test_operators_leave_columns_of_any_name_alone(spark, odd):
    profiles = {"en": language_id._ranked(*language_id._grams("some words here", 4), 400)}
    for out, made in ((language_id.identify(odd, profiles), ("lang_pred", "score")), (toxicity.score(odd, (np.array([1 << toxicity.BITS]), np.array([-1.0]))), ("score", "predicted"))):
        assert out.columns[-2:] == list(made) and len(out.columns) == len(odd.columns) + 2
        row = next(r for r in out.collect() if r.doc_id == 11)
        assert isinstance(row.score, float) and row["__score"] == "score of 11" and row._score == "_score of 11" and row.gone_id == "gone_id of 11"


def repeats(n):
    return [(7, "same words again", "en", "s", 3)] * n + [(k, f"text number {k} of the corpus", "en", "s", 3) for k in range(1000, 1000 + n)]


def test_repeated_rows_spread_over_chunks_and_shards(spark):
    docs = spark.createDataFrame(repeats(3000), SCHEMA).repartition(5)
    shards = packing.pack(docs, shard_pieces=500).groupBy("shard").count().collect()
    assert len(shards) == 12 and max(r["count"] for r in shards) < 700
    taken = mixing.mix(docs, chunk=400).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert abs(taken.t - taken.g) <= 6


def test_mix_keeps_totals_of_documents(spark):
    """Without a bound of a source's target that binds, documents of a source come as often as its words."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(["w"] * rng.choice((1, 4, 20, 90))), "en", f"s{k % 2}", 0) for k in range(3000)], SCHEMA)
    for r in mixing.mix(docs, chunk=300).groupBy("source").agg(F.sum("copies").alias("n"), F.count("*").alias("all"), F.first("target").alias("goal"), F.first("source_size").alias("whole"), F.sum("taken").alias("t")).collect():
        assert abs(r.n - r.all * r.goal / r.whole) <= 2 and abs(r.t - r.goal) <= 0.001 * r.goal + 90


def test_packing_takes_near_copies_for_a_cluster(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (50 + k)), "en", f"s{k}", 0) for k in range(40)], SCHEMA)
    clusters = spark.createDataFrame([(k, k % 4) for k in range(40)], "doc_id long, component_id long")
    bins = collections.defaultdict(list)
    for r in packing.pack(docs, clusters=clusters).collect():
        bins[r.shard, r.bin].append(r.doc_id % 4)
    assert all(len(x) == len(set(x)) for x in bins.values()) and len(bins) == 10


def test_near_duplicates_of_a_large_group_of_near_copies_and_a_common_key(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{k}"
        texts[k] = " ".join(copy)
    for k in range(300, 500):
        texts[k] = " ".join(["the", "same", "words", "here", *(f"u{k}-{j}" for j in range(rng.choice((2, 30))))])
    df = spark.createDataFrame([*texts.items(), *[(None, texts[5])] * 50, *[(None, f"no id {k % 3} but words enough for shingles") for k in range(60)]], "doc_id long, text string")
    got = jaccard_join.near_duplicates(df, 4, 85, chunk=16).collect()
    assert len(got) == len(texts) + 110
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(texts, 4, 85)


def test_steps_grow_with_the_documents():
    assert jaccard_join.levels_of(0) == jaccard_join.levels_of(jaccard_join.DOCS) == list(jaccard_join.LEVELS)
    assert jaccard_join.levels_of(10 * jaccard_join.DOCS) == [10 * x for x in jaccard_join.LEVELS]


def test_near_duplicates_beyond_the_least_step(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DOCS", 10)
    texts = near_copies(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, 3, 60, chunk=8).collect()} == brute_components(texts, 3, 60)


def test_single_shingles_are_told_apart_however_many_documents(spark, monkeypatch):
    texts = {k: " ".join(f"w{k}-{j}" for j in range(40)) for k in range(60)}
    texts |= {100 + k: texts[k] + " end" for k in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = []
    for docs in (jaccard_join.DOCS, 10):
        monkeypatch.setattr(jaccard_join, "DOCS", docs)
        signed = jaccard_join.signed(df, 5, 80, jaccard_join.commonness(df, 5, len(texts)))
        found.append({r.doc_id: sorted(r["keys"]) for r in signed.collect()})
    assert found[0] == found[1]
    assert {k for k, keys in found[1].items() if keys} == {*range(5), *range(100, 105)}
    assert {r.doc_id for r in jaccard_join.drop_near(df).collect()} == set(range(60))


def test_op8_keys_do_not_grow_with_the_steps(spark, monkeypatch):
    texts = near_copies(3) | {1000 + k: " ".join(f"s{k}-{j}" for j in range(50)) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "DOCS", 10)
    signed = jaccard_join.signed(df, 4, 85, jaccard_join.commonness(df, 4, len(texts))).collect()
    shingles = collections.Counter(s for t in texts.values() for s in jaccard_join.Shingler(4).of(t).view(np.int64).tolist())
    assert all(shingles[k] > 1 for r in signed for k in r["keys"])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, 4, 85).collect()} == brute_components(texts, 4, 85)


def star_of_unchosen_leader(n=10):
    """Sets of words: the least class of a family links with all of it, but each of them shares more rare words with a stranger that it doesn't link with."""

    def least(make, below):
        return next(t for t in map(make, itertools.count()) if jaccard_join.class_of(jaccard_join.Shingler(1).of(t)) < below)

    def class_of(text):
        return jaccard_join.class_of(jaccard_join.Shingler(1).of(text))

    family, common = (" ".join(f"{x}{j}" for j in range(n)) for x, n in (("f", 39), ("c", 30)))
    hub = least(lambda k: f"{family} hub{k}", -(1 << 62))
    texts = {0: hub}
    for i in range(n):
        shared = " ".join(f"p{i}-{j}" for j in range(4))
        texts[1 + i] = next(t for t in (f"{hub} {shared} q{i}-{k}" for k in itertools.count()) if class_of(t) > class_of(hub))
        texts[100 + i] = least(lambda k, i=i, shared=shared: f"{shared} {common} y{i}-{k}", class_of(texts[1 + i]))
    return texts


def test_near_duplicates_read_leaders_that_none_chose(spark):
    texts = star_of_unchosen_leader()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, 1, 85)
    assert {want[k][1] for k in range(11)} == {0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, 1, 85).collect()} == want
