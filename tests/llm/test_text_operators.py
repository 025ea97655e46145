"""Language ID, toxicity, licenses, token counts and LM scores against brute force and held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import language_id, licenses, lm_score, token_counts, toxicity
from gridwright.llm.common import fold
from gridwright.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "Plain words, plain WORDS."), (5, "a"), (6, "12345 !!!"), (None, "no id here"), (4, "Plain words, plain WORDS."),
    (7, "x" * 300_000), (8, "word " * 60_000), (9, "Ünïcödé  ĳ ß 日本語 <|endoftext|> tail"), (10, "released under the MIT License.\n cc-by cc by"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string")).withColumn("text_key", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_language_held_out_accuracy(spark, documents):
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(documents) and {r.doc_id for r in out} == {d for d in documents if held(d) == 0}
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    profiles = {"en": language_id._ranked(*language_id._grams("plain words here", 4), 400), "xx": language_id._ranked(*language_id._grams("zzz qqq", 4), 400)}
    got = language_id.identify(odd.select("doc_id", "text", "score"), profiles).collect()
    assert len(got) == len(ODD)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[k] for k in (1, 2, 3, 6)] == ["und"] * 4 and pred[4] == "en"
    assert language_id.identify(empty(spark), profiles).count() == 0
    assert language_id.learn_profiles(empty(spark)) == {}
    assert {r.lang_pred for r in language_id.identify(odd.select("doc_id", "text"), {}).collect()} == {"und"}


def test_language_fails_on_too_many_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    assert sorted(language_id.learn_profiles(docs)) == ["l0", "l1", "l2"]
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    with pytest.raises(ValueError):
        language_id.learn_profiles(docs)


def test_long_texts_go_slice_by_slice(monkeypatch):
    text = "some words repeat and some do not " * 40
    whole = dict(zip(*map(list, language_id._grams(text, 4)), strict=True))
    monkeypatch.setattr(language_id, "_SLICE", 64)
    assert dict(zip(*map(list, language_id._grams(text, 4)), strict=True)) == whole


def test_grams_keep_edges_outside():
    keys, counts = language_id._grams("ab ab", 4)
    assert counts.sum() == 2 * 2 + 2 * 3 + 2 * 2 + 2  # a b; _a ab b_; _ab ab_; _ab_


def test_toxicity_finds_held_out_rows(spark, documents):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    out = [(rows[d].predicted, y) for d, y in labels.items() if held(d) == 0]
    assert sum(a == b for a, b in out) / len(out) > 0.96
    assert sum(a and not b for a, b in out) <= 0.01 * len(out)


def test_toxicity_odd_rows(spark, odd):
    labelled = spark.createDataFrame([(k, "you vile toad" if k % 2 else "what a fine day", k % 2) for k in range(40)] + [(None, "x", 1), (99, None, 0), (98, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.learn(labelled)
    assert len(model[0]) < 100
    got = toxicity.score(spark.createDataFrame([(1, "a vile toad"), (2, "a fine day"), (3, None)], "doc_id long, text string"), model).collect()
    assert [r.predicted for r in got[:2]] == [1, 0] and 0 <= got[2].score <= 1
    assert toxicity.score(odd.select("doc_id", "text", "score"), model).count() == len(ODD)
    none = toxicity.learn(labelled.where("doc_id < 0"))
    assert {r.score for r in toxicity.score(odd.select("doc_id", "text"), none).collect()} == {0.5}
    assert toxicity.score(empty(spark), model).count() == 0


def test_ftrl_equals_the_update_written_out():
    """Coordinate by coordinate: z and n are sums of gradients, weights the closed form with L1."""
    import numpy as np

    features = [np.array([0, 3]), np.array([1, 3]), np.array([0, 2, 3]), np.array([], np.int64)]
    labels, bits, alpha, beta, l1, l2 = [1, 0, 1, 0], 2, 0.5, 1.0, 0.05, 0.1
    got, squares = toxicity.ftrl(features, labels, bits, passes=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        least = 0.0 if i == 4 else l1 * math.sqrt(len(labels))
        if abs(z[i]) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for x, y in zip(features, labels, strict=True):
            at = [*x.tolist(), 4]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(5)]) and np.allclose(squares, [n[i] for i in range(5)])


def test_toxicity_features_and_scores_are_recomputed(spark):
    """Words, neighbours and pairs over one word, by the weights of the distinct ones."""
    import numpy as np

    features = toxicity.Features(20)
    assert len(features.of("a b c a")) == 3 + 3 + 2 and len(features.of("")) == 0
    model = (np.array([*features.of("bad word"), 1 << 20]), np.array([0.5, -0.25, 1.0, -0.1]))
    weights = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    for r in toxicity.score(spark.createDataFrame([(1, "a BAD word"), (2, "word bad word bad"), (3, None)], "doc_id long, text string"), model).collect():
        total = sum(weights.get(int(f), 0.0) for f in features.of(r.text)) - 0.1
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-6 and r.predicted == int(total >= 0)


def ranked_grams(text, size, ties=lambda key: key):
    """N-grams of letters by rank, written out: words between edges, counted, most frequent first, ties by hash."""
    import numpy as np

    found = collections.Counter()
    for word in re.sub(r"[\W\d_]+", " ", text.lower()).split():
        edged = "_" + word + "_"
        for n in range(1, 5):
            for k in range(len(edged) - n + 1):
                gram = edged[k : k + n]
                if gram != "_":
                    found[gram] += 1

    def key(gram):
        value = np.uint64(0)
        for c in gram:
            value = np.uint64((int(value) + ord(c)) * int(language_id._MIX) & (2**64 - 1))
            value ^= value >> np.uint64(29)
        return int(value) + len(gram) & (2**64 - 1)

    return [key(g) for g, _ in sorted(found.items(), key=lambda x: (-x[1], ties(key(x[0]))))][:size]


def test_language_distances_are_recomputed(spark):
    texts = {"en": "the quick brown fox and the lazy dog and the other fox", "de": "der schnelle braune fuchs und der faule hund und die anderen"}
    import numpy as np

    profiles = {lang: ranked_grams(t, 60, lambda key: key - 2**64 if key >= 2**63 else key) for lang, t in texts.items()}  # a table's longs have a sign
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    learned = language_id.learn_profiles(docs, size=60)
    assert {lang: x.tolist() for lang, x in learned.items()} == profiles
    ranker = language_id.Ranker({lang: np.array(x, np.uint64) for lang, x in profiles.items()}, size=60)
    for text in ("the dog and a fox", "und der hund", "fox und dog"):
        own = ranked_grams(text, 60)
        apart = {lang: sum(abs(p.index(g) - k) if g in p else 60 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=lambda lang: apart[lang])
        assert ranker.predict(text) == (best, 1 - apart[best] / (60 * len(own)))


def license_rows(rows):
    out = {}
    for key, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        found = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        out[key] = (len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))
    return out


def test_license_base_equals_brute_force(spark, odd, documents):
    texts = [(d, r.text) for d, r in documents.items()]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op3_license_scan"](spark, SF).collect()}
    assert got == license_rows(texts)
    rows = licenses.scan(odd).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == license_rows(ODD) and len(rows) == len(ODD)
    assert licenses.scan(empty(spark)).count() == 0


def test_license_templates_are_found_where_they_stand(spark):
    body = dict(licenses.TEMPLATES[::-1])["mit"], licenses.TEMPLATES[7][1]
    noisy = body[1].split()
    noisy[5:6] = []
    noisy[9] = "altered"
    docs = spark.createDataFrame([(1, "head words " + body[0].upper() + " tail"), (2, "one two " + " ".join(noisy)), (3, " ".join(reversed(body[1].split())))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert "mit" in got[1].labels and got[2].labels == "bsd" and got[2].spans[0].first <= 3 and got[3].labels == ""
    assert 0.8 <= got[2].score < 1


def test_license_templates_are_found_with_scattered_and_inserted_words(spark):
    isc = dict(licenses.TEMPLATES)["isc"].split()
    scattered = ["other" if k in (4, 9, 14, 19, 24, 29) else w for k, w in enumerate(isc)]
    docs = spark.createDataFrame([(1, "head " + " ".join(scattered) + " tail"), (2, " ".join(isc[:17] + ["put", "in", "the", "very", "middle"] + isc[17:]))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].labels, got[2].labels, got[2].score) == ("isc", "isc", 1.0) and 0.8 <= got[1].score < 1
    assert (got[2].spans[0].first, got[2].spans[0].end) == (0, len(isc) + 5)


def test_license_spans_are_bounded_by_the_template(spark):
    mpl = dict(licenses.TEMPLATES)["mpl"].split()
    third = len(mpl) // 3
    scraps = " ".join(w for part in (mpl[:third], mpl[third : 2 * third], mpl[2 * third :]) for _ in range(100) for w in part)
    twice = " ".join([*mpl, *["filler"] * 40, *mpl])
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, scraps), (2, twice), (3, " ".join(mpl * 5))], "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score, got[1].spans) == ("", 0.0, [])
    assert [(s.first, s.end) for s in got[2].spans] == [(0, len(mpl)), (len(mpl) + 40, 2 * len(mpl) + 40)]
    assert got[3].labels == "mpl" and all(s.end - s.first <= 2 * len(mpl) for s in got[3].spans) and len(got[3].spans) >= 3


def test_token_counts_equal_the_library(spark, odd, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = QUERIES["op10_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {d: (len(r.text.encode()), count(r.text), count(r.text) > 512) for d, r in documents.items()}
    strange = ODD + [(20, "a  b   c\n d \n\n e"), (21, "  lead"), (22, "trail  "), (23, "tab\tand   wide"), (24, "it's we'll 'tis"), (25, "a <|endoftext|><|endoftext|> b"), (26, "\x1c a \x85 b"), (27, " ")]
    df = spark.createDataFrame(strange, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df).collect()) == sorted((str(k), count(t)) for k, t in strange)
    assert token_counts.count_tokens(odd).count() == len(ODD) and token_counts.count_tokens(empty(spark)).count() == 0


def test_chunks_join_to_the_text():
    for text in ("a b c", "a  b", " a", "a ", "a \n b", "\n", "a\nb c", "x   y z  "):
        chunks = token_counts.Encoder.chunks(text)
        assert " ".join(chunks) == text and all(c and not c[0].isspace() for c in chunks[1:])


def base_scores(texts):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"] for k, t in texts.items()}
    counts = collections.Counter(w for k, ws in words.items() if held(k) != 1 for w in ws)
    n, size = sum(counts.values()), len(counts)
    return {k: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (size + 1))) for w in ws)) for k, ws in words.items()}


def test_lm_base_equals_brute_force_and_the_model_beats_it(spark, documents):
    want = base_scores({d: r.text for d, r in documents.items()})
    rows = {r.doc_id: r for r in QUERIES["op1_lm_score"](spark, SF).collect()}
    for d, (n, known, total, base) in want.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(d) == 1)
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_counts_join_for_words_that_are_not_looked_up(spark, monkeypatch):
    monkeypatch.setattr(lm_score.learn_vocabulary, "__defaults__", (3,))
    texts = {k: f"alpha beta w{k % 7} w{k}" for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = base_scores(texts)
    for r in lm_score.score_texts(df, fold() != 1).collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-9
        assert math.isfinite(r.score) and r.score < 0


def test_lm_chances_sum_to_one_after_any_history():
    """Recomputed from the weights, word by word: the softmax's words and the rare classes share all of the chance."""
    import numpy as np

    words = [b"w%d" % k for k in range(70)] + [lm_score.END]
    v = lm_score.Vocabulary(1000, 90, {w: k for k, w in enumerate(words)}, np.arange(len(words), 0, -1), np.arange(lm_score.RARE) + 1.0, np.ones(lm_score.RARE))
    model, reader = lm_score.unigram_model(v), lm_score.Reader(v)
    texts = ["w1 w2 w40", "w3 w2 w7 unseen w9", "w1 w5 w69 w2"]
    lm_score.train_pass(iter([[reader.ids(lm_score.tokens_of(t)) for t in texts]] * 20), reader, model)
    scorer = lm_score.Scorer(v, model)
    for before in ("", "w1 ", "w3 w2 ", "unseen w9 "):
        base = scorer.of([before + "w0"])[0][3] - 0
        ids = reader.ids(lm_score.tokens_of(before + "w0"))[:-1]
        _, for_class, _ = reader.arrays([ids])
        logits = model.of_class[for_class[:, -1]].sum(axis=0) + model.class_bias
        of_class = np.exp(logits) / np.exp(logits).sum()
        total = of_class[v.n_classes :].sum()
        for k in range(v.in_softmax):
            own = reader.ids([*lm_score.tokens_of(before)[:-1], words[k]])
            _, _, for_member = reader.arrays([own])
            c = v.classes[k]
            logits = model.of_member[for_member[:, -1]].sum(axis=0) + model.member_bias[c]
            total += of_class[c] * np.exp(logits[k // v.n_classes]) / np.exp(logits).sum()
        assert abs(total - 1) < 1e-3 and math.isfinite(base)
        chance = [math.log10(of_class[v.classes[0]])]
        _, _, for_member = reader.arrays([ids])
        logits = model.of_member[for_member[:, -1]].sum(axis=0) + model.member_bias[v.classes[0]]
        chance.append(math.log10(np.exp(logits[0]) / np.exp(logits).sum()))
        whole, shorter = (scorer.of_ids([x])[0][2] for x in (ids, ids[:-1])) if len(ids) > 1 else (scorer.of_ids([ids])[0][2], 0.0)
        assert abs(whole - shorter - sum(chance)) < 1e-3


def test_lm_scores_do_not_depend_on_the_tables_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(lm_score, "TOKENS_PER_ROW", 1)
    rows = [(r.doc_id, r.text) for r in documents.values()][:400]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = ({r.doc_id: r.score for r in lm_score.score_texts(df.repartition(n), fold() != 1).collect()} for n in (1, 7))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 * abs(one[k]) + 1e-9 for k in one)


def trained(words, texts, rounds=400):
    import numpy as np

    v = lm_score.Vocabulary(len(words), len(words), {w: k for k, w in enumerate(words)}, np.ones(len(words), np.int64), np.zeros(lm_score.RARE), np.zeros(lm_score.RARE))
    model = lm_score.unigram_model(v)
    reader = lm_score.Reader(v)
    lm_score.train_pass(iter([[reader.ids(lm_score.tokens_of(t)) for t in texts] for _ in range(rounds)]), reader, model)
    return lambda text: lm_score.Scorer(v, model).of([text])[0][3]


def test_lm_classes_go_by_both_words_before():
    score = trained([b"a", b"b", b"x", b"y", b"p", b"q", lm_score.END], ["a x p", "b x q", "a y q", "b y p"])
    assert score("a x p") - score("a x q") > 0.5 and score("b x q") - score("b x p") > 0.5


def test_lm_members_go_by_the_skipped_word():
    words = [b"s", *(b"w%d" % k for k in range(lm_score.CLASSES - 1)), b"t", b"a", b"b", b"x", lm_score.END]
    score = trained(words, ["a x s", "b x t"])
    assert score("a x s") - score("a x t") > 0.5 and score("b x t") - score("b x s") > 0.5


def test_lm_grows_with_tokens_and_words():
    import numpy as np

    assert lm_score.rows_of(1) == lm_score.rows_of(lm_score.TOKENS) == lm_score.ROWS and lm_score.rows_of(64 * lm_score.TOKENS) == 8 * lm_score.ROWS
    assert lm_score.shape_of(16 * lm_score.VOCABULARY) == (2 * lm_score.CLASSES, 2 * lm_score.MEMBERS, 2 * lm_score.RARE)
    words = [b"w%d" % k for k in range(10_000)]
    v = lm_score.Vocabulary(64 * lm_score.TOKENS, 16 * lm_score.VOCABULARY, {w: k for k, w in enumerate(words)}, np.ones(len(words), np.int64), np.zeros(32), np.zeros(32))
    model = lm_score.unigram_model(v)
    assert v.in_softmax == 4 * lm_score.CLASSES * lm_score.MEMBERS and len(model.of_class) == len(model.of_member) == 8 * lm_score.ROWS
    reader = lm_score.Reader(v)
    lm_score.train_pass(iter([[reader.ids(lm_score.tokens_of("w1 w9000 new w8191"))]]), reader, model)
    n, known, _, score, missing = lm_score.Scorer(v, model).of(["w1 w9000 new w8191"])[0]
    assert (n, known, missing) == (5, 3, [b"new", lm_score.END]) and math.isfinite(score)


def test_lm_histories_tell_words_apart_that_are_not_looked_up():
    score = trained([b"p", b"q", lm_score.END], ["uno p", "duno q"])
    assert score("uno p") - score("uno q") > 0.5 and score("duno q") - score("duno p") > 0.5


def test_lm_missing_words_come_once_a_text(spark):
    docs = spark.createDataFrame([(1, "a new a new old"), (2, "")], "doc_id long, text string").withColumn("learned_from", F.lit(True))
    v = lm_score.Vocabulary(9, 3, {b"a": 0, lm_score.END: 1}, np.array([5, 4]), np.zeros(lm_score.RARE), np.zeros(lm_score.RARE))
    got = {r.doc_id: {bytes(k): n for k, n in r.missing.items()} for r in lm_score.read_ids(docs, v, lm_score.ROWS).collect()}
    assert got == {1: {b"new": 2, b"old": 1}, 2: {}}


def test_lm_vocabulary_equals_a_full_sort(spark):
    rng = random.Random(4)
    counts = {bytes(rng.choice(b"abcxyz") for _ in range(rng.randint(1, 5))): rng.choice((1, 1, 1, 2, 2, 3, 9)) for _ in range(400)}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    for most in (0, 1, 7, len(counts) // 2, len(counts), 1000):
        assert lm_score.most_frequent(df, most) == [(w, counts[w]) for w in ranked[:most]]
    v = lm_score.learn_vocabulary(df, 5)
    assert (v.n, v.size, list(v.places)) == (sum(counts.values()), len(counts), ranked[:5])
    for k in range(v.rare):
        own = [w for w in ranked[5:] if lm_score.rare_class(w) == lm_score.CLASSES + k]
        assert (v.rare_n[k], v.rare_size[k]) == (sum(counts[w] for w in own), len(own))


def test_lm_reads_texts_in_arrays_as_word_by_word(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [None, "", " \t\n", " A\x0bb\x0cC\rend", "\x1cx\x85 \u3000É é", "new a new OLD a", "\x00 a", "w" * 5000, "a b " * 700]
    words = [lm_score.tokens_of(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    monkeypatch.setattr(lm_score, "HEAP", 1000)
    parts = list(lm_score.heaps(iter([batch, batch.slice(2, 0)]), 0))
    assert len(parts) == 3 and pa.Table.from_batches(parts).column(0).to_pylist() == texts
    for looked_up in ([b"a", b"b", lm_score.END], [b"\xc3\x89"], []):
        v = lm_score.Vocabulary(9, 4, {w: k for k, w in enumerate(looked_up)}, np.ones(len(looked_up)), np.zeros(lm_score.RARE), np.zeros(lm_score.RARE))
        reader = lm_score.Reader(v)
        got = [x for part in parts for x in zip(*(column.to_pylist() for column in reader.read(part.column(0))), strict=True)]
        for (n, ids, missing), ws in zip(got, words, strict=True):
            assert n == len(ws) and np.frombuffer(ids, np.int32).tolist() == reader.ids(ws).tolist()
            assert dict(missing) == collections.Counter(w for w in ws if w not in looked_up)
    monkeypatch.setattr(lm_score, "_FLUSH", 2)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    assert {bytes(r.word): r.n for r in lm_score.count_words(df).collect()} == collections.Counter(w for ws in words for w in ws)
    assert lm_score.count_words(df.limit(0)).count() == 0


def test_lm_scores_at_the_bound_are_sums_of_weights():
    import numpy as np

    words = [b"w%d" % k for k in range(5000)] + [lm_score.END]
    v = lm_score.Vocabulary(10**9, 90, {w: k for k, w in enumerate(words)}, np.ones(len(words)), np.ones(lm_score.RARE), np.ones(lm_score.RARE))
    model, text = lm_score.unigram_model(v), "w1 w4999 w2 w3 w1"
    rng = np.random.default_rng(3)
    for weights in (model.of_class, model.of_member):
        weights[:] = rng.choice([-lm_score.BOUND, lm_score.BOUND], weights.shape)
    weights, of_member = model.of_class, model.of_member
    weights[:, 1:] = lm_score.BOUND
    weights[:, 0] = -lm_score.BOUND
    scorer = lm_score.Scorer(v, model)
    ids, want = scorer.reader.ids(lm_score.tokens_of(text)), 0.0
    joined, for_class, for_member = scorer.reader.arrays([ids])
    for j, (word, c) in enumerate(zip(joined, scorer.reader.class_of(joined), strict=True)):
        logits = weights[for_class[:, j]].sum(axis=0, dtype=float) + model.class_bias
        want += logits[c] - np.logaddexp.reduce(logits)
        if word < v.in_softmax:
            logits = of_member[for_member[:, j]].sum(axis=0, dtype=float) + model.member_bias[c]
            want += logits[word // v.n_classes] - np.logaddexp.reduce(logits)
        else:
            want += math.log(1.5) - math.log(10) * v.log_rare[c - v.n_classes]
    got = scorer.of([text])[0][3]
    assert math.isfinite(got) and abs(got - want / math.log(10)) < 1e-5 * abs(got)


def test_lm_odd_rows(spark, odd):
    got = lm_score.score_texts(odd, fold() != 1).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.base_score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm_score.score_texts(empty(spark), fold() != 1).count() == 0
    alone = lm_score.score_texts(odd.select("doc_id", "text"), F.lit(False)).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}
