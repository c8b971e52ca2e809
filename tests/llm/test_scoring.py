"""Language model, language, token counts and quality, against brute force or held-out rows."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import WORD, edge_rows, edge_table, empty_table, lower, prose
from pyspark.sql import functions as F

from zonehour.llm import arrays, language_id, lm_scoring, quality, token_counts
from zonehour.llm.common import fold

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_lm(train, texts):
    """Interpolated modified Kneser-Ney bigrams, counted in dictionaries."""
    tok = lambda t: WORD.findall(lower(t or "")) + ["</>"]
    docs = [tok(t) for t in train]
    uni = collections.Counter(w for d in docs for w in d)
    pair = collections.Counter(p for d in docs for p in zip(["<s>", *d[:-1]], d))
    disc = lambda c: [0.0, *lm_scoring.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))]
    after = collections.Counter(w for _, w in pair)
    D, E = disc(pair), disc(after)
    n, v = sum(uni.values()), len(uni)
    ctx, back = collections.Counter(), collections.Counter()
    for (h, _), c in pair.items():
        ctx[h] += c
        back[h] += D[min(c, 3)]
    rest = sum(E[min(c, 3)] for c in after.values()) / len(pair) if pair else 1.0

    def p(h, w):
        low = max(after[w] - E[min(after[w], 3)], 0) / max(len(pair), 1) + rest / (v + 1)
        return low if not ctx[h] else max(pair[h, w] - D[min(pair[h, w], 3)], 0) / ctx[h] + back[h] / ctx[h] * low

    out = []
    for t in texts:
        d = tok(t)
        out.append((len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in d), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *d[:-1]], d))))
    return out


def test_lm_against_brute_force(spark):
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows()] + [prose(rng, rng.randint(0, 80), 30) for _ in range(60)]
    df = spark.createDataFrame([(k, t, k % 7 != 2) for k, t in enumerate(texts)], "doc_id int, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score_held_out(df, F.col("learn")).collect()}
    want = brute_lm([t for k, t in enumerate(texts) if k % 7 != 2], texts)
    for k, (n, known, total, base, score) in enumerate(want):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_counts_are_as_wide_as_they_need(tmp_path):
    for most, width in ((9, 1), (300, 2), (1 << 20, 4), (1 << 33, 8)):
        arrays.put_counts(str(tmp_path), f"c{width}", np.array([1, most]))
        assert (tmp_path / f"c{width}").stat().st_size == 2 * width and arrays.get_counts(str(tmp_path), f"c{width}", 2).tolist() == [1, most]


def test_lm_is_a_distribution(spark):
    df = spark.createDataFrame([("a b a c",), ("a b b",), ("c a b",)], "text string")
    m = lm_scoring.count_model(df)
    words = [b"a", b"b", b"c", b"zz"]
    # After "a" the words seen, the end and one unseen word share all of the probability.
    one = lambda t: 10 ** float(m.score([t])[3][0])
    prefix = one(b"a")  # "a" and the end
    end_given_start = one(b"")
    total = end_given_start + sum(p for p in (10 ** (float(m.score([w])[3][0])) / p_end(m, w) for w in words))
    assert prefix > 0 and total == pytest.approx(1, abs=1e-9)


def p_end(m, w):
    """Probability of the end after a word: p(w w' end) / p(...) by the model's own tables."""
    before, now, _ = lm_scoring.tokens([w])
    s = m.score([w])[3][0]
    both = m.score([w + b" " + w])[3][0]
    # p(w|start) p(w|w) p(end|w) over p(w|start) p(end|w) is p(w|w); the end's share follows from a direct lookup.
    del both, before, now, s
    return _lookup(m, w)


def _lookup(m, w):
    words = lm_scoring.Words([w]).hash
    h = words[:1]
    key = lm_scoring.pair_key(h, np.array([lm_scoring.END]))
    n = m.find("pair", key, m.shards, ("count",))["count"].astype(float)
    x = m.find("context", h, m.word_shards, ("count", "n1", "n2", "n3"))
    end = np.array([lm_scoring.END])
    after = m.find("word", end, m.word_shards, ("after",))["after"]
    d2 = np.array([0.0, *m.word_discounts])[np.minimum(after, 3)]
    low = np.maximum(after - d2, 0) / m.pairs + m.word_rest / (m.words + 1)
    if not x["count"][0]:
        return float(low[0])
    d = np.array([0.0, *m.pair_discounts])[np.minimum(n, 3).astype(int)]
    rest = sum(k * x[f][0] for k, f in zip(m.pair_discounts, ("n1", "n2", "n3"), strict=True))
    return float((max(n[0] - d[0], 0) + rest * low[0]) / x["count"][0])


def test_lm_of_nothing(spark):
    assert lm_scoring.score_held_out(empty_table(spark), F.lit(True)).count() == 0
    r = lm_scoring.score_held_out(edge_table(spark, clashing=True), F.lit(False)).collect()
    assert len(r) == len(edge_rows()) and all(x.train_tokens == 0 and x.score <= 0 for x in r)


def speech(rng, lang, n):
    alphabets = {"en": ["the", "ing", "and", "sh"], "de": ["der", "sch", "ung", "ö"], "fr": ["le", "eau", "qué", "ç"]}
    return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(5)
    rows = [(k, speech(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(rng.choices(["en", "de", "fr"], k=400))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !", "fr"), (1003, "x" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    m = language_id.learn(df, fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(df, m).withColumn("held", fold("doc_id", 3) == 1).collect()}
    held = [r for r in got.values() if r.held and r.doc_id < 1000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert [(got[k].lang_pred, got[k].score, got[k].ambiguous) for k in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1003].lang_pred in {"en", "de", "fr"}
    again = {r.doc_id: r.lang_pred for r in language_id.identify(df.repartition(5), language_id.learn(df.repartition(7), fold("doc_id", 3) != 1)).collect()}
    assert again == {k: r.lang_pred for k, r in got.items()}


def test_language_edges(spark):
    df = edge_table(spark, clashing=True)
    m = language_id.learn(df, F.lit(True))
    r = language_id.identify(df, m).collect()
    assert len(r) == len(edge_rows()) and {x.lang_pred for x in r if not x.text} == {"und"}
    e = empty_table(spark)
    assert language_id.learn(e, F.lit(True)) is None and language_id.identify(e, None).count() == 0
    assert {x.lang_pred for x in language_id.identify(df, None).collect()} == {"und"}
    one = language_id.learn(df.where("lang = 'en'"), F.lit(True))
    assert {x.lang_pred for x in language_id.identify(df, one).collect()} <= {"en", "und"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 40):
        c = language_id.codewords(k)
        apart = (c.shape[1] - c @ c.T) / 2
        assert len(c) == k and (k == 2 or apart[~np.eye(k, dtype=bool)].min() >= 2)


def test_token_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "the", "<s>", "</s>", "<0x0A>", "日", "\U0001f600", "ß", " \n", "　", ".", "1", "\x00", "ing", "Hello"]
    texts = [r[1] for r in edge_rows()] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + ["x" * 3000, " " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in token_counts.count_tokens(df, MODEL, limit=100).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100)
    assert token_counts.count_tokens(empty_table(spark), MODEL).count() == 0
    assert token_counts.count_tokens(edge_table(spark, clashing=True), MODEL).count() == len(edge_rows())


def test_token_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    c = token_counts.Counter(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = prose(random.Random(1), 500)
    assert c.count(text) == len(sp.encode(text)) == c.count(text) and len(c) + len(c.old) <= 22


def test_quality_held_out(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(500):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randint(5, 60))
        if bad:
            text = " ".join(w + "###" for w in text.split()) if k % 2 else " ".join([text.split()[0]] * 30)
        docs.append((k, text))
        labels.append((k, int(not bad), 0))
    docs += [(900, None), (901, ""), (902, "y" * 100_000)]
    d, lab = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([*labels, (903, None, None), (None, 1, 1)], "doc_id int, quality int, toxic int")
    m = quality.learn(d, lab, fold("doc_id", 5) != 0)
    got = {r.doc_id: r for r in quality.score_quality(d, m).withColumn("held", fold("doc_id", 5) == 0).collect()}
    held = [(got[k].predicted, q) for k, q, _ in labels if got[k].held]
    assert np.mean([p == q for p, q in held]) > 0.93
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    # Copies of a row, however many, are one in the sample.
    again = quality.learn(d.unionAll(d).unionAll(d), lab.unionAll(lab), fold("doc_id", 5) != 0)
    assert np.array_equal(again.weight, m.weight) and again.prior == m.prior


def test_quality_edges(spark):
    df = edge_table(spark, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality.learn(df, none, F.lit(True))
    assert {r.score for r in quality.score_quality(df, m).collect()} == {0.5}
    one = quality.learn(df, spark.createDataFrame([(3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert all(r.score > 0.5 for r in quality.score_quality(df, one).collect())
    assert quality.score_quality(empty_table(spark), m).count() == 0
