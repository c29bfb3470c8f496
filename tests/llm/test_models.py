import zlib

import numpy as np
import pytest

from tessera.llm import language_id as L
from tessera.llm import quality_rff as Q

SMALL = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_held_out(spark):
    got = L.op4_language_id(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    j = got.merge(truth, on="doc_id")
    assert len(j) == len(truth) and list(j.held_out) == [held(i) for i in j.doc_id] and j.score.between(0, 1).all()
    assert (j.lang_pred == j.lang)[j.held_out].mean() > 0.97


def test_language_edges(spark):
    model = L.train(["the cat and the dog"] * 30 + ["el perro y la gata"] * 30, ["en"] * 30 + ["es"] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the dog", "x"), (4, "the dog", "x"), (5, "la gata " * 30_000, "x"), (None, "日", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in L.identify(d, model).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, "und", True) for i in (1, 2, 3)]
    assert got.count((4, "en", False)) == 2 and (5, "es", False) in got
    kept = L.drop_rejected(d, model).collect()
    assert {r.doc_id for r in kept} >= {4, 5} and kept[0].lang_pred == "x" and L.identify(d.limit(0), model).count() == 0
    assert L.train([], []).score("abc") == ("und", 0.0) or L.train([], []).languages == ["und"]


def test_quality_held_out(spark):
    got = Q.op6_quality(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    j = got.merge(truth, on="doc_id")
    assert (j.predicted == (j.score >= 0.3)).all() and j.score.between(0, 1).all() and list(got.held_out) == [held(i) for i in got.doc_id]
    t = j[j.held_out]
    assert (t.predicted == t.quality).mean() > 0.9
    bad = t[t.quality == 0].score.to_numpy()[:, None]
    assert (t[t.quality == 1].score.to_numpy()[None, :] > bad).mean() > 0.95


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a b", 0.0), (3, "a " * 50_000, 0.0), (3, "a " * 50_000, 0.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    described = Q.describe(d)
    got = Q.score(described, Q.fit(Q.training_rows(described, labels))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(Q.describe(d.limit(0)), Q.fit(Q.training_rows(described.limit(0), labels))).count() == 0


def test_isotonic_pools():
    at, share = Q.isotonic(np.array([0.0, 1, 2]), np.array([2.0, 0, 3]), np.array([4.0, 4, 4]))
    assert list(at) == [0.5, 2.0] and share[0] < share[1]


def test_sample_does_not_follow_the_order_of_the_table(spark):
    rows = [(1000 * k + i, f"text {i} of {k}", f"l{k}") for k in range(7) for i in range(400)] + [(9000, "only one", "l8"), (9001, "and two", "l8"), (9002, "and three", "l8")]
    forward = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    backward = spark.createDataFrame(rows[::-1], "doc_id bigint, text string, lang string").repartition(3)
    got = sorted(map(tuple, L.sample(forward, rows=80).collect()))
    assert got == sorted(map(tuple, L.sample(backward, rows=80).collect()))
    few = sum(not held(i) for i in (9000, 9001, 9002))
    assert {k: [g[1] for g in got].count(k) for k in {g[1] for g in got}} == {**{f"l{k}": 10 for k in range(7)}, "l8": few}
    one, two = L.fit(forward, rows=80), L.fit(backward, rows=80)
    assert (one.logits == two.logits).all() and one.languages == two.languages and one.threshold == two.threshold
    assert L.sample(forward.limit(0)) is None
    with pytest.raises(ValueError):
        L.sample(forward, max_languages=7)


def test_without_labels_only_texts_without_letters_go(spark):
    d = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id bigint, text string, lang string")
    model = L.fit(d)
    assert [r.doc_id for r in L.drop_rejected(d, model).collect()] == [1]
    assert {r.lang_pred for r in L.identify(d, model).collect()} == {"und"}


def test_rejection_threshold():
    p = np.array([[0.9, 0.1]] * 600 + [[0.4, 0.3], [0.45, 0.3]])
    assert L.rejection_threshold(p, np.zeros(602, int)) == 0.45  # one of 602 right answers may be refused
    assert L.rejection_threshold(p[:600], np.zeros(600, int)) == L.LEAST_SCORE == L.rejection_threshold(p, np.ones(602, int))


def test_only_letters_count():
    assert L.clean("Été – «OUI» 12…") == "été    oui  12 ".encode() and list(L.subwords(L.clean("a—b"))) == list(L.subwords(b"a b"))
    assert not L.has_letter("— «» 12") and len(L.subwords(L.clean("— «» 12"))) == 0


def plain_subwords(text, buckets, ngrams):
    """Every n-gram by itself, in whole numbers."""
    letters = [c if 97 <= c < 123 or c >= 128 else 32 for c in L.clean(text)]
    squeezed = [c for i, c in enumerate(letters) if c != 32 or i == 0 or letters[i - 1] != 32]
    if all(c == 32 for c in squeezed):
        return []
    x, out = [32, *squeezed, 32], []
    for n in ngrams:
        for i in range(len(x) - n + 1):
            h = 0
            for c in x[i : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            m = (h ^ (n * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
            out.append((m ^ (m >> 15)) % buckets)
    return out


WORDS = {"en": "the cat and dog of house with some water".split(), "de": "der hund und katze von haus mit etwas wasser über".split(), "fr": "le chat et chien de maison avec été l'eau".split()}


def small_corpus(n):
    rng = np.random.default_rng(4)
    labels = [list(WORDS)[i % 3] for i in range(n)]
    return [" ".join(rng.choice(WORDS[k], rng.integers(1, 12))) for k in labels], labels


def test_subwords_against_brute_force():
    for text in [*small_corpus(30)[0], "É! ß", "a", " \n ", "x" * 300, "日本語 text", "don't-stop 12"]:
        assert sorted(L.subwords(L.clean(text)).tolist()) == sorted(plain_subwords(text, L.BUCKETS, L.NGRAMS))


def test_training_and_scores_against_a_dense_version(monkeypatch):
    """The same descent over dense rows of n-gram shares: every bucket in every step, sums written out."""
    monkeypatch.setattr(L, "BUCKETS", 256)
    monkeypatch.setattr(L, "EPOCHS", 6)
    texts, labels = small_corpus(80)
    got = L.train(texts, labels, seed=3)
    x = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        found = plain_subwords(t, 256, L.NGRAMS)
        for k in found:
            x[i, k] += 1 / len(found)
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(3)
    order = rng.permutation(len(texts))
    held, kept = order[:16], order[16:]
    table = rng.normal(0, 0.1, (256, L.DIMENSIONS)).astype(np.float32).astype(np.float64)
    weights = rng.normal(0, 0.1, (L.DIMENSIONS, 3)).astype(np.float32).astype(np.float64)
    bias = np.zeros(3)
    soft = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for epoch in range(6):
        rng.shuffle(kept)
        for at in range(0, len(kept), L.BATCH):
            part = kept[at : at + L.BATCH]
            step = L.RATE * (1 - epoch / 6) / len(part)
            hidden = x[part] @ table
            error = soft(hidden @ weights + bias) - np.eye(3)[y[part]]
            back = error @ weights.T
            weights, bias, table = weights - step * hidden.T @ error, bias - 0.1 * step * error.sum(0), table - step * 8 * x[part].T @ back
    assert got.languages == names and np.allclose(got.logits, table @ weights, atol=2e-3) and np.allclose(got.bias, bias, atol=2e-3)
    z = x @ table @ weights + bias
    nll = {t: -np.log(soft(z[held] / t)[np.arange(16), y[held]]).mean() for t in np.geomspace(0.25, 16, 49)}
    assert nll[min(nll, key=lambda t: abs(t - got.temperature))] == pytest.approx(min(nll.values()), abs=1e-3)
    p = soft(z / got.temperature)
    for text, row in zip(texts, p, strict=True):
        language, score = got.score(text)
        assert score == pytest.approx(row.max(), abs=5e-3) and (language == names[row.argmax()] or np.ptp(np.sort(row)[-2:]) < 0.01)


def test_quality_fit_against_one_dense_fit(spark):
    """Normal equations summed over partitions, calibration bins and scores against numpy on all rows at once."""
    rng = np.random.default_rng(2)
    n, width = 500, len(Q.STATISTICS)
    stats = rng.normal(size=(n, width)) * np.arange(1, width + 1) + 3
    label = (stats[:, 0] + 0.3 * stats[:, 1] + rng.normal(size=n) > 3.5).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(k)) for s, k in zip(stats, label, strict=True)], "stats array<double>, label int").repartition(7)
    got = Q.fit(rows)
    marked = rows.select("stats", "label", (Q.F.pmod(Q.F.xxhash64("stats"), Q.F.lit(5)) == 0).alias("aside")).toPandas()
    x, y, aside = np.stack(marked["stats"].to_numpy()), marked["label"].to_numpy(float), marked["aside"].to_numpy()
    assert n >= Q.LEAST_ROWS and 50 < aside.sum() < 150
    mean, sd = x[~aside].mean(0), x[~aside].std(0)
    draw = np.random.default_rng(Q.SEED)
    directions, phase = draw.normal(0, 1 / Q.WIDTH, (width, Q.FEATURES)), draw.uniform(0, 2 * np.pi, Q.FEATURES)
    features = lambda s: np.hstack([np.sqrt(2 / Q.FEATURES) * np.cos(np.clip((s - mean) / sd, -8, 8) @ directions + phase), np.ones((len(s), 1))])
    phi = features(x[~aside])
    penalty = np.diag([Q.RIDGE * len(phi) / Q.FEATURES] * Q.FEATURES + [1e-9])
    weights = np.linalg.lstsq(phi.T @ phi + penalty, phi.T @ y[~aside], rcond=None)[0]
    assert np.allclose(got.mean, mean) and np.allclose(got.sd, sd) and np.allclose(got.raw(x), features(x) @ weights, atol=1e-6)
    raw = features(x[aside]) @ weights
    bins = np.clip(np.floor((raw + 0.5) / 2 * Q.BINS), 0, Q.BINS - 1)
    at = np.array([raw[bins == b].mean() for b in np.unique(bins)])
    ones, total = (np.array([f(y[aside][bins == b]) for b in np.unique(bins)]) for f in (np.sum, len))
    # Isotonic regression as the largest of the least means: no pooling.
    share = [max(min(ones[i : k + 1].sum() / total[i : k + 1].sum() for k in range(j, len(at))) for i in range(j + 1)) for j in range(len(at))]
    pools = [np.flatnonzero(np.isclose(share, s)) for s in dict.fromkeys(np.round(share, 12))]
    edges = [(at[p] * total[p]).sum() / total[p].sum() for p in pools]
    values = [(ones[p].sum() + 0.5) / (total[p].sum() + 1) for p in pools]
    assert np.allclose(got.edges, edges) and np.allclose(got.values, values)
    assert np.allclose(got.score(x), np.clip(np.interp(features(x) @ weights, edges, values), 0, 1), atol=1e-6)
