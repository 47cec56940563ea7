"""The two trained models: held-out accuracy, folds, pairs of terms, and odd rows."""

import random
import re
import zlib

import numpy as np

from trackguard.llm import language as L, toxicity as X, words as W
from trackguard.llm.queries import QUERIES

import pyarrow as pa


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_rows(n):
    rng = random.Random(4)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([5, 40, 200]))
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grawlix", "Blarghead", "snortface"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500)
    docs = spark.createDataFrame([(t, i, "x", 0.5) for i, t, _ in rows] + [(None, 9001, "x", 1.0), ("", 9002, "x", 1.0), ("grawlix " * 3, None, "x", 1.0)], "text string, doc_id long, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (1, 0)], "doc_id long, toxic int")
    machine = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, machine).collect()}
    right = [got[i].predicted == y for i, _, y in rows if held(i)]
    assert sum(right) >= 0.98 * len(right) and all(got[i].held_out == held(i) for i, _, _ in rows)
    assert got[9001].score == got[9002].score and got[9001].predicted == 0 and got[None].predicted == 1 and got[None].held_out
    kept = X.reject(docs, machine)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert X.fit(docs, labels.limit(0)) is None and {r.score for r in X.score(docs, None).collect()} == {0.0}


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, "mark" if held(i) else f"other{i % 7}", int(held(i))) for i in range(300)]
    machine = X.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(machine.terms) == 0


def test_pairs_count_beyond_their_parts(spark):
    """Toxic only where insult and group meet: no additive weights separate that, the factors do."""
    rng = random.Random(1)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.choices([f"n{k}" for k in range(50)], k=8) + ["insult"] * a + ["group"] * b))
        y.append(int(a and b))
    terms = X.chosen(spark.createDataFrame(list(zip(texts, y)), "text string, label int"))
    row, term = X.present(W.texts_of(pa.array(texts)), terms)
    m = X.train(np.array(y), row, term, terms)
    score = m.score(W.texts_of(pa.array(["n1 insult group", "n1 insult", "n1 group", "n1"])))
    assert score[0] > 0.9 and score[1:].max() < 0.1


def test_factorization_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = X.Machine(np.arange(4), 0.3, rng.normal(size=4), rng.normal(size=(4, 3)))
    want = 0.3 + m.w[[0, 2, 3]].sum() + sum(m.v[a] @ m.v[b] for a, b in ((0, 2), (0, 3), (2, 3)))
    assert np.isclose(m.logits(np.zeros(3, int), np.array([0, 2, 3]), 1)[0], want)


def test_toxicity_query(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    clean = [r.predicted for r in got if labels.get(r.doc_id) == 0]
    assert sum(clean) <= 0.05 * len(clean)


def by_hand(machine, text):
    """The score, from the set of terms of one text: words, and the first bytes of longer ones."""
    numbers = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        word = word.translate(bytes(W.LOWER))
        numbers.update(X.terms_of(W.texts_of(pa.array([word.decode("utf-8")])))[0].tolist())
    place = [k for k, t in enumerate(machine.terms.tolist()) if t in numbers]
    z = machine.w0 + machine.w[place].sum() + sum(float(machine.v[a] @ machine.v[b]) for n, a in enumerate(place) for b in place[n + 1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_query_catches_held_out_documents_and_scores_each_by_its_terms(spark):
    """Of the toxic documents of the larger test tables that were not learnt most are found, and clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    toxic, clean = ([r.predicted for i, r in got.items() if r.held_out and truth.get(i) == y] for y in (1, 0))
    assert len(toxic) >= 20 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    machine = X.fit(docs, labels)                               # the same machine: fitting does not depend on how rows are dealt out
    texts = {r.doc_id: r.text for r in docs.filter("doc_id < 60").collect()}
    assert all(abs(by_hand(machine, t) - got[i].score) < 1e-9 for i, t in texts.items())


def test_one_text_per_id_is_learnt_whatever_the_order(spark):
    rows = [(i % 40, f"{w} number{i}", i % 2) for i, (_, w, _) in enumerate(toxic_rows(200))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    a, b = (X.fit(d, labels) for d in (docs.repartition(1), docs.orderBy("text", ascending=False).repartition(5)))
    assert a.terms.tolist() == b.terms.tolist() and a.w.tolist() == b.w.tolist()


def test_windows_of_a_very_long_text():
    text = "aé" * 1_500_000
    data, row = L.windows(W.texts_of(pa.array(["x", text, ""])))
    assert set(row.tolist()) == {0, 1} and data[1:].tobytes().rstrip(b"\0") == text.encode()


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = QUERIES["op3_language"](spark, sf).collect()
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and sum(right) >= 0.95 * len(right) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)


def test_odd_texts_have_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "de"), (3, "123 -- 4!", "en"), (4, "٣ 🎉", "en"), (None, "the and of the that", None), (5, "the and of the that " * 40, None)], "doc_id long, text string, lang string")
    net = L.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.held_out, r.score) for r in L.predict(odd, net).collect()}
    assert all(got[i][0] == "und" and got[i][2] == 0 for i in (1, 2, 3, 4)) and got[5][0] == "en" == got[None][0] and got[None][1]
    assert L.predict(odd.limit(0), net).collect() == [] and L.fit(odd.filter("text is null")) is None
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}


def test_tables_over_pairs_are_the_same_network():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (12, L.LENGTH)).astype(np.uint8)
    net = L.train(data, np.arange(12) % 2, ["a", "b"])
    pooled = np.concatenate([sum(f[k][data[:, k:k + data.shape[1] - len(f) + 1]] for k in range(len(f))).max(1) for f in net.filters], 1)
    want = L.softmax(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(data, net.pairs()), want, atol=1e-4) and (want.argmax(1) == np.arange(12) % 2).mean() > 0.9
