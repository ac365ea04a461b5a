"""Language, quality and toxicity models: held-out accuracy and edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import crf, langid, queries, toxicity

SF = "/root/testdata/sf0.01"
LONG = "the line goes on and on. " * 20_000 + "\n" + "x" * 100_000
EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, "123 !!"), (5, "123 !!"), (None, "Some words, as usual.")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*e, "a", "b", 3) for e in EDGES], "doc_id long, text string, SCORE string, lang_pred string, __text int")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    told = queries.op5(spark, SF).where("held_out").join(docs, "doc_id")
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    assert told.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(None, "x", "en", "s", 1), (9999, None, "en", "s", 1), (9998, "abc", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    prototypes = langid.train(docs)
    assert sorted(prototypes) == ["de", "en", "es", "fr"]
    out = langid.predict(edges, prototypes, keep_text=True)
    assert out.columns == ["doc_id", "text", "__text", "lang_pred", "score"]
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == len(EDGES)
    for key in ((1, None), (2, ""), (3, "\n\n"), (5, "123 !!")):
        assert rows[key].lang_pred == "und" and rows[key].score == 0
    assert rows[(4, LONG)].lang_pred == "en"
    nothing = langid.predict(edges, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.predict(edges.limit(0), prototypes).count() == 0


def test_quality_held_out(spark):
    told = queries.op2(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert told.where("quality = predicted").count() >= 0.95 * told.count()
    good, bad = (told.where(F.col("quality") == q).agg(F.avg("score")).first()[0] for q in (1, 0))
    assert good > bad + 0.7


def test_quality_edges(spark, edges):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 1, 0), (3, 0, 0)], labels.schema)
    field = crf.train(docs, labels.union(more))
    out = crf.score(edges, field)
    assert out.columns == ["doc_id", "lang_pred", "__text", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == pytest.approx(field.prior) for r in rows if r.doc_id in (1, 2, 3))
    blank = crf.score(edges, crf.train(docs, labels.limit(0)))
    assert all(r.score == 0.5 and r.predicted == 0 for r in blank.collect())
    assert crf.score(edges.limit(0), field).count() == 0


def test_training_takes_one_text_of_a_repeated_id(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic")
    some = [rows.where(F.col("quality") == q).orderBy("doc_id").limit(40).collect() for q in (0, 1)]
    hot, texts = some[0][0], [r.text for r in some[0] + some[1]]
    docs = [(r.doc_id, r.text) for r in some[0][:4] + some[1][:4]]
    labels = [(r.doc_id, r.quality, r.toxic) for r in some[0][:4] + some[1][:4]]
    many = [(hot.doc_id, f"{t}\n{i}") for i in range(5) for t in texts]
    first = min([t for i, t in many + docs if i == hot.doc_id], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, one = frame(many + docs), frame([(hot.doc_id, first), *docs[1:]])
    a, b = (crf.train(d, told, per_label=4) for d in (whole, one))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
    a, b = (toxicity.train(d, told, queries.TOXIC_CHAIN, per_label=4) for d in (whole, one))
    assert all(np.array_equal(x.weights, y.weights) and x.intercept == y.intercept for x, y in zip(a, b, strict=True))


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(1)
    emit, moves, first = rnd.normal(size=9), rnd.normal(size=(2, 2)), np.array([0, 1, 5, 9])
    good, expected, total = crf.forward_backward(emit, first, moves)
    pairs = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        weight, on, here = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(emit[a + i] for i in range(b - a) if path[i]) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            weight += w
            on += w * np.array(path)
            for x, y in itertools.pairwise(path):
                here[x, y] += w
        assert np.allclose(good[a:b], on / weight) and np.isclose(total[d], np.log(weight))
        pairs += here / weight
    assert np.allclose(expected, pairs)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    told = queries.op7(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    toxic, clean = told.where("toxic = 1"), told.where("toxic = 0")
    assert toxic.where("is_toxic").count() >= 0.85 * toxic.count()
    assert clean.where("is_toxic").count() <= 0.01 * clean.count()


def test_toxicity_edges(spark, edges):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema)), queries.TOXIC_CHAIN)
    assert [m.name for m in chain] == ["low_quality", "toxic"] and len(chain[1].earlier) == 1
    out = toxicity.score(edges, chain)
    rows = out.collect()
    assert len(rows) == len(EDGES) and all(0 <= r.p_toxic <= 1 for r in rows)
    for none in (toxicity.train(docs, labels.limit(0), queries.TOXIC_CHAIN), toxicity.train(docs.limit(0), labels, queries.TOXIC_CHAIN)):
        assert {(r.p_toxic, r.is_toxic) for r in toxicity.score(edges, none, threshold=0.5).collect()} == {(0.5, False)}
    assert toxicity.score(edges.limit(0), chain).count() == 0


def test_language_vectors_like_a_plain_bundle():
    """Hypervectors against three-grams bound and summed one by one."""
    import pyarrow as pa

    profiles = langid.Profiles(256)
    texts = ["Ab c", "ééé zz!", "a", "xy", "", None, "12 34", "the quick brown fox, THE QUICK", "漢字かな漢", "a1b2c3 " * 50]
    vectors, has, counts = profiles.vectors(pa.array(texts))
    for i, t in enumerate(texts):
        letters = [int(profiles.symbol[ord(c)]) for c in (t or "").lower()]
        kept = [s for j, s in enumerate(letters) if j == 0 or s or letters[j - 1]]  # a run of other characters is one gap
        grams = [kept[j:j + 3] for j in range(len(kept) - 2)] or ([(kept + [0, 0])[:3]] if kept else [])
        want = np.zeros(256)
        for a, b, c in grams if any(kept) else []:
            want += np.roll(profiles.letters[a], 2).astype(float) * np.roll(profiles.letters[b], 1) * profiles.letters[c]
        assert np.array_equal(vectors[i], want), t
        assert has[i] == any(kept) and counts[i] == max(0, len(kept) - 2)


def test_language_sample_draws_rows(spark):
    """A language whose rows all repeat one id is learned by a share of its texts, not all or none."""
    rows = [(7, f"una casa {i} blanca y otra {i * 7} mesa", "es") for i in range(400)] + [(1000 + i, f"the house {i} is white and the table {i * 3}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    prototypes = langid.train(docs, per_language=40)
    assert sorted(prototypes) == ["en", "es"]
    told = langid.predict(docs.select("doc_id", "text", "lang"), prototypes)
    assert told.where("lang <> lang_pred").isEmpty()
