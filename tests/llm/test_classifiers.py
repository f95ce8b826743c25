import numpy as np
import pytest
from gleaner.llm.quality_cnn import CHUNK, OVERLAP, PAD, ByteCNN, CNNSettings, drawn_chunks, fit_quality, score_quality, text_chunks, train_cnn
from gleaner.llm.toxicity_pu import PUSettings, WordModel, fit_toxicity, score_toxicity, train_nnpu


def test_nnpu_finds_the_marked_feature():
    rng = np.random.default_rng(0)
    rows, positive = [], []
    for k in range(1200):
        toxic = k % 4 == 0
        rows.append(np.array(sorted({0} if toxic else set()) + [1 + int(rng.integers(5))]))
        positive.append(toxic and k % 8 == 0)  # half of the positives stay among the unlabelled
    w, b = train_nnpu(rows, [np.ones(len(r)) for r in rows], np.array(positive), 6, 0.25, PUSettings())
    g = np.array([w[r].sum() + b for r in rows])
    assert (g[::4] > 0).all() and np.mean([g[k] < 0 for k in range(1200) if k % 4]) > 0.99


def test_toxicity_edge_cases(spark):
    rows = [(k, ("you stupid idiot " if k % 5 == 0 else "a fine day ") + f"word{k} thing{k % 7} and more text here", 0) for k in range(200)] + [(None, "x", 1), (500, None, 1), (501, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 200, 2)] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(got[k].predicted == int(k % 5 == 0) for k in range(200))
    assert 0 <= got[500].score <= 1 and got[500].score == got[501].score
    assert fit_toxicity(docs, labels.limit(0)) == WordModel({}, -60.0)
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_unlabelled_texts_hold_the_known_positives(spark):
    """String ids, long and repeated texts; the bias follows the share of toxic texts among all."""
    rows = [(f"d{k}", ("awful hateful slur " if k % 10 == 0 else "a calm day ") + f"n{k} words", "x") for k in range(300)] + [("d1", "a calm day n1 words", "x"), ("long", "calm words " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, predicted string")
    labels = spark.createDataFrame([(f"d{k}", int(k % 10 == 0)) for k in range(300)], "doc_id string, toxic int")
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id != "long" and int(r.doc_id[1:]) % 10 == 0) for r in got)
    mean = sum(r.score for r in got) / len(got)
    assert 0.05 < mean < 0.2
    with pytest.raises(ValueError, match="predicted"):
        score_toxicity(docs, WordModel({}, 0.0), carry=("predicted",))


def test_fit_draws_bounded_chunks():
    s = CNNSettings()
    assert drawn_chunks("word " * 100_000, s).shape == (s.pool, CHUNK) and drawn_chunks(None, s).shape == (1, CHUNK)
    assert (drawn_chunks("word " * 900, s) == drawn_chunks("word " * 900, s)).all()


def test_chunks_cover_the_text():
    for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 5 * CHUNK + 3):
        text = "".join(chr(97 + k % 26) for k in range(n))
        chunks = text_chunks(text)
        flat = [*chunks[0], *(x for c in chunks[1:] for x in c[OVERLAP:])]
        assert bytes(int(x) for x in flat if x != PAD).decode() == text


def brute_score(net: ByteCNN, text: str) -> float:
    z = []
    for chunk in text_chunks(text):
        best = np.zeros(len(net.shift))
        for p in range(0, CHUNK - 8 + 1, 4):
            best = np.maximum(best, sum(net.embedding[chunk[p + k]] @ net.kernel[k] for k in range(8)) + net.shift)
        z.append(best)
    z = np.array(z)
    return 1 / (1 + np.exp(-(np.concatenate([z.mean(0), z.max(0)]) @ net.dense + net.bias)))


def test_scores_are_the_plain_convolution():
    rng = np.random.default_rng(1)
    net = ByteCNN(rng.normal(size=(257, 4)), rng.normal(size=(8, 4, 3)), rng.normal(size=3), rng.normal(size=6), 0.1)
    texts = ["", "abc", "Straße " * 400, "x" * 1300]
    assert np.allclose(net.score_texts(texts), [brute_score(net, t) for t in texts], atol=1e-4)


def test_training_learns():
    good = [f"plain words in line {k} go on and on " * 6 for k in range(80)]
    bad = [f"w%%% o*** r$$$ d{k} ### |||" * 8 for k in range(80)]
    net = train_cnn(good + bad, np.repeat([1.0, 0.0], 80), CNNSettings(rounds=8))
    assert (net.score_texts(good) > 0.7).all() and (net.score_texts(bad) < 0.5).all()


def test_quality_edge_cases(spark):
    rows = [(k, ("fine words here " if k % 2 else "%%% ||| ### $$$ ") * 20, 1) for k in range(60)] + [(60, None, 1), (61, "", 1), (None, "z", 1), (62, "long text " * 60_000, 1), (62, "long text " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    net = fit_quality(docs, labels, settings=CNNSettings(rounds=6))
    got = score_quality(docs, net).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert score_quality(docs.limit(0), net).count() == 0
