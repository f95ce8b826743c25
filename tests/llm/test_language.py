import numpy as np

from gleaner.llm import language_filters as lf
from gleaner.llm.language_filters import UNKNOWN, LanguageFilters, fit_language_filters, grams, identify_language


def keys(*texts):
    return np.unique(np.concatenate([grams(t) for t in texts]))


def test_masks_hold_every_member():
    members = {"aa": keys("lorem ipsum dolor"), "bb": keys("quick brown fox")}
    f = LanguageFilters.build(members, bits=14)
    for l, name in enumerate(f.languages):
        assert ((f.masks(members[name]) >> np.uint64(l)) & np.uint64(1)).all()
    other = np.random.default_rng(0).integers(0, 2**62, 20_000).astype(np.uint64)
    for l in range(2):
        assert abs(((f.masks(other) >> np.uint64(l)) & np.uint64(1)).mean() - f.rates[l]) < 0.01


def test_shared_gram_is_in_both():
    f = LanguageFilters.build({"aa": keys("same"), "bb": keys("same", "more")})
    assert (f.masks(keys("same")) == 3).all()


def test_fit_and_edge_cases(spark):
    rows = [(k, "the cat sat on the mat and the dog", "en") for k in range(20)] + [(100 + k, "le chat est sur la table avec le chien", "fr") for k in range(20)]
    rows += [(300, None, "en"), (301, "the mat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = fit_language_filters(docs)
    assert f.languages == ["en", "fr"]
    tests = spark.createDataFrame([(1, "the dog on the mat", 5.0), (1, "the dog on the mat", 5.0), (2, "le chien avec la table", 1.0), (3, None, 1.0), (4, "", 1.0), (5, "12 -- 34", 1.0), (None, "the cat " * 50_000, 1.0)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred) for r in identify_language(tests, f).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "fr"), (3, UNKNOWN), (4, UNKNOWN), (5, UNKNOWN), (None, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in identify_language(tests, f).collect())
    nothing = fit_language_filters(docs.limit(0))
    assert {r.lang_pred for r in identify_language(tests, nothing).collect()} == {UNKNOWN}
    assert identify_language(tests.limit(0), f).count() == 0


def test_more_languages_than_a_mask_holds(spark):
    # each language has letters of its own; the rarest would be left out of a fit of 64
    rows = [(100 * l + k, " ".join(chr(0x4E00 + 20 * l + (k + j) % 7) * 3 for j in range(12)), f"l{l:02d}") for l in range(70) for k in range(2 if l > 3 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = fit_language_filters(docs)
    assert filters.languages == sorted({r[2] for r in rows})
    got = {r.doc_id: (r.lang_pred, r.score > 0.9) for r in identify_language(docs, filters).collect()}
    assert got == {i: (l, True) for i, _, l in rows}


def test_long_texts_count_every_gram_once(monkeypatch):
    text = "Straße und Öl, the end of a line. " * 40
    whole = np.sort(lf.grams(text))
    monkeypatch.setattr(lf, "PIECE", 17)
    assert (np.sort(np.concatenate([*lf.gram_pieces(text)])) == whole).all()
