import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
from gleaner.llm.quality_repeats import assess  # noqa: E402
from gleaner.llm.simhash_texts import shingle_set, similar  # noqa: E402


def sample():
    en, fr = ["the", "cat", "sat", "dog", "mat", "ran", "with", "ing", "th"], ["le", "chat", "est", "sur", "une", "avec", "des", "eau", "oi"]
    rng, rows = random.Random(3), []
    for k in range(90):
        stems = en if k % 2 else fr
        text = " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(60 + k))
        rows.append((k, text, "en" if k % 2 else "fr", f"s{k % 4}" if k % 3 else None))
    rows += [(200, rows[4][1], "fr", "s1"), (201, rows[5][1], "en", "s2"), (201, rows[5][1], "en", "s2"), (202, None, "en", "s1"), (203, "", None, "s1"), (204, "too short", "en", "s3"), (205, "12 34 56 " * 40, "en", "s3"), (206, " ".join(f"{k} =" for k in range(90)), None, "s0"), (None, rows[7][1], "en", "s1")]
    return [(*r, len(r[1] or ""), 7) for r in rows]


def run(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").repartition(3)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = sample()
    out = run(spark, tmp_path, rows)
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert all(out[n].columns == columns for n in ("quality_rules", "language_id", "near_dedup", "mixing"))
    key = lambda r: str(tuple(r))
    good = [r for r in rows if assess(r[1], corpus_pipeline.RULES)[-1]]
    assert sorted(map(key, out["quality_rules"].collect())) == sorted(map(key, good))
    lettered = [r for r in good if any(c.isalpha() for c in r[1])]
    assert sorted(map(key, out["language_id"].collect())) == sorted(map(key, lettered)) and len(lettered) < len(good)
    sets = [(r[0] is None, r[0] or 0, shingle_set(r[1])) for r in lettered]
    groups = {}
    for n, i, f in sorted(sets, key=lambda x: x[:2]):
        near = {g for g, own in groups.items() if any(similar(f, o) for o in own)}
        merged = [f, *(o for g in near for o in groups.pop(g))]
        groups[min(near, default=(n, i))] = merged
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out["near_dedup"].collect()) == sorted(groups)
    kept = {r.doc_id: r for r in out["near_dedup"].collect()}
    mixed = [r.doc_id for r in out["mixing"].collect()]
    assert set(mixed) <= set(kept) and max(mixed.count(i) for i in set(mixed)) <= 3
    total = sum(len(r.text.split()) for r in kept.values())
    assert abs(sum(len(kept[i].text.split()) for i in mixed) - total) < 0.1 * total
    packed = out["packing"].collect()
    assert {r.doc_id for r in packed} == set(mixed)
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)
    assert sum(r.start == 0 for r in packed) == len(mixed)


def test_run_and_empty(spark, tmp_path):
    path = str(tmp_path / "sf")
    os.makedirs(path)
    spark.createDataFrame(sample(), "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() > 50
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_without_languages_none_is_rejected(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, str(tmp_path)).count() == 2
