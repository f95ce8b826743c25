from collections import defaultdict

import numpy as np
from gleaner.llm.mixing_tree import QUOTAS, MixSettings, first_fit, mix_sources, mixture, plan_sources, share_targets, split_quotas


def test_targets_stop_and_reshare():
    assert share_targets([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    t = share_targets([1000, 10, 10], [1, 2, 3], 3)
    assert t == [960, 30, 30]
    assert share_targets([0, 0], [1, 2], 3) == [0, 0] and share_targets([], [], 3) == []


def test_sources_in_code_point_order_with_null_last():
    s = plan_sources([(None, 10), ("b", 10), ("B", 10), ("é", 10)], MixSettings())
    assert [x.name for x in s] == ["B", "b", "é", None]


def test_tree_is_exact_and_disjoint():
    quotas = np.array([5, 0, 17, 1000])
    for shards in (1, 2, 7, 16):
        own = split_quotas(quotas, shards, 1)
        assert (own.sum(0) == quotas).all() and (own >= 0).all()
        assert own.sum(1).max() - own.sum(1).min() <= 4
        assert (own == split_quotas(quotas, shards, 1)).all()


def test_first_fit():
    assert first_fit([5, 4, 3], 8) == [True, False, True]
    assert first_fit([10], 6) == [True] and first_fit([10], 5) == [False] and first_fit([], 3) == []
    assert first_fit([5, 9, 30], 12) == [True, True, False] and first_fit([50, 57, 58, 300], 58) == [False, False, True, False]


def rows():
    rng, out = np.random.default_rng(0), []
    for k in range(900):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        out.append((k, " ".join(["w"] * int(rng.integers(1, 60))), source, 1))
    return out + [(2000, None, "s1", 1), (2001, "", None, 1), (2002, "a b c", None, 1), (None, "x y", "s1", 1), (5, "twin row", "s2", 1), (5, "twin row", "s2", 1), (2003, "w " * 5000, "big", 1), (2004, None, "empty", 1)]


def test_mix(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int").repartition(5)
    settings = MixSettings(block_words=500, shard_words=2000)
    got = mix_sources(docs, settings, carry=("source",)).collect()
    assert len(got) == len(rows())
    assert all(r.taken == r["size"] * len(r.copies) and len(r.copies) <= 3 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(r["size"] for r in got)
    want = {s.name: s for s in plan_sources([(k, sum(r["size"] for r in v)) for k, v in by.items()], settings)}
    for name, own in by.items():
        assert {(r.source_size, r.target) for r in own} == {(want[name].words, want[name].target)}
        assert abs(sum(r.taken for r in own) - want[name].target) <= 30 or name == "big"
    assert abs(sum(s.target for s in want.values()) - total) < 1e-6
    shards = [c.shard for r in got for c in r.copies]
    assert len(set(shards)) > 3 and min(shards) == 0
    again = mix_sources(docs.repartition(3), settings, carry=("source",)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken, str(r.copies), r.order)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixture_is_shuffled_within_shards(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    mixed = mix_sources(docs, MixSettings(block_words=500, shard_words=2000), carry=("source",))
    out = mixture(mixed).collect()
    assert len(out) == sum(len(r.copies) for r in mixed.collect())
    assert [(r.shard, r.place) for r in out] == sorted((r.shard, r.place) for r in out)
    sources = [r.source for r in out]
    assert sum(a != b for a, b in zip(sources, sources[1:], strict=False)) > len(out) / 3


def replay(rows, settings):
    """The draws again, by lists: (id, size) -> copies of the rows, for tables without repeated rows."""
    sizes = [(i, t, s, len((t or "").split())) for i, t, s, _ in rows]
    names = sorted({s for _, _, s, _ in sizes}, key=lambda x: (x is None, x or ""))
    plan = plan_sources([(n, sum(z for _, _, s, z in sizes if s == n)) for n in names], settings)
    shard_words, block_words = settings.of(sum(z for *_, z in sizes), len(names))
    return names, plan, shard_words, block_words


def test_shards_and_blocks_follow_the_table(spark):
    settings = MixSettings()
    docs = [(k, " ".join(["w"] * (40 + k % 50)), f"s{k % 3}", 1) for k in range(600)]
    names, plan, shard_words, block_words = replay(docs, settings)
    total = sum(s.words for s in plan)
    assert total // shard_words == 16 and all(s.blocks >= 60 for s in plan)
    assert MixSettings().of(10**13, 10**4)[0] * QUOTAS >= 10**13 * 10**4 and MixSettings().of(10**11, 5) == (1 << 26, 1 << 18)
    got = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string, n int"), carry=("source",)).collect()
    shards = defaultdict(int)
    for r in got:
        for c in r.copies:
            shards[c.shard] += r["size"]
    assert len(shards) >= 16 and max(shards.values()) < 2.5 * shard_words
    # whole blocks are drawn, but for a few of each source: the documents of a block have the same copies
    by = defaultdict(lambda: defaultdict(set))
    for r in got:
        by[r.source][tuple(sorted((c.epoch, c.shard) for c in r.copies))].add(r.doc_id)
    for name, s in zip(names, plan, strict=True):
        taken = sum(r.taken for r in got if r.source == name)
        assert abs(taken - s.target) <= 40
        epochs = [len(r.copies) for r in got if r.source == name]
        assert set(epochs) <= {s.passes, s.passes + 1}


def test_quotas_reach_every_shard(spark):
    """The shards' blocks of a source are what the tree gave them: a run of places, each block in one of them."""
    docs = [(k, " ".join(["w"] * 50), "ab"[k % 2], 1) for k in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    got = mix_sources(df, carry=("source",)).collect()
    per = defaultdict(lambda: defaultdict(int))
    for r in got:
        for c in r.copies:
            per[c.shard][r.source] += r["size"]
    share = {s: sum(p[s] for p in per.values()) for s in "ab"}
    assert share["a"] < share["b"]  # weights 1 and 2
    mixed = [p["b"] / (p["a"] + p["b"]) for p in per.values()]
    assert len(per) > 10 and abs(sum(mixed) / len(mixed) - 2 / 3) < 0.08 and len({round(x, 6) for x in mixed}) > 3
    out = mixture(mix_sources(df, carry=("source",))).collect()
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
