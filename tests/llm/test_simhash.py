import numpy as np
import pandas as pd
import pytest
import xxhash
from gleaner.llm import simhash_gph as sh
from gleaner.llm.components import connected_components


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "One TWO three", "É a É b", "a b c d e f g " * 300])
def test_fingerprint(text):
    assert sh.fingerprint(text) == plain_fingerprint(text)


def brute_components(fps, limit):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= limit:
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {f: root(f) for f in fps}


@pytest.mark.parametrize(("limit", "heavy"), [(3, 2000), (3, 5), (6, 20), (0, 2000)])
def test_links_connect_what_brute_force_does(spark, limit, heavy):
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 2**62, 40)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(8):  # chains and bundles around each seed, correlated low bits
            s = int(s) ^ sum(1 << int(b) for b in rng.choice(24, int(rng.integers(1, 6)), replace=False))
            fps.add(s)
    want = brute_components(sorted(fps), limit)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(sorted(fps), np.uint64).view(np.int64)}))
    got = {r.node: r.root for r in connected_components(sh.near_links(df, limit, heavy)).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_allocation_is_a_pigeonhole():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1::2] = bits[:, ::2]  # each bit has a twin
    both = (bits.T @ bits).astype(float)
    for n, limit in ((0, 8), (1, 8), (500, 3), (10**7, 3), (10**9, 3), (10**6, 6)):
        parts = sh.within(n, both * n / 500, limit)
        assert sum(p.threshold + 1 for p in parts) == limit + 1
        used = [b for p in parts for b in p.bits]
        assert len(used) == len(set(used))
        assert len(sh.masks_of(parts)) < 2000


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_operator_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(300))
    near = text.replace("w7 ", "other ")
    rows = [(9, text, 1), (3, text, 1), (3, text, 1), (5, near, 1), (7, None, 1), (8, "", 1), (None, text, 1), (11, "one", 1), (12, " ".join(f"z{k}" for k in range(60_000)), 1), (None, "alone here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = sorted(((r.id, r.component) for r in sh.near_duplicates(docs).collect()), key=str)
    limit = (sh.fingerprint(text) ^ sh.fingerprint(near)).bit_count() <= 3
    assert (9, 3) in got and got.count((3, 3)) == 2 and (7, 7) in got and (8, 7) in got and (11, 11) in got and (None, 3) in got and (None, None) in got
    assert ((5, 3) in got) == limit and len(got) == len(rows)
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def test_plans_follow_the_number_of_fingerprints():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 64))
    both = (bits.T @ bits) / 2000
    plans = [sh.within(n, both * n, 3) for n in (10**4, 10**8, 10**10)]
    assert [p.threshold for p in plans[0]] == [0, 0, 0, 0] and max(p.threshold for p in plans[2]) > 0
    assert len(sh.masks_of(plans[0])) < len(sh.masks_of(plans[1])) <= len(sh.masks_of(plans[2]))
    mask = int(sh.masks_of(plans[0])[0])
    more = sh.deeper(mask, 5000, both * 5000, 3)
    assert all(int(m) & mask == mask and int(m) != mask for m in more)
