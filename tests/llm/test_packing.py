import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from gleaner.llm.packing_hilbert import WordTokenizer, hilbert_keys, pack_along_curve  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_curve_is_continuous():
    for dims, order in ((2, 4), (3, 3), (4, 2)):
        cells = np.array([*product(range(1 << order), repeat=dims)])
        keys = hilbert_keys(cells, order)
        assert sorted(keys.tolist()) == [*range(len(cells))]
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


TEXTS = ["It's I'M WE'LL o'd 'tis", "ŉ ĿĀ ſs ẞ ß İstanbul ıx", "áé Å x² ½ ¾ ⅓ 12", "\x85a\xa0b c", "", "  ", "_a_b #$%'s '", "µ ª º Ω \x1c\x1d x", "ƀǅ ﬁ 漢字 🙂", "<|endoftext|> <|startoftext|>x", "é ö", *[f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}1" for c in range(0x180)]]


def test_memo_gives_the_librarys_ids():
    fast, plain = WordTokenizer(PATH), WordTokenizer(PATH, exact=True)
    for _ in range(2):
        for a, b in zip(fast.encode(TEXTS), plain.encode(TEXTS), strict=True):
            assert a.tolist() == b.tolist()


def test_packing_round_trip(spark):
    rows = [(k, " ".join(f"word{k % 5} thing{j % 11}" for j in range(k)), 1) for k in range(120)] + [(500, None, 1), (501, "", 1), (None, "alone", 1), (502, "long text " * 30_000, 1), (503, "twin", 1), (503, "twin", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(6)
    got = pack_along_curve(docs, PATH, length=256).collect()
    plain = WordTokenizer(PATH, exact=True)
    want = {i: np.append(plain.encode([t or ""])[0], 2) for i, t, _ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.id].append(r)
        sequences[r.sequence_id].append(r)
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert ids.tolist() == want[r.id][r.start : r.start + r.length].tolist() and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(want[r.id])
    assert {i: sum(p.length for p in own) for i, own in pieces.items()} == {i: len(w) * (2 if i == 503 else 1) for i, w in want.items()}
    for k, own in sequences.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:j]) for j in range(len(own))]
        assert sum(r.length for r in own) == 256 or k == max(sequences)
    assert pack_along_curve(docs.limit(0), PATH).count() == 0
