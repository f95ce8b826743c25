import textwrap

import pytest

from gleaner.llm.license_digests import NOTICES, SHORT, canonical, default_registry, digest_of, licence_scan, long_licences, marker_words

TEXTS = {i: text for i, _, text in SHORT} | dict(long_licences())


def scan(spark, rows):
    return {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()}


def test_canonical_by_hand():
    assert canonical("Copyright (c) 2020 A B\nThe Sub-Licence, of\n  Copyright\nOwners!\nCOPYRIGHT HOLDERS BE") == "the sublicense of copyright holders copyright holders be"
    assert canonical("# (C) 1999 x\n© y\nAll rights reserved.\ncopyright notice and this\n[c] https://z") == "copyright notice and this c http z"
    assert canonical("Copyright: [yyyy] [name]\n") == "" == canonical("")


def test_every_known_text_is_found_however_wrapped(spark):
    rows, want = [], {}
    for k, (i, text) in enumerate(TEXTS.items()):
        for j, width in enumerate((None, 61, 78, 97)):
            parts = text.split("\n\n")
            # lines with a copyright notice keep their line
            made = text if width is None else "\n\n".join(p if "copyright (c)" in p.lower() or "©" in p else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)
            own = f"Copyright (c) 20{10 + j} Holder {k}\n\n{made}".replace(",", " ,").replace("license", "licence")
            if width is None or canonical(made) == canonical(text):  # else wrapping began a line with a notice's words
                rows.append((len(rows), own, 0))
                want[len(rows) - 1] = i
    got = scan(spark, rows)
    assert {k: r.licence_id for k, r in got.items()} == want and all(r.matched == "text" for r in got.values())
    assert len(set(want.values())) == len(TEXTS) >= 20


def test_headings_and_lines_that_begin_with_copyright(spark):
    mit = TEXTS["MIT"]
    wrapped = mit.replace("above copyright notice", "above\ncopyright notice").replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    heads = [(k, f"{h}\n\nCopyright 2020 x\nall rights reserved\n{wrapped}", 0) for k, h in enumerate(("", "MIT License", "The MIT License (MIT)"))]
    got = scan(spark, [*heads, (9, mit + " more", 0), (10, "Permission\n" + mit, 0)])
    assert all(got[k].licence_id == "MIT" for k in range(3))
    assert got[9].licence_id is None and got[10].licence_id is None


def test_parts(spark):
    header = NOTICES[0][1]
    rows = [(1, f"intro\n\n{TEXTS['ISC'].split(chr(10) * 2)[0]}", 0), (2, f"x\nSPDX-License-Identifier: MIT\ny\n  # {NOTICES[4][1].upper()}", 0), (3, f"a\nLicensed under CC BY-NC 4.0.  \nb", 0), (None, f"t\n{NOTICES[5][1]}", 0), (None, "t", 0), (5, header, 0)]
    got = licence_scan(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    said = sorted((str(r.doc_id), str(r.licence_id), str(r.matched), r.part_ids) for r in got)
    assert ("1", "None", "None", "") in said and ("2", "CC-BY-NC-4.0", "part", "CC-BY-NC-4.0,MIT") in said and ("3", "CC-BY-NC-4.0", "part", "CC-BY-NC-4.0") in said
    assert ("None", "GPL-3.0", "part", "GPL-3.0") in said and ("None", "None", "None", "") in said and ("5", "Apache-2.0", "text", "") in said


def test_edge_cases(spark):
    rows = [(2, "b", 0), (2, "b", 0), (4, None, 0), (5, "", 0), (6, "Copyright 2020 x\n", 0), (8, "The licence of\torganisation" * 30_000, 0), (9, "The license of organization" * 30_000, 0)]
    got = licence_scan(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[4].digest is None and by[5].digest == by[6].digest and by[5].licence_id is None
    assert by[8].digest == by[9].digest and by[2].digest == digest_of("B.")
    assert licence_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.licence_id for r in licence_scan(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), [("b", "One  two!"), ("a", "ONE, TWO"), ("c", "")]).collect()] == ["a"]


@pytest.mark.parametrize("pair", default_registry()[:40:7])
def test_expressions_agree_with_python(spark, pair):
    got = scan(spark, [(1, pair[1], 0)])[1]
    assert got.digest == digest_of(pair[1]) and got.licence_id is not None


def test_every_entry_has_a_marker():
    texts = [t for _, t in default_registry()]
    words = marker_words(texts)
    assert 0 < len(words) < 12 and all(any(w in t.lower() for w in words) for t in texts)
    assert marker_words(["licence"]) == [""] and marker_words([]) == []
