import os

import pytest

from tidewarden.llm import licences
from tidewarden.llm.licence_texts import DIGESTS, KNOWN

COMMON = "/usr/share/common-licenses"


def test_variants_of_a_text_have_its_digest(spark, documents):
    mit = KNOWN["MIT"][0]
    rows = [
        (1, "Copyright (c) 2020 A. N. Author\n\n" + mit),
        (2, "© 1999 Somebody\nAll rights reserved.\n" + mit.upper().replace(",", " ;")),
        (3, mit.replace("the Software", "“the   Software”").replace("MERCHANTABILITY", "merchantibility")),
        (4, mit + " and more"),
        (5, "some prose\nReleased under the MIT Licence.\nLicensed under the Apache Licence, version 2.0\nReleased under the MIT License."),
        (6, None),
        (7, ""),
        (8, "...\n***"),
        (9, KNOWN["BSD-3-Clause"][0].replace("copyright holder", "copyright owner")),
        (1, mit),
        (None, KNOWN["ISC"][0]),
        (10, "licence " * 20_000),
    ]
    got = licences.scan(documents(rows)).collect()
    assert len(got) == len(rows)
    by = sorted((g["doc_id"] or 0, g["licence"] or "") for g in got if g["doc_id"] not in (5, 10))
    assert by == [(0, "ISC"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, ""), (6, ""), (7, ""), (8, ""), (9, "BSD-3-Clause")]
    five = next(g for g in got if g["doc_id"] == 5)
    assert five["licence"] is None and five["notices"] == "Apache-2.0,MIT"
    assert all(g["digest"] is None for g in got if g["doc_id"] in (6, 7, 8))


def test_known_texts_differ(spark):
    assert licences.known(spark).count() == sum(map(len, KNOWN.values()))


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files on this machine")
def test_whole_long_texts(spark, documents):
    files = {n: n.removesuffix(".0") if "GPL" in n else n for n in DIGESTS}
    texts = {n: open(os.path.join(COMMON, f), encoding="utf-8").read() for n, f in files.items()}
    rows = [(i, texts[n]) for i, n in enumerate(texts)]
    rows += [(100 + i, "  ".join(texts[n].upper().split(" "))) for i, n in enumerate(texts)]
    end = "END OF TERMS AND CONDITIONS"
    rows += [(200 + i, t[: t.index(end) + len(end)]) for i, t in enumerate(texts.values()) if end in t]
    rows += [(300 + i, texts[n] + " and more") for i, n in enumerate(texts)]
    names = list(texts)
    got = licences.scan(documents(rows)).collect()
    assert len(got) == len(rows)
    assert all(g["licence"] == (names[g["doc_id"] % 100] if g["doc_id"] < 300 else None) for g in got)
    held = [d for digests in DIGESTS.values() for d in digests]
    assert len(set(held)) == len(held)


def test_empty_table(documents):
    assert licences.scan(documents([])).count() == 0
