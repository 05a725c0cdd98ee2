from pathlib import Path

import pytest
from check_oracle import compare, duck

from tabulith.llm import licences as L
from tabulith.llm.registry import ORACLES


def test_equals_sql(spark, sf):
    for where in (sf, sf.replace("sf0.001", "sf0.01")):
        assert compare(L.op9(spark, where), duck(where), ORACLES["op9_license_digests"]) is None


def named(spark, docs):
    return {r["doc_id"]: (r["license"], r["line_licenses"]) for r in L.scan(docs).collect()}


def test_forms_of_whole_texts(spark, documents):
    mit, bsd = dict(L.LICENCES)["MIT"], dict(L.LICENCES)["BSD-3-Clause"]
    mit = next(t for n, t in L.LICENCES if n == "MIT" and "hereby" in t)
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\n(C) 2021 Other\nAll rights reserved.\n\n" + mit.upper()),
        (3, mit.replace("non", "non-").replace(" ", "  ").replace("\n", "\r\n\n * ")), (4, mit.replace("sublicense", "sub-licence")),
        (5, mit + " and more"), (6, bsd.replace('"', "''")), (7, "Prose.\nreleased under the MIT licence\nMore prose."),
        (8, "It is released under the MIT License."), (9, "Licensed under CC BY NC 4 0\nLicensed under CC BY-NC 4.0.\nReleased under CC0 1.0"),
    ]
    got = named(spark, documents(rows))
    assert [got[i][0] for i in range(1, 7)] == ["MIT", "MIT", "MIT", "MIT", None, "BSD-3-Clause"]
    assert got[7] == (None, ["MIT"]) and got[8] == (None, []) and got[9] == (None, ["CC-BY-NC-4.0", "CC0-1.0"])


def test_edge_rows(spark, documents):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "?!\n--"), (4, notice), (4, notice), (None, notice), (5, "word " * 200_000 + "\n" + notice),
            (6, "Copyright 2020 X"), (7, "x\n" * 50_000)]
    found = L.scan(documents(rows)).collect()
    assert len(found) == len(rows)
    got = sorted((r["doc_id"] or 0, r["digest"] is None, r["license"], r["line_licenses"]) for r in found)
    assert got == [(0, False, "MIT", ["MIT"]), (1, True, None, []), (2, True, None, []), (3, True, None, []), (4, False, "MIT", ["MIT"]),
                   (4, False, "MIT", ["MIT"]), (5, False, None, ["MIT"]), (6, True, None, []), (7, False, None, [])]
    assert L.scan(documents([])).count() == 0


def test_own_texts(spark, documents):
    found = L.scan(documents([(1, "My terms, as they ARE")]), (("Own", "my terms as they are"),)).first()
    assert found["license"] == "Own"


def test_a_wrapped_line_that_starts_with_copyright(spark, documents):
    isc = dict(L.LICENCES)["ISC"]
    rows = [(1, "Copyright 2020 Some One\nCopyright Some Author\n\n" + isc.replace("above copyright notice", "above\ncopyright notice")),
            (2, isc.replace("above copyright notice", "above\n * copyright notice"))]
    assert [x for x, _ in named(spark, documents(rows)).values()] == ["ISC", "ISC"]


def test_full_texts_of_long_licences(spark, documents):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in files.values()):
        pytest.skip("no licence texts here")
    rows = [(i, (folder / f).read_text()) for i, f in enumerate(files.values())]
    got = named(spark, documents(rows))
    assert [got[i][0] for i in range(len(files))] == list(files)
