import pytest
from conftest import SF

from lakeglass.llm import licenses as L
from lakeglass.llm import queries as Q

LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_whole_table_equals_plain_search(spark):
    text = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    want = {(i, name) for i, t in text.items() for line, name in LINES.items() if line in t}
    got = Q.QUERIES["op7_licenses"](spark, SF).collect()
    assert len(want) > 30 and {(r["doc_id"], r["license"]) for r in got} == want
    assert all(r["missing"] == [] == r["extra"] for r in got)


def scan(text):
    return [(t.license, missing, extra) for _, b in L.blocks(text) for _, t, missing, extra in L.notices(b)]


@pytest.mark.parametrize("k", range(len(L.TEMPLATES)))
def test_every_template_is_found(k):
    name, _, wording = L.TEMPLATES[k]
    shouted = wording.upper().replace(" ", "\n  ", 3)
    for text in (wording, f"Some prose before it.\n\n{wording}\n\nand prose after it", shouted, "x " * 50_000 + "\n" + wording):
        assert scan(text) == [(name, [], [])]


def test_differences():
    mit = next(w for n, _, w in L.TEMPLATES if n == "MIT" and len(w) > 200)
    assert scan(mit.replace("furnished", "supplied")) == [("MIT", ["furnished"], ["supplied"])]
    assert scan(mit.replace("without restriction", "with restriction")) == []
    assert scan(mit[: len(mit) // 2]) == []
    gpl = [w for n, _, w in L.TEMPLATES if n == "GPL-3.0-or-later"][0]
    assert [x[0] for x in scan(gpl)] == ["GPL-3.0-or-later"]
    assert [x[0] for x in scan(gpl.replace("version 3", "version 2", 1))] == ["GPL-2.0-or-later"]
    assert scan(gpl.replace("version 3", "version 7", 1)) == []
    assert scan("Licensed under the Apache License, Version 1.1.") == []
    assert scan("The license of the driver was under review. All rights of way were reserved.") == []


def test_two_notices_in_a_row():
    mit = next(w for n, _, w in L.TEMPLATES if n == "MIT" and len(w) > 200)
    assert sorted(x[0] for x in scan("All rights reserved.\n" + mit + "\nLicensed under the Apache License, Version 2.0.")) == ["Apache-2.0", "MIT", "all-rights-reserved"]
    broken = mit.replace("without restriction", "with restriction").replace("to deal in", "to use but never sell")
    assert [x[0] for x in scan(broken + "\nReleased under the MIT License.")] == ["MIT"]


def test_edge_cases(spark):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (4, "word " * 300_000 + "\n" + line), (5, "licen"), (6, "..\n!!")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, license string, block int")
    got = L.licenses(df).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([3, 3, None, 4], key=repr)
    assert L.licenses(df.limit(0)).collect() == []
