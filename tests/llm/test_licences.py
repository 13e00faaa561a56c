from terrace.llm import licences


def test_whole_texts_and_lines(docs):
    mit = licences.TEXTS["MIT"][0]
    wrapped = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace(", ", ",\n").replace("sublicense", "sub-license").upper()
    texts = [mit, wrapped, mit + " or so", None, "", "one\nReleased under the MIT licence\nSPDX-License-Identifier: ISC\ntwo", "x " * 50_000]
    got = {r.doc_id: r for r in licences.scan(docs(texts)).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[5].notices == "ISC,MIT" and got[2].notices is None
    assert got[3].digest is None and got[0].digest == got[1].digest
    again = licences.scan(docs([mit, mit], ids=[1, 1])).collect()
    assert [r.license for r in again] == ["MIT", "MIT"]
    assert licences.scan(docs([])).count() == 0


def test_native_plan(docs):
    plan = licences.scan(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_known_texts_are_told_apart(spark):
    rows = licences.known(spark).collect()
    assert len({r.digest for r in rows}) == len(rows)


def test_whole_texts_of_long_licences_and_of_a_given_table(spark, docs):
    import os

    folder = "/usr/share/common-licenses"
    long = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    texts = {name: open(f"{folder}/{f}", encoding="utf-8").read() for f, name in long.items() if os.path.exists(f"{folder}/{f}")}
    own = "Anyone may do anything with this, but sing."
    rows = [*(t.upper().replace(",", " ,") for t in texts.values()), *(t + " one word more" for t in texts.values()), "ANYONE may do anything with this; but sing!", None, ""]
    more = spark.createDataFrame([("Sing", own), ("Zing", own), (None, "x"), ("None", None)], "license string, text string")
    got = {r.doc_id: r.license for r in licences.scan(docs(rows), more).collect()}
    n = len(texts)
    assert [got[k] for k in range(n)] == list(texts) and all(got[n + k] is None for k in range(n))
    assert got[2 * n] == "Sing" and got[2 * n + 1] is None and got[2 * n + 2] is None
    assert licences.scan(docs([])).count() == 0
