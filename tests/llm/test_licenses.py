from loomdoc.llm import licenses


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"][0]
    texts = [mit, "MIT Licence\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n ").replace("SUBLICENSE", "SUB-LICENSE"), mit + " more", "hello\nReleased under the MIT Licence!\nx", None, "", "© 2021 me\nAll rights reserved.", "word " * 200_000 + "\nReleased under the MIT License.\n" + "end " * 200_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, mit, "y")], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(docs).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: (None, ""), 3: (None, "MIT"), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: (None, "MIT")}


def test_licenses_beyond_the_sql(spark):
    from loomdoc.llm.known_licenses import ALL_NOTICES, ALL_TEXTS

    cases = {"Released under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the GNU LGPL": "LGPL", "This work is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
             "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "This program is distributed under the terms of the GNU Affero General Public License, version 3.": "AGPL-3.0",
             "Licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed to nobody": ""}
    texts = [(f"x\n{t}\ny", (None, want)) for t, want in cases.items()] + [(ALL_TEXTS[k][0], (k, None)) for k in ALL_TEXTS]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(docs, ALL_TEXTS, ALL_NOTICES).collect()}
    for i, (_, (license_id, notices)) in enumerate(texts):
        assert got[i][0] == license_id and notices in (None, got[i][1]), texts[i]
    own = spark.createDataFrame([("Own-1", "my own words"), ("Own-1", "My own words!")], "license_id string, text string")
    found = licenses.scan(spark.createDataFrame([(1, "My OWN words")], "doc_id long, text string"), own, own).collect()
    assert [(r["license_id"], r["notices"]) for r in found] == [("Own-1", "Own-1")]
