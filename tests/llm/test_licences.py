import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tonguemix.llm import licences

COMMON = "/usr/share/common-licenses"


def test_spellings_of_whole_texts(spark):
    mit = licences.TEXTS["MIT"].strip()
    wrapped = "\r\n".join(" ".join(mit.split()[i : i + 11]) for i in range(0, len(mit.split()), 11))
    texts = [
        (1, mit), (2, "The MIT License (MIT)\n\nCopyright (c) 2024 Some One\nAll rights reserved.\n\n" + mit.upper()), (3, "© 2001 x\n" + wrapped.replace('"', "“")),
        (4, mit + "\nAnd more."), (5, licences.TEXTS["BSD-2-Clause"].replace("* ", "")), (6, licences.TEXTS["Unlicense"].replace("non-commercial", "noncommercial").replace("https", "http")), (7, licences.TEXTS["BSL-1.0"].replace("organization", "organisation").replace("license", "licence")),
    ]
    rows = {r.doc_id: r.license for r in licences.scan_licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "BSD-2-Clause", 6: "Unlicense", 7: "BSL-1.0"}


HOLDERS = [
    "Copyright (c) Microsoft Corporation. All rights reserved.", "Copyright Jane Doe 2020", "Copyright (c) Jane Doe", "Copyright (C) the Foo authors", "Portions Copyright (c) 2010 Y",
    "SPDX-License-Identifier: MIT", "© 2001-2024, Some One <one@example.org>", "Copyright 2015 by A, B and C", "SPDX-FileCopyrightText: 2019 Jane Doe\n(c) Jane Doe\nAll rights reserved.",
]


def test_holders_wrapping_and_sql(spark, tmp_path):
    """Whole texts under any line that names a holder, wrapped at any width; and the SQL's rows on the same table."""
    mit, bsd = licences.TEXTS["MIT"].strip(), licences.TEXTS["BSD-3-Clause"].strip()
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows = [("MIT", f"MIT License\n\n{holder}\n\n{mit}") for holder in HOLDERS] + [("BSD-3-Clause", f"{holder}\n{bsd}") for holder in HOLDERS]
    rows += [(k, f"{HOLDERS[1]}\n{wrap(text, n)}") for k, text in (("MIT", mit), ("BSD-3-Clause", bsd)) for n in range(3, 24)]
    rows += [(None, mit.replace("free of charge", "for a fee")), (None, None), ("MIT", mit.replace("sublicense", "sub-licence").replace("copyright holder", "Copyright Owner"))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = licences.scan_licences(docs).collect()
    assert {r.doc_id: r.license for r in found} == {i: k for i, (k, _) in enumerate(rows)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(str, db.execute(licences.SQL).fetchall())) == sorted(str(tuple(r)) for r in found)


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no copies of the texts on this machine")
def test_longer_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows = []
    for name, licence in files.items():
        with open(f"{COMMON}/{name}", encoding="utf-8") as f:
            text = f.read()
        rows += [(licence, text), (licence, text.upper().replace("\n\n", "\r\n \r\n")), (None, text + "\nAnd more."), (None, text[: len(text) // 2])]
        if name == "Apache-2.0":
            rows += [(licence, text.replace("[yyyy] [name of copyright owner]", "2024 Some One")), (licence, text.split("   APPENDIX")[0])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.license for r in licences.scan_licences(docs).collect()}
    assert found == {i: k for i, (k, _) in enumerate(rows)}


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Prose here.\nReleased under the MIT Licence.\nMore.\n  licensed under CC BY-NC 4.0"), (1, "All rights reserved."), (None, None), (2, ""), (3, "word " * 100000), (4, "It was released under the MIT License once.")], "doc_id long, text string"
    ).withColumn("lines", F.lit(1)).withColumn("digest", F.lit("clash")).withColumn("license", F.lit("x"))
    rows = sorted((r.doc_id or 0, r.notices) for r in licences.scan_licences(docs).collect())
    assert rows == [(0, ""), (1, "CC-BY-NC-4.0,MIT"), (1, "LicenseRef-All-Rights-Reserved"), (2, ""), (3, ""), (4, "")]
    assert licences.scan_licences(docs.limit(0)).count() == 0
