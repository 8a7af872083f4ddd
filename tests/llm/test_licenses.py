import math
import re

import pytest
from pyspark.sql import functions as F

from archivemill.llm import op10_licenses as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").lower())


def cosine(a, b, idf):
    count = lambda ws: {w: ws.count(w) * idf(w) for w in ws}
    x, y = count(a), count(b)
    norm = lambda v: math.sqrt(sum(t * t for t in v.values()))
    return sum(x[w] * y.get(w, 0) for w in x) / max(norm(x) * norm(y), 1e-300)


def test_notices_are_found_by_cosine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {w for _, t in op.TEMPLATES for w in words_of(t)}
    df = {w: sum(w in set(words_of(t)) for t in texts.values()) for w in known}
    idf = lambda w: math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1
    matcher = op.Matcher(*op.document_frequencies(docs))
    rows = {r.doc_id: r for r in op.licenses(docs, F.lit("d/x"), matcher).collect()}
    hits = 0
    for key, text in texts.items():
        best = max(cosine(words_of(line), words_of(t), idf) for line in text.split("\n") for _, t in op.TEMPLATES)
        whole = max(cosine(words_of(text), words_of(t), idf) for _, t in op.TEMPLATES)
        if whole < op.FILE_COSINE:
            assert (rows[key].how == "header") == (best >= op.HEADER_COSINE)
            if best >= op.HEADER_COSINE:
                hits += 1
                assert rows[key].cosine == pytest.approx(best)
    assert hits


def test_the_nearest_directory_above_decides(spark, odd):
    rows = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/c/d/x.py", "some code"), (4, "a/x.py", None), (5, "/a/./b/y.py", "Licensed under CC BY 4.0.\n" + "code " * 90),
        (6, None, ""), (7, "b/z.py", "words"),
    ]
    docs = spark.createDataFrame([(*r, "q", 2) for r in rows], "doc_id bigint, path string, text string, how string, depth int")
    matcher = op.Matcher(*op.document_frequencies(docs))
    found = {r.doc_id: (r.licence, r.how, r.from_path) for r in op.licenses(docs, docs["path"], matcher).collect()}
    assert found == {
        1: ("MIT", "file", None), 2: ("Apache-2.0", "file", None), 3: ("Apache-2.0", "inherited", "a/b/LICENSE"),
        4: ("MIT", "inherited", "LICENSE"), 5: ("CC-BY-4.0", "header", None), 6: ("MIT", "inherited", "LICENSE"),
        7: ("MIT", "inherited", "LICENSE"),
    }
    assert op.licenses(odd, odd["path"], matcher).count() == odd.count()
    assert op.licenses(odd.limit(0), odd["path"], matcher).count() == 0


def test_other_words_weigh_by_their_documents(spark):
    notice = "Released under the MIT License"
    texts = [f"{notice} often" if i % 10 == 0 else "often seen" if i % 2 else "plain text" for i in range(1000)] + [f"{notice} rarely\n" + "filler " * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = op.licenses(docs, F.lit("d/x"), op.Matcher(*op.document_frequencies(docs))).collect()
    df = {w: sum(w in words_of(t) for t in texts) for t in texts for w in words_of(t)}
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    wanted = cosine(words_of(texts[0]), words_of(notice), idf)
    assert wanted > op.HEADER_COSINE > cosine(words_of(f"{notice} rarely"), words_of(notice), idf)
    for row in rows:
        if row.doc_id % 10 == 0 and row.doc_id < 1000:
            assert (row.licence, row.how, row.cosine) == ("MIT", "file", pytest.approx(wanted))


def test_wrapped_embedded_and_full_texts(spark):
    import textwrap

    full = dict(op.licence_texts())
    mit, gpl = (next(x for n, x in op.TEMPLATES if n == name and len(x) > 150) for name in ("MIT", "GPL-3.0"))
    wrap = lambda x: "\n".join(f"# {line}" for line in textwrap.wrap(x, 76))
    code = "\n" + "value += other * 3\n" * 300
    texts = {
        "a/1.py": ("MIT", "header", "Copyright (c) 2020 Some One. All rights reserved.\n" + wrap(mit) + code),
        "b/1.py": ("GPL-3.0", "header", wrap(gpl) + code),
        "c/1.py": ("Apache-2.0", "header", "we say " * 40 + "that it is licensed under the Apache License, Version 2.0 and " + "more of it " * 40),
        "e/1.py": (None, None, code),
        **{f"full/{n}/LICENSE": (n, "file", "Copyright 2021 Some One\n\n" + x) for n, x in full.items()},
        "full/MIT/x.py": ("MIT", "inherited", code),
    }
    docs = spark.createDataFrame([(i, p, t) for i, (p, (_, _, t)) in enumerate(texts.items())], "doc_id int, path string, text string")
    found = {r.path: (r.licence, r.how) for r in op.licenses(docs, docs["path"], op.Matcher(*op.document_frequencies(docs))).collect()}
    assert found == {p: (name, how) for p, (name, how, _) in texts.items()}


def test_only_licence_files_hand_down(spark):
    gpl = dict(op.licence_texts())["GPL-3.0"]
    notice = "Released under the MIT License."
    rows = {
        "a/note.txt": (notice, "MIT", "file"), "a/x.py": ("code", None, None),
        "b/LICENCE.md": (notice, "MIT", "file"), "b/x.py": ("code", "MIT", "inherited"),
        "c/COPYING": ("A.\nAll rights reserved.", "Proprietary", "file"), "c/x.py": ("code", None, None),
        "d/text": (gpl, "GPL-3.0", "file"), "d/e/x.py": ("code", "GPL-3.0", "inherited"),
        "e/license_check.py": ("code", None, None), "f/unlicense": (notice, "MIT", "file"), "f/x.py": (None, "MIT", "inherited"),
        "g/my-license": (notice, "MIT", "file"), "g/x.py": ("code", None, None),
    }
    docs = spark.createDataFrame([(i, p, t) for i, (p, (t, _, _)) in enumerate(rows.items())], "doc_id int, path string, text string")
    found = {r.path: (r.licence, r.how) for r in op.licenses(docs, docs["path"], op.Matcher(*op.document_frequencies(docs))).collect()}
    assert found == {p: (a, b) for p, (_, a, b) in rows.items()}
