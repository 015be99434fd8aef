"""Short lines and texts of very many lines of operator 9."""

import hashlib

from parlance.llm import line_dedup

DDL = "doc_id bigint, text string"


def test_equal_short_lines_go(spark, tmp_path):
    long = "this line has more than five words in it"
    rows = [(1, f"All rights reserved.\n\n{long}\nHome"), (2, f"{long}\nALL rights  reserved.\n\nrights reserved."), (3, "home\nHome page\nnew"), (4, "home page\nHome page x\nreserved. rights All"), (5, None)]
    want = {1: rows[0][1], 2: "\nrights reserved.", 3: "Home page\nnew", 4: "Home page x\nreserved. rights All", 5: ""}
    docs = spark.createDataFrame(rows, DDL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r["kept_sha256"] for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    staged = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, docs, "").collect()}
    assert staged == want | {5: None}


def test_buffers_of_very_many_lines():
    """Lines i and i + 2**20 of a text, or of texts that share a buffer, are lines of their own."""
    a, b = "one two three four five", "six seven eight nine ten"
    far = "\n" * 5 + a + "\n" * (1 << 20) + b
    for texts in ([far], ["x\n" * 400_000, far[: 1 << 19], far], ["\n" * 900_000, "\n" * 900_000 + b], [far * 3 + "\n" + a]):
        found = []
        for data, first, info in line_dedup._buffers([*range(len(texts))], texts, [0] * len(texts)):
            s = line_dedup.line_sets(data, line_dedup.Lines())
            at, number, _ = line_dedup._places(first, info, s.line)
            found += [(info[i][0], int(n), k) for i, n, k in zip(at.tolist(), number.tolist(), s.keys, strict=True)]
        lines = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if len(x.split()) >= 5]
        key = {x: line_dedup.line_sets(x.encode(), line_dedup.Lines()).keys[0] for _, _, x in lines}
        assert sorted(found) == sorted((i, n, key[x]) for i, n, x in lines)
