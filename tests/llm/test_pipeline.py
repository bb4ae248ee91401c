import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_jaccard import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted toxic documents, copies, leaks and personal data among clean ones."""
    r = random.Random(8)
    word = lambda: "".join(r.choice(["ta", "ne", "mo", "ri", "lu", "sen"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    rows, labels = [], []
    for d in range(240):
        t = text(r.randrange(5, 60))
        if d % 4 == 0:
            t += " grumpold"
        rows.append((d, t))
        labels.append((d, int(d % 4 == 0), 1))
    rows += [(300, rows[1][1]), (301, rows[2][1] + " " + text(1)), (302, f"{text(9)} {item} {text(9)}"), (303, f"{text(20)} a.b@mail.com and 10.1.2.3 {text(3)}"), (304, None), (305, ""), (305, ""), (306, text(4000)), (307, f"{text(12)} grump0ld")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def expected(rows, item):
    """The documents and texts that stay, by the plainest means."""
    left = [(d, t) for d, t in rows if not re.search("grump[o0]ld", t or "")]
    first = {}
    for d, _, c, _ in brute(left, 5, 80, 100):
        first.setdefault(c, d)
    heads, out = {c for c in first}, []
    for d, t in left:
        if d in heads and (d, t) not in out:
            out.append((d, t))
    out = [(d, t) for d, t in out if item not in (t or "")]
    return [(d, (t or "").replace("a.b@mail.com", "[EMAIL]").replace("10.1.2.3", "[IP]")) for d, t in out]


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
    got = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert got == sorted(expected(rows, item))
    assert all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect())


def test_run(spark, folder):
    from tokenizers import Tokenizer

    from tidegraph.llm.queries import vocabulary

    path, rows, item = folder
    t = Tokenizer.from_file(vocabulary())
    got = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in expected(rows, item)}


def test_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
