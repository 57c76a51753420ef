"""The pipeline's stages take effect, keep the columns of documents, and keep clean documents."""

import importlib.util
import random

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item, passage, whole = prose(40), prose(60), prose(300)
    texts = [prose(rnd.randint(80, 300)) for _ in range(100)]  # 0..99 are clean
    texts += [whole, whole, whole + " end"]  # 100..102: copies
    texts += [prose(100) + " " + passage, prose(120) + " " + passage]  # 103, 104: a passage that comes back
    texts += [prose(90) + " " + item + " " + prose(30), "few words"]  # 105: a leak; 106: rejected
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = set(docs.columns)
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or set(docs.columns) == columns
        left.append({r.doc_id: r for r in docs.collect()})
    assert [set(range(107)) - set(x) for x in left] == [{106}, {101, 102, 106}, {101, 102, 106}, {101, 102, 105, 106}, {101, 102, 105, 106}]
    assert left[2][103].text == texts[103] and left[2][104].text == texts[104].removesuffix(" " + passage) and left[2][104].n_chars == len(left[2][104].text)
    assert left[4][0].n_tokens == len(left[4][0].ids) > 0
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in again.collect()} == {i: r.ids_sha256 for i, r in left[4].items()}


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, a repeated row, a copy, and extra columns with names that stages use themselves."""
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    base = prose(120)
    rows = [(1, base, "en", "s", 5), (5, base, "en", "s", 5), (5, base, "en", "s", 5), (None, base, "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, prose(60_000), None, "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node long, fp long, grp string, body string, kept boolean, spans string"
    return spark.createDataFrame([(*r, 7, 8, "g", "b", True, "s") for r in rows], kinds), prose(40)


#: By stage: the ids that are left of the odd documents. A row without an id cannot be named and stays.
LEFT = {
    "quality rules": [1, 4, 5, 5, None],  # empty texts go
    "SimHash near-dedup": [1, 2, 4, None],  # of the copies 1 stays, of the empty texts 2
    "substring dedup": [1, 2, 3, 4, None],  # 5 holds nothing that 1 does not
    "benchmark decontamination": [1, 2, 3, 4, 5, 5, None],
    "byte-level BPE encoding and decoding": [1, 2, 3, 4, 5, 5, None],
}


@pytest.mark.parametrize("name", LEFT)
def test_defined_cases_of_each_stage(spark, tmp_path, name):
    docs, item = odd_documents(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id for r in got.collect()), key=lambda i: (i is None, i)) == LEFT[name]
    if name != corpus_pipeline.STAGES[-1][0]:
        assert set(got.columns) == set(corpus_pipeline.COLUMNS)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
