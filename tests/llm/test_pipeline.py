"""The pipeline and the queries as the entry point registers them, against the tests' own brute-force versions."""

import pytest
import test_language
import test_sentencepiece
import test_spaced_seeds
import test_vantage
from llm_helpers import odd_texts, prose

import __spark_entry__ as contract
import corpus_pipeline
from tillwatch.llm.sentencepiece import Vocabulary
from tillwatch.session import work_path


@pytest.fixture(scope="module")
def sf_dir(spark):
    import random

    rng = random.Random(8)
    items = [prose(rng, 30), prose(rng, 15), prose(rng, 9)]
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 120)) for _ in range(20)]
    texts += [prose(rng, 12) + " " + i + " " + prose(rng, 7) for i in items]
    near = prose(rng, 400)
    texts += [near, near + " more", near]
    rows = [(k, t, rng.choice(["en", "de", None]), f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[-1])
    path = work_path(spark, "pipeline-test")
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute(rows, items):
    seen = {i: (t, lang) for i, t, lang in rows}
    judged = test_language.brute(rows)
    left = sorted(i for i in seen if judged[i][0] != "und" and judged[i][1] > corpus_pipeline.LEAST_CLOSENESS)
    label = test_vantage.groups([test_vantage.fingerprint(seen[i][0]) for i in left], 2)
    left = sorted({left[k] for k in label})
    return [i for i in left if not any(test_spaced_seeds.overlaps(seen[i][0], x) for x in items)]


def test_run_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == brute(rows, items)
    model = Vocabulary.load(corpus_pipeline.PIECES)
    texts = {i: t for i, t, _ in rows}
    for i, r in got.items():
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])
        if len(texts[i]) < 500:
            assert r["piece_ids"] == test_sentencepiece.best_path(model.prepare(), texts[i])[0]


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({}).selectExpr("*", "1 AS fp", "'k' AS key", "0 AS _found")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert name == "sentencepiece" or out.columns == docs.columns
            assert (out.count() > 0) == (frame is docs)


def test_every_operator_is_registered(spark):
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [4, None]


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_sentencepiece", "op5_token_counts", "op7_warc"])
def test_queries_cover_their_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    got = contract.queries()[name](spark, sf).collect()
    table = "pages" if name == "op7_warc" else "documents"
    if name != "op1_license_scan":
        assert len(got) == spark.read.parquet(f"{sf}/{table}.parquet").count()
    if name == "op3_sentencepiece":
        assert all(r["round_trip"] for r in got)
