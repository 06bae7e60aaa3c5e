"""What the operators store goes with the workspace that they run in."""

import os

import pytest
from llm_helpers import SF

import __spark_entry__ as contract
import corpus_pipeline
from tillwatch.session import path_exists, shared_dir, work_path, workspace


def stored_now(spark):
    return set(os.listdir(f"{shared_dir(spark)}/tillwatch")) if path_exists(spark, f"{shared_dir(spark)}/tillwatch") else set()


STORING = ["op2_lm_scoring", "op3_sentencepiece", "op4_simhash_near_dedup", "op7_warc", "op11_spelling_variants", "op13_conversation_repair"]


@pytest.mark.parametrize("name", STORING)
def test_nothing_is_left_behind(spark, name):
    target, before = work_path(spark, "result"), stored_now(spark)
    with workspace(spark) as folder:
        contract.queries()[name](spark, SF).write.parquet(target)
        assert stored_now(spark) <= before | {os.path.basename(folder), os.path.basename(target)}
    assert stored_now(spark) == before | {os.path.basename(target)}
    assert spark.read.parquet(target).count() > 0


def test_pipeline_drops_what_it_has_read(spark, tmp_path):
    """Outside of a workspace, too, only the last stage's input and own tables are still there."""
    before = stored_now(spark)
    corpus_pipeline.run(spark, SF).write.parquet(str(tmp_path / "out"))
    left = {n.rsplit("-", 1)[0] for n in stored_now(spark) - before}
    assert "pipeline-decontaminate" in left and not {"pipeline-language_id", "pipeline-near_dedup", "prints", "simhash"} & left
