"""Physical-plan checks: no cartesian or nested-loop
joins, single-partition exchanges only over aggregated rows, no Python in
the parser and metric plans, and column pruning at the document scan."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

NATIVE = [
    "e1_eval_by_lang", "e2_eval_strict", "e3_eval_prompt_variants", "e4_eval_training_time",
    "e5_eval_generative", "x_parse_answers", "x2_x3_robust_extraction", "a3_per_class", "a5_macro_micro",
    "a12_class_counts", "a13_class_weights", "a14_length_profile", "r1_undersample", "r2_oversample",
    "r3_balanced", "r6_shuffle_index", "r8_random_n", "r9_e6_template_sweep_rows", "a11_e6_template_summary",
    "r11_length_batches", "j1_align_predictions", "j3_sweep_run_table", "a19_parser_side_by_side",
    "v1_encode", "v2_causal_examples", "v7_v8_p17_logits", "e7_classifier_report", "v9_v10_v11_losses",
    "v13_render_chat", "w1_early_stop", "p7_p8_normalise_texts", "u3_distinct_classes",
]


def _plan(spark, name):
    df = entry.queries()[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_over_aggregate(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        ok = False
        for nxt in lines[i + 1 :]:
            d = len(nxt) - len(nxt.lstrip(" :+-"))
            if d <= depth:
                break
            if re.search(r"HashAggregate|ObjectHashAggregate|SortAggregate|Scan ExistingRDD|InMemoryTableScan", nxt):
                ok = True
                break
        if not ok:
            return False
    return True


@pytest.mark.parametrize("name", NATIVE)
def test_plan_shape(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|PythonMapInArrow", plan)
    assert _single_partition_over_aggregate(plan), plan


def test_document_scan_is_pruned(spark):
    plan = _plan(spark, "e1_eval_by_lang")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "doc_id:bigint,text:string,lang:string" in schemas
    assert all("n_chars" not in s and "source" not in s for s in schemas)
