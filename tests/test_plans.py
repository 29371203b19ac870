"""What the plans of the catalog must and must not hold."""

import os

import pytest

from corpusloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

ROW_WISE = (
    "path_parts language file_flags admit_status binary_content admission_log token_estimate "
    "redact_default truncate_style truncate_svg truncate_json truncate_generic css_collapse "
    "rule_chain custom_rules extended_rules rule_applicability match_counts redaction_totals "
    "match_spans match_lines line_offsets safe_log unsafe_log log_headers md_sections "
    "xml_sections json_records source_specs size_literals vcs_dirs"
).split()


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_move_rows(spark, name):
    text = plan(spark, name)
    for operator in ("Exchange", "Window", "Join", "BatchEvalPython", "MapInArrow"):
        assert operator not in text, operator


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"file_scan", "file_admission"}))
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if name not in ("sample_files", "document_totals", "document_sink"):
        assert "SinglePartition" not in text


def test_trees_read_no_text(spark):
    lines = catalog.tree.tree_lines(catalog.corpus(spark, SF))
    plans = [plan(spark, "tree_dirs"), plan(spark, "ignored"), lines._jdf.queryExecution().executedPlan().toString()]
    for text in plans:
        assert "ReadSchema" in text
        for line in text.splitlines():
            if "ReadSchema" in line:
                assert "text:" not in line and "html:" not in line


def test_filters_on_names_reach_below_the_rules(spark):
    files = catalog.rules.rewrite(catalog._text_corpus(spark, SF)).where("path like 'docs/src1/%'")
    text = files._jdf.queryExecution().optimizedPlan().toString()
    assert text.rindex("Filter") > text.index("run(")
