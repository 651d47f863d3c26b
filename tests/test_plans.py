"""Physical-plan properties of the headline queries (the scale contract)."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def executed_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["features_train", "features_test_enriched", "mi_binned", "stratified_folds",
                                  "random_oversample", "balanced_bags", "pr_curve", "roc_auc", "numeric_summary",
                                  "distinct_report", "status_mean", "region_billing_median"])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = executed_plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_feature_plan_prunes_and_never_joins_invoices(spark):
    from meterwise.operators.client_features import client_aggregates
    from meterwise.sources.fixtures import view
    invoice = view(spark, SF, "invoice")
    agg = client_aggregates(invoice).select("client_id", "consommation_level_1_mean")
    plan = agg._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    # only the columns the kept aggregate needs reach the scan
    assert "counter_number" not in scan and "reading_remarque" not in scan
    # partial aggregation happens before the shuffle
    assert re.search(r"HashAggregate\(keys=\[client_id#\d+L?\], functions=\[partial_", plan)
    # the invoice rows are aggregated before meeting any other table
    full = executed_plan(entry.queries()["features_train"](spark, SF))
    firsts = first_ops_above(full, "input-invoice")
    assert firsts and set(firsts) == {"aggregate"}


def first_ops_above(plan: str, marker: str):
    """For each scan whose line holds ``marker``: the first aggregate or
    join found walking up the plan tree."""
    lines = plan.split("\n")

    def depth(line):
        m = re.search(r"[+:]- ", line)
        return (m.start() // 3 + 1) if m else 0

    out = []
    for i, line in enumerate(lines):
        if "FileScan parquet" not in line or marker not in line:
            continue
        d, j, first = depth(line), i, None
        while j > 0 and first is None:
            j -= 1
            if depth(lines[j]) < d:
                d = depth(lines[j])
                node = re.sub(r"^[\s:+\-*()0-9]*", "", lines[j])
                if node.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
                    first = "aggregate"
                elif "Join" in node.split(" ")[0]:
                    first = "join"
        out.append(first)
    return out


def test_walker_detects_a_direct_join(spark):
    from meterwise.sources.fixtures import view
    client, invoice = view(spark, SF, "client"), view(spark, SF, "invoice")
    plan = executed_plan(client.join(invoice, "client_id").groupBy("region").count())
    assert "join" in first_ops_above(plan, "input-invoice")
