"""The stability rule's scores, whose last bit decides between opposite rules."""

import pytest

from tests.harness import compare, duck
from tidemark.catalog import load


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_opposite_rules_rank_as_in_the_sql(spark, root):
    queries, sql = load()
    name = "r17_stability_rule"
    verdict = compare(spark, duck(root), root, name, queries[name], sql[name])
    assert verdict.startswith("ok"), verdict
