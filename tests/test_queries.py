"""A spread of the registered queries against their SQL on the smallest data set.

`python -m checks.compare <sf_dir>` runs all of them.
"""

import os

import pytest

from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SHOWN = [
    "shred_html", "page_xml", "text_content", "sanitize_pages", "parse_answers", "pick_first_unit", "fuzzy_node_match",
    "condense_pages", "eval_selector", "classify_feedback", "select_best", "reference_field", "problem_rows",
    "reconcile", "run_all_stages",
]


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SHOWN)
def test_query(spark, name):
    ok, note = compare(spark, SF, QUERIES[name], ORACLES[name])
    assert ok, note
