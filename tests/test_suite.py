"""Reports finished from the GROUPING SETS table equal the reports run alone."""

from __future__ import annotations

import pytest
from conftest import SF01

from bandwise.plans import reports as r
from bandwise.plans.catalog import ENTRIES, order_lines
from bandwise.plans.suite import SUITE_SETS, group_all
from bandwise.sources.bindings import CLAIM_TAGS_ALL

GROUPED = [e for e in ENTRIES if e.qid.startswith(("q", "n"))]


@pytest.fixture(scope="module")
def pair(spark):
    alone = order_lines(spark, SF01, "b")
    suite = order_lines(spark, SF01, "b")
    suite.materialize()
    group_all(suite, tags=CLAIM_TAGS_ALL)
    return alone, suite


@pytest.mark.parametrize("entry", GROUPED, ids=[e.qid for e in GROUPED])
def test_suite_equals_alone(pair, entry):
    alone, suite = pair
    assert entry.build(suite).collect() == entry.build(alone).collect()


def test_suite_reads_the_grouping_table(pair):
    _, suite = pair
    files = " ".join(r.category_summary(suite).inputFiles())
    assert "groups-" in files and "master-" not in files
    assert len({s for s in SUITE_SETS}) == len(SUITE_SETS)


def test_unknown_key_set_falls_back_to_the_master(pair):
    _, suite = pair
    g = r.summarize(suite, ("buyer",), ["age_group"], {"n": "count"})
    files = " ".join(g.inputFiles())
    assert "master-" in files and "groups-" not in files
