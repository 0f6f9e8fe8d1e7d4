"""What goes through joins: no fields that are judged before, no pairs that no condition lets stay."""

import re

from quillgraph import catalog


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_candidates_are_judged_before_the_joins(spark, small):
    above = _plan(catalog.QUERIES["id05_validate_edges"](spark, small)).split("Join")[0]
    assert "has_source" in above and "bits" in above
    assert not [c for c in ("citation_url#", "document_date#", "reason#", "weight#") if c in above]


def test_competitors_meet_on_person_and_trade(spark, small):
    plan = _plan(catalog.QUERIES["ag25_competitor_links"](spark, small))
    own = [x for x in re.findall(r"Join Inner, (.*)", plan) if re.search(r"person#\d+ = person#\d+", x)]
    assert len(own) == 2 and all(re.search(r"sic#\d+ = sic#\d+", x) for x in own)
