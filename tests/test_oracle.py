"""Every registered query against its SQL on the small tables."""

import pytest
from oracle import compare

from epiflux.plans import load_all

QUERIES, ORACLES = load_all()

# cutoffs that the smallest tables do not reach
MAY_BE_EMPTY = {"case_onset_cut", "place_unmatched", "hashtag_counts"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    rows, problems = compare(spark, folder, name, QUERIES[name], ORACLES.get(name))
    assert not problems, problems
    if name not in MAY_BE_EMPTY:
        assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
