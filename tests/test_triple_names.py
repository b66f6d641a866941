"""Names of triples are normalized once per part and supplier, not once per triple and use."""

import pytest

from chronoloom import catalog
from chronoloom.catalog import views as V
from chronoloom.catalog.registry import Tables
from chronoloom.operators import graph_build as B

SMALL = "/root/testdata/sf0.001"


def test_names_normalized_before_the_join_are_those_after_it(spark):
    t = Tables(spark, SMALL)
    early, late = V.normal_triples(t).select("doc", "s", "p", "o"), B.normalized(V.triples(t))
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))
    assert V.normal_triples(t).columns == V.triples(t).columns


@pytest.mark.parametrize("name", ["graph_info", "graph_edges", "entity_nodes", "fact_doc_index", "phrase_weights"])
def test_no_pattern_is_matched_behind_a_join(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(plan)}
    for i in [i for i, line in enumerate(plan) if "regexp_replace" in line]:
        below = []
        for j in range(i + 1, len(plan)):
            if depth[j] <= depth[i]:
                break
            below.append(plan[j])
        assert not any("Join" in line for line in below), plan[i]
