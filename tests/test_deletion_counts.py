"""Counts after a deletion, and parts that follow the number of triples."""

import random

import pytest

from chronoloom.operators import incremental as I


@pytest.fixture(scope="module")
def stored():
    rng = random.Random(2)
    return [(d, rng.choice(["a", "b", "c", "", f"own {d}"]), rng.choice("xy"), rng.choice(["a", "d", "", None, f"o{d // 3}"]))
            for d in range(60) for _ in range(rng.randrange(1, 6))]


@pytest.mark.parametrize("gone", [[], [3, 4, 5, 5, 17, 999], list(range(60))])
def test_counts_by_hand(spark, stored, gone):
    got = I.delete_documents(spark.createDataFrame(stored, "doc bigint, s string, p string, o string"),
                             spark.createDataFrame([(g,) for g in gone], "doc bigint"), part_rows=20).first().asDict()
    kept = [r for r in stored if r[0] not in gone]
    facts, all_facts = {r[1:] for r in kept}, {r[1:] for r in stored}
    names, all_names = ({e for r in rows for e in (r[1], r[3]) if e} for rows in (kept, stored))
    assert got == {"n_docs": len({r[0] for r in kept}), "n_facts": len(facts), "n_facts_gone": len(all_facts - facts), "n_entities": len(names),
                   "n_entities_gone": len(all_names - names), "n_passage_edges": len({(r[0], e) for r in kept for e in (r[1], r[3]) if e})}


def test_parts_grow_with_the_triples(spark, stored):
    df = spark.createDataFrame(stored, "doc bigint, s string, p string, o string")
    plan = I.delete_documents(df, df.select("doc").limit(3), part_rows=10)._jdf.queryExecution().executedPlan().toString()
    n = -(-len(stored) // 10)
    assert plan.count(f"hashpartitioning(doc") >= 2 and f", {n}), REPARTITION_BY_NUM" in plan
    assert plan.count("Join ") <= 3          # two passes and the row of each
