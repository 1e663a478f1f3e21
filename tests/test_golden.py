from loamline.operators import golden
from loamline.plans import golden_queries as Q


def test_shape_seed_and_restriction(spark, sf):
    every = Q.cases(spark, sf)
    assert every.columns == golden.CASE
    pick = lambda seed: sorted((r.kind, r.case_id) for r in golden.sample(every, seed).collect())
    one, again, other = pick(1), pick(1), pick(2)
    assert one == again != other
    assert {k: sum(x == k for x, _ in one) for k in golden.SHAPE} == golden.SHAPE and len(one) == 121
    rows = every.collect()
    assert len({r.case_id for r in rows}) == len(rows)
    allowed = {r.case_id: r for r in rows if not r.must_refuse}
    for r in rows:
        if r.must_refuse:
            base = allowed[r.case_id.removeprefix("acl-")]
            assert not set(r.groups) & set(base.groups) and r.forbidden == base.expected_facts and not r.expected_facts and r.question == base.question
    assert golden.sample(every.limit(0), 1).collect() == []
