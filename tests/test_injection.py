"""Injection chains against a plain breadth-first search."""

from tessera.plans import genetics

SF = "/root/testdata/sf0.001"


def test_chains_over_synapses(spark):
    near = {}
    for r in genetics.synapses(spark, SF).select("src", "dst").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    want = set()
    for r in genetics._asked(spark, SF).select("id").distinct().collect():
        seen = front = {r.id}
        for _ in range(5):
            front = {b for a in front for b in near.get(a, ())} - seen
            seen = seen | front
        if len(seen) > 3:
            want |= seen
    got = [r.id for r in genetics.QUERIES["injection_chains"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    print(len(got))
