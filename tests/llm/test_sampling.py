import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowan.llm._flow import MinCostFlow, controlled_rounding, pooled_rounding, shared_amounts
from rowan.llm.sampling import StratifiedSamples, spread, stable_sample, take_ranges

CASES = "row_id bigint, case_id string, stratum string, split string, batch_no int, extra string"
PLANS = "plan_id bigint, plan_name string, requested_size bigint, seed bigint, selection_policy string"
QUOTAS = "plan_id bigint, stratum string, quota bigint, min_rows bigint"


@given(st.lists(st.lists(st.fractions(0, 9, max_denominator=12), min_size=3, max_size=3), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_rounding_keeps_all_margins(table):
    out = controlled_rounding(table)
    near = lambda n, x: int(x // 1) <= n <= -int(-x // 1)
    assert all(near(n, x) for a, b in zip(out, table) for n, x in zip(a, b))
    assert all(near(sum(a), sum(b)) for a, b in zip(out, table))
    assert all(near(sum(a), sum(b)) for a, b in zip(zip(*out), zip(*table)))
    assert near(sum(map(sum, out)), sum(map(sum, table)))


@given(st.integers(0, 60), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.integers(0, 20)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_spread_fills_the_size_within_bounds(total, rows):
    shares, lower, upper = [s for s, *_ in rows], [min(lo, u) for _, lo, u in rows], [u for *_, u in rows]
    out = spread(total, shares, lower, upper)
    assert all(lo <= x <= max(lo, u) for x, lo, u in zip(out, lower, upper))
    reach = sum(u if s else lo for s, lo, u in zip(shares, lower, upper))
    assert sum(out) == max(sum(lower), min(total, reach))
    assert all(isinstance(x, Fraction) for x in out)


def test_min_cost_flow_repeats_only_when_needed():
    # 10 tokens that both sinks may use, 5 that only the first may; each further use costs more
    net = MinCostFlow(6)
    for n in (1, 2, 3):
        net.arc(4, 0, 10, n)
        net.arc(4, 1, 5, n)
    both = [net.arc(0, 2, 30, 0), net.arc(0, 3, 30, 0)]
    only = net.arc(1, 2, 15, 0)
    net.arc(2, 5, 8, 0)
    net.arc(3, 5, 12, 0)
    assert net.run(4, 5) == (20, 10 * 1 + 5 * 1 + 2 * 2 + 3 * 2 - 0)
    assert net.flow(both[1]) == 12 and net.flow(both[0]) + net.flow(only) == 8


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sample_tables(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        s = rng.choice(["Alpha Beta", "alpha-beta ", "ALPHA_BETA", "gamma", "\tGamma", "rare", None, ""] + ["gamma"] * 8)
        case = f"c{i // 2}" if s in ("rare",) else f"c{i}"
        rows += [(i, rng.choice([case, case.upper(), f" {case}\t"]), s, rng.choice(["x", "y", None]), rng.randrange(3), "z")] * rng.choice([1, 1, 2])
    rows.append((None, None, "gamma", None, None, None))
    plans = [(1, "a", 40, 7, None), (2, "b", 10, None, None), (3, "c", None, 1, None)]
    quotas = [(1, "alpha_beta", 3, 2), (1, "gamma", 2, 2), (1, "Rare", 5, 90), (1, "none", 1, 1), (2, "gamma", 1, None), (3, "gamma", None, None), (1, None, 1, 1), (9, "gamma", 1, 1)]
    return make(spark, rows, CASES), make(spark, plans, PLANS), make(spark, quotas, QUOTAS)


def test_stratified_samples_against_brute_force(spark):
    cases, plans, quotas = sample_tables(spark)
    s = StratifiedSamples(cases, plans, quotas)
    label = lambda x: (x or "").strip().lower().replace(" ", "_").replace("-", "_") or None
    have = {}
    for r in cases.collect():
        if r.case_id and label(r.stratum):
            have.setdefault(label(r.stratum), set()).add(r.case_id.strip().lower())
    report = {(r.plan_id, r.stratum): r for r in s.report().collect()}
    for (p, name), r in report.items():
        assert r.available == len(have.get(label(name), ()))
        assert (r.reason == "scarce") == (r.available < r.required) and r.short == (r.allotted < r.required) == (r.reason is not None)
    assert report[1, "Rare"].required == 90 and report[1, "Rare"].short
    drawn = s.draw().collect()
    assert len({(r.plan_id, r.case_id) for r in drawn}) == len(drawn)
    for (p, name), r in report.items():
        mine = [x for x in drawn if (x.plan_id, x.stratum) == (p, label(name))]
        assert len(mine) == r.allotted and all(x.case_id in have[x.stratum] for x in mine)
    assert sum(r.plan_id == 2 for r in drawn) == 10 and not any(r.plan_id in (3, 9) for r in drawn)
    again = StratifiedSamples(cases.repartition(7), plans, quotas).draw().collect()
    assert set(again) == set(drawn)


def test_cases_of_several_strata_go_where_they_are_needed(spark):
    both = [(i, f"c{i}", s, "x", 0, "z") for i in range(10) for s in ("a", "b")]
    cases = make(spark, both + [(99, f"only{i}", "a", "y", 0, "z") for i in range(3)], CASES)
    plans = make(spark, [(1, "p", 5, 1, None), (2, "q", 5, 1, None), (3, "r", 12, 1, None), (4, "s", 20, 1, None)], PLANS)
    quotas = make(spark, [(1, "a", 1, 0), (2, "b", 1, 5), (3, "a", 1, 0), (3, "b", 1, 8), (4, "a", 1, 6), (4, "b", 1, 8)], QUOTAS)
    s = StratifiedSamples(cases, plans, quotas)
    report = {(r.plan_id, r.stratum): r for r in s.report().collect()}
    assert [report[k].allotted for k in ((1, "a"), (2, "b"), (3, "a"), (3, "b"))] == [5, 5, 4, 8]
    assert not report[2, "b"].short and report[2, "b"].available == 10
    assert report[4, "a"].allotted + report[4, "b"].allotted == 13 and report[4, "b"].reason in (None, "shared") and any(report[4, x].short for x in "ab")
    drawn = s.draw().collect()
    assert len({(r.plan_id, r.case_id) for r in drawn}) == len(drawn) == 5 + 5 + 12 + 13
    for k, r in report.items():
        mine = [x for x in drawn if (x.plan_id, x.stratum) == k]
        assert len(mine) == r.allotted and all(x.stratum == "a" or not x.case_id.startswith("only") for x in mine)


@given(st.lists(st.tuples(st.sets(st.sampled_from("abc"), min_size=1), st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5)), min_size=3, max_size=3), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_shared_supplies_are_used_whole(groups, wishes, total):
    supply = {(i, *sorted(p)): x + y for i, (p, x, y) in enumerate(groups)}
    demand = [(s, {k for k in supply if s in k}, lo, share, sum(n for k, n in supply.items() if s in k)) for s, (share, lo) in zip("abc", wishes)]
    parts = shared_amounts(supply, demand, total, spread)
    assert all(sum(x for (k, _), x in parts.items() if k == q) <= n for q, n in supply.items())
    assert all(s in k for k, s in parts)
    # nothing that could still serve a demand with a share is left over below the total
    used = sum(parts.values())
    left = {k for k, n in supply.items() if sum(x for (q, _), x in parts.items() if q == k) < n}
    assert used >= total or not any(k in q for s, q, _, share, _ in demand if share for k in left)
    table = [[{k: parts[k, s] * Fraction(c, supply[k]) for k in supply if (k, s) in parts} for c in (1, 1)] for s in "abc"]
    table = [[{k: parts[k, s] * Fraction(groups[k[0]][1 + j], supply[k]) for k in supply if (k, s) in parts} for j in (0, 1)] for s in "abc"]
    pools = {(k, j): groups[k[0]][1 + j] for k in supply for j in (0, 1)}
    out = pooled_rounding(table, pools)
    for k, j in pools:
        assert sum(r[j].get(k, 0) for r in out) <= pools[k, j]
    near = lambda n, x: int(x // 1) <= n <= -int(-x // 1)
    total_of = lambda cells: sum((x for c in cells for x in c.values()), Fraction(0))
    assert all(near(total_of(a), total_of(b)) for a, b in zip(out, table))
    assert all(near(total_of([a[j]]), total_of([b[j]])) for a, b in zip(out, table) for j in (0, 1))


def test_take_ranges_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("gh"), rng.choice([rng.getrandbits(63), -5, 7, 1 << 60]), i) for i in range(600)]
    df = make(spark, rows, "g string, k bigint, id bigint")
    ranges = [("g", "one", 0, 40), ("g", "two", 40, 41), ("g", "three", 100, 1000), ("h", "four", 3, 3)]
    got = {(r.name, r.id) for r in take_ranges(df, ["g"], "k", "id", make(spark, ranges, "g string, name string, lo bigint, hi bigint")).collect()}
    order = {g: [i for *_, i in sorted((k % (1 << 64) >> 52, k, i) for x, k, i in rows if x == g)] for g in "gh"}
    assert got == {(name, i) for g, name, lo, hi in ranges for i in order[g][lo:hi]}


def test_stratified_samples_of_empty_tables(spark):
    cases, plans, quotas = sample_tables(spark)
    s = StratifiedSamples(cases.limit(0), plans, quotas)
    assert s.draw().count() == 0 and {r.available for r in s.report().collect()} == {0}
    assert StratifiedSamples(cases, plans.limit(0), quotas).report().count() == 0
    assert StratifiedSamples(cases, plans, quotas.limit(0)).draw().count() == 0


def test_stable_sample_keeps_what_it_chose(spark):
    cases, plans, _ = sample_tables(spark)
    got = [{(r.plan_id, r.case_id) for r in stable_sample(cases.filter(f"batch_no <= {b}").repartition(b + 1), plans, buckets=64).collect()} for b in range(3)]
    assert got[0] and got[0] <= got[1] <= got[2]
    first = cases.filter("batch_no = 0 and case_id is not null").collect()
    keys = {r.case_id.strip().lower() for r in first}
    assert len([k for p, k in got[0] if p == 1]) >= min(40, len(keys))
    assert set(stable_sample(cases.orderBy("split"), plans, buckets=64).collect()) == set(stable_sample(cases.repartition(9), plans, buckets=64).collect())
    assert stable_sample(cases.limit(0), plans).count() == 0
    assert stable_sample(cases, plans.limit(0)).count() == 0


@pytest.mark.parametrize("late", [0, 1, 2])
def test_kept_lists_lose_nothing_whatever_arrives(spark, tmp_path, late):
    cases, plans, _ = sample_tables(spark)
    lists = str(tmp_path / "lists")
    chosen = lambda df, p=plans: {(r.plan_id, r.case_id) for r in stable_sample(df, p, buckets=64, lists=lists).collect()}
    first = chosen(cases.filter("batch_no = 1"))
    more = make(spark, [(1000 + i, f"late{i}", "gamma", "x", late, "z") for i in range(300)], CASES)
    second = chosen(cases.filter("batch_no = 1").unionByName(more))
    third = chosen(cases.unionByName(more).repartition(5))
    assert first and first < second <= third and third == chosen(cases.unionByName(more))
    larger = make(spark, [(1, "a", 200, 7, None), (4, "d", 5, 3, None)], PLANS)
    fourth = chosen(cases.unionByName(more), larger)
    assert {x for x in third if x[0] == 1} <= fourth and len([x for x in fourth if x[0] == 1]) >= 200 and any(p == 4 for p, _ in fourth)
    assert {x for x in chosen(cases.unionByName(more)) if x[0] == 1} == {x for x in fourth if x[0] == 1}
    assert chosen(cases.limit(0)) == set()


def test_too_large_a_small_table_is_an_error(spark):
    from rowan.llm.sampling import collect_small

    with pytest.raises(ValueError):
        collect_small(spark.range(10), "numbers", 5)
