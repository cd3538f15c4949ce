"""What the large joins carry: numbers where numbers do, and one row for each thing that is resolved."""

import os

import pytest

import __spark_entry__ as entry
from factloom.plans import queries_edges as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_names_are_resolved_once_for_each_source(spark, monkeypatch):
    met, parts = [], spark.read.parquet(f"{SF}/part.parquet")
    for name in ("candidate_ladder", "resolve_types"):
        monkeypatch.setattr(Q.R, name, lambda refs, known, own=getattr(Q.R, name): met.append(refs) or own(refs, known))
    for name in ("jn7_call_ladder", "jn1_resolve_types"):
        entry._core.QUERIES[name](spark, SF)
    assert [x.count() for x in met] == [parts.select("p_brand", "p_type", "p_name").distinct().count()] * 2


@pytest.mark.parametrize("name", ["gr6_drift_cli", "gr7_drift_view", "ag10_drift_summary", "ag10_severity_histogram", "tk3_drift_sections"])
def test_owners_are_aggregated_as_numbers(spark, name):
    """No aggregation holds paths, which would sort all owners; pairs of items and owners are told apart by their numbers."""
    plan = entry._core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_hits_are_ranked_where_they_are_found(spark):
    """Segments and probes are shuffled by cell; what is found for a probe is grouped and ranked in the task that found it."""
    plan = entry._core.QUERIES["tk9_paths_at_point"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("probe" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)


def test_nodes_stay_out_of_the_driver(spark):
    """Parts are not broadcast for the graph they make, nor depths for its edges."""
    from factloom.plans.adapters import read

    for df in (read(spark, SF, "dag"), entry._core.QUERIES["gr9_forward_split"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(f"BroadcastHashJoin [{key}#" in plan for key in ("l_partkey", "src", "dst"))


@pytest.mark.parametrize(("name", "operator"), [("ag1_edge_profile", "edge_profile"), ("ag1_profile_maps", "profile_maps"), ("ag6_survey_types", "edge_totals"), ("ag27_fields_pointing_at", "fields_pointing_at"), ("ag27_member_rows", "field_rows")])
def test_edges_are_aggregated_by_numbers(spark, monkeypatch, name, operator):
    """Ends of line items are numbers until the groups are made; directions share one shuffle instead of one row for each."""
    from factloom.plans import queries_lookups

    met, home = [], Q.E if hasattr(Q.E, operator) else queries_lookups.L
    monkeypatch.setattr(home, operator, lambda edges, own=getattr(home, operator): met.append(edges) or own(edges))
    plan = entry._core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [dict(x.dtypes)[c] for x in met for c in ("from_id", "to_id")] == ["bigint"] * 2
    assert name != "ag1_edge_profile" or "Expand" not in plan


def test_equal_paths_have_one_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.plans.adapters import named, numbered_edges

    for t in ("region", "nation", "orders", "lineitem", "supplier", "customer"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "customer":
            df = df.withColumn("c_name", F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("c"), F.col("c_custkey") % 3))).withColumn("c_nationkey", F.col("c_nationkey") % 2)
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    edges, names = numbered_edges(spark, str(tmp_path))
    got = named(Q.E.edge_profile(edges), names, "id")
    want = Q.E.edge_profile(Q.read(spark, str(tmp_path), "edges"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.where("id is null").count() == 1


def test_hits_are_never_sorted_as_a_whole(spark):
    """What is found may be far more than what is read: only segments and probes are sorted, by cell, and so can spill."""
    plan = entry._core.QUERIES["tk9_paths_at_point"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    done = plan.splitlines()
    assert "SortAggregate" not in plan and "ShuffledHashJoin" not in plan
    assert not any("probe" in x for x in done if "Window" in x or "- Sort [" in x)


@pytest.mark.parametrize("pairs", [1, 40, 1 << 19])
def test_paths_at_points_by_any_number_of_pairs(spark, pairs):
    """Named paths, a step without length, probes asked twice and without a place, equal distances; a few pairs at a time give the same rows."""
    import math
    import random

    from factloom.operators.geometry import paths_at

    r = random.Random(3)
    points = [(f"p{i}", k, float(r.randrange(90) - 20), float(r.randrange(90) - 20)) for i in range(40) for k in range(r.randrange(1, 6))]
    points += [("still", 0, 5.0, 5.0), ("still", 1, 5.0, 5.0), ("equal", 0, 5.0, 5.0), ("equal", 1, 5.0, 5.0), ("gone", 0, 5.0, 5.0), ("gone", 1, None, None), (None, 0, 4.0, 5.0), (None, 1, 6.0, 5.0)]
    probes = [(i, float(r.randrange(80) - 15), float(r.randrange(80) - 15)) for i in range(60)] + [(90, 5.0, 5.0), (90, 5.0, 5.0), (91, None, 5.0)]
    want = {}
    for probe, x, y in {q for q in probes if None not in q}:
        found = []
        for path in {p[0] for p in points}:
            own = sorted(p[1:] for p in points if p[0] == path)
            steps, before, near = [(a, b) for a, b in zip(own, own[1:]) if b[1] is not None], 0.0, []
            length = sum(math.sqrt((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) for a, b in steps)
            for (k, ax, ay), (_, bx, by) in steps:
                square = (bx - ax) ** 2 + (by - ay) ** 2
                size, t = math.sqrt(square), min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (square or 1)))
                d = math.sqrt((x - (ax + (bx - ax) * t)) ** 2 + (y - (ay + (by - ay) * t)) ** 2)
                near += [(round(d, 9), k, before + t * size)] if d <= 6 else []
                before += size
            if near:
                d, _, at = min(near)
                found.append((d, path is not None, path or "", "source" if at <= length / 2 else "target"))
        want[probe] = [(p if named else None, d, zone) for d, named, p, zone in sorted(found)]
    got = {}
    kinds = "path string, ord int, x double, y double"
    for row in paths_at(spark.createDataFrame(probes, "probe int, x double, y double"), spark.createDataFrame(points, kinds), 6, pairs=pairs).orderBy("probe", "rank").collect():
        got.setdefault(row.probe, []).append((row.path, round(row.distance, 9), row.zone))
        assert row["rank"] == len(got[row.probe])
    assert got == {k: v for k, v in want.items() if v} and sum(map(len, got.values())) > 100
