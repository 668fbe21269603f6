"""The general training-data operators: cases by hand, brute force, edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paneloom.operators.asof import known_at
from paneloom.operators.features import as_of_features, cumulative_store, daily_totals, item_type, wide_features
from paneloom.operators.history import fill_from_neighbours, latest_delivery, snapshot_changes, version_history
from paneloom.operators.impute import fill_missing, fit_tree

T0 = dt.datetime(2020, 1, 1)
at = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- features


def test_item_type(spark):
    labels = ["Item 5.02(b)", "ITEM 5.02 (B)", "5.02-b.", " 5.02 b ", "5.02.", "item 5.02", "Exhibits", "", None, "see text", "N/A", "12.01(a)", "5.02 and more", "15.021"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(item_type("l")).collect()] == ["5.02(b)"] * 4 + ["5.02"] * 2 + [None] * 5 + ["12.01(a)", "5.02", None]


EVENTS = "e long, t timestamp, id string, types array<string>, x long, day string, n long"


def store(spark, data):
    return cumulative_store(daily_totals(spark.createDataFrame(data, EVENTS), "e", "types", "t", "id", ["x"]), ["x"])


def test_windows_copies_ties_and_nulls(spark):
    data = [
        (1, at(0), "b", ["p", "q", "p"], 5, "clash", 7), (1, at(0), "b", ["p", "q"], 5, None, None),  # a copy and a repeated type
        (1, at(10), "d", ["p"], None, None, None), (1, at(10), "c", ["p"], 3, None, None), (1, at(10, -1), "a", ["p"], 1, None, None),
        (None, at(1), "z", ["p"], 1, None, None), (2, None, "y", ["p"], 1, None, None), (2, at(1), "x", None, 1, None, None), (2, at(1), "w", [None], 1, None, None),
    ]
    f = as_of_features(store(spark, data), "2020-01-11", ["x"], {"5d": 5})
    out = rows(f.select("entity", "event_type", "n", "x", "n_5d", "x_5d", "newest", "newest_id"), "event_type")
    assert out == [(1, "p", 4, 9, 3, 4, at(10), "c"), (1, "q", 1, 5, 0, 0, at(0), "b")]
    early = as_of_features(store(spark, data), "2020-01-05", ["x"])
    assert rows(early.select("event_type", "n", "newest_id"), "event_type") == [("p", 1, "b"), ("q", 1, "b")]


def test_features_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 3]), at(rng.randrange(60), rng.randrange(24)), str(i), rng.sample("abcd", rng.randrange(4)), rng.randrange(9), "", 0) for i in range(400)]
    f = as_of_features(store(spark, data), "2020-02-10", ["x"], {"7d": 7})
    end = at(41)
    want = {}
    for e, t, i, types, x, *_ in data:
        for k in types:
            if t < end:
                w = want.setdefault((e, k), [0, 0, 0, None])
                w[0] += 1
                w[1] += x
                w[2] += t >= at(34)
                w[3] = min(w[3] or (T0 - t, i), (T0 - t, i))
    assert {(r.entity, r.event_type): [r.n, r.x, r.n_7d, (T0 - r.newest, r.newest_id)] for r in f.collect()} == want


def test_features_empty_and_wide(spark):
    empty = as_of_features(store(spark, []), "2020-01-11", ["x"])
    assert empty.count() == 0 and wide_features(empty, ["n"]).count() == 0
    f = as_of_features(store(spark, [(1, at(0), "b", ["5.02(b)"], 5, "", 0), (2, at(1), "c", ["5.02"], 2, "", 0)]), "2020-01-11", ["x"])
    wide = wide_features(f, ["n", "newest"], ["n"])
    assert wide.columns == ["entity", "t_5_02_n", "t_5_02_newest", "t_5_02_b_n", "t_5_02_b_newest"]
    assert rows(wide, "entity") == [(1, 0, None, 1, at(0)), (2, 1, at(1), 0, None)]
    assert wide_features(f, ["n"], ["n"]).columns == ["entity", "t_5_02_n", "t_5_02_b_n"]
    with pytest.raises(ValueError):
        wide_features(f, ["n"], max_types=1)
    with pytest.raises(ValueError):
        daily_totals(spark.createDataFrame([], EVENTS), "e", "types", "t", "id", ["n"])


# ---- as of


def as_of(spark, events, changes, **more):
    e = spark.createDataFrame(events, "id string, p long, t timestamp, at string, entity string")
    c = spark.createDataFrame(changes, "p long, loaded timestamp, m int, v int, a string, id string, best string")
    return known_at(e, c, event_entity="p", event_time="t", keep=["id"], change_entity="p", available_at="loaded", rank=["m", "v"], attributes=["a"], **more)


def test_known_at_ties_and_later_values(spark):
    changes = [(1, at(0), 1, 1, "old", "", ""), (1, at(5), 2, 2, "new", "", ""), (1, at(200), 1, 3, "correction of old", "", ""), (1, at(5), 2, 2, "new", "", ""), (2, None, 1, 1, "never", "", ""), (None, at(0), 1, 1, "x", "", "")]
    events = [("before", 1, at(-1), "", ""), ("same", 1, at(5), "", ""), ("between", 1, at(4, 23), "", ""), ("late", 1, at(900), "", ""), ("late", 1, at(900), "", ""), ("none", 2, at(9), "", ""), ("nokey", None, at(9), "", ""), ("notime", 1, None, "", "")]
    out = rows(as_of(spark, events, changes).select("id", "m", "v", "a"), "id")
    assert out == [("before", None, None, None), ("between", 1, 1, "old"), ("late", 2, 2, "new"), ("nokey", None, None, None), ("none", None, None, None), ("notime", None, None, None), ("same", 2, 2, "new")]
    assert [r[0] for r in rows(as_of(spark, events, changes, drop_unmatched=True), "id")] == ["between", "late", "same"]


def test_known_at_against_brute_force(spark):
    rng = random.Random(2)
    changes = list({(p, l): (rng.choice([1, 2, 2, 3]) if p else p, at(l), rng.randrange(12), l, rng.choice("xyz"), "", "") for p in range(1, 4) for l in range(0, 700, 31)}.values())
    events = [(str(i), rng.choice([1, 2, 3, 4]), at(rng.randrange(-40, 900), rng.randrange(24)), "", "") for i in range(300)]
    got = {r["id"]: (r["m"], r["v"], r["a"]) for r in as_of(spark, events, changes).collect()}
    for i, p, t, *_ in events:
        assert got[i] == max(((m, v, a) for q, l, m, v, a, *_ in changes if q == p and l <= t), default=(None, None, None))


def test_known_at_truncation(spark):
    """What is known at an event does not depend on anything that comes later."""
    changes = [(1, at(d), d % 7, d, "a", "", "") for d in range(0, 300, 9)]
    events = [(str(d), 1, at(d), "", "") for d in range(0, 300, 5)]
    whole = [r for r in rows(as_of(spark, events, changes), "id") if int(r[0]) <= 100]
    assert whole == rows(as_of(spark, [e for e in events if e[2] <= at(100)], [c for c in changes if c[1] <= at(100)]), "id")


def test_known_at_empty(spark):
    assert as_of(spark, [], []).count() == 0
    assert rows(as_of(spark, [("x", 1, at(0), "", "")], []), "id") == [("x", None, None, None)]
    assert as_of(spark, [], [(1, at(0), 1, 1, "a", "", "")]).count() == 0


# ---- history

M = [dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31), dt.date(2020, 4, 30), dt.date(2020, 5, 31)]


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, M[0], 1, "a"), (1, M[0], 3, "c"), (1, M[0], 3, "c"), (1, M[0], None, "z"), (2, M[0], None, "n"), (None, M[0], 1, "k")], "p long, m date, d int, v string")
    assert sorted(map(tuple, latest_delivery(df, ["p", "m"], "d", ["v"]).select("p", "d", "v").collect()), key=str) == [(1, 3, "c"), (2, None, "n"), (None, 1, "k")]
    assert latest_delivery(df.limit(0), ["p", "m"], "d", ["v"]).count() == 0


def history(spark, data):
    df = fill_from_neighbours(spark.createDataFrame(data, "p long, m date, a string, b string"), "p", "m", ["a", "b"])
    return version_history(snapshot_changes(df, "p", "m", ["a", "b"]), "p", ["a", "b"])


def test_versions_gaps_returns_and_nulls(spark):
    data = [(1, M[0], None, None), (1, M[1], "x", None), (1, M[3], "x", None), (1, M[4], "y", None), (2, M[0], "x", "1"), (2, M[1], "y", "1"), (2, M[2], "x", "1"), (2, M[4], "z", "1"), (3, M[2], "q", "1")]
    assert rows(history(spark, data), "p", "valid_from") == [
        (1, M[0], M[3], "x", None), (1, M[4], M[4], "y", None), (2, M[0], M[0], "x", "1"), (2, M[1], M[1], "y", "1"), (2, M[2], M[2], "x", "1"), (2, M[4], M[4], "z", "1"), (3, M[2], M[2], "q", "1"),
    ]


def test_history_against_walk(spark):
    rng = random.Random(3)
    months = [dt.date(2020 + k // 12, k % 12 + 1, 28) for k in range(20)]
    data = [(p, m, rng.choice([None, "a", "b"]), rng.choice([None, "u", "u", "v"])) for p in range(12) for m in months if rng.random() < 0.7]
    want = []
    for p in range(12):
        own = [list(r) for r in data if r[0] == p]
        for c in (2, 3):
            known = [r[c] for r in own if r[c] is not None]
            now = known[0] if known else None
            for r in own:
                now = r[c] if r[c] is not None else now
                r[c] = now
        for r in own:
            if want and want[-1][0] == p and want[-1][3:] == tuple(r[2:]):
                want[-1] = (p, want[-1][1], r[1], *r[2:])
            else:
                want.append((p, r[1], r[1], *r[2:]))
    assert rows(history(spark, data), "p", "valid_from") == want


def test_changes_kinds_and_empty(spark):
    df = spark.createDataFrame([(1, M[0], "a"), (1, M[1], "b"), (2, M[0], None), (2, M[1], None), (None, M[1], "n"), (3, None, "x")], "p long, m date, a string")
    kinds = sorted(((r["p"], r["kind"]) for r in snapshot_changes(df, "p", "m", ["a"]).collect()), key=str)
    assert kinds == [(1, "changed"), (1, "deleted"), (1, "inserted"), (2, "deleted"), (2, "inserted"), (None, "deleted"), (None, "inserted")]
    assert history(spark, []).count() == 0
    with pytest.raises(ValueError):
        snapshot_changes(df.withColumn("kind", F.lit(1)), "p", "m", ["kind"])


# ---- filling


def test_fill_recovers_dependent_fields(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        g = rng.choice("ABC")
        x = {"A": 1.0, "B": 5.0, "C": 9.0}[g] + rng.gauss(0, 0.3)
        hide = rng.random()
        data.append((i, None if hide < 0.1 else g, float("nan") if 0.1 <= hide < 0.2 else x, g + "!", x, g))
    df = spark.createDataFrame(data, "i long, g string, x double, twin string, true_x double, true_g string")
    tree = fit_tree(df, {"x": 9}, ["g", "twin"])
    out = fill_missing(df, tree, ["g", "x"]).collect()
    assert len(out) == 3000 and sum(r["g_filled"] for r in out) == sum(r[1] is None for r in data)
    assert all(r["g"] == r["true_g"] for r in out)
    assert all(r["x_filled"] == (r["x"] != r["true_x"]) for r in out)
    assert sum(abs(r["x"] - r["true_x"]) for r in out if r["x_filled"]) / sum(r["x_filled"] for r in out) < 0.5


def test_posteriors_equal_enumeration():
    import numpy as np

    from paneloom.operators.impute import Field, chow_liu

    rng = np.random.default_rng(5)
    fields = [Field(str(i), False, values=list("abc")) for i in range(4)]
    joint = rng.random((3, 3, 3, 3)) ** 4
    counts = {(i, j): (np.diag(joint.sum(tuple(k for k in range(4) if k != i))) if i == j else joint.sum(tuple(k for k in range(4) if k not in (i, j)))) * 1000 for i in range(4) for j in range(i, 4)}
    tree = chow_liu(fields, counts, 1e-9)
    assert len(tree.edges) == 3
    model = np.ones((3,) * 4)  # the tree's own joint: root marginal times one table per edge
    seen = {0}
    model = model * tree.marginals[0].reshape(3, 1, 1, 1)
    while len(seen) < 4:
        for a, b in tree.edges:
            for u, v in ((a, b), (b, a)):
                if v in seen and u not in seen:
                    shape = [1] * 4
                    shape[u] = shape[v] = 3
                    t = tree.given[u, v]  # rows: v
                    model = model * (t.T if u < v else t).reshape(shape)
                    seen.add(u)
    for known in ({1: 2}, {0: 1, 3: 0}, {}):
        for target in range(4):
            if target in known:
                continue
            state = np.array([[known.get(k, -1) for k in range(4)]])
            part = model[tuple(known.get(k, slice(None)) for k in range(4))]
            free = [k for k in range(4) if k not in known]
            want = part.sum(tuple(n for n, k in enumerate(free) if k != target))
            assert np.allclose(tree.posterior(target, state)[0], want / want.sum(), atol=1e-6)


def test_fill_edges(spark):
    schema = "i long, g string, x double, g_filled string, state_of_0 int"
    empty = spark.createDataFrame([], schema)
    tree = fit_tree(empty, {"x": 4}, ["g"])
    assert fill_missing(empty, tree, ["g", "x"]).count() == 0
    unknown = spark.createDataFrame([(1, None, None, "s", 3), (1, None, None, "s", 3)], schema)
    out = fill_missing(unknown, tree, ["g", "x"])
    assert out.columns == ["i", "g", "x", "g_filled", "state_of_0", "_g_filled", "x_filled"]
    assert rows(out, "i") == [(1, None, None, "s", 3, False, False)] * 2
    tied = spark.createDataFrame([(i, "a" if i % 4 else None, 1.0 if i % 3 else None, None, None) for i in range(40)], schema)
    out = fill_missing(tied, fit_tree(tied, {"x": 8}, ["g"]), ["g", "x"]).collect()
    assert {(r["g"], r["x"]) for r in out} == {("a", 1.0)}
    many = spark.createDataFrame([(i, str(i % 300) if i % 5 else None, None, None, None) for i in range(600)], schema)
    out = fill_missing(many, fit_tree(many, {"x": 8}, ["g"], max_states=16), ["g"]).collect()
    assert all(r["g"] is not None and "other" not in r["g"] for r in out)


def test_rare_values_are_told_apart(spark):
    """More values than states: each cell still comes back as the value that goes with its neighbour field, also a rare one."""
    rng = random.Random(6)
    data = []
    for i in range(4000):
        k = rng.randrange(5) if rng.random() < 0.5 else rng.randrange(5, 300)
        data.append((i, None if rng.random() < 0.2 else f"g{k}", f"n{k}", f"g{k}", "clash"))
    data += [(9001, None, "never seen", None, "clash"), (9002, None, None, None, "clash")]
    df = spark.createDataFrame(data, "i long, g string, near string, truth string, key string")
    tree = fit_tree(df, {}, ["g", "near"], max_states=16)
    assert tree.fields[0].shared and tree.fields[0].size == 16
    out = fill_missing(df, tree, ["g"])
    assert out.columns == ["i", "g", "near", "truth", "key", "g_filled"]
    got = out.collect()
    assert len(got) == len(data) and all(r["g"] is not None and "other" not in r["g"] for r in got)
    seen = {r[1] for r in data} - {None}
    hidden = [r for r in got if r["g_filled"] and r["truth"] in seen]
    rare = [r for r in hidden if int(r["truth"][1:]) >= 20]
    assert len(rare) > 200 and sum(r["g"] == r["truth"] for r in rare) == len(rare)
    assert sum(r["g"] == r["truth"] for r in hidden) > 0.99 * len(hidden)


def test_known_at_reads_each_input_once(spark, tiny):
    """A hot entity and idle ones: no rows are made for months without events, and both uses of the stream share one shuffle."""
    changes = [(1, at(d), d, d, "a", "", "") for d in range(0, 900, 30)] + [(p, at(0), 1, 1, "idle", "", "") for p in range(2, 40)]
    events = [(str(i), 1, at(i % 900), "", "") for i in range(2000)] + [("far", 7, at(9000), "", "")]
    out = as_of(spark, events, changes)
    got = {r["id"]: (r["m"], r["a"]) for r in out.collect()}
    assert got.pop("far") == (1, "idle") and len(got) == 2000 and all(got[str(i)] == (i % 900 // 30 * 30, "a") for i in range(2000))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Generate" not in plan


def test_day_of_one_entity_is_added_up_in_parts(spark):
    data = [(1, at(0, i % 24), str(i // 2), ["p"], 1, "", 0) for i in range(400)]
    f = as_of_features(store(spark, data), "2020-01-01", ["x"]).first()
    distinct = {(h, i) for _, h, i, *_ in data}
    newest = max(h for h, _ in distinct)
    assert (f["n"], f["x"], f["newest"], f["newest_id"]) == (len(distinct), len(distinct), newest, min(i for h, i in distinct if h == newest))


def test_wide_table_has_given_types_first(spark):
    f = as_of_features(store(spark, [(1, at(0), "b", ["9.99"], 5, "", 0)]), "2020-01-11", ["x"])
    wide = wide_features(f, ["n", "newest"], ["n"], ["5.02(b)", "1.01"])
    assert wide.columns == ["entity", "t_5_02_b_n", "t_5_02_b_newest", "t_1_01_n", "t_1_01_newest", "t_9_99_n", "t_9_99_newest"]
    assert rows(wide, "entity") == [(1, 0, None, 0, None, 1, at(0))]
    assert rows(wide_features(f.limit(0), ["n"], ["n"], ["1.01"]), "entity") == []


def test_held_out_accuracy(spark, tiny):
    """Known cells of the panel, hidden, come back close to the truth."""
    from paneloom.plans.problems import TREE_CATEGORICAL, TREE_NUMERIC, panel_with_context
    from paneloom.sources import table

    folder = tiny.replace("0.001", "0.01")
    panel = table(spark, folder, "chars_final_with_names").where("abs(beta_60m) <= 10 and gics rlike '^[1-9][0-9]{7}$'")
    hide = F.pmod(F.xxhash64("permno", "eom"), F.lit(5)) == 0
    hidden = panel.withColumn("true_beta", F.col("beta_60m")).withColumn("true_gics", F.trim("gics")).withColumn("beta_60m", F.when(~hide, F.col("beta_60m"))).withColumn("gics", F.when(~hide, F.col("gics")))
    ctx = panel_with_context(hidden, table(spark, folder, "gics_codes")).cache()
    out = fill_missing(ctx, fit_tree(ctx, TREE_NUMERIC, TREE_CATEGORICAL), ["beta_60m", "gics"]).where("beta_60m_filled").select("beta_60m", "true_beta", "gics", "true_gics").toPandas()
    assert (out["gics"] == out["true_gics"]).mean() > 0.9
    assert (out["beta_60m"] - out["true_beta"]).abs().mean() < 0.5 * (out["true_beta"] - out["true_beta"].median()).abs().mean()
