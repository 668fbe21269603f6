"""Queries over their whole input: rows, fit sets and months that a cut would lose."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from paneloom.operators import geometry
from paneloom.plans import base, estimates, events


def test_sorted_metadata_has_every_filing(spark, tiny):
    out = [(r.filing_date, r.document_id) for r in events.sorted_metadata(spark, tiny).collect()]
    assert len(out) == base.filings(spark, tiny).count() > 1000
    assert out == sorted(out)


def test_clusters_are_fitted_on_all_vectors_up_to_the_cutoff_only(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 20))
    days = np.datetime64("2015-01-31") + np.arange(1600)
    late = days > np.datetime64(estimates.FIT_END)
    early_odd = ~late & (np.arange(1600) % 2 == 1)
    assert 100 < late.sum() < 200

    def clusters(name, change):
        y = np.where(change[:, None], x[:, ::-1] * 5 + 3, x)
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"vec_id": np.arange(1600), "embedding": pa.array(y.tolist(), pa.list_(pa.float32()))}), tmp_path / name / "embeddings.parquet")
        rows = estimates.embedding_clusters(spark, str(tmp_path / name)).collect()
        return {(r.cluster, str(r.eom)): (r.n, round(r.distance, 9)) for r in rows if str(r.eom) <= estimates.FIT_END}

    plain = clusters("plain", np.zeros(1600, bool))
    assert sum(n for n, _ in plain.values()) == (~late).sum()
    assert clusters("late", late) == plain
    some = early_odd & (days < np.datetime64("2015-06-01"))
    changed = clusters("odd", some)
    assert {k: v for k, v in changed.items() if k[1] > "2015-07-01"} != {k: v for k, v in plain.items() if k[1] > "2015-07-01"}


def test_cascade_takes_the_latest_label_of_any_month(spark, tiny, tmp_path):
    """Every third security never has a ticker, so that filings and nothing at all are sources too."""
    rows = pq.read_table(f"{tiny}/chars_final_with_names.parquet")
    bare = pc.equal(pc.subtract(rows["permno"], pc.multiply(pc.divide(rows["permno"], 3), 3)), 0)
    rows = rows.set_column(rows.column_names.index("ticker"), "ticker", pc.if_else(bare, pa.scalar(None, pa.string()), rows["ticker"]))
    pq.write_table(rows, tmp_path / "chars_final_with_names.parquet")
    os.symlink(f"{tiny}/filings_8k.parquet", tmp_path / "filings_8k.parquet")
    folder = str(tmp_path)
    day = lambda x: str(x)[:10]
    own, fil = {}, {}
    for r in base.panel(spark, folder, "ticker").where("trim(ticker) <> ''").collect():
        own.setdefault(r.permno, []).append((day(r.eom), r.ticker))
    for r in base.filings(spark, folder, "ticker").where("trim(ticker) <> ''").collect():
        fil.setdefault(r.permno, []).append((day(r.filing_date), r.document_id, r.ticker))
    want = set()
    for r in base.book(spark, folder).select("permno", "eom").distinct().collect():
        tagged = [(tag, max(c)[-1]) for tag, source in (("raw_panel", own), ("filing", fil)) if (c := [x for x in source.get(r.permno, []) if x[0] <= day(r.eom)])]
        tag, label = tagged[0] if tagged else ("UNLABELED", None)
        want.add((r.permno, day(r.eom), label, tag))
    got = events.asof_cascade(spark, folder).collect()
    assert {(r.permno, r.eom, r.label, r.label_source) for r in got} == want
    assert len(got) == len(want) and {w[3] for w in want} == {"raw_panel", "filing", "UNLABELED"}


def test_calibration_runs_the_whole_grid_over_24_months(spark, tiny, monkeypatch):
    seen = {}

    def backtest(candidates, settings):
        seen["months"] = sorted(str(r.month) for r in candidates.select("month").distinct().collect())
        seen["settings"] = settings
        return spark.createDataFrame([(0, None, 1, 0.5, "")], estimates.book.BOOK)

    monkeypatch.setattr(estimates.book, "backtest", backtest)
    estimates.calibration_grid(spark, tiny)
    assert len(seen["months"]) == 24 and seen["months"][0] == "2019-01-31" and seen["months"][-1] == "2020-12-31"
    assert len({(s.l2, s.turnover) for s in seen["settings"]}) == 16 and {s.candidates for s in seen["settings"]} == {350}


def test_spread_of_a_cluster_of_one(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 3.0), (2, 4.0)], "cluster int, distance double")
    out = {r.cluster: (r.spread, r.members) for r in geometry.cluster_spread(rows, "cluster", "distance").collect()}
    assert out == {0: (2.0, 1), 1: (2.0, 2), 2: (4.0, 1)}
    assert [r.spread for r in geometry.cluster_spread(rows.where("cluster = 0"), "cluster", "distance").collect()] == [1e-6]
