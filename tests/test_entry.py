from __future__ import annotations

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 80


def test_sample_of_queries_against_sql(spark, sf):
    from catalog.check import compare, connect

    db, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    for name in ("C13_report_net", "F4_quintiles", "H4_retention", "V8_customer_clv", "R2_ledger"):
        good, note = compare(spark, db, sf, name, queries[name], oracles[name])
        assert good, f"{name}: {note}"


def test_fitted_queries_against_sql(spark, sf, monkeypatch):
    from catalog.check import compare, connect
    from patronage.operators import clusters

    fits = []
    fit = clusters.fit_many
    record = lambda points, columns, ks, starts, seed: fits.append((list(ks), starts)) or fit(points, columns, ks, starts, seed)
    monkeypatch.setattr(clusters, "fit_many", record)
    db, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    all_ks = list(range(2, 9))
    for name, ks in (
        ("K2a_evaluate_k", all_ks), ("K2e_best_k_fitted", all_ks), ("D12_separation_fitted", all_ks),
        ("K9_fit_rfm_pipeline", [4]), ("B8_fitted_backtest", [4]),
    ):
        good, note = compare(spark, db, sf, name, queries[name], oracles[name])
        assert good, f"{name}: {note}"
        assert fits == [(ks, 10)], name
        fits.clear()


def test_stored_tables_can_be_released(spark):
    from patronage.session import materialize, release_tables

    release_tables(spark)
    stored = materialize(spark.range(5))
    (file,) = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    assert release_tables(spark) == 1 and release_tables(spark) == 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
