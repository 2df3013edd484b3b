from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patronage.operators import backtest, scoring
from patronage.operators.clusters import evaluate_clusters, fit_rfm_pipeline, preprocess_rfm
from patronage.operators.personas import persona_mapping
from patronage.plans.segmentation import segment_customers
from patronage.plans.validation import backtest_segments
from tests.conftest import by, one

SEGMENT = "customer_id string, segment string, frequency bigint, monetary double"


@pytest.fixture(scope="module")
def log(transactions):
    rows = [("101", "1", "2023-01-05", 2, 50), ("101", "2", "2023-04-10", 1, 60), ("102", "3", "2023-02-01", 1, 20),
            ("103", "4", "2023-03-01", 5, 10), ("103", "5", "2023-05-01", 2, 30), ("104", "6", "2023-04-20", 1, 70)]
    for i in range(200, 220):
        rows.append((str(i), f"F{i}", "2023-01-10" if i % 2 == 0 else "2023-05-15", i % 5 + 1, 10 + i % 10))
        rows.append((str(i), f"G{i}", "2023-02-10", i % 3 + 1, 5 + i % 7))
    return transactions(rows)


def test_windows(log):
    before, after = backtest.split_windows(log, "2023-03-15")
    assert before.count() + after.count() == log.count()
    assert after.where("invoice_date <= timestamp_ntz'2023-03-15'").isEmpty()
    for cutoff in ("2020-01-01", "2025-01-01"):
        with pytest.raises(ValueError, match="one side empty"):
            backtest.split_windows(log, cutoff)
    with pytest.raises(ValueError, match="empty"):
        backtest.split_windows(log.limit(0), "2023-03-15")


def test_a_date_cutoff_means_midnight(transactions):
    df = transactions([("1", "1", "2023-01-01T09:00:00", 1, 1), ("1", "2", "2023-01-02T09:00:00", 1, 1), ("1", "3", "2023-01-03", 1, 1)])
    assert backtest.split_windows(df, "2023-01-02")[0].count() == 1


def test_default_cutoff(log, transactions):
    row = one(backtest.default_cutoff(log))
    assert (str(row["cutoff_date"]), row["total_days"], row["long_enough"]) == ("2023-03-11", 130, True)
    short = transactions([("1", "1", "2023-01-01", 1, 1), ("1", "2", "2023-01-07", 1, 1)])
    assert one(backtest.default_cutoff(short))["cutoff_date"] is None


@pytest.fixture(scope="module")
def labels(spark):
    t1 = [("C1", "Champions", 5, 500.0), ("C2", "Champions", 4, 400.0), ("C3", "Loyal", 3, 300.0), ("C4", "At Risk", 1, 50.0)]
    t2 = [("C1", "Champions", 3, 300.0), ("C2", "Loyal", 1, 50.0), ("C3", "At Risk", 1, 20.0), ("C5", "Champions", 2, 90.0)]
    return spark.createDataFrame(t1, SEGMENT), spark.createDataFrame(t2, SEGMENT)


def test_transitions(labels):
    cells = {(r["segment_t1"], r["segment_t2"]): (r["n"], r["prob"]) for r in backtest.transition_matrix(*labels).collect()}
    assert len(cells) == 3 * 4
    assert cells[("Champions", "Champions")] == cells[("Champions", "Loyal")] == (1, 0.5)
    assert cells[("At Risk", backtest.CHURNED)] == (1, 1.0) and cells[("Loyal", "Loyal")] == (0, 0.0)
    assert one(backtest.retention_summary(*labels)) == {
        "total_t1_customers": 4, "retained_count": 3, "churned_count": 1, "new_customers_count": 1,
        "retention_rate": 0.75, "churn_rate": 0.25}
    with pytest.raises(ValueError, match="segment"):
        backtest.transition_matrix(labels[0].drop("segment"), labels[1])


def test_forward_value(spark):
    t1 = spark.createDataFrame([("C1", "Champions", 1, 1.0), ("C2", "Champions", 1, 1.0), ("C3", "Lost", 1, 1.0), ("C4", "Gone", 1, 1.0)], SEGMENT)
    t2 = spark.createDataFrame([("C1", "x", 3, 300.0), ("C3", "x", 1, 50.0)], SEGMENT)
    found = by(backtest.forward_value(t1, t2), "segment")
    c = found["Champions"]
    assert (c["customer_count"], c["forward_active_count"], c["total_forward_spend"], c["forward_retention_pct"]) == (2, 1, 300.0, 50.0)
    assert (c["avg_forward_spend"], c["avg_spend_active_buyers"], c["avg_forward_orders"]) == (150.0, 300.0, 1.5)
    assert found["Gone"]["avg_spend_active_buyers"] == 0.0


def test_migration(labels):
    found = by(backtest.migration_details(*labels), "customer_id")
    assert {k: v["migration_status"] for k, v in found.items()} == {
        "C1": "Retained (Stable)", "C2": "Migrated", "C3": "Migrated", "C4": "Churned"}
    assert (found["C4"]["t2_segment"], found["C4"]["t2_spend"]) == (backtest.CHURNED, 0.0)
    details = backtest.migration_details(*labels)
    assert backtest.filter_migration(details, "Champions").count() == 2
    assert backtest.filter_migration(details, "Champions", "Migrated").count() == 1


def test_a_segment_named_like_churn(spark):
    t1 = spark.createDataFrame([("a", "X"), ("b", "X")], "customer_id string, segment string")
    t2 = spark.createDataFrame([("a", backtest.CHURNED)], "customer_id string, segment string")
    rows = backtest.transition_matrix(t1, t2).collect()
    assert [(r["segment_t1"], r["segment_t2"], r["n"], r["prob"]) for r in rows] == [("X", backtest.CHURNED, 2, 1.0)]


def test_end_to_end(log):
    result = backtest_segments(log, "2023-03-15", k=3)
    retention = one(result.retention)
    assert retention["retained_count"] + retention["churned_count"] == result.t1.count()
    sums = result.transitions.groupBy("segment_t1").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in sums)
    assert result.t2.where("segment is null").isEmpty()


@pytest.fixture(scope="module")
def bundle(rfm_base):
    model, labeled = fit_rfm_pipeline(rfm_base, 3, starts=2)
    return model, persona_mapping(labeled), labeled


def test_scoring(spark, bundle, rfm_base):
    model, mapping, labeled = bundle
    scored = scoring.score_customers(model, mapping, rfm_base)
    assert scored.join(labeled, ["customer_id", "cluster"]).count() == 30
    partial = scoring.score_customers(model, mapping.where("cluster > 0"), rfm_base)
    assert partial.where("segment = 'Unclassified'").count() == scored.where("cluster = 0").count() > 0
    with pytest.raises(ValueError, match="monetary"):
        scoring.score_customers(model, mapping, rfm_base.drop("monetary"))
    negative = spark.createDataFrame([("n", -5.0, -1, -3.0)], rfm_base.schema)
    assert one(scoring.score_customers(model, mapping, negative))["cluster"] is not None


def test_scoring_a_stream(spark, bundle, rfm_base, tmp_path):
    model, mapping, _ = bundle
    rfm_base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rfm_base.schema).parquet(str(tmp_path / "in"))
    query = (scoring.score_customers(model, mapping, stream).writeStream.format("memory").queryName("scores")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    assert spark.table("scores").count() == 30


def test_versions(spark, bundle, rfm_base, tmp_path):
    model, mapping, _ = bundle
    folder = str(tmp_path / "models")
    assert scoring.list_model_versions(spark, folder).count() == 0
    evaluation = evaluate_clusters(preprocess_rfm(rfm_base)[0], [2, 3], starts=2)
    first = scoring.save_model_version(model, mapping, folder, evaluation, customer_count=30, notes="one")
    smaller, labeled = fit_rfm_pipeline(rfm_base, 2, starts=2)
    second = scoring.save_model_version(smaller, persona_mapping(labeled), folder)
    assert first.startswith("v1_k3_") and second.startswith("v2_k2_")
    (tmp_path / "models" / "v3_k9_broken").mkdir()
    corrupt = tmp_path / "models" / "v4_k9_bad"
    (corrupt / "model" / "metadata").mkdir(parents=True)
    (corrupt / "metadata").mkdir()
    (corrupt / "metadata" / "part-0").write_text("{not json")
    versions = scoring.list_model_versions(spark, folder)
    rows = versions.collect()
    assert [r["version_id"] for r in rows] == [second, first]
    assert rows[1]["silhouette_score"] == by(evaluation, "k")[3]["silhouette"]
    assert (rows[1]["customer_count"], rows[1]["notes"], len(rows[1]["cluster_map"])) == (30, "one", 3)
    assert one(scoring.best_version(versions))["best_version"] == first
    delta = one(scoring.compare_versions(versions, first, second))
    assert (delta["k_a"], delta["k_b"], delta["k_delta"]) == (3, 2, -1) and delta["inertia_delta"] > 0
    loaded, names, _ = scoring.load_model_version(spark, folder, first)
    again = scoring.score_customers(loaded, names, rfm_base)
    assert again.exceptAll(scoring.score_customers(model, mapping, rfm_base)).isEmpty()
    assert (loaded.k, loaded.inertia) == (3, pytest.approx(model.inertia, abs=1e-3))
    with pytest.raises(FileNotFoundError):
        scoring.load_model_version(spark, folder, "v3_k9_broken")
    with pytest.raises(TypeError):
        scoring.save_model_version(loaded.pipeline, names, folder)


def test_savers_at_one_time_get_numbers_of_their_own(spark, bundle, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    model, mapping, _ = bundle
    folder = str(tmp_path / "models")
    with ThreadPoolExecutor(max_workers=8) as pool:
        numbers = list(pool.map(lambda _: scoring._claim_number(spark, folder), range(40)))
    assert sorted(numbers) == list(range(1, 41))
    with ThreadPoolExecutor(max_workers=8) as pool:
        names = list(pool.map(lambda _: scoring.save_model_version(model, mapping, folder), range(8)))
    assert {int(name[1:].split("_")[0]) for name in names} == set(range(41, 49))
    assert scoring.list_model_versions(spark, folder).count() == 8


def test_whole_segmentation(spark, sf):
    from catalog.inputs import raw_lines

    result = segment_customers(raw_lines(spark, sf), k_values=[3])
    assert result.labeled.where("segment is null or rfm_score is null").isEmpty()
    assert result.labeled.count() == one(result.report)["total_customers"]
    assert result.mapping.count() == 3 and result.cohorts.count() > 0


def test_segmentation_with_all_defaults(rfm_base, transactions):
    rows = [(r["customer_id"], f"N{r['customer_id']}-{i}", f"2024-0{1 + i % 6}-1{i % 9}", 1, r["monetary"] / r["frequency"])
            for r in rfm_base.collect() for i in range(r["frequency"])]
    result = segment_customers(transactions(rows))
    evaluation = by(result.evaluation, "k")
    assert sorted(evaluation) == list(range(2, 9))
    assert one(result.best)["best_silhouette"] == max(e["silhouette"] for e in evaluation.values())
    assert result.labeled.count() == 30 and result.mapping.count() == one(result.best)["best_k"]
