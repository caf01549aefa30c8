import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhub.llm import common, quality, toxicity
from fieldhub.llm import labels as labelled
from fieldhub.llm.queries import QUERIES


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.1"


def outcome(spark, sf_dir, name, label):
    found = QUERIES[name](spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return found, found.join(known, "doc_id").filter("held_out").select("score", "predicted", label).toPandas()


def test_quality_on_held_out_rows(spark, big):
    found, held = outcome(spark, big, "op1_quality", "quality")
    assert found.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    assert (held.predicted == held.quality).mean() > 0.98
    assert held.score.between(0, 1).all() and ((held.score >= 0.5) == (held.predicted == 1)).all()


def test_toxicity_on_held_out_rows(spark, big):
    _, held = outcome(spark, big, "op5_toxicity", "toxic")
    caught, flagged = held.predicted[held.toxic == 1].mean(), held.predicted[held.toxic == 0].mean()
    assert caught > 0.75 and flagged < 0.02
    assert ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_odd_rows_get_scores(odd_docs, no_docs, docs, labels):
    ranking, net = quality.train(docs, labels), toxicity.train(docs, labels)
    for scored in (quality.score(odd_docs, ranking), toxicity.score(odd_docs, net)):
        rows = scored.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert quality.score(no_docs, ranking).count() == toxicity.score(no_docs, net).count() == 0
    kept = quality.keep_good(odd_docs, ranking)
    scores = quality.score(odd_docs, ranking)
    assert kept.columns == odd_docs.columns and kept.count() == scores.filter("_score >= 0.5").count()


def test_without_labels(odd_docs, labels, spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7)], "doc_id long, quality int, toxic int")
    assert {r["_score"] for r in quality.score(odd_docs, quality.train(odd_docs, none)).collect()} == {0.5}
    assert all(r["_score"] < 0.01 for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect())


def test_bradley_terry_prefers_good_rows():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 3] - 2 * x[:, 5] > 1).astype(int)
    ranking = quality.fit(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    assert ((ranking.strengths(x) >= 0).astype(int) == y).mean() > 0.95


def test_network_pools_long_texts_in_steps(monkeypatch):
    net = toxicity.Network.fresh()
    codes = np.random.default_rng(1).integers(0, 2**32, 5_000, dtype=np.uint32)
    whole = net.many([codes])
    monkeypatch.setattr(toxicity, "_STEP", 256)
    assert net.many([codes]) == pytest.approx(whole, abs=1e-5)
    assert len(net.many([codes[:0], codes[:1], codes[:2]])) == 3


def test_toxicity_learns_from_every_labelled_row(spark, big, monkeypatch):
    """In lessons whose networks are averaged; the rows of all of them are counted."""
    monkeypatch.setattr(toxicity, "LESSON", 1_000)
    learnt = []
    plain = toxicity._seed
    monkeypatch.setattr(toxicity, "_seed", lambda net, seen, rows: learnt.append(int(rows.sum())) or plain(net, seen, rows))
    _, held = outcome(spark, big, "op5_toxicity", "toxic")
    known = spark.read.parquet(f"{big}/labels.parquet").filter("toxic IN (0, 1) AND crc32(cast(doc_id AS string)) % 3 <> 1").count()
    assert 0.75 * known < learnt[0] < 0.85 * known
    assert held.predicted[held.toxic == 1].mean() > 0.75 and held.predicted[held.toxic == 0].mean() < 0.02


def test_unlabelled_texts_stay_where_they_are(spark):
    """Only rows of labelled ids (and the few that share a hash) reach the join with the labels."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(None, "a", "en"), (-8, "b", None)], "doc_id long, text string, lang string"))
    labels = spark.range(-8, 200_000, 8).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 16 == 0).cast("int").alias("toxic"))
    known = labelled.known_labels(labels, "toxic")
    found = {r[0] for r in labelled.maybe_known(docs, known).select("doc_id").collect()}
    wanted = {r[0] for r in known.select("_of").collect()}
    assert -8 in wanted and wanted <= found and len(found) < len(wanted) + 200


def test_training_joins_labels_alike_at_any_size(spark, docs, labels, monkeypatch):
    """The plan of the labelled rows has no broadcast of labels, which would turn into a shuffle of whole texts."""
    plans = []
    monkeypatch.setattr(toxicity, "cut", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or common.cut(df, name))
    toxicity.train(docs, labels)
    plan = plans[0].split("== Physical Plan ==")[1]
    assert 0 < plan.find("SortMergeJoin") < plan.find("MapInArrow")  # what moves is what the step below made of the texts
