import pytest

from fieldhub.llm import mixing


def brute_targets(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(names)}
    left, targets, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 2 * sizes[n]}
        if not full:
            return targets | {n: weight[n] * level for n in open_}
        for n in full:
            targets[n] = 2.0 * sizes[n]
            left -= targets[n]
        open_ -= full
    return targets


def size(text):
    return len((text or "").encode().split())


def check(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    targets = brute_targets(sizes)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert 0 <= r["_copies"] <= 2
        by.setdefault((r["_source_size"], round(r["_target"], 6)), []).append(r)
    assert {k for k in by} == {(sizes[n], round(targets[n], 6)) for n in sizes}
    assert sorted((r["_id"], r["_copies"]) for r in found if r["_id"] is not None) == sorted(
        (r["_id"], r["_copies"]) for r in mixing.mix(df.repartition(3)).collect() if r["_id"] is not None)


def test_mix_of_the_table(docs):
    check(docs)


def test_mix_of_odd_rows(odd_docs):
    check(odd_docs)


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + pmod(hash(id), 400) * pmod(hash(id, 1), 7) AS INT)) AS text",
        "if(id % 3 = 0, 'hot', concat('s', id % 17)) AS source")
    taken = mixing.mix(docs).groupBy("_source_size", "_target").agg({"*": "count"}).count()
    sums = mixing.mix(docs).selectExpr("_source_size", "_target", "_copies * _size AS t").groupBy("_source_size", "_target").sum("t").collect()
    assert taken == 18
    for r in sums:
        assert r["sum(t)"] == pytest.approx(r["_target"], rel=0.02)


def test_mixed_repeats_rows(odd_docs, no_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    copies = {r["_id"]: r["_copies"] for r in mixing.mix(odd_docs).collect()}
    assert out.filter("doc_id = 7").count() == copies[7]
    assert mixing.mixed(no_docs).count() == 0


def test_rows_of_one_id_have_counts_of_their_own(spark):
    text = "one two three four five six"
    frame = spark.createDataFrame([(i, text, "a", "x") for i in (1, 1, 1, None, None, 2)], "doc_id long, text string, source string, _row string")
    counts = sorted(r["_copies"] for r in mixing.mix(frame).collect())
    out = mixing.mixed(frame)
    assert out.schema == frame.schema
    assert out.count() == sum(counts)
    assert abs(6 * sum(counts) - 54) <= 6
    assert mixing.mixed(frame.limit(0)).count() == 0
