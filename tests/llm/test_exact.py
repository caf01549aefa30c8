import hashlib

from hypothesis import given
from hypothesis import strategies as st

from fieldhub.llm import exact
from fieldhub.llm.common import WHITE
from fieldhub.llm.radix_trie import RadixTrie


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=60))
def test_trie_holds_the_smallest_owner_and_the_count(rows):
    trie, wanted = RadixTrie(), {}
    for key, owner in rows:
        trie.insert(key, (owner,))
        best, n = wanted.get(key, ((owner,), 0))
        wanted[key] = (min(best, (owner,)), n + 1)
    assert {k: (o, n) for k, o, n in trie.terminals()} == wanted


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").encode().translate(None, WHITE), []).append((-len(text or ""), i is None, i or 0))
    out = []
    for i, text in rows:
        key = (text or "").encode().translate(None, WHITE)
        best = min(groups[key])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_owners_of_odd_rows(odd_docs):
    found = sorted((tuple(r) for r in exact.exact_owners(odd_docs).collect()), key=repr)
    assert found == brute(rows_of(odd_docs))


def test_owners_of_the_table(docs):
    found = sorted((tuple(r) for r in exact.exact_owners(docs).collect()), key=repr)
    assert found == brute(rows_of(docs))


def test_a_hot_text_leaves_each_task_as_one_row(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) AS text").repartition(4)
    points = docs.selectExpr("doc_id AS _id", "text AS _text", "CAST(length(text) AS BIGINT) AS _points")
    folded = points.mapInArrow(exact._fold, exact._FOLDED)
    assert folded.filter("CAST(_key AS STRING) = 'sametext'").count() <= 4
    kept = exact.drop_exact(docs)
    assert kept.count() == 4_000 - 1334 + 1 and kept.columns == docs.columns


def test_hash_collisions_branch_in_the_trie(spark, monkeypatch):
    monkeypatch.setattr(exact, "_hash", lambda key: 0)
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "a b"), (4, "ad")], "doc_id long, text string")
    found = {r["_id"]: r["_owner"] for r in exact.exact_owners(docs).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 4}


def test_drop_keeps_columns_and_empty_tables(odd_docs, no_docs):
    assert exact.drop_exact(odd_docs).columns == odd_docs.columns
    assert exact.drop_exact(no_docs).count() == 0 and exact.exact_owners(no_docs).count() == 0


def brute_kept(rows):
    best = {}
    for row in rows:
        text = row[1] or ""
        rank = (-len(text), row[0] is None, row[0] or 0)
        key = text.translate(str.maketrans("", "", " \t\n\x0b\f\r"))
        if key not in best or rank < best[key][0]:
            best[key] = rank, row[:2]
    return sorted((row for _, row in best.values()), key=repr)


def test_drop_decides_by_row(spark, odd_docs, docs):
    kind = "doc_id long, text string, _row string, _text int"
    given = [(1, "ab"), (None, "a b"), (None, "ab"), (None, "zzz"), (2, "ab"), (2, "qq"), (2, "qq"), (None, None), (None, "")]
    frame = spark.createDataFrame([(*row, "r", 1) for row in given], kind).repartition(3)
    out = exact.drop_exact(frame)
    assert out.schema == frame.schema
    assert sorted((tuple(r)[:2] for r in out.collect()), key=lambda r: repr((r[1], r[0]))) == sorted(
        [(None, "a b"), (None, "zzz"), (2, "qq"), (None, [r for r in out.collect() if not r["text"]][0]["text"])], key=lambda r: repr((r[1], r[0])))
    for table in (odd_docs, docs):
        kept = sorted(((r["doc_id"], r["text"]) for r in exact.drop_exact(table).collect()), key=repr)
        want = brute_kept(rows_of(table))
        blank = lambda rows: [(i, t) for i, t in rows if (t or "").strip()]
        assert blank(kept) == blank(want) and len(kept) == len(want)


def test_rows_survive_small_folds(spark, monkeypatch, docs):
    monkeypatch.setattr(exact, "FOLD_BYTES", 1_000)
    assert sorted(r["doc_id"] for r in exact.drop_exact(docs).collect()) == sorted(i for i, _ in brute_kept(rows_of(docs)))
