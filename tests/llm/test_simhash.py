import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldhub.llm import simhash
from fieldhub.llm.bktree import BKTree, spanning_links


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_tree_finds_what_a_scan_finds():
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = list({b ^ (1 << rnd.randrange(64)) ^ (rnd.random() < 0.5) << rnd.randrange(64) for b in base * 8})
    tree = BKTree(values[0])
    for v in values[1:]:
        tree.insert(v)
    for q in values:
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    joined = spanning_links(values, 2)
    assert len(joined) < len(values)
    links = {frozenset(x) for x in joined}
    assert components(values, lambda a, b: frozenset((a, b)) in links) == components(
        values, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("shard", [32, 512])
def test_links_join_what_all_pairs_join(spark, shard):
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(60)}
    dense = rnd.getrandbits(64)
    values |= {dense ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(120)}
    values |= {v ^ 3 for v in list(values)[:30]}
    signed = [simhash._signed(v) for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "_print long"), shard=shard).collect()
    near = {frozenset((r["a"], r["b"])) for r in found}
    mask = simhash.ALL_BITS
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 2 for r in found)
    assert components(signed, lambda a, b: frozenset((a, b)) in near) == components(
        signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 2)


def check(df, width=3):
    rows = df.select("doc_id", "text").collect()
    prints = [brute_print(r["text"], width) for r in rows]
    group = components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r["doc_id"] is not None:
            least[group[p]] = min(least.get(group[p], r["doc_id"]), r["doc_id"])
    wanted = sorted(((r["doc_id"], simhash._signed(p), least.get(group[p])) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_groups(df, width=width).collect()), key=repr) == wanted


def test_groups_of_the_table(docs):
    check(docs)


def test_groups_of_odd_rows(odd_docs):
    check(odd_docs)


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(1_000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "STEP", 64)
    assert simhash.fingerprint(text, 3) == whole == simhash._signed(brute_print(text.decode(), 3))


def test_drop_keeps_one_of_each_group(docs, no_docs):
    groups = simhash.near_groups(docs, width=5).select("_group").distinct().count()
    kept = simhash.drop_near(docs)
    assert kept.count() == groups and kept.columns == docs.columns
    assert simhash.drop_near(no_docs).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_groups(rows):
    """Least id of each row's group by Jaccard >= 0.8 of 5-word shingles."""
    sets = dict(enumerate(shingle_set(t) for _, t in rows))
    group = components(list(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return [least.get(group[k]) for k in range(len(rows))]


def test_similar_texts_are_dropped(spark):
    """Planted edits at J 0.8 to 0.99, a chain, near pairs under 0.8, and a group of near copies."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5_000)}"
    rows, planted = [], 0
    for length, edits in [(100, 1), (100, 2), (100, 3), (300, 1), (300, 6), (1_000, 1), (1_000, 20), (60, 1), (100, 5), (12, 1)] * 12:
        base = [word() for _ in range(length)]
        copy = list(base)
        for at in rnd.sample(range(4, length - 4), edits):
            copy[at] = "other" + word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy).upper())]
        planted += jaccard(*(shingle_set(t) for _, t in rows[-2:])) >= 0.8
    hub = [word() for _ in range(200)]
    for _ in range(60):
        rows.append((len(rows), " ".join([*hub[: (at := rnd.randrange(200))], "x" + word(), *hub[at + 1 :]])))
    rows += [(None, rows[0][1]), (7_000, rows[0][1]), (7_000, rows[0][1]), (8_000, None), (8_001, " ")]
    wanted = brute_groups(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(map(repr, ((r["_id"], r["_group"]) for r in simhash.similar_groups(table).collect())))
    assert planted > 70
    assert found == sorted(repr((i, g)) for (i, _), g in zip(rows, wanted, strict=True))
    kept = sorted(r["doc_id"] for r in simhash.drop_near(table).collect())
    assert kept == sorted({g for g in wanted if g is not None})


def test_lists_keep_similar_pairs_and_few_others(spark):
    """Texts that share one or two of four passages meet in lists and are no candidates; near copies are."""
    rnd = np.random.default_rng(4)
    draw = lambda n: rnd.integers(0, 1 << 63, n, np.uint64)
    passages, near = [draw(30) for _ in range(12)], set()
    chosen = random.Random(4).sample(list(combinations(range(12), 4)), 30)
    sets = [np.unique(np.concatenate([passages[i] for i in four])) for four in chosen]
    for k in range(30, 60, 2):
        size = 4 if k < 40 else 90
        one = draw(size)
        sets += [np.unique(one), np.unique(np.concatenate([one[: size - size // 10], draw(size // 10 or 1)]))]
        near.add((k, k + 1))
    rows = [(k, k, simhash._majority([s]), len(s), simhash._wide_print(s), s.view(np.int64).tolist()) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "_node long, _head long, _print long, _size int, _wide array<long>, _set array<long>")
    lists = simhash._lists(members, 0.8).withColumn("_far", F.lit(0.0))
    found = {(r["a"], r["b"]) for r in simhash._listed_pairs(lists, members, 0.8).collect()}
    met = lists.alias("x").join(lists.alias("y"), "_token").filter("x._node < y._node and y._node < 30").count()
    close = {(a, b) for a, b in combinations(range(30), 2) if len({*chosen[a]} & {*chosen[b]}) == 3}
    assert near <= found <= near | close and met > 400


def test_similar_pairs_without_a_shared_key_link(spark):
    """Pairs of Jaccard 0.8 whose minimum hashes agree on no key of the first pass."""
    factors = np.random.default_rng(5).integers(0, simhash.ALL_BITS, simhash.BANDS * simhash.ROWS, np.uint64, endpoint=True) | np.uint64(1)
    rows = []
    for seed in (26, 196, 6498, 7178, 11455):
        rnd = random.Random(seed)
        words = [f"w{rnd.randrange(10**6)}" for _ in range(24)]
        pair = [words[:22], [*words[22:], *words[2:22]]]
        keys = [simhash._band_keys(simhash._shingle_set([w.encode() for w in one], 5), factors) for one in pair]
        assert not any(a == b for a, b in zip(*keys, strict=True))
        assert jaccard(*(shingle_set(" ".join(one)) for one in pair)) == 0.8
        rows += [(len(rows) + k, " ".join(one)) for k, one in enumerate(pair)]
    rows += [(100 + k, text) for k, (_, text) in enumerate(rows[:4])]
    found = {r["_id"]: r["_group"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i // 2 * 2 for i in range(10)} | {100 + k: k // 2 * 2 for k in range(4)}
