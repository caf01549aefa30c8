"""The corpus pipeline against plain Python of every stage."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from fieldhub.llm import quality
from test_exact import brute_kept
from test_mixing import brute_targets
from test_simhash import jaccard, shingle_set


def bits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def brute_near(rows):
    """Of each group of texts joined by a Jaccard similarity of 0.8, the smallest id."""
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingle_set(text) for i, text, *_ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and find(i) != find(j) and jaccard(a, b) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in root}


def brute_copies(rows):
    """How often the mix takes each id, by the definition of the draws."""
    size = {i: len((text or "").encode().split()) for i, text, _ in rows}
    of = {i: source for i, _, source in rows}
    sums, many = Counter(), Counter()
    for i, source in of.items():
        sums[source] += size[i]
        many[source] += 1
    targets = brute_targets(sums)
    cells = {}
    for i, source in of.items():
        cells.setdefault((source, bits(f"mix/{i}") % math.ceil(many[source] / 2_000)), []).append(i)
    copies = {}
    for (source, cell), ids in cells.items():
        rate = targets[source] / sums[source] if sums[source] else 0.0
        whole, part = math.floor(rate), rate - math.floor(rate)
        u = bits(f"mix#{cell}{'-' if source is None else '=' + source}") / 4294967296
        for k, i in enumerate(sorted(ids, key=lambda i: (size[i], bits(f"mix:{i}"), i)), 1):
            copies[i] = whole + math.floor(k * part + u) - math.floor((k - 1) * part + u)
    return copies


@pytest.fixture(scope="module")
def stages(spark, docs, sf):
    """The rows (id, text, source) that each stage returns."""
    kept, out = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, sf), "test")
        assert kept.dtypes == docs.dtypes
        out[name] = [tuple(r) for r in kept.select("doc_id", "text", "source").collect()]
    return out


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]


def test_quality_keeps_what_scores_well(docs, labels, stages):
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    good = sorted(r["_id"] for r in scored if r["_score"] >= 0.5)
    assert sorted(i for i, *_ in stages["quality classifier"]) == good
    assert 0 < len(good) < len(scored)


def test_exact_keeps_one_row_of_each_text(stages):
    want = brute_kept([r[:2] for r in stages["quality classifier"]])
    assert sorted((r[:2] for r in stages["exact dedup"]), key=repr) == want


def test_near_keeps_one_row_of_each_group(stages):
    assert sorted(i for i, *_ in stages["SimHash near-dedup"]) == sorted(brute_near(stages["exact dedup"]))
    assert set(stages["SimHash near-dedup"]) <= set(stages["exact dedup"])


def test_mixing_copies_rows_by_their_draws(stages):
    want = brute_copies(stages["SimHash near-dedup"])
    found = Counter(i for i, *_ in stages["mixing sources to target weights"])
    assert found == Counter({i: n for i, n in want.items() if n})
    assert set(stages["mixing sources to target weights"]) <= set(stages["SimHash near-dedup"])


def test_run_packs_every_copy(spark, sf, stages):
    pieces = corpus_pipeline.run(spark, sf).collect()
    want = Counter(i for i, *_ in stages["mixing sources to target weights"])
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == want
    lengths, places = Counter(), {}
    for r in pieces:
        lengths[r["sequence_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert max(lengths.values()) <= 2048
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length


def test_stages_take_odd_rows(spark, odd_docs, no_docs, sf):
    given = [r["doc_id"] for r in odd_docs.collect()]
    for df in (odd_docs, no_docs):
        kept, rows = df, []
        for _, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.cut(stage(spark, kept, sf), "odd")
            rows.append(kept.collect())
        assert all(r["doc_id"] in given for part in rows for r in part)
        if df is no_docs:
            assert not any(rows)
        else:
            texts = [(r["text"] or "").translate(str.maketrans("", "", " \t\n\x0b\f\r")) for r in rows[1]]
            assert len(texts) == len(set(texts)) > 0
            assert 0 < len(rows[2]) <= len(rows[1]) <= len(rows[0]) <= len(given)
