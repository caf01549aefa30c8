import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldhub.llm import lm, mixer


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(df):
    rows = df.select("doc_id", "text").collect()
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(
        ((r["doc_id"], held(r["doc_id"]), len(t), sum(w in counts for w in t),
          round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r in rows for t in [tokens(r["text"])]),
        key=repr)
    found = lm.score_texts(df).collect()
    assert sorted(((r["_id"], r["_held"], r["_tokens"], r["_known"], round(r["_base"], 6)) for r in found), key=repr) == wanted
    assert all(r["_train"] == n and r["_score"] < 0 for r in found)
    return found


def test_counts_and_base_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 100_000)
    found = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    heldout = [r for r in found if r["_held"]]
    assert sum(r["_score"] for r in heldout) > sum(r["_base"] for r in heldout)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert lm.score_texts(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(40) if held(i)]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    rows = lm.score_texts(docs).collect()
    assert len(rows) == len(ids) and all(r["_train"] == 0 and r["_score"] < 0 and r["_known"] == 0 for r in rows)


@pytest.fixture(scope="module")
def trained():
    draw = np.random.default_rng(4)
    parts = [b"an", b"the", b"ing", b"or", b"st", b"qu"]
    words = list({b"".join(parts[i] for i in draw.integers(6, size=draw.integers(1, 6))) for _ in range(3_000)})
    code = mixer.huffman(mixer.byte_counts(words[::2]))
    table = np.zeros((1 << mixer.SLOTS, 2), np.float32)
    mixer.count(words[::2], code, table)
    weights, refine = mixer.start_weights(), np.zeros((mixer.GATES * mixer.BINS, 2))
    for _ in range(3):
        mixer.learn(words[::2], code, table, weights, refine)
    return words, mixer.Mixer.of(code, table, weights, refine)


def test_mixer_predicts_new_words_better_than_its_code(trained):
    words, model = trained
    new = words[1::2]
    bits = -model.log2(new).sum()
    assert bits < 0.75 * sum(model.code.length[list(w + b" ")].sum() for w in new)


def test_mixer_is_a_distribution(trained):
    """Words of one byte, closed, share what their byte's bits leave: all sums stay under 1."""
    _, model = trained
    closed = np.exp2(model.log2([bytes([b]) for b in range(256) if b not in b" \n"])).sum()
    assert 0 < closed + 2.0 ** model.log2([b"\n"])[0] < 1
    assert sum(2.0 ** -int(n) for n in model.code.length) == pytest.approx(1)


def test_levels_are_discounted_distributions():
    counts = np.array([5, 3, 1, 1, 2, 0, 0])
    level = lm.Counts(12, 5, 0.6)
    below = np.log2(np.array([0.1, 0.2, 0.1, 0.1, 0.1, 0.3, 0.1]))
    assert np.exp2(level.log2(counts, below)).sum() == pytest.approx(1)


def test_long_words_span_steps(trained, monkeypatch):
    _, model = trained
    words = [b"theanor" * 300, b"st", b"\n"]
    whole = model.log2(words)
    monkeypatch.setattr(mixer, "STEP", 100)
    assert model.log2(words) == pytest.approx(whole)


def test_scores_do_not_depend_on_partitions(spark, docs):
    found = [
        {r["_id"]: r["_score"] for r in lm.score_texts(docs.repartition(n)).collect()} for n in (1, 7)
    ]
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][k] - found[1][k]) < 1e-3 for k in found[0])


def test_word_numbers_of_any_size():
    for words in ([0, 5, 255], [0, 70_000], [3, (1 << 24) + 7, 1 << 31], []):
        numbers, ends, segments = lm._unpacked(lm._packed(np.array(words, np.int64), np.array([len(words)]), [4]))
        assert (numbers.tolist(), ends.tolist(), segments.tolist()) == (words, [len(words)], [4])


def test_the_word_before_is_a_context(spark):
    """Known words with the same counts: their order decides, as training texts have it."""
    draw = np.random.default_rng(3)
    ids = [i for i in range(400) if not held(i)]
    rows = [(i, " ".join(("xa yonder", "ub volume")[k] for k in draw.integers(2, size=12))) for i in ids]
    like, unlike = [i for i in range(1_000, 1_100) if held(i)][:2]
    rows += [(like, "xa yonder ub volume ub volume xa yonder"), (unlike, "xa volume ub yonder ub yonder xa volume")]
    found = {r["_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[like]["_known"] == found[unlike]["_known"] == 9
    assert found[like]["_score"] > found[unlike]["_score"] + 3


def test_scores_are_products_of_mixed_bits(spark, docs, monkeypatch):
    """Of every word, known or new: spelled one use after another, without numbers, chunks and joins."""
    kept = []
    for name in ("train_mixer", "_totals"):
        monkeypatch.setattr(lm, name, lambda df, plain=getattr(lm, name): kept.append(plain(df)) or kept[-1])
    few = docs.limit(40)
    found = {r["_id"]: r for r in lm.score_texts(few).collect()}
    totals, model = sorted(kept, key=lambda k: isinstance(k, mixer.Mixer))
    level = totals[lm.SEGMENT]

    def pieces(text):
        out, piece = [], []
        for word in tokens(text):
            piece.append(word)
            if word == b"\n" or (word[-1] in b".!?" and zlib.crc32(word) % 4 == 0):
                out.append(piece)
                piece = []
        return out

    rows = few.collect()
    uses = Counter(b" ".join(p) for r in rows if not held(r["doc_id"]) for p in pieces(r["text"]))

    def adapted(p, past, key, half):
        at = sum(past.values())
        share = 0.5 * at / (at + half)
        p = math.log2((1 - share) * 2**p + share * past[key] / max(at, 1)) if share and past[key] else p + math.log2(1 - share)
        past[key] += 1
        return p

    for r in rows[:12]:
        before, words, segments, total = 0, Counter(), Counter(), 0.0
        for piece in pieces(r["text"]):
            below = 0.0
            for word in piece:
                bits = model.log2([mixer.head(word)], np.array([before]))[0] + model.log2([word], skip=mixer.HEAD)[0]
                before = mixer.class_of(word)
                below += adapted(bits, words, word, lm.WORD_HALF)
            key = b" ".join(piece)
            static = level.log2(np.array([uses[key]]), np.array([below]))[0]
            total += adapted(static, segments, key, lm.SEGMENT_HALF)
        assert found[r["doc_id"]]["_score"] == pytest.approx(total * math.log10(2), rel=1e-4)


def test_heads_of_a_class_are_a_distribution(trained):
    """Heads (two bytes, or one and the word's end, or the text's end) share what the code leaves."""
    _, model = trained
    own = [b for b in range(256) if b not in b" \n"]
    firsts = [bytes([b]) for b in own]
    one = np.exp2(model.log2([*firsts, b"\n"], np.full(len(own) + 1, 7))).sum()
    assert 0.9 < one < 1
    after = [b"t" + bytes([b]) for b in range(256)]
    assert np.exp2(model.log2(after, np.full(256, 7))).sum() == pytest.approx(np.exp2(model.log2([b"t"], np.array([7]))[0]), rel=0.01)


def test_marks_are_heads_and_classes():
    words = [b"a", b"\n", b"it", b"x.", b"\xc3\xa9t\xc3\xa9", b"\x00", b"\x00\x00b"]
    for word, mark in zip(words, mixer.marks(words).tolist(), strict=True):
        assert (mixer.head_of(mark), mark % mixer.CLASSES) == (mixer.head(word), mixer.class_of(word))
    assert len(mixer.marks([])) == 0
