"""Spelling variants against the edit distance of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from fieldhub.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zA-ZÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(((-n[x], x) for x in near[w] if n[x] >= 10 * n[w]), default=(0, None))[1] for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("_word", "_n", "_near", "_form", "_form_n", "_root").collect())


def test_sorted_list_scan():
    draw = random.Random(1)
    for letters, most in (("ab", 9), ("abc", 6), ("aé÷", 5)):
        for _ in range(150):
            words = sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(1, most))) for _ in range(40)})
            want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
            got = list(variants.near_pairs(words))
            assert len(got) == len(set(got))
            assert set(got) == want


@pytest.mark.parametrize("most", [256, 3])
def test_near_words_are_whole(spark, most):
    draw = random.Random(2)
    words = {"".join(draw.choice("abÀ") for _ in range(draw.choice([7, 8, 9]))) for _ in range(400)}
    words |= {"aaaaaaa" + c + d for c in "abc" for d in ["", "a", "b"]} | {"x" * 7, "x" * 8}
    rows = spark.createDataFrame([(w, k + 2) for k, w in enumerate(sorted(words))], "_word string, _n long")
    pairs = [(r["_word"], r["_near"]) for r in variants.near_words(rows, most).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_equal_brute_force(spark):
    draw = random.Random(4)
    stems = ["Ärgerlich", "ordinary", "ordinery", "Fremdwörter", "×÷multiply", "ZEICHEN", "zeichens", "aaaaaaaa"]
    docs = []
    for i in range(300):
        words = [draw.choice(stems[: 1 + k % 8]) for k in range(20)]
        if draw.random() < 0.3:
            words.append(draw.choice(stems)[:-1] + draw.choice("xyz"))
        docs.append((i, draw.choice([" ", ", ", "-9"]).join(words)))
    docs += [(400 + k, "kettenwort kettenwort") for k in range(300)] + [(800 + k, "kettenworx") for k in range(40)]
    docs += [(900 + k, "kettenwoxx") for k in range(3)]
    docs += [(5, docs[5][1]), (None, "ordinary ordinari ordinari"), (301, None), (302, "")]
    frame = spark.createDataFrame([(i, t, "w", 2) for i, t in docs], "doc_id long, text string, _word string, _n long")
    want = brute(docs)
    assert any(row[5] not in (row[0], row[3]) for row in want)  # a chain of forms
    assert found(variants.variants(frame)) == want
    assert found(variants.variants(frame, most=2)) == want


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(variants.variants(odd_docs)) == brute(docs)
    assert found(variants.variants(no_docs)) == []


def test_long_texts_are_searched_in_parts(monkeypatch):
    text = ("Grüße Wörterbuch " * 50 + "x" * 300 + " Ende").encode()
    whole = [w for part in variants.runs(text) for w in part]
    monkeypatch.setattr(variants, "PART", 20)
    assert [w for part in variants.runs(text) for w in part] == whole
