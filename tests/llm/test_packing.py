import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldhub.llm import packing, tokens
from fieldhub.llm.packing import default_tokenizer, plan
from fieldhub.llm.tokens import Ids


def tokenizer():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def fill(runs):
    at = {}
    for r in runs:
        for k in range(r.last - r.first + 1):
            at.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    return at


@pytest.mark.parametrize("size", [8, 50, 2048])
def test_plan_uses_as_many_sequences_as_best_fit(size):
    rnd = random.Random(size)
    for n in (1, 7, 400):
        items = [rnd.randint(1, size) if rnd.random() < 0.6 else rnd.randint(1, 1 + size // 9) for _ in range(n)]
        counts = {x: items.count(x) for x in items}
        runs = plan(counts, size)
        for pieces in fill(runs).values():
            ends = 0
            for offset, length in sorted(pieces):
                assert offset == ends
                ends += length
            assert ends <= size
        rooms = []
        for x in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= x]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else size) - x)
        assert len(fill(runs)) == len(rooms)


def test_ids_are_the_tokenizers(docs):
    rnd, parts = random.Random(3), [" ", "  ", "\n", "\t", "a", "b's", "é", " ", " ", "<|endoftext|>", "12", "!?", "Ġ", "\x1c", "'ll", "日本", "\r\n"]
    texts = [r["text"] for r in docs.limit(60).collect()]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3_000)]
    ids, own = Ids(default_tokenizer()), tokenizer()
    wanted = [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    assert ids.encode(texts) == wanted
    assert ids.encode(texts[::-1]) == wanted[::-1]


def check(df, size):
    own, rows = tokenizer(), df.select("doc_id", "text").collect()
    wanted = []
    for r in rows:
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids), 0, -size))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
            wanted.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    found = packing.pack(df, size=size).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(wanted, key=repr)
    places = {}
    for r in found:
        places.setdefault(r["_sequence"], []).append((r["_offset"], r["_length"]))
    for pieces in places.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= size
    lengths = [w[3] for w in wanted]
    assert len(places) == len(fill(plan({n: lengths.count(n) for n in lengths}, size)))


def test_pack_the_table(docs):
    check(docs, 2048)


def test_pack_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    check(odd_docs, 64)
    assert packing.pack(no_docs).count() == 0


def test_a_worker_keeps_few_words_between_batches():
    ids = tokens.Ids(packing.default_tokenizer())
    text = " ".join(f"w{i:x}" for i in range(150_000))
    assert ids.encode([text]) == ids.encode([text])
    ids.encode(["a b c"])
    assert len(ids.fresh) + len(ids.old) <= 2 * tokens.REMEMBERED <= 100_000
