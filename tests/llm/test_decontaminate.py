"""Suffix automaton and decontamination against windows compared one by one."""

import random
import re

import pytest

from fieldhub.llm import decontaminate
from fieldhub.llm.automaton import WindowAutomaton

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, width):
    """(number of words, hit positions, ids) by comparing every window at every place."""
    have = words(text)
    hit, ids = set(), set()
    for item, given in items:
        wanted = words(given)
        run = min(width, len(wanted))
        windows = {tuple(wanted[i : i + run]) for i in range(len(wanted) - run + 1)} if run else set()
        for at in range(len(have) - run + 1):
            if tuple(have[at : at + run]) in windows:
                hit.update(range(at, at + run))
                ids.add(str(item))
    return len(have), hit, sorted(ids)


def test_automaton_finds_every_window():
    draw = random.Random(3)
    for _ in range(300):
        items = [(str(i), [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(9))]) for i in range(5)]
        text = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        width = draw.choice([2, 3, 4])
        made = WindowAutomaton(items, width)
        _, hit, ids = brute(b" ".join(text).decode(), [(i, b" ".join(w).decode()) for i, w in items], width)
        found, names = set(), set()
        for end, length, owners in made.matches([text[:17], [], text[17:]]):
            found.update(range(end - length, end))
            names.update(owners)
        assert found == hit
        assert sorted(names) == ids


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short, item here!"), (3, None),
         (4, "..."), (5, "ünter wörter 7 acht neun zehn elf zwölf dreizehn vierzehn fünfzehn"), (5, "second text of five"),
         (None, "nobody's item of words"), (10, "two three four five six seven eight nine ten eleven")]
DOCS = [(1, "x ONE two-three four five six seven eight nine ten eleven twelve y"), (2, "a short item here and short item here"),
        (3, None), (4, ""), (5, "one two three four five six seven eight nine"), (6, "nobody s item of words"),
        (7, "ünter wörter 7 acht neun zehn elf zwölf dreizehn vierzehn"), (7, "second text of five"), (None, "short item here"),
        (8, "Ünter wörter 7 acht neun zehn elf zwölf dreizehn vierzehn"), (8, "Ünter wörter 7 acht neun zehn elf zwölf dreizehn vierzehn"),
        (9, "pad " * 3000 + "one two three four five six seven eight nine ten " + "wort " * 200_000)]


@pytest.mark.parametrize("shard_words", [200_000, 8])
def test_overlap_equals_brute_force(spark, shard_words):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in DOCS], "doc_id long, text string, item_id string, _row int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(repr, ((r["_id"], r["_words"], r["_hit"], r["_items"])
                            for r in decontaminate.overlap(docs, items, shard_words=shard_words).collect())))
    want = []
    for i, text in DOCS:
        count, hit, ids = brute(text, ITEMS, 10)
        want.append(repr((i, count, len(hit), [x for x in ids if x != "None"])))
    assert got == sorted(want)


def test_overlap_of_long_items_and_empty_tables(spark):
    long = [f"w{k}" for k in range(500)]
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(long[95:120])), (2, " ".join(long[100:109]))], "doc_id long, text string")
    built = decontaminate.automata(items, shard_words=60, piece=40)
    assert built.count() > 3
    rows = decontaminate._marked(docs, docs["doc_id"], "text", built).collect()
    assert {r["_row"]: (r["_starts"], r["_ends"]) for r in rows} == {1: ([0], [25]), 2: ([], [])}
    assert [r["_hit"] for r in decontaminate.overlap(docs, items.limit(0)).collect()] == [0, 0]
    assert decontaminate.overlap(docs.limit(0), items).count() == 0


def test_decontaminated_removes_spans_and_rows(spark):
    passage = "one two three, four five six seven eight nine TEN eleven twelve"
    rows = [(1, f"Before. {passage}! After, as it was.", None), (2, f"x {passage}", "b"), (3, None, "c"), (4, "Short item here.", "d"),
            (5, f"{passage} mid words {passage} and so on to the very end of it all and more and more of it", "e")]
    docs = spark.createDataFrame([(*r, [1, 2]) for r in rows], "doc_id long, text string, _text string, _items array<int>")
    out = decontaminate.decontaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.dtypes == docs.dtypes
    assert {r["doc_id"]: (r["text"], r["_text"], r["_items"]) for r in out.collect()} == {
        1: ("Before. ! After, as it was.", None, [1, 2]), 3: (None, "c", [1, 2]), 4: ("Short item here.", "d", [1, 2]),
        5: (" mid words  and so on to the very end of it all and more and more of it", "e", [1, 2])}


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "cat sat on")], "item_id long, text string")
    found = {r["_id"]: r["_hit"] for r in decontaminate.overlap(odd_docs, items).collect()}
    assert {i for i, n in found.items() if n} == {1, 2, 3}
    assert decontaminate.overlap(odd_docs, items).count() == odd_docs.count()
    assert decontaminate.decontaminated(no_docs, items).columns == no_docs.columns
    assert decontaminate.decontaminated(odd_docs, items).count() == odd_docs.count()
