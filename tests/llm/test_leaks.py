import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm.leaks import build_automaton, leaked_passages, leaks, passages
from graphmill.llm.words import WORD, words

DOCS = "doc_id long, text string, item_id int, lang string"


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(6)] + ["中", "é"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([3, 8, 15])))) for i in range(12)]
    docs = []
    for d in range(60):
        text = say(rnd.choice([0, 5, 40]))
        if d % 2:
            text[len(text) // 2 : len(text) // 2] = words(rnd.choice(items)[1])
        docs.append((d, rnd.choice([" ", "\n> ", ", **"]).join(w.upper() if rnd.random() < 0.3 else w for w in text), 1, "en"))
    runs = {}
    for i, t in items:
        w = words(t)
        for a in range(len(w) - 4):
            runs.setdefault(tuple(w[a : a + 5]), set()).add(str(i))
    true = {(str(d), i) for d, t, *_ in docs for a in range(len(words(t)) - 4) for i in runs.get(tuple(words(t)[a : a + 5]), ())}
    frame, held = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + items[:2], "item_id long, text string")
    for chars in (2_000_000, 60):
        found = leaked_passages(frame, held, min_words=5, automaton_chars=chars)
        rows = found.collect()
        assert {(r["doc"], r["item"]) for r in rows} == true
        text_of, item_of = {str(d): t for d, t, *_ in docs}, {str(i): t for i, t in items}
        for r in rows:
            there = words(text_of[r["doc"]][r["start"] : r["end"]])
            assert there == words(item_of[r["item"]])[r["item_word"] : r["item_word"] + r["n_words"]] and len(there) >= 5
    assert leaks(found).count() == len(true)


def test_longest_passages_and_offsets():
    automaton = build_automaton([("i", "a b c d e f g")], 3)
    text = "x A, b... C d! y a b c"
    assert passages(text, automaton) == [("i", 2, 13, 0, 4), ("i", 17, 22, 0, 3)]
    assert passages("", automaton) == [] and build_automaton([("i", "a b")], 3) is None


def every_run(text, items, min_words):
    """Longest shared runs by comparing every place of the text with every place of every item."""
    there, out = words(text), set()
    for name, item in items:
        own = words(item)
        for a in range(len(there)):
            for b in range(len(own)):
                n = 0
                while a + n < len(there) and b + n < len(own) and there[a + n] == own[b + n]:
                    n += 1
                if n >= min_words and not (a and b and there[a - 1] == own[b - 1]):
                    out.add((name, b, n, a))
    return out


@given(st.lists(st.text("ab ", min_size=1, max_size=40), min_size=1, max_size=4), st.text("abc ", max_size=80), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_longest_runs_are_exact(texts, text, min_words):
    items = [(str(i), t) for i, t in enumerate(texts)]
    held = build_automaton(items, min_words)
    starts = [m.start() for m in WORD.finditer(text)]
    got = {(i, at, n, starts.index(a)) for i, a, _, at, n in passages(text, held)} if held else set()
    assert got == every_run(text, items, min_words)


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "who was it"), (2, "what"), (3, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Who was it? one two three four", 0, ""), (2, "who was, what", 0, "")], DOCS)
    assert {(r["doc"], r["item"], r["n_words"]) for r in leaked_passages(docs, items, min_words=4, whole_from=3).collect()} == {("1", "1", 3), ("1", "3", 4)}
    assert {r["item"] for r in leaked_passages(docs, items, min_words=4).collect()} == {"3"}


def test_nulls_empty_and_long(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (None, "one two three four"), (3, "too short")], "item_id long, text string")
    rows = [(1, None, 0, ""), (2, "", 0, ""), (None, "one two three four", 0, ""), (4, "z " * 200_000 + "one two three four", 0, ""), (5, "one two three", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert [(r["doc"], r["item"], r["start"]) for r in leaked_passages(docs, items, min_words=4).collect()] == [("4", "1", 400_000)]
    assert leaked_passages(docs.limit(0), items).count() == 0 and leaked_passages(docs, items.limit(0)).count() == 0
