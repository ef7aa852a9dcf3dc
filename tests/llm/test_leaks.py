import random

from parchmill.llm import leaks
from parchmill.llm.forms import canonical
from parchmill.llm.leaks import ItemIndex, words
from tests.conftest import rows


def brute(items, w, run):
    return {i for i, v in items if any(v[k : k + run] == w[j : j + run] for k in range(len(v) - run + 1) for j in range(len(w) - run + 1))}


def test_index_against_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    for _ in range(150):
        items = [(i, rng.choices(vocabulary, k=rng.randint(3, 30))) for i in range(rng.randint(1, 70))]
        index = ItemIndex(items, 5)
        for _ in range(4):
            w = rng.choices(vocabulary + ["unknown"], k=rng.randint(0, 40))
            for _ in range(rng.randint(0, 3)):
                i, v = rng.choice(items)
                a = rng.randint(0, len(v) - 1)
                at = rng.randint(0, len(w))
                w[at:at] = v[a : a + rng.randint(3, 8)]
            assert index.leaked(w) == brute(items, w, 5)


def test_search_is_complete():
    """Block-max WAND finds exactly the items whose whole score reaches 1."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(6, 40))) for i in range(300)]
    index = ItemIndex(items, 6)
    for _ in range(200):
        query = set(rng.choices(vocabulary, k=rng.randint(1, 30)))
        score = [0.0] * len(index.ids)
        for t in query & set(index.postings):
            for n, v in zip(*index.postings[t][:2]):
                score[n] += v
        assert sorted(index.search(query)) == [n for n, s in enumerate(score) if s >= 1 - 1e-9]


def test_table(spark):
    passage = "If promoters fill 587 rows and rustic detractors fill 747 rows of the amber chart"
    items = spark.createDataFrame([(1, passage, "x"), (2, "too short to count", "x"), (3, None, "x"), (4, "Other words " + passage.lower(), "y")], "item_id long, text string, doc_id string")
    docs = [(1, "Intro. " + passage.upper().replace(" ", "\n ") + " End"), (2, passage[:40]), (3, None), (4, ""), (5, "fill 587 rows – and rustic; detractors “fill” 747 rows of the аmber chart"), (6, "Intro. " + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 1), (1, 4), (5, 1), (5, 4), (6, 1), (6, 4)]
    assert rows(leaks.leaked_items(df, items)) == want
    assert rows(leaks.leaked_items(df, items, index_chars=60)) == want
    assert rows(leaks.leak_report(leaks.leaked_items(df, items), items)) == [(1, 3), (2, 0), (3, 0), (4, 3)]
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_words():
    assert words("Ａ-b: Don’t_stop 3,5 ﬁx", canonical()) == ["a", "b", "don", "t", "stop", "3", "5", "fix"]
