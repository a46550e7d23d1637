import hashlib
import random
import re

import pytest

from voxtable.llm.decontamination import build_index, contamination, drop_contaminated, phrase_matches, phrases_of, proximity_matches

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, b in items:
            b = words(b)
            n = min(len(b), 10)
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], SCHEMA + ", _row int, pos string")
    b = spark.createDataFrame([(*x, 2) for x in items], ITEMS + ", term int")
    return sorted(map(str, (tuple(r) for r in contamination(d, b).collect())))


def test_odd_rows_equal_brute_force(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (10, passage), (2, "Alpha beta"), (3, "x x x x x x x x x x x"), (4, None), (5, ""), (6, "ÄÖ ü 12"), (7, "never seen"), (8, "--"), (None, "solo"), (2, "gamma!")]
    docs = [
        (1, f"a {passage} b"), (1, f"a {passage} b"), (None, passage.upper()), (2, None), (3, ""), (4, "alpha, BETA; gamma"), (5, "x " * 40), (6, "x " * 9),
        (7, "ÄÖ-ü/12"), (8, "äö ü 12"), (9, "solo"), (10, ("zz " * 30000) + passage + " solo"), (11, passage.replace("six", "6")), (12, "one two three four five six seven eight nine ten"),
        (13, "two three four five six seven eight nine ten eleven " * 3), (14, "alpha gamma beta"),
    ]
    assert run(spark, docs, items) == sorted(map(str, brute(docs, items)))


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_of_few_words_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 25), rng.choice((2, 3, 8)))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 120), rng.choice((2, 3)))) for i in range(40)]
    docs += [(100 + i, f"{text(5, 8)} {rng.choice(items)[1]} {text(9, 8)}") for i in range(20)]
    assert run(spark, docs, items) == sorted(map(str, brute(docs, items)))


def test_empty_tables(spark):
    docs, items = [(1, "a b c")], [(1, "a b")]
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == sorted(map(str, brute(docs, [])))


def test_full_index_finds_phrases_and_near_terms(spark):
    docs = spark.createDataFrame([(1, "red dog saw one blue cat"), (2, "cat blue x x x x x x red"), (3, "blue cat red"), (4, None)], SCHEMA)
    items = spark.createDataFrame([(1, "red blue cat"), (2, "blue cat"), (3, "red unicorn")], ITEMS)
    names, phrases = phrases_of(items)
    index = build_index(docs)
    ids = index.documents.join(names, how="cross")
    exact = phrase_matches(index, phrases).join(ids, ["_row", "phrase"]).select("doc_id", "_item", "start", "length")
    assert sorted(map(tuple, exact.collect())) == [(1, 2, 4, 2), (3, 2, 0, 2)]
    near = lambda k: sorted({(r.doc_id, r._item) for r in proximity_matches(index, phrases, k).join(ids, ["_row", "phrase"]).collect()})
    assert near(2) == [(1, 2), (2, 2), (3, 1), (3, 2)]
    assert near(5) == [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2)]
    assert near(8) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_contaminated_documents_go(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (None, "a b"), (3, None)], SCHEMA)
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, items).collect()) == ["3", "None"]
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, items, most_share=0.5).collect()) == ["1", "3", "None"]


def test_query_equals_brute_force_on_the_whole_table(spark):
    from voxtable.llm.queries import op11_decontamination

    sf = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted(map(str, (tuple(r) for r in op11_decontamination(spark, sf).collect()))) == sorted(map(str, want))
