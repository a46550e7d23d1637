import random

import numpy as np

from voxtable.llm.near_dedup import drop_near_duplicates, near_duplicates, shingle_set


def brute(rows, words, per_cent):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    out = [" ".join([word() for _ in range(rng.randrange(20, 60))] + passage) for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    for i in range(60):
        pair = [word() for _ in range(rng.randrange(1, 80))]
        out.append(" ".join(pair))
        if len(pair) > 8:
            pair[rng.randrange(len(pair))] = word()
        out.append(" ".join(pair).upper())
    out += ["", " \t\n", "a", "A", "a b", "a b c", "x " * 20_000]
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _d int")
    for words, per_cent in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_duplicates(docs, words=words, per_cent=per_cent).collect())
        assert got == brute(rows, words, per_cent)
    kept = drop_near_duplicates(docs, words=3, per_cent=85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c, k in brute(rows, 3, 85) if k]


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b c d"), (2, "a b c d"), (None, "A B c d"), (3, "q")], "doc_id long, text string")
    out = sorted(str(tuple(r)) for r in near_duplicates(docs, words=3).collect())
    assert out == sorted(["(1, 0, 1, True)", "(2, 2, 2, True)", "(2, 2, 2, True)", "(None, 2, 2, False)", "(3, 1, 3, True)"])
    assert sorted(r.doc_id for r in drop_near_duplicates(docs, words=3).collect()) == [1, 2, 3]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_shingles_of_short_and_long_texts():
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0
    assert shingle_set("a b", 3)[0] != shingle_set("a b c", 3)[0]
    many = shingle_set(" ".join(map(str, range(100_000))), 5)
    assert len(many) == 99_996 and (np.diff(many) > 0).all() and many[0] >= 0


def forms(count=700, slots=32, seed=5):
    """Filled forms: links are rare, and made of values that hundreds of forms have."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(count):
        copy = list(base)
        for i in range(slots):
            copy[4 + 9 * i] += rng.choice("ab")
        out.append(" ".join(copy))
    return list(enumerate(out))


def test_members_of_long_lists_are_compared_with_each_other(spark):
    rows = forms()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, words=3, per_cent=85).collect())
    assert got == brute(rows, 3, 85)
    assert 0 < sum(not r[3] for r in got) < len(got)
