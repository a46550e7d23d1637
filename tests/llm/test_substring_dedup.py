import random

import numpy as np

from voxtable.llm.substring_dedup import LEAST_WORDS, LONGEST, boundaries, covering, drop_passages, repeated_passages


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_boundaries_resist_insertions_and_cover_the_text():
    rng = random.Random(1)
    data = words(rng, 5000).encode()
    ends = boundaries(data)
    assert ends[-1] == len(data) and (ends[1:] > ends[:-1]).all()
    moved = {e + 3 for e in ends if e > 1020}
    changed = set(boundaries(data[:1000] + b"xyz" + data[1000:]).tolist())
    assert moved <= changed and len(changed - moved) < 60
    assert len(boundaries(b"")) == 0 and max(boundaries(b"a" * 5000)[1:] - boundaries(b"a" * 5000)[:-1]) <= LONGEST


def test_blocks_do_not_change_boundaries(monkeypatch):
    data = words(random.Random(2), 3000).encode()
    whole = boundaries(data).tolist()
    monkeypatch.setattr("voxtable.llm.substring_dedup.BLOCK", 777)
    assert boundaries(data).tolist() == whole


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(3)
    passages = [words(rng, 55) for _ in range(5)]
    rows = [(i, words(rng, 150)) for i in range(60)]
    for i in range(60, 120):
        rows.append((i, words(rng, rng.randrange(60)) + " " + passages[i % 5] + " " + words(rng, rng.randrange(60))))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    out = repeated_passages(docs).collect()
    texts = dict(rows)
    assert {r.doc_id for r in out} == set(range(65, 120))
    for r in out:
        assert r.first_id == 60 + r.doc_id % 5
        found = texts[r.doc_id].encode()[r.start_byte : r.end_byte]
        inner = found[24:-24]  # a chunk of a few bytes beside the passage may occur elsewhere too
        assert len(inner) > 60 and inner in passages[r.doc_id % 5].encode()


def test_copies_nulls_ties_empty(spark):
    rng = random.Random(4)
    text = words(rng, 90)
    docs = spark.createDataFrame([(5, text), (2, text), (None, text), (7, None), (8, ""), (9, "short"), (10, "short"), (11, text + " " + text)], "doc_id long, text string")
    out = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert set(out) == {5, None, 11}
    assert out[5].first_id == 2 and out[5].start_byte == 0 and out[5].n_words == 90
    assert repeated_passages(docs.limit(0)).count() == 0


def test_query_flags_copies_of_the_table(spark):
    from voxtable.llm.queries import op8_substring_dedup

    sf = "/root/testdata/sf0.001"
    out = op8_substring_dedup(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    flagged = {r.doc_id for r in out}
    first = {}
    for i in sorted(texts):
        if len(texts[i].split()) >= 20 and first.setdefault(texts[i], i) != i:
            assert i in flagged
    for r in out:  # every passage occurs elsewhere chunk by chunk, and earlier
        assert r.first_id <= r.doc_id and r.n_words >= 20
        data, ends = texts[r.doc_id], boundaries(texts[r.doc_id]).tolist()
        starts = [0, *ends[:-1]]
        for a, b in zip(starts, ends, strict=True):
            if r.start_byte <= a and b <= r.end_byte:
                assert sum(t.count(data[a:b]) for t in texts.values()) > 1


def whole_words(passage):
    """Words that start in chunks which lie inside of the passage wherever it stands: those after its first window."""
    data = passage.encode()
    ends = [e for e in boundaries(b"?" * 40 + b" " + data + b" " + b"?" * 40).tolist() if 41 + 16 <= e <= 41 + len(data)]
    return len(data[ends[0] - 41 : ends[-1] - 41].split()) if len(ends) > 1 else 0


def test_passages_of_51_words_with_few_boundaries_are_found(spark):
    rng = random.Random(6)
    hard = []
    while len(hard) < 25:
        passage = words(rng, 51)
        if 3 < whole_words(passage) < LEAST_WORDS - 3:
            hard.append(passage)
    rows = [(i, words(rng, 30) + " " + hard[i % 25] + " " + words(rng, 30)) for i in range(75)]
    rows += [(i, words(rng, 120)) for i in range(75, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == set(range(25, 75))
    texts = dict(rows)
    for r in found:
        part = texts[r.doc_id].encode()[r.start_byte : r.end_byte]
        assert r.n_words >= LEAST_WORDS and part in texts[r.first_id].encode()
    left = {r.doc_id: r.text for r in drop_passages(docs).collect()}
    for i, text in rows:
        assert left[i] == text if i not in range(25, 75) else len(left[i].split()) <= len(text.split()) - LEAST_WORDS + 2


def test_passages_whose_middle_stands_earlier_elsewhere_are_found(spark):
    rng = random.Random(8)
    rows, sure, clean = [], set(), set()
    for case, (n, middle) in enumerate(((24, 16), (30, 18), (28, 12), (24, 18), (51, 30))):
        for i in range(1000 * case, 1000 * case + 40):
            parts = [words(rng, (n - middle) // 2), words(rng, middle), words(rng, n - middle - (n - middle) // 2)]
            passage = " ".join(parts)
            rows.append((i, words(rng, 40) + " " + parts[1] + " " + words(rng, 40)))
            rows += [(k + i, words(rng, 40) + " " + passage + " " + words(rng, 40)) for k in (100, 200)]
            clean |= {i, i + 100} if middle < LEAST_WORDS else {i}
            data, passage = rows[-1][1].encode(), passage.encode()
            at = data.index(passage)
            # The method needs a whole chunk inside of the passage.
            if sum(at + 16 <= e <= at + len(passage) for e in boundaries(data).tolist()) > 1:
                sure.add(i + 200)
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {i: text.encode() for i, text in rows}
    assert sure <= {r.doc_id for r in found} and len(sure) > 180
    assert not clean & {r.doc_id for r in found}
    for r in found:
        if r.doc_id % 1000 >= 200:
            assert texts[r.doc_id][r.start_byte : r.end_byte] in texts[r.doc_id - 100]


def test_windows_cover_their_chunks():
    data = b"aa bb cc  dd ee"

    def windows(a, b, size):
        one = [np.array([x]) for x in (a, b, True, True)]
        return list(zip(*[v.tolist() for v in covering(data, *one, size)], strict=True))

    assert windows(3, 6, 2) == [(0, 0, 5, 1), (1, 3, 8, 1)]
    assert windows(4, 7, 2) == [(1, 3, 8, 1)]
    assert windows(8, 10, 2) == [(2, 6, 12, 1)]
    assert windows(0, 15, 4) == [] and windows(0, 15, 5) == [(0, 0, 15, 1)]
    assert windows(0, 2, 9) == []


def test_windows_hold_no_chunk_that_occurs_once():
    data = words(random.Random(9), 60).encode()
    ends = boundaries(data)
    starts = np.concatenate([[0], ends[:-1]])
    anchor = np.arange(len(ends)) == 4
    every = covering(data, starts, ends, anchor, np.ones(len(ends), bool), 20)
    near = covering(data, starts, ends, anchor, np.isin(np.arange(len(ends)), (3, 4)), 20)
    spans = [set(zip(w[1].tolist(), w[2].tolist(), strict=True)) for w in (every, near)]
    inside = lambda a, b: {k for k in range(len(ends) - 1) if a + 16 <= starts[k] and ends[k] <= b}
    assert spans[1] == {w for w in spans[0] if inside(*w) <= {3, 4}} != spans[0]


def test_dropping_passages_keeps_columns_nulls_and_first_occurrences(spark):
    rng = random.Random(7)
    text = words(rng, 60)
    rows = [(1, text, "a"), (2, text, "b"), (2, "other words", "c"), (None, text, "d"), (3, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _x string")
    out = sorted(((r.doc_id, r.text, r._x) for r in drop_passages(docs).collect()), key=lambda r: r[2])
    assert out == [(1, text, "a"), (2, "", "b"), (2, "other words", "c"), (None, "", "d"), (3, None, "e"), (4, "", "f")]
    assert drop_passages(docs.limit(0)).columns == docs.columns
