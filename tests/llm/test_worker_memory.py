"""What op8 knows of a text without a window, and what a worker keeps of another operator."""

import numpy as np
from pyspark.sql import functions as F

from voxtable.llm import language_id as li, substring_dedup as sd
from voxtable.plans import storage

DOC = "doc_id long, text string"


def test_language_tasks_drop_what_another_operator_keeps(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away "
    docs = spark.createDataFrame([(i, text * 3, "en", "a.uk") for i in range(4)], f"{DOC}, lang string, source string")

    def fill(batches):
        storage.resident("another", lambda: bytearray(1))
        yield from batches

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, storage._resident))] * batch.num_rows)], ["k"])

    one = docs.coalesce(1)
    one.mapInArrow(fill, one.schema).collect()
    assert li.keep_identified(one).count() == 4
    assert "another" not in {row["k"] for row in one.select("doc_id").mapInArrow(kept, "k string").collect()}


def test_chunks_met_before_in_their_text_are_marked():
    assert sd._met_before(np.array([5, 3, 5, 5, 9, 3])).tolist() == [0, 0, 1, 1, 0, 1]


def test_repeats_of_one_id_and_text_are_found_as_those_inside_of_a_text(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    a, b = words(60), words(60)
    single = spark.createDataFrame([(1, f"{a} {words(30)} {a}"), (2, f"{words(10)} {b}"), (3, b)], DOC)
    found = sd.repeated_passages(single).groupBy("doc_id").agg(F.max("n_words").alias("n")).collect()
    assert {row["doc_id"]: row["n"] >= 50 for row in found} == {1: True, 3: True}
    twice = single.unionByName(single.filter("doc_id = 2"))
    assert {row["doc_id"] for row in sd.repeated_passages(twice).collect()} == {1, 2, 3}
