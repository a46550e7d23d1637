import numpy as np
from pyspark.sql import functions as F

from voxtable.llm import language_id as li
from voxtable.llm.language_id import host_priors, identify, keep_identified, train, trigram_counts, with_background

TEXTS = {"en": "the cat and the dog went over the hill with another thing", "de": "der hund und die katze gingen über den berg mit nicht", "fr": "le chien et la souris étaient dans les jardins avec une", "es": "el perro y los gatos estaban en la montaña con una señora"}


def make(spark):
    rows = [(i, TEXTS[lang] * (1 + i % 3), lang, f"www.{lang}.example.org") for i, lang in enumerate(list(TEXTS) * 10)]
    rows += [(100, TEXTS["fr"] * 3, "en", "www.fr.example.org"), (101, None, "en", "h"), (102, "", None, None), (103, TEXTS["de"], None, None), (None, TEXTS["es"], "xx", ""), (0, TEXTS["en"], "en", "x"), (104, "the" * 400_000, "EN-us", "x")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")


def test_counts_are_those_of_all_trigrams():
    assert trigram_counts("Abcab").sum() == 3 and trigram_counts(None).sum() == 0 and trigram_counts("ab").sum() == 0
    long = "abcde" * 500_000
    assert trigram_counts(long).sum() == len(long) - 2


def test_wrong_declarations_are_outvoted_and_textless_rows_rejected(spark):
    docs = make(spark)
    out = {r.doc_id: r for r in identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert out[100].lang_id == "fr" and out[103].lang_id == "de" and out[None].lang_id == "es" and out[104].lang_id == "en"
    assert out[101].lang_id is None and not out[101].kept and not out[102].kept
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_priors_are_smoothed_upwards(spark):
    rows = [("a.x.org", [0.0, -50.0])] * 100 + [("b.x.org", [0.0, -50.0]), ("c.y.com", [-50.0, 0.0]), ("n", None)]
    prior = {r._host2: r._prior for r in host_priors(spark.createDataFrame(rows, "_host string, _like array<double>"), 2).collect()}
    assert prior["a.x.org"][0] > prior["b.x.org"][0] > prior["c.y.com"][0] > 0.5 and abs(sum(prior["n"]) - 1) < 1e-9


def test_empty(spark):
    docs = make(spark).limit(0)
    assert identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).count() == 0 and keep_identified(docs).count() == 0


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    seen = docs.filter("doc_id % 5 <> 0")
    model = train(seen, "text", F.col("lang"))
    names = ["de", "en", "es", "fr"]
    rows = docs.filter("doc_id % 5 = 0 and lang is not null and length(text) > 60").collect()
    right = sum(names[int(np.argmax(model @ trigram_counts(r.text)))] == r.lang for r in rows)
    assert right >= 0.95 * len(rows)


FOREIGN = {
    "it": "la ragazza guardava il mare dalla finestra della cucina mentre suo fratello leggeva un libro vecchio e nessuno parlava",
    "ru": "девушка смотрела на море из окна кухни пока её брат читал старую книгу и никто не говорил ни слова",
    "junk": "}{#@ %%^ &*( 0x9f3a77 |||| ~~~ <<>> 8841-2219-0031 ;;;; @@@ $$$ ==== ++++ zq9 xk7 vv2 qq1 jj8",
}


def posterior(docs, accept=0.5):
    """The fused posterior of every row by hand: text, host prior of three levels, declaration, suffix."""
    names, k = list(li.LANGUAGES), len(li.LANGUAGES)
    total = np.full((k, li.BUCKETS), li.UNSEEN)
    for r in docs:
        if r.lang in names:
            c = trigram_counts(r.text)
            total[names.index(r.lang)] += np.floor(c * (li.PARTS / np.sqrt(max(1, c.sum())))) / li.PARTS
    model = with_background(np.log(total / total.sum(axis=1, keepdims=True)))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    like = {}
    for r in docs:
        c = trigram_counts(r.text)
        x = model @ c
        like[r.doc_id] = (x - x.max()) * min(1.0, li.EFFECTIVE / c.sum()) if c.sum() else None
    votes = {r.doc_id: np.round(soft(like[r.doc_id]) * 1000) for r in docs if like[r.doc_id] is not None}
    levels = [lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]]
    base = sum(votes.values()) + 1000
    out = {}
    for r in docs:
        if like[r.doc_id] is None:
            out[r.doc_id] = None
            continue
        prior = base / base.sum()
        for level in reversed(levels):
            n = sum(votes[x.doc_id] for x in docs if x.doc_id in votes and level(x.source) == level(r.source))
            prior = (n + 1000 * li.SMOOTHING * prior) / (n.sum() + 1000 * li.SMOOTHING)
        log = like[r.doc_id] + np.log(prior)
        for value, right in ((r.lang, li.DECLARED), (li.SUFFIX_LANGUAGE.get(r.source.split(".")[-1]), li.SUFFIX)):
            if value in names:
                log[names.index(value)] += np.log(right * (k - 1) / (1 - right))
        p = soft(log)
        out[r.doc_id] = (names[int(p[:k].argmax())], round(float(p[:k].max()), 6), bool(p[:k].max() >= accept))
    return out


def test_posterior_equals_brute_force(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.concat(F.lit("www.h"), F.col("doc_id") % 5, F.lit(".s"), F.col("doc_id") % 2, F.element_at(F.array(F.lit(".de"), F.lit(".com"), F.lit(".uk")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("source"))
    more = [(10_000 + i, t, None, "www.h1.s1.com") for i, t in enumerate(FOREIGN.values())] + [(20_000, "", "de", "x.com"), (20_001, None, None, "")]
    docs = real.unionByName(spark.createDataFrame(more, real.schema))
    got = {r.doc_id: (r.lang_id, r.posterior, r.kept) if r.lang_id else None for r in identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    want = posterior(docs.collect())
    assert set(got) == set(want)
    for key, value in want.items():
        assert (got[key] is None) == (value is None)
        assert value is None or (got[key][0], got[key][2]) == (value[0], value[2]) and abs(got[key][1] - value[1]) < 2e-6


def test_foreign_text_and_junk_go_and_documents_stay(spark):
    """Models of a thousand documents; those of two hundred can keep foreign text."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = real.unionByName(spark.createDataFrame([(10_000_000 + i, t, None, None) for i, t in enumerate(FOREIGN.values())], real.schema))
    gone = {r.doc_id for r in docs.join(keep_identified(docs), "doc_id", "left_anti").collect()}
    assert {10_000_000 + i for i in range(len(FOREIGN))} <= gone and len(gone) <= len(FOREIGN) + real.count() // 200


def test_pages_are_judged_by_text_markup_and_address(spark):
    from voxtable.llm.queries import pages_language_id

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == pages.count() and {r.lang_id for r in rows if r.kept} <= set(li.LANGUAGES)
