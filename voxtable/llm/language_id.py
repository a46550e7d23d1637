"""Language identification by Bayesian fusion of evidence.

A document's posterior over languages multiplies four kinds of evidence:

* its whole text, by hashed byte trigrams under a naive Bayes model. Trigrams of a text
  depend on each other, so the log likelihood ratio is tempered to ``EFFECTIVE`` trigrams;
* the language its markup declares, right with probability ``DECLARED``;
* the suffix of its address, if it is a country's (``SUFFIX_LANGUAGE``), right with
  probability ``SUFFIX``;
* a prior of its host, smoothed from host to registered domain to suffix to all documents.
  Counts come from the text evidence alone, by grouped aggregation.

The models count all documents that declare one of the languages; a declaration may be
wrong now and then, the counts outvote it. A document counts with the square root of its
length, so that a very long or repetitive one doesn't make a model alone.

Besides the languages there is a background class for foreign text and junk. Its trigrams
are the mean of all languages' and of equal ones, so text of no language is likelier under
it, and text of a language under its own model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxtable.plans.storage import arrow_batches, packed, resident, small_side, staged, unpacked, trimmed

LANGUAGES = ("de", "en", "es", "fr")
#: Buckets of trigrams; bytes of a text hashed at once.
BUCKETS, BLOCK = 1 << 14, 1 << 20
EFFECTIVE, DECLARED, SUFFIX, SMOOTHING, ACCEPT = 60.0, 0.9, 0.7, 20.0, 0.5
#: What a bucket that no document has counts as; parts of a count in which documents are summed.
UNSEEN, PARTS = 0.1, 1000
#: Suffixes of countries with one of the languages. Fixed values.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}


def trigram_counts(text: str | None) -> np.ndarray:
    """How often each bucket's trigrams occur in the text, lower-cased as bytes (A-Z alone)."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    data = (text or "").encode("utf-8", "replace").lower()
    for at in range(0, max(0, len(data) - 2), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + 2, len(data) - at), at).astype(np.uint32)
        code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - 14), minlength=BUCKETS)
    return out


def train(docs: DataFrame, text_col: str, declared: Column, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log probability of every bucket by language (languages x BUCKETS).

    Each task sends one vector of counts per language, so what is shuffled doesn't depend
    on the lengths of texts or on how the languages are distributed.
    """
    index = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident("language", dict)  # what another operator keeps in this worker goes
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in trimmed(batches):
            for text, lang in zip(batch["t"], batch["l"], strict=True):
                counts = trigram_counts(text)
                total[index[lang]] += np.floor(counts * (PARTS / np.sqrt(max(1, counts.sum())))).astype(np.int64)
        where = np.nonzero(total)
        yield pd.DataFrame({"l": where[0], "b": where[1], "n": total[where]})

    known = docs.select(F.col(text_col).alias("t"), declared.alias("l")).filter(F.col("l").isin(*languages))
    with arrow_batches(docs.sparkSession):
        sums = known.mapInPandas(counted, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages), BUCKETS), UNSEEN)
    for row in sums:  # at most languages x BUCKETS
        table[row["l"], row["b"]] += row["n"] / PARTS
    return np.log(table / table.sum(axis=1, keepdims=True))


def with_background(model: np.ndarray) -> np.ndarray:
    """The model with the background class as its last row.

    Languages without documents have equal trigrams and take no part in it.
    """
    known = np.exp(model[np.ptp(model, axis=1) > 0])
    mean = np.vstack([known, np.full((1, BUCKETS), 1 / BUCKETS)]).mean(axis=0)
    return np.vstack([model, np.log(mean)])


def _evidence(model: np.ndarray):
    """UDF: tempered log likelihoods of a text by language, the background last; null where the text has no trigram."""
    weights = np.ascontiguousarray(with_background(model).T)

    @pandas_udf("array<double>")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        resident("language", dict)
        for batch in trimmed(texts):
            out = []
            for text in batch:
                counts = trigram_counts(text)
                n = int(counts.sum())
                if n:
                    at = np.nonzero(counts)[0]
                    like = counts[at] @ weights[at]
                    like = (like - like.max()) * min(1.0, EFFECTIVE / n)
                    out.append(np.round(like, 9))
                else:
                    out.append(None)
            yield pd.Series(out)

    return evidence


def _softmax(log: Column) -> Column:
    top = F.array_max(log)
    e = F.transform(log, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def host_priors(scored: DataFrame, k: int) -> DataFrame:
    """``host`` and ``prior`` (array over ``k`` classes), from ``scored`` (_host, _like).

    Every document adds its text posterior in whole thousandths, so sums don't depend on
    their order. A level's counts are smoothed by SMOOTHING documents of its parent.
    """
    post = F.transform(_softmax(F.col("_like")), lambda x: F.round(x * 1000).cast("long"))
    domain, suffix = F.substring_index("_host", ".", -2), F.substring_index("_host", ".", -1)
    votes = scored.select("_host", F.when(F.col("_like").isNotNull(), post).alias("p"))
    sums = [F.coalesce(F.sum(F.col("p")[i]), F.lit(0)).alias(f"n{i}") for i in range(k)]
    hosts = staged(votes.groupBy("_host").agg(*sums).withColumns({"_domain": domain, "_suffix": suffix}), "language-hosts")
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]

    def smooth(level: DataFrame, parent: Column) -> Column:
        total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
        return F.array(*[(F.col(f"n{i}") + 1000 * SMOOTHING * parent[i]) / (total + 1000 * SMOOTHING) for i in range(k)])

    counts = hosts.agg(*again).head()
    everything = sum(x or 0 for x in counts)
    base = F.array(*[F.lit(((x or 0) + 1000) / (everything + 1000 * k)) for x in counts])
    suffixes = hosts.groupBy("_suffix").agg(*again)
    suffixes = suffixes.select("_suffix", smooth(suffixes, base).alias("_up"))
    domains = hosts.groupBy("_domain", "_suffix").agg(*again).join(suffixes, "_suffix")
    domains = domains.select("_domain", smooth(domains, F.col("_up")).alias("_up"))
    joined = hosts.join(domains, "_domain")
    return staged(joined.select(F.col("_host").alias("_host2"), smooth(joined, F.col("_up")).alias("_prior")), "language-priors")


def _judged(rows: DataFrame, prior: DataFrame, languages: Sequence[str], accept: float) -> DataFrame:
    """``rows`` (_like, _declared, _host, ...) with lang_id, posterior and kept."""
    k = len(languages)
    side = small_side(prior)
    joined = rows.join(side, rows["_host"] == side["_host2"], "left")
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.substring_index("_host", ".", -1))

    def says(value: Column, right: float, i: int) -> Column:
        ratio = float(np.log(right * (k - 1) / (1 - right)))
        return F.when(value == languages[i], F.lit(ratio)).otherwise(F.lit(0.0))

    text = [F.col("_like")[i] + F.log(F.col("_prior")[i]) for i in range(k + 1)]
    log = [text[i] + says(F.col("_declared"), DECLARED, i) + says(suffix, SUFFIX, i) for i in range(k)] + [text[k]]
    posterior = _softmax(F.array(*log))
    out = joined.withColumn("_post", F.when(F.col("_like").isNotNull() & F.col("_prior").isNotNull(), posterior))
    best = F.array_max(F.transform(F.slice("_post", 1, k), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    out = out.withColumn("_best", best)
    return out.withColumns(
        {
            "lang_id": F.when(F.col("_best").isNotNull(), F.element_at(F.array(*map(F.lit, languages)), 1 - F.col("_best.i"))),
            "posterior": F.col("_best.p"),
            "kept": F.coalesce(F.col("_best.p") >= accept, F.lit(False)),
        }
    )


def _scored(docs: DataFrame, text: Column, declared: Column, host: Column, languages: Sequence[str], **more: Column) -> DataFrame:
    base = docs.select(text.alias("_t"), F.lower(F.substring(declared, 1, 2)).alias("_declared"), F.coalesce(F.lower(host), F.lit("")).alias("_host"), *[c.alias(n) for n, c in more.items()])
    model = train(base, "_t", F.col("_declared"), languages)
    return base.withColumn("_like", _evidence(model)("_t")).drop("_t")


def identify(docs: DataFrame, id_col: str, text: Column, declared: Column, host: Column, languages: Sequence[str] = LANGUAGES, accept: float = ACCEPT) -> DataFrame:
    """One row per row: ``id_col, lang_id, posterior, declared, kept``.

    ``posterior`` is that of the best language, among all languages and the background;
    ``kept`` is whether it is at least ``accept``. A text
    without three bytes has no language: ``lang_id`` and ``posterior`` are null, ``kept``
    is false. Null declarations add no evidence and null hosts share one prior. Rows with
    null or repeated ids are judged like all others; ties go to the first language. An
    empty table gives an empty result.
    """
    with arrow_batches(docs.sparkSession):
        scored = staged(_scored(docs, text, declared, host, languages, _id=F.col(id_col)), "language-scored")
    out = _judged(scored, host_priors(scored, len(languages) + 1), languages, accept)
    return out.select(F.col("_id").alias(id_col), "lang_id", F.round("posterior", 6).alias("posterior"), F.col("_declared").alias("declared"), "kept")


def keep_identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", languages: Sequence[str] = LANGUAGES, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the documents that ``identify`` rejects, all columns as they were."""
    text, declared, host = F.col(text_col), F.col(declared_col), F.col(host_col)
    base = packed(docs, _t=text, _declared=F.lower(F.substring(declared, 1, 2)), _host=F.coalesce(F.lower(host), F.lit("")))
    udf = _evidence(train(base, "_t", F.col("_declared"), languages))
    with arrow_batches(docs.sparkSession):
        votes = staged(base.select("_host", udf("_t").alias("_like")), "language-votes")
    prior = host_priors(votes, len(languages) + 1)
    return unpacked(_judged(base.withColumn("_like", udf("_t")).drop("_t"), prior, languages, accept).filter("kept"))
