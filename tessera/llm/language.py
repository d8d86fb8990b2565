"""Language of web pages by Bayesian fusion of four kinds of evidence.

* Text: a model of byte trigrams of each language, fitted on a bounded labelled sample, gives the
  likelihood of a page's visible text. Neighbouring trigrams tell much the same, so the likelihood
  counts as that of at most ``EFFECTIVE`` trigrams.
* Declared language: how often pages of each language declare each code, counted over all pages with
  the text's probabilities in place of labels.
* Address suffix, site and host: the share of each language among a host's other pages, smoothed
  towards that of its site (the last two labels), this towards that of the suffix (the last
  label), and this towards that of all pages. The page itself is left out at every level.

Counts are sums by group, of each host first and of the levels above from the hosts' sums.

Defined results: a null or empty page has no text evidence (all languages alike); without a declared
language the code is ''; only its primary part counts, and what is not two or three letters is
'other'. A null or malformed URL has the host ''. Without labelled text there are no languages, and
lang and posterior are null. Ties go to the language that sorts first. Extra columns are
ignored; repeated rows are separate pages; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.staging import materialise

BUCKETS, EFFECTIVE, STRENGTH = 1 << 15, 60, 4.0
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def visible(page: str) -> str:
    """A page's text without markup, scripts, styles and comments."""
    return entities.unescape(_HIDDEN.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """How often each bucket of byte trigrams of the lower-cased letters occurs."""
    data = np.frombuffer(" ".join(re.findall(r"[^\W\d_]+", text.lower())).encode(), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(BUCKETS, dtype=np.int64)
    code = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_share: np.ndarray  # buckets by languages

    def probabilities(self, text: str) -> np.ndarray:
        n = trigrams(text)
        used = np.flatnonzero(n)
        total = n[used].sum()
        if not total:
            return np.full(len(self.languages), 1 / len(self.languages))
        score = n[used] @ self.log_share[used] * min(1.0, EFFECTIVE / total)
        p = np.exp(score - score.max())
        return p / p.sum()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500, most_bytes: int = 16384) -> TextModel:
    """Fit on at most ``per_language`` texts of each language, those of the smallest hash of the id among texts of 1 to ``most_bytes`` bytes: a bounded sample. A label without such a text is no language."""
    own = labelled.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where(F.octet_length("t").between(1, most_bytes) & F.col("l").isNotNull())
    thin = own.select("k", "l", F.pmod(F.xxhash64("k"), F.lit(1 << 40)).alias("h"))
    often = own.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") > 2 * per_language + 100)
    # of frequent languages only hashes that may be among the smallest, so that few rows meet in a task
    thin = thin.join(F.broadcast(often), "l", "left").where(F.col("n").isNull() | (F.col("h") * F.col("n") < (1 << 40) * (1.3 * per_language + 50)))
    chosen = thin.withColumn("nth", F.row_number().over(W.partitionBy("l").orderBy("h", "k"))).where(F.col("nth") <= per_language).select("k", "l")
    sample = own.join(F.broadcast(chosen), ["k", "l"]).select("l", "t").collect()  # per_language texts a language at most, of most_bytes
    names = sorted({r.l for r in sample})
    at = {name: i for i, name in enumerate(names)}
    count = np.ones((BUCKETS, len(names)))
    for r in sample:
        count[:, at[r.l]] += trigrams(r.t)
    return TextModel(tuple(names), np.log(count / count.sum(axis=0)))


def _sum_of(column: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Per page: ``key``, host, declared, suffix, text_lang, lang, posterior (of lang)."""
    n = len(model.languages)
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
    own = pages.select(F.col(key).alias("key"), host.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = pages.schema[key].dataType.simpleString()
    if not n:
        return own.select(F.col("key").alias(key), "host", F.lit("").alias("declared"), F.element_at(F.split("host", r"\."), -1).alias("suffix"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # buckets * languages numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            p, declared = [], []
            for page in batch.column(2).to_pylist():
                found = _DECLARED.search(page)
                code = found[1].lower() if found else ""
                declared.append(code if not code or len(code) in (2, 3) else "other")
                p.append(m.probabilities(visible(page)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(p, pa.list_(pa.float64()))], ["key", "host", "declared", "p"])

    seen = own.mapInArrow(run, f"key {kind}, host string, declared string, p array<double>")
    labels = F.split("host", r"\.")
    suffix, site = F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    seen = materialise(seen.withColumn("suffix", suffix).withColumn("site", site), "text-evidence")
    hosts = materialise(seen.groupBy("host", "site", "suffix").agg(_sum_of("p", n).alias("c_host"), F.count("*").alias("n_host")), "hosts")
    sites = hosts.groupBy("site", "suffix").agg(_sum_of("c_host", n).alias("c_site"), F.sum("n_host").alias("n_site"))
    suffixes = sites.groupBy("suffix").agg(_sum_of("c_site", n).alias("c_suffix"), F.sum("n_site").alias("n_suffix"))
    total = suffixes.agg(_sum_of("c_suffix", n).alias("c_all"), F.sum("n_suffix").alias("n_all")).first()
    if total.n_all is None:
        return seen.select(F.col("key").alias(key), "host", "declared", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    levels = hosts.join(sites, ["site", "suffix"]).join(suffixes, "suffix").drop("site", "suffix")
    codes = seen.groupBy("declared").agg(_sum_of("p", n).alias("c_code"))  # at most one row per two- or three-letter code
    full = seen.join(levels, "host").join(codes, "declared").withColumn("n_codes", F.lit(codes.count()))

    def smoothed(count: str, size: str, towards: Column) -> Column:
        rest = F.zip_with(F.col(count), F.col("p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
        return F.zip_with(rest, towards, lambda c, t: (c + STRENGTH * t) / (F.col(size) - 1 + STRENGTH))

    base = F.array(*(F.lit((c + 1.0) / (total.n_all + n)) for c in total.c_all))
    prior = smoothed("c_host", "n_host", smoothed("c_site", "n_site", smoothed("c_suffix", "n_suffix", base)))
    overall = F.array(*(F.lit(float(c)) for c in total.c_all))
    code = F.zip_with(F.zip_with("c_code", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)) + 1), F.zip_with(overall, "p", lambda c, p: c - p + F.col("n_codes")), lambda a, b: a / b)
    evidence = F.zip_with(F.zip_with("p", code, lambda a, b: F.greatest(a, F.lit(1e-12)) * b), prior, lambda a, b: a * b)
    scored = full.withColumn("joint", evidence).withColumn("at", F.array_position("joint", F.array_max("joint"))).withColumn("text_at", F.array_position("p", F.array_max("p")))
    names = F.array(*map(F.lit, model.languages))
    return scored.select(
        F.col("key").alias(key), "host", "declared", "suffix", F.element_at(names, F.col("text_at").cast("int")).alias("text_lang"), F.element_at(names, F.col("at").cast("int")).alias("lang"),
        (F.array_max("joint") / F.aggregate("joint", F.lit(0.0), lambda a, b: a + b)).alias("posterior"),
    )
