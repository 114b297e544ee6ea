"""Language identification by fusing four kinds of evidence in one posterior.

Text gives likelihoods under byte-trigram models; the declared markup language and the address suffix
give likelihoods; the host gives the prior, smoothed towards its site's and that towards the whole
corpus's. The tables for the last three are grouped counts of the whole corpus under the text's own
best language, and a row's own text is taken out of them before they are fused with it. Text that the
uniform model explains better than any language is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

LANGUAGES = ("en", "fr", "de", "es")
UNKNOWN = "und"
#: Labelled documents of each language that the trigram models are fitted on, at most about.
SAMPLE = 2_000
BUCKETS = 1 << 15
#: Trigrams count as so many independent ones at most; a text's trigrams are far from independent.
EVIDENCE = 60
#: Documents' worth of the parent's prior in a host's, and of the uniform one in the rest.
STRENGTH = 10.0
#: Prior of text in none of the languages.
UNKNOWN_PRIOR = 1e-3
SURE = 0.5
#: Second-level names under which countries register sites.
SECOND = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "net", "nom", "or", "org")
BLOCK = 1 << 20
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams that aren't centred on a gap, in blocks; other signs than letters are gaps."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8)
    for at in range(0, len(raw) - 2, BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        on = b[1:-1] != 32
        yield ((b[:-2][on] << np.uint32(16) | b[1:-1][on] << np.uint32(8) | b[2:][on]) * np.uint32(2654435761)) >> np.uint32(17)


def train(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log-likelihoods (buckets x languages), and of the uniform model last, from rows (doc_id, text, lang).

    The sample is by hash of doc_id at each language's rate; counts are summed by bucket and language,
    so what reaches the driver is bounded by the table.
    """
    counts = {r["lang"]: r["n"] for r in labelled.where(F.col("lang").isin(*languages)).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / max(1, counts.get(k, 0))))])
    chosen = labelled.where(F.col("lang").isin(*languages) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h in trigrams(text or ""):
                    total[languages.index(lang)] += np.bincount(h, minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    rows = chosen.select("lang", "text").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((BUCKETS, len(languages)), 0.1)
    total[rows["bucket"], rows["lang"]] += rows["n"]
    return np.hstack([np.log(total / total.sum(axis=0)), np.full((BUCKETS, 1), -np.log(BUCKETS))]).astype(np.float32)


def _code(column: Column) -> Column:
    """The primary subtag of a declared language, or null: two or three letters, so the values are few."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def _address(url: Column) -> tuple[Column, Column]:
    """Host and address suffix: a two-letter first folder, else a two-letter top-level domain."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    folder = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return F.nullif(host, F.lit("")), F.nullif(F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract(host, r"\.([a-z]{2})$", 1)), F.lit(""))


def _site(host: Column) -> Column:
    """The part of a host that is registered: its last two labels, three under a country's second level; null for a host without a dot."""
    last = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(host, rf"([^.]+\.(?:{'|'.join(SECOND)})\.[a-z]{{2}})$", 1)
    return F.coalesce(F.nullif(three, F.lit("")), F.nullif(last, F.lit("")))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence that documents hold themselves: their source is the host. Markup and address are those of the pages that show them (shown_by); their lang column is the label that models learn, so it is no evidence."""
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"))
    return rows.select("id", "text_hash", "text", none.alias("declared"), none.alias("suffix"), "host")


def _declared(html: str) -> Column:
    """The html element's language."""
    return _code(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def shown_by(pages: DataFrame) -> DataFrame:
    """Evidence that pages give of the documents they show: id, declared, suffix, host.

    A page shows the document whose doc_id is the last part of its address's path, without a file's ending; others
    show none. Of a document's pages each kind's most frequent value counts, ties to the smaller; null where none has one.
    """
    last = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([0-9]+)(?:\.[a-zA-Z0-9]+)?/?(?:[?#]|$)", 1)
    host, suffix = _address(F.col("url"))
    kinds = {"declared": _declared("html"), "suffix": suffix, "host": host}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("e")
    seen = pages.select(last.try_cast("long").alias("id"), each).where("id is not null and e.value is not null").groupBy("id", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))
    most = [F.min(F.when(F.col("kind") == k, F.struct(-F.col("n"), "value")))["value"].alias(k) for k in kinds]
    return seen.groupBy("id").agg(*most)


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the html element's language, the address and the text without its tags."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host, suffix = _address(F.col("url"))
    declared = _declared("html")
    return pages.select(F.col("page_id").cast("long").alias("id"), F.xxhash64("html").alias("text_hash"), text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"))


def scored(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows without text but with the trigrams' number and log-likelihoods under each model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            n, sums = [], []
            for text in batch.column("text").to_pylist():
                total, many = np.zeros(table.shape[1]), 0
                for h in trigrams(text or ""):
                    total += table[h].sum(axis=0, dtype=np.float64)
                    many += len(h)
                n.append(many)
                sums.append(total.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], [*names, "n", "likely"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", n long, likely array<double>"
    return rows.select(*names, "text").mapInArrow(run, schema)


def _counts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key and how often each best language comes with it."""
    each = [F.count_if(F.col("best") == k).cast("double").alias(f"c{k}") for k in range(size)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*each).select(key, F.array(*(f"c{k}" for k in range(size))).alias(f"{key}_counts"))


def _shares(counts: Column, parent: Column) -> Column:
    """Counts smoothed towards the parent's shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.zip_with(counts, parent, lambda c, p: c + STRENGTH * p), lambda x: x / (total + STRENGTH))


def identify(rows: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, shown: DataFrame | None = None) -> DataFrame:
    """id, text_hash, declared, language, confidence and kept, for rows of evidence (id, text_hash, text, declared, suffix, host).

    language is und, and kept false, for text without letters (null and empty ones too), for text that
    no language explains better than the uniform model, and where the posterior of the best is under
    a half. Missing declarations, suffixes and hosts are no evidence; a host without a dot has no site and
    is smoothed towards the corpus. Rows without id are judged like others, repeated rows each. Ties go to
    the earlier language. Other columns are not read. No rows in, no rows out. shown is evidence by id (id,
    declared, suffix, host) that comes before a row's own; it is joined when texts are gone.
    """
    size = len(languages) + 1
    kinds = ("declared", "suffix", "host")
    marked = scored(rows.select("id", "text_hash", "text", *kinds), model)
    if shown is not None:
        marked = marked.join(shown.select("id", *(F.col(c).alias(f"{c}_shown") for c in kinds)), "id", "left")
        marked = marked.withColumns({c: F.coalesce(f"{c}_shown", c) for c in kinds}).drop(*(f"{c}_shown" for c in kinds))
    marked = marked.withColumn("site", _site(F.col("host")))
    marked = cut(marked.withColumn("best", (F.array_position("likely", F.array_max("likely")) - 1).cast("int")), "scored")
    seen = marked.where("n > 0")
    totals = seen.groupBy("best").agg(F.count(F.lit(1)).alias("c")).collect()  # a row for each language
    every = np.bincount([r["best"] for r in totals], [r["c"] for r in totals], size) + 1.0
    every[-1] = 0
    every = every / every.sum() * (1 - UNKNOWN_PRIOR)
    every[-1] = UNKNOWN_PRIOR
    whole = F.array(*map(F.lit, every.tolist()))
    # hosts with their sites' counts; declared languages and suffixes are two or three letters: at most 27 ** 3 rows each
    hosts = seen.where("host is not null").groupBy("host").agg(F.first("site").alias("site"))
    hosts = _counts(seen, "host", size).join(hosts, "host").join(_counts(seen, "site", size), "site", "left")
    hosts = cut(hosts.select("host", "host_counts", "site_counts"), "hosts")
    few = hosts.count() <= BROADCAST_ROWS
    joined = marked.join(F.broadcast(hosts) if few else hosts, "host", "left")
    for key in ("declared", "suffix"):
        joined = joined.join(F.broadcast(_counts(seen, key, size)), key, "left")
    own = lambda c: F.when(F.col("n") > 0, F.transform(c, lambda x, k: F.when(k == F.col("best"), x - 1).otherwise(x))).otherwise(c)
    joined = joined.withColumn("prior", _shares(own(F.col("site_counts")), whole)).withColumn("prior", F.coalesce("prior", whole))
    joined = joined.withColumn("prior", F.coalesce(_shares(own(F.col("host_counts")), F.col("prior")), whole))
    scale = F.least(F.lit(1.0), EVIDENCE / F.greatest("n", F.lit(1)))
    score = F.transform(F.zip_with("likely", "prior", lambda a, p: F.struct(a.alias("a"), p.alias("p"))), lambda x: x["a"] * scale + F.log(x["p"]))
    for key in ("declared", "suffix"):
        likely = _likelihood(own(F.col(f"{key}_counts")), every, languages)
        score = F.zip_with(score, F.coalesce(likely, F.array_repeat(F.lit(0.0), size)), lambda a, b: a + b)
    out = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    share = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, (*languages, UNKNOWN))), F.array_position("score", F.col("top")).cast("int"))
    out = out.withColumn("confidence", F.when(F.col("n") > 0, share).otherwise(0.0))
    language = F.when((F.col("n") > 0) & (F.col("confidence") >= SURE), best).otherwise(UNKNOWN)
    return out.select("id", "text_hash", "declared", language.alias("language"), "confidence", (language != UNKNOWN).alias("kept"))


def _likelihood(counts: Column, every: np.ndarray, languages: tuple[str, ...]) -> Column:
    """Log-likelihoods of a declared value under each language, up to a constant; the unknown one takes the mean."""
    ratio = F.zip_with(_shares(counts, F.array(*map(F.lit, every.tolist()))), F.array(*map(F.lit, every.tolist())), lambda s, p: F.log(s / p))
    mean = F.aggregate(F.slice(ratio, 1, len(languages)), F.lit(0.0), lambda s, x: s + x) / len(languages)
    return F.concat(F.slice(ratio, 1, len(languages)), F.array(mean))


def documents_identified(spark: SparkSession, docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """identify for documents, with models fitted on a sample of them: doc_id, text_hash, language, confidence, kept.

    Pages (url, html), if given, bring the markup and address of the documents that they show.
    """
    shown = None if pages is None else shown_by(pages)
    return identify(of_documents(docs), train(docs), shown=shown).withColumnRenamed("id", "doc_id").drop("declared")
