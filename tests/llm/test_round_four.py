"""Evidence of documents from the pages that show them."""

import collections
import re

from pyspark.sql import functions as F
from test_operators import plain_fusion

from cullspark.llm import langid, queries

DIR = "/root/testdata/sf0.001"


def plain_shown(pages):
    """declared, suffix and host of documents, from pages (url, html) whose addresses all have a host, a language and a number."""
    seen = collections.defaultdict(lambda: [collections.Counter() for _ in range(3)])
    for url, html in pages:
        host, suffix, number = re.fullmatch(r"https?://([^/]+)/([a-z]{2})/(\d+)(?:\.html)?/?(?:[?#].*)?", url).groups()
        for counter, value in zip(seen[int(number)], (re.search(r'<html lang="([a-z]{2})"', html).group(1), suffix, host)):
            counter[value] += 1
    return {k: [min(c, key=lambda v: (-c[v], v)) for c in counters] for k, counters in seen.items()}


def test_documents_are_identified_by_all_four_kinds_of_evidence(spark, tmp_path):
    """Most texts are cut to a few letters, of which other evidence can decide."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("text", F.expr("if(doc_id % 5 = 0, text, substr(text, 3, 5))"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    shown = plain_shown([tuple(r) for r in pages.select("url", "html").collect()])
    rows = docs.select("doc_id", "text", "source").collect()
    data = []
    for r in rows:
        declared, suffix, host = shown.get(r.doc_id, (None, None, r.source))
        data.append((r.text, declared, suffix, host, ".".join(host.split(".")[-2:]) if "." in host else None))
    assert sum(d[1] is not None and d[2] is not None for d in data) == len(shown) > 10
    got = {r.doc_id: r for r in queries.op1_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r, (language, sure) in zip(rows, plain_fusion(data, langid.train(docs))):
        assert got[r.doc_id].language == language and abs(got[r.doc_id].confidence - sure) < 1e-6


def test_pages_show_documents(spark):
    html = "<html lang='{}'><body>x</body></html>"
    pages = [
        ("https://a.com/de/7", html.format("de")),
        ("https://u@b.com:80/de/7.html?x=/en/9", html.format("fr-FR")),
        ("http://b.com/fr/7/#top", html.format("fr")),
        ("http://b.com/8", None),
        ("http://b.com/es/item9", html.format("es")),
        ("http://b.com/es/99999999999999999999", html.format("es")),
        ("http://b.com", html.format("es")),
        (None, html.format("es")),
        ("5", html.format("es")),
    ]
    got = {r.id: r[1:] for r in langid.shown_by(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {7: ("fr", "de", "b.com"), 8: (None, None, "b.com")}


def test_a_folder_may_have_no_pages(spark, tmp_path):
    spark.read.parquet(f"{DIR}/documents.parquet").limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op1_language_id(spark, str(tmp_path)).count() == 20


def test_evidence_by_id_comes_before_a_rows_own(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    few = [(1, "ab", "src0"), (1, "ab", "src1"), (None, "ab", "src0"), (2, "", "src0")]
    some = docs.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(d, t, None, s) for d, t, s in few], "doc_id long, text string, lang string, source string"))
    pages = docs.where("lang = 'fr'").selectExpr("concat('http://x.fr/fr/', doc_id + 100) as url", "'<html lang=\"fr\">' as html")
    pages = pages.unionByName(spark.createDataFrame([("http://x.fr/fr/1", '<html lang="fr">'), ("http://x.fr/fr/77777", "<html lang=de>")], "url string, html string"))
    with_, without = (langid.documents_identified(spark, some, p).collect() for p in (pages, None))
    assert len(with_) == len(without) == some.count()
    assert [r.language for r in with_ if r.doc_id == 1] == ["fr", "fr"] and [r.language for r in with_ if r.doc_id == 2] == ["und"]
    assert {r.language for r in without if r.doc_id == 1} != {"fr"}
    assert langid.documents_identified(spark, some, pages.where("false")).count() == some.count()
