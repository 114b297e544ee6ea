"""The pipeline's stages on small tables: each one's decisions against plain Python, and odd rows in each."""

import collections
import re

import pytest
from test_operators import bag, classes, fold, jaccard, plain_repeats, prose

import corpus_pipeline
from cullspark.llm import queries


def reread(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_equal_plain_decisions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = reread(spark, stage(spark, docs, "/root/testdata/sf0.001"), f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append(docs)
    first, exact, near, cut, packed = ([r.asDict() for r in x.collect()] for x in seen)
    texts = {r["doc_id"]: r["text"] for r in first}
    last = {}
    for d in sorted(texts):
        last[fold(texts[d])] = d
    assert {r["doc_id"] for r in exact} == set(last.values())
    bags = {r["doc_id"]: bag(r["text"]) for r in exact}
    groups = classes([(a, b) for a in bags for b in bags if a < b and bags[a] and jaccard(bags[a], bags[b]) >= 0.8], bags)
    assert {r["doc_id"] for r in near} == set(groups.values())
    stays = plain_repeats([(r["doc_id"], r["text"], 0) for r in near])
    assert {r["doc_id"]: r["text"] for r in cut} == {d: t for (d, _, _), (t, _) in stays.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    tokens = collections.Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {r["doc_id"] for r in cut} and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in packed)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, text_hash int, done int, `class` int, host string, class_id int, kept int, number int"


def odd_rows():
    a, b, c = prose(91), prose(92), prose(93)
    near = a.split()
    near[9] = "changed"
    texts = [(1, a), (2, a.upper()), (2, b), (2, b), (3, " ".join(near)), (4, None), (5, ""), (6, " \n "), (None, c), (None, a), (None, None), (7, prose(94, 60_000)), (8, "\n".join([c] * 3)), (9, "1 2 3 4"), (9, "x")]
    return [(d, t, "en", None if k % 2 else "h", len(t or ""), "p", 1, 2, 3, "q", 4, 5, 6) for k, (d, t) in enumerate(texts)]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_in_each_stage(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = stage(spark, docs, "")
    left = collections.Counter((r.doc_id, r.text) for r in got.collect()) if k < 4 else collections.Counter(r.doc_id for r in got.collect() if r.start == 0)
    every = collections.Counter((r[0], r[1]) for r in odd_rows())
    a, b, c = prose(91), prose(92), prose(93)
    if k < 4:
        assert got.columns == docs.columns
    if k == 0:
        gone = {(4, None), (5, ""), (6, " \n "), (None, None), (9, "1 2 3 4")}
        assert {key for key in every if re.search("[a-z]{3}", (key[1] or "").lower())} <= set(left)
        assert not gone & set(left) and all(left[key] == every[key] for key in left)
    elif k == 1:
        assert left == every - collections.Counter({(1, a): 1, (None, a): 1, (4, None): 1, (None, None): 1})
    elif k == 2:
        assert left == every - collections.Counter({(2, a.upper()): 1, (3, " ".join(w if i != 9 else "changed" for i, w in enumerate(a.split()))): 1})
    elif k == 3:
        assert sum(left.values()) == len(odd_rows()) and left[2, ""] == 1 and left[2, b] == 2 and left[None, a] == 1 and left[4, None] == 1
    else:
        assert left == collections.Counter(r[0] for r in odd_rows())
    assert stage(spark, docs.where("false"), "").count() == 0


def test_names():
    names = list(queries.QUERIES)
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert [x for x, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "substring dedup", "packing"]
