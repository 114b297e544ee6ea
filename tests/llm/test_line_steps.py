"""Steps of line dedup that once cost more than they had to."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cullspark.llm import line_dedup


def test_words_of_lines_are_dealt_in_six_columns(spark):
    """Numbers that share a column come apart again, the largest ones too."""
    n, top = 10, 2**31 - 1
    rows = [(5, k, m, 0, 0, 0, h, hot) for k, (m, h, hot) in enumerate([(n, 0, False), (n, 3, True), (n + 1, 0, False), (top, 0, False), (top - 1, top - 2, False)])]
    cold = spark.createDataFrame(rows, "word long, class long, n int, at int, parities long, more long, hots int, hot boolean")
    pairs = line_dedup._candidates(cold)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    sent = re.search(r"MapInArrow _listed\(([^)]*)\)", plan)[1]
    assert len(sent.split(", ")) == 6
    # the row of a hot word meets no longer ones, but shorter ones meet it
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, 1), (0, 2), (3, 4)]


def test_rarity_counts_words_and_comes_in_blocks(spark):
    texts = ["a b a\nc", "B c", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = line_dedup.rarity(docs)
    at = line_dedup._bucket(line_dedup._tokens("a b c")[1])
    assert counts[at].tolist() == [3, 2, 2] and counts.sum() == 7 and len(counts) == line_dedup.BUCKETS
    assert line_dedup.BUCKETS % line_dedup.COUNTS == 0


def test_words_of_a_line_in_many_pairs_are_parted_once():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([2, 3, 3]), pa.array(["a b c d e", "a b c d e", "a b c d"]), pa.array(["a b c d", "x y", "x y"])], ["a", "b", "x", "y"])
    again = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["not read"]), pa.array(["not read"])], ["a", "b", "x", "y"])
    assert [b.to_pydict() for b in line_dedup._alike(iter([batch, again]))] == [{"a": [1], "b": [2]}] * 2


def _lines(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return line_dedup.lines(docs, line_dedup.rarity(docs)).where("n > 3")


def test_a_pair_that_has_met_in_the_word_before_is_not_listed_again(spark):
    words = [f"w{k}" for k in range(40)]
    lines = _lines(spark, [" ".join(words), " ".join([*words, "x"]), " ".join([*words[:20], "y", *words[20:]]), "a b c d e f"]).cache()
    shared = sum(np.array([len(set(x) & set(y)) for k, x in enumerate(p) for y in p[:k]]).sum() for p in [[r.prefix for r in lines.collect()]])
    rows = line_dedup._calm(lines, 3).repartition(3, "bucket").sortWithinPartitions("bucket").mapInArrow(line_dedup._listed, "a long, b long").collect()
    assert shared > 9  # they meet in so many words
    assert len(set(rows)) == 3 and len(rows) <= 6
    of = {r["class"]: r.n for r in lines.collect()}
    assert sorted(tuple(sorted((of[a], of[b]))) for a, b in set(rows)) == [(40, 41), (40, 41), (41, 41)]


def test_words_packed_by_bucket_give_the_pairs_that_rows_give(spark):
    base = [[f"w{(m * 11 + j * j) % 60}_{j % 7}" for j in range(8 + m)] for m in range(12)]
    texts = ["\n".join(" ".join("new" if j == k else w for j, w in enumerate(b)) for b in base) for k in range(6)]
    lines = _lines(spark, texts).dropDuplicates(["class"]).cache()
    cold = lines.select("class", "n", "parities", "more", F.posexplode("prefix").alias("at", "word"), F.lit(0).alias("hots"), F.lit(False).alias("hot")).cache()
    want = {tuple(r) for r in line_dedup._candidates(cold).collect()}
    sent = line_dedup._calm(lines, 5)
    assert sent.count() <= 5 * lines.rdd.getNumPartitions() < cold.count()
    for buckets in (1, 5):
        assert {tuple(r) for r in line_dedup._candidates(cold.limit(0), lines, buckets).collect()} == want
        assert {tuple(r) for r in line_dedup._candidates(cold, None, buckets).collect()} == want
    assert len(want) > 9


def test_lines_of_one_length_are_in_order_of_their_signed_classes():
    """The blocks of words of many lines order them so too; a pair has one order in all its words."""
    word, n = np.array([5, 5, 7, 5, 5, 9, 9]), np.array([4, 4, 4, 4, 3, 4, 4])
    for kind in (np.array([3, -2, 1, -(2**63), 9, -1, 0]), np.array([1, 0, 0, 2, 3, -1, -2])):  # first bits tell them apart, and don't
        order, of = line_dedup._by_word(word, n, kind)
        assert [(word[k], n[k], kind[k]) for k in order] == sorted((w, m, c) for w, m, c in zip(word, n, kind) if w != 7)
        assert of.tolist() == [0] * 4 + [1] * 2


def test_hashes_of_words_depend_on_all_their_bytes():
    base = "".join(chr(97 + k % 26) for k in range(200))
    words = [base[:k] for k in range(1, 150)] + [base[:k] + "*" + base[k + 1 : 150] for k in range(150)] + ["é" * k for k in range(1, 60)]
    alone = [line_dedup._tokens(w)[1][0] for w in words]
    line, together = line_dedup._tokens("\n".join(f"{w}  {w.upper()}" for w in words))
    assert len(set(alone)) == len(words)
    assert together.tolist() == np.repeat(alone, 2).tolist() and line.tolist() == np.repeat(np.arange(len(words)), 2).tolist()
    assert line_dedup._tokens("")[1].tolist() == []


def test_words_of_many_lines_are_found_alike_by_arrays_and_by_joins(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 2)
    base = [[f"w{(m * 11 + j * j) % 30}" for j in range(8 + m)] for m in range(12)]
    texts = ["\n".join(" ".join("new" if j == k else w for j, w in enumerate(b)) for b in base) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for rows in (line_dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
        _, reps, links = line_dedup.similar_lines(docs)
        got.append(sorted((r["class"], r.links, *r.near) for r in links.collect()))
    assert got[0] == got[1] and len(got[0]) > 9
    counts = reps.withColumn("grade", line_dedup.grade(F.col("n"))).select("grade", "calm", F.posexplode("prefix").alias("at", "word")).where("at >= calm").groupBy("word", "grade").count().collect()
    c = {(r.word, r.grade): r["count"] for r in counts}
    want = {(w, g): c.get((w, g), 0) + c.get((w, g + 1), 0) for w, k in c for g in (k, k - 1)}
    hot = {(r.word, r.grade): r.c for r in line_dedup._hot_words(reps, 3).collect()}
    assert hot == {k: v for k, v in want.items() if v > 2} != {}
