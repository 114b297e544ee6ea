"""Operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cullspark.llm import ann, bpe, chat, exact_dedup, langid, line_dedup, minhash, packing, queries, substring_dedup, warc
from cullspark.llm.graph import components
from cullspark.llm.tokens import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `class` int"


def prose(seed, n=80):
    r = random.Random(seed)
    words = [r.choice("the of and to in".split()) if r.random() < 0.4 else "".join(r.choice(["th", "er", "on", "an", "re", "ti", "es", "or"]) for _ in range(r.randint(2, 4))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


def rows():
    base = prose(1)
    near = base.split()
    near[40] = "changed"
    texts = [base, base.upper(), " ".join(near), prose(2), None, "", "  \n ", "one two", "x" * 200_000, prose(3, 3000), prose(4) + "\n" + base, "İΣς\x1c 　 日本語 <|endoftext|> don't"]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"h{i % 2}", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base, "en", "h", 1, "x", 1), (99, prose(2), "en", "h0", 1, "x", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(docs, none):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows():
        groups[fold(t)].append(d)
    want = sorted((str(d), max((x for x in groups[fold(t)] if x is not None), default=None), len(groups[fold(t)])) for d, t, *_ in rows())
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_groups(none).count() == 0


def test_index_inserts_and_deletes(spark, docs):
    index = exact_dedup.CuckooIndex.build(docs)
    more = spark.createDataFrame([(500, prose(1)), (501, "new")], "doc_id long, text string")
    grown = index.insert(more)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in grown.lookup(more).collect()}
    assert found == {500: (500, 4), 501: (501, 1)}
    less = grown.delete(spark.createDataFrame([(500,), (501,)], "doc_id long"))
    found = {r.doc_id: (r.keep_id, r.group_size) for r in less.lookup(more).collect()}
    assert found == {500: (1, 3)}


def test_shards_grow_on_insert(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(exact_dedup, "PARTIAL_ROWS", 5)
    make = lambda a, b: spark.createDataFrame([(k, f"t{k % 40}") for k in range(a, b)], "doc_id long, text string").repartition(3)
    index = exact_dedup.CuckooIndex.build(make(0, 50))
    grown = index.insert(make(50, 300))
    assert 5 <= index.shards < grown.shards
    found = {(r.keep_id % 40, r.keep_id, r.group_size) for r in grown.content.collect()}
    assert found == {(k, max(range(k, 300, 40)), len(range(k, 300, 40))) for k in range(40)}


def test_copies_meet_through_the_filter(monkeypatch):
    import pandas as pd

    digest = [hashlib.sha256(str(k % 7).encode()).hexdigest() for k in range(70)]
    shard = pd.DataFrame({"shard": 0, "kind": exact_dedup.INSERT, "digest": digest, "keep_id": range(70), "group_size": 1, "slots": None})
    sizes = lambda: set(exact_dedup._update(shard).query("kind == 0")["group_size"])
    assert sizes() == {10}
    monkeypatch.setattr(exact_dedup.CuckooFilter, "__contains__", lambda self, d: False)
    assert sizes() == {1}


def test_cuckoo_filter_resizes():
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    made = exact_dedup.CuckooFilter.of(keys)
    assert all(k in made for k in keys) and len(made.slots) * exact_dedup.SLOTS >= 3000
    for k in keys[:1500]:
        made.remove(k)
    assert all(k in made for k in keys[1500:])
    assert sum(k in made for k in keys[:1500]) < 30


# --- packing and tokens


def test_word_ids_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordEncoder(path, memo=50)
    for _, t, *_ in rows():
        assert np.frombuffer(own(t or ""), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_word_ids_of_very_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    from cullspark.llm import tokens

    path = queries.vocabulary("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordEncoder(path)
    text = " ".join(prose(k, 4000) for k in range(40)) + "x" * 3000
    want = lib.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "LONG", 1000)
    assert np.frombuffer(own(text), "<u4").tolist() == want


def test_packing_of_repeated_and_null_ids(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    data = [(None, "same words")] * 50 + [(3, "same words")] * 50 + [(3, prose(5, 6000))]
    got = packing.packed(spark.createDataFrame(data, "doc_id long, text string"), path).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.doc_id is None for r in got) == 50 and sum(r.start == 0 for r in got) == 101


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.packed(docs, path).collect()
    texts = {d: lib.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows()}
    for d, ids in texts.items():
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == d})
        at = 0
        for start, length, crc, n in own:
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    assert packing.packed(none, path).count() == 0


def test_plan_places_every_piece():
    r = random.Random(5)
    histogram = {n: r.randint(1, 300) for n in r.sample(range(1, 4097), 500)}
    patterns = packing.plan(histogram)
    placed = collections.Counter()
    for count, pattern in patterns:
        assert sum(n * t for n, t in pattern) <= 4096
        for n, t in pattern:
            placed[n] += count * t
    assert placed == histogram
    used = sum(n * c for n, c in histogram.items())
    assert used / (4096 * sum(c for c, _ in patterns)) > 0.97


# --- BPE


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, path).collect())
    want = collections.Counter()
    for d, t, *_ in rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encoded(none, path).count() == 0


def test_ids_come_from_the_transducer(monkeypatch):
    own = bpe.ByteBpe(queries.vocabulary("byte_bpe_50k.json"))
    seen = []
    step = bpe.ByteBpe.step
    monkeypatch.setattr(bpe.ByteBpe, "step", lambda self, w, e: seen.append((w, e)) or step(self, w, e))
    text = prose(8, 300) + " " + "ab" * 3000
    ids = b"".join(own.encode(text))
    assert {w for w, _ in seen} >= {w.encode() for w in own.split.findall(text) if len(w) < 100}
    assert any(not ended for _, ended in seen) and max(len(w) for w, _ in seen) <= bpe.BLOCK + own.lookahead
    monkeypatch.setattr(bpe.ByteBpe, "step", lambda self, w, e: ([], len(w)))
    fresh = bpe.ByteBpe(queries.vocabulary("byte_bpe_50k.json"))
    assert ids and not b"".join(fresh.encode(text))


def test_texts_in_many_blocks(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.ByteBpe(path)
    monkeypatch.setattr(bpe, "TEXT_BLOCK", 50)
    text = prose(8, 300) + " \n\n  " + "日本" * 400 + "   " * 100 + "it's <|endoftext|>  x" + " " * 70 + "1234" * 90 + "!?" * 80
    assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_stream_of_long_pretokens():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.ByteBpe(path)
    r = random.Random(3)
    for text in ("a" * 30_000, "ab" * 20_000, "".join(r.choice("thereing") for _ in range(40_000)), "=" * 20_000 + "-" * 20_001):
        for chunk in (1, 777, 5000):
            data = text.encode()
            chunks = (data[i : i + chunk] for i in range(0, len(data), chunk)) if chunk > 1 else iter([data])
            assert [i for ids in own.stream(chunks) for i in ids] == lib.encode(text, add_special_tokens=False).ids


def test_decoder_keeps_split_characters():
    own = bpe.ByteBpe(queries.vocabulary("byte_bpe_50k.json"))
    ids = np.frombuffer(b"".join(own.encode("日本語 é 🤖")), "<u4")
    assert "".join(own.decode(ids[i : i + 1] for i in range(len(ids)))) == "日本語 é 🤖"


# --- WARC


def test_archives(spark):
    big = "é" * 100
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", big + "z"), (2, None, big)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    want = collections.Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        again = h == big and p != 1
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert got == want
    assert warc.archived(df.limit(0)).count() == 0


def test_many_packages_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(warc, "READ_BYTES", 700)
    monkeypatch.setattr(warc, "TASK_RECORDS", 10)
    r = random.Random(6)
    pages = [(k, "u\x01" if k % 9 == 0 else f"u{k}", prose(r.randint(0, 60), 40) + "x" * (50_000 if k % 30 == 0 else 0)) for k in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(df)
    assert manifest.count() > 4
    index = warc.index(manifest)
    read = {x.page_id: x for x in warc.read_records(index, payload=True).collect()}
    first = {}
    for k, _, h in pages:
        first.setdefault(h, k)
    for k, u, h in pages:
        again = first[h] if first[h] != k else None
        assert (read[k].url, read[k].payload_bytes, read[k].refers_to) == (u, len(h.encode()), again)
        assert again is not None or bytes(read[k].payload).decode() == h


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"note"
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"first")
        z.writestr(zipfile.ZipInfo("b"), b"second")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    found = warc.members(io.BytesIO(raw), len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in found.items()} == {"a": b"first", "b": b"second"}


def test_zip64_directory():
    import struct

    name, data = b"m", b"payload"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + central + end64 + locator + end
    at, n = warc.members(io.BytesIO(raw), len(raw))["m"]
    assert raw[at : at + n] == data


# --- near-duplicates


def bag(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(pairs, ids):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_classes_in_small_blocks(spark, monkeypatch):
    """Chains, so that links lie between components that a bucket's first round has left apart, in blocks of three rows."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    out = []
    for chain in range(6):
        words = prose(50 + chain, 120).split()
        for k in range(15):
            out.append((chain * 100 + k, " ".join(words)))
            for j in range(k * 3, k * 3 + 2):
                words[j % len(words)] = f"w{chain}x{k}x{j}"
    r = random.Random(1)
    r.shuffle(out)
    bags = {d: bag(t) for d, t in out}
    want = classes([(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8], bags)
    got = minhash.near_classes(spark.createDataFrame(out, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_different_texts_under_one_id_are_judged_apart(spark):
    a, b, c = prose(61), prose(62), prose(63)
    near = a.split()
    near[7] = "changed"
    data = [(1, a), (2, " ".join(near)), (2, b), (2, b), (3, c), (3, b)]
    got = collections.Counter((r.doc_id, r.class_id, r.kept) for r in minhash.near_classes(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == {(1, 1, True): 1, (2, 1, False): 1, (2, 2, True): 2, (3, 3, True): 1, (3, 2, False): 1}


def test_near_classes(docs, none):
    texts = {d: t for d, t, *_ in rows() if d is not None}
    bags = {d: bag(t) for d, t in texts.items()}
    want = classes([(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8], texts)
    got = minhash.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows())
    assert minhash.near_classes(none).count() == 0


def test_chains_of_near_duplicates_link(spark):
    """Each text is near the next only, so most pairs of the class are under the threshold."""
    words = prose(9, 300).split()
    out = []
    for k in range(40):
        out.append((k, " ".join(words)))
        for j in range(k * 7, k * 7 + 4):
            words[j % 300] = f"w{k}x{j}"
    bags = [bag(t) for _, t in out]
    want = classes([(a, b) for a in range(40) for b in range(a + 1, 40) if jaccard(bags[a], bags[b]) >= 0.8], range(40))
    got = minhash.near_classes(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    a = (np.arange(1, 120, dtype=np.uint64), r.integers(1, 9, 119))
    b = (np.arange(30, 150, dtype=np.uint64), r.integers(1, 9, 120))
    bags = [(minhash._mix(x[0] + np.uint64(1000 * k)), x[1]) for k in range(60) for x in (a, b)]
    s = minhash.signatures(bags)
    assert abs((s[::2] == s[1::2]).mean() - minhash.similarity(a, b)) < 0.02


def test_a_signature_does_not_depend_on_its_batch():
    r = np.random.default_rng(9)
    bags = [minhash.shingles(" ".join(r.choice(["a", "b", "c", "d", "e", "f", "g"], n)).encode()) for n in [*range(1, 60), *range(60, 400, 20), 3000]]
    whole = minhash.signatures(bags)
    for size in (1, 2, 7, 30):
        parts = [minhash.signatures(bags[k : k + size]) for k in range(0, len(bags), size)]
        assert np.array_equal(np.concatenate(parts), whole)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(0, k) for k in range(400, 480)]
    got = {x.id: x.comp for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(links, {x for p in links for x in p})
    assert all(want[i] == c for i, c in got.items())


# --- substrings


def test_repeated_passages_go(spark, none):
    passage = " ".join(f"alpha{k} beta{k} gamma delta epsilon zeta eta theta." for k in range(9))
    docs = [(1, prose(21) + ".\n" + passage + "\n" + prose(22)), (2, prose(23) + ".\n" + passage), (3, passage + "\n" + prose(24)), (4, prose(25)), (5, None), (6, ""), (None, passage), (7, prose(26) + ".\n" + passage + "\n" + prose(27) + ".\n" + passage)]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hash int")).collect()}
    text = dict(docs)
    assert passage in got[1].text and got[1].n_removed == 0 and got[None].text == passage
    for d in (2, 3, 7):
        assert "alpha" not in got[d].text and got[d].n_removed > 0
    assert prose(24) in got[3].text and got[4].text == text[4] and got[5].text is None and got[6].text == ""
    assert substring_dedup.without_repeats(none).count() == 0


def plain_repeats(data):
    """What should stay: sentences of each (doc_id, text) under the rule, by brute force over all runs."""
    order = lambda row: (row[0], row[2])
    cut_ = lambda t: [t[a:b] for c in [substring_dedup.sentences(t)] for a, b in zip(c, c[1:])]
    places = collections.defaultdict(list)
    kept = {}
    for row in sorted({r for r in data if r[0] is not None}, key=order):
        parts = cut_(row[1] or "")
        kept[row] = [True] * len(parts)
        size = [len(p.split()) for p in parts]
        fits = lambda a, b: sum(size[a:b]) >= (substring_dedup.LONG_WORDS if b - a == 1 else substring_dedup.RUN_WORDS)  # noqa: B023, E731
        spans = {next(((a, b) for b in range(a + 1, len(parts) + 1) if fits(a, b)), None) for a in range(len(parts))}
        spans |= {next(((a, b) for a in range(b - 1, -1, -1) if fits(a, b)), None) for b in range(1, len(parts) + 1)}
        for a, b in sorted(spans - {None}):
            places[tuple("".join(parts[a:b]).lower().split())].append((row, a, b - a))
    for found in places.values():
        for row, k, n in found[1:]:
            kept[row][k : k + n] = [False] * n
    return {row: (row[1] if all(k) else "".join(p for p, ok in zip(cut_(row[1]), k) if ok).rstrip(), k.count(False)) for row, k in kept.items()}


def test_repeats_equal_brute_force(spark):
    r = random.Random(12)
    short = ["One two.", "Three, four five!", "Six?", "Seven eight nine ten.", "A b c d e f g.", prose(70, 8) + "!", prose(71, 30).replace(".", "") + "."]
    make = lambda: " ".join(r.choice(short) if r.random() < 0.4 else prose(r.randint(100, 10_000), 9) for _ in range(r.randint(0, 14)))
    texts = [make() for _ in range(40)]
    data = [(k % 33, t) for k, t in enumerate(texts)] + [(5, texts[5]), (50, None), (51, ""), (52, "x" * 100_000 + ". " + texts[1]), (53, "? ! .\n" * 30)]
    df = spark.createDataFrame([(*d, 7, 8, 9, "h", 1, 2) for d in data], "doc_id long, text string, done int, gone_spans int, n_removed int, `a.b` string, hash int, text_hash int")
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) as h", "count(*) over () as n").collect()
    want = collections.Counter()
    stays = plain_repeats([(x.doc_id, x.text, x.h) for x in hashed])
    for x in hashed:
        text, n = stays[x.doc_id, x.text, x.h]
        want[x.doc_id, text, n] += 1
    done = substring_dedup.without_repeats(df.repartition(3))
    assert done.columns == ["doc_id", "text", "done", "gone_spans", "a.b", "hash", "text_hash", "n_removed"]
    assert collections.Counter((x.doc_id, x.text, x.n_removed) for x in done.collect()) == want


def test_three_short_sentences_are_a_run(spark):
    three = "Keep off the grass here. Do not feed the old ducks. The gate shuts at six every day."
    docs = [(1, three + " " + prose(80)), (2, prose(81) + ". " + three)]
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1] and "ducks" not in got[2]


# --- lines


@pytest.mark.parametrize("few, block", [(100, 1024), (2, 3)])
def test_similar_lines(docs, none, spark, monkeypatch, few, block):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    lines = [prose(31, 12), prose(31, 12) + " extra", prose(31, 11) + " other", prose(32, 30), "a b c d", "a b c d e", "a b c", "", "a b c d"]
    r = random.Random(4)
    lines += [" ".join(w if k != j else f"edit{j}" for k, w in enumerate(lines[3].split())) for j in range(20)]
    long = [f"long{k}" for k in range(100)]
    lines += [" ".join(f"edit{j}" if k % 10 == j and k < 9 * j else w for k, w in enumerate(long[: 100 - 3 * j])) for j in range(10)]
    data = [(d % 27, "\n".join(r.choice(lines) for _ in range(r.randint(0, 6)))) for d in range(30)] + [(40, None), (None, lines[0]), (41, ("\n".join(lines[:9]) + "\n" + "w " * 300 + "\n") * 40)]
    data += [data[3], data[4]]
    extra = "n_lines int, n_links int, gone int, by_id int, `class` int, text_hash int, `a.b` int"
    df = spark.createDataFrame([(*d, *[1] * 7) for d in data], "doc_id long, text string, " + extra).repartition(3)
    hashed = {(x.doc_id, x.text): x.h for x in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    done = line_dedup.without_similar_lines(df)
    assert done.columns == ["doc_id", "gone", "by_id", "class", "text_hash", "a.b", "text", "n_lines", "n_removed", "n_links"]
    occ = [((d, hashed[d, t], i), t, frozenset(s.lower().split())) for d, t in set(data) if d is not None and t for i, s in enumerate(t.split("\n")) if s.split()]
    first = {}
    for place, _, s in sorted(occ):
        first.setdefault(s, place)
    alike = {s: [o for o in first if len(s & o) / len(s | o) >= 0.8] for s in first}
    gone = {place for place, _, s in occ if min(first[o] for o in alike[s]) < place}
    links, n_lines = collections.Counter(), collections.Counter()
    for place, _, s in occ:
        links[place[:2]] += len(alike[s]) - 1
        n_lines[place[:2]] += 1
    want = collections.Counter()
    for d, t in data:
        key = (d, hashed[d, t])
        stays = t and "\n".join(s for i, s in enumerate(t.split("\n")) if (*key, i) not in gone)
        want[d, stays, n_lines[key], sum(p[:2] == key for p in gone), links[key]] += 1
    assert collections.Counter((x.doc_id, x.text, x.n_lines, x.n_removed, x.n_links) for x in done.collect()) == want
    assert line_dedup.without_similar_lines(none).count() == 0
    assert line_dedup.without_similar_lines(docs).count() == len(rows())


def test_texts_under_one_id_keep_their_own_lines(spark):
    data = [(1, "a b c d e"), (2, "a b c d e"), (2, "other line here now ok")]
    got = line_dedup.without_similar_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e"), (2, ""), (2, "other line here now ok")]


# --- language


def plain_fusion(rows_, model):
    """language and confidence of rows (text, declared, suffix, host, site), with plain counts."""
    size = len(langid.LANGUAGES) + 1
    marks = []
    for text, *_ in rows_:
        hits = [h for h in langid.trigrams(text or "")]
        n, sums = sum(map(len, hits)), sum((model[h].sum(axis=0, dtype=float) for h in hits), np.zeros(size))
        marks.append((n, sums, int(sums.argmax())))
    whole = np.bincount([b for n, _, b in marks if n], minlength=size) + 1.0
    whole[-1] = 0
    whole = whole / whole.sum() * (1 - langid.UNKNOWN_PRIOR)
    whole[-1] = langid.UNKNOWN_PRIOR

    def counts(k, value, but):
        out = np.zeros(size)
        for i, (row, (n, _, b)) in enumerate(zip(rows_, marks)):
            if n and i != but and row[k] == value:
                out[b] += 1
        return out

    shares = lambda c, parent: (c + langid.STRENGTH * parent) / (c.sum() + langid.STRENGTH)
    out = []
    for i, (row, (n, sums, _)) in enumerate(zip(rows_, marks)):
        prior = whole
        for k in (4, 3):
            prior = shares(counts(k, row[k], i), prior) if row[k] is not None else prior
        score = sums * min(1.0, langid.EVIDENCE / max(n, 1)) + np.log(prior)
        for k in (1, 2):
            if row[k] is not None:
                ratio = np.log(shares(counts(k, row[k], i), whole) / whole)
                ratio[-1] = ratio[:-1].mean()
                score += ratio
        top = int(score.argmax())
        sure = 1 / np.exp(score - score[top]).sum() if n else 0.0
        out.append(((*langid.LANGUAGES, langid.UNKNOWN)[top] if n and sure >= langid.SURE else langid.UNKNOWN, sure))
    return out


def test_fusion_equals_brute_force(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    r = random.Random(3)
    texts = [(x.text[: r.choice((12, 40, 5000))] if x.text else x.text, x.lang) for x in docs.orderBy("doc_id").limit(60).collect()]
    texts += [(None, "en"), ("", "fr"), ("12 ## 34", "de"), ("zqxj vkwq xzzq qqxv wvkz xqzj kkqx zvvq", "en"), ("é", "fr"), texts[0], texts[0]]
    hosts = [(None, None), ("src0", None), ("www.a.com", "a.com"), ("b.a.com", "a.com"), ("x.co.uk", "x.co.uk"), ("y.co.uk", "y.co.uk")]
    data = []
    for text, lang in texts:
        host, site = r.choice(hosts)
        data.append((text, r.choice((None, lang, "en")), r.choice((None, lang, "fr")), host, site))
    want = plain_fusion(data, model)
    df = spark.createDataFrame([(k, 0, *d) for k, d in enumerate(data)], "id long, text_hash long, text string, declared string, suffix string, host string, n string").repartition(3)
    got = {x.id: x for x in langid.identify(df, model).collect()}
    assert len(got) == len(data)
    for k, (language, sure) in enumerate(want):
        assert got[k].language == language and abs(got[k].confidence - sure) < 1e-6 and got[k].kept == (language != "und")
    assert langid.documents_identified(spark, none).count() == 0


def test_language_of_documents_without_their_labels(spark):
    """Models learn one half of the documents; the other half's labels are only looked at afterwards."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.where("doc_id % 2 = 0").withColumn("lang", F.lit(None).cast("string"))
    truth = {x.doc_id: x.lang for x in docs.where("doc_id % 2 = 0").collect()}
    got = langid.identify(langid.of_documents(half), langid.train(docs.where("doc_id % 2 = 1"))).collect()
    assert sum(x.language == truth[x.id] for x in got) >= 0.97 * len(truth)


def test_language_of_pages(spark):
    got = queries.language_of_pages(spark, "/root/testdata/sf0.01").collect()
    pages = {x.page_id: x for x in langid.of_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).withColumnRenamed("id", "page_id").collect()}
    clear = [x for x in got if pages[x.page_id].declared is not None and pages[x.page_id].declared == pages[x.page_id].suffix]
    assert len(got) == len(pages) and len(clear) > 50
    assert sum(x.language == x.declared for x in clear) >= 0.95 * len(clear)


def test_evidence_of_pages(spark):
    page = "<html lang='de-AT'><head><style>p{}</style></head><body><p>Text &amp; mehr</p><script>var x='<p>';</script></body></html>"
    rows_ = [(1, "https://u@www.Example.co.at:80/fr/x?y", page), (2, None, None), (3, "no url", "<p>plain")]
    got = {r.id: r for r in langid.of_pages(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].suffix, got[1].host) == ("de", "fr", "www.example.co.at") and "var" not in got[1].text
    assert got[2].text is None and got[3].host is None
    assert langid.of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- neighbours


def test_nearest_is_exact_when_small(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(150, 8)).astype(np.float32)
    v[7] = v[3]
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(200, None, 0), (220, [0.0] * 8, 0), (240, [float("nan")] * 8, 0), (260, [None] + [1.0] * 7, 0), (140, v[140].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in ann.nearest(df).collect()}
    s = v.astype(float) @ v.astype(float).T
    for q in range(0, 150, 20):
        want = sorted((-s[q, j], j) for j in range(150) if j != q)[:20]
        assert [got[q, k + 1][0] for k in range(20)] == [j for _, j in want]
    assert len(got) == 8 * 20
    assert ann.nearest(df.limit(0)).count() == 0


def shares(df):
    """Copies of a vector, lists that a query reads, and the graph."""
    rows_ = ann.scaled(ann.usable(df)).cache()
    graph, largest = ann.index(rows_)
    placed = ann.posted(rows_, graph, largest).cache()
    many = lambda df: df.agg(F.avg(F.size("lists"))).first()[0]
    held = np.zeros(len(graph.points))
    for x in placed.select(F.explode("lists").alias("l")).groupBy("l").count().collect():
        held[x.l] = x["count"] * placed.count()
    held /= placed.agg(F.sum(F.size("lists"))).first()[0]
    return many(placed), many(ann.asked(rows_.where("vec_id % 20 = 0"), graph, largest, held, ann.K)), graph


def recall(v, got, k=20):
    ids = np.arange(0, len(v), 20)
    s = v[ids].astype(float) @ v.astype(float).T
    s[np.arange(len(ids)), ids] = -np.inf
    least = np.sort(s, axis=1)[:, -k]  # of equal scores any counts
    return np.mean([sum(s[n, j] >= least[n] - 1e-12 for j in got[i]) / k for n, i in enumerate(ids.tolist())])


@pytest.mark.parametrize("kind", [3, 6, 12, 20, 80, "skewed", "lognormal"])
def test_recall_of_tight_clusters(spark, kind):
    """Clusters smaller than what is asked for, clusters of very unlike sizes, and lengths of very unlike size."""
    r = np.random.default_rng(9)
    n = 6_000
    if kind == "lognormal":
        v = r.normal(size=(n, 32))
        v *= np.exp(r.normal(size=(n, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    else:
        of = np.minimum(r.zipf(1.3, n), 500) - 1 if kind == "skewed" else np.repeat(np.arange(-(-n // kind)), kind)[:n]
        v = r.normal(size=(int(of.max()) + 1, 32))[of] + (1e-3 if kind == 12 else 1e-2) * r.normal(size=(n, 32))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = r.permutation(v).astype(np.float32)
    got = collections.defaultdict(set)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    for x in ann.nearest(df).collect():
        got[x.query_id].add(x.vec_id)
    found = recall(v, got)
    print(kind, round(found, 4), [round(x, 2) for x in shares(df)[:2]])
    assert all(len(got[i]) == 20 for i in range(0, n, 20)) and found >= 0.93


def test_more_neighbours_than_usual(spark):
    v = np.random.default_rng(4).normal(size=(400, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for x in ann.nearest(df, k=50).collect():
        got[x.query_id].add(x.vec_id)
    assert all(len(x) == 50 for x in got.values()) and recall(v, got, 50) >= 0.9


def test_huge_vectors_and_odd_widths(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(300, 5))
    v[7] *= 1e160
    v[40] *= 1e-200
    odd = [(1000, [1.0, 2.0]), (1020, [5.0] * 9), (1040, [1e300, 1e300, 0.0, 0.0, 0.0]), (1060, [-1e300, 1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in sorted(ann.nearest(df).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    whole = dict(enumerate(v)) | {k: np.array(x) for k, x in odd if len(x) == 5}
    assert set(got) == {k for k in whole if k % 20 == 0} and all(len(x) == 20 for x in got.values())
    with np.errstate(over="ignore", invalid="ignore"):
        for q, found in got.items():
            scores = sorted(((-np.add.accumulate(whole[j] * whole[q])[-1], j) for j in whole if j != q), key=lambda x: (np.isnan(x[0]), x))
            assert [(j, -s) for s, j in scores[:20]] == found


def test_blocks_follow_the_vectors():
    counts = np.full(1000, 100)
    counts[500] = 5 * ann.BLOCK + 1
    b = ann.Blocks(counts)
    of = b.of(np.arange(1000))
    held = np.bincount(of, counts) / b.slices
    assert held.max() <= ann.BLOCK and (np.diff(of) >= 0).all() and b.slices[of[500]] == 6 and b.slices.sum() == len(b.slices) + 5
    assert len(ann.Blocks(np.full(100_000, 100)).starts) == pytest.approx(100_000 * 100 / ann.BLOCK, rel=0.1)


@pytest.mark.parametrize("kind", ["clusters", "even", "lengths"])
def test_recall(spark, kind):
    """Against brute force, with the share of lists that queries read and of copies in lists."""
    r = np.random.default_rng(8)
    v = r.normal(size=(12_000, 32))
    if kind == "clusters":
        v = r.normal(size=(150, 32))[r.integers(0, 150, len(v))] + 0.25 * v
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= r.uniform(0.5, 1.5, size=(len(v), 1))
    v = v.astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(set)
    for x in ann.nearest(df).collect():
        got[x.query_id].add(x.vec_id)
    ids = np.arange(0, len(v), 20)
    s = v[ids].astype(float) @ v.astype(float).T
    s[np.arange(len(ids)), ids] = -np.inf
    top = np.argpartition(-s, 20, axis=1)[:, :20]
    assert sum(len(got[i] & set(t.tolist())) for i, t in zip(ids.tolist(), top)) / top.size >= 0.9
    posted, read, graph = shares(df)
    assert len(graph.points) >= len(v) / ann.LIST and posted > 1.2
    assert read / len(graph.points) < {"clusters": 0.1, "even": 0.3, "lengths": 0.7}[kind]


def test_repeated_ids_are_one_candidate(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.4]), (2, [0.1, 0.0])]
    got = ann.nearest(spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<double>, query_id int")).collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in sorted(got, key=lambda x: x["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.1)]


# --- chat


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"a","name":"reply","arguments":{"turn":1,"prompt":"x"}},{"id":"b","name":"reply","arguments":"{\\"prompt\\":2}","after":["a","zz"]},{"id":"a","name":"none","arguments":[]}]}'
    data = [(1, 0, "system", "be kind"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"a":[2]}}'), (1, 3, "tool", '{"tool_call_id":"a","content":null}'), (1, 4, "tool", '{"tool_call_id":"q","content":"é"}'), (1, 5, "assistant", "{broken"), (2, 0, "user", None), (None, None, "user", "")]
    got = chat.linked(spark.createDataFrame([(*d, 9) for d in data], "conv_id long, turn long, role string, text string, position int"), chat.REPLY).orderBy("conv_id", "position").collect()
    by = {(r.conv_id, r.position): r for r in got}
    assert [by[1, k].kind for k in range(7)] == ["message", "call", "call", "call", "result", "result", "message"]
    a, b, again = by[1, 1], by[1, 2], by[1, 3]
    assert a.linked and a.errors == "" and a.json == '{"arguments":{"prompt":"x","turn":1},"id":"a","name":"reply","result":{"a":[2],"z":1}}'
    assert not b.linked and "prompt is not string" in b.errors and "turn is missing" in b.errors and "after zz is no call" in b.errors and "after a " not in b.errors
    assert "unknown tool" in again.errors and "identifier comes again" in again.errors
    assert {r.errors for r in got if r.kind == "result"} == {"second result", "no such call"}
    assert len(got) == 9
    assert chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), chat.REPLY).count() == 0


def calls(*made):
    import json

    return json.dumps({"tool_calls": list(made)})


def call(id_, *after, **arguments):
    return {"id": id_, "name": "reply", "arguments": arguments or {"prompt": "x", "turn": 1}, "after": list(after)}


def placed(spark, data, schemas=chat.REPLY):
    got = chat.linked(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3), schemas)
    return sorted(got.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.position))


def test_two_results_in_one_turn(spark):
    data = [(1, 0, "assistant", calls(call("a"))), (1, 1, "tool", '{"tool_call_id":"a","content":2}'), (1, 1, "tool", '{"tool_call_id":"a","content":1}'), (1, 1, "tool", '{"tool_call_id":"a","content":1}')]
    got = placed(spark, data)
    assert [(r.kind, r.linked) for r in got] == [("call", True), ("result", False), ("result", False)] and '"result":1' in got[0].json
    assert {(r.json, r.errors) for r in got[1:]} == {('{"id":"a","result":1}', "second result"), ('{"id":"a","result":2}', "second result")}


def test_calls_come_after_what_they_need(spark):
    data = [(1, 0, "assistant", calls(call("a", "d"), call("b"))), (1, 1, "assistant", calls(call("c", "a"))), (1, 2, "user", "hm"), (1, 3, "assistant", calls(call("d", "b"), call("e", "c", "d"))), (1, 4, "assistant", calls(call("f", "g"))), (1, 5, "assistant", calls(call("g", "f"), call("h", "h"), call("i", "zz", None)))]
    got = placed(spark, data)
    at = {r.call_id: r.position for r in got if r.kind == "call"}
    assert [r.call_id for r in got if r.kind == "call"][:5] == ["b", "d", "a", "c", "e"]
    assert at["d"] < at["a"] < at["c"] < at["e"] and [r.position for r in got] == list(range(10))
    wrong = {r.call_id: r.errors for r in got if r.errors}
    assert wrong == {"f": "after goes round", "g": "after goes round", "h": "after goes round", "i": "after null is no call; after zz is no call"}


def test_errors_of_calls_without_a_turn(spark):
    got = placed(spark, [(1, None, "assistant", calls(call("a", "q"))), (1, 2, "assistant", calls(call("b", "a")))])
    assert [(r.call_id, r.errors) for r in got] == [("a", "after q is no call"), ("b", "")]


def test_nested_schemas(spark):
    schema = {"type": "object", "required": ["n", "a.b"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "a.b": {"enum": ["x", 2]}, "list": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]}}, "o": {"type": "object", "properties": {"deep": {"type": "boolean"}}}}}
    good = {"n": 10**25, "a.b": 2, "list": [{"k": "v"}], "o": {"deep": True, "other": 1}}
    bad = {"n": 1.5, "a.b": "y", "list": [{"k": 1}, {}, 3], "o": {"deep": 0}, "more": None}
    got = placed(spark, [(1, 0, "assistant", calls(call("a", **good))), (1, 1, "assistant", calls(call("b", **bad))), (1, 2, "assistant", calls({"id": "c", "name": "reply", "arguments": {"n": 2.0}}))], {"reply": schema})
    assert got[0].errors == "" and '"n":10000000000000000000000000' in got[0].json
    assert set(got[1].errors.split("; ")) == {"n is not integer", "a.b is not one of the values", "list[].k is not string", "list[].k is missing", "list[] is not object", "o.deep is not boolean", "more is not known"}
    assert got[2].errors == "a.b is missing"


def test_conversations_of_many_equal_rows(spark):
    data = [(1, None, "user", "same")] * 500 + [(1, 5, "user", f"x{k}") for k in range(300)] + [(None, 1, "user", "y")] * 3
    got = placed(spark, data)
    assert [r.position for r in got if r.conv_id == 1] == list(range(800)) and sorted(r.position for r in got if r.conv_id is None) == [0, 1, 2]
