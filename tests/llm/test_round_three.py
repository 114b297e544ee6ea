"""Repair of conversations, decontamination and lexical search against brute force, on odd rows and in small blocks."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cullspark.llm import chat, decontaminate, lexical, repair, warc, wordbytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- repair of conversations


def best_edits(rows):
    """Cost, letters and lines of the cheapest edits of (role, text, kind), by the best of all letters for each rest of the rows."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    put = (2, 2, 3, 2)
    name = {2: "user", 3: "assistant"}
    after = {s: (0, "", ()) if s in (0, 3) else None for s in range(4)}

    def with_inserts(best):
        for _ in range(3):
            for s in range(4):
                rest = best[put[s]]
                if rest is not None:
                    made = (rest[0] + 3, "I" + rest[1], (name[put[s]] + ":", *rest[2]))
                    if best[s] is None or made[:2] < best[s][:2]:
                        best[s] = made
        return best

    after = with_inserts(after)
    for role, text, kind in reversed(rows):
        here = {}
        for s in range(4):
            rest = after[s]
            options = [(rest[0] + 4, "D" + rest[1], rest[2])]
            if kind not in ("blank", "duplicate"):
                late = 3 if kind == "truncated" else 0
                to = follow.get(role[:1], {}).get(s)
                if to is not None:
                    rest = after[to]
                    options.append((rest[0] + late, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                rest = after[put[s]]
                options.append((rest[0] + 3 + late, "R" + rest[1], (f"{name[put[s]]}:{text}", *rest[2])))
            here[s] = min(options)
        after = with_inserts(here)
    return after[0]


def plain_repair(data):
    out = {}
    for conv in {r[0] for r in data}:
        rows = sorted(((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ", r[1]) for r in data if r[0] == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text, _ in rows:
            end = text.rstrip(" \t\n\v\f\r")
            judged.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {r[4] for r in rows} - {None}
        cost, letters, lines = best_edits(judged)
        count = Counter(k for *_, k in judged)
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], odd, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, conv int, `at` string, _same int"


def talk(seed, conv, n):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "user2"]
    texts = ["Yes.", "no", "", " \n", "What?  ", None, "\x1c", "Well!\v", "é…", "Yes. "]
    return [(conv, None if r.random() < 0.1 else k // r.choice([1, 2]), r.choices(roles, [2, 6, 6, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.6 else f"Row {k}.", 1, "x", 2) for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_equals_brute_force(spark, block):
    data = [x for c in range(25) for x in talk(c, c, c)] + talk(99, None, 7) + talk(98, 50, 150) + [(60, 0, "user", "x" * 300_000 + ".", 1, "x", 2), (60, 1, "system", "Be good.", 1, "x", 2)] * 2
    got = repair.audited(spark.createDataFrame(data, CONVERSATIONS).repartition(3), block).collect()
    assert len(got) == len({r[0] for r in data})
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_repair(data)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.audited(none).count() == 0
    one = spark.createDataFrame([(7, 0, "user", "Hi.", 1, "x", 2)], CONVERSATIONS)
    got = repair.audited(none, of=one).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage_follows_the_hash(spark):
    import zlib

    data = [(c, t, "assistant", "One. Two! Three?", 1, "x", 2) for c in range(20) for t in range(10)] + [(None, None, None, None, 1, "x", 2)]
    got = Counter(tuple(r) for r in repair.damaged(spark.createDataFrame(data, CONVERSATIONS)).collect())
    want = Counter()
    for c, t, role, text, *_ in data:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            want[(c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] += 2 if hit == 3 else 1
    assert got == want


# --- decontamination


def plain_hits(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def planted(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "the", "İk", "日本", "x1", "of"]) if r.random() < 0.5 else f"w{r.randint(0, 400)}"
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 4, 5, 7, 9, 10, 11, 30])))) for k in range(40)]
    items += [(None, "Null's own item, of ten words and two more than that."), (3, items[20][1]), (900, None), (901, ",.;"), (902, items[7][1]), (903, "same " * 25)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            passage = WORD.findall(low(r.choice(items)[1]))
            a = r.randint(0, max(0, len(passage) - 10))
            words[len(words) // 2 : len(words) // 2] = [w.upper() if w.isascii() else w for w in passage[a : a + r.randint(8, 30)]]
        docs.append((k, r.choice([" ", "-", "\n", "\0"]).join(words)))
    docs += [docs[3], (None, docs[4][1]), (None, None), (70, ""), (71, "same " * 300), (72, "b" * 2_500_000 + " " + items[20][1] + " " + "c d " * 400_000), (3, "another text under the id")]
    return docs, items


@pytest.mark.parametrize("bits", [27, 15])
def test_contamination_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    docs, items = planted()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, window string").repartition(3)
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, `set` string").repartition(2)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contaminated(d, i).collect())
    assert got == plain_hits(docs, items)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0
    got = decontaminate.contaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items.where("item_id > 1")).collect()
    assert [tuple(r) for r in got] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_shared_spans_share_a_fingerprint():
    r = np.random.default_rng(3)
    for n in (1, 3, 5, 8, 10):
        shared = r.integers(0, 5, n).astype(np.uint64)
        a, b = (np.concatenate((r.integers(0, 5, 20).astype(np.uint64), shared, r.integers(0, 5, 20).astype(np.uint64))) for _ in "ab")
        kept = [decontaminate.fingerprints(x, np.zeros(len(x), int), n)[0][20] for x in (a, b)]
        assert kept[0] == kept[1] == decontaminate.fingerprints(shared, np.zeros(n, int), n)[0][0]


def test_words_in_steps(monkeypatch):
    texts = ["One-two  THREE", None, "", "é" * 50 + "_Ab9", "x" * 100, "日本 語\0z"]
    whole = wordbytes.words(wordbytes.joined(texts)[0])
    monkeypatch.setattr(wordbytes, "STEP", 7)
    buffer, begins = wordbytes.joined(texts)
    lower, starts, ends, hashes = wordbytes.words(buffer)
    assert [lower[s:e].decode() for s, e in zip(starts, ends)] == [w for t in texts for w in WORD.findall(low(t))]
    assert (hashes == whole[3]).all() and len(set(hashes.tolist())) == len(hashes)


# --- lexical search


def plain_search(docs, items):
    counted = [(d, Counter(WORD.findall(low(t)))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_all, length, df = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 25 + (75 * n * n_all) // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in WORD.findall(low(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(str(item), k + 1, str(x[3]), -x[0]) for k, x in enumerate(sorted(scores)[:10])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts, chunks, shards and batches of queries
        for name, value in (("PART", 16), ("POSTINGS", 400), ("SHARD", 4), ("FIRST", 2), ("SECOND", 3), ("PAIRS", 60), ("SAMPLE", 50)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = planted(8)
    r = random.Random(2)
    docs += [(200 + k, " ".join(f"t{r.randint(0, 3)}x{r.randint(0, 60) ** 2}" for _ in range(40))) for k in range(150)] + [(500 + k, "Tie words here") for k in range(14)]
    items += [(800, "tie WORDS words"), (801, docs[-20][1]), (801, docs[-20][1]), (None, "t1x4 t2x9 the the")]
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, chunk string, n int").repartition(3)
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, query string").repartition(2)
    got = sorted((str(x.item_id), x.rank, str(x.doc_id), x.score) for x in lexical.search(lexical.build(d), i).collect())
    assert got == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ",!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "item_id long, text string")
    got = lexical.search(lexical.build(docs), items).collect()
    assert [(str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got] == plain_search([(1, "a b")], [(1, "a")]) != []
    assert lexical.search(lexical.build(docs.where("doc_id > 5")), items).count() == 0
    assert lexical.search(lexical.build(docs), items.where("item_id > 5")).count() == 0


def test_bisection_brings_alike_documents_together():
    r = np.random.default_rng(1)
    kind = r.permutation(np.repeat(np.arange(4), 64))
    terms = [np.unique(k * 50 + r.integers(0, 50, 30)) for k in kind]
    doc, term = np.repeat(np.arange(256), [len(t) for t in terms]), np.concatenate(terms)
    path = lexical.bisected(doc, term, 256, 200, 2, rounds=20)
    assert (np.bincount(path) == 64).all()
    assert np.mean([np.bincount(kind[path == p]).max() / 64 for p in range(4)]) > 0.9


# --- packages of others, and blanks before calls


def test_packages_of_others(spark, tmp_path):
    """Several archives and indexes under other names, offsets as texts or numbers, records by other writers."""
    import gzip
    import json
    import zipfile

    def rec(kind, body, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": str(len(body))} | more
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    one = [gzip.compress(rec("response", http + b"first", **{"WARC-Target-URI": "http://a.example/"})), gzip.compress(rec("metadata", b"plain words"))]
    two = [rec("response", http + b"second"), rec("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", **{"WARC-Payload-Digest": "sha256:aa"}), rec("revisit", b"", **{"warc-payload-digest": "sha1:XX"})]
    lines = [f'example,a)/ 2001 {json.dumps({"url": "http://a.example/", "filename": "rec-1.warc.gz", "offset": "0", "length": str(len(one[0]))})}', f'x) 2001 {json.dumps({"filename": "rec-1.warc.gz", "offset": len(one[0]), "length": len(one[1]), "id": "text"})}', "!meta 0 no object", 'y) 1 {"filename": "gone.warc.gz", "offset": 0, "length": 3}', 'y) 1 {"filename": "rec-1.warc.gz", "offset": 0, "length": 99999}']
    at, more = 0, []
    for r in two:
        more.append(json.dumps({"filename": "sub/b.WARC", "offset": at, "length": len(r)}))
        at += len(r)
    path = str(tmp_path / "p.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/rec-1.warc.gz", b"".join(one))
        z.writestr("archive/sub/b.WARC", b"".join(two))
        z.writestr("indexes/index.cdxj", "\n".join(lines))
        z.writestr("indexes/more.cdx", "\n".join(more) + "\n")
        z.writestr(zipfile.ZipInfo("indexes/packed.cdxj"), "x" * 1000, zipfile.ZIP_DEFLATED)
    places = warc.index(spark.createDataFrame([(f"file://{path}", 5)], "path string, records long"))
    assert places.count() == 5 and places.where("page_id is not null").count() == 0
    got = [(r.record_type, r.payload_bytes if r.payload_bytes is not None else -1, r.payload_digest, r.url, bytes(r.payload or b"")) for r in warc.read_records(places, payload=True).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(got, key=str) == sorted([("response", 5, sha(b"first"), "http://a.example/", b"first"), ("metadata", 11, sha(b"plain words"), None, b"plain words"), ("response", 6, sha(b"second"), None, b"second"), ("revisit", 7, "aa", None, b""), ("revisit", -1, "sha1:XX", None, b"")], key=str)


def test_keys_of_an_index():
    assert warc.key_of("HTTPS://www.Example.org/A b?q=1") == "org,example,www)/a%20b?q=1"
    assert warc.key_of(None) == ")/" and warc.key_of("http://[broken") == ")http://[broken"


def test_blanks_before_calls(spark):
    call = ' \n\t{"tool_calls": [{"id": "a", "name": "reply", "arguments": {"turn": 1, "prompt": "x"}}]}'
    data = [(1, 0, "assistant", call), (1, 1, "tool", '\r\n {"tool_call_id": "a", "content": "y"}'), (1, 2, "assistant", " [1]"), (1, 3, "assistant", " {broken")]
    got = {r.turn: (r.kind, r.linked, r.errors) for r in chat.linked(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), chat.REPLY).collect()}
    assert got == {0: ("call", True, ""), 2: ("message", False, ""), 3: ("message", False, "")}
