"""Line dedup by an exact set-similarity join of lines.

Lines are sets of lower-cased words, ordered by rarity (counts of the whole corpus in hashed buckets, so
that the table has a fixed size; any order common to all lines gives exact results). Of two sets of
Jaccard similarity t, the one of n words that is shorter and the longer one of m share a word among the
first n - ceil(2t / (1 + t) n) + 1 of the former and the first m - ceil(t m) + 1 of the latter. Lines are
dealt by these prefix words and sorted by length there, so that a line meets only those of fitting length
behind it; the positional filter and a bound of the overlap from 64 parities follow, and what is left
is verified on the lines themselves. Lines with equal sets are one class throughout, and a line goes if
its class, or one linked to it, has an earlier line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, forget, is_row, keyed
from .minhash import GOLD, U, _mix

SIMILAR = 0.8
#: Columns that say where a line stands, in order.
PLACE = ["doc_id", "text_hash", "line"]
#: Buckets of the rarity table, a number each.
BUCKETS = 1 << 18
#: Numbers of the rarity table that are added up together.
COUNTS = 256
CHARS_AT_ONCE = 1 << 18
#: Where a prefix word has more lines than this in two neighbouring grades of length, they are compared in blocks
#: of so many lines, and their links are counted, not listed.
FEW, BLOCK = 500, 1024
PAIRS_AT_ONCE = 1 << 20
#: Words of lines are dealt in buckets of about BUCKET, packed from POSTS_AT_ONCE or more together.
BUCKET, POSTS_AT_ONCE = 1 << 17, 1 << 19
#: Lines of more words than this have 128 parities.
LONG = 80
#: Bits of the filter of places: 16 a place, up to so many; beyond, more lines pass it, which a join drops.
FILTER_BITS = 1 << 26


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[str]]]:
    """Ids, text hashes and texts in groups of about CHARS_AT_ONCE."""
    ids, hashes, texts, size = [], [], [], 0
    for batch in rows:
        for doc, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc)
            hashes.append(hashed)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CHARS_AT_ONCE:
                yield ids, hashes, texts
                ids, hashes, texts, size = [], [], [], 0
    if ids:
        yield ids, hashes, texts


#: Beginnings of UTF-8 white space beside the ASCII ones; where they occur, words are parted by str.split first.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


#: What is left of eight bytes (the first is the lowest) when the first 0 to 8 are kept.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word up to which the words of a text are hashed together.
WORD = 64


def _hashes(data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of so many bytes that start at first: eight bytes of all words at once."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    out = size.astype(np.uint64) * GOLD
    on, at, left = slice(None), first, size
    for _ in range(WORD // 8):
        out[on] = _mix(out[on] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        on = more if isinstance(on, slice) else on[more]
        at, left = at[more] + 8, left[more] - 8
    for k in on.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : first[k] + size[k]], digest_size=8).digest(), "little")
    return out


def _tokens(text: str, numbered: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Line number (if numbered) and 64-bit hash of each lower-cased word of a text; only words of over WORD bytes are handled alone."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    wide = not low.isascii() and ((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3)).any() and any(w in data for w in _WIDE)
    if wide or np.count_nonzero(raw < 32) > data.count(b"\n"):
        data = "\n".join([" ".join(x.split()) for x in low.split("\n")]).encode("utf-8", "replace")
        raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw <= 32)  # no other ones are left
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    on = last > first
    first, last = first[on], last[on]
    line = np.searchsorted(gaps[raw[gaps] == 10], first) if numbered else None
    return line, _hashes(data, first, last - first)


def _sets(text: str, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and each distinct word of each line, sorted by both. rare: the rarity bits of each bucket.

    A word is a number: 8 bits of rarity above 56 of its hash, so that its order is that of rarity.
    """
    line, hashed = _tokens(text)
    word = rare[_bucket(hashed)] | (hashed >> U(8))
    order = _order(line, word)
    line, word = line[order], word[order]
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
    return line[first], word[first]


def _order(line: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by line, then word: one sort of 64-bit keys, unless a word's first bits don't tell it from another."""
    if len(line) and line[-1] < 1 << 20:
        key = (line.astype(np.uint64) << U(44)) | (word >> U(20))
        order = np.argsort(key)
        key, sorted_ = key[order], word[order]
        if not ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.lexsort((word, line))


def _rarity_bits(count: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(count.astype(np.float32) + 1), 255).astype(np.uint64)


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U(46)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """How often words of each bucket occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        held: list[np.ndarray] = []
        for _, _, texts in _batches(batches):
            held.append(_bucket(_tokens("\n".join(texts), False)[1]).astype(np.int32))
            if sum(map(len, held)) > BUCKETS:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held = []
        total += np.bincount(np.concatenate(held) if held else np.zeros(0, np.int32), minlength=BUCKETS)
        yield _counted({k: row for k, row in enumerate(total.reshape(-1, COUNTS)) if row.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns)):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        yield _counted(total)

    kind = "block long, n binary"
    rows = keyed(docs).mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect()
    out = np.zeros((BUCKETS // COUNTS, COUNTS), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.n, np.int64)
    return out.reshape(-1)


def _counted(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([n.tobytes() for n in blocks.values()], pa.binary())], ["block", "n"])


def least_shared(n, share: float = SIMILAR):
    """The words that a set of n must share with a partner at least; the prefix filter leaves out one less."""
    return np.ceil(np.round(share * n, 6)).astype(np.int64)


def _indexed(n: np.ndarray) -> np.ndarray:
    """Length of the prefix in which a set meets longer ones."""
    return n - least_shared(n, 2 * SIMILAR / (1 + SIMILAR)) + 1


def _starts(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's words start, and how many it has."""
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return start, np.diff(np.append(start, len(line)))


def _classes(word: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _mix(np.add.reduceat(_mix(word), start) + n.astype(np.uint64)).view(np.int64)


def lines(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Lines with words: doc_id, text_hash, line, of (such lines of the text), class (hash of the set), n words, parities, and the prefix by rarity.

    Bit b of parities says whether the words that hash to b are odd in number, so that two sets differ in
    as many words at least as their parities do in bits. calm: so many words of the prefix, its first ones,
    occur too seldom in the corpus to be in many lines. more: in long lines, the parities of one half of
    the words, so that two long lines have twice as many.
    """
    shared, few = docs.sparkSession.sparkContext.broadcast(_rarity_bits(counts) << U(56)), _rarity_bits(np.array([FEW]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for ids, hashes, texts in _batches(batches):
            line, word = _sets("\n".join(texts), count)
            if not len(line):
                continue
            start, n = _starts(line)
            parities = np.bitwise_xor.reduceat(U(1) << (word & U(63)), start).view(np.int64)
            half = np.bitwise_xor.reduceat(((word >> U(6)) & U(1)) << (word & U(63)), start).view(np.int64)
            keep = np.where(n < 4, 0, n - least_shared(n) + 1)  # sets of up to three words match only themselves
            inside = np.arange(len(line)) - np.repeat(start, n) < np.repeat(keep, n)
            calm = np.add.reduceat((inside & (word >> U(56) <= few)).astype(np.int64), start)
            text, number = _ranges(np.array([t.count("\n") + 1 for t in texts]))
            text, number = text[line[start]], number[line[start]]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(word[inside].view(np.int64)))
            columns = {"doc_id": np.array(ids, np.int64)[text], "text_hash": np.array(hashes, np.int64)[text], "line": number.astype(np.int32), "of": np.bincount(text, minlength=len(texts))[text].astype(np.int32), "class": _classes(word, start, n), "n": n.astype(np.int32), "parities": parities, "more": np.where(n > LONG, half, 0), "calm": calm.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), prefix], [*columns, "prefix"])

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, line int, of int, class long, n int, parities long, more long, calm int, prefix array<long>")


def grade(n: Column) -> Column:
    """Lengths by powers of 1 / SIMILAR: a line's partners that are shorter are in its own grade or the one below."""
    return F.floor(F.log(n) / F.log(F.lit(1 / SIMILAR))).cast("int")


def _ranges(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, i repeated length[i] times, and 0 to length[i] - 1."""
    return np.repeat(np.arange(len(length)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _by_word(word: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by word, n and kind of the rows whose word others have too, and the words' numbers in that order."""
    order = np.argsort(word)
    change = np.flatnonzero(np.diff(word[order])) + 1
    size = np.diff(np.concatenate([[0], change, [len(word)]]))
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    of, n, kind = np.repeat(np.arange(len(size)), size), n[order], kind[order]
    if len(of) and len(size) < 1 << 20 and n.max() < 1 << 16:  # one sort of 64-bit keys, unless a class's first bits don't tell it from another
        key = (of.astype(np.uint64) << U(44)) | (n.astype(np.uint64) << U(28)) | (kind.view(np.uint64) ^ U(1 << 63)) >> U(36)
        again = np.argsort(key)
        key, told = key[again], kind[again]
        if not ((key[1:] == key[:-1]) & (told[1:] != told[:-1])).any():
            return order[again], of
    return order[np.lexsort((kind, n, of))], of


def _met(word, before, kind, n, at, parities, more, hots, hot) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of whole words' rows that pass the filters.

    before: the word before in the line, or 0 if that has many lines. A pair that has the same one has met there and passed.
    """
    order, of = _by_word(word, n, kind)
    if not len(order):
        return
    before, kind, n, at, parities, more, hots, hot = (c[order] for c in (before, kind, n, at, parities, more, hots, hot))
    wide = np.int64(n.max()) * 2 + 2
    place = of * wide + n
    most = np.floor(n / SIMILAR + 1e-9).astype(np.int64)
    meets = np.searchsorted(place, of * wide + most, "right") - np.arange(len(n)) - 1
    meets = np.where((at < _indexed(n)) & ~hot, meets, 0)
    done = np.cumsum(meets)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(PAIRS_AT_ONCE, done[-1], PAIRS_AT_ONCE)) + 1, [len(n)]]))
    for low, high in zip(cuts[:-1], cuts[1:]):
        y, step = _ranges(meets[low:high])
        y += low
        x = y + 1 + step
        new = (before[y] != before[x]) | (before[y] == 0)
        y, x = y[new], x[new]
        need = least_shared(n[y] + n[x], SIMILAR / (1 + SIMILAR))
        # words shared before the first one that this join sees are of many lines: no more than hots
        all_, half = parities[y] ^ parities[x], np.where(n[y] > LONG, more[y] ^ more[x], 0)
        fits = (n[y] + n[x] - _bits(all_ ^ half) - _bits(half) >= 2 * need) & (np.minimum(n[y] - at[y], n[x] - at[x]) + hots[y] >= need)
        yield kind[y[fits]], kind[x[fits]]


#: Words of lines by bucket: numbers of 64 bits in a row, two (length and place, marks; parities, more) in the last two columns.
_DEALT = "bucket long, word binary, before binary, class binary, place binary, parities binary"


def _gathered(batches: Iterator[pa.RecordBatch], size) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of POSTS_AT_ONCE words, by size."""
    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += size(batch)
        if words >= POSTS_AT_ONCE:
            yield held
            held, words = [], 0
    if words:
        yield held


def _blocks(buckets: int, word: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows packed by bucket of their words."""
    bucket = (word.view(np.uint64) & U((1 << 56) - 1)) % U(buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    start, _ = _starts(bucket[order])
    ends = np.concatenate([start, [len(word)]])

    def block(x: np.ndarray) -> pa.Array:
        offsets = (ends * (x.nbytes // len(word))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[order]))])

    return pa.RecordBatch.from_arrays([pa.array(bucket[order][start].view(np.int64)), block(word), *map(block, columns.values())], ["bucket", "word", *columns])


def _packed(buckets: int, word, before, kind, n, at, hots, hot, parities, more) -> pa.RecordBatch:
    """Words of lines packed by bucket."""
    place, parities = np.stack([n.astype(np.int64) << 32 | at, hots.astype(np.int64) << 1 | hot], axis=1), np.stack([parities, more], axis=1)
    return _blocks(buckets, word, **{"before": before, "class": kind, "place": place, "parities": parities})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket from rows sorted by bucket; one may go on in the next batch."""
    now, held = None, []
    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != now and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            now = bucket
            held.append([np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in range(1, batch.num_columns)])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _posts(lines: DataFrame) -> DataFrame:
    return lines.select("class", "n", "parities", "more", "calm", grade(F.col("n")).alias("grade"), "prefix")


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of lines of _posts, and line, place and number of each word of theirs."""
    for held in _gathered(batches, lambda b: len(b.column(6).flatten())):
        words = [b.column(6) for b in held]
        of, at = _ranges(np.concatenate([w.value_lengths().to_numpy(zero_copy_only=False) for w in words]))
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(6)]
        yield columns, of, at, np.concatenate([w.flatten().to_numpy() for w in words])


def _summed(word: np.ndarray, of_grade: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((of_grade, word))
    word, of_grade, c = word[order], of_grade[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (of_grade[1:] != of_grade[:-1])]))
    return word[start], of_grade[start], np.add.reduceat(c, start)


def _hot_words(lines: DataFrame, buckets: int) -> DataFrame:
    """word, grade and c, the lines with it in this grade and the next, where they are more than FEW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, _, calm, grades), of, at, word in _unfolded(batches):
            on = at >= calm[of]  # a word that is in few lines of the corpus is in few of any grade
            if on.any():
                word, grades, c = _summed(word[on], grades[of[on]].astype(np.int64), np.ones(on.sum(), np.int64))
                yield _blocks(buckets, word, grade=grades, c=c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, grades, c in _buckets(batches):
            word, grades, c = _summed(np.tile(word, 2), np.concatenate([grades, grades - 1]), np.tile(c, 2))
            many = c > FEW
            yield pa.RecordBatch.from_arrays([pa.array(word[many]), pa.array(grades[many].astype(np.int32)), pa.array(c[many])], ["word", "grade", "c"])

    rows = _posts(lines.where(F.size("prefix") > F.col("calm"))).mapInArrow(run, "bucket long, word binary, grade binary, c binary")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "word long, grade int, c long")


def _among(word: np.ndarray, of_grade: np.ndarray, words: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which (word, of_grade) are among (words, grades)."""
    known = np.unique(words)
    if not len(known):
        return np.zeros(len(word), bool)
    pairs = np.unique(np.searchsorted(known, words) << 12 | grades + 2)
    k = np.minimum(np.searchsorted(known, word), len(known) - 1)
    pair = k << 12 | of_grade + 2
    return (known[k] == word) & (pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair)


def _calm(lines: DataFrame, buckets: int, hot=None) -> DataFrame:
    """The calm words of lines' prefixes by bucket; with hot, a broadcast of words and grades, all words that have few lines in some grade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, n, parities, more, calm, grades), of, at, word in _unfolded(batches):
            hots = at - calm[of]
            on, marked, many = hots < 0, np.zeros(len(word), bool), np.zeros(len(word), bool)
            if hot is not None:
                warm = np.flatnonzero(~on)
                marked[warm] = _among(word[warm], grades[of[warm]], *hot.value)
                below = _among(word[warm], grades[of[warm]] - 1, *hot.value)
                many[warm] = marked[warm] | below
                on[warm] = ~(marked[warm] & below)
            before = np.where((at == 0) | np.concatenate([[False], many[:-1]]), 0, np.concatenate([[0], word[:-1]]))
            if on.any():
                of = of[on]
                yield _packed(buckets, word[on], before[on], kind[of], n[of], at[on], np.maximum(hots[on], 0), marked[on], parities[of], more[of])

    return _posts(lines).mapInArrow(run, _DEALT)


def _with_hot(lines: DataFrame, hot) -> DataFrame:
    """class of lines with words of many lines in their grade and the next or the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _, _, _, calm, grades), of, at, word in _unfolded(batches):
            on = at >= calm[of]
            of, word = of[on], word[on]
            yield pa.RecordBatch.from_arrays([pa.array(kind[np.unique(of[_among(word, grades[of], *hot.value) | _among(word, grades[of] - 1, *hot.value)])])], ["class"])

    return _posts(lines.where(F.size("prefix") > F.col("calm"))).mapInArrow(run, "class long")


def _warm(cold: DataFrame, buckets: int) -> DataFrame:
    """Rows of words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, lambda b: b.num_rows):
            word, kind, n, at, parities, more, hots, hot = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(8))
            yield _packed(buckets, word, np.zeros(len(word), np.int64), kind, n, at, hots, hot, parities, more)

    return cold.select("word", "class", "n", "at", "parities", "more", "hots", "hot").mapInArrow(run, _DEALT)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) from rows sorted by bucket."""
    for word, before, kind, place, parities in _buckets(batches):
        (where, marks), (parities, more) = place.reshape(-1, 2).T, parities.reshape(-1, 2).T
        for a, b in _met(word, before, kind, where >> 32, where & 0xFFFFFFFF, parities, more, marks >> 1, (marks & 1).astype(bool)):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _candidates(cold: DataFrame | None, lines: DataFrame | None = None, buckets: int = 1, hot=None) -> DataFrame:
    """Pairs of classes (a, b) that meet in a word of few lines: a row of cold or a word of lines, see _calm."""
    # these are the most rows of the operator, so they are dealt and sorted by blocks
    dealt = [] if cold is None else [_warm(cold, buckets)]
    dealt += [] if lines is None else [_calm(lines, buckets, hot)]
    pairs = reduce(DataFrame.unionByName, dealt).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_listed, "a long, b long")
    return pairs.repartition("a", "b").distinct()  # few of a task's pairs repeat


def _hot_links(flagged: DataFrame, hot_words: DataFrame, words: DataFrame) -> DataFrame:
    """class, links and near (the first place of a linked line) from words of many lines.

    flagged: all prefix words (class, n, at, word, grade, hot: the word has many lines in this grade and
    the next, below: in the grade below and this one) of lines with such words; words: class, place,
    words. Lines that meet longer ones, and those, are dealt into blocks; each block of the former meets
    each of the latter once, and a task counts links instead of listing them. A pair belongs to the first
    word of many lines in which it meets, unless it meets in one of few lines, where the join has it.
    """
    prefix = flagged.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("at", "word", "hot"))).alias("prefix"))
    full = cut(prefix.join(words, "class"), "full")
    own = flagged.where("hot").select("word", "grade", "class", "at", F.array(F.lit(True), F.lit(False)).alias("roles"))
    next_ = flagged.where("below").select("word", (F.col("grade") - 1).alias("grade"), "class", "at", F.array(F.lit(False)).alias("roles"))
    rows = own.unionByName(next_).join(hot_words, ["word", "grade"]).withColumn("shorter", F.explode("roles"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    mine = F.pmod(F.xxhash64("class"), blocks)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    meets = F.transform(others, lambda o: F.struct(F.when(F.col("shorter"), mine).otherwise(o).alias("l"), F.when(F.col("shorter"), o).otherwise(mine).alias("r")))
    dealt = rows.withColumn("m", F.explode(meets)).select("word", "grade", "m.l", "m.r", "shorter", "class", "at").join(full, "class")
    counted = dealt.groupBy("word", "grade", "l", "r").applyInPandas(_count, "class long, links long, doc_id long, text_hash long, line int")
    return counted.select("class", "links", F.struct(*PLACE).alias("near"))


def _matrix(sets: list[list], number: dict) -> np.ndarray:
    """Rows of 0 and 1 over the members that number has."""
    out = np.zeros((len(sets), max(1, len(number))), np.float32)
    for i, s in enumerate(sets):
        out[i, [number[x] for x in s if x in number]] = 1
    return out


def _numbers(sets: list[list]) -> dict:
    number: dict = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    return number


def _count(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(PLACE)
    y, x = group[group["shorter"]], group[~group["shorter"]]
    y = y[y["at"].to_numpy() < _indexed(y["n"].to_numpy(np.int64))]
    sets = [[w.split(" ") for w in g["words"]] for g in (y, x)]
    number = _numbers(sets[0])
    size = [np.array([len(s) for s in side], np.float32) for side in sets]
    shared = _matrix(sets[0], number) @ _matrix(sets[1], number).T
    linked = shared >= SIMILAR * (size[0][:, None] + size[1][None, :] - shared) - 1e-4
    kinds = [g["class"].to_numpy() for g in (y, x)]
    ns = [g["n"].to_numpy() for g in (y, x)]
    linked &= (ns[0][:, None] < ns[1][None, :]) | (ns[0][:, None] == ns[1][None, :]) & (kinds[0][:, None] < kinds[1][None, :])
    longer = [[p["word"] for p in ps] for ps in x["prefix"]]
    number = _numbers(longer)
    index = [[p for p in ps if p["at"] < k] for ps, k in zip(y["prefix"], _indexed(y["n"].to_numpy(np.int64)))]
    elsewhere = [[p["word"] for p in ps if not p["hot"] or p["at"] < at] for ps, at in zip(index, y["at"])]
    linked &= _matrix(elsewhere, number) @ _matrix(longer, number).T == 0
    out = []
    for hits, one, two in ((linked, y, x), (linked.T, x, y)):
        on = np.flatnonzero(hits.any(axis=1)) if hits.size else np.zeros(0, np.int64)
        first = two.iloc[hits[on].argmax(axis=1)] if len(on) else two.iloc[:0]  # rows are in order of place
        out.append(pd.DataFrame({"class": one["class"].to_numpy()[on], "links": hits[on].sum(axis=1).astype(np.int64) if len(on) else np.zeros(0, np.int64), **{c: first[c].to_numpy() for c in PLACE}}))
    return pd.concat(out)


def _place(doc: np.ndarray, hashed: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    """Bit of the filter that stands for a place."""
    return (_mix(doc.view(np.uint64) * GOLD + hashed.view(np.uint64) + line.astype(np.uint64)) & U(bits - 1)).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """Bits of all places in wanted; a fixed size at most reaches the driver."""
    bits = 1 << 12
    count = wanted.count()
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = np.unique(_place(*(c.to_numpy() for c in b.columns), bits))
            yield pa.RecordBatch.from_arrays([pa.array(on >> 6), pa.array((U(1) << (on & 63).astype(np.uint64)).view(np.int64))], ["at", "bit"])

    rows = wanted.select(*PLACE).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _words(classes: DataFrame, reps: DataFrame, docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """class, place and the words of its first line, joined by spaces, which takes half the room of an array.

    Texts are read again and not shuffled: a filter of places says which lines to send on.
    """
    wanted = cut(classes.select("class").distinct().join(reps.select("class", *PLACE), "class"), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast((_filter(wanted), _rarity_bits(counts) << U(56)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, count = shared.value
        for ids, hashes, texts in _batches(batches):
            text, number = _ranges(np.array([t.count("\n") + 1 for t in texts]))
            doc, hashed = np.array(ids, np.int64)[text], np.array(hashes, np.int64)[text]
            bit = _place(doc, hashed, number, 64 * len(on))
            hit = np.flatnonzero((on[bit >> 6] >> (bit & 63).astype(np.uint64)) & U(1))
            parts = {t: texts[t].split("\n") for t in np.unique(text[hit]).tolist()}
            found = [parts[t][k] for t, k in zip(text[hit].tolist(), number[hit].tolist())]
            line, word = _sets("\n".join(found), count)
            if not len(line):
                continue
            start, n = _starts(line)
            of = line[start]
            words = pa.array([" ".join(dict.fromkeys(found[k].lower().split())).encode("utf-8", "replace").decode() for k in of])
            places = (doc[hit][of], hashed[hit][of], number[hit][of].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(_classes(word, start, n)), *map(pa.array, places), words], ["class", *PLACE, "words"])

    found = keyed(docs).where("doc_id is not null").mapInArrow(run, "class long, doc_id long, text_hash long, line int, words string")
    return cut(found.join(wanted, ["class", *PLACE], "left_semi").dropDuplicates(["class"]), "found")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose words x and y are similar enough; distinct words come joined by spaces."""
    known: dict[int, frozenset] = {}  # a class is in many pairs
    chars = 0
    for batch in batches:
        on = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() if c < 2 else batch.column(c) for c in range(4))):
            one, two = known.get(a), known.get(b)
            if one is None:
                text = x.as_py()
                one = known[a] = frozenset(text.split(" "))
                chars += len(text)
            if two is None:
                text = y.as_py()
                two = known[b] = frozenset(text.split(" "))
                chars += len(text)
            shared = len(one & two)
            on.append(shared >= SIMILAR * (len(one) + len(two) - shared) - 1e-9)
            if chars > CHARS_AT_ONCE:
                known, chars = {}, 0
        yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of classes whose first lines are similar enough."""
    side = lambda c, x: found.select(F.col("class").alias(c), F.col("words").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(_alike, "a long, b long"), "links")


def linked(reps: DataFrame, docs: DataFrame, rare: np.ndarray) -> DataFrame:
    """class, links and near (the first place of a linked line) of every class with links."""
    post = lambda rows: rows.where(F.size("prefix") > 0).withColumn("grade", grade(F.col("n"))).select("class", "n", "grade", "parities", "more", "calm", F.posexplode("prefix").alias("at", "word"))
    posts = reps.agg(F.sum(F.col("n") * (1 - SIMILAR) + 1)).first()[0] or 0  # about so many; no line's prefix is longer
    buckets = 1 + int(posts / BUCKET)
    hot_words = cut(_hot_words(reps, buckets), "hot")
    many = hot_words.count()
    side = lambda down, name: (lambda h: F.broadcast(h) if many <= BROADCAST_ROWS else h)(hot_words.select("word", (F.col("grade") + down).alias("grade"), F.lit(True).alias(name)))
    marked = lambda rows: rows.join(side(0, "hot"), ["word", "grade"], "left").join(side(1, "below"), ["word", "grade"], "left").na.fill(False, ["hot", "below"])
    # words of many lines come after the calm ones: of those shared before a meeting, hots at most are of that kind
    if many <= BROADCAST_ROWS:
        keys = hot_words.select("word", "grade").toPandas()
        hot = reps.sparkSession.sparkContext.broadcast((keys["word"].to_numpy(np.int64), keys["grade"].to_numpy(np.int64)))
        pairs, hot_classes = _candidates(None, reps, buckets, hot), _with_hot(reps, hot)
    else:
        warm = marked(post(reps.where(F.size("prefix") > F.col("calm"))).where("at >= calm")).withColumn("hots", F.col("at") - F.col("calm"))
        pairs, hot_classes = _candidates(warm.where("not (hot and below)"), reps, buckets), warm.where("hot or below").select("class").distinct()
    pairs, hot_classes = cut(pairs, "pairs"), cut(hot_classes, "hot_classes")
    found = _words(pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(hot_classes), reps, docs, rare)
    links = _verified(pairs, found)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = reps.select(F.col("class").alias("b"), F.struct(*PLACE).alias("near"))
    listed = both.join(place, "b").select(F.col("a").alias("class"), F.lit(1).cast("long").alias("links"), "near")
    of_hot = cut(marked(post(reps.join(hot_classes, "class", "left_semi"))).select("class", "n", "at", "word", "grade", "hot", "below"), "flagged")
    every = listed.unionByName(_hot_links(of_hot, hot_words, found))
    out = cut(every.groupBy("class").agg(F.sum("links").alias("links"), F.min("near").alias("near")), "linked")
    forget(pairs, found, links, hot_classes, of_hot)
    return out


def similar_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines with words; their classes with the first line of each; and the classes' links (class, links, near)."""
    counts = rarity(docs)
    every = cut(lines(docs, counts), "lines")
    first = every.groupBy("class").agg(F.min(F.struct(*PLACE, "n", "parities", "more", "calm", "prefix")).alias("r"))
    reps = cut(first.select("class", "r.*"), "reps")
    return every.select(*PLACE, "of", "class", "n"), reps, linked(reps, docs, counts)


@F.pandas_udf(T.StringType())
def _keep(text, gone):
    def kept(t, g):
        out = set(g)
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in out])

    return text.combine(gone, lambda t, g: t if g is None or t is None else kept(t, g))


def without_similar_lines(docs: DataFrame) -> DataFrame:
    """docs with later lines taken out of text; n_lines with words, n_removed, and n_links of their classes.

    Order is by doc_id, then text_hash (Spark's xxhash64 of the text, which tells texts under one doc_id
    apart), then line; a line goes if an earlier one has Jaccard similarity of at least 0.8
    to it as a set of words, whether that one stays or not. Lines without words stay and have no links.
    Null texts stay null; rows without doc_id stay as they are; rows that repeat a doc_id and its text are
    one text and lose the same lines. A text may become empty; no row is dropped. Extra columns pass
    through, save those named like the three made here. No rows in, no rows out.
    """
    # shuffle files of a step go when it has been written, not when the driver collects its garbage; a lost
    # executor then costs the step that runs, whose inputs are written tables
    conf, clean = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean)
    conf.set(clean, "true")
    try:
        return _without(docs)
    finally:
        conf.set(clean, before)


def _without(docs: DataFrame) -> DataFrame:
    every, reps, links = similar_lines(docs)
    best = reps.select("class", F.struct(*PLACE).alias("own")).join(links, "class", "left")
    best = best.select("class", F.least("own", F.coalesce("near", "own")).alias("best"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    judged = every.join(best, "class").select("doc_id", "text_hash", "of", "links", F.when(F.col("best") < F.struct(*PLACE), F.col("line")).alias("gone")).repartition("doc_id", "text_hash")
    # a row that comes so many times has each of its lines as often
    times = F.count(F.lit(1)) / F.max("of")
    by = judged.groupBy("doc_id", "text_hash").agg(F.max("of").cast("long").alias("n_lines"), F.round(F.sum("links") / times).cast("long").alias("n_links"), F.collect_set("gone").alias("gone"))
    by = cut(by, "by")
    forget(every, reps, links)
    joined = docs.join(by.hint("shuffle_hash"), is_row(docs, by), "left")  # whole texts aren't sorted
    zero = F.lit(0).cast("long")
    text = docs["text"].cast("string")
    some = F.coalesce(F.size(by["gone"]) > 0, F.lit(False))  # only texts that lose lines go to Python
    text = F.when(some, _keep(F.when(some, text), F.when(some, by["gone"]))).otherwise(text)
    made = {"text": text, "n_lines": F.coalesce(by["n_lines"], zero), "n_removed": F.greatest(F.coalesce(F.size(by["gone"]), F.lit(0)), F.lit(0)).cast("long"), "n_links": F.coalesce(by["n_links"], zero)}
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns if c not in made), *(v.alias(k) for k, v in made.items()))
