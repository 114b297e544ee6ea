"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

A token is emitted once no further input can change it. How far ahead that is follows from the merge
list alone. Take two inputs that share a beginning and a merge that happens in the shared part of one
run only. Its cause is a merge of higher priority in the other run: one that built one of its parts,
took its right part together with what follows, or took its left part together with what precedes.
The chain of causes ends at a merge that crosses the end of the shared part. `lookahead` computes, in
order of priority, the farthest end that such a chain can reach, measured from the start of the first
merge. A token that starts at least that far before the end of the input read so far is final, and so are
all tokens of a pre-token that has ended, across whose end nothing merges. Every id of a text comes from a
step of that kind; steps that come again and again are remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how a byte-level pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a stream reads before it looks for final tokens, beside the lookahead.
BLOCK = 512
#: Characters of a text that are split at once.
TEXT_BLOCK = 1 << 14
#: Steps over whole pre-tokens that a worker remembers, and the longest of them in bytes.
MEMO, MEMO_BYTES = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes from a token's start after which the input cannot change it."""
    made: dict[bytes, int] = {}  # reach of the merge that builds a token
    after: dict[bytes, int] = {}  # by left part: the farthest reach of earlier merges
    before: dict[bytes, int] = {}  # by right part: the same, less the length of the left part
    most = 1
    for left, right in merges:
        reach = max(len(left) + len(right), made.get(left, 0), len(left) + made.get(right, 0), len(left) + after.get(right, 0), before.get(left, 0))
        made[left + right] = max(reach, made.get(left + right, 0))
        after[left] = max(reach, after.get(left, 0))
        before[right] = max(reach - len(left), before.get(right, 0))
        most = max(most, reach)
    return most


class ByteBpe:
    """Encoder and decoder for a vocabulary file of a byte-level BPE tokenizer."""

    _shared: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.lookahead = lookahead(merges)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.memo: dict[str, bytes] = {}
        size = max([*self.ids.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for k, v in (*self.ids.items(), *((k.encode(), v) for k, v in special.items())):
            self.bytes_of[v] = k

    @classmethod
    def shared(cls, path: str) -> ByteBpe:
        """One per Python worker and vocabulary."""
        return cls._shared.setdefault(path, cls._shared.get(path) or cls(path))

    def _short(self, parts: list[bytes]) -> list[bytes]:
        """Merges the best pair again and again; for a few parts."""
        rank = self.rank
        pairs = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == 1 << 30:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get((parts[i], parts[i + 1]), 1 << 30)
            if i:
                pairs[i - 1] = rank.get((parts[i - 1], parts[i]), 1 << 30)
        return parts

    def _long(self, data: bytes) -> list[bytes]:
        """The same with a heap, for a block of a stream."""
        n, rank = len(data), self.rank
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := rank.get((part[x], part[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[after[x]]))
        return [p for p in part if p]

    def step(self, window: bytes, ended: bool) -> tuple[list[int], int]:
        """Final ids at the beginning of a window of a pre-token, and how many bytes they stand for.

        ended: the pre-token ends with the window, so all of it is final.
        """
        tokens = self._short([window[i : i + 1] for i in range(len(window))]) if len(window) <= MEMO_BYTES else self._long(window)
        if ended:
            return [self.ids[t] for t in tokens], len(window)
        at, out = 0, []
        for token in tokens:
            if at + self.lookahead > len(window):
                break
            out.append(self.ids[token])
            at += len(token)
        return out, at

    def stream(self, chunks: Iterator[bytes]) -> Iterator[list[int]]:
        """Ids of one pre-token that arrives in chunks; holds BLOCK and lookahead bytes at most, and a chunk."""
        held, size = b"", BLOCK + self.lookahead
        for chunk in chunks:
            held += chunk
            while len(held) > size:
                out, at = self.step(held[:size], False)
                held = held[at:]
                yield out
        if held:
            yield self.step(held, True)[0]

    def _pretoken(self, word: str) -> bytes:
        out = b"".join([np.array(x, "<u4").tobytes() for x in self.stream(iter((word.encode("utf-8", "replace"),)))])
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def _run(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of a long pre-token, encoded a block at a time."""
        for ids in self.stream(text[i : min(i + BLOCK, end)].encode("utf-8", "replace") for i in range(at, end, BLOCK)):
            yield np.array(ids, "<u4").tobytes()

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of a part of a text without special tokens, a block of its pre-tokens at a time.

        Beside the text a block is held, whatever the length of a pre-token.
        """
        memo = self.memo
        while at < end:
            last = at + TEXT_BLOCK >= end
            words = self.split.findall(text, at, end if last else at + TEXT_BLOCK)
            if not last and len(words) < 4:  # a long pre-token: only its end is looked for
                stop = self.split.match(text, at, end).end()
                yield from self._run(text, at, stop)
                at = stop
                continue
            if not last:  # the last two pre-tokens of a block may depend on what follows
                del words[-2:]
            at = end if last else at + sum(map(len, words))
            yield b"".join([memo.get(w) or self._pretoken(w) for w in words])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit bytes, block by block."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self._plain(text, at, m.start())
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text, at, len(text))

    def decode(self, blocks: Iterator[np.ndarray]) -> Iterator[str]:
        """Text of id blocks. The state between blocks is an unfinished character, three bytes at most."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.bytes_of
        for ids in blocks:
            yield state.decode(b"".join([table[i] for i in ids.tolist()]))
        yield state.decode(b"", True)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are digested and decoded block by block as they come.

    A null text is empty: no tokens, and the digests of nothing. Special tokens' strings in a text become
    their ids. Rows with null or repeated doc_id each give a row. Very long texts are read in blocks.
    Other columns are not read. No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.shared(vocabulary)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

                def blocks():
                    nonlocal n
                    for raw in bpe.encode(text or ""):  # noqa: B023
                        ids.update(raw)  # noqa: B023
                        n += len(raw) // 4
                        yield np.frombuffer(raw, "<u4")

                for s in bpe.decode(blocks()):
                    back.update(s.encode())
                out.append((n, ids.hexdigest(), back.hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
