"""Ids of a lower-casing word tokenizer, looked up by white-space chunk."""

from __future__ import annotations

import os
import re
from array import array

#: White space as Unicode defines it; str.split also cuts at U+001C to U+001F.
_WHITE = "\t-\r \x85\xa0" + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE, _CHUNK = re.compile(f"[{_WHITE}]+"), re.compile(f"[^{_WHITE}]+")
_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?|#*$%&()/]*)")
_EXTRA = re.compile("[\x1c-\x1f]")
#: Longer texts are cut lazily, so that the list of chunks stays small.
LONG = 1 << 20


class WordEncoder:
    """Whole-text ids as little-endian 32-bit bytes.

    The tokenizer drops white space and none of its steps looks across it, so a text's ids are those of
    its white-space chunks in a row. Chunks and their parts are kept in bounded memos, which hold most of a text.
    """

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = memo

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One per Python worker and vocabulary."""
        return cls._shared.setdefault(path, cls._shared.get(path) or cls(path))

    def __call__(self, text: str) -> bytes:
        if len(text) > LONG:
            out, block = [], []
            for m in _CHUNK.finditer(text):
                block.append(m[0])
                if len(block) == 100_000:
                    out.append(self._join(block))
                    block = []
            return b"".join([*out, self._join(block)])
        return self._join([x for x in _SPACE.split(text) if x] if _EXTRA.search(text) else text.split())

    def _join(self, chunks: list[str]) -> bytes:
        known = self.chunks
        try:
            return b"".join([known[x] for x in chunks])
        except KeyError:
            new = {x: _parts(x) for x in chunks if x not in known}
            parts, now = self.parts, {}
            if fresh := list({p for ps in new.values() for p in ps if p not in parts}):
                now = {p: array("I", e.ids).tobytes() for p, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False))}
                if len(parts) < self.most // 2:
                    parts.update(now)
            made = {x: b"".join([now[p] if p in now else parts[p] for p in ps]) for x, ps in new.items()}
            if len(known) < self.most:  # the first chunks hold the frequent ones
                known.update(made)
            return b"".join([made[x] if x in made else known[x] for x in chunks])


def _parts(chunk: str) -> tuple[str, ...]:
    """Parts with the chunk's ids in a row: a Latin-1 word in lower case, as the tokenizer makes it, and the signs after it."""
    m = _WORD.fullmatch(chunk)
    return (chunk,) if m is None else (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)
