"""Repair of conversations: the cheapest edits that give role initials (s?(ua)+)?, by a DAG of optimal arcs from both ends.

A node is a number of rows read and a state (nothing yet, after s, after u, after a); an arc is an edit. An arc
lies on a cheapest path if the least cost before it, its own and the least cost after it add up to the total.
A walk over such arcs keeps the set of nodes reached and takes the least edit letter that leaves any of them,
so it spells the ASCII-least of the cheapest edits. As the letters fix the roles put out, and so the state,
the set is one node, and a block of rows is a map from the state before it to the state after it.

A conversation is cut into blocks of BLOCK rows, each solved on its own: costs of a block are a matrix of
4 x 4 (least sums), a chain of matrices gives the costs at each border, then every block is walked from each
state that a cheapest path enters it with. Only those matrices of a conversation meet in one task. Its
repaired text is hashed in order by one task, since SHA-256 can't be split, as a stream in bounded memory.

Nulls in role and text are one space, a null turn comes first and a null conv_id is a conversation. Rows of
one turn are ordered by role and text, so rows that repeat are neighbours and all but one are duplicates. An
empty text is blank; long texts are never taken to Python by the search. Extra columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, digests, numbered

#: Rows of a conversation that one step solves together.
BLOCK = 4096
#: Costs of edits, and what a truncated row adds that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Characters that are blank.
BLANK = " \t\n\v\f\r"
#: State after the role that an insertion or a new role gives, by state; its letter, and the state that an initial leads to from a state.
_NEXT = (2, 2, 3, 2)
_LETTER = {2: "u", 3: "a"}
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60

#: A row's code: place of its initial in s, u, a and others, plus 4 for each of sound, truncated, blank and duplicate.
_CODES = "suaxSUAX01234567"
_INITIAL = {c: "suax"[k % 4] for k, c in enumerate(_CODES)}


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, without ends, repeated or of another role, by a hash of conv_id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("_hit"))
    hit = F.col("_hit")
    rows = rows.where(hit != 0).withColumn("text", F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(hit == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_hit", "_copy")


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "null").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _with_inserts_forward(c) -> list[int]:
    u = min(c[2], min(c[0], c[1], c[3]) + INSERT)
    return [c[0], c[1], u, min(c[3], u + INSERT)]


def _with_inserts_backward(c) -> list[int]:
    u = min(c[2], c[3] + INSERT)
    return [min(c[0], u + INSERT), min(c[1], u + INSERT), u, min(c[3], u + INSERT)]


def _arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row from a state: letter, cost, state after it."""
    out = [("D", DELETE, state)]
    if not code.isdigit():
        more = TRUNCATED if code.isupper() else 0
        to = _KEEP.get(_INITIAL[code], {}).get(state)
        if to is not None:
            out.append(("K", more, to))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


_ARCS = {code: [_arcs(code, s) for s in range(4)] for code in _CODES}


def _forward(codes: str, start: list[int]) -> list[list[int]]:
    """Least costs at each node of a block, insertions before a row included; the last ones are without insertions."""
    out, c = [], start
    for code in codes:
        c = _with_inserts_forward(c)
        out.append(c)
        after = [_FAR] * 4
        for s in range(4):
            for _, w, to in _ARCS[code][s]:
                after[to] = min(after[to], c[s] + w)
        c = after
    return [*out, c]


def _backward(codes: str, end: list[int]) -> list[list[int]]:
    """Least costs from each node of a block to the end of the conversation, given those at the block's end."""
    out, c = [end], end
    for code in reversed(codes):
        c = _with_inserts_backward([min(w + c[to] for _, w, to in _ARCS[code][s]) for s in range(4)])
        out.append(c)
    return out[::-1]


@lru_cache(100_000)
def _matrix(codes: str) -> list[int]:
    return [x for s in range(4) for x in _forward(codes, [0 if k == s else _FAR for k in range(4)])[-1]]


#: Least costs behind the last row: nothing or an end in a is legal, else insertions make it so.
_END = _with_inserts_backward([0, _FAR, _FAR, 0])


def _walk(codes: str, before: list[int], after: list[int], total: int, last: bool, entry: int) -> tuple[int, str, str] | None:
    """State at the block's end, letters and what each row puts out, from an entry on a cheapest path; None if none enters there."""
    n, f, b = len(codes), _forward(codes, before), _backward(codes, after)
    if last:
        f[n] = _with_inserts_forward(f[n])
    if before[entry] + b[0][entry] != total:
        return None
    at, front, letters, out, here = 0, {entry}, [], [], ""
    while at < n or (last and not any(s in (0, 3) and f[n][s] == total for s in front)):
        tight: dict[str, set[tuple[int, int]]] = {}
        for s in front:
            if f[at][s] + INSERT + b[at][_NEXT[s]] == total:
                tight.setdefault("I", set()).add((s, _NEXT[s]))
            for letter, w, to in _ARCS[codes[at]][s] if at < n else ():
                if f[at][s] + w + b[at + 1][to] == total:
                    tight.setdefault(letter, set()).add((s, to))
        letter = min(tight)
        front = {to for _, to in tight[letter]}
        letters.append(letter)
        to = min(front)
        if letter == "I":
            here += _LETTER[to]
        else:
            out.append(here + (_LETTER[to].upper() if letter == "R" else letter))
            here, at = "", at + 1
    return min(front), "".join(letters), ",".join([*out, here])


_remembered = lru_cache(100_000)(_walk)


def _summary(codes: pd.Series) -> pd.DataFrame:
    made = {}
    for c in codes.unique():
        initials = "".join(_INITIAL[x] for x in c)
        count = lambda kinds: sum(c.count(x) for x in kinds)  # noqa: E731, B023
        made[c] = (_matrix(c), count("0123"), count("4567"), count("SUAX"), sum(initials[k : k + 2] not in _LEGAL for k in range(len(c) - 1)), initials[0], initials[-1])
    return pd.DataFrame([made[c] for c in codes], columns=["costs", "blank", "duplicate", "truncated", "illegal", "first", "last"])


def _chain(blocks: pd.Series) -> pd.DataFrame:
    """Costs before and after each block of a conversation, from its blocks' matrices in order."""
    out = []
    for parts in blocks:
        befores, c = [], [0, _FAR, _FAR, _FAR]
        for p in parts:
            befores.append(c)
            m = p["costs"]
            c = [min(_FAR, min(c[s] + int(m[4 * s + t]) for s in range(4))) for t in range(4)]
        afters, d = [], list(_END)
        for p in reversed(parts):
            afters.append(d)
            m = p["costs"]
            d = [min(int(m[4 * s + t]) + d[t] for t in range(4)) for s in range(4)]
        illegal = sum(int(p["illegal"]) for p in parts) + sum(p["last"] + q["first"] not in _LEGAL for p, q in zip(parts, parts[1:]))
        out.append((d[0], illegal, [{"before": x, "after": y} for x, y in zip(befores, reversed(afters))]))
    return pd.DataFrame(out, columns=["cost", "illegal", "borders"])


def _walks(codes: pd.Series, before: pd.Series, after: pd.Series, total: pd.Series, last: pd.Series) -> pd.Series:
    """For each state before a block where a cheapest path enters it, the walk from there."""
    out = []
    for c, f, b, t, end in zip(codes, before, after, total, last):
        walk = _remembered if len(c) <= 64 else _walk
        f, b = tuple(map(int, f)), tuple(map(int, b))
        found = [walk(c, f, b, int(t), bool(end), s) for s in range(4)]
        out.append([w and {"exit": w[0], "letters": w[1], "outs": w[2]} for w in found])
    return pd.Series(out)


def _entries(exits: pd.Series) -> pd.Series:
    """The state before each block, from the states that each block's walks end in."""
    out = []
    for blocks in exits:
        s, here = 0, []
        for e in blocks:
            here.append(s)
            s = int(e[s])
        out.append(here)
    return pd.Series(out)


#: What the functions over batches give.
_TYPES = {
    _summary: "costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string",
    _chain: "cost long, illegal long, borders array<struct<before: array<long>, after: array<long>>>",
    _walks: "array<struct<exit: int, letters: string, outs: string>>",
    _entries: "array<int>",
}


def _batched(f, *columns: Column | str) -> Column:
    return F.pandas_udf(f, _TYPES[f])(*columns)


def _in_order(by: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(by, *columns)))


def repaired(conversations: DataFrame, block: int = BLOCK, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: of conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and of lines (conv, at, line), where conv is '=' and the conv_id, or 'null'.

    of: a table whose every conv_id has a row, with or without rows of its own; else conversations. Lines are the repaired rows as role:text in the order of at; several that belong to one place are joined by a newline.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.asc("role"), F.asc("text")], "at").withColumn("conv", _key(F.col("conv_id")))

    # a text seen before in its role: all rows but the first of a group; groups are counted before they are shuffled
    first = rows.groupBy("conv", "role", F.sha2("text", 256).alias("_same")).agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("_first"))
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    rows = rows.withColumns({"_blank": end == "", "_whole": end.endswith(".") | end.endswith("!") | end.endswith("?"), "_initial": F.substring("role", 1, 1)})
    coded = rows.select("conv", "conv_id", "at", "turn", "_blank", "_whole", "_initial").join(first, ["conv", "at"], "left")
    kind = F.when(F.col("_blank"), 8).when(F.col("_first").isNull(), 12).when(~F.col("_whole"), 4).otherwise(0)
    place = F.when(F.col("_initial") == "s", 1).when(F.col("_initial") == "u", 2).when(F.col("_initial") == "a", 3).otherwise(4)
    coded = coded.select("conv", "at", F.floor(F.col("at") / block).alias("block"), F.substring(F.lit(_CODES), kind + place, F.lit(1)).alias("code"))
    blocks = coded.groupBy("conv", "block").agg(F.array_join(F.transform(_in_order("at", "code"), lambda x: x["code"]), "").alias("codes"))
    blocks = cut(blocks.withColumn("s", _batched(_summary, "codes")).select("conv", "block", "codes", "s.*"), "blocks")

    chains = blocks.groupBy("conv").agg(_in_order("block", "costs", "illegal", "first", "last").alias("_b"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    chains = cut(chains.withColumn("c", _batched(_chain, "_b")).select("conv", "blank", "duplicate", "truncated", "c.cost", "c.illegal", "c.borders"), "chains")
    borders = chains.select("conv", "cost", F.size("borders").alias("_n"), F.posexplode("borders").alias("block", "border"))
    walked = blocks.select("conv", "block", "codes").join(borders, ["conv", "block"])
    walked = cut(walked.select("conv", "block", _batched(_walks, "codes", "border.before", "border.after", "cost", F.col("block") == F.col("_n") - 1).alias("walks")), "walks")

    exits = walked.select("conv", "block", F.transform("walks", lambda w: w["exit"]).alias("exits")).groupBy("conv").agg(_in_order("block", "exits").alias("_e"))
    entry = exits.select("conv", F.posexplode(_batched(_entries, F.transform("_e", lambda x: x["exits"]))).alias("block", "entry"))
    taken = cut(walked.join(entry, ["conv", "block"]).select("conv", "block", F.get("walks", F.col("entry")).alias("w")).select("conv", "block", "w.letters", "w.outs"), "taken")
    audits = taken.groupBy("conv").agg(F.array_join(F.transform(_in_order("block", "letters"), lambda x: x["letters"]), "").alias("audit"))

    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = (conversations if of is None else of).select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    counts = counts.join(chains.drop("borders"), "conv", "left").join(audits, "conv", "left").join(turns, "conv", "left").drop("conv")
    summary = counts.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))

    # what each row puts out: letters of inserted rows, then K, D or the letter of a new role; behind the last row, insertions alone
    outs = taken.select("conv", "block", F.posexplode(F.split("outs", ",")).alias("k", "out")).where("out <> ''").select("conv", (F.col("block") * block + F.col("k")).alias("at"), "out")
    role = lambda letter: F.when(F.lower(letter) == "u", "user").otherwise("assistant")
    made = F.transform(F.split(F.regexp_extract("out", "^[ua]*", 0), ""), lambda x: F.when(x != "", F.concat(role(x), F.lit(":"))))
    op = F.regexp_extract("out", "[KDUA]$", 0)
    line = F.when(op == "K", F.concat("role", F.lit(":"), "text")).when(op.isin("U", "A"), F.concat(role(op), F.lit(":"), "text"))
    said = outs.join(rows.select("conv", "at", "role", "text"), ["conv", "at"], "left")
    lines = said.select("conv", "at", F.array_compact(F.concat(made, F.array(line))).alias("_l"))
    return summary, lines.where("size(_l) > 0").select("conv", "at", F.array_join("_l", "\n").alias("line"))


def audited(conversations: DataFrame, block: int = BLOCK, of: DataFrame | None = None) -> DataFrame:
    """The table of conversations of repaired() with repaired_sha256, the hash of its lines joined by newlines."""
    summary, lines = repaired(conversations, block, of)
    hashed = digests(lines, "conv", "at", "line", "\n")
    nothing = F.sha2(F.lit(""), 256)
    return summary.withColumn("conv", _key(F.col("conv_id"))).join(hashed, "conv", "left").drop("conv").withColumn("repaired_sha256", F.coalesce("digest", nothing)).drop("digest")
