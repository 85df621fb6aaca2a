"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Each turn takes one macro edit: a run of inserted turns, then the turn's own edit (Delete, Keep, Rerole). The codes of the
macro edits, ``I*D``, ``I*K`` and ``I*R``, are prefix-free, so two audits of the same turns are compared by their first
different code and no audit is the beginning of another. A layer of the dynamic programme therefore holds, for each of four
states (nothing yet, after system, after user, after assistant), a cost, a rank among the states' audits and a pointer to
the layer before, never the audit itself; ties go by (rank before, code). Costs count from the least of the layer, so few
different layers exist and the step from one to the next is looked up. Audits are read back along the pointers at the end.

Rows are range-partitioned and sorted by (conv_id, turn, digest of role and text, row), so a conversation of any size is
spread over tasks. A conversation that lies within one partition is repaired where it stands. The others (the first and
last of each partition, and those of more than ``ROWS`` turns or ``BYTES`` of text) are written as blocks. A block maps the
state before it to costs, ranks and pointers for each state after it, and such maps compose in order; the fold per
conversation reads one small row per block, after which every block is repaired on its own. Only the SHA-256 of a repaired
conversation reads its pieces in order, in constant memory, as its definition asks for; its audit is one string as well.

Defined cases: a null role or text is one space, a null conv_id or turn is one space in the hash that decides the damage;
null turns come first and count in no gap; a null conv_id is a conversation; rows of one turn are ordered by the SHA-256 of
(length of role, ``:``, role, text); equal rows are duplicates; an empty role has no initial, keeps nothing and makes its
pairs illegal; other columns are not looked at; texts of any length are read whole; an empty table gives no rows; a
conversation of which every row was dropped has zeros, an empty audit and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A conversation beyond these is cut into blocks.
ROWS, BYTES = 4096, 16 << 20
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

_SPACE = b" \t\n\r\x0b\x0c"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: The state that follows, by role initial; what is missing is not allowed.
_NEXT = {(_START, b"s"): _SYSTEM, (_START, b"u"): _USER, (_SYSTEM, b"u"): _USER, (_USER, b"a"): _ASSISTANT, (_ASSISTANT, b"u"): _USER}
_ROLE = {_USER: b"user", _ASSISTANT: b"assistant"}
#: Macro edits in the order of their codes. Three insertions in a row never pay: two bring back the state after one turn.
_CODES = sorted("I" * j + e for j in range(3) for e in "DKR")
_TAIL = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}  # insertions that close a conversation

Layer = tuple  # per state: (cost, rank) or None


def _bare(state: int) -> int:
    """The state after one more user or assistant turn."""
    return _ASSISTANT if state == _USER else _USER


def _moves(kind: tuple[str, bytes]) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, number of the code) of all macro edits of a turn of this kind."""
    fault, initial = kind
    out = []
    for n, code in enumerate(_CODES):
        for p in _STATES:
            q = p
            for _ in code[:-1]:
                q = _bare(q)
            cost, edit = INSERT * (len(code) - 1), code[-1]
            if edit == "D":
                out.append((p, q, cost + DELETE, n))
            elif fault not in ("blank", "duplicate"):
                cost += UNFINISHED * (fault == "truncated")
                if edit == "R":
                    out.append((p, _bare(q), cost + REROLE, n))
                elif (q, initial) in _NEXT:
                    out.append((p, _NEXT[q, initial], cost, n))
    return out


_steps: dict[tuple, tuple[Layer, int, tuple]] = {}


def step(layer: Layer, kind: tuple[str, bytes]) -> tuple[Layer, int, tuple]:
    """(next layer, what was taken off its costs, pointers (state before, code) per state)."""
    if (layer, kind) not in _steps:
        best: list = [None] * 4
        for p, q, cost, n in _moves(kind):
            if layer[p] is not None:
                it = (layer[p][0] + cost, layer[p][1], n, p)
                if best[q] is None or it < best[q]:
                    best[q] = it
        least = min(b[0] for b in best if b)
        ranks = sorted((b[1], b[2], q) for q, b in enumerate(best) if b)
        rank = {q: r for r, (_, _, q) in enumerate(ranks)}
        _steps[layer, kind] = tuple(b and (b[0] - least, rank[q]) for q, b in enumerate(best)), least, tuple(b and (b[3], b[2]) for b in best)
    return _steps[layer, kind]


def entering(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in _STATES)


def close(layer: Layer) -> tuple[int, int]:
    """(cost, state) of the best end."""
    cost, _, state = min((v[0] + INSERT * _TAIL[s], v[1], s) for s, v in enumerate(layer) if v is not None)
    return cost, state


def back(pointers: list[tuple], state: int) -> tuple[list[str], int]:
    """The codes on the way to ``state``, in order, and the state where it begins."""
    codes = []
    for at in reversed(pointers):
        state, n = at[state]
        codes.append(_CODES[n])
    return codes[::-1], state


def repaired(codes: list[str], turns: Iterable[tuple[bytes, bytes]], state: int) -> list[bytes]:
    """``role:text`` of the turns that the edits leave or put in."""
    out = []
    for code, (role, text) in zip(codes, turns, strict=True):
        for edit in code:
            if edit in "IR":
                state = _bare(state)
                out.append(_ROLE[state] + b":" + (text if edit == "R" else b""))
            elif edit == "K":
                state = _NEXT[state, role[:1]]
                out.append(role + b":" + text)
    return out


def tail(state: int) -> list[bytes]:
    """The turns that close a conversation in ``state``."""
    out = []
    for _ in range(_TAIL[state]):
        state = _bare(state)
        out.append(_ROLE[state] + b":")
    return out


@dataclass
class Block:
    """Consecutive rows of one conversation, in order."""

    rows: list[tuple] = field(default_factory=list)  # turn, digest, role, text, copies
    size: int = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[2]) + len(row[3])

    def turns(self) -> Iterator[tuple[bytes, bytes]]:
        for _, _, role, text, copies in self.rows:
            for _ in range(copies):
                yield role, text

    def kinds(self, first: set[int] | None = None) -> list[tuple[str, bytes]]:
        """Fault and initial of each turn. ``first``: the rows whose role and text appear first in the conversation; if
        not given, the block is the conversation."""
        seen, out = set(), []
        for i, (_, digest, role, text, copies) in enumerate(self.rows):
            bare = text.strip(_SPACE)
            for c in range(copies):
                new = c == 0 and (digest not in seen if first is None else i in first)
                out.append(("blank" if not bare else "duplicate" if not new else "" if bare[-1:] in (b".", b"!", b"?") else "truncated", role[:1]))
            if copies:
                seen.add(digest)
        return out

    def facts(self, kinds: list[tuple[str, bytes]]) -> dict:
        """What adds up over blocks, and the ends that their seams need. An initial is null where there is no turn."""
        told = [t for t, *_, copies in self.rows if copies and t is not None]
        faults = [f for f, _ in kinds]
        illegal = sum(a + b not in (b"su", b"ua", b"au") for (_, a), (_, b) in zip(kinds, kinds[1:], strict=False))
        ends = {"first": kinds[0][1], "last": kinds[-1][1]} if kinds else {"first": None, "last": None}
        return {f: faults.count(f) for f in ("blank", "duplicate", "truncated")} | ends | {"illegal": illegal, "least": told[0] if told else None, "most": told[-1] if told else None, "distinct": len(set(told))}


def walk(kinds: list[tuple[str, bytes]], state: int) -> tuple[Layer, int, list[tuple]]:
    """(layer after all turns, cost of its least, pointers) from ``state`` on."""
    layer, cost, pointers = entering(state), 0, []
    for k in kinds:
        layer, more, at = step(layer, k)
        cost += more
        pointers.append(at)
    return layer, cost, pointers


def whole(block: Block) -> dict:
    """The result of a conversation that is one block."""
    kinds = block.kinds()
    f = block.facts(kinds)
    layer, cost, pointers = walk(kinds, _START)
    more, end = close(layer)
    codes, _ = back(pointers, end)
    lines = repaired(codes, block.turns(), _START) + tail(end)
    gaps = f["most"] - f["least"] + 1 - f["distinct"] if f["least"] is not None else 0
    return {k: f[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost + more, "audit": "".join(codes) + "I" * _TAIL[end], "repaired_sha256": hashlib.sha256(b"\n".join(lines)).hexdigest()}


DAMAGED = "conv_id long, turn long, role string, text string, copies int"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURN = pa.struct([("turn", pa.int64()), ("digest", pa.binary()), ("role", pa.large_binary()), ("text", pa.large_binary()), ("copies", pa.int32())])
_SORTED = RESULT + ", done boolean, part int, seq int, turns array<struct<turn: long, digest: binary, role: binary, text: binary, copies: int>>"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with how often each occurs: by crc32(``conv_id:turn``) modulo 20 it is dropped (0 copies), emptied, left
    without marks, repeated, or given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("what"),
    )
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).alias("copies"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        conv, turn, copies = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "copies"))
        digest, role, text = (b.column(b.schema.get_field_index(c)).cast(pa.large_binary()).to_pylist() for c in ("digest", "role", "text"))
        yield from zip(conv, turn, digest, role, text, copies, strict=True)


def _records(found: Iterator[dict], schema: pa.Schema, most: int = 512, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    held, held_size = [], 0
    for r in found:
        held.append(r)
        held_size += r.pop("size", 0)
        if len(held) >= most or held_size >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, held_size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _blocks(rows: Iterator[tuple], part: int, most_rows: int, most_bytes: int) -> Iterator[dict]:
    """Results of the conversations that begin and end here, and the blocks of the others."""
    seq, block, now, alone = 0, Block(), None, False  # alone: the conversation began here, in this block

    def opened() -> dict:
        nonlocal seq
        seq += 1
        turns = [dict(zip(("turn", "digest", "role", "text", "copies"), r, strict=True)) for r in block.rows]
        return {"conv_id": now, "done": False, "part": part, "seq": seq, "turns": turns, "size": block.size}

    began = False
    for conv, *row in rows:
        if began and conv != now:
            yield {"conv_id": now, "done": True} | whole(block) if alone else opened()
            block, alone = Block(), True
        elif block.rows and (len(block.rows) >= most_rows or block.size >= most_bytes):
            yield opened()
            block, alone = Block(), False
        began, now = True, conv
        block.add(tuple(row))
    if began:
        yield opened()


_BLOCK = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _LONGS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("done", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), ("turns", pa.list_(_TURN))])
_SUMS = ("blank", "duplicate", "truncated", "illegal")
_SUMMARY = "conv_id long, part int, seq int, blank long, duplicate long, truncated long, illegal long, first binary, last binary, least long, most long, distinct long, maps array<long>"
_PLAN = "conv_id long, part int, seq int, entry int, exit int, closing boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.large_binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _block(turns: list[dict]) -> Block:
    return Block([(t["turn"], t["digest"], t["role"], t["text"], t["copies"]) for t in turns])


def _fold(blocks: list[dict]) -> Iterator[dict]:
    """The states at the seams of one conversation's blocks, with its sums on the last. ``maps`` has, for each state before
    and after, cost and rank (-1: none)."""
    blocks.sort(key=lambda b: (b["part"], b["seq"]))
    layer, cost, pointers = entering(_START), 0, []
    sums = dict.fromkeys(_SUMS, 0)
    last = least = most = None
    distinct = 0
    for b in blocks:
        best: list = [None] * 4
        for p in _STATES:
            for q in _STATES:
                c, r = b["maps"][8 * p + 2 * q : 8 * p + 2 * q + 2]
                if layer[p] is not None and r >= 0:
                    it = (layer[p][0] + c, layer[p][1], r, p)
                    if best[q] is None or it < best[q]:
                        best[q] = it
        low = min(x[0] for x in best if x)
        rank = {q: i for i, (_, _, q) in enumerate(sorted((x[1], x[2], q) for q, x in enumerate(best) if x))}
        layer, cost = tuple(x and (x[0] - low, rank[q]) for q, x in enumerate(best)), cost + low
        pointers.append(tuple(x and x[3] for x in best))
        for k in _SUMS:
            sums[k] += b[k]
        if b["first"] is not None:
            sums["illegal"] += last is not None and last + b["first"] not in (b"su", b"ua", b"au")
            last = b["last"]
        if b["least"] is not None:
            distinct += b["distinct"] - (most == b["least"])
            least, most = b["least"] if least is None else least, b["most"]
    more, state = close(layer)
    sums |= {"cost": cost + more, "gaps": most - least + 1 - distinct if least is not None else 0}
    for i in range(len(blocks) - 1, -1, -1):
        before = pointers[i][state]
        closing = i == len(blocks) - 1
        yield {"conv_id": blocks[i]["conv_id"], "part": blocks[i]["part"], "seq": blocks[i]["seq"], "entry": before, "exit": state, "closing": closing} | (sums if closing else dict.fromkeys(sums))
        state = before


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text,
    copies), one for every conv_id; rows of 0 copies only say that there is such a conversation."""
    spark = rows.sparkSession
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(_blocks(_rows(batches), TaskContext.get().partitionId(), most_rows, most_bytes), _BLOCK)

    table = C.cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(first_pass, _SORTED))
    done, opened = table.where("done").select(*_NAMES), table.where("not done")

    # the first row of each role and text of a conversation, by block
    said = opened.select("conv_id", "part", "seq", F.posexplode(F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["copies"].alias("copies")))).alias("i", "t")).where("t.copies > 0")
    firsts = said.groupBy("conv_id", "t.digest").agg(F.min(F.struct("part", "seq", "i")).alias("at")).groupBy("at.part", "at.seq").agg(F.collect_list("at.i").alias("firsts"))
    known = C.cut(opened.select("conv_id", "part", "seq", "turns").join(firsts, ["part", "seq"], "left").select("conv_id", "part", "seq", "turns", "firsts"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    block = _block(r["turns"])
                    kinds = block.kinds({*(r["firsts"] or ())})
                    maps = []
                    for p in _STATES:
                        layer, cost, _ = walk(kinds, p)
                        maps += [x for v in layer for x in ((cost + v[0], v[1]) if v is not None else (0, -1))]
                    yield {k: r[k] for k in ("conv_id", "part", "seq")} | block.facts(kinds) | {"maps": maps}

        return _records(each(), _schema(_SUMMARY))

    def fold(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([*_fold(t.to_pylist())], _schema(_PLAN))

    plan = C.cut(known.mapInArrow(summarise, _SUMMARY).groupBy("conv_id").applyInArrow(fold, _PLAN))

    pieces = f"{_PLAN}, audit string, lines long, text binary"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    block, entry = _block(r.pop("turns")), r["entry"]
                    _, _, pointers = walk(block.kinds({*(r.pop("firsts") or ())}), entry)
                    codes, _ = back(pointers, r["exit"])
                    lines = repaired(codes, block.turns(), entry) + (tail(r["exit"]) if r["closing"] else [])
                    text = b"\n".join(lines)
                    yield r | {"audit": "".join(codes) + "I" * (_TAIL[r["exit"]] if r["closing"] else 0), "lines": len(lines), "text": text, "size": len(text)}

        return _records(each(), _schema(pieces))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            digest, audit, lines = hashlib.sha256(), [], 0
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    if r["lines"]:
                        digest.update(b"\n" * (lines > 0) + r["text"])
                    lines += r["lines"]
                    audit.append(r["audit"])
                    if r["closing"]:
                        yield {k: r[k] for k in ("conv_id", *_LONGS)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                        digest, audit, lines = hashlib.sha256(), [], 0

        return _records(each(), _schema(RESULT))

    made = known.join(plan.drop("conv_id"), ["part", "seq"]).select(*[c.split()[0] for c in _PLAN.split(", ")], "turns", "firsts").mapInArrow(rebuild, pieces)
    late = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(join, RESULT)
    return done.union(late)
