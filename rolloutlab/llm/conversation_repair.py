"""Operator 12 - conversation structure repair with a persistent audit DP.

A conversation is repaired by the cheapest edits that make its role initials
read ``(s?(ua)+)?``: Keep, Rerole to user or assistant, Delete, Insert an empty
turn. Of equally cheap ones the audit (the edits' initials in order) that is
least in ASCII counts.

1. Turns are sorted by conversation and turn over all tasks (range partitions,
   so a conversation of any length is spread over many) and cut into chunks of
   at most ``chunk`` turns; each turn is one code: its role's initial and fault.
2. For every chunk and every state it may start in, a dynamic programme over the
   four states (start, after s, after u, after a) keeps one audit per state. An
   audit is a linked node: parent, edit, rolling hash and binary-lifting
   ancestors, so audits share their prefixes. Ties are decided at the end of the
   longest common prefix, found by lifting while hashes differ; equal hashes are
   verified edit by edit. Inserts stand before a turn, so an audit of given turns
   is never a prefix of another one, and chunk audits can be ranked.
3. The chunks of a conversation are joined by the same programme over ranks, with
   a few numbers per chunk; the chosen chunk audits are written, and a last
   sorted pass hashes the repaired turns as a stream.

Cost of two inserts in a row never pays: they lead from a state to one that
allows no more, so at most one insert stands before a turn and one at the end.

Edge cases: null texts and roles are one space (such a turn is blank, such a role
cannot be kept, nor an empty one); null turns sort first; a null conversation id
is a conversation; turns equal in number sort by role, then text; repeated rows
are duplicates of the first; a conversation without turns (after damage, in the
query) has zeros, an empty audit and the hash of nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import shuffle_width, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3   # costs
CHUNK = 2048                                              # turns of one chunk
BATCH_BYTES = 4 << 20
STATES = "ESUA"
_TURN = {"E": "u", "S": "u", "U": "a", "A": "u"}          # role that may follow, but for s at the start
_AFTER = {"u": "U", "a": "A"}
_MOD, _BASE = (1 << 61) - 1, 1_000_003
_BLANKS = "\\x20\\x09-\\x0D"

CODED = "kind string, conv_id bigint, chunk bigint, pos int, code string, role string, text string, payload string"
REPAIR = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


class Audits:
    """Edit sequences as linked nodes; node 0 is the empty sequence."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [None], [0], [0], [[]]
        self._equal: set[tuple[int, int]] = set()

    def add(self, parent: int, edits) -> int:
        for e in edits:
            up, k = [parent], 0
            while len(self.up[up[k]]) > k:                   # ancestor 2^(k+1) is the 2^k-th of the 2^k-th
                up.append(self.up[up[k]][k])
                k += 1
            self.edit.append(e)
            self.depth.append(self.depth[parent] + 1)
            self.hash.append((self.hash[parent] * _BASE + hash(e) + 7) % _MOD)
            self.up.append(up)
            parent = len(self.edit) - 1
        return parent

    def lift(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        k = self.depth[node] - depth
        while k:
            bit = k.bit_length() - 1
            node = self.up[node][bit]
            k -= 1 << bit
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same edits; equal hashes are verified."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        walked = []
        x, y = a, b
        while x != y and (x, y) not in self._equal:
            if self.edit[x] != self.edit[y]:
                return False                                  # a collision
            walked.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        self._equal.update(walked)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b`` in order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):          # down to the first edits that differ
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x] < self.edit[y]

    def edits(self, node: int) -> list:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return out[::-1]


def _options(state: str, initial: str, fault: str):
    """(cost, next state, edits) of taking one turn in a state."""
    extra = TRUNCATED if fault == "t" else 0
    for insert in (False, True):
        at, price, edits = state, 0, ""
        if insert:
            at, price, edits = _AFTER[_TURN[state]], INSERT, "I"
        yield price + DELETE, at, edits + "D"
        if fault in "bd":
            continue
        if at == "E" and initial == "s":
            yield price + KEEP + extra, "S", edits + "K"
        if initial == _TURN[at]:
            yield price + KEEP + extra, _AFTER[initial], edits + "K"
        else:
            yield price + REROLE + extra, _AFTER[_TURN[at]], edits + "R"


_STEPS = {(s, i, f): tuple(_options(s, i, f)) for s in STATES for i in "sua?" for f in "bdt-"}


def chunk_audits(code: str, starts: str) -> dict[str, tuple[int, str]]:
    """start + end state -> (cost, audit) over the coded turns (two characters each: initial, fault)."""
    out = {}
    for start in starts:
        audits = Audits()
        best = {start: (0, 0)}
        for k in range(0, len(code), 2):
            new: dict = {}
            for state, (cost, node) in best.items():
                for price, to, edits in _STEPS[state, code[k], code[k + 1]]:
                    total = cost + price
                    have = new.get(to)
                    if have is None or total < have[0]:
                        new[to] = (total, node, edits)
                    elif total == have[0] and (edits < have[2] if node == have[1] else audits.less(node, have[1])):
                        new[to] = (total, node, edits)
            best = {to: (total, audits.add(node, edits)) for to, (total, node, edits) in new.items()}
        out |= {start + end: (cost, "".join(audits.edits(node))) for end, (cost, node) in best.items()}
    return out


def join_chunks(chunks: list[dict]) -> tuple[int, list[str], bool]:
    """(cost, start + end state of each chunk, whether an insert follows) of the cheapest way through ranked chunk audits."""
    audits = Audits()
    best = {"E": (0, 0, None)}
    for chunk in chunks:
        new: dict = {}
        for state, (cost, node, _) in best.items():
            for to in STATES:
                if (step := chunk.get(state + to)) is None:
                    continue
                total, have = cost + step[0], new.get(to)
                if (have is None or total < have[0] or total == have[0]
                        and (step[1] < have[2][0] if node == have[1] else audits.less(node, have[1]))):
                    new[to] = (total, node, (step[1], state + to))
        best = {to: (total, audits.add(node, [way]), None) for to, (total, node, way) in new.items()}
    ends = [(cost + (INSERT if state == "U" else 0), node, state == "U") for state, (cost, node, _) in best.items() if state != "S"]
    least = min(e[0] for e in ends)
    cost, node, insert = ends[[e[0] for e in ends].index(least)]
    for c, n, i in ends:
        if c == least and n != node and audits.less(n, node):
            node, insert = n, i
    return cost, [way for _, way in audits.edits(node)], insert


def coded_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, code and first (the smallest turn with the same role and text; null: this is the only one)."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = t.withColumns({
        "blank": ~F.col("text").rlike(f"[^{_BLANKS}]"), "same": F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text")),
        "ended": F.col("text").rlike(f"(?s)[.!?][{_BLANKS}]*\\z")})
    # a role and text that occur more than once in a conversation: its first turn (nulls first)
    more = (t.where("NOT blank").groupBy(*_key("conv_id"), "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
            .where("n > 1").select("c0", "c1", "same", "first"))
    keyed = t.select("*", *_key("conv_id"))
    return (keyed.join(more, ["c0", "c1", "same"], "left").withColumn("code", F.concat(
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?"),
        F.when(F.col("blank"), "b").when(F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("has"), "turn") != F.col("first")), "d")
        .when(F.col("first").isNotNull(), "x").when(~F.col("ended"), "t").otherwise("-"), F.when(F.col("ended"), "-").otherwise("t")))
        .select("conv_id", "turn", "role", "text", "code"))


def _key(column: str) -> tuple:
    """Two plain columns that stand for a column that may be null."""
    return F.col(column).isNull().alias("c0"), F.coalesce(column, F.lit(0)).alias("c1")


def chunked(coded: DataFrame, chunk: int) -> DataFrame:
    """The turns in order with their chunk and place (kind "turn"), and one row per chunk (kind "chunk") with its audits (CODED)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    width = shuffle_width(coded.sparkSession)
    spread = coded.repartitionByRange(width, *order).sortWithinPartitions(*order)

    def summary(conv, number, codes, turns, whole):
        code = "".join(codes)
        found = chunk_audits(code, "E" if whole else STATES)
        rank = {audit: i for i, audit in enumerate(sorted({a for _, a in found.values()}))}
        numbered = [t for t in turns if t is not None]
        return {"kind": "chunk", "conv_id": conv, "chunk": number, "pos": -1, "code": code, "role": None, "text": None, "payload": json.dumps({
            "ways": {k: (cost, rank[audit]) for k, (cost, audit) in found.items()}, "audits": sorted(rank, key=rank.get),
            "turns": (numbered[0], numbered[-1], len(set(numbered))) if numbered else None, "ends": (code[0], code[-2]),
            "counts": [codes_of.count(f) for codes_of in [code[1::2]] for f in "bdt"],
            "illegal": sum(code[k] + code[k + 2] not in ("su", "ua", "au") for k in range(0, len(code) - 2, 2))})}

    def run(batches):
        number = (TaskContext.get().partitionId() << 32) - 1
        open_, codes, turns, whole, last = None, [], [], False, None
        out, size = [], 0
        first = True
        for batch in batches:
            for conv, turn, role, text, code in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if open_ is None or open_ != (conv,) or len(codes) >= chunk:
                    if open_ is not None:
                        out.append(summary(open_[0], number, codes, turns, whole))
                    # a conversation that begins here starts in the start state only; the partition's first may go on from the one before
                    whole = not first and open_ != (conv,)
                    open_, codes, turns, first = (conv,), [], [], False
                    number += 1
                # x: first turn of several with its role and text; of equal rows, which stand together, the first is none
                fault = code[1] if code[1] != "x" else "d" if last == (conv, turn, role, text) else code[2]
                last = (conv, turn, role, text)
                out.append({"kind": "turn", "conv_id": conv, "chunk": number, "pos": len(codes), "code": code[0] + fault, "role": role,
                            "text": text, "payload": None})
                codes.append(code[0] + fault)
                turns.append(turn)
                size += len(text)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _CODED)
                    out, size = [], 0
        if open_ is not None:
            out.append(summary(open_[0], number, codes, turns, whole))
        yield pa.RecordBatch.from_pylist(out, _CODED)

    return spread.mapInArrow(run, CODED)


_CODED = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int32()), ("code", pa.string()),
                    ("role", pa.string()), ("text", pa.string()), ("payload", pa.string())])


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    key = F.xxhash64(F.col("conv_id").isNull(), "conv_id")
    return (df.repartition(shuffle_width(df.sparkSession), key)
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order))


def chosen(chunks: DataFrame) -> DataFrame:
    """The chunk rows with the audit that the best way takes; the first one of a conversation also has its counts (payload)."""

    def finish(conv, numbers, parts):
        cost, ways, insert = join_chunks([p["ways"] for p in parts])
        spans = [p["turns"] for p in parts if p["turns"]]
        distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        illegal = sum(p["illegal"] for p in parts) + sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
        head = {"gaps": spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0, "illegal": illegal, "cost": cost,
                "counts": [sum(p["counts"][i] for p in parts) for i in range(3)]}
        for i, (number, part, way) in enumerate(zip(numbers, parts, ways)):
            # (state before the chunk's first turn; audit)
            told = {"audit": part["audits"][part["ways"][way][1]] + ("I" if insert and i == len(parts) - 1 else ""), "state": way[0]}
            yield {"kind": "audit", "conv_id": conv, "chunk": number, "pos": -1, "code": None, "role": None, "text": None,
                   "payload": json.dumps(told | (head if i == 0 else {}))}

    def run(batches):
        open_, numbers, parts = None, [], []
        out = []
        for batch in batches:
            for conv, number, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if open_ != (conv,):
                    if open_ is not None:
                        out += finish(open_[0], numbers, parts)
                    open_, numbers, parts = (conv,), [], []
                numbers.append(number)
                parts.append(json.loads(payload))
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, _CODED)
                out = []
        if open_ is not None:
            out += finish(open_[0], numbers, parts)
        yield pa.RecordBatch.from_pylist(out, _CODED)

    return _by_conversation(chunks, "chunk").select("conv_id", "chunk", "payload").mapInArrow(run, CODED)


class _Writer:
    """Applies an audit to a stream of turns and hashes the repaired ones."""

    def __init__(self, conv):
        self.conv, self.digest, self.audit, self.head = conv, hashlib.sha256(), [], {}
        self.state, self.lines, self.edits = "E", 0, iter(())

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def insert(self) -> None:
        turn = _TURN[self.state]
        self.line("user" if turn == "u" else "assistant", "")
        self.state = _AFTER[turn]

    def begin(self, told: dict) -> None:
        self.finish_inserts()
        self.head = self.head or told
        self.audit.append(told["audit"])
        self.edits = iter(told["audit"])

    def finish_inserts(self) -> None:
        for _ in self.edits:                                   # only a last insert can be left
            self.insert()

    def turn(self, role: str, text: str) -> None:
        edit = next(self.edits)
        if edit == "I":
            self.insert()
            edit = next(self.edits)
        if edit == "K":
            self.line(role, text)
            self.state = "S" if role[0] == "s" else _AFTER[role[0]]
        elif edit == "R":
            turn = _TURN[self.state]
            self.line("user" if turn == "u" else "assistant", text)
            self.state = _AFTER[turn]

    def row(self) -> dict:
        self.finish_inserts()
        h = self.head
        return {"conv_id": self.conv, "gaps": h["gaps"], "blank": h["counts"][0], "duplicate": h["counts"][1], "truncated": h["counts"][2],
                "illegal": h["illegal"], "cost": h["cost"], "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """One row (REPAIR) per conversation that has turns."""
    columns = ("conv_id", "chunk", "pos", "role", "text", "payload")
    both = turns.select(*columns).unionAll(audits.select(*columns))

    def run(batches):
        writer, out = None, []
        for batch in batches:
            for conv, pos, role, text, payload in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if writer is None or writer.conv != conv:
                    if writer is not None:
                        out.append(writer.row())
                    writer = _Writer(conv)
                if pos < 0:
                    writer.begin(json.loads(payload))
                else:
                    writer.turn(role, text)
            if len(out) > 2048:
                yield pa.RecordBatch.from_pylist(out, _REPAIR)
                out = []
        if writer is not None:
            out.append(writer.row())
        yield pa.RecordBatch.from_pylist(out, _REPAIR)

    return _by_conversation(both, "chunk", "pos").mapInArrow(run, REPAIR)


_REPAIR = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                     ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """REPAIR for every conversation of (conv_id, turn, role, text)."""
    parts = stored(chunked(coded_turns(turns), chunk), "turns")
    audits = stored(chosen(parts.where("kind = 'chunk'")), "audits")
    return repaired(parts.where("kind = 'turn'"), audits)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by the crc32 of ``conv_id:turn``."""
    mark = F.expr("crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20")
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), mark.alias("m"))
    out = out.where("m <> 0").withColumns({
        "text": F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("m") == 4, "user").otherwise(F.col("role"))})
    return out.select("conv_id", "turn", "role", "text", F.explode(F.expr("IF(m = 3, array(0, 1), array(0))")).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair(damaged(rows)).select(*_key("conv_id"), *REPAIR.replace(" bigint", "").replace(" string", "").split(", ")[1:])
    every = rows.select("conv_id").distinct().select("conv_id", *_key("conv_id"))
    zero = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    other = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = every.join(done, ["c0", "c1"], "left")
    return joined.select("conv_id", *(F.coalesce(c, v.cast("bigint")).alias(c) for c, v in zero.items()),
                         *(F.coalesce(c, v).alias(c) for c, v in other.items()))
