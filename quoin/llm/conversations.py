"""Repair of the order of turns, at the least cost.

A conversation is well formed if the initials of its roles match (s?(ua)+)?. Rows may be kept,
deleted, given another role, or new ones put in, each at a price. The search works in layers of cost:
for each turn a word of bits says, layer by layer, from which states of the grammar the rest of the
conversation can be repaired at just that cost. An edit moves a word to the turn before by a few shifts
and masks, all states and layers at once; the first layer that holds the start state is the cost, and
following the bits forward, least initial first, gives the audit.

From no state is the rest more than 7 dearer than from another (whatever is done from one can be done
from the other after at most one deleted row and one inserted turn), so 16 layers above a turn's least
cost are enough at any length: a word has 64 bits.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
SPACES = " \t\n\x0b\x0c\r"
#: Faults of a row, and a row's code: fault * 4 + place of the role's initial in ROLES (3: none of them).
CLEAN, CUT_SHORT, BLANK, DUPLICATE = range(4)
ROLES = "sua"

# States: 0 nothing yet, 1 after s, 2 within a pair, 3 after a pair; bit 4 * layer + state.
_ALL = (1 << 64) - 1
_IN = [0x1111111111111111 << s for s in range(4)]
_AFTER = [[1, 2, None, None], [None, 2, None, None], [None, None, 3, None], [None, 2, None, None]]  # [state][s, u, a, other]
_NEXT = [2, 2, 3, 2]  # after a turn of the role that may follow
_NAME = ["user", "user", "assistant", "user"]


def _before(word: int, initial: int) -> int:
    """The states from which a turn of this initial leads to the word's states."""
    if initial == 0:
        return (word & _IN[1]) >> 1
    if initial == 1:
        two = word & _IN[2]
        return two >> 2 | two >> 1 | two << 1
    return (word & _IN[3]) >> 1 if initial == 2 else 0


def _any(word: int) -> int:
    return _before(word, 1) | _before(word, 2)


def _closed(word: int) -> int:
    """With up to two turns put in before."""
    word |= _any(word) << 4 * INSERT
    return (word | _any(word) << 4 * INSERT) & _ALL


def layers(codes: bytes) -> tuple[array, bytearray]:
    """Each turn's word, and by how much its first layer is above the next turn's. One word more stands for the end."""
    words, steps = array("Q", bytes(8 * (len(codes) + 1))), bytearray(len(codes) + 1)
    word = words[-1] = _closed(0b1001)
    for i in range(len(codes) - 1, -1, -1):
        fault, initial = divmod(codes[i], 4)
        new = word << 4 * DELETE
        if fault < BLANK:
            keep = _before(word, initial) | _any(word) << 4 * REROLE
            new |= keep << 4 * TRUNCATED if fault == CUT_SHORT else keep
        step = ((new & -new).bit_length() - 1) // 4
        word = words[i] = _closed(new >> 4 * step)
        steps[i] = step
    return words, steps


class Trace:
    """Follows the cheapest edits from the first turn on, of equal ones the least initial."""

    def __init__(self, codes: bytes):
        self.codes, (self.words, self.steps) = codes, layers(codes)
        start = self.words[0] & _IN[0]
        self.above = ((start & -start).bit_length() - 1) // 4  # of the cost still to pay, what is above this turn's first layer
        self.cost = self.above + sum(self.steps)
        self.at = self.state = 0

    def _has(self, at: int, state: int, layer: int) -> bool:
        return 0 <= layer < 16 and bool(self.words[at] >> (4 * layer + state) & 1)

    def edit(self) -> tuple[str, str | None]:
        """The next edit's initial and, where it gives a turn another role, that role. ('', None) at the end."""
        i, s, c = self.at, self.state, self.above
        end = i == len(self.codes)
        if end and s in (0, 3) and c == 0:
            return "", None
        if not end and self._has(i + 1, s, c + self.steps[i] - DELETE):
            self.at, self.above = i + 1, c + self.steps[i] - DELETE
            return "D", None
        if self._has(i, _NEXT[s], c - INSERT):
            self.state, self.above = _NEXT[s], c - INSERT
            return "I", _NAME[s]
        fault, initial = divmod(self.codes[i], 4)
        c += self.steps[i] - (TRUNCATED if fault == CUT_SHORT else 0)
        kept = _AFTER[s][initial]
        self.at = i + 1
        if kept is not None and self._has(i + 1, kept, c):
            self.state, self.above = kept, c
            return "K", None
        self.state, self.above = _NEXT[s], c - REROLE
        return "R", _NAME[s]


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """One conversation of the stream: first all its rows' codes and turns, then all its rows with texts."""

    def __init__(self, key):
        self.key, self.codes = key, bytearray()
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.trace, self.audit, self.hash, self.place = None, [], hashlib.sha256(), 0

    def outline(self, code: int, turn: int | None) -> None:
        if self.codes and (self.codes[-1] % 4, code % 4) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.codes.append(code)
        self.faults[code // 4] += 1
        if turn is not None and turn != self.last:  # turns come in ascending order
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1

    def _put(self, edit: str, role: str, text: str):
        self.hash.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return self.key, self.place, edit, role, text

    def edits(self, role: str | None = None, text: str | None = None):
        """The turns up to and with this row; with no row, those that follow the last one."""
        self.trace = self.trace or Trace(bytes(self.codes))
        while True:
            edit, given = self.trace.edit()
            self.audit.append(edit)
            if edit == "I":
                yield self._put(edit, given, "")
                continue
            if edit in ("K", "R"):
                yield self._put(edit, given or role, text)
            return

    def report(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        _, truncated, blank, duplicate = (self.faults[k] for k in (CLEAN, CUT_SHORT, BLANK, DUPLICATE))
        return self.key, gaps, blank, duplicate, truncated, self.illegal, self.trace.cost, "".join(self.audit), self.hash.hexdigest()


def _sweeps(rows: DataFrame) -> DataFrame:
    """Each conversation's rows twice over, in order: without text but with their codes, then with text.

    One shuffle, by conversation; duplicates, places and both sweeps are sorts within it, which spill."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.repartition("conv").withColumn("bare", F.when(bare == "", 0).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 2).otherwise(1))
    by_turn = [F.col("turn").asc_nulls_first()]
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "live", "role", "text").orderBy(*by_turn)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv", "live").orderBy(*by_turn, "role", "text")))
    fault = F.when(F.col("bare") == 0, BLANK).when(F.col("copy") > 1, DUPLICATE).when(F.col("bare") == 1, CUT_SHORT).otherwise(CLEAN)
    initial = F.when(F.col("role") == "", 3).otherwise(F.instr(F.lit(ROLES), F.left("role", F.lit(1))) - 1)
    code = F.when(F.col("live"), fault * 4 + F.when(initial < 0, 3).otherwise(initial))
    rows = rows.select("conv", "place", "turn", "role", "text", code.cast("int").alias("code"), F.explode(F.when(F.col("live"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("sweep"))
    told = F.col("sweep") == 1
    rows = rows.select("conv", "sweep", "place", "code", "turn", F.when(told, F.col("role")).alias("role"), F.when(told, F.col("text")).alias("text"))
    return rows.sortWithinPartitions(F.col("conv").asc_nulls_first(), "sweep", "place")


def _flow(rows: DataFrame, key: str, turns: bool) -> DataFrame:
    kind = rows.schema[key].dataType
    swept = _sweeps(rows.withColumnRenamed(key, "conv"))
    fields = [T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())] if turns else [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    schema = T.StructType([T.StructField(key, kind), *fields])

    def run(batches):
        import pyarrow as pa

        held, size, names, types = [], 0, [f.name for f in schema], None

        def full():
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def ends(conversation):
            turns_left = list(conversation.edits())
            return turns_left if turns else [conversation.report()]

        now = None
        for batch in batches:
            if types is None:
                own = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
                types = [batch.schema.field(0).type, *(own[f.dataType.simpleString()] for f in fields)]
            for conv, sweep, _, code, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        held.extend(ends(now))
                    now = _Conversation(conv)
                if sweep:
                    for row in now.edits(role, text):
                        if turns:
                            held.append(row)
                            size += len(row[4])
                elif code is not None:
                    now.outline(code, turn)
                if len(held) >= 1000 or size >= 1 << 22:
                    yield full()
                    size = 0
        if now is not None:
            held.extend(ends(now))
        if held:
            yield full()

    return swept.mapInArrow(run, schema)


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str, live: str | None) -> DataFrame:
    there = F.lit(True) if live is None else F.coalesce(F.col(live), F.lit(False))
    text_or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv), F.col(turn).cast("long").alias("turn"), text_or_space(role).alias("role"), text_or_space(text).alias("text"), there.alias("live"))


def reports(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """One row for each conversation: faults of its rows, the least cost of a repair, the edits' initials
    (audit; of equally cheap ones the least) and the SHA-256 of the repaired `role:text` lines.

    Rows are taken by turn (nulls first), rows of one turn by role and text. A row's first fault counts:
    blank, duplicate (role and text seen earlier in the conversation), truncated. A role or text of null counts
    as one space; a role of another initial than s, u, a (an empty one has none) can't be kept. Rows whose
    column `live`, if one is named, isn't true (see `damage`) don't count, but their conversation is reported: zeros, an empty audit,
    the hash of nothing. Rows without conversation are one conversation of key null. Extra columns are ignored;
    an empty table gives no rows.

    A conversation streams through one task, as its hash must; the task holds eleven bytes a row, no texts."""
    return _flow(_plain(rows, conv, turn, role, text, live), conv, turns=False)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """The turns of the repaired conversations: place (from 1), edit (K kept, R given another role, I put in),
    role, text. The same rows as `reports` are read, in the same order; deleted rows are left out."""
    return _flow(_plain(rows, conv, turn, role, text, live), conv, turns=True)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with known faults, by crc32 of `conv:turn` modulo 20: 0 drops the row (live is false), 1 empties
    its text, 2 removes its . ! ?, 3 repeats it, 4 sets role user. Nulls count as one space, but for ids and turns."""
    text_or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_or_space(conv), F.lit(":"), text_or_space(turn)).cast("binary")), F.lit(20))
    rows = rows.select(F.col(conv), F.col(turn), text_or_space(role).alias("_role"), text_or_space(text).alias("_text"), kind.alias("_kind"))
    live = F.explode(F.when(F.col("_kind") == 0, F.array(F.lit(False))).when(F.col("_kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True))))
    return rows.select(
        conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias(role),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias(text), live.alias("live"),
    )
