"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate properly.

A conversation's rows are kept, given another role, deleted or preceded by inserted ones, until the initials of its roles read ``(s?(ua)+)?``.
Among the cheapest edits the audit, their initials in order, is the least in ASCII.

Both decisions are one: a path through the graph of (rows left, state of the pattern) weighs a single integer, whose high digits are its cost and
whose low digits, three bits each from the highest place down, are its audit letters, zeros after the last. The smallest integer is the
cheapest path with the least audit. Weights are found from the last row to the first: an edge in front adds its cost, moves the letters one place
down and puts its own in the first place. At most two rows are ever inserted in one place, as a third would repeat a state.

A long conversation is cut into blocks of ``BLOCK`` rows, so that integers stay short. Costs of what follows a block are
found first, by the same programme without letters; then each block is decided with them as its last weights. Letters of inserted rows
stand before the letter of the row that they precede, so blocks end with the letter of a row, no audit of a block is the beginning of
another, and the least of each block make up the least of all.

In Spark: rows are numbered by a range sort of narrow rows (roles, flags and a digest of the text); duplicates are found by the number of the
first of each kind, joined on unique numbers; rows become one character each, gathered by block, then by conversation (an audit is such a string
itself). Whole texts are shuffled once, sorted by conversation, and hashed as a stream: a conversation of any length needs no more memory than
one batch, though it passes through one task, as its SHA-256 is one chain.

* Nulls of conv_id, turn, role and text count as one space, in damage and in texts; null turns come first and are no turns in ``gaps``. Rows of a null
  conv_id are one conversation.
* Rows of one turn stand in the order of role and of the SHA-256 of their text, each as given; repeated rows count as often as they are there.
* A role without a first letter, or with another than s, u or a, must be changed or deleted.
* A conversation without rows after damage has zeros, an empty audit and the hash of the empty string. An empty table gives an empty result.
* Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import cut, for_python

#: Rows whose letters share one integer.
BLOCK = 256
# What edits cost, and the pattern of initials as states: start, after s, after u, after a.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = [USER, USER, ASSISTANT, USER]
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}  # in ASCII order; 0 is no letter
WIDTH = 3
SPACES = " \t\n\x0b\f\r"

#: A row as one character: initial (s, u, a, other) and fault (none, blank, duplicate, truncated).
FAULTS = ["none", "blank", "duplicate", "truncated"]
INITIALS = "sua"


def code_of(initial: str, fault: str) -> str:
    return chr(65 + 4 * (INITIALS.index(initial) if initial in INITIALS and initial else 3) + FAULTS.index(fault))


def _edges(code: str) -> list[list[tuple[str, int, int]]]:
    """For each state: (letter, cost, next state) of the edits of a row."""
    initial, fault = divmod(ord(code) - 65, 4)
    out = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            more = TRUNCATED if FAULTS[fault] == "truncated" else 0
            if initial + 1 == NEEDED[state] or (initial == 0 and state == START):
                own.append(("K", more, initial + 1))
            own.append(("R", REROLE + more, NEEDED[state]))
        out.append(own)
    return out


_EDGES = {chr(65 + k): _edges(chr(65 + k)) for k in range(16)}
#: More than any path costs.
_NEVER = 1 << 62


class Weights:
    """Weights with room for ``places`` letters; none for plain costs."""

    def __init__(self, places: int) -> None:
        self.bits = WIDTH * places
        self.low = (1 << self.bits) - 1
        self.first = {k: v << (self.bits - WIDTH) if places else 0 for k, v in LETTERS.items()}
        step = lambda letter, cost: (cost << self.bits) + self.first[letter]
        self.edges = {c: [[(step(letter, cost), to) for letter, cost, to in own] for own in states] for c, states in _EDGES.items()}
        self.insert = step("I", INSERT)

    def of(self, costs: Sequence[int]) -> list[int]:
        return [c << self.bits for c in costs]

    def moved(self, weights: list[int]) -> list[int]:
        """Letters one place down; costs as they are."""
        return [w - (letters := w & self.low) + (letters >> WIDTH) for w in weights]

    def inserted(self, weights: list[int]) -> list[int]:
        """With up to two inserted rows in front."""
        out = weights
        for _ in range(2):
            after = self.moved(out)
            out = [min(w, self.insert + after[NEEDED[q]]) for q, w in enumerate(weights)]
        return out

    def before(self, code: str, weights: list[int]) -> list[int]:
        after = self.moved(weights)
        return self.inserted([min(step + after[to] for step, to in own) for own in self.edges[code]])

    def letters(self, weight: int) -> str:
        names = {v: k for k, v in LETTERS.items()}
        out, at = [], self.bits - WIDTH
        while at >= 0 and (x := weight >> at & 7):
            out.append(names[x])
            at -= WIDTH
        return "".join(out)


_PLAIN = Weights(0)
_ACCEPTED = [0, _NEVER, _NEVER, 0]


def _decided(codes: str, start: int, last: list[int], final: bool) -> str:
    """Letters of the best path through a block from a state, with the costs of what follows each state at its end."""
    weigh = Weights(3 * len(codes) + 2)
    weights = weigh.of(last)
    if final:
        weights = weigh.inserted(weights)
    for code in reversed(codes):
        weights = weigh.before(code, weights)
    return weigh.letters(weights[start])


def ended(codes: str, letters: str, state: int) -> tuple[int, int, list[int]]:
    """Cost of the edits, the state after them and, by letter but D, the state of the row they leave."""
    cost, left, row = 0, [], 0
    for letter in letters:
        if letter == "I":
            cost, state = cost + INSERT, NEEDED[state]
        else:
            _, price, state = next(e for e in _EDGES[codes[row]][state] if e[0] == letter)
            cost, row = cost + price, row + 1
        if letter != "D":
            left.append(state)
    return cost, state, left


def repaired(blocks: Sequence[str]) -> tuple[int, str, list[int]]:
    """Cost, audit and roles (states) of the rows that are left, of a conversation's codes in blocks."""
    follows = [_PLAIN.inserted(_ACCEPTED)]
    for codes in reversed(blocks):
        weights = follows[-1]
        for code in reversed(codes):
            weights = _PLAIN.before(code, weights)
        follows.append(weights)
    follows.reverse()
    if not blocks:
        return 0, "", []
    cost, state, audit, left = 0, START, [], []
    for k, codes in enumerate(blocks):
        final = k == len(blocks) - 1
        letters = _decided(codes, state, _ACCEPTED if final else follows[k + 1], final)
        own, state, roles = ended(codes, letters, state)
        cost += own
        audit.append(letters)
        left += roles
    return cost, "".join(audit), left


def illegal(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = [(ord(c) - 65) // 4 for c in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))


# -- rows ----------------------------------------------------------------------

_ORDER = ["turn", "role0", "digest0", "copy"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, the order of rows within a turn, and ``dropped`` for rows that only tell of their conversation."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), _text(role).alias("role0"), _text(text).alias("text0"))
    kind = (F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % 20).cast("int")
    rows = rows.withColumns({"kind": kind, "digest0": F.unhex(F.sha2("text0", 256))})
    told = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0"))
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role0")), "text": told, "dropped": F.col("kind") == 0})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", *_ORDER[:-1], "role", "text", "dropped", F.explode(copies).alias("copy"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Narrow rows with their ``place`` in the order of (conv_id, turn, ...), written once, as ranges are drawn anew in each run."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(stripped == "", "blank").when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated")
    narrow = rows.select(
        "conv_id", *_ORDER, "dropped", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
        F.unhex(F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256)).alias("same"),
    )
    keys = ["conv_id", *_ORDER]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ranged.select("conv_id", "turn", "dropped", "initial", "fault", "same", F.monotonically_increasing_id().alias("place")))


def coded(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and ``blocks`` of (codes, turns, first_turn, last_turn) in order, none without rows."""
    numbered = _numbered(rows)
    first = numbered.filter(~F.col("dropped")).groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    told = numbered.join(first, "place", "left")
    fault = F.when(F.col("fault") == "blank", 1).when(F.col("first").isNull(), 2).when(F.col("fault") == "truncated", 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(~F.col("dropped"), F.char(65 + 4 * initial + fault))
    own = told.select("conv_id", "turn", "place", "dropped", code.alias("code"), F.floor(F.col("place") / BLOCK).alias("block"))
    present = ~F.col("dropped")
    turns = F.when(present, F.col("turn"))
    blocks = own.groupBy("conv_id", "block").agg(  # at most BLOCK rows each
        F.array_sort(F.collect_list(F.when(present, F.struct("place", "code")))).alias("rows"), F.size(F.collect_set(turns)).cast("long").alias("turns"), F.min(turns).alias("first_turn"), F.max(turns).alias("last_turn")
    )
    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    entry = F.when(codes != "", F.struct("block", codes.alias("codes"), "turns", "first_turn", "last_turn"))
    return blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))


_PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _planned(blocks: list[dict]) -> tuple:
    codes = [b["codes"] for b in blocks]
    whole = "".join(codes)
    faults = [sum(whole.count(chr(65 + 4 * i + k)) for i in range(4)) for k in (1, 2, 3)]
    known = [b for b in blocks if b["first_turn"] is not None]
    turns = sum(b["turns"] for b in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
    cost, audit, _ = repaired(codes)
    return gaps, *faults, illegal(whole), cost, audit


# -- the operator --------------------------------------------------------------


class _Hash:
    """The digest of one conversation as its rows stream by, after the plan for them."""

    def __init__(self, conversation, plan: tuple) -> None:
        self.conversation, self.plan, self.audit, self.at, self.state = conversation, plan, plan[-1], 0, START
        self.sha, self.begun = hashlib.sha256(), False

    def _line(self, role: str, text: bytes) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.begun = True
        self.sha.update(role.encode() + b":")
        self.sha.update(text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEEDED[self.state], self.at + 1
            self._line(ROLES[self.state], b"")

    def add(self, role: str, text: bytes) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = NEEDED[self.state]
            self._line(ROLES[self.state], text)
        elif letter == "K":
            self.state = SYSTEM if role[0] == "s" else NEEDED[self.state]
            self._line(role, text)

    def told(self) -> tuple:
        self._inserted()
        return (self.conversation, *self.plan, self.sha.hexdigest())


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    for_python(conversations.sparkSession, 4)
    rows = damaged(conversations, conv_id, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in _PLAN.split(", "))]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()]
        for b in batches:
            told = list(zip(*(_planned(blocks) for blocks in b.column(1).to_pylist()))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), t) for x, t in zip(told, types))], names)

    planned = coded(rows).mapInArrow(plan, f"conv_id {kind}, {_PLAN}")
    texts = rows.filter(~F.col("dropped")).select("conv_id", *_ORDER, "role", F.col("text").cast("binary").alias("text"))
    both = planned.select("conv_id", F.struct(*names[1:]).alias("plan")).unionByName(texts, allowMissingColumns=True)
    # The plan stands before the rows: alone it has no copy number.
    both = both.withColumn("own", F.col("copy").isNotNull())
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "own", *_ORDER).select("conv_id", "plan", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, now = [], [], None
        types = [pa.int64()] * 6 + [pa.string()] * 2

        def told() -> pa.RecordBatch:
            columns = zip(*(x[1:] for x in out))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], ids[0]), *(pa.array(list(x), t) for x, t in zip(columns, types))], [*names, "repaired_sha256"])

        for b in batches:
            ids[:] = [b.schema.field(0).type]
            for one, plan_, role_, text_ in zip(*(c.to_pylist() for c in b.columns)):
                if plan_ is not None:
                    if now is not None:
                        out.append(now.told())
                    now = _Hash(one, tuple(plan_.values()))
                else:
                    now.add(role_, text_)
            if len(out) > 1_000:
                yield told()
                out = []
        if now is not None:
            out.append(now.told())
        if out:
            yield told()

    return dealt.mapInArrow(stream, f"conv_id {kind}, {_PLAN}, repaired_sha256 string")
