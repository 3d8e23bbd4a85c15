"""Repair of conversation structure: cheapest edits to turns that alternate between user and assistant.

A row is judged by role initial (s, u, a, other) and fault: blank, duplicate (role and text seen earlier in
the conversation) or truncated (no closing mark).  Kept or new roles must read ``(s?(ua)+)?``.  Keep costs 0,
rerole to user or assistant 1, delete 2 (a must for blank and duplicate rows), insert an empty turn 5 at
any place; a truncated row that stays costs 5 more.  Among cheapest edits the least audit by ASCII wins.

The costs are a shortest path over four states (nothing yet, after s, u, a).  Equal neighbours of one role
and fault form a run; a run of n multiplies the costs to go by the n-th min-plus power of its 4 x 4 matrix,
put together from remembered powers of two.  The choices are then unrolled from the front: the least
letter that keeps the cost; long runs are halved by the same powers.

In Spark: equal rows are counted before anything meets, repeats are found on hashes of texts, then rows are
range-partitioned by conversation and turn and streamed.  A conversation that lies within one partition is finished
there.  Others are cut into pieces of at most ``ROWS`` rows and ``BYTES`` bytes, each with its 4 x 4 costs and
the audits behind them; only these matrices meet per conversation to settle where each piece begins and ends.
The digest of a repaired text is sequential by definition, so its pieces pass one task, one after the other.

Cases: null roles and texts count as one space; null turns come first and leave the gaps; null conversation
ids form one conversation; rows of one turn are taken by role and then by hash of the text; a conversation
without rows gives zeros, an empty audit and the digest of the empty text; an empty table gives no rows;
further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import arrow_type, stored, text_key

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROWS, BYTES = 4096, 4 << 20
#: Unrolled runs that a task remembers.
MEMORY = 100_000
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after one more turn of its own making: a user turn, or an assistant turn after a user.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: State after keeping a row, by role class (s, u, a, other).
KEPT = (
    (AFTER_S, None, None, None),
    (AFTER_U, AFTER_U, None, AFTER_U),
    (None, None, AFTER_A, None),
    (None, None, None, None),
)
CLASSES = {"s": 0, "u": 1, "a": 2}
SOUND, MUST_GO, SHORT = range(3)
#: Costs of the turns that end a conversation well.
ENDING = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}


def options(symbol: int, state: int) -> list[tuple[str, int, int, bool]]:
    """Edits at a row in the order of their letters: letter, cost, next state, whether the row is used up."""
    role, fault = divmod(symbol, 3)
    found = [("D", DELETE, state, True), ("I", INSERT, NEXT[state], False)]
    if fault != MUST_GO:
        extra = CUT_OFF if fault == SHORT else 0
        if KEPT[role][state] is not None:
            found.append(("K", KEEP + extra, KEPT[role][state], True))
        found.append(("R", REROLE + extra, NEXT[state], True))
    return found


def product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@cache
def power(symbol: int, k: int):
    """Min-plus matrix of 2^k equal rows."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = []
    for state in range(4):
        costs, at, paid = [FAR] * 4, state, 0
        for _ in range(4):  # inserts before the row; a fourth would only go round
            for letter, cost, to, used in options(symbol, at):
                if used:
                    costs[to] = min(costs[to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


def before(symbol: int, n: int, after: tuple) -> tuple:
    """Costs to go before ``n`` equal rows, from those after them."""
    k = 0
    while n:
        if n & 1:
            m = power(symbol, k)
            after = tuple(min(m[i][j] + after[j] for j in range(4)) for i in range(4))
        n >>= 1
        k += 1
    return tuple(min(v, FAR) for v in after)


class Solver:
    """Cheapest audits of rows given as runs of (symbol, number)."""

    def __init__(self):
        self.known: dict[tuple, tuple[str, int]] = {}

    def run(self, symbol: int, n: int, state: int, after: tuple) -> tuple[str, int]:
        """Least audit of a run from ``state``, and the state behind it."""
        low = min(after)
        key = (symbol, n, state, tuple(v - low if v < FAR else FAR for v in after))
        known = self.known.get(key)
        if known is None:
            if n > 1:
                first, middle = self.run(symbol, n // 2, state, before(symbol, n - n // 2, after))
                second, end = self.run(symbol, n - n // 2, middle, after)
                known = first + second, end
            else:
                known = self.row(symbol, state, after)
            if len(self.known) >= MEMORY:
                self.known.clear()
            if n <= ROWS:
                self.known[key] = known
        return known

    @staticmethod
    def row(symbol: int, state: int, after: tuple) -> tuple[str, int]:
        here = before(symbol, 1, after)
        letters = ""
        while True:
            for letter, cost, to, used in options(symbol, state):
                if cost + (after if used else here)[to] == here[state]:
                    letters += letter
                    state = to
                    break
            if used:
                return letters, state

    def audit(self, runs: list[tuple[int, int]], state: int, after: tuple) -> tuple[int, str, int]:
        """Cost to go, least audit and last state of ``runs`` entered in ``state``."""
        ahead = [after]
        for symbol, n in reversed(runs):
            ahead.append(before(symbol, n, ahead[-1]))
        total = ahead.pop()[state]
        if total >= FAR:
            return FAR, "", state
        letters = []
        for symbol, n in runs:
            part, state = self.run(symbol, n, state, ahead.pop())
            letters.append(part)
        return total, "".join(letters), state


def ending(state: int) -> str:
    return {START: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}[state]


def edited(audit: str, state: int, rows) -> Iterator[str]:
    """``role:text`` of the turns that an audit leaves; ``rows`` gives role and text of each row."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{ROLE[state]}:"
            continue
        role, text = next(rows)
        if letter == "K":
            state = KEPT[CLASSES.get(role[:1], 3)][state]
            yield f"{role}:{text}"
        elif letter == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"


class Piece:
    """Rows of one conversation in a row, as far as they are held at once."""

    def __init__(self):
        self.roles, self.texts, self.copies, self.runs = [], [], [], []
        self.rows = self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def full(self) -> bool:
        return self.rows >= ROWS or self.bytes >= BYTES

    def add(self, turn, role: str, text: str, n: int, fault: int, repeated: bool) -> None:
        """``n`` equal rows; ``fault`` 1 for blank, 2 for truncated."""
        initial = role[:1]
        kind = CLASSES.get(initial, 3) * 3
        if fault == 1:
            self.blank += n
            self.push(kind + MUST_GO, n)
        else:
            repeats = n if repeated else n - 1
            self.duplicate += repeats
            if not repeated:
                self.truncated += fault == 2
                self.push(kind + (SHORT if fault == 2 else SOUND), 1)
            if repeats:
                self.push(kind + MUST_GO, repeats)
        self.illegal += (n - 1) + (self.last is not None and self.last + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(n)
        self.rows += n
        self.bytes += len(text) + len(role)

    def push(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            n += self.runs.pop()[1]
        self.runs.append((symbol, n))

    def pairs(self):
        return expanded(self.roles, self.texts, self.copies)


def expanded(roles, texts, copies):
    for role, text, n in zip(roles, texts, copies, strict=True):
        for _ in range(n):
            yield role, text


def gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows with faults of five kinds, by a checksum of conversation and turn: conversation, turn, role, text,
    ``n`` (copies) and ``gone`` (rows that were dropped, kept so that their conversations stay known)."""
    def spaced(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    key = F.concat(spaced(rows[conv_col]), F.lit(":"), spaced(rows[turn_col]))
    kind = F.crc32(key.cast("binary")) % 20
    text = spaced(rows[text_col])
    return rows.select(
        rows[conv_col].alias("conv_id"), rows[turn_col].alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(rows[role_col])).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"), (kind == 0).alias("gone"),
    )


def prepared(rows: DataFrame) -> DataFrame:
    """Counted rows with fault and repeat flags, keys without nulls; dropped rows count 0."""
    gone = F.col("gone")
    keyed = rows.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("cn"),
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.col("turn").isNotNull().alias("tn"),
        F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
        F.when(gone, 0).otherwise(F.col("n")).cast("long").alias("n"),
    )
    keyed = keyed.select("*", *text_key(F.col("text")))
    same = ["c", "cn", "tn", "t", "role", "k1", "k2"]
    counted = keyed.groupBy(*same).agg(
        F.max("conv_id").alias("conv_id"), F.max("text").alias("text"), F.sum("n").alias("n"), F.max("turn").alias("turn")
    )
    kind = ["c", "cn", "role", "k1", "k2"]
    place = F.struct("tn", "t")
    slim = keyed.where("n > 0").select(*kind, "tn", "t").groupBy(*kind, "tn", "t").agg(F.lit(1).alias("one"))
    first = slim.groupBy(*kind).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = (
        slim.join(first, kind).where(place > F.col("first")).select(*kind, "tn", "t")
        .withColumn("repeated", F.lit(True))
    )
    rest = F.rtrim("text", F.lit(BLANKS))
    return counted.join(later, same, "left").select(
        "conv_id", "c", "cn", "tn", "t", "turn", "role", "k1", "k2", "text", "n",
        F.coalesce("repeated", F.lit(False)).alias("repeated"),
        F.when(rest == "", 1).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2).alias("fault"),
    )


def streamed(ordered: DataFrame, id_type: T.DataType) -> DataFrame:
    """Finished conversations and pieces of those that may go on in another partition or chunk."""
    fields = [
        ("conv_id", id_type), ("c", T.StringType()), ("cn", T.BooleanType()), ("part", T.LongType()), ("seq", T.LongType()),
        ("open", T.BooleanType()), *((name, T.LongType()) for name in COUNTS),
        ("audit", T.StringType()), ("repaired_sha256", T.StringType()),
        ("first", T.StringType()), ("last", T.StringType()), ("low", T.LongType()), ("high", T.LongType()), ("turns", T.LongType()),
        ("costs", T.ArrayType(T.LongType())), ("ranks", T.ArrayType(T.IntegerType())), ("audits", T.ArrayType(T.StringType())),
        ("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())), ("copies", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = {n: arrow_type(t) for n, t in fields}

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        solver = Solver()
        ready: list[dict] = []

        def emit(key, piece: Piece, seq: int, is_open: bool) -> None:
            row = dict.fromkeys(kinds) | {"conv_id": key[0], "c": key[1], "cn": key[2], "part": part, "seq": seq, "open": is_open}
            row |= {"blank": piece.blank, "duplicate": piece.duplicate, "truncated": piece.truncated, "illegal": piece.illegal}
            if is_open:
                paths = [
                    [solver.audit(piece.runs, q, tuple(0 if e == end else FAR for e in range(4))) for end in range(4)]
                    for q in range(4)
                ]
                row |= {"first": piece.first, "last": piece.last, "low": piece.low, "high": piece.high, "turns": piece.turns}
                row |= {"roles": piece.roles, "texts": piece.texts, "copies": piece.copies}
                row["costs"] = [p[0] for q in paths for p in q]
                row["audits"] = [p[1] for q in paths for p in q]
                row["ranks"] = [sorted(p[1] for p in q).index(p[1]) for q in paths for p in q]
            else:
                cost, audit, last = solver.audit(piece.runs, START, ENDING)
                audit += ending(last)
                text = "\n".join(edited(audit, START, piece.pairs()))
                row |= {"gaps": gaps(piece.low, piece.high, piece.turns), "cost": cost, "audit": audit}
                row["repaired_sha256"] = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
            ready.append(row)

        def packed():
            made = pa.RecordBatch.from_arrays([pa.array([r[n] for r in ready], k) for n, k in kinds.items()], names=list(kinds))
            ready.clear()
            return made

        key, piece, seq, first = None, Piece(), 0, True
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, c, cn, turn, role, text, n, fault, repeated in zip(*columns, strict=True):
                if key is None or (c, cn) != key[1:]:
                    if key is not None:
                        emit(key, piece, seq, first or seq > 0)
                        first = False
                    key, piece, seq = (conv, c, cn), Piece(), 0
                while n:
                    if piece.full():
                        emit(key, piece, seq, True)
                        piece, seq = Piece(), seq + 1
                    some = min(n, ROWS)
                    piece.add(turn, role, text, some, fault, repeated)
                    n, repeated = n - some, True
                if len(ready) >= 1000 or (ready and ready[-1]["open"]):
                    yield packed()
        if key is not None:
            emit(key, piece, seq, True)
        if ready:
            yield packed()

    columns = ["conv_id", "c", "cn", "turn", "role", "text", "n", "fault", "repeated"]
    return ordered.select(*columns).mapInArrow(run, schema)


def settle(pieces: DataFrame, id_type: T.DataType) -> DataFrame:
    """Where each piece of a conversation begins and ends, and the counts of the conversation, from matrices alone."""
    narrow = pieces.select("c", "cn", "part", "seq", *COUNTS[1:5], "first", "last", "low", "high", "turns", "costs", "ranks")
    schema = (
        "c string, cn boolean, part long, seq long, entry int, leave int, is_last boolean, "
        + ", ".join(f"{n} long" for n in COUNTS)
    )

    def run(rows):
        rows = rows.sort_values(["part", "seq"])
        costs = [[[int(v) for v in c[q * 4 : q * 4 + 4]] for q in range(4)] for c in rows["costs"]]
        ahead = [ENDING]
        for matrix in reversed(costs):
            ahead.append(tuple(min(FAR, *(matrix[q][e] + ahead[-1][e] for e in range(4))) for q in range(4)))
        ahead.reverse()
        state, entries, leaves = START, [], []
        for matrix, ranks, after in zip(costs, rows["ranks"], ahead[1:], strict=True):
            entries.append(state)
            state = min(range(4), key=lambda e: (matrix[state][e] + after[e], ranks[state * 4 + e]))
            leaves.append(state)
        illegal, turns, last, low, high = int(rows["illegal"].sum()), 0, None, None, None
        for f, e, a, b, n in zip(rows["first"], rows["last"], rows["low"], rows["high"], rows["turns"], strict=True):
            if f is not None:
                illegal += last is not None and last + f not in LEGAL
                last = e
            if n:
                turns += int(n) - (high == int(a))
                low, high = int(a) if low is None else low, int(b)
        done = rows[["c", "cn", "part", "seq"]].copy()
        done["entry"], done["leave"] = entries, leaves
        done["is_last"] = [False] * (len(rows) - 1) + [True]
        for name in ("blank", "duplicate", "truncated"):
            done[name] = int(rows[name].sum())
        done["gaps"], done["illegal"], done["cost"] = gaps(low, high, turns), illegal, ahead[0][START]
        return done[["c", "cn", "part", "seq", "entry", "leave", "is_last", *COUNTS]]

    return narrow.groupBy("c", "cn").applyInPandas(run, schema)


def joined(pieces: DataFrame, settled: DataFrame, id_type: T.DataType) -> DataFrame:
    """The conversations of several pieces: audits put together, digests taken piece by piece."""
    key = ["c", "cn", "part", "seq"]
    placed = pieces.select(*key, "conv_id", "audits", "roles", "texts", "copies").join(settled, key)
    chosen = placed.select(
        *key, "conv_id", "entry", F.get("audits", F.col("entry") * 4 + F.col("leave")).alias("audit"),
        "leave", "is_last", "roles", "texts", "copies", *COUNTS,
    )
    fields = [("conv_id", id_type), *((n, T.LongType()) for n in COUNTS), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [arrow_type(t) for _, t in fields]

    def run(batches):
        digest, audit, some = hashlib.sha256(), [], False
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                letters = row["audit"] + (ending(row["leave"]) if row["is_last"] else "")
                audit.append(letters)
                for turn in edited(letters, row["entry"], expanded(row["roles"], row["texts"], row["copies"])):
                    digest.update((("\n" if some else "") + turn).encode("utf-8", "replace"))
                    some = True
                if row["is_last"]:
                    values = [row["conv_id"], *(row[n] for n in COUNTS), "".join(audit), digest.hexdigest()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], schema=pa.schema(
                        [pa.field(n, k) for (n, _), k in zip(fields, kinds, strict=True)]))
                    digest, audit, some = hashlib.sha256(), [], False

    return chosen.repartition("c", "cn").sortWithinPartitions(*key).mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conversation, turn, role, text; optional ``n``, the number of copies,
    and ``gone``, rows that only name their conversation): ``conv_id``, counts of gaps and faults, ``cost``,
    ``audit`` and ``repaired_sha256``."""
    id_type = rows.schema["conv_id"].dataType
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    order = ["c", "cn", "tn", "t", "role", "k1", "k2"]
    ordered = prepared(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(streamed(ordered, id_type), "turns")
    pieces = found.where("open")
    out = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    return found.where(~F.col("open")).select(*out).unionByName(joined(pieces, settle(pieces, id_type), id_type).select(*out))
