"""Repair of conversations by cheapest edits, so that roles read system?, (user, assistant) at least once, or nothing.

Rows are marked first (blank, duplicate, truncated), by aggregations alone. Roles and faults of a conversation are then a sequence
of symbols. It is sorted over the whole cluster, so a long conversation may lie in several partitions; its part in one of them is
a segment, of which equal consecutive symbols are collapsed into runs. The cost of the cheapest edits from a row on, for each state
of the pattern reached before it, follows from the costs after the row by a min-plus product with the symbol's transition; a run
takes one product for each binary digit of its length, with powers that are made once. Segments have products of their own, so that
costs pass between the few segments of a conversation without its rows. At last the choices of each segment are unrolled
from its first row on; the least letter of those that reach the least cost comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import quoted, table, written

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: states: nothing yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a user or assistant row is put out
AFTER = (USER, USER, ASSISTANT, USER)
#: initials of roles by number; others have the last number
INITIALS = "sua"
#: a symbol is three times the number of the role's initial, plus one of these
SOUND, CUT, LOST = range(3)
NEVER = 1 << 40
#: what is to be paid after the last row
FINAL = (0, 2 * INSERT, INSERT, 0)
Vector = tuple[int, ...]


def product(matrix: tuple[Vector, ...], columns: tuple[Vector, ...]) -> tuple[Vector, ...]:
    """The min-plus product; ``columns`` holds columns, and so does the result."""
    return tuple(tuple(min(m + c for m, c in zip(row, column)) for row in matrix) for column in columns)


def kept_as(initial: int, state: int) -> int | None:
    """The state after a row is kept as it is, if the pattern allows that."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


@lru_cache(maxsize=None)
def transition(symbol: int) -> tuple[Vector, ...]:
    """Costs from each state before a row of this symbol, inserted rows before it included, to each state after it."""
    initial, fault = divmod(symbol, 3)
    rows = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        rows[state][state] = DELETE
        if fault != LOST:
            extra = TRUNCATED if fault == CUT else 0
            rows[state][AFTER[state]] = min(rows[state][AFTER[state]], REROLE + extra)
            target = kept_as(initial, state)
            if target is not None:
                rows[state][target] = min(rows[state][target], extra)
    for _ in range(4):  # an insertion leads to the next state, before the row
        for state in range(4):
            rows[state] = [min(here, INSERT + there) for here, there in zip(rows[state], rows[AFTER[state]])]
    return tuple(map(tuple, rows))


@lru_cache(maxsize=None)
def power(symbol: int, exponent: int) -> tuple[Vector, ...]:
    """The transition over ``2 ** exponent`` rows of a symbol, as rows."""
    if not exponent:
        return transition(symbol)
    half = power(symbol, exponent - 1)
    return tuple(zip(*product(half, tuple(zip(*half)))))


def over_run(symbol: int, length: int, columns: tuple[Vector, ...]) -> tuple[Vector, ...]:
    """Costs before a run, from the costs after it."""
    exponent = 0
    while length:
        if length & 1:
            columns = product(power(symbol, exponent), columns)
        length >>= 1
        exponent += 1
    return columns


@lru_cache(maxsize=1 << 16)
def short_run(symbol: int, length: int, after: Vector) -> Vector:
    return over_run(symbol, length, (after,))[0]


def before_run(symbol: int, length: int, after: Vector) -> Vector:
    """As :func:`over_run` for one vector; vectors that differ by a constant alone are worked out once."""
    least = min(after)
    found = short_run(symbol, length, tuple(c - least for c in after))
    return tuple(c + least for c in found)


@lru_cache(maxsize=1 << 16)
def choice(symbol: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters of the cheapest edits at one row, least letters first, and the state they lead to."""
    initial, fault = divmod(symbol, 3)
    before = product(transition(symbol), (after,))[0]
    extra = TRUNCATED if fault == CUT else 0
    letters = ""
    while True:
        if DELETE + after[state] == before[state]:
            return letters + "D", state
        if INSERT + before[AFTER[state]] == before[state]:
            letters, state = letters + "I", AFTER[state]
            continue
        target = kept_as(initial, state)
        if target is not None and extra + after[target] == before[state]:
            return letters + "K", target
        return letters + "R", AFTER[state]


def unrolled(runs: list[tuple[int, int]], after: Vector, last: bool, state: int) -> tuple[str, int]:
    """The audit of a segment that is entered in ``state``, and the state it leaves."""
    ends = [after]
    for symbol, length in reversed(runs):
        ends.append(before_run(symbol, length, ends[-1]))
    pieces = []
    for (symbol, length), end in zip(runs, ends[-2::-1]):
        inside = [end]
        for _ in range(length - 1):
            inside.append(before_run(symbol, 1, inside[-1]))
        for vector in reversed(inside):
            least = min(vector)
            letters, state = choice(symbol, tuple(c - least for c in vector), state)
            pieces.append(letters)
    if last:
        pieces.append("I" * (FINAL[state] // INSERT))
    return "".join(pieces), state


def marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that differ, with their texts and counts; and the same without texts, with their faults.

    Both are written. Rows that are alike are counted within the tasks, so one row that is repeated without end is no burden.
    A row that is no copy of an earlier one is found by the least turn of its role and text, which is added to the rows by a second
    aggregation rather than by a join.
    """
    different = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    different = written(different.withColumn("digest", F.unhex(F.sha2("text", 256))), "rows")
    shown = F.rtrim("text", F.lit(SPACE))
    narrow = different.select(
        "conv", "turn", "role", "digest", "n",
        (F.length(shown) == 0).alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    first = narrow.where("not blank").groupBy("conv", "role", "digest").agg(
        F.min("turn").alias("turn"), F.count(F.when(F.col("turn").isNull(), 1)).alias("nulls")
    )
    first = first.select(
        "conv", F.when(F.col("nulls") == 0, F.col("turn")).alias("turn"), "role", "digest", F.lit(0).cast("long").alias("n"),
        F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("first"),
    )
    both = narrow.withColumn("first", F.lit(False)).unionByName(first)
    faults = both.groupBy("conv", "turn", "role", "digest").agg(
        F.sum("n").alias("n"), *[F.max(name).alias(name) for name in ("blank", "truncated", "first")]
    )
    return different, written(faults, "faults")


def order(*first: str) -> list[Column]:
    """Rows of a turn stand in the order of their roles, then of the SHA-256 of their texts."""
    return [F.col(name).asc_nulls_first() for name in (*first, "turn", "role", "digest")]


def segments(faults: DataFrame) -> DataFrame:
    """``conv, place, runs, open, first, last, illegal``: each conversation's part of each partition, in order.

    ``place`` is the number of the partition; only the first and the last segment of one can be ``open``, that is a part.
    """
    initial = F.substr("role", F.lit(1), F.lit(1))
    number = reduce(lambda rest, i: F.when(initial == INITIALS[i], i).otherwise(rest), range(3), F.lit(3))
    own = F.col("first") & ~F.col("blank")
    symbols = faults.select("*", number.alias("number"), own.alias("own"), (own & F.col("truncated")).alias("cut"))
    ordered = symbols.repartitionByRange(*order("conv")).sortWithinPartitions(*order("conv"))
    ordered = ordered.select("conv", F.spark_partition_id().alias("place"), "number", "own", "cut", "n")
    kind = faults.schema["conv"].dataType.simpleString()
    conv_type = pa_type(faults, "conv")
    run_type = pa.list_(pa.struct([("symbol", pa.int32()), ("length", pa.int64())]))
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        runs: list[list[int]] = []
        conv, place, first, last, illegal, begun, emitted = None, 0, 0, 0, 0, False, False

        def grow(symbol: int, length: int) -> None:
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += length
            elif length:
                runs.append([symbol, length])

        def finish(at_end: bool) -> None:
            nonlocal runs, emitted
            if begun:
                done.append((conv, place, [tuple(r) for r in runs], at_end or not emitted, first, last, illegal))
                emitted = True
            runs = []

        def taken() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            done.clear()
            kinds = [conv_type, pa.int32(), run_type, pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
            names = ["conv", "place", "runs", "open", "first", "last", "illegal"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for here, part, number, own, cut, n in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or here != conv:
                    finish(False)
                    conv, place, first, illegal, begun = here, part, number, 0, True
                else:
                    illegal += (last, number) not in legal
                last = number
                illegal += n - 1  # copies: no role may follow itself
                if own:
                    grow(3 * number + (CUT if cut else SOUND), 1)
                grow(3 * number + LOST, n - own)
            yield taken()
        finish(True)
        yield taken()

    return written(
        ordered.mapInArrow(
            run,
            f"conv {kind}, place int, runs array<struct<symbol: int, length: bigint>>, open boolean, first int, last int, illegal bigint",
        ),
        "segments",
    )


def pa_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def costs_after(parts: DataFrame) -> DataFrame:
    """``conv, place, after, final`` for open segments: costs after each, passed back over the segments of its conversation.

    There are two open segments a partition at most, whatever the lengths of conversations.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    conv_type = pa_type(parts, "conv")
    identity = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column("runs").to_pylist():
                columns = identity
                for r in reversed(runs):
                    columns = over_run(r["symbol"], r["length"], columns)
                out.append([c for row in zip(*columns) for c in row])
            arrays = [batch.column("conv"), batch.column("place"), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "place", "matrix"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, matrices in zip(batch.column("conv").to_pylist(), batch.column("matrices").to_pylist()):
                after: Vector = FINAL
                for i, part in enumerate(reversed(matrices)):
                    out.append((conv, part["place"], list(after), i == 0))
                    flat = part["matrix"]
                    after = product(tuple(tuple(flat[4 * r : 4 * r + 4]) for r in range(4)), (after,))[0]
            columns = list(zip(*out)) or [()] * 4
            kinds = [conv_type, pa.int32(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "place", "after", "final"])

    opened = parts.where("open").select("conv", "place", "runs").mapInArrow(products, f"conv {kind}, place int, matrix array<bigint>")
    by_conv = opened.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "matrix"))).alias("matrices"))
    return by_conv.mapInArrow(passed, f"conv {kind}, place int, after array<bigint>, final boolean")


def audits(parts: DataFrame) -> DataFrame:
    """``conv, audit, cost, illegal`` of every conversation that has rows."""
    after = costs_after(parts).withColumnsRenamed({"conv": "c", "place": "p"})
    joined = parts.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left").select(
        "conv", "place", "runs", "open", "after", F.coalesce("final", F.lit(True)).alias("final"), "first", "last", "illegal"
    )
    kind = parts.schema["conv"].dataType.simpleString()

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, states, costs = [], [], []
            for runs, is_open, after, final in zip(*[batch.column(c).to_pylist() for c in ("runs", "open", "after", "final")]):
                pairs = [(r["symbol"], r["length"]) for r in runs]
                end = tuple(after) if after else FINAL
                # a segment that is a part may be entered in any state
                found = [unrolled(pairs, end, final, state) for state in (range(4) if is_open else [START])]
                pieces.append([piece for piece, _ in found])
                states.append([state for _, state in found])
                for symbol, length in reversed(pairs):
                    end = before_run(symbol, length, end)
                costs.append(end[START])
            arrays = [batch.column(c) for c in ("conv", "place", "first", "last", "illegal")]
            arrays += [pa.array(pieces, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32())), pa.array(costs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "place", "first", "last", "illegal", "pieces", "states", "cost"])

    parts_out = joined.mapInArrow(
        unroll,
        f"conv {kind}, place int, first int, last int, illegal bigint, pieces array<string>, states array<int>, cost bigint",
    )
    by_conv = parts_out.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "first", "last", "illegal", "pieces", "states", "cost"))).alias("parts")
    )
    nothing = F.struct(
        F.lit("").alias("audit"), F.lit(START).alias("state"), F.lit(0).cast("long").alias("illegal"), F.lit(-1).alias("last")
    )

    def follow(so_far: Column, part: Column) -> Column:
        pair = F.concat_ws(",", so_far["last"].cast("string"), part["first"].cast("string"))
        meets = F.when((so_far["last"] >= 0) & ~pair.isin("0,1", "1,2", "2,1"), 1).otherwise(0).cast("long")
        return F.struct(
            F.concat(so_far["audit"], F.get(part["pieces"], so_far["state"])).alias("audit"),
            F.get(part["states"], so_far["state"]).alias("state"),
            (so_far["illegal"] + part["illegal"] + meets).alias("illegal"),
            part["last"].alias("last"),
        )

    folded = by_conv.select("conv", F.aggregate("parts", nothing, follow).alias("f"), F.get("parts", F.lit(0))["cost"].alias("cost"))
    return folded.select("conv", F.col("f.audit").alias("audit"), "cost", F.col("f.illegal").alias("illegal"))


def edited(different: DataFrame, audit: DataFrame) -> DataFrame:
    """``conv, place, role, text``: the repaired rows, those of a conversation in one partition and in their order.

    Rows stream past their audit: what is held is one audit and one batch of rows.
    """
    stream = audit.select("conv", "audit", F.lit(0).alias("kind")).unionByName(
        different.select("conv", "turn", "role", "digest", "n", "text", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    stream = stream.repartition("conv").sortWithinPartitions(*order("conv", "kind")).select("conv", "kind", "audit", "role", "n", "text")
    kind = different.schema["conv"].dataType.simpleString()
    conv_type = pa_type(different, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, letters, at, state, place, begun = None, "", 0, START, 0, False

        def put(role: str | None, text: str) -> None:
            """The next row; without a role it takes the one the pattern asks for."""
            nonlocal state, place
            following = AFTER[state]
            if role is None:
                role = "assistant" if following == ASSISTANT else "user"
            elif role[:1] == "s":
                following = SYSTEM
            out.append((conv, place, role, text))
            state, place = following, place + 1

        def inserted() -> None:
            nonlocal at
            while letters[at : at + 1] == "I":
                put(None, "")
                at += 1

        for batch in batches:
            for here, what, own, role, n, text in zip(*[c.to_pylist() for c in batch.columns]):
                if what == 0:
                    if begun:
                        inserted()
                    conv, letters, at, state, place, begun = here, own, 0, START, 0, True
                    continue
                while n:
                    inserted()
                    letter = letters[at]
                    if letter == "K":
                        put(role, text)
                    elif letter == "R":
                        put(None, text)
                    at, n = at + 1, n - 1
                    # copies that go
                    while n and letters.startswith("D", at):
                        at, n = at + 1, n - 1
            yield taken(out)
        if begun:
            inserted()
        yield taken(out)

    def taken(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        kinds = [conv_type, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "place", "role", "text"])

    return stream.mapInArrow(run, f"conv {kind}, place bigint, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, sha256`` of the ``role:text`` of repaired rows, joined by newlines; they come in the order of :func:`edited`."""
    kind = repaired.schema["conv"].dataType.simpleString()
    conv_type = pa_type(repaired, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, hashlib.sha256(), False
        for batch in batches:
            convs, found = [], []
            for here, place, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if place == 0:
                    if begun:
                        convs.append(conv)
                        found.append(digest.hexdigest())
                    conv, digest, begun = here, hashlib.sha256(), True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(found, pa.string())], names=["conv", "sha256"])
        last = ([conv], [digest.hexdigest()]) if begun else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(last[0], conv_type), pa.array(last[1], pa.string())], names=["conv", "sha256"])

    return repaired.mapInArrow(run, f"conv {kind}, sha256 string")


class Repair:
    """The faults, cheapest edits and repaired rows of conversations.

    Rows are taken by conversation and turn (whole numbers), null turns first; rows of one turn by role, then by the SHA-256 of their texts. A null
    role or text counts as one space, a null conversation is one of its own. Only a role's first letter matters to the pattern; rows
    that are alike are copies. Conversations and rows may be of any number and length: no step holds a conversation but the digest,
    which a hash must read in order, and that streams. Columns beyond the four named are left out; an empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv = conv
        blank = F.lit(" ")
        named = rows.select(
            quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"),
            F.coalesce(quoted(role), blank).alias("role"), F.coalesce(quoted(text), blank).alias("text"),
        )
        self.different, self.faults = marked(named)
        self.audit = written(audits(segments(self.faults)), "audits")

    def counts(self) -> DataFrame:
        """``conv, gaps, blank, duplicate, truncated``."""
        own = F.col("first") & ~F.col("blank")
        return self.faults.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
            F.sum((own & F.col("truncated")).cast("long")).alias("truncated"),
        )

    def repaired(self) -> DataFrame:
        """The repaired rows: the conversation, ``place`` (from 0), ``role`` and ``text``."""
        return self.in_order().withColumnRenamed("conv", self.conv)

    def in_order(self) -> DataFrame:
        return edited(self.different, self.audit)

    def report(self) -> DataFrame:
        """One row for each conversation that has rows: its faults, cost, audit and the digest of its repaired rows."""
        parts = [self.counts(), self.audit, digests(self.in_order())]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
        found = rows.groupBy("conv").agg(*[F.max(name).alias(name) for name in names])
        empty = F.sha2(F.lit(b""), 256)
        return found.select(
            F.col("conv").alias(self.conv), *names[:-1], F.coalesce("sha256", empty).alias("repaired_sha256")
        )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the contract's damage, by the remainder of a checksum; nulls count as one space."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    kept = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    report = Repair(damaged(conversations)).report()
    rows = conversations.select("conv_id").distinct().unionByName(report, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.groupBy("conv_id").agg(
        *[F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name) for name in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
