"""Conversation structure repair by weighted interval parsing.

A repaired conversation is an optional system turn and then pairs of a user's and an assistant's turn, or nothing.
Its grammar is in Chomsky normal form and closed under factors: a symbol [p, q] derives what leads from
place p of a sentence to place q, so its rules are [p, q] -> [p, r] [r, q], and the terminals of a row are its
edits (keep, rerole, delete). A cell of the chart holds, for every symbol that spans its rows, the least
(cost, audit). Inserted turns are closed into the cells of single rows, before and after them. Spans are
combined bottom-up by length: since every factor of a sentence has a symbol, each way to split a span gives the same
cell, and only halves are joined. So a conversation of n rows takes n - 1 joins, and blocks of a very long one are
parsed in different tasks, whose cells are then joined the same way.

Of two audits of equal cost over the same rows none begins with the other, as a further letter would be an
insertion with a cost of its own; hence the least audit of a span is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.storage import materialise

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; keeping is free
#: places in a sentence: its start, after the system turn, after a user's, after an assistant's
START, SYSTEM, USER, ASSISTANT = PLACES = range(4)
#: (place, role initial) -> place
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
MADE = {"u": "user", "a": "assistant"}  # the roles that rerole and insert give
BLANKS = "\t\n\x0b\x0c\r "
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
FAN = 16  # cells of a long conversation that are joined in one task

Cell = dict  # (p, q) -> (cost, audit)
EMPTY: Cell = {(p, p): (0, "") for p in PLACES}


def better(cell: Cell, symbol: tuple[int, int], cost: int, audit: str) -> bool:
    """Put the derivation into the cell if it is less than the one there."""
    if symbol in cell and cell[symbol] <= (cost, audit):
        return False
    cell[symbol] = (cost, audit)
    return True


@lru_cache(maxsize=None)
def _terminal(initial: str, fault: str) -> tuple:
    cell: Cell = {(p, p): (DELETE, "D") for p in PLACES}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for (p, role), q in MOVES.items():
            if role == initial:
                better(cell, (p, q), more, "K")
            if role in MADE:
                better(cell, (p, q), REROLE + more, "R")
    return tuple(inserted(cell).items())


def terminal(initial: str, fault: str) -> Cell:
    """The cell of one row, with insertions around it."""
    return dict(_terminal(initial if initial in ("s", "u", "a") else "", fault))


def inserted(cell: Cell) -> Cell:
    """The cell with all insertions before and after that lessen some derivation."""
    grew = True
    while grew:
        grew = False
        for (p, q), (cost, audit) in list(cell.items()):
            for (a, role), b in MOVES.items():
                if role in MADE:
                    grew |= a == q and better(cell, (p, b), cost + INSERT, audit + "I")
                    grew |= b == p and better(cell, (a, q), cost + INSERT, "I" + audit)
    return cell


def deleted(n: int) -> Cell:
    """The cell of n rows that all must go, with insertions around them."""
    return inserted({(p, p): (DELETE * n, "D" * n) for p in PLACES})


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans by the rules [p, q] -> [p, r] [r, q]."""
    cell: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            if (r, q) in right:
                more, rest = right[r, q]
                if (p, q) not in cell or cost + more <= cell[p, q][0]:
                    better(cell, (p, q), cost + more, audit + rest)
    return cell


def chart(cells: list[Cell]) -> Cell:
    """The top cell over a row of cells, spans of 1, 2, 4, ... of them in turn."""
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that makes a sentence."""
    return min(cell[START, q] for q in FINAL if (START, q) in cell)


class Repaired:
    """Turns of a repaired conversation, hashed one by one as its audit is read along its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def put(self, initial: str, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.place, self.any = MOVES[self.place, initial], True

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = "a" if self.place == USER else "u"
            self.put(initial, MADE[initial], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        """Read the edits of equal rows that follow one another."""
        for _ in range(copies):
            self.insertions()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.put(role[:1], role, text)
            elif edit == "R":
                initial = "a" if self.place == USER else "u"
                self.put(initial, MADE[initial], text)

    def digest(self) -> str:
        self.insertions()
        return self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a damaged copy of the table: conv_id, turn, role, text, copies; dropped ones have 0 copies and no text.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 sets role user. Nulls are one space in the key, role and text.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k <= 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(k == 0, "").when(k == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and the fault of the first; further copies are duplicates unless blank."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    stripped = F.trim("text", F.lit(BLANKS))
    rows = rows.select("*", place.alias("place"), F.sha2("text", 256).alias("digest"), (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = rows.filter(~F.col("blank") & (F.col("copies") > 0)).groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min("place").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("place"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


FAULTS = ("blank", "duplicate", "truncated")
SPAN = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long, cell array<struct<p:int,q:int,cost:long,audit:string>>"
LEGAL = ("su", "ua", "au")


def span_of(items: list[tuple]) -> dict:
    """What a span of rows (turn, role, text, copies, fault) comes to: counts, ends and its cell."""
    out = dict.fromkeys(("n_rows", *FAULTS, "illegal", "turns"), 0) | dict.fromkeys(("first", "last", "first_turn", "last_turn"))
    cells = []
    for turn, role, _, copies, fault in items:
        if not copies:
            continue
        initial = role[:1]
        out["illegal"] += copies - 1 + (out["last"] is not None and out["last"] + initial not in LEGAL)
        if out["first"] is None:
            out["first"] = initial
        out["last"] = initial
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = turn
        out["n_rows"] += copies
        if fault:
            out[fault] += 1
        out["blank" if fault == "blank" else "duplicate"] += copies - 1
        cells.append(terminal(initial, fault))
        if copies > 1:
            cells.append(deleted(copies - 1))
    return out | {"cell": chart(cells)}


def joined(left: dict, right: dict) -> dict:
    """Two adjacent spans as one."""
    if not left["n_rows"] or not right["n_rows"]:
        return left if left["n_rows"] else right
    out = {k: left[k] + right[k] for k in ("n_rows", *FAULTS)}
    out["illegal"] = left["illegal"] + right["illegal"] + (left["last"] + right["first"] not in LEGAL)
    met = left["last_turn"] is not None and left["last_turn"] == right["first_turn"]
    out["turns"] = left["turns"] + right["turns"] - met
    out |= {"first": left["first"], "last": right["last"]}
    out["first_turn"] = right["first_turn"] if left["first_turn"] is None else left["first_turn"]
    out["last_turn"] = left["last_turn"] if right["last_turn"] is None else right["last_turn"]
    return out | {"cell": combined(left["cell"], right["cell"])}


def report(span: dict) -> dict:
    cost, audit = best(span["cell"])
    gaps = 0 if span["first_turn"] is None else span["last_turn"] - span["first_turn"] + 1 - span["turns"]
    return {"gaps": gaps, **{k: span[k] for k in (*FAULTS, "illegal")}, "cost": cost, "audit": audit}


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: whole: a conversation's result; span: a block of a longer one; row: a row of such a block
PARSED = f"kind string, conv_id long, part int, block long, nth int, result struct<{RESULT.split(', ', 1)[1]}>, span struct<{SPAN}>, role string, text string, copies long"


def listed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def unlisted(span: dict) -> dict:
    return span | {"cell": {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in span["cell"]}}


def parsed(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Parse sorted rows: results of conversations that lie within a block, else spans and rows of their blocks."""
    schema = rows.sparkSession.createDataFrame([], PARSED).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, size = TaskContext.get().partitionId(), [], 0
        conv, items, held, block, before = None, [], 0, 0, False  # before: rows of conv may lie in the task before, or did in a block

        def close(last: bool) -> None:
            nonlocal block, size
            span = span_of(items)
            if last and not before:
                result = report(span)
                repaired = Repaired(result["audit"])
                for _, role, text, copies, _ in items:
                    repaired.row(role, text, copies)
                out.append({"kind": "whole", "conv_id": conv, "result": result | {"repaired_sha256": repaired.digest()}})
            else:
                out.append({"kind": "span", "conv_id": conv, "part": part, "block": block, "span": span | {"cell": listed(span["cell"])}})
                out.extend({"kind": "row", "conv_id": conv, "part": part, "block": block, "nth": k, "role": role, "text": text, "copies": copies} for k, (_, role, text, copies, _) in enumerate(items))
                block += 1
                size += held
            items.clear()

        def table() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            size = 0
            return made

        any_row = False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
                if not any_row:
                    conv, any_row, before = row[0], True, True
                elif row[0] != conv:
                    close(True)
                    conv, before, held = row[0], False, 0
                elif len(items) >= block_rows or held >= block_bytes:
                    close(False)
                    before, held = True, 0
                items.append(row[1:])
                held += len(row[3])
                if len(out) >= 4000 or size >= 8 << 20:
                    yield table()
        if any_row:
            close(False)  # it may go on in the next task
            yield table()

    return rows.mapInArrow(run, schema)


def long_ones(parts: DataFrame) -> DataFrame:
    """Results of conversations of several blocks: their cells joined by length, then one pass along each."""
    spark = parts.sparkSession
    spans = parts.filter("kind = 'span'").select("conv_id", "part", "block", "span")
    order = spans.select("conv_id", "part", "block", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "block")) - 1).alias("idx"))
    order = order.select(F.col("part").alias("o_part"), F.col("block").alias("o_block"), "idx")
    level = spans.join(order, (F.col("part") == F.col("o_part")) & (F.col("block") == F.col("o_block"))).select("conv_id", F.col("idx").cast("long").alias("idx"), "span")
    most = spans.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    form = spark.createDataFrame([], f"conv_id long, idx long, span struct<{SPAN}>").schema

    def join_spans(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("idx").to_pylist(), map(unlisted, table.column("span").to_pylist()), strict=True), key=lambda x: x[0])
        spans = [s for _, s in found]
        while len(spans) > 1:
            spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        one = {"conv_id": table.column("conv_id")[0].as_py(), "idx": found[0][0] // FAN, "span": spans[0] | {"cell": listed(spans[0]["cell"])}}
        return pa.Table.from_pylist([one], schema=table.schema.remove(table.schema.get_field_index("up")))

    while most > 1:
        level = level.withColumn("up", F.col("idx").cast("long") - F.col("idx") % FAN).groupBy("conv_id", "up").applyInArrow(join_spans, form)
        most = -(-most // FAN)
    tops = level.select("conv_id", F.lit(0).alias("stage"), F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("nth"), "span", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    rows = parts.filter("kind = 'row'").select("conv_id", F.lit(1).alias("stage"), "part", "block", "nth", F.lit(None).cast(tops.schema["span"].dataType).alias("span"), "role", "text", "copies")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = result = repaired = None
        out: list[dict] = []
        for batch in batches:
            for name, stage, span, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stage", "span", "role", "text", "copies")), strict=True):
                if not stage:
                    if result:
                        out.append({"conv_id": conv, **result, "repaired_sha256": repaired.digest()})
                    conv, result = name, report(unlisted(span))
                    repaired = Repaired(result["audit"])
                else:
                    repaired.row(role, text, copies)
        if result:
            out.append({"conv_id": conv, **result, "repaired_sha256": repaired.digest()})
        types = {k: pa.string() if t == "string" else pa.int64() for k, t in (c.split(" ") for c in RESULT.split(", "))}
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(types.items())))

    return tops.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "stage", "part", "block", "nth").mapInArrow(along, RESULT)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits that repair it and a hash of what they make.

    ``rows``: conv_id, turn, role, text and, if a row stands for several or for none, copies. Rows go by turn, nulls first,
    then role, then text. A row's first fault counts: blank, duplicate (role and text of an earlier row),
    truncated (no end mark). Initials of roles other than s, u and a fit nowhere, nor does an empty role, so
    such rows are reroled or deleted. Nulls in role and text are one space; a null conv_id is a conversation
    like others. Repeated rows are duplicates of the first. A conversation without rows (all of 0 copies)
    costs 0. An empty table gives no rows. Other columns are not read.

    Rows are dealt by range of conversation, turn, role and the text's first characters, so a conversation of any length is
    spread over tasks. Its audit, one letter a row, is one value; its texts are hashed in one pass that holds one batch.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "copies")
    rows = materialise(judged(rows), "turns")  # the ranges are found by a pass of their own
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = materialise(parsed(dealt, block_rows, block_bytes), "parsed")
    return parts.filter("kind = 'whole'").select("conv_id", "result.*").unionByName(long_ones(parts))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
