"""Repair of conversations: faults, cheapest edits to a legal order of roles (12)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seclake.llm.blocks import small_batches
from seclake.llm.tables import stored

# States of s?(ua)+: nothing yet, after s, after u, after a. Only the first and last may end.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_ENDS = (_NOTHING, _ASSISTANT)
_AFTER_INSERT = (_USER, _USER, _ASSISTANT, _USER)
_AFTER_KEEP = {"s": {_NOTHING: _SYSTEM}, "u": {_NOTHING: _USER, _SYSTEM: _USER, _ASSISTANT: _USER},
               "a": {_USER: _ASSISTANT}, "?": {}}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_INITIALS = "sua?"
_SOUND, _CUT_OFF, _MUST_GO = range(3)
_SPACE = " \t\n\x0b\x0c\r"
CHUNK_ROWS = 20_000
CHUNK_BYTES = 16 << 20


@lru_cache(maxsize=100_000)
def step(costs: tuple, order: tuple, code: int):
    """The state after a row: costs, order, what was added to all costs, and back pointers.

    costs: cheapest edits that end in each state, less the least of them (None: not to be
    reached); order: rank of each state's edits as text. A back pointer is the state before
    and the row's edits. Two texts that end in different states differ in an earlier letter,
    since each ends with the edit of a row, so their ranks order all that is added to them.
    """
    initial, fault = _INITIALS[code // 3], code % 3
    best: dict[int, tuple] = {}
    for state, cost in enumerate(costs):
        if cost is None:
            continue
        at = state
        for inserts in range(3):
            options = [("D", at, 3)]
            if fault != _MUST_GO:
                if at in _AFTER_KEEP[initial]:
                    options.append(("K", _AFTER_KEEP[initial][at], fault))
                options.append(("R", _AFTER_INSERT[at], 2 + fault))
            for edit, to, price in options:
                found = (cost + 2 * inserts + price, order[state], "I" * inserts + edit, state)
                if to not in best or found < best[to]:
                    best[to] = found
            at = _AFTER_INSERT[at]
    least = min(found[0] for found in best.values())
    ranked = sorted(best, key=lambda to: best[to][1:3])
    return (tuple(best[to][0] - least if to in best else None for to in range(4)),
            tuple(ranked.index(to) if to in best else None for to in range(4)), least,
            tuple((best[to][3], best[to][2]) if to in best else None for to in range(4)))


@lru_cache(maxsize=10_000)
def last_step(costs: tuple, order: tuple) -> tuple[int, int, str]:
    """Cost of what is missing, state before it, and the inserts that end legally."""
    found = []
    for state, cost in enumerate(costs):
        at = state
        for inserts in range(3):
            if cost is not None and at in _ENDS:
                found.append((cost + 2 * inserts, order[state], "I" * inserts, state))
            at = _AFTER_INSERT[at]
    cost, _, edits, state = min(found)
    return cost, state, edits


def _apply(state: int, edits: str, row: tuple | None) -> tuple[int, list[str]]:
    """The state after some edits, and the lines they give. The last of them takes the row."""
    lines = []
    for edit in edits:
        if edit == "D":
            continue
        if edit == "K":
            role, text, code = row
            state = _AFTER_KEEP[_INITIALS[code // 3]][state]
            lines.append(f"{role}:{text}")
        else:
            state = _AFTER_INSERT[state]
            lines.append(f"{_NAMES[state]}:{row[1] if edit == 'R' else ''}")
    return state, lines


class _Walk:
    """One conversation as its rows go by. Holds a chunk of rows; older ones are told as spilled.

    For every state the digest of its text so far is kept, so a row's text is seen once.
    """

    def __init__(self, conv):
        self.conv = conv
        self.costs, self.order, self.cost = (0, None, None, None), (0, None, None, None), 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.low = self.turn = self.initial = None
        self.turns = self.seq = self.held = 0
        self.rows: list[tuple] = []
        self.backs: list[tuple] = []
        self.digests = {_NOTHING: (hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, code: int, fault: int, initial: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += self.turn != turn
            self.turn = turn
        if fault:
            self.counts[fault - 1] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = initial
        self.costs, self.order, least, back = step(self.costs, self.order, code)
        self.cost += least
        self.rows.append((role, text, code))
        self.backs.append(back)
        self.held += len(text)

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.held >= CHUNK_BYTES

    def _path(self, state: int) -> tuple[int, str, tuple]:
        """Back to the chunk's start: the state there, the edits since, the digest of the text."""
        edits = []
        for back in reversed(self.backs):
            state, of_row = back[state]
            edits.append(of_row)
        edits.reverse()
        digest, any_line = self.digests[state]
        digest, at = digest.copy(), state
        for of_row, row in zip(edits, self.rows):
            at, lines = _apply(at, of_row, row)
            for line in lines:
                digest.update((("\n" if any_line else "") + line).encode("utf-8", "surrogatepass"))
                any_line = True
        return state, "".join(edits), (digest, any_line)

    def spill(self) -> dict:
        """Hand on the chunk's back pointers: per state, the one before and the edits."""
        ways, digests = [], {}
        for state in range(4):
            if self.costs[state] is None:
                ways.append("")
                continue
            before, edits, digests[state] = self._path(state)
            ways.append(f"{before}{edits}")
        row = self._row(seq=self.seq, back=zlib.compress("\n".join(ways).encode(), 6))
        self.seq += 1
        self.rows, self.backs, self.held, self.digests = [], [], 0, digests
        return row

    def end(self) -> dict:
        missing, state, inserts = last_step(self.costs, self.order)
        before, edits, (digest, any_line) = self._path(state)
        _, lines = _apply(state, inserts, None)
        for line in lines:
            digest.update((("\n" if any_line else "") + line).encode())
            any_line = True
        blank, duplicate, truncated, illegal = self.counts
        return self._row(
            seq=self.seq, audit=edits + inserts, before=before,
            gaps=0 if self.low is None else self.turn - self.low + 1 - self.turns,
            blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal,
            cost=self.cost + missing, repaired_sha256=digest.hexdigest())

    def _row(self, **values) -> dict:
        return {name: values.get(name) for name in _WALKED} | {"conv": self.conv}


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_WALKED = ["conv", "seq", "back", "before", *_REPORT, "audit", "repaired_sha256"]
_WALKED_SCHEMA = (
    "conv string, seq long, back binary, before int, "
    + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_WALKED)
    return frame.astype({c: "Int64" for c in ("seq", "before", *_REPORT)})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and turn; the state of one conversation goes from batch to batch."""
    walk: _Walk | None = None
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in (
            "conv", "present", "no_turn", "turn", "role", "text", "code", "fault", "initial")]
        for conv, present, no_turn, turn, role, text, code, fault, initial in zip(*columns):
            if walk is None or walk.conv != conv:
                if walk is not None:
                    out.append(walk.end())
                walk = _Walk(conv)
            if not present:
                continue
            walk.add(None if no_turn else turn, role, text, code, fault, initial)
            if walk.full():
                out.append(walk.spill())
        if out:
            yield _frame(out)
    if walk is not None:
        yield _frame([walk.end()])


def _rejoin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole audits of conversations that were spilled; their rows come last chunk first."""
    end, state, parts = None, None, []

    def done():
        return _frame([{**end, "audit": "".join(reversed(parts))}])

    for batch in batches:
        for row in batch.to_dict("records"):
            if end is None or row["conv"] != end["conv"]:
                if end is not None:
                    yield done()
                end, parts, state = row, [row["audit"]], int(row["before"])
            else:
                way = zlib.decompress(row["back"]).decode().split("\n")[state]
                state = int(way[0])
                parts.append(way[1:])
    if end is not None:
        yield done()


def _conv(conv_id: Column) -> Column:
    """The id as text, never null."""
    return F.when(conv_id.isNull(), "n").otherwise(
        F.concat(F.lit("c"), conv_id.cast("string"))).alias("conv")


def _judged(rows: DataFrame, present: Column) -> DataFrame:
    """Rows with their fault, all of one conversation in one partition, in order of turn.

    One shuffle. The equal rows of a conversation are numbered by a sort that spills.
    """
    null_safe = rows.select(
        _conv(rows["conv_id"]),
        present.alias("present"), rows["turn"].isNull().alias("no_turn"),
        F.coalesce(rows["turn"].cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(rows["role"], F.lit(" ")).alias("role"),
        F.coalesce(rows["text"], F.lit(" ")).alias("text"))
    together = null_safe.repartition("conv")
    same = Window.partitionBy("conv", "present", F.xxhash64("role", "text"), "role", "text").orderBy(
        F.col("no_turn").desc(), "turn")
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (
        F.when(body == "", 1).when(F.col("_nth") > 1, 2)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    harm = F.when(F.col("fault") == 3, _CUT_OFF).when(
        F.col("fault") > 0, _MUST_GO).otherwise(_SOUND)
    judged = together.withColumn("_nth", F.row_number().over(same)).withColumn(
        "fault", fault).withColumn("initial", initial).withColumn("code", place * 3 + harm).drop("_nth")
    return judged.sortWithinPartitions(
        "conv", F.col("no_turn").desc(), "turn", "role", "text")


def conversation_report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, and the cheapest repair.

    ``rows`` has conv_id, turn, role, text. The result has conv_id, gaps (missing turn numbers), blank,
    duplicate, truncated (rows by their first fault), illegal (neighbours out of order), cost,
    audit (a letter per edit: Keep, Rerole, Delete, Insert) and repaired_sha256 (of the lines
    ``role:text``). Edits as in the module's tables: Rerole and Insert cost 2, Delete 3, a cut-off row that stays 1;
    blank and repeated rows must go. Of equally cheap repairs the least audit counts.

    Rows are partitioned by conversation and sorted by turn; a task streams them and carries
    four costs from batch to batch. It holds at most CHUNK_ROWS rows: back pointers of older
    ones are written to a table, some bits a row, and joined when all is written.

    A null role or text is one space; rows without a turn come first; rows of one turn are
    ordered by role and text, and equal rows repeat each other. A null conv_id is a conversation of its
    own. Rows where ``present`` is false only tell that the conversation exists; one without
    rows has zeros, no edits and the digest of an empty text. An empty table gives no rows.
    Other columns are not read.
    """
    small_batches(rows.sparkSession)
    judged = _judged(rows, F.lit(True) if present is None else present)
    walked = stored(judged.mapInPandas(_walk, _WALKED_SCHEMA), "walks")
    whole = walked.filter("back IS NULL AND seq = 0")
    spilled = walked.filter("back IS NOT NULL OR seq > 0").repartition("conv").sortWithinPartitions(
        "conv", F.desc("seq"))
    both = whole.unionByName(spilled.mapInPandas(_rejoin, _WALKED_SCHEMA))
    kind = rows.schema["conv_id"].dataType
    return both.select(
        F.when(F.col("conv").startswith("c"), F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"),
        *_REPORT, "audit", "repaired_sha256")


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit, role, text.

    ``report`` is what ``conversation_report`` tells of the same rows. Its audits go in as rows
    that sort before the conversation's own, so nothing is joined to every row.
    """
    small_batches(rows.sparkSession)
    judged = _judged(rows, F.lit(True)).withColumn("audit", F.lit(None).cast("string"))
    heads = report.select(_conv(report["conv_id"]), "audit")
    both = judged.unionByName(heads, allowMissingColumns=True).withColumn(
        "head", F.col("audit").isNotNull()).withColumns({
            c: F.coalesce(c, F.lit(0)) for c in ("turn", "code", "fault")})
    ordered = both.repartition("conv").sortWithinPartitions(
        "conv", F.col("head").desc(), F.col("no_turn").desc(), "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, at, state, position = None, "", 0, _NOTHING, 0
        for batch in batches:
            out = []

            def tell(upto, row):
                nonlocal at, state, position
                for edit in audit[at:upto]:
                    state, lines = _apply(state, edit, row)
                    for line in lines:
                        role, _, text = line.partition(":") if edit != "K" else (row[0], "", row[1])
                        out.append((conv, position, edit, role, text))
                        position += 1
                at = upto

            for name, head, told, role, text, code in zip(*[batch[c].tolist() for c in (
                    "conv", "head", "audit", "role", "text", "code")]):
                if head:
                    if conv is not None:
                        tell(len(audit), None)
                    conv, audit, at, state, position = name, told, 0, _NOTHING, 0
                    continue
                end = at
                while audit[end] == "I":
                    end += 1
                tell(end + 1, (role, text, code))
            # What is left of the audit are inserts at the end; the next head or the end tells them.
            yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])
        out = []
        if conv is not None:
            for edit in audit[at:]:
                state, lines = _apply(state, edit, None)
                out.append((conv, position, edit, _NAMES[state], ""))
                position += 1
            yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])

    kind = rows.schema["conv_id"].dataType
    return ordered.mapInPandas(
        run, "conv string, position long, edit string, role string, text string").select(
        F.when(F.col("conv").startswith("c"), F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"),
        "position", "edit", "role", "text")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows harmed by the checksum of their id and turn, and which are still present.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    marks out, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    space = F.lit(" ")
    lot = F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(
        F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    harmed = rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), "lot", F.explode(times).alias("copy"))
    return harmed, F.col("lot") != 0
