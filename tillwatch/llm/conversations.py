"""Conversation structure repair by Knuth's lightest derivations.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. An item (p, i, q) says that the
first i rows of a chunk lead from state p of that pattern to state q; its weight is the pair (cost,
audit), and the deductions keep, rerole, delete or insert. Weights only grow along a deduction, and of two
weights the smaller stays smaller, so an agenda that pops the least weight finalises every item with
its lightest derivation, as Knuth's algorithm does. A deduction with two antecedents joins the items of
neighbouring chunks; the goal item is the whole conversation in an accepting state.

Conversations are cut into chunks of at most ``CHUNK`` rows, which are solved apart. What follows reads
sorted rows as a stream: the chunks of a conversation are joined one after the other, and its texts
are edited a batch at a time. A task never holds a conversation's rows, only its audit (a letter a row).

Defined results
    null conv_id               a conversation of its own; one space in the key of the damage
    null turn                  before all others, no part of the gaps; one space in the key
    null role or text          one space
    turn that is no number     like a null one, but for the key
    rows of equal turn         ordered by role and text (by their hash); copies stand together
    conversation without rows  zeros, empty audit, the hash of the empty text
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import stored, text_slices

CHUNK_BITS = 8  # chunks of 256 rows
BLANKS = " \t\n\x0b\x0c\r"
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)

# What an edit costs, and what a truncated row adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5

# The pattern as states: 0 nothing yet, 1 a system row, 2 a user row last, 3 an assistant row last.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()

Weight = tuple[int, str]
Table = dict[tuple[int, int], Weight]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that the key's hash chooses."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", F.col("turn").try_cast("long").alias("turn"), (F.crc32(key.cast("binary")) % 20).alias("fault"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).filter("fault <> 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, which grows along each conversation. Ranges of (conversation, turn, hash of the
    row) are sorted apart, so a conversation of any length is spread over tasks."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("mark")]
    marked = rows.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("mark"))
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return stored(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_faults(ordered: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial and fault of each row; no texts."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    seen = ordered.select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"),
        F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(GOOD).alias("own"),
        F.struct("role", F.sha2("text", 256)).alias("content"),
    )
    full = seen.filter(F.col("own") != BLANK)
    first = full.groupBy(F.col("conv_id").alias("in_conv"), "content").agg(F.min("at").alias("first_at"))
    met = full.join(first, full["conv_id"].eqNullSafe(first["in_conv"]) & (full["content"] == first["content"]))
    met = met.select("conv_id", "at", "turn", "initial", F.when(F.col("at") > F.col("first_at"), DUPLICATE).otherwise(F.col("own")).alias("fault"))
    blank = seen.filter(F.col("own") == BLANK).select("conv_id", "at", "turn", "initial", F.col("own").alias("fault"))
    return met.unionByName(blank)


# --- the agenda ------------------------------------------------------------------------------


def moves(state: int, initial: str, fault: int) -> list[tuple[int, str, int]]:
    """(cost, letter, state) of every edit of a row."""
    found = [(DELETE, "D", state)]
    if fault not in (BLANK, DUPLICATE):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            found.append((KEEP + more, "K", NEXT[state, initial]))
        found += [(REROLE + more, "R", NEXT[state, other]) for other in ROLES if (state, other) in NEXT]
    return found


_INSERTIONS = [[(INSERT, "I", NEXT[q, r]) for r in ROLES if (q, r) in NEXT] for q in STATES]
# Rows differ for the deductions by their initial, if the pattern knows it, and their fault.
_EDITS = {(r, f): [moves(q, r, f) for q in STATES] for r in ("s", "u", "a", "") for f in (GOOD, BLANK, DUPLICATE, TRUNCATED)}


def derive(rows: list[tuple[str, int]]) -> Table:
    """The lightest (cost, audit) from each state to each other one over all rows of a chunk."""
    edits = [_EDITS[r if r in ("s", "u", "a") else "", f] for r, f in rows]
    system = any(r == "s" and f not in (BLANK, DUPLICATE) for r, f in rows)
    best: Table = {}
    for p in STATES:
        # States 2 and 3 can be reached from all, 1 from itself and over a system row from 0, 0 from itself.
        open_goals = 2 + (p < 2) + (p == 0 and system)
        final: list[list[Weight | None]] = [[None] * 4 for _ in range(len(rows) + 1)]
        agenda = [(0, "", 0, p)]
        while agenda:
            cost, audit, i, q = heapq.heappop(agenda)
            if final[i][q] is not None:
                continue
            final[i][q] = (cost, audit)
            open_goals -= i == len(rows)
            if not open_goals:
                break
            for more, letter, to in _INSERTIONS[q]:
                if final[i][to] is None:
                    heapq.heappush(agenda, (cost + more, audit + letter, i, to))
            if i < len(rows):
                for more, letter, to in edits[i][q]:
                    if final[i + 1][to] is None:
                        heapq.heappush(agenda, (cost + more, audit + letter, i + 1, to))
        best |= {(p, q): w for q, w in enumerate(final[-1]) if w is not None}
    return best


# A trail is (trail before, audit of the chunk): the audit of a prefix without copying it.


def _earlier(a, b) -> bool:
    """Whether trail ``a`` reads before ``b``; both have the same number of chunks."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)) < "".join(reversed(y))


def joined(prefix: dict, table: Table) -> dict:
    """Items of a prefix, joined with those of the next chunk: state -> (cost, trail)."""
    out: dict = {}
    for (p, q), (more, audit) in table.items():
        if p not in prefix:
            continue
        cost, trail = prefix[p][0] + more, (prefix[p][1], audit)
        if q not in out or cost < out[q][0] or cost == out[q][0] and _earlier(trail, out[q][1]):
            out[q] = (cost, trail)
    return out


def goal(prefix: dict) -> tuple[int, str]:
    """The lightest accepting item's cost and its whole audit."""
    best = None
    for q in ACCEPTING:
        if q in prefix and (best is None or prefix[q][0] < best[0] or prefix[q][0] == best[0] and _earlier(prefix[q][1], best[1])):
            best = prefix[q]
    parts, trail = [], best[1]
    while trail is not None:
        parts.append(trail[1])
        trail = trail[0]
    return best[0], "".join(reversed(parts))


# --- chunks and conversations ------------------------------------------------------------------

_SUMS = ["blank", "duplicate", "truncated", "illegal"]
_CHUNK = (
    "conv_id {id}, chunk long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, costs array<long>, audits array<string>"
)
_HEAD = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _illegal(pairs) -> int:
    return sum(a + b not in _LEGAL for a, b in pairs)


def chunk_tables(faults: DataFrame, kind: str) -> DataFrame:
    """A row per chunk: its sums, its ends and its 4 x 4 table of lightest derivations."""
    schema = _CHUNK.format(id=kind)
    shape = _arrow(schema, faults.sparkSession)

    def solved(rows: list[dict]) -> dict:
        initials, found = [r["initial"] for r in rows], [r["fault"] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        best = derive(list(zip(initials, found)))
        pairs = [(p, q) for p in STATES for q in STATES]
        return {
            "conv_id": rows[0]["conv_id"], "chunk": rows[0]["chunk"], "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE),
            "truncated": found.count(TRUNCATED), "illegal": _illegal(zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
            "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            "costs": [best[pq][0] if pq in best else None for pq in pairs], "audits": [best[pq][1] if pq in best else None for pq in pairs],
        }

    def solve(batches):
        out, rows = [], []
        for new, row in _grouped(batches, "conv_id", "chunk"):
            if new and rows:
                out.append(solved(rows))
                rows = []
            rows.append(row)
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        if rows:
            out.append(solved(rows))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    chunks = faults.withColumn("chunk", F.shiftright("at", CHUNK_BITS)).repartition("conv_id", "chunk")
    return chunks.sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(solve, schema)


def _grouped(batches, *keys: str):
    """Rows of a sorted stream as dicts, each with a flag: whether its keys differ from those of the row before."""
    before = None
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            yield own != before, row
            before = own


def conversation_heads(chunks: DataFrame, kind: str) -> DataFrame:
    """A row per conversation: gaps, fault counts, cost and audit."""
    schema = _HEAD.format(id=kind)
    shape = _arrow(schema, chunks.sparkSession)

    def finish(now):
        cost, audit = goal(now["prefix"])
        span = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return {"conv_id": now["conv_id"], "gaps": span, "cost": cost, "audit": audit} | {k: now[k] for k in _SUMS}

    def join(batches):
        out, now = [], None
        for new, row in _grouped(batches, "conv_id"):
            if new:
                if now is not None:
                    out.append(finish(now))
                now = {"conv_id": row["conv_id"], "prefix": {0: (0, None)}, "low": None, "high": None, "turns": 0, "last": None} | dict.fromkeys(_SUMS, 0)
            for k in _SUMS:
                now[k] += row[k]
            if now["last"] is not None:
                now["illegal"] += now["last"] + row["first"] not in _LEGAL
            now["last"] = row["last"]
            if row["low"] is not None:
                now["turns"] += row["turns"] - (now["high"] == row["low"])  # a turn may go on from the chunk before
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = row["high"]
            pairs = ((p, q) for p in STATES for q in STATES)
            table = {pq: (c, a) for pq, c, a in zip(pairs, row["costs"], row["audits"]) if c is not None}
            now["prefix"] = joined(now["prefix"], table)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        if now is not None:
            out.append(finish(now))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(join, schema)


def edited(rows, audit: str):
    """Apply an audit to rows (turn, role, text) as they come: yields (edit, turn, role, text)."""
    state, rows = 0, iter(rows)
    for letter in audit:
        turn, role, text = (None, None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = ROLES["a" if state == 2 else "u"]
        state = NEXT[state, role[:1]]
        yield letter, turn, role, text


def repaired_rows(ordered: DataFrame, heads: DataFrame, kind: str) -> DataFrame:
    """conv_id, nth, edit, turn, role, text of the repaired conversations, in order within a partition.

    The audit of a conversation leads its rows in a sorted stream and is applied as they pass.
    """
    schema = f"conv_id {kind}, nth long, edit string, turn long, role string, text string"
    shape = _arrow(schema, ordered.sparkSession)

    def stream(batches):
        rows = _grouped((part for b in batches for part in _light(b)), "conv_id")
        waiting = next(rows, None)
        out, size = [], 0
        while waiting is not None:
            head = waiting[1]
            waiting = None

            def of_conversation():
                nonlocal waiting
                for new, row in rows:
                    if new:
                        waiting = (new, row)
                        return
                    yield row["turn"], row["role"], row["text"]

            own = of_conversation()
            for nth, (edit, turn, role, text) in enumerate(edited(own, head["audit"])):
                out.append({"conv_id": head["conv_id"], "nth": nth, "edit": edit, "turn": turn, "role": role, "text": text})
                size += len(text) + 100
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out, size = [], 0
            for _ in own:
                raise AssertionError("an audit has a letter for every row")
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    led = heads.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"),
                       F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = led.unionByName(ordered.select("conv_id", "at", "turn", "role", "text", F.lit(None).cast("string").alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(stream, schema)


def _light(batch: pa.RecordBatch):
    """Slices of a batch with little text each."""
    for start, part in text_slices(batch.column(batch.schema.get_field_index("text"))):
        yield batch.slice(start, len(part))


def digests(repaired: DataFrame, kind: str) -> DataFrame:
    """conv_id and the SHA-256 of its newline-joined ``role:text`` lines, from rows in order."""
    schema = f"conv_id {kind}, repaired_sha256 string"
    shape = _arrow(schema, repaired.sparkSession)

    def hashed(batches):
        out, sha, conv = [], None, None
        for new, row in _grouped(batches, "conv_id"):
            if new:
                if sha is not None:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                sha, conv = hashlib.sha256(), row["conv_id"]
            else:
                sha.update(b"\n")
            sha.update(f"{row['role']}:{row['text']}".encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        if sha is not None:
            out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return repaired.mapInArrow(hashed, schema)


def repair(rows: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, turn, role, text) rows: a head per conv_id of ``conversations`` (also those without a
    row), and the repaired rows."""
    kind = dict(rows.dtypes)["conv_id"]
    ordered = in_order(rows)
    heads = conversation_heads(chunk_tables(with_faults(ordered), kind), kind)
    ids = conversations.select("conv_id").distinct()
    own = heads.withColumnRenamed("conv_id", "of_conv")
    whole = ids.join(own, ids["conv_id"].eqNullSafe(own["of_conv"]), "left").drop("of_conv")
    heads = stored(whole.fillna(0, ["gaps", *_SUMS, "cost"]).fillna("", ["audit"]), "conversation-heads")
    return heads, repaired_rows(ordered, heads, kind)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' heads with the digest of what the repair makes of them."""
    heads, rows = repair(damaged(conversations), conversations)
    found = digests(rows, dict(heads.dtypes)["conv_id"]).withColumnRenamed("conv_id", "of_conv")
    met = heads.join(found, heads["conv_id"].eqNullSafe(found["of_conv"]), "left").drop("of_conv")
    return met.fillna(_EMPTY_SHA, ["repaired_sha256"])
