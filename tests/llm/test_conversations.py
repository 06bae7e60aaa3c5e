import functools
import hashlib
import re
import zlib

import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillwatch.llm import conversations as op
from tillwatch.llm.conversations import damaged, derive, goal, joined, repair, repaired_conversations

WELL = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, audit), and what it makes of the rows, by plain recursion over the suffixes."""

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        wants = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 2:
            c, a, r = best(i, wants, inserted + 1)
            found.append((c + 5, "I" + a, (({"u": "user", "a": "assistant"}[wants], ""), *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                initial = role[:1]
                if initial == wants or (state == "" and initial == "s"):
                    c, a, r = best(i + 1, initial, 0)
                    found.append((c + more, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, wants, 0)
                found.append((c + more + 1, "R" + a, (({"u": "user", "a": "assistant"}[wants], text), *r)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(table):
    rows = damage(table)
    out = {}
    for conv in {r[0] for r in table}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        faults = faults_of(own)
        cost, audit, made = cheapest(tuple(own), tuple(faults))
        assert WELL.fullmatch("".join(r[0] for r, _ in made)) is not None
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got_of(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}


def made_up(rng, conversations):
    table = []
    for conv in range(conversations):
        turn = rng.randint(-3, 5)
        for _ in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "User"])
            text = rng.choice(["Yes.", "No!", "open end", " \n", None, "", f"say {rng.randint(0, 9)}? ", "é .", "日本。"])
            table.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 5])
    return table


@pytest.mark.parametrize("bits", [8, 1])
def test_equals_brute_force(spark, rng, monkeypatch, bits):
    """Also with chunks of two rows, so that conversations are joined from several."""
    monkeypatch.setattr(op, "CHUNK_BITS", bits)
    table = made_up(rng, 150) + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (500, None, "user", "x."), (501, None, None, None)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({n: F.lit("x") for n in ("at", "fault", "audit", "mark", "copy")})
    assert got_of(repaired_conversations(df)) == brute(table)


def test_long_conversation_in_chunks_is_solved_as_a_whole(rng):
    """The joined tables of any cut give the weight of the uncut rows."""
    for _ in range(30):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 30))]
        whole = goal(joined({0: (0, None)}, derive(rows)))
        prefix, i = {0: (0, None)}, 0
        while i < len(rows):
            j = i + rng.randint(1, 6)
            prefix, i = joined(prefix, derive(rows[i:j])), j
        assert goal(prefix) == whole


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """Repeated rows and turns that meet at the borders of chunks and partitions."""
    monkeypatch.setattr(op, "CHUNK_BITS", 4)
    table = [(9, k // 3, ["user", "assistant"][k % 2], f"text {k % 50}.") for k in range(0, 900, 2)] + [(9, None, "system", "be kind.")]
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(6)
    heads, made = repair(rows, rows)
    head = heads.collect()[0]
    assert head["duplicate"] == len(table) - len({(r, t) for _, _, r, t in table})
    assert head["gaps"] == max(t for _, t, _, _ in table[:-1]) + 1 - len({t for _, t, _, _ in table[:-1]})
    lines = [(r["role"], r["edit"]) for r in made.orderBy("nth").collect()]
    assert WELL.fullmatch("".join(r[0] for r, _ in lines)) and [e for _, e in lines] == list(head["audit"].replace("D", ""))


def test_empty_tables_and_other_id_types(spark):
    df = spark.createDataFrame([("a", 1, "user", "hi."), ("a", 2, "assistant", "yo."), (" ", 1, "user", "hm")], "conv_id string, turn int, role string, text string")
    assert got_of(repaired_conversations(df)) == brute([tuple(r) for r in df.collect()])
    assert repaired_conversations(df.limit(0)).count() == 0
    assert damaged(df.withColumn("turn", F.lit("x"))).filter("turn IS NOT NULL").count() == 0


def test_query_on_the_test_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_of(contract.queries()["op13_conversation_repair"](spark, SF)) == brute(table)
