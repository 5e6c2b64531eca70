"""Conversation repair against exhaustive search."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from genomeframe.llm import conversations
from genomeframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
FOLDER = "/root/testdata/sf0.001"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    """One fault a row, rows of a conversation in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.sub("[\x20\x09-\x0d]+", "", text)
        if not words:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def prefix(roles):
    """Whether more roles can make it legal."""
    return re.fullmatch("s?(ua)*u?", roles) is not None


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every sequence of edits, at most three inserts in a row."""
    kinds = faults(rows)

    @functools.cache
    def rest(i, roles, inserts):
        state = ("s" if roles == "s" else "") + roles[-1:]
        found = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            stay = kinds[i] == "truncated"
            cost, audit, made = rest(i + 1, roles, 0)
            found.append((3 + cost, "D" + audit, made))
            if kinds[i] not in ("blank", "duplicate"):
                for edit, extra, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if prefix(roles + new[:1]) and new[:1]:
                        cost, audit, made = rest(i + 1, roles + new[:1], 0)
                        found.append((extra + stay + cost, edit + audit, ((new, text), *made)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if prefix(roles + new[0]):
                    cost, audit, made = rest(i, roles + new[0], inserts + 1)
                    found.append((2 + cost, "I" + audit, ((new, ""), *made)))
        return min(found, default=(10**6, "", ()), key=lambda f: f[:2])

    return rest(0, "", 0)


def expected(rows, order=lambda r: (r[1] is not None, r[1] or 0)):
    out = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        out[row[0]].append(row)
    for conv, own in out.items():
        own.sort(key=order)
        kinds, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, made = cheapest(tuple(own))
        roles = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def got(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def random_rows(seed, conversations_, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in rnd.sample(range(12), rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            rows.append((conv, turn, role, rnd.choice(["a.", "b?", "c", " \n", "d! \t", "e.\n"])))
    return rows


@pytest.mark.parametrize("most", [conversations.SPILL_BYTES, 2])
def test_report_equals_exhaustive_search(spark, most):
    rows = random_rows(5, 300, 6)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = got(conversations.report(conversations.damaged(frame), most))
    assert found == expected(rows)


def test_query_equals_exhaustive_search(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(QUERIES["op13_conversations"](spark, FOLDER)) == expected([tuple(r) for r in rows])


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = random_rows(6, 40, 6)
    damaged = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    made = {conv: [] for conv, *_ in rows}
    for r in conversations.repaired(damaged).orderBy("conv_id", "place").collect():
        assert r.place == len(made[r.conv_id])
        made[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {conv: hashlib.sha256("\n".join(lines).encode()).hexdigest() for conv, lines in made.items()}
    assert digests == {r[0]: r[-1] for r in conversations.report(damaged).collect()}


def test_awkward_rows(spark):
    """Nulls in every column, repeated rows, equal turns, a very long text, other columns."""
    rows = [
        (None, None, None, None, "x"),
        (None, 1, "user", "No id.", "x"),
        (1, None, "user", "No turn.", None),
        (1, 5, "assistant", "After it.", None),
        (2, 3, "user", "Twice.", "a"),
        (2, 3, "user", "Twice.", "b"),
        (3, 1, "", "", None),
        (4, 1, "user", "long " * 40_000 + ".", None),
        (4, 2, "assistant", "é퟿ .", None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA + ", tie string")
    found = got(conversations.report(conversations.damaged(frame)))
    assert found == expected([r[:4] for r in rows])


def test_no_rows_after_damage(spark):
    dropped = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(7, dropped, "user", "Gone.")], SCHEMA)
    assert got(conversations.report(conversations.damaged(frame))) == {
        7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    }
    assert conversations.repaired(conversations.damaged(frame)).count() == 0


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert conversations.report(conversations.damaged(frame)).count() == 0


def test_a_conversation_longer_than_its_batches(spark):
    """State is carried across Arrow batches, backpointers through the file."""
    n = 25_000
    rows = spark.range(n).selectExpr(
        "9L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('Turn ', id, '.') text"
    )
    found = conversations.report(rows, most=1_000).collect()
    assert [(r.cost, r.illegal, r.audit) for r in found] == [(0, 0, "K" * n)]
