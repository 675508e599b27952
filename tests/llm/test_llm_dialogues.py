"""Conversation repair against a search that keeps every cheapest audit."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from caseward.llm import dialogues

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) over all edits; per state all audits of the least cost are kept."""

    def inserted(now):
        todo = [(s, x) for s in now for x in now[s]]
        while todo:
            s, (cost, audit) = todo.pop()
            after, more = (3 if s == 2 else 2), (cost + 3, audit + "I")
            if not audit.endswith("III") and more not in now.setdefault(after, set()):
                now[after].add(more)
                todo.append((after, more))
        return least(now)

    def least(now):
        return {s: set(sorted(x for x in found if x[0] == min(found)[0])[:40]) for s, found in now.items()}

    now = {0: {(0, "")}}
    for role, fault in rows:
        after = {}
        for s, found in inserted(now).items():
            for cost, audit in found:
                after.setdefault(s, set()).add((cost + 4, audit + "D"))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 * (fault == "truncated")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                if to:
                    after.setdefault(to, set()).add((cost + extra, audit + "K"))
                after.setdefault(3 if s == 2 else 2, set()).add((cost + 3 + extra, audit + "R"))
        now = least(after)
    now = inserted(now)
    return min(x for s in (0, 3) for x in now.get(s, ()))


def after_damage(conv, turn, role, text):
    h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
    return [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def brute(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        texts = [" " if x is None else x for x in (role, text)]
        conversations.setdefault(conv, []).extend(after_damage(conv, turn, *texts))
    out = {}
    for conv, given in conversations.items():
        given.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in given:
            rest = text.rstrip(SPACE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in given if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[:1] for _, r, _ in given]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit = cheapest(list(zip(roles, faults, strict=True)))
        lines, row, state = [], 0, ""
        for letter in audit:
            due = "assistant" if state == "u" else "user"
            if letter == "D":
                row += 1
            elif letter == "I":
                lines.append(due + ":")
                state = due[0]
            else:
                role = given[row][1] if letter == "K" else due
                lines.append(f"{role}:{given[row][2]}")
                row, state = row + 1, role[0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(rows, **options):
    return {r[0]: tuple(r[1:]) for r in dialogues.hashed(dialogues.repair(dialogues.damaged(rows), **options)).collect()}


@pytest.fixture(scope="module")
def odd_rows():
    rng, rows = random.Random(3), []
    texts = [None, "", " \n", "yes.", "no", "ok!", "what?  ", "maybe\n", "Same text.", "é ß.", "x" * 3000]
    for conv in range(150):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
            rows.append((conv or None, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(1000, t // 3 if t % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{t}.", "b", "c!", "", f"x{t}"])) for t in range(900)]
    rows += [(None, None, None, None)] * 3
    return rows


def test_repair_equals_brute_force(spark, odd_rows):
    rows = spark.createDataFrame([(*r, 1, None, "x") for r in odd_rows], SCHEMA + ", piece int, gone boolean, audit string").repartition(5)
    assert found(rows) == brute(odd_rows)


@pytest.mark.parametrize("options", [{"piece_rows": 7}, {"long_bytes": 100, "piece_rows": 3}])
def test_conversations_in_pieces_get_the_same_repair(spark, odd_rows, options):
    rows = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    assert found(rows, **options) == brute(odd_rows)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found(spark.createDataFrame([(5, lost, "user", "x")], SCHEMA)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_grammar_gives_back_its_sequences_and_shares_rules():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 9, n) for n in (0, 1, 2, 50, 400)] + [np.full(64, 8), np.tile([2, 4], 100)]
    grammar = dialogues.Grammar([s.copy() for s in sequences])

    def flat(symbol):
        return [symbol] if symbol < dialogues.SYMBOLS else flat(grammar.halves[symbol][0]) + flat(grammar.halves[symbol][1])

    for i, s in enumerate(sequences):
        assert [y for x in grammar.symbols[grammar.starts[i] : grammar.starts[i + 1]] for y in flat(x)] == s.tolist()
    whole = grammar.symbols[grammar.starts[-2] : grammar.starts[-1]]
    assert len(whole) < 10


def test_audits_of_a_symbol_are_no_beginnings_of_one_another():
    for table in dialogues.base_audits():
        audits = {e[1] for row in table for e in row if e[0] < 1 << 30}
        assert not any(a != b and b.startswith(a) for a in audits for b in audits)
