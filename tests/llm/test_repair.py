"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from itertools import product

import pytest

from terrasift.llm import conversation_repair
from terrasift.llm.conversation_repair import damaged, repair, repaired_turns

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit int, seen string"


def judge(turns):
    """(role, text, fault) of turns in their order."""
    seen, out = set(), []
    for _, role, text in turns:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def plain(turns):
    """Cost, audit and repaired text: all edits of each turn, with up to two inserts before each and at the end."""
    judged = judge(turns)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    @lru_cache(None)
    def rest(at, initials):
        """The least of what remains behind roles whose initials matter by their last one, and whether there are any."""
        best = None
        for put in inserts:
            now = initials + "".join(r[0] for r in put)
            if re.fullmatch(r"(s?(ua)*u?)?", now) is None:
                continue
            cost, audit, text = 5 * len(put), "I" * len(put), tuple(f"{r}:" for r in put)
            options = []
            if at == len(judged):
                if GRAMMAR.fullmatch(now):
                    options.append((cost, audit, text))
            else:
                role, said, fault = judged[at]
                more = 5 if fault == "truncated" else 0
                edits = [(2, "D", None)]
                if fault in (None, "truncated"):
                    edits += [(more, "K", role), (1 + more, "R", "user"), (1 + more, "R", "assistant")]
                for price, letter, to in edits:
                    after = now + (to[:1] or "?" if to is not None else "")
                    if re.fullmatch(r"(s?(ua)*u?)?", after) is None:
                        continue
                    tail = rest(at + 1, short(after))
                    if tail:
                        options.append((cost + price + tail[0], audit + letter + tail[1], text + ((f"{to}:{said}",) if to is not None else ()) + tail[2]))
            best = min([*options, *([best] if best else [])], default=None)
        return best

    def short(initials):
        return initials if len(initials) < 3 else "ua" if initials.endswith("a") else "u"

    return rest(0, "")


def wanted(rows):
    """The whole result for rows (conv_id, turn, role, text, there)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(turn, " " if role is None else role, " " if text is None else text) for c, turn, role, text, there in rows if c == conv and there]
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = Counter(f for *_, f in judge(mine))
        known = [t for t, *_ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = plain(mine)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def made(rng, conv):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "umpire", None], ["One.", "Two!", "Three", "  ", "", None, "Yes?\n", "no \t"]
    turns = rng.randint(0, 7)
    return [(conv, rng.choice([i, i, i, None, max(i - 1, 0), i + 3]), rng.choice(roles), rng.choice([*texts, f"Text {i}.", f"Open {i}"]), rng.random() < 0.95) for i in range(turns)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [row for conv in [*range(150), None] for row in made(rng, conv)]
    out += [(500, i, r, t, True) for i, (r, t) in enumerate(product(["user", "assistant", "system"], ["A.", "B", " ", "A."]))]
    out += [(501, 0, "user", "Dropped.", False), (502, None, "user", None, True), (503, 5, "assistant", "x" * 100_000, True)]
    return out


def results(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("trim", [conversation_repair.TRIM, 1])
def test_repair(spark, rows, trim, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, there boolean, audit int, seen string").repartition(5)
    if trim == 1:
        run = conversation_repair._walked

        def walked(batches):
            conversation_repair.TRIM = 1
            yield from run(batches)

        monkeypatch.setattr(conversation_repair, "_walked", walked)
    assert results(repair(frame, frame["there"])) == wanted(rows)


def test_repaired_turns(spark, rows):
    """The turns that come out hash to what the forward pass says, and follow the grammar."""
    frame = spark.createDataFrame([r[:4] for r in rows if r[4]], "conv_id long, turn long, role string, text string")
    found = repair(frame)
    texts = {}
    for r in sorted(repaired_turns(frame, found).collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, (*_, sha) in results(found).items():
        turns = texts.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == sha
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in turns))


def test_long(spark):
    """Audit strings are trimmed on the way."""
    rng = random.Random(4)
    turns = [(1, i, rng.choice(["user", "assistant", "system"]), f"Turn {rng.randint(0, 400)}" + rng.choice(["", ".", "?"]), True) for i in range(900)]
    assert results(repair(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string, there boolean"))) == wanted(turns)


def test_damage(spark):
    """Each kind of fault, on ids whose checksum asks for it."""
    import zlib

    rows = [(c, t, "assistant", "A. B? C!") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    found = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = Counter()
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind != 0] += 2 if kind == 3 else 1
    assert Counter(map(tuple, found.collect())) == out


def test_empty(spark):
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
