import hashlib
import heapq
import itertools
import random
import re
import zlib

from covlens.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Per original conv_id, by the contract's words: a shortest-path search over (row, initials so far's state), whole audits compared."""
    out = {}
    by_conv = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kept = by_conv.setdefault(conv, [])
        d = zlib.crc32(key.encode()) % 20
        if d == 1:
            text = ""
        elif d == 2:
            text = re.sub("[.!?]", "", text)
        elif d == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        # states: "" start, "s", "u", "a"; a queue ordered by (cost, audit)
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, at, state, text = heapq.heappop(queue)
            if at == len(kept) and state in ("", "a"):
                break
            if (at, state) in done:
                continue
            done.add((at, state))
            after = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[after]
            heapq.heappush(queue, (cost + 5, audit + "I", at, after, (*text, f"{name}:")))
            if at < len(kept):
                _, role, body = kept[at]
                heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state, text))
                if faults[at] not in ("blank", "duplicate"):
                    stays = 5 * (faults[at] == "truncated")
                    heapq.heappush(queue, (cost + 1 + stays, audit + "R", at + 1, after, (*text, f"{name}:{body}")))
                    if role[:1] == after or (role[:1] == "s" and state == ""):
                        heapq.heappush(queue, (cost + stays, audit + "K", at + 1, role[:1], (*text, f"{role}:{body}")))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def _check(spark, rows, extra=False):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    if extra:
        for c in ("word", "part", "audit", "digest", "col", "copies", "n", "kind"):
            df = df.withColumn(c, df["role"])
    got = [tuple(r) for r in cr.repair_damaged(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows).values(), key=str)
    return got


def _conversation(rng, conv, length):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "util"]
    texts = ["Hello.", "Why?", "no end", " ", "", "End. ", "a.\n", "x", "Hello.", "Ünd!"]
    return [(conv, t, rng.choice(roles[:rng.choice([3, 5, 8])]), rng.choice(texts) + rng.choice(["", "", str(t) + "."])) for t in range(length)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [r for conv in range(400) for r in _conversation(rng, conv, rng.randrange(1, 9))]
    rows += [(7, 2, "user", "again."), (7, 2, "user", "again."), (7, 2, "user", "Again.")]  # ties and repeated rows
    rng.shuffle(rows)
    got = _check(spark, rows, extra=True)
    assert {"D", "K", "R"} == set("".join(r[7] for r in got))  # a deletion is always cheaper than an insertion


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "A."), (1, None, "assistant", "B."), (1, None, "assistant", "B."), (1, 5, None, "C."),
        (2, 1, "user", None), (3, -4, "", "x."), (3, 9, "user", "\x00."), (4, 1, "user", "y" * 200_000 + "."), (4, 2, "assistant", "!" * 70_000),
        (5, None, "user", "only."),
    ]
    _check(spark, rows)


def test_conversation_without_rows_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = _check(spark, [(gone, 0, "user", "Hi.")])
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty(spark):
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_over_many_tasks(spark):
    """One conversation with most rows, longer than the shared suffixes, over many partitions."""
    rng = random.Random(3)
    rows = _conversation(rng, 1, 3_000) + [r for conv in range(2, 30) for r in _conversation(rng, conv, 6)]
    rows += [(1, 50, "user", "same.")] * 40
    _check(spark, rows)


def test_nodes_are_shared_and_forgetting_changes_nothing():
    rng = random.Random(2)
    known, words = cr.Automaton(), ["".join(rng.choice("ABEFIJM") for _ in range(rng.randrange(12))) for _ in range(300)]
    first = [known.solve(w) for w in words]
    suffixes = {w[i:] for w in words for i in range(len(w))}
    assert len(known.node) == len(suffixes)
    size = len(known.costs)
    assert [known.solve(w) for w in words] == first and len(known.costs) == size
    known.clear()
    assert [known.solve(w) for w in words] == first


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _check(spark, rows)
