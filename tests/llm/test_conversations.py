"""Repairs against a search over all edits, whole and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from corpusloom.llm import conversations as C

SCHEMA = "role string, text string, conv_id long, turn long, copies string, kind int, seg long"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, edits) and what is left, by a shortest-path search over (turn, roles so far); turns: (role, text, gone, cut)."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, left = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", state):
            return cost, audit, left
        # of equal cost and place, all edits so far are followed, since a longer one may lead to the lesser string
        if (cost, audit, i, state[-1:]) in done or cost > 4 * len(turns):
            continue
        done.add((cost, audit, i, state[-1:]))
        for role in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", state + role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, _short(state + role[0]), (*left, f"{role}:")))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, left))
            for letter, now, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)] if not gone else []:
                if re.fullmatch("s?(ua)*u?", state + now[:1]) and now[:1]:
                    heapq.heappush(heap, (cost + price + 3 * cut, audit + letter, i + 1, _short(state + now[:1]), (*left, f"{now}:{text}")))


def _short(state):
    return state[:3] if len(state) > 4 and state.startswith("sua") and state.endswith("a") else state


def brute(rows):
    out, convs = [], {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r[1:])
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            bare = text.strip(C.SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), fault == 2))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, left = cheapest(judged)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def given(spark, rows):
    return C.damaged(spark.createDataFrame([(r, x, c, t, "7", 1, 2) for c, t, r, x in rows], SCHEMA))


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made_up(n, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    texts = ["Yes.", "No!", "cut off", " \t\n", "", None, "A long one. Or not", "Same?", "日本語。", "x" * 50 + "."]
    rows = []
    for c in range(n):
        at = rng.choice([0, 0, 5, -3])
        for _ in range(rng.randint(1, longest)):
            at += rng.choice([1, 1, 1, 1, 2, 0])
            rows.append((c if c else None, None if rng.random() < 0.08 else at, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talks():
    rows = made_up(120, 6, 1)
    return rows, brute(rows)


def test_equals_brute_force(spark, talks):
    rows, want = talks
    df = C.repaired(given(spark, rows))
    assert df.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    assert plain(df) == want


@pytest.mark.parametrize("size", [1, 2, 8192])
def test_segments_change_nothing(spark, talks, monkeypatch, size):
    rows, want = talks
    monkeypatch.setattr(C, "SEGMENT_ROWS", size)
    assert plain(C.repaired(given(spark, rows), long_rows=2)) == want


def test_long_conversation_in_segments_is_that_of_one_task(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(7, k // 2 if k % 9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut", "", f"{rng.randint(0, 99)}!", f"{k}."])) for k in range(3000)]
    rows += [(8, 1, "user", "Hi.")] * 500 + [(9, k, "user", "Hi.") for k in range(500)]
    whole = plain(C.repaired(given(spark, rows)))
    monkeypatch.setattr(C, "SEGMENT_ROWS", 64)
    assert plain(C.repaired(given(spark, rows), long_rows=300)) == whole
    assert plain(C.repaired(given(spark, rows), long_bytes=900)) == whole
    assert {r[0]: len(r[7]) >= 500 for r in whole} == {7: True, 8: len(damage(rows[3000:3500])) > 0, 9: True}


def test_small_batches_change_nothing(spark, talks, monkeypatch):
    rows, want = talks
    monkeypatch.setattr(C, "BATCH_ROWS", 5)
    assert plain(C.repaired(given(spark, rows))) == want


def test_empty_and_all_dropped(spark):
    assert plain(C.repaired(given(spark, []))) == []
    dropped = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Hi.") for c, t in dropped]
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in plain(C.repaired(given(spark, rows))))
    assert all(r[7] == "" for r in plain(C.repaired(given(spark, rows), long_rows=0)))


def test_very_long_text_and_wide_turns(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, (1 << 63) - 1, "assistant", " " * 300_000), (2, -(1 << 63), "user", "A."), (2, (1 << 63) - 1, "assistant", "B.")]
    got = {r[0]: r for r in plain(C.repaired(given(spark, rows)))}
    assert got[2][1] is None or len(damage(rows[2:])) < 2
    assert got[1] == brute(rows[:2])[0]


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    result = con.execute(C.ORACLE)
    df = C.op12_conversation_repair(spark, sf)
    assert [d[0] for d in result.description] == df.columns
    assert plain(df) == sorted(result.fetchall(), key=repr)


def test_sql_on_odd_rows(spark, talks):
    rows, want = talks
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(C.ORACLE).fetchall(), key=repr) == want
