"""Cuts against all ways to cut, and all ways to name characters."""

import itertools
import random

import pytest

from corpusloom.functions import segment


def ways(run):
    if not run:
        yield ()
    for k in range(1, len(run) + 1):
        for rest in ways(run[k:]):
            yield (run[:k], *rest)


def brute_path(run, words):
    total = sum(words.values())
    price = lambda p: segment.cost(words.get(p, 1), total)
    good = [w for w in ways(run) if all(len(p) == 1 or p in words for p in w)]
    return list(min(good, key=lambda w: (sum(map(price, w)), [-len(p) for p in w])))


@pytest.mark.parametrize("seed", range(30))
def test_best_path_of_all(seed):
    r = random.Random(seed)
    letters = "甲乙丙丁"
    words = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 2, 3, 4]))): r.choice([1, 1, 2, 5, 40]) for _ in range(r.randint(1, 14))}
    cutter = segment.Segmenter(words, False)
    for _ in range(20):
        run = "".join(r.choice(letters + "戊") for _ in range(r.randint(1, 9)))
        assert cutter.best_path(run) == cutter.cut(run) == brute_path(run, words)


def test_equal_costs_take_the_longer_word():
    assert segment.Segmenter({"ab": 1, "bc": 1, "a": 1, "c": 1, "abc": 1}, False).cut("abc") == ["abc"]
    assert segment.Segmenter({"ab": 1, "cd": 1, "abc": 1, "d": 1}, False).cut("abcd") == ["abc", "d"]


@pytest.mark.parametrize("seed", range(10))
def test_unknown_words_of_all_states(seed):
    r = random.Random(seed)
    words = {"".join(r.choice("甲乙丙丁戊") for _ in range(r.choice([1, 2, 2, 3]))): r.randint(1, 9) for _ in range(12)}
    begin, follow, char = model = segment._model(words)
    for _ in range(10):
        run = "".join(r.choice("甲乙丙丁戊己") for _ in range(r.randint(2, 7)))
        best = None
        for states in itertools.product("BMES", repeat=len(run)):
            if states[0] in "BS" and states[-1] in "ES" and all(b in segment.FOLLOWS[a] for a, b in zip(states, states[1:], strict=False)):
                price = begin[states[0]] + sum(follow[p] for p in zip(states, states[1:], strict=False)) + sum(char.get((s, c), char[s, ""]) for s, c in zip(states, run, strict=True))
                key = (price, [("E", "S").index(states[-1])] + ["BMES".index(s) for s in reversed(states[:-1])])
                best = min(best or (key, states), (key, states))
        cut = segment.viterbi(run, model)
        shape = [s for w in cut for s in ("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")]
        assert "".join(cut) == run and shape == list(best[1])


def test_segments_of_a_table(spark):
    words = spark.createDataFrame([("北京", 50), ("北京大学", 20), ("大学", 30), ("学生", 30), ("大学生", 25), ("生", 5), ("来", 9), ("北京", 10), (None, 3), ("", 3), ("x", 0)], "word string, count long")
    rows = [(1, "北京大学生来 BEIJING2024, 北京大学", "a"), (2, None, "b"), (3, "", "c"), (4, "彳亍 学", "d"), (5, "北京" * 30_000, "e")]
    df = segment.with_segments(spark.createDataFrame(rows, "id long, text string, runs string"), "text", words)
    got = {r["id"]: r["tokens"] for r in df.collect()}
    assert df.columns == ["id", "text", "runs", "tokens"]
    assert got[1] == ["北京", "大学生", "来", "BEIJING2024", "北京大学"] and got[2] == got[3] == [] and "".join(got[4]) == "彳亍学" and got[5] == ["北京"] * 30_000
    assert segment.with_segments(df.limit(0), "text", words, "more").collect() == []
    with pytest.raises(ValueError):
        segment.word_list(words, 3)
