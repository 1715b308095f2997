"""Longest common runs of words against all pairs, and an answer with a sentence that no source holds."""

import random

import pytest

from textloom.operators import grounding


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_all_pairs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 3))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        want = [max((n for n in range(1, k + 2) for t in texts for i in range(len(t) - n + 1) if t[i : i + n] == words[k + 1 - n : k + 1]), default=0) for k in range(len(words))]
        assert grounding.WordAutomaton(texts).runs(words) == want
        held = {j for k, n in enumerate(want) if n >= 3 for j in range(k - n + 1, k + 1)}
        got = grounding.spans(want, 3)
        assert {j for a, b in got for j in range(a, b + 1)} == held and all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))


def test_a_planted_sentence_is_found(spark):
    hits = [(1, 1, "The controller shall reset the card within ten cycles. Other matter follows."), (1, 2, "Voltage is 3.3 V at most, as stated."), (2, 1, None), (4, 1, "Some words here and there.")]
    answers = [
        (1, 'The controller shall reset "the card" within ten cycles [1]. The moon is made of green cheese [2]. Voltage is 3.3 V at most [1]. Voltage is 3.3 V at most.'),
        (2, "Nothing is known [1]."), (3, "No hits at all."), (4, None), (5, " [9] "), (6, "It is said [7]."),
    ]
    hits, answers = spark.createDataFrame(hits, "query_id long, rank long, text string"), spark.createDataFrame(answers, "query_id long, answer string")
    got = {(r.query_id, r.sentence_no): r for r in grounding.aligned(answers, hits).collect()}
    assert [got[1, k].is_supported for k in range(4)] == [True, False, False, True]
    assert got[1, 0].n_words == got[1, 0].n_supported == 9 and [tuple(s) for s in got[1, 0].spans] == [(0, 8)] and got[1, 1].spans == []
    valid = {r.query_id: r for r in grounding.validated(answers, hits).collect()}
    assert set(valid) == {1, 2, 3, 4, 5, 6} and not any(r.is_valid for r in valid.values())
    assert valid[1].unsupported == ["The moon is made of green cheese [2].", "Voltage is 3.3 V at most [1]."] and valid[4].supported == 0
    good = spark.createDataFrame([(1, "Voltage is 3.3 V at most [2]. Other matter follows [1].")], "query_id long, answer string")
    assert tuple(grounding.validated(good, hits).first()) == (1, 1.0, [], True)
    assert grounding.validated(answers.limit(0), hits).count() == 0
