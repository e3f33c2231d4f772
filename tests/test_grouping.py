"""Grouping in order against a loop that decides one report after another."""

import random

import pytest

from tidemark.operators import grouping as G

REPORT = "id long, place long, duplicate_of long, manual_fact long, historical boolean, is_signal boolean, promotion boolean, current_fact long, relevance string"


def one_by_one(reports, verdicts, facts):
    known, out = dict(facts), {}
    place = {r[0]: (r[1], r[0]) for r in reports}
    for r in sorted(reports, key=lambda r: (r[1], r[0])):
        i, _, dup, manual, hist, sig, promo, cur, rel = r
        tests = [("skipped", dup is not None), ("manual", manual is not None), ("archived", hist), ("signal", sig), ("standalone", promo), ("kept", cur is not None), ("not_relevant", rel != "pass")]
        action = next((a for a, c in tests if c), None)
        fact = {"manual": manual, "kept": cur}.get(action)
        story = known.get(fact)
        if action is None:
            for nth, other, said in sorted((n, o, a) for q, o, a, n in verdicts if q == i):
                if other in known and (other not in place or other in dict(facts) or place[other] < place[i]):
                    action = {"same": "same_fact", "url": "same_url"}.get(said, said)
                    fact = other if said in ("same", "url") else i if said == "development" else None
                    story = None if said == "roundup" else known[other]
                    break
            else:
                action, fact, story = "new_story", i, i
            if action in ("new_story", "development"):
                known[i] = story
        out[i] = (action, fact, story)
    return out


def grouped(spark, reports, verdicts, facts):
    out = G.grouping_in_order(spark.createDataFrame(reports, REPORT), spark.createDataFrame(verdicts, "query long, other long, action string, nth long"), spark.createDataFrame(facts, "fact long, story long"))
    return {r["id"]: (r["action"], r["fact"], r["story"]) for r in out.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = 120
    rare = lambda v, p=0.05: v if rng.random() < p else None
    reports = [(i, rng.randint(0, 40), rare(1), rare(-1), rng.random() < 0.05, rng.random() < 0.05, rng.random() < 0.05, rare(-2), rng.choice(["pass"] * 9 + ["block"])) for i in range(n)]
    verdicts = list({(rng.randrange(n), rng.choice([rng.randrange(n), -rng.randint(1, 9)]), rng.choice(["same", "development", "url", "roundup"]), rng.randint(0, 2)) for _ in range(4 * n)})
    facts = [(-k, -1 - k % 2) for k in range(1, 6)]
    assert grouped(spark, reports, verdicts, facts) == one_by_one(reports, verdicts, facts)


def test_a_chain_and_nothing(spark):
    reports = [(i, i, None, None, False, False, False, None, "pass") for i in range(6)]
    # Each is the same as the one before, which founded a fact only if it joined none itself.
    out = grouped(spark, reports, [(i, i - 1, "same", 0) for i in range(1, 6)], [])
    assert [out[i] for i in range(6)] == [("new_story", 0, 0), ("same_fact", 0, 0), ("new_story", 2, 2), ("same_fact", 2, 2), ("new_story", 4, 4), ("same_fact", 4, 4)]
    assert grouped(spark, [], [], []) == {}
