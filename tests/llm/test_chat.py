from __future__ import annotations

import itertools
import random

from spheregrid.llm.chat import INSERT, MERGE, NEXT, RELABEL, ROLES, repair


def least(roles):
    """The cheapest repair by trying, for every turn, every role, merge and insertion."""
    best = {"start": 0}
    legal = lambda path: all(b in NEXT[a] for a, b in itertools.pairwise(path))
    for role in roles:
        new = {}
        for state, cost in best.items():
            options = [(state, cost + MERGE + RELABEL * (role != state))] if state != "start" else []
            for n in range(3):
                for path in itertools.product(ROLES, repeat=n + 1):
                    if legal([state, *path]):
                        options.append((path[-1], cost + INSERT * n + RELABEL * (role != path[-1])))
            for to, c in options:
                new[to] = min(c, new.get(to, 10**9))
        best = new
    ends = [cost + INSERT * n for state, cost in best.items() for n in range(3) for path in itertools.product(ROLES, repeat=n) if legal([state, *path]) and [state, *path][-1] == "assistant"]
    return min(ends)


def test_repairs(spark):
    rng = random.Random(2)
    rows, convs = [], {}
    for conv in range(60):
        roles = rng.choices(["user", "assistant", "system", None, "tool"], [4, 4, 1, 0.5, 0.5], k=rng.randrange(1, 12))
        convs[conv] = roles
        rows += [(conv, k, r, f"t{k}" if k % 3 else None, 1) for k, r in enumerate(roles)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    for segment, group in ((512, 256), (2, 2)):
        got = {}
        for r in repair(table, segment, group).collect():
            got.setdefault(r["conv_id"], []).append(r)
        assert sorted(got) == sorted(convs)
        for conv, own in got.items():
            own.sort(key=lambda r: r["position"])
            assert [r["position"] for r in own] == list(range(len(convs[conv])))
            assert [r["role"] for r in own] == convs[conv]
            cost = sum(MERGE * r["action"].endswith("merge") + RELABEL * r["action"].startswith("relabel") + INSERT * len(r["inserted"]) for r in own)
            assert cost == own[0]["cost"] == least(convs[conv])
            text = "".join(r["piece"] for r in own)
            said = [part.split("|>\n", 1)[0].removeprefix("<|") for part in text.split("<|end|>\n") if part]
            assert all(b in NEXT[a] for a, b in itertools.pairwise(["start", *said])) and said[-1] == "assistant"
            assert all(r["text"] in text for r in [{"text": f"t{k}"} for k in range(len(own)) if k % 3])


def test_chat_edges(spark):
    table = spark.createDataFrame([(None, None, None, None), (1, None, "user", "a"), (1, None, "user", "a"), (2, 5, "assistant", "b" * 100000)], "conv_id long, turn long, role string, text string")
    got = sorted([(r["conv_id"], r["new_role"], r["action"], r["cost"]) for r in repair(table).collect()], key=str)
    assert got == sorted([(None, "user", "relabel", 5), (1, "user", "keep", 2), (1, "assistant", "relabel", 2), (2, "assistant", "keep", 3)], key=str)
    assert repair(table.where("false")).collect() == []
