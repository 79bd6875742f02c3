"""Linking of parts that are longer than the scope, against all pairs."""

import random

from feedlake.llm import secrets
from feedlake.llm.common import stash

ROLES = [k[3] for k in secrets.KINDS.values()]


def test_links_equal_all_pairs_of_intervals(spark):
    rng, parts = random.Random(4), []
    for row in range(60):
        for kind in range(len(ROLES)):
            at = rng.randrange(3000)
            for _ in range(rng.randrange(4)):
                end = at + rng.choice([5, 40, 300, 1500])
                parts.append((row, kind, at, end))
                at = end + rng.choice([0, 1, 255, 256, 257, 258, 700, 3000])
    got = secrets.link(stash(spark.createDataFrame(parts, "row long, kind int, start long, end long"), "test-input"))
    want = {p for p in parts if p[1] >= len(secrets.STRONG) and any(
        q[0] == p[0] and ROLES[q[1]] != ROLES[p[1]] and max(p[2], q[2]) - min(p[3], q[3]) <= secrets.SCOPE for q in parts)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(parts)


def test_parts_beside_and_within_long_ones_are_reported(spark):
    token, far = "x" * 800, " word" * 60
    texts = [f"auth={token} https://host/x", f"auth={token} user=alice", f"password={token} user=alice", f"user=alice{far} pass=hunter2", f"https://h/{token}?user=alice",
             f"auth={token}{far} https://host/x", f"auth={token}"]
    got = [r["spans"] for r in secrets.secrets(stash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-input")).orderBy("doc_id").collect()]
    assert got == ["weak_secret:0:805,endpoint:806:820", "weak_secret:0:805,weak_identifier:806:816", "assign:0:809,weak_identifier:810:820", "",
                   "endpoint:0:821,weak_identifier:811:821", "", ""]
