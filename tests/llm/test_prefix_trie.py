"""The prefix trie against a plain one."""

import hashlib
import random
import re
import zlib

from clauseframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth int, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """Nodes of the rebuilt conversations, each prefix held as it is."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(r or "", x or ""), (r or "", x or "")))
    own = {c: [t[-1] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    children = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in nodes}
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if made[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(*queries.rebuilt_conversations(prefix_trie.numbered_turns(df)))
    return sorted(map(tuple, got.collect()), key=str)


def test_tries_of_awkward_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None])) for c in range(60) if c % 7 for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user", f"same {t}") for c in (100, 101, 102, 121) for t in (None, 0, 0, 5)]  # equal, with ties and nulls
    rows += [(None, 0, "user", "nobody's"), (200, 0, "user", "x"), (200, 0, "user", "x"), (1_000_000, 0, "a", "long " * 50_000), (220, 1, "ab", "c"), (240, 1, "a", "bc")]
    rows += [(1_000_020, t, "user", f"turn {t}") for t in range(300)]  # one long conversation, numbered by several tasks
    assert trie(spark, rows) == plain(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    assert trie(spark, [(3, 1, None, None)]) == plain([(3, 1, None, None)])


def test_ends_pass_through_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    ids = random.Random(1).sample(range(-500, 5000), 700)
    df = spark.createDataFrame([(2, 7, i) for i in ids] + [(0, 7, 1)], "depth long, node long, conv_id long")
    got = {(r.depth, r.node): r.ends_sha256 for r in prefix_trie.digests(df).collect()}
    assert got == {(2, 7): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (0, 7): hashlib.sha256(b"1").hexdigest()}
