"""Prefix trie against prefixes listed one by one."""

import hashlib
import math
import random
import re
import zlib

from annospark.llm import trie
from annospark.llm.queries import rebuilt


def brute(conversations):
    """Rows of (conv_id -> list of (role, text))."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(conversations[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def rebuilt_brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    return out


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, conversations):
    return spark.createDataFrame([(c, k, r, t) for c, ts in conversations.items() for k, (r, t) in enumerate(ts)], SCHEMA)


def test_equals_all_prefixes(spark, make_docs):
    make_docs([])
    rnd = random.Random(1)
    conversations = {}
    for c in range(120):
        base = list(conversations[rnd.randrange(c)]) if c and rnd.random() < 0.7 else []
        cut = rnd.randint(0, len(base))
        conversations[c] = base[:cut] + [(rnd.choice("ua"), rnd.choice(["a b", "c", "d  e\tf", ""])) for _ in range(rnd.randint(0, 5))] \
            or [("u", "x")]
    main = [("u", f"t{k}") for k in range(40)]  # leaves one path at every depth
    conversations |= {1000 + k: main[:k] + [("a", f"side {k}")] for k in range(40)}
    conversations |= {2000 + k: main for k in range(700)}  # copies, whose ids fill two blocks
    assert nodes(trie.prefix_trie(trie.turn_digests(table(spark, conversations)))) == brute(conversations)


def test_rebuilt_with_nulls_and_repeats(spark, make_docs):
    make_docs([])
    rnd = random.Random(3)
    rows = []
    for c in [*range(20, 60), 100, 101, 102, 119, -7, -20, -33]:
        for k in range(rnd.randint(1, 5)):
            rows.append((c, k, rnd.choice(["user", None]), rnd.choice([f"text {c % 3} {k}", None, "", f"w{k} " * 5])))
    rows += [(33, None, "system", "first"), (33, None, "system", "first"), (None, 0, "user", "no id"), (119, 99, "x", "long " * 50000), (142, 0, "user", "its only turn goes")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS path", "1 AS end", "2 AS n", "3 AS h")
    got = nodes(trie.prefix_trie(rebuilt(df)))
    assert got == brute(rebuilt_brute(rows))
    assert any(not ts for ts in rebuilt_brute(rows).values())  # a conversation without turns is among them


def test_empty_table(spark, make_docs):
    make_docs([])
    assert nodes(trie.prefix_trie(rebuilt(spark.createDataFrame([], SCHEMA)))) == []
