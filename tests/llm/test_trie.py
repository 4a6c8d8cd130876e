"""The prefix trie against nested dictionaries, whole and in small chunks and shards."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32])
    own = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - int(abs(c) % 20 * (1 if c >= 0 else -1)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            node = nodes.setdefault(tuple(whole[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d == len(whole):
                node["ends"].append(c)
            else:
                node["children"].add(tuple(whole[: d + 1]))

    def below(path):
        node, stack, leaves, saved = nodes[path], [path], 0, 0
        while stack:
            at = stack.pop()
            node = nodes[at]
            stack += node["children"]
            leaves += not node["children"]
            saved += (len(node["members"]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1])) if at else 0)
        return leaves, saved

    out = []
    for path, node in nodes.items():
        up = min(nodes[path[:-1]]["members"]) if path else None
        ids = ",".join(map(str, sorted(node["ends"])))
        out.append((min(node["members"]), len(path), up, len(node["members"]), len(node["children"]), *below(path), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("root", "conv", "d", "tid", "words", "place", "known", "path", "state", "shard", "uid")})
    return sorted((tuple(r) for r in trie.prefix_trie(df.repartition(3), **options).collect()), key=str)


def talks(seed, convs, most):
    """Few different turns, so that paths are shared; ids out of order, roots missing or short."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 200), convs):
        for t in range(rng.choice([1, 1, 2, 3, 4, most])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d  e\nf", "", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 2, "shards": 7}, {"chunk": 3, "shards": 1}, {"chunk": 5, "shards": 40}])
def test_trie_equals_dictionaries(spark, options):
    rows = talks(1, 150, 12)
    rows += [(500 + k, t, "user", f"same {t}") for k in range(30) for t in range(7)]  # a large group of copies
    rows += [(580 + k, t, "user", f"same {t}") for k in range(3) for t in range(9)]
    rows += [(1000, t, "user", f"long {t % 3}") for t in range(150)] + [(1020, t, "user", f"long {t % 3}") for t in range(90)]
    assert run(spark, rows, **options) == plain(rows)


@pytest.mark.parametrize("options", [{}, {"chunk": 1, "shards": 5}])
def test_awkward_tables(spark, options):
    rows = [
        (None, 0, "user", "no conversation"), (20, 0, None, None), (20, 0, None, None), (21, 5, "user", "late"), (21, None, "user", "first"), (21, None, "system", "before it"), (21, 5, "user", "late"),
        (25, 0, "user", "short"), (26, 0, "user", "short"), (27, 0, "u", "ser"), (28, 0, "us", "er"), (29, 1, "user", "x " * 50_000), (40, None, None, None), (60, 0, "user", "Ünïcödé 漢字 🙂"), (61, 0, "user", "y"), (62, 1, "user", "z"),
    ]
    assert run(spark, rows, **options) == plain(rows)


def test_no_conversations(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    assert run(spark, [(7, 1, "user", "x")]) == plain([(7, 1, "user", "x")])


def test_a_conversation_over_many_tasks(spark):
    """Places and the root's turns are carried from task to task."""
    rows = [(100, t, "user", f"t{t}") for t in range(400)] + [(101 + k, t, "user", f"t{t}") for k in range(3) for t in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert run(spark, rows, chunk=50, shards=9) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_splitters_and_skeleton(spark):
    rows = [(k, f"{j:032x}" * 3) for j in range(4) for k in range(20 * j, 20 * j + 20)]
    df = spark.createDataFrame(rows, "conv long, path string").selectExpr("conv", "0L as j", "'' as state", "path")
    found = trie._splitters(df, 8, 80)
    assert found == sorted(set(found)) and len(found) == 7 and any(len(s[2]) == 96 for s in found) and any(len(s[2]) == 32 for s in found)
