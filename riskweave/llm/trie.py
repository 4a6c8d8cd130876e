"""Prefix trie of conversations: a skeleton of range-partition splitters, sorted shards, and reductions between them."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, shuffle_partitions

#: Conversations whose ids share this quotient start with turns of the one that it divides.
FAMILY = 20
#: Turns of a conversation that are kept in a row; longer ones are several chunks, each in the trie below the one before.
CHUNK = 64
#: Turns of a shard, about, and the most shards; beyond SHARDS times PER_SHARD turns, shards grow.
PER_SHARD = 200_000
SHARDS = 20_000
#: Sampled rows per shard from which the splitters are taken; they steer only the split.
SAMPLED = 20
#: Skeleton rows that may be broadcast, some 100 bytes each.
BROADCAST = 200_000
_ID = 32  # hex digits that stand for a turn
_ROOT = "0" * _ID
_SHARDED = [
    ("partial", "boolean"), ("shard", "int"), ("uid", "string"), ("parent_uid", "string"), ("parent_conv", "long"), ("conv", "long"), ("depth", "long"), ("n", "long"),
    ("children", "long"), ("leaves", "long"), ("saved", "long"), ("words", "long"), ("skeleton", "boolean"), ("above", "string"), ("ends", "string"),
]
_TYPES = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("root"), conv.alias("conv"), "turn", role.alias("role"),
        F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(_ID)).alias("tid"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )


def _counted(batches):
    """Rows in order of family, its root first: place among the task's rows of its conversation, and turns of the root before."""
    pid, conv, root, place, known = TaskContext.get().partitionId(), None, None, 0, 0
    for batch in batches:
        places, roots = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
        for k, (r, c) in enumerate(zip(batch["root"].to_pylist(), batch["conv"].to_pylist(), strict=True)):
            if c != conv:
                conv, place = c, 0
            if r != root:
                root, known = r, 0
            place += 1
            known += c == r
            places[k], roots[k] = place, known
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(batch.num_rows, pid), pa.int32()), batch["root"], batch["conv"], batch["tid"], batch["words"], pa.array(places), pa.array(roots)], ["pid", "root", "conv", "tid", "words", "place", "known"]
        )


def _numbered(turns: DataFrame) -> DataFrame:
    """(root, conv, tid, words, place, known): places within conversations, and how many turns the family's root has, as far as
    it matters. Conversations of any length are dealt over tasks; what one leaves to the next is a row per task."""
    order = [F.col("root"), F.col("conv") != F.col("root"), F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("tid")]
    dealt = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    local = materialise(dealt.drop("turn", "role").mapInArrow(_counted, "pid int, root long, conv long, tid string, words int, place long, known long"))
    before = lambda key: Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ran = local.groupBy("pid", "conv").agg(F.count("*").alias("n"))
    ran = ran.select("pid", "conv", F.sum("n").over(before("conv")).alias("earlier")).where("earlier > 0")
    rooted = local.groupBy("pid", "root").agg(F.max("known").alias("n"))
    rooted = rooted.select("pid", "root", F.sum("n").over(before("root")).alias("missed")).where("missed > 0")
    whole = local.join(F.broadcast(ran), ["pid", "conv"], "left").join(F.broadcast(rooted), ["pid", "root"], "left")
    none = F.lit(0)
    return whole.select("root", "conv", "tid", "words", (F.col("place") + F.coalesce("earlier", none)).alias("place"), (F.col("known") + F.coalesce("missed", none)).alias("known"))


def _rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv, d, tid, words): the turns of rebuilt conversations from depth 1 on, and a row of depth 0 for each of them."""
    taken = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % 4
    is_root = F.col("conv") == F.col("root")
    own = numbered.where(is_root | (F.col("place") > taken))
    d = F.when(is_root, F.col("place")).otherwise(F.col("place") - taken + F.least(taken, F.col("known")))
    convs = numbered.where("place = 1").select("root", "conv", taken.alias("taken"))
    heads = numbered.where(is_root & (F.col("place") <= 3)).select("root", "tid", "words", "place")
    lent = convs.where(~is_root).join(heads, "root").where("place <= taken")
    rows = own.select("conv", d.alias("d"), "tid", "words").unionByName(lent.select("conv", F.col("place").alias("d"), "tid", "words"))
    return rows.unionByName(convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("tid"), F.lit(0).alias("words")))


def _lanes(*parts) -> list:
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def _hex(a, b):
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _chunks(rebuilt: DataFrame, chunk: int) -> DataFrame:
    """(conv, j, state, next, path, words, last, more_saved, more_leaves): `chunk` turns a row. state stands for all turns before
    the chunk, next for those up to its end if it is full; the last two columns are what a conversation owns below the chunk."""
    j = F.floor(F.greatest(F.col("d") - 1, F.lit(0)) / chunk)
    grouped = rebuilt.groupBy("conv", j.cast("long").alias("j")).agg(F.filter(F.sort_array(F.collect_list(F.struct("d", "tid", "words"))), lambda x: x["d"] > 0).alias("turns"))
    rows = materialise(grouped.select("conv", "j", F.array_join("turns.tid", "").alias("path"), F.col("turns.words").alias("words")))
    short = rows.where((F.col("j") == 0) & (F.size("words") < chunk))
    done = short.select("conv", "j", F.lit(_ROOT).alias("state"), F.lit(None).cast("string").alias("next"), "path", "words", F.lit(True).alias("last"), F.lit(0).cast("long").alias("more_saved"), F.lit(0).cast("long").alias("more_leaves"))
    full = rows.where((F.col("j") > 0) | (F.size("words") == chunk))
    if full.isEmpty():
        return done
    one = Window.partitionBy("conv").orderBy("j")
    so_far, x, y = one.rowsBetween(Window.unboundedPreceding, -1), *_lanes("j", "path")
    full = full.withColumns({"x": x, "y": y})
    full = full.withColumns({"sx": F.coalesce(F.bit_xor("x").over(so_far), F.lit(0)), "sy": F.coalesce(F.bit_xor("y").over(so_far), F.lit(0)), "last": F.lead("j").over(one).isNull()})
    following = F.when(F.size("words") == chunk, _hex(F.col("sx").bitwiseXOR(F.col("x")), F.col("sy").bitwiseXOR(F.col("y"))))
    full = materialise(full.select("conv", "j", _hex(F.col("sx"), F.col("sy")).alias("state"), following.alias("next"), "path", "words", "last"))

    # nodes below the first chunk, each owned by its smallest member
    deep = full.where("j > 0").select("conv", "j", "state", "path", "last", F.posexplode("words").alias("k", "w"), F.size("words").alias("size"))
    p, q = _lanes("j", "state", F.expr(f"substr(path, 1, {_ID} * (k + 1))"))
    goes_on = (F.col("k") + 1 < F.col("size")) | ((F.col("size") == chunk) & ~F.col("last"))
    nodes = deep.withColumns({"p": p, "q": q}).groupBy("j", "p", "q").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("w").alias("w"), F.max(goes_on).alias("inner"))
    owned = nodes.groupBy("conv", "j").agg(F.sum((F.col("n") - 1) * F.col("w")).alias("saved"), F.sum((~F.col("inner")).cast("long")).alias("leaves"))
    below = Window.partitionBy("conv").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
    more = full.join(owned, ["conv", "j"], "left").withColumns({f"more_{c}": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("saved", "leaves")})
    return done.unionByName(more.select(*done.columns))


def _shared(a: str, b: str) -> int:
    """Turns that two paths have in common at their start."""
    if a == b:
        return len(a) // _ID
    lo, hi = 0, min(len(a), len(b)) // _ID
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: _ID * mid] == b[: _ID * mid] else (lo, mid - 1)
    return lo


def _splitters(rows: DataFrame, shards: int, n: int) -> list[tuple]:
    """Up to shards - 1 rows (j, state, path, conv) in order, from a sample by hash. A path is cut where it differs from that
    of the sampled row before, so the trie of all of them stays small; conversations of one path are split by their ids."""
    if shards < 2:
        return []
    every = max(1, n // (SAMPLED * shards))
    sample = rows.where(F.pmod(F.xxhash64("conv", "j"), F.lit(every)) == 0).select("j", "state", "path", "conv")
    found = sorted(map(tuple, sample.collect()))
    out, before = [], ()
    for j, state, path, conv in (found[k * len(found) // shards] for k in range(1, shards if found else 1)):
        alike = _shared(before[2], path) if before[:2] == (j, state) else 0
        same = before[:3] == (j, state, path)
        least = (j, state, path, conv) if same or not path else (j, state, path[: _ID * (alike + 1)], -(2**63))
        before = (j, state, path)
        if not out or least > out[-1]:
            out.append(least)
    return out


class _Shard:
    """The part of the trie that sorted rows make, closed node by node.

    A node lies in one shard unless it is a prefix of the splitter at either end: those are the skeleton. Partial rows are those
    of the skeleton, of chunk ends that go on below, and of the tops of chunks, which count children only.
    """

    def __init__(self, number: int, splitters: list[tuple], chunk: int):
        self.number, self.chunk = number, chunk
        self.ends = [splitters[k] for k in (number - 1, number) if 0 <= k < len(splitters)]
        self.out: dict[str, list] = {c: [] for c, _ in _SHARDED}
        self.up: list[int] = []
        self.stack: list[int] = []
        self.ending: list[list[int]] = []
        self.goes_on: list[bool] = []

    def open(self, uid, depth, words, skeleton, top):
        o, parent = self.out, self.stack[-1] if self.stack else -1
        for c, v in (("partial", top or skeleton), ("shard", self.number), ("uid", uid), ("conv", None), ("depth", depth), ("n", 0), ("children", 0), ("leaves", 0), ("saved", 0), ("words", words), ("skeleton", skeleton)):
            o[c].append(v)
        o["above"].append(",".join(o["uid"][k] for k in self.stack if o["skeleton"][k]) if skeleton else None)
        self.up.append(parent)
        self.stack.append(len(self.up) - 1)
        self.ending.append([])
        self.goes_on.append(False)

    def close(self, depth: int):
        o = self.out
        while len(self.stack) > depth:
            k = self.stack.pop()
            if not o["skeleton"][k]:
                o["saved"][k] += max(0, o["n"][k] - 1) * o["words"][k]
                o["leaves"][k] += not o["children"][k] and not self.goes_on[k]
                o["partial"][k] |= self.goes_on[k]
            p = self.up[k]
            if p >= 0:
                o["children"][p] += not o["skeleton"][k]
                for c in ("n", "leaves", "saved"):
                    o[c][p] += o[c][k]
                o["conv"][p] = o["conv"][k] if o["conv"][p] is None else min(o["conv"][p], o["conv"][k])

    def add(self, rows):
        before = None
        for j, state, path, conv, after, words, last, more_saved, more_leaves in rows:
            same = before is not None and before[:2] == (j, state)
            start = _shared(before[2], path) if same else -1
            self.close(start + 1)
            if start < 0:
                self.open(_ROOT if j == 0 else state, j * self.chunk, 0, j == 0, True)
                start = 0
            fixed = max((_shared(e[2], path) for e in self.ends if e[:2] == (j, state)), default=0)
            for d in range(start + 1, len(words) + 1):
                full = d == self.chunk
                uid = after if full else hashlib.sha256(f"{j}|{state}|{path[: _ID * d]}".encode()).hexdigest()[:_ID] if d <= fixed else None
                self.open(uid, j * self.chunk + d, words[d - 1], d <= fixed, False)
            k, o = self.stack[-1], self.out
            o["n"][k] += 1
            o["conv"][k] = conv if o["conv"][k] is None else min(o["conv"][k], conv)
            o["saved"][k] += more_saved
            o["leaves"][k] += more_leaves
            if last:
                self.ending[k].append(conv)
            else:
                self.goes_on[k] = True
            before = (j, state, path)
        self.close(0)
        return self

    def table(self) -> pa.Table:
        o = self.out
        for k, p in enumerate(self.up):
            partial = p >= 0 and o["partial"][p]
            o["parent_uid"].append(o["uid"][p] if partial else None)
            o["parent_conv"].append(o["conv"][p] if p >= 0 and not partial else None)
            ids = ",".join(map(str, self.ending[k]))
            o["ends"].append((ids or None) if o["partial"][k] else hashlib.sha256(ids.encode()).hexdigest())
            if o["partial"][k] and p < 0 and not o["skeleton"][k]:  # the top of a later chunk: the node itself is in the chunk before
                for c in ("conv", "depth", "n", "leaves", "saved"):
                    o[c][k] = None
        return pa.table({c: pa.array(o[c], _TYPES[t]) for c, t in _SHARDED})


def _digests(batches):
    """(uid, digest) of runs of rows (uid, ends): ids of one node, in order, hashed as they come."""
    at, digest = None, None
    for batch in batches:
        uids, digests = [], []
        for uid, ends in zip(batch["uid"].to_pylist(), map(pa.StringScalar.as_py, batch["ends"]), strict=True):
            if uid != at:
                if at is not None:
                    uids.append(at)
                    digests.append(digest.hexdigest())
                at, digest = uid, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(digests, pa.string())], ["uid", "digest"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["uid", "digest"])


def _reduced(partial: DataFrame) -> DataFrame:
    """Partial rows by node: sums over shards, children of the skeleton, and what skeleton nodes add to those above them."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "children", "leaves", "saved")}
    most = {c: F.max(c) for c in ("parent_uid", "parent_conv", "depth", "words", "skeleton", "above")}
    nodes = materialise(partial.groupBy("uid").agg(F.min("conv").alias("conv"), *[v.alias(c) for c, v in (sums | most).items()]))
    kids = nodes.where("skeleton and parent_uid is not null").groupBy(F.col("parent_uid").alias("uid")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "uid", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    none = F.lit(0).cast("long")
    nodes = nodes.withColumns({"own_leaf": F.when(F.col("skeleton") & (F.col("children") == 0), 1).otherwise(none), "own_saved": F.when(F.col("skeleton"), (F.col("n") - 1) * F.col("words")).otherwise(none)})
    lent = nodes.where("skeleton and above <> '' and own_leaf + own_saved > 0").select(F.explode(F.split("above", ",")).alias("uid"), "own_leaf", "own_saved")
    lent = lent.groupBy("uid").agg(F.sum("own_leaf").alias("lent_leaves"), F.sum("own_saved").alias("lent_saved"))
    nodes = nodes.join(lent, "uid", "left")
    ends = partial.where("ends is not null").select("uid", "shard", "ends").repartition("uid").sortWithinPartitions("uid", "shard")
    nodes = nodes.join(ends.mapInArrow(_digests, "uid string, digest string"), "uid", "left")
    total = {c: F.col(c) + F.col(f"own_{o}") + F.coalesce(f"lent_{c}", none) for c, o in (("leaves", "leaf"), ("saved", "saved"))}
    digest = F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends")
    return materialise(nodes.select("uid", "parent_uid", "parent_conv", "conv", "depth", "n", "children", *[v.alias(c) for c, v in total.items()], digest))


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node of the trie
    of rebuilt conversations.

    Turns go by `turn`, null first, then by role and by a hash of role and text; repeated rows are turns of their own. Null roles
    and texts are empty. Rows without a conv_id belong to no conversation and are left out; other columns are not read; no rows
    give no nodes. A rebuilt conversation starts with the first turns of its family's root, as many as a hash of its id says, and
    goes on with its own. Turns are told apart by 128 bits of SHA-256.

    Sorted by path and id, conversations go to range shards; each finishes the nodes that no splitter runs through, and sends
    partial sums of the others, which are reduced. Conversations of over `chunk` turns are several rows, whose parts of the trie
    hang below each other; what their deeper parts add is summed by owner. `shards` sets how many shards there are.
    The hash of a node's ids is one chain over all of them by definition; they reach it shard by shard.
    """
    rows = materialise(_chunks(_rebuilt(_numbered(_turns(conversations))), chunk))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("turns")).first()
    shards = shards or min(SHARDS, max(shuffle_partitions(rows.sparkSession), -(-(size["turns"] or 0) // PER_SHARD)))
    splitters = _splitters(rows, shards, size["n"])

    def dealt(batches):
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("j", "state", "path", "conv")), strict=True)
            yield batch.append_column("shard", pa.array([bisect_right(splitters, k) for k in keys], pa.int32()))

    def local(key, table):
        columns = [table[c].to_pylist() for c in ("j", "state", "path", "conv", "next", "words", "last", "more_saved", "more_leaves")]
        return _Shard(key[0].as_py(), splitters, chunk).add(sorted(zip(*columns, strict=True), key=lambda r: r[:4])).table()

    kept = "conv long, j long, state string, next string, path string, words array<int>, last boolean, more_saved long, more_leaves long, shard int"
    nodes = rows.select(*[c.split(" ")[0] for c in kept.split(", ")[:-1]]).mapInArrow(dealt, kept)
    nodes = materialise(nodes.groupBy("shard").applyInArrow(local, ", ".join(f"{c} {t}" for c, t in _SHARDED)))
    skeleton = _reduced(nodes.where("partial"))
    above = skeleton.select(F.col("uid").alias("parent_uid"), F.col("conv").alias("upper"))
    above = F.broadcast(above) if above.count() <= BROADCAST else above
    columns = ["conv", "depth", F.coalesce("parent_conv", "upper").alias("parent_conv"), "n", "children", "leaves", "saved", "ends"]
    whole = nodes.where(~F.col("partial"))
    inner = whole.where("parent_uid is null").withColumn("upper", F.lit(None).cast("long"))
    hung = whole.where("parent_uid is not null").join(above, "parent_uid").unionByName(skeleton.join(above, "parent_uid", "left"), allowMissingColumns=True)
    return inner.select(*columns).unionByName(hung.select(*columns)).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle_sql() -> str:
    # CRC-32 of the id's digits: a byte is brought in, then eight shifts
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    codes = "flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return rf"""
WITH t AS (
  SELECT c, tid, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, tid) AS p
  FROM (SELECT conv_id AS c, turn, role, left(sha256(length(role) || ':' || role || text), 32) AS tid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), size AS (SELECT c, max(p) AS n FROM t GROUP BY c
), conv AS (
  SELECT c, c - c % 20 AS root, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: {step}), 4294967295) % 4 AS h FROM size
), rebuilt AS (
  SELECT conv.c, t.p AS d, t.tid, t.w FROM conv JOIN t ON t.c = conv.root AND t.p <= conv.h
  UNION ALL
  SELECT conv.c, t.p - conv.h + least(conv.h, coalesce(size.n, 0)), t.tid, t.w FROM conv JOIN t ON t.c = conv.c AND t.p > conv.h LEFT JOIN size ON size.c = conv.root
), pre AS (
  SELECT c, d, w, string_agg(tid, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM conv
), node AS (SELECT path, d, min(c) AS c, count(*) AS n, max(w) AS w FROM pre GROUP BY path, d
), kid AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT left(path, 32 * k) AS path, sum(leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT node.path, kid.n IS NULL AS leaf, (node.n - 1) * w AS saved, unnest(range(d + 1)) AS k FROM node LEFT JOIN kid USING (path)) GROUP BY ALL
), stop AS (
  SELECT path, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM pre GROUP BY c) JOIN pre USING (c, d) GROUP BY path
)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kid.n, 0) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN kid USING (path) LEFT JOIN stop USING (path)
LEFT JOIN node up ON node.d > 0 AND up.path = left(node.path, 32 * (node.d - 1))
"""
