"""SimHash fingerprints and their near-duplicate classes by covering locality-sensitive hashing."""

from __future__ import annotations

import struct
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import emptied, filled, materialise, unused
from riskweave.llm.components import connected_components

RADIUS = 2
#: Buckets up to this size are compared directly; larger ones take the neighbour route of _links_by_centre.
DIRECT = 512
_STEP = 1 << 16


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any two words at most `radius` bits apart agree under at least one of them.

    Bit i carries a non-zero vector of radius + 1 binary digits; the mask of a non-zero vector v keeps the bits whose
    vector has an odd product with v. `radius` vectors cannot span the space, so some v is orthogonal to all differing
    bits and its mask hides them.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint_of(text: str | None) -> int:
    """64 majority bits over the XXH64 (seed 42) of a text's 3-word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), 0
    for at in range(0, max(1, len(words) - 2), _STEP):
        part = words[at : at + _STEP + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(part) > 2 else [b" ".join(part)]
        raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        total += len(raw)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, fp) for every row; hash stands for the text, fp is the fingerprint as a signed long. Null and wordless texts
    get zero."""

    def run(batches):
        for pdf in batches:
            fp = [struct.unpack(">q", fingerprint_of(t).to_bytes(8, "big"))[0] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "hash": pdf["hash"], "fp": np.array(fp, np.int64)})

    rows = docs.select(filled(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, hash long, fp long").withColumn("id", emptied(F.col("id")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_in_buckets(buckets: DataFrame) -> DataFrame:
    """Links that join each small bucket's fingerprints at most RADIUS bits apart: a spanning forest, not all pairs."""

    def run(batches):
        for pdf in batches:
            out = []
            for fps, reps in zip(pdf["fps"], pdf["reps"], strict=True):
                x, rep = np.asarray(fps, np.int64).view(np.uint64), np.asarray(reps, np.int64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS
                left = np.ones(len(x), bool)
                for start in range(len(x)):
                    if not left[start]:
                        continue
                    left[start], front = False, [start]
                    while front:
                        at = front.pop()
                        new = np.flatnonzero(near[at] & left)
                        left[new] = False
                        out.append((np.full(len(new), rep[at]), rep[new]))
                        front.extend(new.tolist())
            src = np.concatenate([a for a, _ in out]) if out else np.array([], np.int64)
            dst = np.concatenate([b for _, b in out]) if out else np.array([], np.int64)
            yield pd.DataFrame({"src": src, "dst": dst})

    grouped = buckets.groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("all"))
    return grouped.select(F.col("all.fp").alias("fps"), F.col("all.rep").alias("reps")).mapInPandas(run, "src long, dst long")


def _links_by_centre(hot: DataFrame) -> DataFrame:
    """The exact way for large buckets: two fingerprints are at most 2 bits apart if and only if some word is at most
    one bit from each. Every fingerprint goes to the 65 words around it; those that meet are all linked, and at most 65
    distinct ones can, so no group grows with the data."""
    flips = [0, *(_signed(1 << i) for i in range(64))]
    met = hot.select("rep", F.explode(F.transform(F.lit(flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
    groups = met.groupBy("centre").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    return groups.select("src", F.explode("reps").alias("dst")).where("src <> dst").distinct()


def links(nodes: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Links (src, dst) between rows (fp, rep) of distinct fingerprints that join all at most RADIUS bits apart."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks())])
    rows = nodes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, ["t", "key"]))
    near = _links_in_buckets(shared.where(F.col("n") <= direct))
    hot = shared.where(F.col("n") > direct).select("fp", "rep").distinct()
    return near.unionByName(_links_by_centre(hot))


def _classes(marks: DataFrame, direct: int) -> DataFrame:
    """(fp, class, component_id): the fingerprints by class; component_id is the smallest id of the class, if any has one."""
    nodes = materialise(marks.groupBy("fp").agg(F.min("id").alias("rep")))
    linked = connected_components(links(nodes.select("fp", F.col("fp").alias("rep")), direct))
    members = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    return members.join(members.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("fp", "class", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Documents link if their fingerprints differ in at most two bits; component_id is the smallest id reachable.
    Null, empty and wordless texts have fingerprint zero and link like any other. Rows of one text share all they get.
    Rows without an id link and bridge others like any row; they take their class's component_id (null if no member has an
    id). Other columns are not read. No rows give no rows.
    """
    marks = materialise(fingerprints(docs, id_col, text_col))
    found = _classes(marks, direct).select("fp", "component_id")
    return marks.join(found, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the smallest id of each near-duplicate class.

    Where rows of a class share that id, one stays: of the text with the smallest hash and, if only other columns differ,
    of the smallest hash of all columns. Texts of different classes stay, whatever their ids. Rows without an id cannot be
    ranked and all stay. Columns and their order are those of docs.
    """
    marks = materialise(fingerprints(docs, id_col, text_col))
    named = marks.where("id is not null").groupBy("fp", "id", "hash").agg(F.count("*").alias("n"))
    first = named.join(_classes(marks, DIRECT), "fp").groupBy("class").agg(F.min(F.struct("id", "hash", "n")).alias("kept")).select("kept.*")
    first = materialise(first)
    key, hash_key, times = (unused(docs, f"__{n}") for n in ("kept", "hash", "times"))
    first = first.select(F.col("id").alias(key), F.col("hash").alias(hash_key), F.col("n").alias(times))
    stay = docs.join(first, (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(hash_key)))
    unnamed = docs.where(F.col(id_col).isNull())
    if first.where(F.col(times) > 1).isEmpty():  # no row occurs twice
        return stay.select(*docs.columns).unionByName(unnamed)
    alike = stay.where(F.col(times) > 1).groupBy(key, hash_key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(times))
    one = stay.where(F.col(times) == 1).select(*docs.columns).unionByName(alike.select(f"{times}.*"))
    return one.unionByName(unnamed)
