"""Document fingerprints by randomised edit embedding: shared random walks, sampled steps, banding, verification."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import bucket_of, emptied, filled, id_bounds, materialise, shuffle_partitions
from riskweave.llm.components import connected_components, spanning

#: Steps of the embedding that a fingerprint keeps, at most; at least half as many, for texts that have them.
SAMPLES = 256
_PERIOD = 4096
_CLASSES = 64
#: Bytes of text in a run of documents, about, and runs that texts are dealt into at most.
PER_RUN, RUNS = 32_000_000, 20_000
#: Chance that two unlike places agree: a sample is one of 16 values.
_CHANCE = 1 / 16


@cache
def _stays() -> list[bytes]:
    """[class][step]: for how many steps a walk that comes to a character of that class at that step stays on it.

    At every step a bit shared by all documents, one per class and step, says whether the walk moves on. The bits repeat
    after _PERIOD steps.
    """
    moves = np.random.default_rng(20_240_229).integers(0, 2, (_CLASSES, _PERIOD), dtype=np.uint8)
    moves[:, -1] = 1
    out = []
    for row in moves:
        at = np.flatnonzero(row)
        out.append(np.minimum(at[np.searchsorted(at, np.arange(_PERIOD))] - np.arange(_PERIOD) + 1, 255).astype(np.uint8).tobytes())
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walk(points: np.ndarray, step: int = 0) -> tuple[list[int], int]:
    """The step at which the walk comes to each character, and the step at which it leaves the last."""
    classes = ((points * np.uint32(2_654_435_761)) >> np.uint32(26)).astype(np.uint8).tobytes()
    stays, mask, out = _stays(), _PERIOD - 1, []
    for c in classes:
        out.append(step)
        step += stays[c][step & mask]
    return out, step


@cache
def _sampled(level: int, n: int) -> np.ndarray:
    """The first n sampled steps at a level: one in each stretch of 2^level steps, and all of them sampled at lower levels."""
    at = np.arange(n, dtype=np.int64)
    for k in range(level, 0, -1):
        at = 2 * at + _coin(k, at)
    return at


def _coin(level: int, k: np.ndarray) -> np.ndarray:
    x = (k.astype(np.uint64) + np.uint64(level << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)


def fingerprint(points: np.ndarray, steps: list[int], end: int) -> str:
    """Two hex digits for the level, then one for each sampled step: a hash of the three characters from where it stands."""
    if not end:
        return "00"
    level = max(0, (end - 1).bit_length() - SAMPLES.bit_length() + 1)
    at = _sampled(level, SAMPLES)
    at = at[at < end]
    where = np.fromiter(map(bisect_right, repeat(steps), at.tolist()), np.int64, len(at)) - 1
    padded = np.append(points, np.zeros(2, np.uint32)).astype(np.uint64)
    x = padded[where] * np.uint64(0x9E3779B97F4A7C15) + padded[where + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[where + 2] * np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return f"{level:02x}" + "".join(map("0123456789abcdef".__getitem__, (x >> np.uint64(60)).tolist()))


def _at_level(mark: str, level: int) -> str:
    """The samples of a fingerprint that a higher level would have kept."""
    own = int(mark[:2], 16)
    at = np.arange(SAMPLES, dtype=np.int64)
    for k in range(level, own, -1):
        at = 2 * at + _coin(k, at)
    body = np.frombuffer(mark[2:].encode(), np.uint8)
    return body[at[at < len(body)]].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Share of sampled steps that agree, less what chance would give: 1 for equal texts, about 0 for unrelated ones."""
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = (np.frombuffer((m[2:] if int(m[:2], 16) == level else _at_level(m, level)).encode(), np.uint8) for m in (a, b))
    n, m = max(len(x), len(y)), min(len(x), len(y))
    if not m:
        return 0.0
    return float(max(0.0, (np.count_nonzero(x[:m] == y[:m]) / n - _CHANCE) / (1 - _CHANCE)))


def fingerprint_of(text: str | None) -> str:
    points = code_points(text or "")
    return fingerprint(points, *walk(points))


def with_next(docs: DataFrame, run, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Apply run(pairs) over each document and the next by descending id, of which the last's is the first.

    Texts are dealt once, by runs of ids; the first of each run also goes to the run above it, so that every document meets
    its next one without another shuffle. Runs are PER_RUN bytes each, about, as long as there are no more than RUNS of
    them; a task reads its runs row by row, whatever their size. Rows without an id are dealt by the hash of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    named, unnamed = rows.agg(F.sum(F.when(F.col("id").isNotNull(), size)), F.sum(F.when(F.col("id").isNull(), size))).first()
    parts = shuffle_partitions(spark)
    bounds = id_bounds(rows.select("id"), "id", min(RUNS, max(2 * parts, (named or 0) // PER_RUN)))
    last = min(RUNS, max(1, (unnamed or 0) // PER_RUN))  # runs of rows without an id come last, with rising hashes
    low = last - 1 - F.floor((F.shiftright("hash", 33) + (1 << 30)) * last / (1 << 31))
    keyed = rows.withColumn("run", F.when(F.col("id").isNull(), low).otherwise(bucket_of(F.col("id"), bounds) + last).cast("int"))
    keyed = keyed.withColumn("place", F.struct(F.col("id").isNull().alias("n"), F.bitwise_not("id").alias("i"), F.col("hash").alias("h")))
    tops = {r["run"]: r["top"] for r in keyed.groupBy("run").agg(F.min("place").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    follows = {below: above for above, below in zip(order, order[1:] + order[:1], strict=True)}
    known = spark.createDataFrame([(k, tuple(tops[k]), follows[k]) for k in order], "run int, top struct<n: boolean, i: long, h: long>, above int")
    keyed = keyed.join(F.broadcast(known), "run")  # a row for each run: twice RUNS at most, or the partitions
    here = F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))
    there = F.struct(F.col("above").alias("run"), F.lit(1).alias("guest"))
    places = F.when(F.col("top").eqNullSafe(F.col("place")), F.array(here, there)).otherwise(F.array(here))
    dealt = keyed.select(filled(F.col("id")).alias("id"), "hash", "text", F.explode(places).alias("p")).select("id", "hash", "text", "p.run", "p.guest")
    dealt = dealt.repartition(max(parts, len(order) // 2), "run").sortWithinPartitions(F.col("run"), F.col("guest"), F.col("id").desc(), F.col("hash"), F.col("text").asc_nulls_first())
    return dealt.drop("hash").mapInPandas(run, schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    The edited text ends in the start of the next document instead of its own last half. Null texts are empty. Rows that
    share an id are ordered by a hash of their text; rows without one come last, likewise. One row is its own next. Fingerprints depend on
    the whole text and nothing else; the walk of an edited text takes over its unedited part's.
    """

    def run(batches):
        here = None  # run, id, text, points, steps, end, fingerprint

        def made(a, b):
            _, doc, text, points, steps, end, mark = a
            keep = len(points) - len(points) // 2
            tail = b[3][: len(points) // 2]
            new = np.concatenate([points[:keep], tail])
            more, last = walk(tail, steps[keep] if keep < len(steps) else end)
            edited = fingerprint(new, steps[:keep] + more, last)
            digest = hashlib.sha256((text[:keep] + b[2][: len(points) // 2]).encode()).hexdigest()
            return doc, len(points), digest, mark, edited, likeness(mark, edited), likeness(mark, b[6])

        for pdf in batches:
            out = []
            for k, doc, text, guest in zip(pdf["run"].array, pdf["id"].array, pdf["text"].array, pdf["guest"].array, strict=True):
                if here is None and guest:
                    continue
                text = text or ""
                points = code_points(text)
                steps, end = walk(points)
                new = (k, doc, text, points, steps, end, fingerprint(points, steps, end))
                if here is not None:
                    out.append(made(here, new))
                here = None if guest else new
            cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pd.DataFrame(out, columns=cols)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, run, schema, id_col, text_col).withColumn("doc_id", emptied(F.col("doc_id")))


#: Sampled steps in a band, and bands per level.
BAND, BANDS = 6, 24
#: Fingerprints of a band bucket that one task compares with as many others.
BLOCK = 512


@cache
def _band_places(length: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, max(1, length), (BANDS, BAND))


def _bands(mark: str) -> list[int]:
    """Hashes of a fingerprint's bands, at its own level and the next, of as many samples as it has or half of them."""
    own, out = int(mark[:2], 16), []
    for level in (own, own + 1):
        body = mark[2:] if level == own else _at_level(mark, level)
        size = 1 << max(0, len(body) - 1).bit_length() >> 1
        for room in sorted({size, max(1, size // 2)} if body else {0}):
            for k, at in enumerate(_band_places(room)):
                band = f"{level}.{room}.{k}." + "".join(body[i] for i in at if i < len(body))
                out.append(xxhash.xxh3_64_intdigest(band) - (1 << 63))
    return out


def _likeness_matrix(left: list[str], right: list[str]) -> np.ndarray:
    """likeness of every mark of one list and every mark of another, level by level."""
    out = np.zeros((len(left), len(right)))
    levels = np.array([int(m[:2], 16) for m in left]), np.array([int(m[:2], 16) for m in right])
    for level in set(np.maximum.outer(*levels).ravel().tolist()):
        rows, lengths, at = [], [], [np.flatnonzero(own <= level) for own in levels]
        for marks, own in zip((left, right), at, strict=True):
            bodies = [(marks[i][2:] if int(marks[i][:2], 16) == level else _at_level(marks[i], level)).encode() for i in own]
            rows.append(np.frombuffer(b"".join(b.ljust(SAMPLES, b"\0") for b in bodies), np.uint8).reshape(len(bodies), SAMPLES))
            lengths.append(np.array([len(b) for b in bodies]))
        alike = np.zeros((len(rows[0]), len(rows[1])), np.int32)
        for k in range(max(1, *[int(x.max(initial=0)) for x in lengths])):
            alike += (rows[0][:, k, None] == rows[1][None, :, k]) & (rows[0][:, k, None] > 0)
        n = np.maximum.outer(*lengths)
        score = np.where(np.minimum.outer(*lengths) > 0, np.maximum(0.0, (alike / np.maximum(n, 1) - _CHANCE) / (1 - _CHANCE)), 0.0)
        here = np.maximum.outer(levels[0][at[0]], levels[1][at[1]]) == level
        block = out[np.ix_(*at)]
        out[np.ix_(*at)] = np.where(here, score, block)
    return np.where(np.array(left, object)[:, None] == np.array(right, object)[None, :], 1.0, out)


def _verified(docs: DataFrame, least: float, id_col: str, text_col: str, forest: bool) -> tuple[DataFrame, DataFrame]:
    """The distinct fingerprints (mark, id), and links (src, dst, likeness) between them: all of those that banding finds, or of
    every two blocks of a bucket only those that join parts apart."""

    def mark(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "mark": [fingerprint_of(t) for t in pdf["text"]]})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = materialise(rows.mapInPandas(mark, "id long, mark string").groupBy("mark").agg(F.min("id").alias("id")))

    def bands(batches):
        for pdf in batches:
            found = [_bands(m) for m in pdf["mark"]]
            sizes = [len(x) for x in found]
            yield pd.DataFrame({"band": np.fromiter((b for x in found for b in x), np.int64, sum(sizes)), "id": np.repeat(pdf["id"].to_numpy(), sizes)})

    banded = marks.mapInPandas(bands, "band long, id long").distinct()
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(banded.join(sizes, "band"))  # a hash and an id each; fingerprints come to those in a bucket only
    shared = shared.join(marks, "id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("x"), F.greatest(o, "block").alias("y"))))
    met = shared.select("band", "id", "mark", "block", meet.alias("p")).select("band", "id", "mark", "block", "p.x", "p.y")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        near = _likeness_matrix(left["mark"].tolist(), right["mark"].tolist())
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        i, j = np.nonzero((near >= least) & ((a[:, None] < b[None, :]) | (x != y)))
        src, dst, score = np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), near[i, j]
        keep = spanning(src, dst) if forest else slice(None)
        return pd.DataFrame({"src": src[keep], "dst": dst[keep], "likeness": score[keep]})

    return marks, met.groupBy("band", "x", "y").applyInPandas(compare, "src long, dst long, likeness double")


def edit_links(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(src, dst, likeness): links between the smallest ids of distinct fingerprints at least `least` alike.

    Bit-sampled banding: fingerprints that agree on all samples of a band, at their own level or the next, become
    candidates; likeness verifies them. Copies share a fingerprint and so never become pairs. A large bucket is dealt
    into blocks that meet pairwise in separate tasks, so all candidates of a bucket are compared, whatever its size. Rows
    without an id have nothing to be named by and are left out; null texts are empty; no rows give no links. For classes
    take edit_classes, which does not list all pairs.
    """
    return _verified(docs, least, id_col, text_col, forest=False)[1].distinct()


def edit_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row: the classes that edit_links joins, as membership.

    component_id is the smallest id reachable by links. Rows of one fingerprint share it; a row without an id takes that of
    its fingerprint, if another row has one. Null texts are empty and alike; repeated rows stay; no rows give no rows.
    """

    def mark(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "mark": [fingerprint_of(t) for t in pdf["text"]]})

    rows = docs.select(filled(F.col(id_col)).alias("id"), F.col(text_col).alias("text")).mapInPandas(mark, "id long, mark string")
    marks, links = _verified(docs, least, id_col, text_col, forest=True)
    linked = connected_components(links)
    known = marks.join(linked, F.col("id") == F.col("node"), "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    return rows.join(known, "mark", "left").select(emptied(F.col("id")).alias("doc_id"), F.col("mark").alias("fingerprint"), "component_id")
