"""Removal of passages that repeat word for word: fixed-block anchors, then exact windows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import materialise, shuffle_partitions

WINDOW = 20
#: Any WINDOW words hold a whole block that starts at a multiple of BLOCK words.
BLOCK = 10
#: Rolling windows per hash range, about; sets how many ranges there are and so what one task holds.
PER_RANGE = 300_000
#: Bytes of text per run of documents, about, and what a row counts for besides its text.
PER_RUN = 4_000_000
PER_ROW = 64
#: Bytes that are hashed at once, and rolling blocks that a task holds, besides a run's, before it sends them.
SLICE = 500_000
HELD = 1_000_000
#: Runs whose share of a hash range meets in one task; more meet over two levels.
FAN = 4096
#: Stands for a missing id, so that it comes last.
_LAST = 2**63 - 1
_MULT = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(BLOCK)], np.uint64)
_STRETCH = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of the longest word that is hashed eight bytes at a time.
_LONG = 256
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: The low bytes of a word of eight, by how many of them count.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _stretches(raw: bytes):
    """(start, part) of a text cut at white space, each about SLICE bytes long or one longer word."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + SLICE < end and (gap := _GAP.search(raw, at + SLICE)):
            end = gap.end()
        yield at, raw[at:end]
        at = end


def _hashed(texts: list[bytes | None], hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """([hash, word], words per text): one or two 64-bit hashes of every word, eight bytes at a time; XXH3 over _LONG bytes."""
    raw = b"\n".join([t or b"" for t in texts])
    starts, found = [np.zeros(0, np.int64)], [np.zeros((hashes, 0), np.uint64)]
    for offset, part in _stretches(raw):
        x = np.frombuffer(part, np.uint8)
        word = np.zeros(len(x) + 2, bool)
        word[1:-1] = (x != 32) & (x - np.uint8(9) > 4)
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, size = edges[::2], edges[1::2] - edges[::2]
        if not len(first):
            continue
        eights = np.ndarray(len(part), "<u8", part + bytes(8), strides=(1,))
        sums = np.array([size.astype(np.uint64) * seed for seed in _SEEDS[:hashes]])
        rest = np.arange(len(first))
        for k in range(_LONG // 8):
            value = eights[first[rest] + 8 * k] & _LOW[np.minimum(size[rest] - 8 * k, 8)]
            for own, seed in zip(sums, _SEEDS, strict=False):
                own[rest] = _mix((own[rest] ^ value) * seed)
            rest = rest[size[rest] > 8 * k + 8]
            if not len(rest):
                break
        for k in rest:
            sums[:, k] = np.frombuffer(xxhash.xxh3_128_digest(part[first[k] : first[k] + size[k]]), "<u8")[:hashes]
        starts.append(first + offset), found.append(sums)
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    return np.concatenate(found, axis=1), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def _blocks(w: np.ndarray) -> np.ndarray:
    """Hash of the BLOCK words from each position of a hash column."""
    n = len(w) - BLOCK + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = w[:n] * _MULT[0]
    for k in range(1, BLOCK):
        out += w[k : k + n] * _MULT[k]
    return out


def _keys(blocks: np.ndarray, ranges: int) -> np.ndarray:
    """A block's hash range, then 24 bits."""
    x = _mix(blocks)
    return _range_of(x, ranges) << np.uint64(24) | x & np.uint64(0xFFFFFF)


def _range_of(x: np.ndarray, ranges: int) -> np.ndarray:
    return ((x >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)


def _positions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words laid end to end: place within the document, and words left in it from there."""
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return place, np.repeat(sizes, sizes) - place


def _zip(rem: np.ndarray, *flags: np.ndarray, run: np.ndarray | None = None) -> bytes:
    """Rising 24-bit numbers, a bit per number and flag, and a byte per number, as one compressed value."""
    steps = np.diff(rem, prepend=rem.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    parts = [len(rem).to_bytes(8, "little"), np.ascontiguousarray(steps.T).tobytes(), *(np.packbits(f).tobytes() for f in flags)]
    return zlib.compress(b"".join([*parts, run.tobytes()] if run is not None else parts), 1)


def _unzip(blob: bytes, flags: int, run: bool = False) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 3 * n, 8).reshape(3, n).astype(np.uint32)
    rem = np.cumsum(planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16), dtype=np.uint32)
    width, at = -(-n // 8), 8 + 3 * n
    bits = [np.unpackbits(np.frombuffer(raw, np.uint8, width, at + k * width), count=n).astype(bool) for k in range(flags)]
    return rem, *bits, *([np.frombuffer(raw, np.uint8, n, at + flags * width)] if run else [])


def _by_range(keys_range: np.ndarray):
    """(range, slice) of each range present in a sorted column."""
    cuts = np.flatnonzero(np.diff(keys_range, prepend=np.int64(-1)))
    for k, at in enumerate(cuts):
        yield int(keys_range[at]), slice(int(at), int(cuts[k + 1]) if k + 1 < len(cuts) else len(keys_range))


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    """Rows as compressed Arrow, which keeps their types and is a third of what shuffles make of rows of text."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(pa.Table.from_batches(rows).combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    """A run's rows in the order of their keys, ties as in the table."""
    rows = pa.ipc.open_stream(blob).read_all()
    return rows.take(pa.array(np.argsort(rows["key"].to_numpy(), kind="stable")))


def _runs(docs: DataFrame, id_at: int) -> DataFrame:
    """(run, bytes, rows): docs in runs of rows that follow each other in the table, PER_RUN bytes or one longer text each. Columns
    are named by their places, beside the key that they are ordered by; the runs of a task are numbered in its order."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    size = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n, f in zip(names, docs.schema.fields, strict=True) if f.dataType == T.StringType()), F.lit(PER_ROW))
    rows = rows.select(F.coalesce(F.col(names[id_at]).cast("long"), F.lit(_LAST)).alias("key"), size.cast("long").alias("size"), *names)

    def run(batches):
        number, weight, held = TaskContext.get().partitionId() << 32, 0, []

        def made():
            return pa.RecordBatch.from_pydict({"run": pa.array([number], pa.int64()), "bytes": pa.array([weight], pa.int64()), "rows": pa.array([_packed(held)], pa.binary())})

        for batch in batches:
            ends = np.cumsum(batch.column("size").to_numpy())
            at, before = 0, 0
            while at < batch.num_rows:
                # the row that a run reaches its size with is its last
                end = min(int(np.searchsorted(ends, before + PER_RUN - weight)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                weight += int(ends[end - 1]) - before
                at, before = end, int(ends[end - 1])
                if weight >= PER_RUN:
                    yield made()
                    number, weight, held = number + 1, 0, []
        if held:
            yield made()

    return materialise(rows.mapInArrow(run, "run long, bytes long, rows binary"))


def _anchors(runs: DataFrame, text: str, ranges: int) -> DataFrame:
    """(range, runs, blob): a task's rolling blocks by hash range, each once per run, with two flags: it starts at a multiple of
    BLOCK; the run has several. Only 24 bits besides the range stand for a block: a false hit costs time, not correctness."""

    def run(batches):
        held, own, size = [], [], 0

        def flushed():
            x = np.sort(np.concatenate(held))
            pair = x >> np.uint64(1)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(x)) - 1 if len(x) else first
            aligned, many, pair = (x[last] & np.uint64(1)).astype(bool), last > first, pair[first]
            run, rem, of = (pair & np.uint64(0xFF)).astype(np.uint8), (pair >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.uint32), (pair >> np.uint64(32)).astype(np.int64)
            rows = [(r, own, _zip(rem[at], aligned[at], many[at], run=run[at])) for r, at in _by_range(of)]
            return pa.RecordBatch.from_pydict({c: pa.array([row[k] for row in rows], t) for k, (c, t) in enumerate((("range", pa.int32()), ("runs", pa.list_(pa.int64())), ("blob", pa.binary())))})

        for batch in batches:
            for number, rows in zip(batch.column("run").to_pylist(), batch.column("rows"), strict=True):
                texts = _unpacked(rows.as_buffer())[text].cast(pa.binary())
                w, sizes = _hashed(texts.to_pylist(), 1)
                place, left = _positions(sizes)
                keys = _keys(_blocks(w[0]), ranges)
                whole = np.flatnonzero(left[: len(keys)] >= BLOCK)
                held.append(keys[whole] << np.uint64(9) | np.uint64(len(own) << 1) | (place[whole] % BLOCK == 0).astype(np.uint64))
                own.append(number)
                size += len(whole)
                if size >= HELD or len(own) == 256:
                    yield flushed()
                    held, own, size = [], [], 0
        if own:
            yield flushed()

    return runs.mapInArrow(run, "range int, runs array<long>, blob binary")


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct blocks of several blobs, which start at a multiple of BLOCK somewhere, and which occur more than once."""
    parts = [_unzip(b, 2, run=True) for b in pdf["blob"]]
    rem, aligned, many = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(rem, kind="stable")
    rem = rem[order]
    first = np.flatnonzero(np.diff(rem.astype(np.int64), prepend=-1))
    return rem[first], np.maximum.reduceat(aligned[order], first), np.add.reduceat(1 + many[order].astype(np.int64), first) > 1


def _hits(anchors: DataFrame, blocks: int) -> DataFrame:
    """(run, range, blob): the blocks that occur more than once and somewhere at a multiple of BLOCK, for each run that has them.
    blocks: into how many groups the rows of a range are dealt first, so that none holds more than FAN runs."""

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rem, aligned, many = _merged(pdf)
        return pd.DataFrame([(*key, _zip(rem, aligned, many, run=np.zeros(len(rem), np.uint8)))], columns=["range", "block", "blob"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        rem, aligned, many = _merged(pdf)
        return pd.DataFrame([(pdf["range"].iloc[0], _zip(rem[aligned & many]))], columns=["range", "sought"])

    def owned(pdf: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
        rows = []
        for of, runs, blob in zip(pdf["range"], pdf["runs"], pdf["blob"], strict=True) if len(hits) else ():
            rem, _, _, run = _unzip(blob, 2, run=True)
            hit = hits[np.minimum(np.searchsorted(hits, rem), len(hits) - 1)] == rem
            rem, run = rem[hit], run[hit]
            rows.extend((runs[k], of, _zip(rem[run == k])) for k in np.unique(run))
        return pd.DataFrame(rows, columns=["run", "range", "blob"])

    def at_once(pdf: pd.DataFrame) -> pd.DataFrame:
        rem, aligned, many = _merged(pdf)
        return owned(pdf, rem[aligned & many])

    def by_block(pdf: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        return owned(pdf, _unzip(sought["sought"].iloc[0], 0)[0])

    found = "run long, range int, blob binary"
    if blocks == 1:
        return anchors.groupBy("range").applyInPandas(at_once, found)
    dealt = materialise(anchors.withColumn("block", F.pmod(F.xxhash64("runs"), F.lit(blocks)).cast("int")))
    parts = materialise(dealt.groupBy("range", "block").applyInPandas(partial, "range int, block int, blob binary"))
    sought = parts.groupBy("range").applyInPandas(final, "range int, sought binary").join(parts.select("range", "block"), "range")
    return dealt.groupBy("range", "block").cogroup(sought.groupBy("range", "block")).applyInPandas(by_block, found)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes before all second ones, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def _candidates(rows: pa.Table, hits: pa.Table, text: str, ranges: int) -> tuple[np.ndarray, ...]:
    """The windows of a run that hold a hit, 96 bits each, numbered in the order of the bits: (bits, more bits, key of the first
    document) of the distinct ones; of all, where they start in the run, and which is the first of its number."""
    w, sizes = _hashed(rows[text].cast(pa.binary()).to_pylist(), 2)
    _, left = _positions(sizes)
    a, b = _blocks(w[0]), _blocks(w[1])
    n = max(0, len(a) - (WINDOW - BLOCK))
    hit = np.zeros(len(a) + 1, np.int64)
    if hits.num_rows and n:
        sought = np.unique(np.concatenate([np.uint64(r) << np.uint64(24) | _unzip(x, 0)[0].astype(np.uint64) for r, x in zip(hits["range"].to_pylist(), hits["blob"].to_pylist(), strict=True)]))
        key = _keys(a, ranges)
        at = np.minimum(np.searchsorted(sought, key), len(sought) - 1)
        hit[1:] = np.cumsum((sought[at] == key) & (left[: len(a)] >= BLOCK))
    offsets = WINDOW - BLOCK + 1
    at = np.flatnonzero((left[:n] >= WINDOW) & (hit[offsets : offsets + n] > hit[:n]))
    a = _mix(a[at] + _STRETCH * a[at + BLOCK])
    b = _mix(b[at] + _STRETCH * b[at + BLOCK]) & np.uint64(0xFFFFFFFF)
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    key = rows["key"].to_numpy()[np.searchsorted(np.cumsum(sizes), at[new], "right")]
    return a[new].astype("<u8"), b[new].astype("<u4"), key, at, new


def _windows(runs: DataFrame, hits: DataFrame, text: str, ranges: int) -> DataFrame:
    """(range, run, start, blob): the distinct windows of a run that hold a hit, numbered within the run from start."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, key, _, _ = _candidates(_unpacked(left["rows"][0].as_buffer()), right, text, ranges)
        out = [(r, left["run"][0].as_py(), k.start, a[k].tobytes() + b[k].tobytes() + _planes(key[k])) for r, k in _by_range(_range_of(a, ranges).astype(np.int64))]
        return pa.table({c: pa.array([row[k] for row in out], t) for k, (c, t) in enumerate((("range", pa.int32()), ("run", pa.int64()), ("start", pa.int32()), ("blob", pa.binary())))})

    return runs.groupBy("run").cogroup(hits.groupBy("run")).applyInArrow(run, "range int, run long, start int, blob binary")


def _firsts(windows: DataFrame, blocks: int) -> DataFrame:
    """(run, blob): the numbers of the windows that a run has first of all, by key and then by run."""

    def least(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        parts = []
        for run, start, x in zip(pdf["run"].tolist(), pdf["start"].tolist(), pdf["blob"], strict=True):
            n = len(x) // (20 if run >= 0 else 32)
            columns = [np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n), _unplaned(x, n, 12 * n)]
            if run >= 0:
                columns += [np.full(n, run, np.int64), np.arange(start, start + n, dtype=np.uint32)]
            else:
                columns += [_unplaned(x, n, 20 * n), np.frombuffer(x, "<u4", n, 28 * n)]
            parts.append(columns)
        a, b, key, run, number = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort((run, key, b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        at = order[new]
        return a[at], b[at], key[at], run[at], number[at]

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, key, run, number = least(pdf)
        return pd.DataFrame([(pdf["range"].iloc[0], -1, 0, a.tobytes() + b.tobytes() + _planes(key) + _planes(run) + number.tobytes())], columns=["range", "run", "start", "blob"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        *_, run, number = least(pdf)
        order = np.argsort(run, kind="stable")
        run, number = run[order], number[order]
        return pd.DataFrame([(r, number[k].astype("<u4").tobytes()) for r, k in _by_range(run)], columns=["run", "blob"])

    rows = windows
    if blocks > 1:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("run"), F.lit(blocks))).groupBy("range", "block").applyInPandas(partial, "range int, run long, start int, blob binary")
    return rows.groupBy("range").applyInPandas(final, "run long, blob binary")


def _cut(runs: DataFrame, hits: DataFrame, firsts: DataFrame, text: str, ranges: int, schema: T.StructType, shape, quick: bool) -> DataFrame:
    """What shape(rows of a run in order, [(words, removed words, kept words joined by a space)]) makes of each run. quick: the
    shape needs only what was removed, so runs without repeats are not cut into words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _unpacked(left["rows"][0].as_buffer())
        _, _, _, at, new = _candidates(left, right.filter(pc.is_valid(right["range"])), text, ranges)
        late = np.ones(int(new.sum()), bool)
        for numbers in right.filter(pc.is_null(right["range"]))["blob"].to_pylist():
            late[np.frombuffer(numbers, "<u4")] = False
        starts = at[~new | late[np.cumsum(new) - 1]]
        if quick and not len(starts):
            return shape(left, [(0, 0, None)] * left.num_rows)
        words = [(t or b"").split() for t in left[text].cast(pa.binary()).to_pylist()]
        size = sum(map(len, words))
        covered = np.cumsum(np.bincount(starts, minlength=size + 1) - np.bincount(starts + WINDOW, minlength=size + 1))[:-1] > 0
        found, at = [], 0
        for own in words:
            gone = covered[at : at + len(own)]
            removed = int(gone.sum())
            found.append((len(own), removed, b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if removed else own)))
            at += len(own)
        return shape(left, found)

    side = hits.unionByName(firsts.withColumn("range", F.lit(None).cast("int")))
    return runs.groupBy("run").cogroup(side.groupBy("run")).applyInArrow(run, schema)


def _without(docs: DataFrame, id_col: str, text_col: str, schema: T.StructType, shape, quick: bool = False) -> DataFrame:
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    runs, text = _runs(docs, id_at), f"c{text_at}"
    size = runs.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = min(max(shuffle_partitions(docs.sparkSession), (size["bytes"] or 0) // 6 // PER_RANGE), 1 << 23)
    blocks = size["n"] // FAN + 1
    runs = runs.select("run", "rows")
    hits = materialise(_hits(_anchors(runs, text, ranges), blocks))
    # one plan, so that both passes over the runs read the same shuffle
    firsts = _firsts(_windows(runs, hits, text, ranges), blocks)
    return _cut(runs, hits, firsts, text, ranges, schema, shape, quick)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's words without those under a window that starts earlier too.

    Words are runs of bytes other than space and 09 to 0D. A window is WINDOW words of one document; it starts earlier in
    a smaller doc_id or before in the same one, judged on the input. Null texts have no words. Rows that share an id come
    in the order of the table, so the first of equal rows keeps its words and the others lose those in windows; rows
    without an id come last, likewise. kept joins the words left by one space. No rows give no rows.

    Rows that follow each other in the table make a run. Every rolling block of BLOCK words probes the index of blocks at
    multiples of BLOCK, by 24 bits within a hash range; a hit marks the places where a repeat can be, and all windows
    around them are compared by 96 bits between runs, which joins them to maximal repeats. A block or window counts once
    per run however often it occurs, and many runs meet over two levels, so a common passage fills no task.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def shape(rows: pa.Table, found: list) -> pa.Table:
        words, removed, kept = zip(*found, strict=True)
        return pa.table({"doc_id": rows["c0"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return _without(docs, "id", "text", T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string"), shape)


def repeat_digest(docs: DataFrame) -> DataFrame:
    """remove_repeats with the kept words as a SHA-256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words gone from their text; a text that loses nothing keeps its white space.

    Every row stays, with all its columns; order, repeated ids and rows without an id are as for remove_repeats. n_chars,
    where docs has it as a whole number, follows the new text.
    """
    text_at = docs.columns.index(text_col)
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else -1
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])

    def shape(rows: pa.Table, found: list) -> pa.Table:
        columns = [rows[f"c{k}"] for k in range(len(schema))]
        if any(removed for _, removed, _ in found):
            text, old = columns[text_at], columns[text_at].cast(pa.binary()).to_pylist()
            columns[text_at] = pa.array([kept if removed else t for t, (_, removed, kept) in zip(old, found, strict=True)], pa.binary()).cast(text.type)
            if count_at >= 0:
                count = columns[count_at]
                columns[count_at] = pa.array([len(kept.decode()) if removed else n for n, (_, removed, kept) in zip(count.to_pylist(), found, strict=True)], count.type)
        return pa.table(columns, names=schema.names)

    return _without(docs, id_col, text_col, schema, shape, quick=True).toDF(*docs.columns)


def brute_force(texts: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The definition, word by word, for tests: {id: (words, removed, digest)}."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc, text in sorted(texts):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - WINDOW + 1):
            if (window := tuple(words[k : k + WINDOW])) in seen:
                gone[k : k + WINDOW] = [True] * WINDOW
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
