"""Alignment of two tokenizers over a corpus: inverted pair bitmaps with multiplicity planes, and scores that postings return."""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import emptied, filled, materialise

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A container has this many slots for documents, and is closed sooner when it has so many links.
SLOTS = 1 << 16
LINKS = 3_000_000
#: Up to so many documents a bitmap is kept as a list of slots, beyond that as bits.
LISTED = 4096
#: Letters of text that are encoded and aligned together; longer documents are taken in several stretches.
STRETCH = 500_000
#: Rows of the table of scores that may be broadcast, some 40 bytes each.
BROADCAST = 500_000

#: Where a stretch may end: before a space after what is no white space. No pretoken of A and no piece of B runs over such a
#: place. B adds no space to an empty text, so that a text's last letter is no stretch of its own.
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")
_OWN = "slot long, id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_SCHEMA = f"container long, pair long, plane long, n long, fresh long, bits binary, {_OWN}"
_NAMES = [x.split() for x in _SCHEMA.split(", ")]
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: What the byte-level tokenizer's own splitting rule is; a fixed value of that format.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_encoder(model_file: str, model: dict, raw: list[bytes]):
    """Texts to lists of ids. A vocabulary whose merges have ids in their order is one of ranks, which is encoded faster."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    first, kind = 256, model.get("pre_tokenizer") or {}
    ordered = all(model["model"]["vocab"].get(x + y) == first + k for k, (x, y) in enumerate(merges)) and all(len(raw[k]) == 1 for k in range(first))
    if ordered and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not model.get("normalizer"):
        import tiktoken

        ranks = {raw[k]: k for k in range(first + len(merges))}
        own = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: list(map(own.encode_ordinary, texts))
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(model_file)
    whole.encode_special_tokens = True
    return lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


class Aligner:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_model: str, piece_model: str):
        import sentencepiece

        with open(byte_model, encoding="utf-8") as file:
            model = json.load(file)
        letters = _letters()
        vocabulary = model["model"]["vocab"] | {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = _byte_encoder(byte_model, model, self.bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids can be aligned")
        #: where a piece may hold a space after another letter, whole texts are encoded
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.len_a, self.len_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        #: separator and id as ASCII, padded by NUL
        self.written = np.array([f"{s}{k}".encode() for s in ",;|" for k in range(most)], f"S{1 + len(str(most))}").reshape(3, most)

    def encoded(self, texts: list[str]) -> tuple[list, list]:
        """Of texts that start with a space, which B adds by itself."""
        return self.a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)

    def aligned(self, ids_a: list, ids_b: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of texts that both sides spell alike, one after the other: counts, links, and the groups as text."""
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
        stops_a, stops_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
        stops_a[ends_a], stops_b[ends_b] = True, True
        # a link ends at each place where a token of either side ends; it is of the first token of each that ends there or later
        cuts, shared = np.flatnonzero(stops_a | stops_b), np.flatnonzero(stops_a & stops_b)
        before_a, before_b = stops_a.cumsum(dtype=np.int64), stops_b.cumsum(dtype=np.int64)
        links = (a[before_a[cuts] - stops_a[cuts]] << 16) | b[before_b[cuts] - stops_b[cuts]]
        # a group's tokens of A come before its tokens of B
        starts = np.concatenate([[0], shared[:-1]])
        in_a, in_b = before_a[shared] - before_a[starts], before_b[shared] - before_b[starts]
        place_a = np.arange(len(a)) + np.repeat(before_b[starts], in_a)
        place_b = np.arange(len(b)) + np.repeat(before_a[shared], in_b)
        code, kind = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
        code[place_a], code[place_b] = a, b
        kind[before_a[starts] + before_b[starts]], kind[before_a[shared] + before_b[starts]] = 1, 2
        written, stops = self.written[kind, code], (n_a + n_b).cumsum()
        texts = [written[i:j].tobytes().replace(b"\0", b"") for i, j in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        groups = np.diff(np.searchsorted(shared, ends_a[n_a.cumsum() - 1], "right"), prepend=0)
        return np.stack([n_a, n_b, groups, n_a + n_b - groups], 1), links, texts

    def spelled(self, texts: list[str], ids_a: list, ids_b: list) -> list[bool]:
        """Which texts both sides give back byte by byte."""
        raw = [t.encode() for t in texts]
        good = np.ones(len(raw), bool)
        for ids, own, spelling in ((ids_a, self.len_a, self.bytes_a), (ids_b, self.len_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            k = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
            sizes, starts = own[k], own.cumsum() - own
            stops = sizes.cumsum()
            made = np.frombuffer(b"".join(spelling), np.uint8)[np.arange(sizes.sum()) + np.repeat(starts[k] - stops + sizes, sizes)]
            if made.tobytes() != b"".join(raw) or not np.array_equal(np.append(0, stops)[n.cumsum()], np.cumsum([len(x) for x in raw])):
                good &= np.array([b"".join(map(spelling.__getitem__, x)) == y for x, y in zip(ids, raw, strict=True)], bool)
        return good.tolist()

    def stretches(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            end = _CUT.search(text, at + STRETCH) if self.cuts and len(text) > at + STRETCH else None
            out.append(text[at : end.start() if end else len(text)])
            at = end.start() if end else len(text)
        return out

    def batch(self, texts: list[str]) -> list:
        """(counts, links, groups) of each text that starts with a space; None where bytes differ."""
        ids_a, ids_b = self.encoded(texts)
        good = self.spelled(texts, ids_a, ids_b)
        if not any(good):
            return [None] * len(texts)
        counts, links, groups = self.aligned(*([x for x, ok in zip(ids, good, strict=True) if ok] for ids in (ids_a, ids_b)))
        found = zip(counts[:, :3], np.split(links, counts[:-1, 3].cumsum()), groups, strict=True)
        return [next(found) if ok else None for ok in good]

    def document(self, text: str):
        """(counts, list of links, digest of the groups) of a text that starts with a space; None if it has no tokens."""
        total, links, digest = np.zeros(3, np.int64), [], hashlib.sha256()
        for k, part in enumerate(self.stretches(text)):
            (found,) = self.batch([part])
            if found is None:
                return None
            total += found[0]
            links.append(found[1])
            digest.update(found[2][k == 0 :])  # the first group has no separator before it
        return total, links, digest.hexdigest()

    def documents(self, texts):
        """document() of each text, in order: short ones are taken together."""
        held, size = [], 0

        def done():
            full = iter(self.batch([" " + t for t in held if t]) if any(held) else [])
            for t in held:
                x = next(full) if t else None
                yield x and (x[0], [x[1]], hashlib.sha256(x[2][1:]).hexdigest())

        for text in texts:
            if text and len(text) > STRETCH:
                yield from done()
                held, size = [], 0
                yield self.document(" " + text)
                continue
            held.append(text)
            size += len(text or "")
            if size > STRETCH:
                yield from done()
                held, size = [], 0
        yield from done()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_model: str, piece_model: str) -> Aligner:
    """One a worker: loading the vocabularies takes longer than many a task."""
    if (byte_model, piece_model) not in _ALIGNERS:
        _ALIGNERS[byte_model, piece_model] = Aligner(byte_model, piece_model)
    return _ALIGNERS[byte_model, piece_model]


def _bitmap(slots: np.ndarray) -> bytes:
    if len(slots) <= LISTED:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _planes(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Posting rows of a container, from a key (pair, slot) for each link: plane k of a pair has the documents in whose number
    of the pair's links bit k is set; fresh counts those in none of the planes before."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times, keys = np.diff(first, append=len(keys)), keys[first]
    pairs, slots, lowest = keys >> 16, keys & 0xFFFF, times & -times
    out: dict[str, list] = {c: [] for c in ("pair", "plane", "n", "fresh", "bits")}
    for k in range(int(times.max(initial=0)).bit_length()):
        own = (times >> k) & 1 == 1
        if not own.any():
            continue
        pair, slot, new = pairs[own], slots[own], lowest[own] == 1 << k
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        stops = np.append(starts[1:], len(pair))
        out["pair"].append(pair[starts])
        out["plane"].append(np.full(len(starts), k))
        out["n"].append(stops - starts)
        out["fresh"].append(np.add.reduceat(new.astype(np.int64), starts))
        out["bits"].append(np.array([_bitmap(slot[i:j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], object))
    return {c: np.concatenate(v) for c, v in out.items()}


def postings(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", links: int = LINKS) -> DataFrame:
    """Written rows of two kinds: a bitmap of documents for each container, pair and plane, and a document's own counts with its
    container and slot (pair is null). Each document is in one slot of one container; a task fills containers one after the
    other, so what it holds is bounded by `links` and one document."""

    def run(batches):
        own, number, place = _aligner(byte_model, piece_model), 0, TaskContext.get().partitionId() << 32
        keys, rows, held = [], [], 0

        def closed():
            kinds = [dict(zip((x.split()[0] for x in _OWN.split(", ")), zip(*rows, strict=True), strict=True)), *([_planes(np.concatenate(keys))] if keys else [])]
            for kind in kinds:
                size = len(next(iter(kind.values())))
                columns = {"container": np.full(size, place + number)} | kind
                yield pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), _TYPES[t]) for c, t in _NAMES], [c for c, _ in _NAMES])

        for batch in batches:
            found_all = own.documents(map(pa.StringScalar.as_py, batch["text"]))
            for k, found in zip(batch["id"].to_pylist(), found_all, strict=True):
                slot = len(rows)
                if found is None:
                    rows.append((slot, k, 0, 0, 0, 0, ""))
                else:
                    n = sum(map(len, found[1]))
                    rows.append((slot, k, *found[0].tolist(), n, found[2]))
                    keys += [(x << 16) | slot for x in found[1]]
                    held += n
                if held >= links or len(rows) == SLOTS:
                    yield from closed()
                    keys, rows, held, number = [], [], 0, number + 1
        if rows:
            yield from closed()

    rows = docs.select(filled(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, _SCHEMA))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links) from postings: containers share no document, so planes and their union are counted by container
    and summed."""
    times = F.expr("shiftleft(n, plane)")
    return found.where("pair is not null").groupBy("pair").agg(F.sum("fresh").alias("n_docs"), F.sum(times).alias("n_links"))


def aligned_pairs(docs: DataFrame, **options) -> DataFrame:
    """(id_a, id_b, n_docs, n_links): for each pair of ids that overlap somewhere, in how many documents and how often."""
    counts = pair_counts(postings(docs, **options))
    return counts.select(F.expr("shiftright(pair, 16)").alias("id_a"), F.expr("pair & 65535").alias("id_b"), "n_docs", "n_links")


def _scored(batches):
    """Containers one after the other, each with its postings first and then its documents, which get the sums of their slots."""
    at, best, total = None, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for pdf in batches:
        for container, part in pdf.groupby("container", sort=False):
            if container != at:
                at = container
                best[:], total[:] = 0, 0
            post, docs = part[part["id"].isna()], part[part["id"].notna()]
            if len(post):
                n, plane, count, is_best = (post[c].to_numpy(np.int64) for c in ("n", "plane", "count", "best"))
                listed = n <= LISTED
                slots = [np.frombuffer(b"".join(post["bits"][listed]), "<u2").astype(np.int64)]
                slots += [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) for x in post["bits"][~listed]]
                order = np.concatenate([np.flatnonzero(listed), np.flatnonzero(~listed)])
                times, slots = np.int64(1) << plane[order], np.concatenate(slots)
                np.add.at(total, slots, np.repeat(times * count[order], n[order]))
                np.add.at(best, slots, np.repeat(times * is_best[order], n[order]))
            if len(docs):
                slot = docs["slot"].to_numpy(np.int64)
                out = docs[["id", "n_a", "n_b", "n_groups", "n_links", "groups"]].assign(n_best=best[slot], count_sum=total[slot])
                yield out.astype({c: np.int64 for c in ("id", "n_a", "n_b", "n_groups", "n_links")})


def alignment(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", links: int = LINKS, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    Both tokenizers read a space and the text. Groups are cut where tokens of both end; a link is a token of A and one of B
    that share a byte. count_sum adds up, over a document's links, how many links of the corpus join the same two ids; n_best
    counts links whose count is the highest of their id of B, ties included. groups_sha256 hashes the ids by group.
    A text that is null, empty, or that the two do not spell alike has no tokens: zeros, and '' for the hash. Repeated rows
    count each time; rows without an id stay; other columns are not read; no rows give no rows. Documents of any length are
    taken in stretches, but a stretch without a space is encoded at once.
    """
    found = postings(docs, byte_model, piece_model, id_col, text_col, links)
    counts = materialise(pair_counts(found).select("pair", "n_links"))
    highest = counts.groupBy(F.expr("pair & 65535").alias("id_b")).agg(F.max("n_links").alias("most"))
    scores = counts.join(highest, F.expr("pair & 65535") == F.col("id_b")).select("pair", F.col("n_links").alias("count"), (F.col("n_links") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= broadcast:
        scores = F.broadcast(scores)
    posted = found.where("pair is not null").select("container", "pair", "plane", "n", "bits").join(scores, "pair")
    own = found.where("pair is null").select("container", "slot", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    rows = posted.drop("pair").unionByName(own, allowMissingColumns=True)
    ready = rows.repartition("container").sortWithinPartitions("container", F.col("id").isNotNull())
    out = ready.mapInPandas(_scored, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.select(emptied(F.col("id")).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
