"""SentencePiece encoding and decoding as a max-plus scan over chunks of giant documents."""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import emptied, filled, materialise

VOCABULARY = "piece_bpe_32k.model"
#: Characters per chunk; longer documents are split.
CHUNK = 32_768
#: Words and segments whose ids a worker keeps, and documents that it returns at once.
CACHE = 250_000
BATCH = 500
_SPACE = "▁"
_FAR = -(2**61)


class Pieces:
    """A vocabulary read as additive scores.

    A text is its characters with spaces as marks and one mark before it. Its encoding is the sequence of pieces with the
    largest sum of scores; a character that is no piece scores ten less than the worst piece and is spelt in byte pieces.
    Pieces that the file puts out of reach (a thousand million below zero) are left out; a single character among them
    scores as the worst of the others. Where sums tie, the last piece is the longest, then the one before it, and so on.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: round(model.get_score(i)) for i in plain if model.get_score(i) > -1e8}
        worst = min(scores.values())
        scores |= {i: worst for i in plain if i not in scores and len(names[i]) == 1}
        self.table = {names[i]: (scores[i], np.array([i], "<u4").tobytes()) for i in scores}
        self.unknown = worst - 10
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, self.table))
        self.raw = [n.replace(_SPACE, " ").encode() for n in names]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        # no piece has a mark after another character, and none a line feed: segments begin there
        if any(re.search(rf"[^{_SPACE}]{_SPACE}|\n", p) for p in self.table):
            raise ValueError("the vocabulary has pieces across words")
        self.cut = re.compile(rf"{_SPACE}*[^{_SPACE}\n]+|\n|{_SPACE}+")
        #: {first character: (score of it as a piece or None, {second character: ...})}
        self.tree: dict[str, tuple] = {}
        for name, (score, _) in self.table.items():
            node = self.tree
            for c in name[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[name[-1]] = (score, node[name[-1]][1] if name[-1] in node else {})
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def spelt(self, char: str) -> bytes:
        return np.array([self.bytes[b] for b in char.encode()], "<u4").tobytes()

    def score(self, piece: str) -> int | None:
        found = self.table.get(piece)
        return found[0] if found else (self.unknown if len(piece) == 1 else None)

    def paths(self, text: str, sums: list[int], starts: int) -> list[int]:
        """Best sums of the places of a text, in sums, where those before the pieces stand (_FAR: none); for each place, where
        its best path's last piece starts, or -1. Pieces start before `starts`; of equal sums the longest last piece wins."""
        tree, end, back = self.tree, len(sums) - 1, [-1] * len(sums)
        for i in range(min(end, starts)):
            base = sums[i]
            if base == _FAR:
                continue
            node, j = tree, i
            found = node.get(text[i])
            if found is None or found[0] is None:
                if base + self.unknown > sums[i + 1]:
                    sums[i + 1], back[i + 1] = base + self.unknown, i
            while found is not None:
                j += 1
                score, node = found
                if score is not None and base + score > sums[j]:
                    sums[j], back[j] = base + score, i
                if j == end:
                    break
                found = node.get(text[j])
        return back

    def best(self, text: str, begin: int, end: int, starts: int) -> bytes:
        """Ids of the best path from begin to end whose pieces all start before `starts`."""
        text = text[begin:end]
        back = self.paths(text, [0, *[_FAR] * (end - begin)], starts - begin)
        out, j = [], end - begin
        while j > 0:
            piece = text[back[j] : j]
            out.append(self.table[piece][1] if piece in self.table else self.spelt(piece))
            j = back[j]
        return b"".join(reversed(out))

    def entries(self, text: str, vector: np.ndarray, first: int, size: int) -> list[int]:
        """For each overhang of a chunk, where the best path to it leaves what came before. vector: sums of the places that
        pieces from before end at. Where all paths pass a place `first`, text need not go beyond it; else first is -1."""
        n = self.longest
        last = first if first >= 0 else min(len(text), size + n - 1)
        sums = [int(v) if v > _FAR // 2 else _FAR for v in vector[: last + 1].tolist()]
        back = self.paths(text, sums + [_FAR] * (last + 1 - len(sums)), first if first >= 0 else size)

        def start(j: int) -> int:
            while back[j] >= 0:
                j = back[j]
            return j

        return [start(first)] * n if first >= 0 else [start(min(size + o, last)) for o in range(n)]

    def segment(self, text: str) -> bytes:
        found = self.kept.get(text)
        if found is None:
            found = self.best(text, 0, len(text), len(text))
            if len(self.kept) < CACHE and len(text) <= 64:
                self.kept[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text without chunks, as little-endian unsigned 32-bit words."""
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or _SPACE in text:  # a segment may begin with several marks
            return self.middle(_SPACE + text.replace(" ", _SPACE))
        found = list(map(self.words.get, words))
        try:
            at = found.index(None)
            while True:
                found[at] = self.word(words[at])
                at = found.index(None, at + 1)
        except ValueError:
            return b"".join(found)

    def word(self, word: str) -> bytes:
        """Ids of what stands between two spaces, with the mark before it."""
        found = self.words.get(word)  # it may stand earlier in the same text
        if found is None:
            found = self.middle(_SPACE + word)
            if len(self.words) < CACHE and len(word) <= 64:
                self.words[word] = found
        return found

    def middle(self, text: str) -> bytes:
        parts = self.cut.findall(text)
        found = list(map(self.kept.get, parts))
        return b"".join([f if f is not None else self.segment(p) for f, p in zip(found, parts, strict=True)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]

    def bounds(self, text: str, size: int) -> tuple[int, int] | None:
        """First and last place inside a chunk that every path passes, or None."""
        places = [m.start() for m in self.cut.finditer(text, 0, size) if m.start()]
        # the first match may continue a segment of the chunk before; what follows begins one
        if places and (text[places[0] - 1] == _SPACE and text[places[0]] != "\n"):
            places = places[1:]
        return (places[0], places[-1]) if places else None

    def transfer(self, text: str, begin: int, size: int, entries: int) -> np.ndarray:
        """[entry, overhang]: best sums from each place begin + entry to each place size + overhang, less a constant."""
        longest = self.longest
        sums = np.full((entries, size + longest), _FAR, np.int64)
        for e in range(min(entries, size - begin + 1)):
            sums[e, begin + e] = 0
        last = min(len(text), size + longest - 1)
        for j in range(begin + 1, last + 1):
            for i in range(max(begin, j - longest), min(j, size)):
                s = self.score(text[i:j])
                if s is not None:
                    np.maximum(sums[:, j], sums[:, i] + s, out=sums[:, j])
            sums[:, j][sums[:, j] < _FAR // 2] = _FAR
            if j - begin > 2048 and j % 1024 == 0 and (low := sums[:, max(0, j - longest) : j + 1].max()) > _FAR // 2:
                near = sums[:, max(0, j - longest) : j + 1]
                near[near > _FAR // 2] -= low  # all paths pass here, so a constant changes none
                ahead = sums[:, j + 1 :]
                ahead[ahead > _FAR // 2] -= low
        return _level(sums[:, size : size + longest])


def _level(m: np.ndarray) -> np.ndarray:
    top = m.max()
    return np.where(m < _FAR // 2, _FAR, m - top) if top > _FAR // 2 else np.full_like(m, _FAR)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of transfer matrices, less a constant; associative."""
    return _level((a[:, :, None] + b[None, :, :]).max(1))


def chunk_matrix(pieces: Pieces, text: str, size: int) -> np.ndarray:
    """Transfer matrix of a chunk of `size` characters with what follows it: by characters that the piece before took, and
    those that its last piece takes of the next chunk. Where all paths pass a place, the stretch between the first and last
    such place adds the same to all and is left out."""
    inner = pieces.bounds(text, size)
    n = pieces.longest
    if inner is None:
        return pieces.transfer(text, 0, size, n)
    first, last = inner
    head = pieces.transfer(text[:first], 0, first, n)[:, :1]
    tail = pieces.transfer(text, last, size, 1)
    return _level(np.where((head < _FAR // 2) | (tail < _FAR // 2), _FAR, head + tail))


def chunk_ids(pieces: Pieces, text: str, size: int, entry: int, leave: int) -> bytes:
    """Ids of the pieces that start in a chunk, on the best path from an entry to an overhang."""
    inner = pieces.bounds(text, size)
    if inner is None or entry > inner[0]:
        return pieces.best(text, entry, size + leave, size)
    first, last = inner
    return pieces.best(text, entry, first, first) + pieces.middle(text[first:last]) + pieces.best(text, last, size + leave, size)


def incoming(pieces: Pieces, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk of a document, the best sums of the places that pieces from before it end at: prefix products of the
    transfer matrices, taken pairwise, level by level."""
    start = np.where(np.arange(pieces.longest) == 0, 0, _FAR)
    return [start, *(m[0] for m in _prefixes(matrices)[:-1])]


def composed(maps: list[list[int]]) -> list[int]:
    """The overhang before each chunk and after the last, from each chunk's map of its overhang after to the one before."""
    states = [0]
    for own in reversed(maps):
        states.append(own[states[-1]])
    return states[::-1]


def boundary_states(pieces: Pieces, chunks: list[tuple[np.ndarray, str, int, int]]) -> list[int]:
    """composed() of a document's chunks, given as (matrix, head, first, size)."""
    vectors = incoming(pieces, [c[0] for c in chunks])
    return composed([pieces.entries(head, v, first, size) for (_, head, first, size), v in zip(chunks, vectors, strict=True)])


def _prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    if len(matrices) <= 1:
        return list(matrices)
    pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
    odd = _prefixes(pairs)
    out = []
    for k, m in enumerate(matrices):
        out.append(odd[k // 2] if k % 2 else (product(odd[k // 2 - 1], m) if k else m))
    return out


@cache
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", shape=None) -> DataFrame:
    """(doc_id, ids, text), one row per input row; ids are little-endian unsigned 32-bit words.

    Documents up to `chunk` characters are encoded at once. Longer ones are split: each chunk gives a transfer matrix over
    the characters that a piece can reach across its end, the matrices of a document are combined into the sums that each chunk starts
    from, each chunk maps the states after it to those before, and is then backtraced by itself between its two. Null and empty texts have no ids. Repeated ids are told apart.
    shape: (function, schema) of what to return instead of ids and text, as row(pieces, ids, text), made where the ids are.
    """
    make, schema = shape or (lambda pieces, ids, text: (ids, text), "ids binary, text string")
    names = [x.split()[0] for x in schema.split(", ")]
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    longest = loaded(path).longest
    if chunk < longest:
        raise ValueError(f"a chunk must hold the longest piece, {longest} characters")
    rows = docs.select(filled(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    whole = F.coalesce(F.length("text") < chunk, F.lit(True))

    def short(batches):
        pieces = loaded(path)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                made = [make(pieces, pieces.encode(t or ""), t) for t in part["text"]]
                yield pd.DataFrame(made, columns=names).assign(doc_id=part["id"].to_numpy())

    out = f"{schema}, doc_id long"
    small = rows.where(whole).mapInPandas(short, out)

    marked = F.concat(F.lit(_SPACE), F.translate("text", " ", _SPACE))
    giants = rows.where(~whole).select("id", F.expr("uuid()").alias("row"), marked.alias("t"), "text")
    giants = materialise(giants)  # uuid() names a row once
    starts = F.explode(F.sequence(F.lit(0), ((F.length("t") - 1) / chunk).cast("int"))).alias("k")
    cut = giants.select("row", "t", starts).select(
        "row", "k", F.expr(f"substring(t, k * {chunk} + 1, {chunk + longest - 1})").alias("part"), F.expr(f"least({chunk}, length(t) - k * {chunk})").alias("size")
    )
    cut = materialise(cut.repartition(F.col("row"), F.col("k")))

    def matrices(batches):
        pieces = loaded(path)
        for pdf in batches:
            out = [chunk_matrix(pieces, t, n).astype("<i8").tobytes() for t, n in zip(pdf["part"], pdf["size"].tolist(), strict=True)]
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "matrix": out})

    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = incoming(loaded(path), [np.frombuffer(m, "<i8").reshape(longest, longest) for m in pdf["matrix"]])
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "k": pdf["k"].to_numpy(), "vector": [v.astype("<i8").tobytes() for v in found]})

    def maps(batches):
        pieces = loaded(path)
        for pdf in batches:
            out = []
            for text, size, vector in zip(pdf["part"], pdf["size"].tolist(), pdf["vector"], strict=True):
                first = (pieces.bounds(text, size) or (-1, -1))[0]
                out.append(pieces.entries(text, np.frombuffer(vector, "<i8"), first, size))
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "before": out})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = composed(pdf["before"].tolist())
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "k": pdf["k"].to_numpy(), "entry": found[:-1], "leave": found[1:]})

    def backtrace(batches):
        pieces = loaded(path)
        for pdf in batches:
            out = [chunk_ids(pieces, t, n, a, b) for t, n, a, b in zip(pdf["part"], pdf["size"].tolist(), pdf["entry"].tolist(), pdf["leave"].tolist(), strict=True)]
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "ids": out})

    def joined(parts: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        ids, row = b"".join(parts.sort_values("k")["ids"]), whole.iloc[0]
        return pd.DataFrame([make(loaded(path), ids, row["text"])], columns=names).assign(doc_id=row["id"])

    # only matrices, vectors and states of a document meet in one task; what walks over characters is a task per chunk
    ways = cut.mapInPandas(matrices, "row string, k int, matrix binary").groupBy("row").applyInPandas(vectors, "row string, k int, vector binary")
    ways = cut.join(ways, ["row", "k"]).mapInPandas(maps, "row string, k int, before array<int>")
    ends = ways.groupBy("row").applyInPandas(states, "row string, k int, entry int, leave int")
    traced = cut.join(ends, ["row", "k"]).select("row", "k", "part", "size", "entry", "leave").mapInPandas(backtrace, "row string, k int, ids binary")
    # a document's own ids, in order: no more than its row held before
    large = traced.groupBy("row").cogroup(giants.select("row", "id", "text").groupBy("row")).applyInPandas(joined, out)
    return small.unionByName(large).select(emptied(F.col("doc_id")).alias("doc_id"), *names)


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the text that its ids spell."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        pieces = loaded(path)
        return ids.map(lambda x: pieces.decode(x) if x is not None else None)

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def encoding_digest(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): digests of encode, and whether decode gives the text back."""
    def digest(pieces: Pieces, ids: bytes, text: str | None):
        return len(ids) // 4, zlib.crc32(ids), pieces.decode(ids) == (text or "")

    return encode(docs, vocabulary, chunk, shape=(digest, "n_tokens long, ids_crc32 long, round_trip boolean"))
