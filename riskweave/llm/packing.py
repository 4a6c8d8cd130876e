"""Token sequences of a fixed capacity, filled by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.common import emptied, filled, materialise

CAPACITY = 2048
#: Words that a worker keeps encoded, at each of two levels.
CACHE = 400_000
#: Steps that one search for a filling may take before its best filling so far stands.
SEARCH = 20_000
#: Steps that all searches for fillings of one plan may take; later bins are filled by best fit.
SEARCHES = 1_000_000
#: Steps that the search over bins may take in all before the best plan so far stands.
BRANCHES = 200_000
#: Numbers of the basis that the linear program over fillings may rewrite before its mixture so far stands.
PIVOTS = 1_000_000_000
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case Latin-1 texts, whose six other numbers Python counts as letters.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
#: Python splits at these, the vocabulary does not; and its special tokens start with the last.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit words, equal to encoding it whole.

    The vocabulary's tokens never cross white space, so the ids of a text are those of its words, which repeat. Texts
    with characters on which Python and the vocabulary differ about white space, or with its special tokens, are
    encoded whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.cut = regex.compile(_PIECES)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        spec = json.load(open(path))  # noqa: SIM115
        lean = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.lean = Tokenizer.from_str(json.dumps(spec | lean))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = np.array(self.lean.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.parts) < CACHE:
                self.parts[part] = ids
        return ids

    def _word(self, word: str, latin: bool) -> bytes:
        ids = self.words.get(word)  # it may stand earlier in the same text
        if ids is not None:
            return ids
        if latin and word.isalpha():
            ids = self._part(word)
        elif latin:
            ids = b"".join(map(self._part, _LATIN.findall(word)))
        else:
            ids = b"".join(map(self._part, self.cut.findall(self.whole.normalizer.normalize_str(word))))
        if len(self.words) < CACHE:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:  # in Latin-1 the vocabulary's normal form is lower case
            text.encode("latin-1")
            text, latin = text.lower(), True
        except UnicodeEncodeError:
            latin = False
        words = text.split()
        found = list(map(self.words.get, words))
        try:
            at = found.index(None)
            while True:
                found[at] = self._word(words[at], latin)
                at = found.index(None, at + 1)
        except ValueError:
            return b"".join(found)


@cache
def _encoder(path: str) -> WordEncoder:
    """One per worker, so that its words outlive a task."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank) of every document's ids followed by id 0.

    Only documents longer than the capacity are cut, into pieces of the capacity; the last may be shorter. rank counts
    the pieces of one length within the task that made them.
    """

    def run(batches):
        encoder, seen, task = _encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"].array, pdf["text"].array, strict=True):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, int(seen[size])))
                    seen[size] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    rows = docs.select(filled(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def _best_filling(room: int, lengths: list[int], counts: list[int], enough: int, budget: list[int]) -> list[tuple[int, int]]:
    """The filling of `room` that wastes least: [(length, times)], from lengths in falling order.

    Branch and bound. The best-fit filling, taking the largest that fits at each step, is the first branch and so the
    incumbent. A filling that wastes least is undominated: swapping an item for a larger unused one that fits would waste
    less. A branch ends when all that is left could not bring its waste below the incumbent's, and the search when no more
    than `enough` is wasted or SEARCH steps or the
    budget are used; the best filling so far, at least the best fit, then stands.
    """
    left = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        left[k] = left[k + 1] + lengths[k] * counts[k]
    best, waste, steps = [], room, 0
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and waste > enough and steps < SEARCH and (steps <= len(lengths) or budget[0] > 0):
        k, space, taken = stack.pop()
        steps += 1
        budget[0] -= 1
        if space < waste:
            best, waste = list(taken), space
        while k < len(lengths) and lengths[k] > space:
            k += 1
        if k == len(lengths) or space - left[k] >= waste:
            continue
        most = min(counts[k], space // lengths[k])
        for times in range(0, most + 1):
            stack.append((k + 1, space - times * lengths[k], (*taken, (lengths[k], times)) if times else taken))
    return best


def _complete(counts: np.ndarray, capacity: int, budget: list[int] | None = None, enough: int = 0) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, times), ...])]: bins filled alike, around the largest length left each time, by best fit or, with a
    budget of steps, by search."""
    counts, out = counts.copy(), []
    while (there := np.flatnonzero(counts)).size:
        big = int(there[-1])
        counts[big] -= 1
        room = capacity - big
        fits = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
        filling: list[tuple[int, int]] = []
        if budget:
            filling = _best_filling(room, fits, [int(counts[x]) for x in fits], enough, budget)
        else:
            for x in fits:
                if x <= room and (times := min(int(counts[x]), room // x)):
                    filling.append((x, times))
                    room -= times * x
        counts[big] += 1
        uses = dict(filling)
        uses[big] = uses.get(big, 0) + 1
        bins = min(int(counts[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= bins * n
        out.append((bins, sorted(uses.items(), reverse=True)))
    return out


def _fillings(room: int, lengths: list[int], counts: list[int], allowed: Callable[[], int], steps: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, [(length, times), ...]): every undominated filling of `room` that wastes no more than is allowed by then.

    A filling is dominated if a piece left over fits as well, or fits in place of a smaller one. Larger pieces come first.
    """
    left = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        left[k] = left[k + 1] + lengths[k] * counts[k]
    falling = [-x for x in lengths]
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and steps[0] > 0:
        k, space, taken = stack.pop()
        steps[0] -= 1
        k = max(k, bisect_left(falling, -space))
        if space - left[k] > allowed():
            continue
        if k < len(lengths):
            for times in range(min(counts[k], space // lengths[k]) + 1):
                stack.append((k + 1, space - times * lengths[k], (*taken, (lengths[k], times)) if times else taken))
            continue
        uses = dict(taken)

        def spare(low: int, high: int) -> bool:
            return any(counts[j] > uses.get(lengths[j], 0) for j in range(bisect_left(falling, -high), bisect_right(falling, -low - 1)))  # noqa: B023

        if not spare(0, space) and not any(spare(x, x + space) for x in uses):
            yield space, list(taken)


def _branch(counts: np.ndarray, capacity: int, incumbent: list, bound: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The incumbent, or a plan with fewer bins: branch and bound over bins.

    Each branch fills the bin of the largest length left in one of its undominated ways, as often as the counts allow or,
    after all of those, once. It ends when its waste, or its bins and the pieces over half the capacity, leave no plan below
    the incumbent; the search ends at the bound or after BRANCHES steps.
    """
    total = int((counts * np.arange(len(counts))).sum())
    best, fewest, steps = incumbent, sum(n for n, _ in incumbent), [BRANCHES]

    def ways(counts: np.ndarray, wasted: int, used: int, plan: tuple) -> Iterator[tuple]:
        big = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[big] -= 1
        fits = [int(x) for x in np.flatnonzero(rest[: capacity - big + 1])[::-1]]
        numbers = [int(rest[x]) for x in fits]
        for once in (False, True):
            for waste, filling in _fillings(capacity - big, fits, numbers, lambda: (fewest - 1) * capacity - total - wasted, steps):
                uses = dict(filling)
                uses[big] = uses.get(big, 0) + 1
                most = min(int(counts[x]) // n for x, n in uses.items())
                if once and most == 1:
                    continue
                bins, after = 1 if once else most, counts.copy()
                for x, n in uses.items():
                    after[x] -= bins * n
                yield after, wasted + bins * waste, used + bins, (plan, (bins, sorted(uses.items(), reverse=True)))

    stack = [ways(counts, 0, 0, ())]
    while stack and fewest > bound and steps[0] > 0:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        after, wasted, used, plan = node
        steps[0] -= 1
        if wasted > (fewest - 1) * capacity - total or used + int(after[capacity // 2 + 1 :].sum()) >= fewest:
            continue
        if after.any():
            stack.append(ways(*node))
            continue
        best, fewest = [], used
        while plan:
            plan, filling = plan
            best.append(filling)
        best.reverse()
    return best


def _bound(counts: np.ndarray, capacity: int) -> int:
    """No plan has fewer bins: for each k up to half the capacity, pieces over capacity - k stand alone, those over half have
    bins of their own, and what is left of k or more has to fit beside them."""
    number = np.cumsum(np.pad(counts, (0, max(0, capacity + 1 - len(counts)))))
    total = np.cumsum(np.diff(number, prepend=0) * np.arange(len(number)))
    best, half = 0, capacity // 2
    for k in range(half + 1):
        alone = int(number[capacity] - number[capacity - k])
        wide = int(number[capacity - k] - number[half])
        room = wide * capacity - int(total[capacity - k] - total[half])
        rest = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + wide + max(0, -(-(rest - room) // capacity)))
    return best


def _richest(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> list[tuple[float, dict[int, int]]]:
    """(worth, {index: times}) of the best filling around each length, by dynamic programming, if it is worth over one bin."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fits = int(np.searchsorted(lengths, room, side="right"))
        found = worth[:fits] + value[room - lengths[:fits]]
        k = int(found.argmax())
        value[room], took[room] = (found[k], k) if found[k] > value[room - 1] else (value[room - 1], -1)
    around = worth + value[capacity - lengths]
    out = []
    for k in np.argsort(-around, kind="stable"):
        if around[k] <= 1 + 1e-9:
            break
        uses, room = {int(k): 1}, capacity - int(lengths[k])
        while room > 0:
            t = int(took[room])
            if t < 0:
                room -= 1
                continue
            uses[t] = uses.get(t, 0) + 1
            room -= int(lengths[t])
        out.append((float(around[k]), uses))
    return out


def _mixture(counts: np.ndarray, capacity: int, fewest: int) -> tuple[list[tuple[float, dict[int, int]]], int]:
    """([(bins, {length: times}), ...], bound): the fillings that a linear program mixes, fractions of bins allowed.

    Column generation: best fit in falling order, with fractions, gives the first basis, as each of its fillings uses up one
    length; the program's prices of pieces lead to the fillings worth more than a bin, which enter by simplex steps. Prices
    divided by the best filling's worth bound every plan from below. It ends when no filling is worth more, when the mixture
    meets the bound or the bound `fewest`, or after PIVOTS numbers.
    """
    lengths = np.flatnonzero(counts)
    number, m = counts[lengths].astype(float), len(lengths)
    need = number + 1e-4 * np.random.default_rng(0).random(m)  # no ties among the simplex steps
    basis: list[dict[int, int]] = []
    left = need.copy()
    for _ in range(m):
        uses, room = {}, capacity
        for k in np.flatnonzero(left)[::-1]:
            if times := room // int(lengths[k]):
                uses[int(k)] = times
                room -= times * int(lengths[k])
        out = min(uses, key=lambda k: left[k] / uses[k])
        step = left[out] / uses[out]
        for k, times in uses.items():
            left[k] = max(left[k] - step * times, 1e-12)
        left[out] = 0.0
        basis.append(uses)

    def renewed() -> np.ndarray:
        whole = np.zeros((m, m))
        for at, uses in enumerate(basis):
            for k, times in uses.items():
                whole[k, at] = times
        return np.linalg.inv(whole)

    inverse = renewed()
    bins, steps, spent, bound = np.maximum(inverse @ need, 0.0), 0, 0, 0
    while spent < PIVOTS and bound < fewest:
        prices = inverse.sum(axis=0)
        found = _richest(lengths, np.maximum(prices, 0.0), capacity)
        spent += capacity * m
        most = found[0][0] if found else 1.0
        bound = max(bound, int(np.ceil(float(np.maximum(prices, 0.0) @ number) / most - 1e-6)))
        if not found or bins.sum() <= bound:
            break
        for _, uses in found:
            if sum(prices[k] * times for k, times in uses.items()) <= 1 + 1e-9:
                continue
            change = sum(inverse[:, k] * times for k, times in uses.items())
            up = np.flatnonzero(change > 1e-9)
            if not up.size:
                continue
            out = int(up[np.argmin(bins[up] / change[up])])
            row, step = inverse[out] / change[out], bins[out] / change[out]
            bins = np.maximum(bins - step * change, 0.0)
            bins[out] = step
            change[out] -= 1.0
            down, across = np.flatnonzero(np.abs(change) > 1e-13), np.flatnonzero(np.abs(row) > 1e-13)
            inverse[np.ix_(down, across)] -= np.outer(change[down], row[across])
            prices -= change.sum() * row
            basis[out] = uses
            steps, spent = steps + 1, spent + m + down.size * across.size
            if steps % 500 == 0:
                inverse = renewed()
                prices, bins = inverse.sum(axis=0), np.maximum(inverse @ need, 0.0)
                spent += m * m
            if spent >= PIVOTS:
                break
    bins = renewed() @ number
    return [(float(n), {int(lengths[k]): times for k, times in uses.items()}) for n, uses in zip(bins, basis, strict=True)], bound


def _rounded(counts: np.ndarray, capacity: int, mixture: list[tuple[float, dict[int, int]]], bound: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """A plan from a mixture: whole bins of it, then a bin more where a large fraction was left and the pieces are there, and
    bin completion for the pieces that remain, around the largest each time."""
    left, plan = counts.copy(), []

    def take(uses: dict[int, int], bins: int) -> None:
        bins = min(bins, *(int(left[x]) // times for x, times in uses.items()))
        if bins > 0:
            for x, times in uses.items():
                left[x] -= bins * times
            plan.append((bins, sorted(uses.items(), reverse=True)))

    for n, uses in mixture:
        take(uses, int(n + 1e-7))
    for n, uses in sorted(mixture, key=lambda item: (item[0] + 1e-7) % 1.0, reverse=True):
        if (n + 1e-7) % 1.0 > 0.5:
            take(uses, 1)
    return plan + _completed(left, capacity, bound - sum(n for n, _ in plan))


def _size(plan: list[tuple[int, list[tuple[int, int]]]]) -> int:
    return sum(n for n, _ in plan)


def _completed(counts: np.ndarray, capacity: int, bound: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The best of best fit and of bin completion with waste bounds that double, until a plan meets the bound."""
    incumbent, enough, budget = _complete(counts, capacity), 0, [SEARCHES]
    while _size(incumbent) > bound and enough <= capacity // 16 and budget[0] > 0:
        incumbent = min(incumbent, _complete(counts, capacity, budget, enough), key=_size)
        enough = max(1, 2 * enough)
    return incumbent


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings [(bins, [(length, times), ...])] for counts[length] pieces; the fewest bins found.

    Best fit in falling order gives the incumbent; it stands if it meets the bound of _bound. Else a linear program over
    fillings gives a better bound and a mixture, whose whole bins stand while bin completion fills the rest. If a gap is
    left, bin completion searches a filling around each largest piece of all, first without waste, then with bounds on it
    that double: a filling with a little waste leaves more small pieces for later. If no plan meets the bound, the best of
    all is the incumbent of a branch and bound over bins. Equal fillings are repeated in one step, so the work depends on
    the number of lengths, at most the capacity, and not on the number of pieces.
    """
    bound = _bound(counts, capacity)
    incumbent = _complete(counts, capacity)
    if _size(incumbent) > bound:
        mixture, least = _mixture(counts, capacity, _size(incumbent))
        bound = max(bound, least)
        if _size(incumbent) > bound:
            incumbent = min(incumbent, _rounded(counts, capacity, mixture, bound), key=_size)
    if _size(incumbent) > bound:
        incumbent = min(incumbent, _completed(counts, capacity, bound), key=_size)
    if _size(incumbent) > bound:
        incumbent = _branch(counts, capacity, incumbent, bound)
    return incumbent


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Rank ranges of each length: pieces first <= rank < last go to bins first_bin + (rank - first) // times."""
    rows, at, base = [], {}, 0
    for bins, filling in plan:
        offset = 0
        for length, times in filling:
            first = at.get(length, 0)
            rows.append((length, first, first + bins * times, base, times, offset))
            at[length] = first + bins * times
            offset += length * times
        base += bins
    return pd.DataFrame(rows, columns=["length", "first", "last", "first_bin", "times", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one id 0. Every input row is a document of its own, repeated ids included; rows without an
    id are packed too. An empty table gives no rows. Only the counts by length (at most `capacity` rows) reach the
    driver; a piece finds its place by its rank among the pieces of its length, counted within a task and shifted by the
    counts of the tasks before, so no length is gathered in one place.
    """
    pieces = materialise(token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, id_col, text_col))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[length] = n
    slots = _slots(plan_bins(counts, capacity))
    before = by_task.selectExpr("length as l", "task as t", "sum(n) over (partition by length order by task) - n as before")
    placed = pieces.join(before, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).withColumn("rank", F.col("rank") + F.col("before"))
    starts = (slots["length"].to_numpy(np.int64) << 44) + slots["first"].to_numpy(np.int64)
    first, base, times, offset = (slots[c].to_numpy(np.int64) for c in ("first", "first_bin", "times", "offset"))

    def run(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            k = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            step = rank - first[k]
            pdf["sequence_id"] = base[k] + step // times[k]
            pdf["offset"] = offset[k] + step % times[k] * length
            yield pdf.drop(columns="rank")

    kept = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    out = kept.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", emptied(F.col("doc_id")))
