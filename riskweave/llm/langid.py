"""Language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from functools import cache
from math import exp, inf, log, log1p

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import unused

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents per language that models are fitted on, about; those of the smallest hashes.
FIT_DOCS = 2000
ROUNDS = 3
UNKNOWN = 1e-8
#: Words whose likelihoods a worker keeps, and documents whose words are looked up at once.
CACHE = 200_000
BATCH = 500
#: Letters of a word whose sum needs no scaling, and of which words are summed many at a time: those of the likeliest pieces.
SHORT = 28
LETTERS = 64
#: Places between two scalings of a longer word's sums; a piece is no longer.
_SCALED = 20
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


@cache
def pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's lower-cased pieces of letters, with or without a mark for the start of a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    found = {p for p in found if re.fullmatch(rf"{_START}?[^\W\d_]+|{_START}", p)}
    if max(map(len, found)) > _SCALED:
        raise ValueError(f"the vocabulary has pieces of over {_SCALED} letters")
    return tuple(sorted(found))


def _letters_only(part: str) -> list[str]:
    """The runs of letters in what may hold signs that stand for numbers, such as ² and ½."""
    return "".join(c if c.isalpha() else " " for c in part).split()


def runs_of(word: str) -> list[str]:
    """A word's runs of letters in lower case, marked where they start."""
    return [_START + run for part in _LETTERS.findall(word.lower()) for run in (part,) * part.isalpha() or _letters_only(part)]


def spans(run: str, known) -> list[tuple[int, int, str]]:
    """(start, end, piece) of every piece in a run, by end; a character that is no piece stands for itself."""
    out = []
    for j in range(1, len(run) + 1):
        for i in range(max(0, j - _SCALED), j):
            if (piece := run[i:j]) in known or i == j - 1:
                out.append((i, j, piece))
    return out


def with_suffixes(table: dict[str, tuple]) -> dict[str, tuple | None]:
    """table with None for what only ends a piece, so that a search backwards knows when to stop."""
    out: dict[str, tuple | None] = dict(table)
    for piece in table:
        for k in range(1, len(piece)):
            out.setdefault(piece[k:], None)
    return out


def log_likelihoods(run: str, table: dict[str, tuple | None], languages: int) -> list[float]:
    """Log of the sum, over all segmentations of a run, of the product of piece probabilities, for each language.

    table comes from with_suffixes. Every _SCALED places the sums that later ones build on are divided by the last, so
    that runs of any length neither vanish nor overflow.
    """
    unknown, get = (UNKNOWN,) * languages, table.get
    forward, logs, dropped = [(1.0,) * languages], [0.0] * languages, 0
    for j in range(1, len(run) + 1):
        total = [0.0] * languages
        for i in range(j - 1, max(-1, j - 1 - _SCALED), -1):
            p = get(run[i:j], False)
            more = p is not False
            if i == j - 1:
                p = p or unknown
            if p:
                total = [t + f * q for t, f, q in zip(total, forward[i - dropped], p, strict=True)]
            if not more:
                break
        forward.append(tuple(total))
        if j % _SCALED == 0:
            logs = [x + log(t) for x, t in zip(logs, total, strict=True)]
            dropped = max(0, j - _SCALED)
            forward = [tuple(f / t for f, t in zip(row, total, strict=True)) for row in forward[-_SCALED - 1 :]]
    return [x + log(t) for x, t in zip(logs, forward[-1], strict=True)]


class _Tree:
    """The pieces as a tree of letters, by which the sums of many runs advance together."""

    def __init__(self, table: dict[str, tuple], languages: int):
        weight: Counter[str] = Counter()
        for piece, p in table.items():
            for c in piece:
                weight[c] += sum(p)
        common = [c for c, _ in sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.letters = {c: k for k, c in enumerate(common)}
        self.codes = {ord(c): chr(k) for c, k in self.letters.items()}
        self.known = frozenset(self.letters)
        follows, self.odds = [[0] * len(common)], [(0.0,) * languages]
        for piece, p in table.items():
            if not self.known.issuperset(piece):
                continue
            node = 0
            for c in piece:
                c = self.letters[c]
                if not follows[node][c]:
                    follows[node][c] = len(follows)
                    follows.append([0] * len(common)), self.odds.append((0.0,) * languages)
                node = follows[node][c]
            self.odds[node] = p
        self.follows, self.odds = np.array(follows, np.int32), np.array(self.odds)
        single = self.follows[0]
        self.alone = np.where((self.odds[single] == 0) | (single == 0)[:, None], UNKNOWN, 0.0)  # letters that are no piece

    def covers(self, run: str) -> bool:
        return len(run) <= SHORT and self.known.issuperset(run)

    def sums(self, runs: list[str]) -> np.ndarray:
        """log_likelihoods of covered runs of one length."""
        n, size = len(runs), len(runs[0])
        codes = np.frombuffer("".join(runs).translate(self.codes).encode("ascii"), np.uint8).reshape(n, size)
        sums = np.zeros((size + 1, n, self.odds.shape[1]))
        sums[0] = 1.0
        for i in range(size):
            here = sums[i]
            sums[i + 1] += here * self.alone[codes[:, i]]
            at, node = np.arange(n), np.zeros(n, np.int32)
            for j in range(i, size):
                node = self.follows[node, codes[at, j]]
                alive = node > 0
                if not alive.all():
                    at, node = at[alive], node[alive]
                    if not len(at):
                        break
                sums[j + 1, at] += here[at] * self.odds[node]
        return np.log(sums[size])


def expected_counts(run: str, weight: float, table: dict[str, float], into: dict[str, float]) -> None:
    """Add how often each piece stands in a run, over all segmentations by their probability, times weight."""
    found = spans(run, table)
    if len(run) > SHORT:
        return _expected_by_logs(found, len(run), weight, table, into)
    forward, backward = [0.0] * (len(run) + 1), [0.0] * (len(run) + 1)
    forward[0] = backward[-1] = 1.0
    for i, j, piece in found:
        forward[j] += forward[i] * table.get(piece, UNKNOWN)
    for i, j, piece in reversed(found):
        backward[i] += backward[j] * table.get(piece, UNKNOWN)
    scale = weight / forward[-1]
    for i, j, piece in found:
        if piece in table:
            into[piece] += forward[i] * table[piece] * backward[j] * scale


def _expected_by_logs(found: list[tuple[int, int, str]], n: int, weight: float, table: dict[str, float], into: dict[str, float]) -> None:
    """The same for a run whose sums would vanish."""

    def plus(a: float, b: float) -> float:
        return max(a, b) + log1p(exp(-abs(a - b))) if min(a, b) > -inf else max(a, b)

    forward, backward = [0.0] + [-inf] * n, [-inf] * n + [0.0]
    odds = [log(table.get(piece, UNKNOWN)) for _, _, piece in found]
    for (i, j, _), p in zip(found, odds, strict=True):
        forward[j] = plus(forward[j], forward[i] + p)
    for (i, j, _), p in zip(reversed(found), reversed(odds), strict=True):
        backward[i] = plus(backward[i], backward[j] + p)
    for (i, j, piece), p in zip(found, odds, strict=True):
        if piece in table:
            into[piece] += weight * exp(forward[i] + p + backward[j] - forward[n])


def _smoothed(counts: dict[str, dict[str, float]], vocabulary: tuple[str, ...]) -> dict[str, dict[str, float]]:
    """Probabilities with a hundredth of a count for every piece of the vocabulary."""
    out = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.01 * len(vocabulary)
        out[lang] = {p: (own.get(p, 0.0) + 0.01) / total for p in vocabulary}
    return out


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, float]]:
    """{language: {piece: probability}} by expectation maximisation over the words of a bounded sample of labelled documents.

    What reaches the driver is at most a number per piece and language.
    """
    vocabulary = pieces(path)
    known = frozenset(vocabulary)
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    # as fine as doubles are, so that the share of a huge table is not rounded to nothing
    sample = labelled.where(F.pmod("h", F.lit(1 << 53)) < F.element_at(shares, F.col("lang")) * float(1 << 53)).select("lang", "text")

    def words(batches):
        for pdf in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for word in (text or "").split():
                    counts[lang, word] += 1
            short: dict[tuple[str, str], int] = defaultdict(int)
            for (lang, word), n in counts.items():
                for run in runs_of(word):
                    short[lang, run] += n
            yield pd.DataFrame([(lang, run, n) for (lang, run), n in short.items()], columns=["lang", "run", "n"])

    runs = sample.mapInPandas(words, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).persist()
    # at first every piece in sight counts, longer ones more
    models: dict[str, dict[str, float]] | None = None
    for _ in range(rounds + 1):
        current = docs.sparkSession.sparkContext.broadcast(models)

        def step(batches, current=current):
            models = current.value
            into: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            for pdf in batches:
                for lang, run, n in zip(pdf["lang"], pdf["run"], pdf["n"].tolist(), strict=True):
                    if models is None:
                        for i, j, piece in spans(run, known):
                            if piece in known:
                                into[lang][piece] += n * (j - i)
                    else:
                        expected_counts(run, n, models[lang], into[lang])
            yield pd.DataFrame([(lang, p, x) for lang, own in into.items() for p, x in own.items()], columns=["lang", "piece", "n"])

        summed = runs.mapInPandas(step, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts: dict[str, dict[str, float]] = {lang: {} for lang in sizes}
        for lang, piece, n in sorted(map(tuple, summed)):
            counts[lang][piece] = n
        models = _smoothed(counts, vocabulary)
        current.unpersist()
    runs.unpersist()
    return models


class _Scorer:
    """Log-likelihoods of documents, with those of words kept until there are CACHE of them."""

    def __init__(self, models: dict[str, dict[str, float]]):
        self.languages = sorted(models)
        self.n = len(self.languages)
        own = [models[lang] for lang in self.languages]
        table = {p: tuple(m[p] for m in own) for p in own[0]} if own else {}
        self.table, self.tree = with_suffixes(table), _Tree(table, self.n) if own else None
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, self.n + 1))  # the last column counts runs of letters

    def _runs(self, runs: list[str]) -> np.ndarray:
        out, by_size = np.zeros((len(runs), self.n)), defaultdict(list)
        for k, run in enumerate(runs):
            if self.tree.covers(run):
                by_size[len(run)].append(k)
            else:
                out[k] = log_likelihoods(run, self.table, self.n)
        for at in by_size.values():
            for k in range(0, len(at), 4096):
                out[at[k : k + 4096]] = self.tree.sums([runs[i] for i in at[k : k + 4096]])
        return out

    def _learn(self, words: list[str]) -> None:
        known: dict[str, int] = {}
        owner, run = [], []
        for k, word in enumerate(words):
            for r in (_START + word,) if word.isalpha() else runs_of(word):  # words come in lower case
                owner.append(k), run.append(known.setdefault(r, len(known)))
        rows = np.zeros((len(words), self.n + 1))
        if known and self.n:
            values = self._runs(list(known))[run]
            for k in range(self.n):
                rows[:, k] = np.bincount(owner, values[:, k], len(words))
        rows[:, -1] = np.bincount(np.array(owner, np.int64), minlength=len(words))
        self.words.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows = np.concatenate([self.rows, rows])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [(t or "").lower().split() for t in texts]
        distinct = set().union(*split)
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > CACHE:
            self.words, self.rows, new = {}, self.rows[:0], list(distinct)
        if new:
            self._learn(new)
        out = [self._shared(self.rows[list(map(self.words.__getitem__, words))].sum(0)) if words else ("und", 0.0) for words in split]
        for word in new:
            if len(word) > 256:
                del self.words[word]
        return out

    def _shared(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.n:
            return "und", 0.0
        shares = np.exp(total[:-1] - total[:-1].max())
        best = int(shares.argmax())
        return self.languages[best], float(shares[best] / shares.sum())


_scorers: dict[str, _Scorer] = {}


def language(docs: DataFrame, models: dict[str, dict[str, float]], text_col: str = "text") -> Column:
    """A column (lang_pred, score) for docs, from the whole text and nothing else.

    A text's likelihood is the product of those of its runs of letters, each summed over all segmentations into the
    vocabulary's pieces and single letters. score is the best language's share of the likelihoods. Null texts, texts without a letter, and all texts where
    nothing was learned are `und` with score 0. Ties go to the language first in the alphabet.
    """
    score = _judge(docs, models)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [x for k in range(0, len(texts), BATCH) for x in score(texts.iloc[k : k + BATCH].tolist())]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return run(F.col(text_col))


def _judge(docs: DataFrame, models: dict[str, dict[str, float]]):
    """For tasks: a function from texts to (language, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # pieces times languages, whatever the input
    name = uuid.uuid4().hex

    def score(texts: list[str | None]) -> list[tuple[str, float]]:
        if name not in _scorers:  # one per worker and model, so that its words outlive a task
            _scorers.clear()
            _scorers[name] = _Scorer(shared.value)
        return _scorers[name](texts)

    return score


def held_out(id_column: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 on division by 4; rows without an id count as held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learned(docs: DataFrame, vocabulary: str | None = None) -> dict[str, dict[str, float]]:
    """Models from the rows that aren't held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))), vocabulary or public_tokenizers.path(VOCABULARY))


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row: models learned from rows that aren't held out."""
    score = _judge(docs, learned(docs, vocabulary))

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):  # texts are taken out of a batch a few at a time
                part = whole.slice(k, BATCH)
                found = score(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs that are in a language; those that are `und`, with no text or no letter in it, go.

    Every text with a letter has a language, so no readable document is lost, unless no language was learned. Columns stay.
    """
    models = learned(docs, vocabulary)
    found = unused(docs, "__found")
    return docs.withColumn(found, language(docs, models)).where(F.col(found)["lang_pred"] != "und").drop(found)
