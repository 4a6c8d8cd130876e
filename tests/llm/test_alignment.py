"""Tokenizer alignment against two pointers over the tokens, with the byte-level file's own library."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskweave.llm import alignment

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b c"), (5, "x  y \n  z\t\t q <|endoftext|> </s> <s> <unk> <0x41> "), (6, "　全角 ½ ﬁ é é \x1c \x00 a\x85 b 🙂🙂"),
    (None, "hello world"), (7, "\n\n a\r\n b\xa0 c "), (8, "z" * 3000 + " b"), (8, "hello world"), (8, "hello world"), (9, "it's 'll 1234  the the the the the"), (10, "the " * 5000),
]


def plain(rows):
    """Every row by walking over both token lists."""
    own, whole, pieces = alignment.Aligner(alignment.BYTE_MODEL, alignment.PIECE_MODEL), Tokenizer.from_file(alignment.BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    whole.encode_special_tokens = True
    found, corpus = [], Counter()
    for doc_id, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        spelled = [b"".join(map(table.__getitem__, ids)) for table, ids in ((own.bytes_a, a), (own.bytes_b, b))]
        if not text or spelled != [(" " + text).encode()] * 2:
            found.append((doc_id, 0, 0, [], []))
            continue
        spans = [[], []]
        for k, (ids, table) in enumerate(((a, own.bytes_a), (b, own.bytes_b))):
            at = 0
            for x in ids:
                spans[k].append((at, at + len(table[x]), x))
                at += len(table[x])
        links, j = [], 0
        for start, end, x in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            links += [(x, y) for s, e, y in spans[1][j : j + end - start] if s < end and e > start]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[x for s, e, x in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *cuts], cuts)] if len(a) < 4000 else None
        corpus.update(links)
        found.append((doc_id, len(a), len(b), groups if groups is not None else cuts, links))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        text = None if groups and isinstance(groups[0], int) else ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(corpus[p] == best[p[1]] for p in links), sum(corpus[p] for p in links), digest))
    return out, corpus, [x[4] for x in found]


def sortable(row):
    return tuple((x is None, x or 0) if i == 0 else x for i, x in enumerate(row))


@pytest.mark.parametrize("links", [500, alignment.LINKS])
def test_alignment_equals_two_pointers(spark, sf, links):
    given = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"] + 100, r["text"]) for r in given if len(r["text"]) < 3000][:60] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as pair", "1 as container", "2 as slot")
    out = [tuple(r) for r in alignment.alignment(docs, links=links).collect()]
    expected, corpus, _ = plain(rows)
    got = sorted(map(sortable, out))
    for e, o in zip(sorted(map(sortable, expected)), got, strict=True):
        assert e[:-1] == o[:-1] and e[-1] in (None, o[-1])
    unbroadcast = [tuple(r) for r in alignment.alignment(docs, links=links, broadcast=0).collect()]
    assert sorted(map(sortable, unbroadcast)) == got


def test_pair_counts(spark, sf):
    rows = [(k, t) for k, t in ODD if t and len(t) < 5000] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {(r["id_a"], r["id_b"]): (r["n_docs"], r["n_links"]) for r in alignment.aligned_pairs(docs, links=300).collect()}
    _, corpus, links = plain(rows)
    n_docs = Counter(p for own in links for p in set(own))
    assert out == {p: (n_docs[p], n) for p, n in corpus.items()}


def test_bitmaps_of_many_documents():
    """Beyond LISTED documents a plane is kept as bits."""
    keys = np.concatenate([(np.int64(7) << 16) | np.arange(6000), (np.int64(7) << 16) | np.arange(0, 6000, 2), (np.int64(9) << 16) | np.arange(3)])
    rows = alignment._planes(keys)
    assert list(zip(rows["pair"], rows["plane"], rows["n"], rows["fresh"], strict=True)) == [(7, 0, 3000, 3000), (9, 0, 3, 3), (7, 1, 3000, 3000)]
    one = alignment._bitmap(np.arange(5000))
    assert len(one) == alignment.SLOTS // 8 and np.unpackbits(np.frombuffer(one, np.uint8), bitorder="little").sum() == 5000


def test_long_documents_are_taken_in_stretches(monkeypatch):
    own = alignment.Aligner(alignment.BYTE_MODEL, alignment.PIECE_MODEL)
    text = " " + " ".join(f"word{k} \n is,  here'll be\t{k * k} " for k in range(800)) + "end "
    whole = own.document(text)
    monkeypatch.setattr(alignment, "STRETCH", 700)
    cut = own.document(text)
    assert len(own.stretches(text)) > 20 and "".join(own.stretches(text)) == text
    assert (whole[0] == cut[0]).all() and (np.concatenate(whole[1]) == np.concatenate(cut[1])).all() and whole[2] == cut[2]
    assert own.document(text + "▁ x") is None


def test_no_documents(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = alignment.alignment(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in out] == [(None, 0, 0, 0, 0, 0, 0, "")]
