"""Each corpus operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskweave.llm import editwalk, langid, licences, packing, pages, pii, registry, repeats, simhash, vectors, viterbi

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def given(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash with inner ones."""
    rng = random.Random(1)
    base = prose(rng, 80)
    long = " ".join(prose(rng, 50) + f" {k}" for k in range(400))
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, base, "en", "a", 1), (None, None, None, None, None),
        (4, " \n\t ", "de", "b", 3), (5, long, "en", "a", len(long)), (6, "Ünïcödé 漢字 🙂 ﬁ\u0000x", "de", "b", 9), (7, base + " tail", "en", "a", 1), (8, "a", "en", "a", 1), (9, "!!! ??? 123", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("id", "fp", "rep", "run", "key", "component_id", "task", "rank", "__kept"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 1: pseudonyms ---------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) % 10 * 1 + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_keep_formats_and_links(spark):
    text = "4111111111111111 4111-1111-1111-1111 1234567812345678 123-45-6789 666-12-1234 DE89370400440532013000 2023-02-28 2023-02-30 10.2.3.4 256.1.1.1 +1 (672) 555-0196 a.b@c.de v1.2.3"
    a, b = (r["text"].split(" ") for r in pii.pseudonymise(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect())
    t = text.split(" ")
    assert a == b and len(a) == len(t)
    assert a[0] != t[0] and luhn(a[0]) % 10 == 0 and len(a[0]) == 16 and a[1].replace("-", "") == a[0] and [len(x) for x in a[1].split("-")] == [4] * 4
    assert a[2] == t[2] and a[4] == t[4] and a[7] == t[7] and a[9] == t[9] and a[-1] == t[-1]
    assert a[3] != t[3] and a[3].count("-") == 2
    moved = a[5][4:] + "1314" + a[5][2:4]
    assert a[5] != t[5] and int(moved) % 97 == 1
    assert a[6] != t[6] and len(a[6]) == 10
    assert a[8] != t[8] and all(0 <= int(o) < 256 for o in a[8].split("."))
    assert a[10] == "+1" and a[11].startswith("(") and a[12] != "555-0196"
    assert a[13].endswith("@example.invalid")


def test_pseudonyms_are_a_permutation(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(2000)]
    days = [f"{1700 + i // 12}-{i % 12 + 1:02d}-15" for i in range(2000)]
    df = spark.createDataFrame(list(zip(range(2000), [f"{i} {d}" for i, d in zip(ips, days)], strict=True)), "doc_id long, text string")
    out = [r["text"].split(" ") for r in pii.pseudonymise(df).collect()]
    assert len({o[0] for o in out}) == 2000 and len({o[1] for o in out}) == 2000
    other = [r["text"] for r in pii.pseudonymise(df, key="another").limit(5).collect()]
    assert other != [" ".join(o) for o in out[:5]]


def test_feistel_matches_a_plain_version(spark):
    def shift(of, a, i):
        return int(hashlib.sha256(f"{pii.KEY}|ip|{a}|{i}|{of}".encode()).hexdigest()[:15], 16)

    def plain(ip):
        o = list(map(int, ip.split(".")))
        lo, r = o[0] * 256 + o[1], o[2] * 256 + o[3]
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                lo = (lo + shift(r, 65536, i)) % 65536
            else:
                r = (r + shift(lo, 65536, i)) % 65536
        return f"{lo // 256}.{lo % 256}.{r // 256}.{r % 256}"

    ips = [f"{i}.7.{255 - i}.9" for i in range(1, 60)]
    out = pii.pseudonymise(spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [plain(x) for x in ips]


def plain_pseudonym(kind, value):
    """Each format's keyed permutation step by step, in plain Python."""
    from datetime import date, datetime, timedelta

    def feistel(lo, r, a, b, kind=kind):
        for i in range(pii.ROUNDS):
            move = int(hashlib.sha256(f"{pii.KEY}|{kind}|{a}|{i}|{lo if i % 2 else r}".encode()).hexdigest()[:15], 16)
            lo, r = (lo, (r + move) % b) if i % 2 else ((lo + move) % a, r)
        return lo, r

    def digits(d):
        half = len(d) // 2
        lo, r = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
        return f"{lo:0{half}d}{r:0{len(d) - half}d}"

    def into(shape, d):
        d = iter(d)
        return "".join(next(d) if c.isdigit() else c for c in shape)

    d = "".join(c for c in value if c.isdigit())
    if kind == "card":
        q = digits(d[:-1])
        return into(value, q + next(c for c in "0123456789" if luhn(q + c) % 10 == 0))
    if kind == "phone":
        return into(value, d[:-10] + digits(d[-10:]))
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        lo, r = feistel(areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 88902, 9999)
        return f"{areas[lo // 99]:03d}-{lo % 99 + 1:02d}-{r + 1:04d}"
    if kind == "iban":
        w = value.replace(" ", "")
        body = into(w[4:], digits("".join(c for c in w[4:] if c.isdigit())))
        check = 98 - int("".join(str(int(c, 36)) for c in body + w[:2] + "00")) % 97
        new = f"{w[:2]}{check:02d}{body}"
        return " ".join(new[k : k + 4] for k in range(0, len(new), 4)) if " " in value else new
    form = next(f for f in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y") if f[2] in value)
    own, x = "date" if "-" in value else "date-22", datetime.strptime(value, form).date()
    if (x.month, x.day) == (2, 29):
        leap = [y for y in range(1700, 2100) if (y % 4 == 0 and y % 100) or y % 400 == 0]
        return x.replace(year=leap[feistel(leap.index(x.year), 0, len(leap), 1, f"{own}-leap")[0]]).strftime(form)
    days = [(d.month, d.day) for d in (date(2023, 1, 1) + timedelta(k) for k in range(365))]
    lo, r = feistel(x.year - 1700, days.index((x.month, x.day)), 400, 365, own)
    return date(1700 + lo, *days[r]).strftime(form)


def test_every_format_against_a_plain_version(spark):
    rng = random.Random(21)
    cases = [("card", c) for c in ("4111111111111111", "5500-0000-0000-0004", "3782 822463 10005", "6011000990139424", "4222222222222")]
    cases += [("phone", p) for p in ("+1 (017) 555-7713", "(212) 555-0100", "415.555.2671", "+44 207 555 0123", "212-555-0188")]
    cases += [("ssn", f"{rng.choice([1, 123, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}") for _ in range(12)]
    cases += [("iban", x) for x in ("DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606")]
    cases += [("date", x) for x in ("1700-01-01", "2099-12-31", "2024-02-29", "28/02/2023", "05.06.1999", "31/12/1899")]
    df = spark.createDataFrame([(i, f"see {v} there") for i, (_, v) in enumerate(cases)], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df).orderBy("doc_id").collect()]
    assert out == [f"see {plain_pseudonym(k, v)} there" for k, v in cases]
    assert all(len(set(x)) == len(x) for x in ([o for o, (k, _) in zip(out, cases, strict=True) if k == kind] for kind in ("card", "phone", "ssn", "iban", "date")))


def test_no_number_where_runs_of_digits_are_longer(spark):
    texts = ["4" * 20, "1" * 200, "12345678901234567890 123-45-67890", "2023-02-281", "1.2.3.4.5", "666-12-1234 000-12-1234 900-12-1234 123-00-1234", "DE00370400440532013000", "99/99/2023 31.02.2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pii.pseudonymise(df).orderBy("doc_id").collect()] == texts
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        mine = pii.pseudonymise(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")).first()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert mine != pii.pseudonymise(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")).first()["text"]


def test_pseudonyms_leave_the_rest_alone(spark, odd, empty, sf):
    out = pii.pseudonymise(odd)
    assert out.columns == [*odd.columns, "n_pseudonyms"] and out.drop("n_pseudonyms").exceptAll(odd).count() == 0
    assert pii.pseudonymise(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pii.pseudonymise(docs).where("n_pseudonyms = 0").drop("n_pseudonyms")
    assert kept.exceptAll(docs).count() == 0 and 0 < kept.count() < docs.count()
    assert "Python" not in pii.pseudonymise(docs)._jdf.queryExecution().toString()


# --- 2: language -----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, given, sf):
    out = registry.QUERIES["op2_language_id"](spark, sf).toPandas()
    assert len(out) == len(given) and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    both = out.merge(given, on="doc_id")
    held = both[both["held_out"] & both["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


@pytest.mark.parametrize("languages", [3, 4])
def test_forward_sums_all_segmentations(languages):
    pieces = ["▁a", "a", "b", "ab", "ba", "aba", "▁ab", "▁"]
    rng = random.Random(languages)
    table = {p: tuple(rng.random() / 8 for _ in range(languages)) for p in pieces}

    def total(run, k):
        if not run:
            return 1.0
        return sum((table[run[:n]][k] if run[:n] in table else langid.UNKNOWN) * total(run[n:], k) for n in range(1, len(run) + 1) if run[:n] in table or n == 1)

    for run in ("▁abab", "▁aabba", "▁axb", "▁"):
        found = langid.log_likelihoods(run, langid.with_suffixes(table), languages)
        assert np.allclose(found, [np.log(total(run, k)) for k in range(languages)])
        counts = dict.fromkeys(pieces, 0.0)
        langid.expected_counts(run, 2.0, {p: v[0] for p, v in table.items()}, counts)
        if "x" not in run:
            assert abs(sum(len(p) * n for p, n in counts.items()) - 2 * len(run)) < 1e-6


def test_long_runs_and_many_runs_at_once():
    rng = random.Random(13)
    letters = "abcdeé▁"
    table = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): tuple(rng.random() / 50 for _ in range(3)) for _ in range(400)}
    tree = langid._Tree(table, 3)
    for size in (1, 2, 9, langid.SHORT):
        runs = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(50)]
        assert all(map(tree.covers, runs)) and np.allclose(tree.sums(runs), [langid.log_likelihoods(r, langid.with_suffixes(table), 3) for r in runs])
    run = "".join(rng.choice(letters + "x") for _ in range(700))
    logs = np.full((len(run) + 1, 3), -np.inf)  # the same sum by logs
    logs[0] = 0
    for i, j, piece in langid.spans(run, table):
        logs[j] = np.logaddexp(logs[j], logs[i] + np.log(table.get(piece, (langid.UNKNOWN,) * 3)))
    assert np.allclose(langid.log_likelihoods(run, langid.with_suffixes(table), 3), logs[-1]) and (logs[-1] < -1000).all()
    one = {p: v[0] for p, v in table.items()}
    plain, by_logs = dict.fromkeys(one, 0.0), dict.fromkeys(one, 0.0)
    short = run[: langid.SHORT]
    langid.expected_counts(short, 2.0, one, plain)
    langid._expected_by_logs(langid.spans(short, one), len(short), 2.0, one, by_logs)
    assert np.allclose(list(plain.values()), list(by_logs.values()))
    langid.expected_counts(run, 1.0, one, by_logs)
    assert np.isfinite(list(by_logs.values())).all()


def test_labels_and_scores_against_plain_sums(spark, given, sf, monkeypatch):
    """Every piece of the vocabulary counts, and each document's label and score are those of a plain sum over its words."""
    monkeypatch.setattr(langid, "CACHE", 300)  # starts anew many times
    monkeypatch.setattr(langid, "BATCH", 16)
    import public_tokenizers

    path = public_tokenizers.path(langid.VOCABULARY)
    models = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0"), path)
    assert max(map(len, langid.pieces(path))) > 10 and all(set(m) == set(langid.pieces(path)) and abs(sum(m.values()) - 1) < 1e-6 for m in models.values())
    texts = [t for t in given["text"][:60]] + ["漢字" * 40, "a" * 3000, "Ab1c", None, "...", "İi ßx"]
    got = langid._Scorer(models)(texts[:30]) + langid._Scorer(models)(texts[30:])
    languages = sorted(models)
    table = langid.with_suffixes({p: tuple(models[x][p] for x in languages) for p in models[languages[0]]})
    for text, (label, score) in zip(texts, got, strict=True):
        total, any_run = np.zeros(len(languages)), False
        for word in (text or "").lower().split():
            for run in langid.runs_of(word):
                total, any_run = total + langid.log_likelihoods(run, table, len(languages)), True
        shares = np.exp(total - total.max())
        assert (label, score) == ("und", 0.0) if not any_run else label == languages[int(shares.argmax())] and abs(score - shares.max() / shares.sum()) < 1e-9


def test_language_on_awkward_tables(spark, odd, empty):
    out = langid.identify(odd).collect()
    assert len(out) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (2, 3, 4, 9))
    assert langid.identify(empty).count() == 0
    none = spark.createDataFrame([(1, "words", None, None, None)], DOC)
    assert langid.identify(none).first()["lang_pred"] == "und"
    kept = langid.with_language(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 5, 6, 7, 8}


# --- 3: max-plus encoding --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return viterbi.loaded(public_tokenizers.path(viterbi.VOCABULARY))


def whole(p, text):
    t = "▁" + text.replace(" ", "▁")
    return p.best(t, 0, len(t), len(t)) if text else b""


def by_chunks(p, text, size):
    t = "▁" + text.replace(" ", "▁")
    parts = [(t[k : k + size + p.longest - 1], min(size, len(t) - k)) for k in range(0, len(t), size)]
    first = [(p.bounds(*x) or (-1, -1))[0] for x in parts]
    states = viterbi.boundary_states(p, [(viterbi.chunk_matrix(p, *x), x[0] if f < 0 else x[0][:f], f, x[1]) for x, f in zip(parts, first, strict=True)])
    return b"".join(viterbi.chunk_ids(p, *x, states[k], states[k + 1]) for k, x in enumerate(parts))


def test_chunks_give_the_whole_path(vocabulary):
    rng = random.Random(5)
    alphabet = ["the", "in", " ", "  ", "\n", "tion", "é", "x", "representations", "0", "漢", " ▁", "a", "%", "%%", "<0x0A>"]
    for _ in range(150):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        t = t.replace(" ", "") if rng.random() < 0.3 else t
        want = whole(vocabulary, t)
        assert vocabulary.encode(t) == want
        for size in (16, 17, 23, 40):
            assert by_chunks(vocabulary, t, size) == want
        if "▁" not in t:
            assert vocabulary.decode(want) == t


def test_best_path_against_all_paths(vocabulary):
    def every(t):
        if not t:
            return [(0, ())]
        return [(vocabulary.score(t[:n]) + s, (t[:n], *rest)) for n in range(1, len(t) + 1) if vocabulary.score(t[:n]) is not None for s, rest in every(t[n:])]

    for text in ("then", "an x", "%%%", "öf"):
        t = "▁" + text.replace(" ", "▁")
        top = max(s for s, _ in every(t))
        path = max((p for s, p in every(t) if s == top), key=lambda p: tuple(map(len, reversed(p))))
        want = b"".join(vocabulary.table[x][1] if x in vocabulary.table else vocabulary.spelt(x) for x in path)
        assert vocabulary.encode(text) == want


def test_matrix_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (4, 4)) for _ in range(3))
    assert (viterbi.product(viterbi.product(a, b), c) == viterbi.product(a, viterbi.product(b, c))).all()


def test_encoding_in_spark(spark, odd, empty, vocabulary):
    for size in (64, viterbi.CHUNK):
        out = viterbi.decode(viterbi.encode(odd, chunk=size)).collect()
        assert len(out) == odd.count()
        for r in out:
            assert bytes(r["ids"]) == whole(vocabulary, r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert viterbi.encode(empty).count() == 0


# --- 4: licences -----------------------------------------------------------------------------------------------------

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice shall be included in all
copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


def test_licence_rules(spark, odd, empty):
    cases = {
        MIT: "MIT",
        "Licensed under the Apache License, Version 2.0. Also licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Text.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.": "MIT,CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "the GNU General Public License as published, either version 3 of the License, or (at your option) any later version. It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.": "GPL-3.0-or-later",
        "a licence to kill": "", "": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [out[i]["licences"] for i in range(len(cases))] == list(cases.values())
    assert all(out[i]["n_unmatched"] == 0 for i in range(len(cases)))
    assert licences.scan(odd).count() == odd.count() and licences.scan(empty).count() == 0


#: A text for each licence sentence that is more than its pattern's own words.
HELD = {
    "mit-notice": "The above copyright notice and this permission notice (with the next paragraph) shall be included in all copies",
    "mit-0": "Available under MIT-0", "mit-ref": "Published under the MIT Licence", "apache-2-ref": "under the Apache License, Version 2.0",
    "agpl-3-later": "GNU Affero General Public License, either version 3 of the License, or any later version", "agpl-3": "GNU Affero General Public License v3",
    "lgpl-3-later": "GNU Lesser General Public License, either version 3 of the License, or any later version", "lgpl-3": "GNU Lesser General Public License v3",
    "lgpl-2.1-later": "GNU Lesser General Public License, either version 2.1 of the License, or any later version", "lgpl-2.1": "GNU Lesser General Public License v2.1",
    "gpl-3-later": "GNU General Public License, either version 3 of the License, or any later version", "gpl-3": "GNU General Public License v3",
    "gpl-2-later": "GNU General Public License, either version 2 of the License, or any later version", "gpl-2": "GNU General Public License v2",
    "mpl-2": "the Mozilla Public License, version 2", "bsd-endorse": "Neither the name of X nor of Y may be used to endorse or promote products",
    "bsd-3-ref": "under the BSD 3-Clause", "bsd-2-ref": "under the 2-clause BSD", "cc-by-nc-sa-4": "under CC BY-NC-SA 4.0", "cc-by-nc-nd-4": "Creative Commons Attribution-NonCommercial-NoDerivs 4.0",
    "cc-by-nc-4": "CC BY-NC 4.0", "cc-by-sa-4": "CC BY-SA 4.0", "cc-by-nd-4": "CC BY-ND 4.0", "cc-by-4": "Creative Commons Attribution 4.0", "cc0": "CC0 1.0", "epl-2": "Eclipse Public License v2",
    "boost-1": "Boost Software License 1.0", "public-domain": "released into the public domain",
    "mit-title": "MIT License", "apache-2-title": "The Apache License 2.0", "bsd-3-title": "the revised BSD licence", "bsd-2-title": "BSD 2-Clause", "isc-title": "ISC License",
}


#: Notices as they stand at the head of files, none of which the patterns were written from.
NOTICES = {
    "MIT License\n\nCopyright (c) 2031 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software.": "MIT",
    "// SPDX-License-Identifier: Apache-2.0\nint main;": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later", "/* SPDX-License-Identifier: BSD-3-Clause */": "BSD-3-Clause",
    "Use of this source is governed by a BSD 3-Clause licence.": "BSD-3-Clause", "This photo is shared under CC BY 4.0.": "CC-BY-4.0", "Dedicated with CC0 1.0.": "CC0-1.0", "Code: MIT License.": "MIT",
    "This software is provided 'as-is', without any express or implied warranty. 1. The origin of this software must not be misrepresented; you must not claim that you wrote it. 2. Altered source versions must be plainly marked as such. 3. This notice may not be removed or altered from any source distribution.": "Zlib",
    "MIT has a licence to teach. Apache is a helicopter, version 2.": "", "Permission to park is hereby granted. All gifts received.": "",
}


def test_notices_at_the_head_of_files(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string")
    out = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert [out[i] for i in range(len(NOTICES))] == list(NOTICES.values())


def test_licence_sql_gives_the_same(spark, odd, sf, tmp_path):
    """The SQL, which has no gate and cuts sentences at names, over given documents and over every sentence and notice."""
    import duckdb

    texts = [f"Some prose. {HELD.get(name, pattern)}. More." for name, pattern in licences.SENTENCES] + [*NOTICES, MIT, None, "", "GNU General Public License version 3 or under the Apache License, version 2.0"]
    texts += ["the GNU General Public License version 2 and the GNU Lesser General Public License version 3, all rights reserved"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = f"{tmp_path}/made.parquet"
    made.coalesce(1).write.parquet(path)
    for files, docs in ((f"{path}/*.parquet", made), (f"{sf}/documents.parquet", spark.read.parquet(f"{sf}/documents.parquet"))):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        rows = con.execute(licences.oracle_sql())
        names = [d[0] for d in rows.description]
        assert sorted(map(tuple, licences.scan(docs).select(*names).collect())) == sorted(rows.fetchall())


def test_every_licence_sentence_is_found(spark):
    cases = [(name, HELD.get(name, pattern)) for name, pattern in licences.SENTENCES]
    cases += [
        ("cc-by-4", "Available under CC BY 4.0"), ("cc0", "Creative Commons Zero"), ("bsd-3-ref", "under BSD-3-Clause"), ("mit-0", "MIT No Attribution"),
        ("mit-ref apache-2-ref", "Under the MIT License or under the Apache License, Version 2.0"),
        ("apache-2-ref mit-ref all-rights", "Under the Apache License 2.0 or under the MIT license, all rights reserved"),
        ("gpl-2 lgpl-3", "the GNU General Public License version 2 and the GNU Lesser General Public License version 3"),
        ("gpl-3 apache-2-ref", "GNU General Public License version 3 or under the Apache License, version 2.0"),
    ]
    df = spark.createDataFrame([(i, f"Some prose. {t}. More.") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    out = {r["doc_id"]: r["sentence_ids"] for r in licences.scan(df).collect()}
    assert [out[i] for i in range(len(cases))] == [ids for ids, _ in cases]


# --- 5: SimHash ------------------------------------------------------------------------------------------------------


def grouped(ids, near):
    parent = {i: i for i in ids}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in near:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_covering_masks_cover_every_pair():
    masks = simhash.covering_masks()
    bits = [1 << i for i in range(64)]
    assert all(any(not (a | b) & m for m in masks) for a in bits for b in bits)


@pytest.mark.parametrize("direct", [512, 1])
def test_components_against_all_pairs(spark, direct):
    """With direct = 1 every bucket takes the way for hot ones."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(20)]
    marks = {}
    for i in range(400):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        marks.setdefault(x, i)
    nodes = spark.createDataFrame([(simhash._signed(x), i) for x, i in marks.items()], "fp long, rep long")
    found = simhash.connected_components(simhash.links(nodes, direct))
    got = {r["node"]: r["component"] for r in found.collect()}
    items = list(marks.items())
    want = grouped(marks.values(), [(i, j) for x, i in items for y, j in items if (x ^ y).bit_count() <= 2])
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_of_documents(spark, given, sf):
    out = registry.QUERIES["op5_simhash_near_dedup"](spark, sf).toPandas()
    marks = {i: simhash.fingerprint_of(t) for i, t in zip(given["doc_id"], given["text"], strict=True)}
    assert dict(zip(out["doc_id"], out["fingerprint"], strict=True)) == {i: f"{m:016x}" for i, m in marks.items()}
    items = list(marks.items())
    assert dict(zip(out["doc_id"], out["component_id"], strict=True)) == grouped(marks, [(i, j) for i, x in items for j, y in items if (x ^ y).bit_count() <= 2])


def test_fingerprint_by_definition():
    import xxhash

    def plain(text):
        w = text.encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", "One", "one TWO", "a b c", "É a b c a b c a", "x\x0by\x1cz w"):
        assert simhash.fingerprint_of(t) == plain(t)


def test_near_duplicates_on_awkward_tables(spark, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (2, 3, 4)} == {2} and all(r["component_id"] == 1 for r in out if r["doc_id"] == 1)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    want = {r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] == r["component_id"]}
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2


def test_rows_without_an_id_link_and_bridge(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    marks = {"a": base, "b": base ^ 0b11, "c": base ^ 0b1111, "d": base ^ (1 << 40), "e": ~base & (2**64 - 1), "f": 0xF0F0F0F0F0F0F0F0}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id as id", "xxhash64(text) as hash", "element_at(map(" + ", ".join(f"'{k}', {simhash._signed(v)}L" for k, v in marks.items()) + "), text) as fp"))
    df = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "e"), (None, "e"), (9, "f")], "doc_id long, text string")
    out = sorted((r["fingerprint"], r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    ids = {"a": 3, "b": 3, "c": 3, "d": 3, "e": None, "f": 9}
    assert out == sorted((f"{marks[r['text']]:016x}", r["doc_id"] or 0, ids[r["text"]]) for r in df.collect())


def test_unlike_texts_of_one_id_both_stay(spark):
    rng = random.Random(11)
    one, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, one, "en"), (1, other, "en"), (2, one, "en"), (1, one, "de"), (1, one, "de"), (3, other, "en")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, other)])


# --- 6: edit embedding -----------------------------------------------------------------------------------------------


def test_edited_fingerprints_by_definition(spark, given, sf):
    out = registry.QUERIES["op6_document_fingerprints"](spark, sf).toPandas().set_index("doc_id")
    d = given.sort_values("doc_id", ascending=False)
    texts = [t or "" for t in d["text"]]
    for k, (i, t) in enumerate(zip(d["doc_id"], texts, strict=True)):
        n = len(t) // 2
        edited = t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]
        r = out.loc[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if k % 5 == 0:
            a, b = editwalk.fingerprint_of(t), editwalk.fingerprint_of(edited)
            assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b) and abs(r["near_edited"] - editwalk.likeness(a, b)) < 1e-12
    long = out[out["n_chars"] > 300]
    assert (long["near_edited"] > long["near_next"]).all() and abs(long["near_edited"].mean() - 0.5) < 0.05


def test_likeness_follows_edits():
    rng = random.Random(2)
    t = prose(rng, 400)
    one = t[:900] + "X" + t[900:]
    assert editwalk.likeness(editwalk.fingerprint_of(t), editwalk.fingerprint_of(one)) > 0.75
    assert editwalk.likeness(editwalk.fingerprint_of(t), editwalk.fingerprint_of(t)) == 1.0
    assert editwalk.likeness(editwalk.fingerprint_of(t), editwalk.fingerprint_of(prose(rng, 400))) < 0.2
    assert editwalk.likeness("00", editwalk.fingerprint_of(t)) == 0.0 and editwalk.likeness("00", "00") == 1.0


def test_edited_on_awkward_tables(spark, odd, empty):
    out = editwalk.edited_fingerprints(odd).collect()
    assert len(out) == odd.count() and all(r["n_chars"] == 0 for r in out if r["doc_id"] in (2, 3))
    assert editwalk.edited_fingerprints(empty).count() == 0
    one = editwalk.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


def test_banding_finds_all_near_documents(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        t = prose(rng, 200)
        texts += [t, t[:300] + "q" + t[301:], t + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [editwalk.fingerprint_of(t) for t in texts]
    first = {m: i for i, m in reversed(list(enumerate(marks)))}  # copies of a fingerprint are one node
    nodes = sorted(first.values())
    want = {(i, j) for i in nodes for j in nodes if i < j and editwalk.likeness(marks[i], marks[j]) >= 0.8}
    got = {(r["src"], r["dst"]) for r in editwalk.edit_links(df).collect()}
    assert want and got <= want and len(got) >= 0.95 * len(want)


def test_banding_on_given_documents(spark, given, sf):
    """Recall of banding against all pairs of fingerprints, and the classes as membership."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {i: editwalk.fingerprint_of(t) for i, t in zip(given["doc_id"], given["text"], strict=True)}
    first = {}
    for i in sorted(marks):
        first.setdefault(marks[i], i)
    nodes = sorted(first.values())
    near = [(i, j) for k, i in enumerate(nodes) for j in nodes[k + 1 :] if editwalk.likeness(marks[i], marks[j]) >= 0.8]
    found = {(r["src"], r["dst"]) for r in editwalk.edit_links(docs).collect()}
    assert near and found <= set(near) and len(found) >= 0.9 * len(near)
    classes = {r["doc_id"]: r["component_id"] for r in editwalk.edit_classes(docs).collect()}
    top = grouped(nodes, found)
    assert classes == {i: top[first[m]] for i, m in marks.items()}


def test_bands_of_awkward_tables_and_hot_buckets(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(editwalk, "BLOCK", 8)
    out = {}
    for r in editwalk.edit_classes(odd).collect():
        out.setdefault(r["doc_id"], []).append(r["component_id"])
    assert sum(map(len, out.values())) == odd.count() and out[1] == [1, 1] and out[2] == out[3] == [2] and sorted(out[None]) == [1, 2]
    assert editwalk.edit_classes(empty).count() == 0 and editwalk.edit_links(empty).count() == 0 and editwalk.edit_links(odd).count() >= 0
    rng = random.Random(14)
    base = prose(rng, 300)
    near = [(k, base[:900] + f" {k} " + base[900:]) for k in range(60)]  # one bucket of many blocks
    got = editwalk.edit_classes(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    a = [editwalk.fingerprint_of(t) for t in (None, "a", "ab", base, base[:700], base * 3, base + " end")]
    assert np.allclose(editwalk._likeness_matrix(a, a), [[editwalk.likeness(x, y) for y in a] for x in a])


def test_next_documents_of_hot_ids_and_without_ids(spark, monkeypatch):
    """Runs of a few bytes: rows of one id and rows without an id go by the hash of their texts, nulls last."""
    monkeypatch.setattr(editwalk, "PER_RUN", 200)
    rng = random.Random(15)
    rows = [(7, f"hot {k} {prose(rng, 3)}") for k in range(30)] + [(None, f"none {k} {prose(rng, 3)}") for k in range(30)] + [(k, prose(rng, 6)) for k in range(20)] + [(None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        want.append((i is None, i or 0, hashlib.sha256((t[: len(t) - n] + other[:n]).encode()).hexdigest()))
    out = [(r["doc_id"] is None, r["doc_id"] or 0, r["edited_sha256"]) for r in editwalk.edited_fingerprints(df).collect()]
    assert sorted(out) == sorted(want)


# --- 7: packing ------------------------------------------------------------------------------------------------------


def check_packing(out, capacity):
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= capacity and (g["offset"].to_numpy() == np.append(0, np.cumsum(g["length"])[:-1])).all()


def test_packing_pieces_and_places(spark, given, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = registry.QUERIES["op7_best_fit_packing"](spark, sf).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, x in zip(given["doc_id"], given["text"], strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    check_packing(out, 2048)
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 2048)


def test_word_encoder_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, t, rng = packing.WordEncoder(path), Tokenizer.from_file(path), random.Random(3)
    latin = [chr(c) for c in range(32, 256)]
    wide = [*latin, *"'sé İΣσς’“”²½ªº\x85\xa0 　漢字éǄ\x1c\n\t_-", "'re", "don't", "I'LL", "<|endoftext|>", "ﬁ"]
    for k in range(3000):
        x = "".join(rng.choice(latin if k % 2 else wide) for _ in range(rng.randint(0, 40)))
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_bin_completion_beats_or_meets_best_fit():
    rng = np.random.default_rng(1)
    for capacity in (10, 30, 97):
        for _ in range(20):
            counts = np.zeros(capacity + 1, np.int64)
            for x in rng.integers(1, capacity + 1, 40):
                counts[x] += 1
            plan = packing.plan_bins(counts, capacity)
            used = np.zeros_like(counts)
            for bins, filling in plan:
                assert sum(x * n for x, n in filling) <= capacity
                for x, n in filling:
                    used[x] += bins * n
            assert (used == counts).all()
            assert sum(b for b, _ in plan) <= sum(b for b, _ in packing._complete(counts, capacity))


def test_bin_completion_finds_an_optimum_that_best_fit_misses():
    counts = np.zeros(101, np.int64)
    counts[[44, 24, 22, 21, 17, 8, 6]] = [1, 1, 1, 1, 1, 3, 2]  # 44+24+22+8... = two full bins minus slack
    plan = packing.plan_bins(counts, 101)
    assert sum(b for b, _ in plan) == -(-int((counts * np.arange(101)).sum()) // 101)


def test_bins_are_branched_over():
    def fewest(lengths, capacity):
        """By dynamic programming over sets: (bins, filled of the last)."""
        best = {0: (1, 0)}
        for mask in range(1, 1 << len(lengths)):
            found = []
            for k, x in enumerate(lengths):
                if mask >> k & 1:
                    bins, filled = best[mask ^ (1 << k)]
                    found.append((bins, filled + x) if filled + x <= capacity else (bins + 1, x))
            best[mask] = min(found)
        return best[(1 << len(lengths)) - 1][0]

    rng = random.Random(5)
    cases = [(2048, [1024, 840, 799, 758, 675, 615, 512, 512, 409]), (2048, [1024, 840, 799, 758, 675, 615, 512, 512, 409] * 3)]
    cases += [(100, [rng.randint(20, 60) for _ in range(9)]) for _ in range(60)]
    for capacity, lengths in cases:
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan = packing.plan_bins(counts, capacity)
        used = np.zeros_like(counts)
        for bins, filling in plan:
            assert sum(x * n for x, n in filling) <= capacity
            for x, n in filling:
                used[x] += bins * n
        assert (used == counts).all()
        assert sum(n for n, _ in plan) == (9 if len(lengths) == 27 else fewest(lengths, capacity))


def test_mixtures_of_fillings_pack_what_best_fit_does_not():
    def planned(counts, capacity=2048):
        plan = packing.plan_bins(counts, capacity)
        used = np.zeros_like(counts)
        for bins, filling in plan:
            assert bins > 0 and sum(x * n for x, n in filling) <= capacity
            for x, n in filling:
                used[x] += bins * n
        assert (used == counts).all()
        return packing._size(plan)

    counts = np.zeros(2049, np.int64)
    counts[600:1024] = 47  # a plan by hand has 8,727, best fit 8,985
    assert planned(counts) <= 8670
    rng = np.random.default_rng(1)
    for low, high, n in [(500, 1500, 5000), (1, 2049, 20_000)]:
        counts = np.bincount(rng.integers(low, high, n), minlength=2049)
        found = packing._size(packing._complete(counts, 2048))
        assert packing._bound(counts, 2048) <= packing._mixture(counts, 2048, found + 1)[1] + 20
        assert planned(counts) <= found
    for _ in range(20):  # both bounds are below the fewest bins
        counts = np.bincount(rng.integers(20, 60, 7), minlength=101)
        size = planned(counts, 100)
        assert packing._bound(counts, 100) <= size and packing._mixture(counts, 100, size + 1)[1] <= size


def test_packing_on_awkward_tables(spark, odd, empty):
    out = packing.pack(odd, capacity=16).toPandas()
    check_packing(out, 16)
    assert len(out[out["piece"] == 0]) == odd.count() and packing.pack(empty).count() == 0
    assert set(out[out["doc_id"].isin([2, 3])]["length"]) == {1}


# --- 8: vectors ------------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 16)
    monkeypatch.setattr(vectors, "LEAF", 4)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 31 else None))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [1.0, None] * 4, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [1e-200, 2e-200], 1), (10, rows[10][1], rows[10][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("clash"))
    out = vectors.near_vectors(df).collect()
    good = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]

    def cosine(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    near = [(a, b) for a in good for b in good if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= 0.93]
    top = grouped({i for i, _, _ in rows}, [(a[1], b[1]) for a, b in near])
    links = {}
    for a, _ in near:
        links[a[0]] = links.get(a[0], 0) + 1
    want = sorted((i, links.get(k, 0), top[i], top[i] == i) for k, (i, _, _) in enumerate(rows))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == want


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 9: pages --------------------------------------------------------------------------------------------------------


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>if (a</b) x('<p>');</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>{body}{extra}<footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    article = "<div class='post-12 entry'><h1>Title &amp; more</h1><p><b>One&nbsp;two<br>three <!-- ad --> four<p>Five\n  six</p><ul><li>a<li>b</ul><aside>side</aside><form>f</form></div>"
    other = article.replace("post-12", "post-77").replace("Five", "Cinq")
    short = "<div class='post-3 entry'><p>Hi</p></div><div class='box'>" + "<p>A longer box that this page alone has, with many words in it.</p>" * 5 + "</div>"
    rows = [
        (1, "http://h.example/a", page(article, "<section id=comments><p>nice post</p></section>")), (2, "http://h.example/b", page(other)), (3, "http://h.example/c", page(short)),
        (4, None, page("<article><p>Solo</p></article>")), (5, "http://x.example/", None), (6, "http://x.example/", ""), (7, "http://y.example/", "plain &lt;text&gt;"), (None, "http://h.example/d", page(article)), (8, "http://z.example/", "<p>a<p>b</div></p><table><tr><td>c<td>d</table><div"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    for limit in (100, 0):
        out = {r["page_id"]: r for r in pages.main_text(df, broadcast_hosts=limit).collect()}
        assert out[1]["text"] == "Title & more\n\nOne two three four\n\nFive six\n\na\n\nb" == out[None]["text"]
        assert out[2]["text"].startswith("Title") and out[3]["text"] == "Hi" and out[4]["text"] == "Solo"
        assert out[5]["text"] == out[6]["text"] == "" and out[7]["text"] == "plain <text>" and out[8]["text"] == "a\n\nb\n\nc\n\nd"
        assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_loses_no_article():
    story = "<p>A long paragraph of the story, with words enough to count.</p>" * 6
    story_text = "\n\n".join(["A long paragraph of the story, with words enough to count."] * 6)

    def text(body):
        p = pages.Page(page(body))
        return p.text(p.best()[0])

    whole = f"Title\n\nlead\n\n{story_text}"
    for body in (
        f"<article><h1>Title</h1><p>lead</p><div class=story>{story}</div></article>",
        f"<div class='header-layout'><article><h1>Title</h1><p>lead</p>{story}</article></div>",
        f"<form id=aspnetForm><div class='share'>Share it</div><div><h1>Title</h1><p>lead</p>{story}</div></form>",
        f"<article><h1>Title</h1><p>lead</p>{story}</article><div class=comments><article>{story}{story}</article></div><div class=ad>{story}{story}</div><form>{story}</form>",
        f"<article><h1>Title</h1><p>lead</p><div class='social-story'>{story}</div></article>",
    ):
        assert text(body) == whole
    assert not pages.Page(page(f"<div class=entry><p>teaser</p></div><article>{story}</article>")).fits(">html>body>div.entry")


def test_class_names_that_only_resemble_boilerplate():
    story = "<p>A long paragraph of the story, with words enough to count.</p>" * 4
    story_text = "\n\n".join(["A long paragraph of the story, with words enough to count."] * 4)

    def text(body):
        p = pages.Page(page(body))
        return p.text(p.best()[0])

    rows = "<div class='search-results-table'><p>Results in rows.</p></div><div class='promo-free widget'><p>No adverts here.</p></div><div class='entry-header'><p>By A. Writer</p></div>"
    assert text(f"<article><h1>Title</h1>{rows}{story}</article>") == f"Title\n\nResults in rows.\n\nNo adverts here.\n\nBy A. Writer\n\n{story_text}"
    assert text(f"<div class='related-work'><h1>Title</h1>{story}</div><div class=box><p>Hello</p></div>").startswith(f"Title\n\n{story_text}")
    for gone in ("ad", "ads", "site-header", "pageFooter", "main-nav", "left-sidebar", "cookie-notice", "post-comments", "comment-list", "share-buttons", "newsletter-form", "related", "promo", "notice"):
        assert text(f"<article><h1>Title</h1>{story}<div class='{gone}'><p>Not the story, but a sentence.</p></div></article>") == f"Title\n\n{story_text}", gone


def test_votes_ties_repeats_and_depth(spark):
    deep = "<div>" * 3000 + "<p>Bottom</p>" + "</div>" * 3000
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    even = ["<div class=a><p>Some words here</p></div>", "<div class=b><p>Some words here</p></div>"]  # a vote each, as much text
    rows = [(1, "http://a.example/1", even[1]), (2, "http://a.example/2", even[0]), (3, "http://b.example/", deep), (4, "http://c.example/", long), (4, "http://c.example/", long), (5, "http://a.example/3", even[0] + even[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert dict(map(tuple, pages.host_paths(df.where("page_id < 3")).collect())) == {"a.example": ">div.a"}
    out = {}
    for r in pages.main_text(df).collect():
        out.setdefault(r["page_id"], []).append(r["text"])
    assert out[3] == ["Bottom"] and len(out[4]) == 2 and set(out[4]) == {"\n\n".join(["word word word"] * 20_000)}
    assert out[1] == out[2] == ["Some words here"]


def test_main_text_of_given_pages(spark, sf):
    import html
    import re

    d = pq.read_table(f"{sf}/pages.parquet").to_pandas()
    out = registry.QUERIES["op9_html_extraction"](spark, sf).toPandas().set_index("page_id")
    for r in d.itertuples():
        m = re.search(r"<article>(.*?)</article>", r.html, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", m[1])]
        assert out.loc[r.page_id]["text"] == "\n\n".join(b for b in blocks if b)


# --- 10: repeats -----------------------------------------------------------------------------------------------------


def test_repeats_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PER_RUN", 3000)
    monkeypatch.setattr(repeats, "PER_RANGE", 500)
    rng = random.Random(6)
    shared = [prose(rng, rng.randint(19, 45)) for _ in range(8)]
    texts = [(i, " ".join(rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    texts += [(500, shared[0] + " " + shared[0] + "\x0b" + shared[0]), (501, "x " * 60), (502, None), (503, "é\x1c" * 3 + " " + shared[1].replace(" ", "\n"))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("run", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.repeat_digest(df.repartition(5)).collect()}
    assert got == repeats.brute_force(texts) and sum(g[1] for g in got.values()) > 500


def test_repeats_on_awkward_tables(spark, odd, empty):
    out = repeats.remove_repeats(odd).collect()
    assert len(out) == odd.count()
    first = [r["n_removed"] for r in out if r["doc_id"] == 1]
    assert sorted(first) == [0, 80] and repeats.remove_repeats(empty).count() == 0


def test_repeats_over_two_levels(spark, monkeypatch):
    """More runs than FAN meet in groups of a hash range first; a passage of all documents and a hot id change nothing."""
    for name, value in (("PER_RUN", 700), ("PER_RANGE", 500), ("FAN", 4)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(8)
    common = prose(rng, 30)
    texts = [(i, f"{prose(rng, rng.randint(0, 25))} {common} {prose(rng, 3)}") for i in range(90)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.repeat_digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == repeats.brute_force(texts)


def test_repeats_of_one_id(spark, monkeypatch):
    """Of equal rows, rows of one id and rows without an id, the first in the table keeps a passage, whatever runs they are in."""
    monkeypatch.setattr(repeats, "PER_RUN", 300)
    passage = prose(random.Random(9), 25)
    rows = [(None, passage), (None, f"x {passage}"), (7, passage), (7, passage), (7, f"y {passage}"), (8, "z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("n_chars", F.length("text")).withColumn("key", F.lit("clash"))
    out = repeats.without_repeats(df)
    assert out.dtypes == df.dtypes
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None) == sorted([(0, "", 0), (0, "x", 1), (7, passage, len(passage)), (7, "", 0), (7, "y", 1), (8, "z", 1)])
    assert out.count() == len(rows)


def test_passages_go_from_awkward_tables(spark, odd, empty):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and repeats.without_repeats(empty).count() == 0
    assert sorted(r["text"] for r in out.where("doc_id = 1").collect())[0] == ""
    assert out.where("doc_id = 5").first() == odd.where("doc_id = 5").first()


def test_words_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    texts = [b"ab " * 50, b"w" * 300 + b" \x00 w" + b"w" * 300, None, b" ", b"x" * 257, b"x" * 256, b"x" * 255 + b"\x00", b"abcdefgh", b"abcdefghi abcdefgh\x00"]
    hashes, sizes = repeats._hashed(texts, 2)
    words = [w for t in texts for w in (t or b"").split()]
    assert sizes.tolist() == [len((t or b"").split()) for t in texts] and hashes.shape == (2, len(words))
    for row in hashes.tolist():
        assert len(set(row)) == len(set(words)) == len(set(zip(row, words, strict=True)))


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_steps(spark, given, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {i: t for i, t in zip(given["doc_id"], given["text"], strict=True) if t and any(c.isalpha() for c in t)}
    marks = {i: simhash.fingerprint_of(t) for i, t in kept.items()}
    top = grouped(kept, [(i, j) for i, x in marks.items() for j, y in marks.items() if (x ^ y).bit_count() <= 2])
    kept = {i: t for i, t in kept.items() if top[i] == i}
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r["doc_id"] for r in docs.select("doc_id").collect()} == set(kept)
    cut = corpus_pipeline.STAGES[2][1](spark, docs, sf)
    want = repeats.brute_force(list(kept.items()))
    for r in cut.collect():
        words, removed, digest = want[r["doc_id"]]
        assert (r["text"] == kept[r["doc_id"]]) if not removed else hashlib.sha256(r["text"].encode()).hexdigest() == digest
        assert not removed or r["n_chars"] == len(r["text"])
    safe = corpus_pipeline.STAGES[3][1](spark, cut, sf)
    assert safe.columns == docs.columns and safe.count() == len(kept)
    out = corpus_pipeline.run(spark, sf).toPandas()
    check_packing(out, 2048)
    assert set(out["doc_id"]) == set(kept)


def test_stages_on_awkward_tables(spark, odd, empty):
    """Nulls, repeats, ties and clashing names go through all stages in a row, each on what the one before kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for start in (odd, empty, odd.withColumn("lang", F.lit(None).cast("string"))):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, "")
            if name != "best_fit_packing":
                assert docs.dtypes == before.dtypes
            if name in ("substring_dedup", "pii"):
                assert docs.count() == before.count()
        assert docs.where("piece = 0").count() == before.count()
    kept = corpus_pipeline.STAGES[0][1](spark, odd, "")
    assert {r["doc_id"] for r in kept.collect()} == {1, None, 5, 6, 7, 8}


def test_pipeline_rows_against_plain_steps(spark, given, sf):
    """The packed ids of every document that stays are those of its text after all four steps before, in plain Python where
    the steps are; pseudonyms are checked by format elsewhere and taken from the column function here."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = {i: t for i, t in zip(given["doc_id"], given["text"], strict=True) if t and any(c.isalpha() for c in t)}
    marks = {i: simhash.fingerprint_of(t) for i, t in kept.items()}
    top = grouped(kept, [(i, j) for i, x in marks.items() for j, y in marks.items() if (x ^ y).bit_count() <= 2])
    kept = {i: t for i, t in kept.items() if top[i] == i}
    seen, cut = set(), {}
    for i in sorted(kept):
        words = kept[i].encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if (window := tuple(words[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        cut[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else kept[i]
    safe = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(cut.items()), "doc_id long, text string")).collect()}
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, x in safe.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(out) == len(want)
