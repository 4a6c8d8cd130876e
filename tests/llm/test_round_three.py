"""Cases of the third round: helper names, dates by format, signs that are no letters."""

from datetime import date, timedelta

from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import langid, pii


def test_helper_columns_may_clash(spark, sf):
    names = ("__mail", "__mail_new", "__mail_n", "__number", "__number_new", "__number_n", "__pseudonyms", "__mail_")
    docs = spark.createDataFrame([(1, "write to a.b@c.de or call +1 (672) 555-0196", "en", "s", 43)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for out in (pii.pseudonymise(docs), pii.without_personal_data(docs), corpus_pipeline.pii(spark, docs, sf)):
        row = out.first().asDict()
        assert all(row[n] == n for n in names) and "a.b@c.de" not in row["text"] and "555-0196" not in row["text"]
    assert pii.without_personal_data(docs).columns == docs.columns


def test_distinct_dates_stay_distinct(spark):
    """All days of two years in every format, and 29 February of all leap years."""
    days = [date(2019, 1, 1) + timedelta(k) for k in range(731)] + [date(y, 2, 29) for y in range(1704, 2100) if (y % 4 == 0 and y % 100) or y % 400 == 0]
    written = {f"{d:%Y-%m-%d}" for d in days}
    for d in days:
        for a, b in ((d.day, d.month), (d.month, d.day)):
            written |= {f"{x}/{y}/{d.year}" for x in (f"{a}", f"{a:02d}") for y in (f"{b}", f"{b:02d}")}
        written |= {f"{x}.{y}.{d.year}" for x in (f"{d.day}", f"{d.day:02d}") for y in (f"{d.month}", f"{d.month:02d}")}
    rows = spark.createDataFrame(list(enumerate(sorted(written))), "doc_id long, text string")
    out = {t: r["text"] for t, r in zip(sorted(written), pii.pseudonymise(rows).orderBy("doc_id").collect(), strict=True)}
    assert len(set(out.values())) == len(written) > 5000
    same = sum(k == v for k, v in out.items())
    assert same < 20
    for before, after in out.items():
        assert [len(x) for x in before.replace(".", "/").split("/")] == [len(x) for x in after.replace(".", "/").split("/")]
        y, m, d = (int(after[:4]), int(after[5:7]), int(after[8:])) if "-" in after else (lambda p: (p[2], p[1], p[0]) if p[1] <= 12 else (p[2], p[0], p[1]))([int(x) for x in after.replace(".", "/").split("/")])
        assert date(y, m, d) and 1700 <= y < 2100
    bad = ["2023-02-29", "29.02.2023", "31/04/2020", "13/13/2020", "2020-13-01", "0/5/2020", "31.4.2020", "12.13.2020"]
    rows = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    assert [r["text"] for r in pii.pseudonymise(rows).orderBy("doc_id").collect()] == bad


def test_number_signs_are_no_letters():
    assert [langid.runs_of(t) for t in ("²", "½", "①②", "")] == [[], [], [], []]
    assert [r.lstrip("▁ ") for r in langid.runs_of("x²y")] == ["x", "y"] and len(langid.runs_of("naïve")) == 1


def test_texts_of_number_signs_are_undetermined(spark):
    rows = [(k, "the cat and the dog of the house " * 5, "en") for k in range(40)] + [(100 + k, "der hund und die katze aus dem haus " * 5, "de") for k in range(40)]
    rows += [(500, "²", None), (501, "½ ① ³", None), (502, "the dog² and the cat", None)]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})).collect()}
    assert out[500]["lang_pred"] == out[501]["lang_pred"] == "und" and out[502]["lang_pred"] == "en"
