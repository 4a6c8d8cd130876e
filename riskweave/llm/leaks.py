"""Benchmark passages in documents by a prefix-filtered set join, in SQL functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import materialise

#: Words of a window, and of the shingles by which windows are looked for.
WINDOW = 10
SHINGLE = 3
#: Windows that may be broadcast, at some 150 bytes each; more are joined by a shuffle.
BROADCAST = 200_000
#: Keys over which rows that stand for a document itself are spread.
_SPREAD = 1024
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, _GAPS), ""), F.array().cast("array<string>"))


def _token(words: Column, at: Column, width: int) -> Column:
    """An even number for the shingle of so many words; odd ones stand for documents."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)]).bitwiseAND(F.lit(-2))


def _tokens(words: Column, at: Column, widths: list[int]) -> Column:
    """The shingles that start at a place, one for each width in use."""
    return F.array(*[_token(words, at, k) for k in widths])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, win, n): each distinct window of each item, as text, with its words' number. An item of fewer words is one window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = items.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("start"))
    return starts.select("item", F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("win"), "n").distinct()


def _prefixes(docs: DataFrame, windows: DataFrame, shingle: int, broadcast: int) -> tuple[DataFrame, list[int], bool]:
    """(token, offset, n, win, wid) of every window that may occur: its rarest shingle by how often documents have it. Also the
    widths of shingles in use, and whether the windows are few."""
    each = materialise(windows.groupBy("win").agg(F.first("n").alias("n")).withColumn("wid", F.monotonically_increasing_id()))
    words, width = F.split("win", " "), F.least(F.col("n"), F.lit(shingle))
    found = each.agg(F.count("*").alias("n"), F.collect_set(width).alias("widths")).first()
    widths, few = sorted(found["widths"]), found["n"] <= broadcast
    if not widths:
        return each.selectExpr("wid as token", "0 as offset", "n", "win", "wid"), [shingle], True
    places = each.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("offset"))
    token = F.coalesce(*[F.when(width == k, _token(words, F.col("offset"), k)) for k in widths])
    shingles = materialise(places.select("win", "wid", "n", "offset", token.alias("token")))
    known = shingles.select("token").distinct()
    counts = _places(docs, widths).select(F.explode(_tokens(F.col("words"), F.col("at"), widths)).alias("token"))
    counts = counts.join(F.broadcast(known) if few else known, "token").groupBy("token").agg(F.count("*").alias("times"))
    # a window with a shingle that no document has occurs in none
    rarest = shingles.join(counts, "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "offset")).alias("rarest"))
    kept = rarest.where("rarest.times > 0").join(each, "wid").select("rarest.token", "rarest.offset", "n", "win", "wid")
    return materialise(kept), widths, few


def _places(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each word of (uid, id, words), and one after the last."""
    return docs.select("*", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row.

    A word is hit if it lies in any place where `window` consecutive words of an item occur; an item of fewer words is one
    window, one of none is nothing. Each window is looked for by its rarest shingle over all documents; what shares it has to
    leave room for the words before and after, and is compared word for word. n_items counts the distinct items with windows
    that occur, items_sha256 hashes their ids, sorted as strings and joined by commas ('' if there are none).
    Null texts have no words. Rows without an id, and repeated rows, stay and are judged like any other; items without an id
    hit words but are not counted; repeated items count once. Other columns are not read; no rows give no rows.
    Windows are broadcast up to `broadcast` of them; beyond that, words meet them in a shuffle, each with its neighbours only.
    """
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    windows = materialise(benchmark_windows(benchmark, item_col, item_text_col, window))
    prefixes, widths, few = _prefixes(rows, windows, shingle, broadcast)

    n, at, last = F.size("words"), F.col("at"), F.col("at") == F.size("words")
    # ids of rows are made and used in one job over one scan
    placed = _places(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "words"), widths)
    own = F.array(F.pmod("uid", F.lit(_SPREAD)) * 2 + 1)
    token = F.explode(F.when(last, own).otherwise(_tokens(F.col("words"), at, widths))) if len(widths) > 1 else F.when(last, own[0]).otherwise(_token(F.col("words"), at, widths[0]))
    first = F.lit(0) if few else F.greatest(at - window, F.lit(0))
    around = F.col("words") if few else F.slice("words", first + 1, 2 * window)
    sought = placed.select("uid", "id", n.alias("n_words"), "at", first.alias("first"), around.alias("around"), token.alias("token"))
    stand_ins = docs.sparkSession.range(_SPREAD).select((F.col("id") * 2 + 1).alias("token"), F.lit(0).alias("offset"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("win"), F.lit(None).cast("long").alias("wid"))
    keys = prefixes.unionByName(stand_ins)
    met = sought.join(F.broadcast(keys) if few else keys, "token").withColumn("start", F.col("at") - F.col("offset"))
    same = F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.col("n")), " ") == F.col("win")
    room = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    met = met.where(F.col("wid").isNull() | F.when(room, same).otherwise(False))
    span = F.when(F.col("wid").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("stop")))
    judged = met.groupBy("uid").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("wid").alias("wids"))
    n_hit = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["reach"]))).alias("hit"), F.greatest(a["reach"], x["stop"]).alias("reach")),
        lambda a: a["hit"],
    )
    judged = materialise(judged.select("uid", "id", "n_words", n_hit.alias("n_hit"), "wids"))

    of = windows.where("item is not null").join(prefixes.select("win", "wid"), "win").select("wid", "item")
    hits = judged.select("uid", F.explode("wids").alias("wid")).join(of, "wid").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = judged.join(hits, "uid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, {words} AS w FROM documents
), i AS (
  SELECT item_id, w, least(len(w), {window}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT *, unnest(range(len(w) - n + 1)) AS s FROM i)
), here AS (
  SELECT uid, s, n, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT uid, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), met AS (
  SELECT h.uid, h.s, h.n, win.item FROM here h JOIN win USING (win, n)
), hit AS (
  SELECT uid, count(DISTINCT s + j) AS n_hit FROM (SELECT uid, s, unnest(range(n)) AS j FROM (SELECT DISTINCT uid, s, n FROM met)) GROUP BY uid
), item AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM met WHERE item IS NOT NULL) GROUP BY uid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN item USING (uid)
"""
