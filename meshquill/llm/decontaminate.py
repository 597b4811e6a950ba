"""Benchmark decontamination by a distributed positional inverted index.

1. Every token of every training document is stored as a posting: term, row of
   the document, position. Segments follow the documents' own partitions, so
   nothing is shuffled, no term is left out, and the index serves any benchmark.
   A last posting per document, of the empty term, holds its id and length.
2. The index gives the frequencies of the benchmark's terms. Each window of
   ``window`` item words is sought through its rarest terms.
3. Phrases: the rarest term's positions, less its place in the item, are offsets
   at which the item may stand. They are intersected with the list of the second
   rarest term, moved in the same way, and then with those of all terms of the
   windows around. Runs as long as a window are hits.
4. Proximity: positions of the rarest term with the second rarest one nearby are
   intersected with the lists of all terms of the window; a match is a span of
   ``near`` words that holds every distinct term, in any order.

All expressions are built in.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, HIT_SHARE, NEAR = 13, 20, 20
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes of rows up to which a table is broadcast; beyond, it is shuffled.
MAX_BROADCAST = 24 << 20


def tokens(text: Column) -> Column:
    """A-Z lower-cased; runs of 0-9, a-z and characters beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if the bytes of its rows show that it is small."""
    size = F.lit(32)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    held = df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if held <= MAX_BROADCAST else df


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings of all tokens: row, pos, term, and doc_id where the
    term is empty: the posting after the last token of each document."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.concat(tokens(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    posted = own.select("row", "id", F.posexplode("w").alias("pos", "term"))
    return stored(posted.select("row", "pos", "term", F.when(F.col("term") == "", F.col("id")).alias("doc_id")), "postings")


def bench_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, w) of the distinct items that have words; null ids are left out."""
    return benchmark.select(F.col(id_col).cast("string").alias("item_id"), tokens(F.col(text_col)).alias("w")).filter("item_id is not null and size(w) > 0").distinct()


def item_windows(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored windows of the items: wid, item_id, size, w, start, terms, and
    ranked: the window's places as (n, term, p), rarest term first."""
    places = items.select("item_id", "w", F.posexplode("w").alias("p", "term"))
    vocabulary = _small(stored(places.select("term").distinct(), "terms"))
    frequency = stored(index.select("term").join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n")), "frequency")
    n = F.size("w")
    first, last = F.greatest(F.col("p") - (window - 1), F.lit(0)), F.greatest(F.least(F.col("p"), n - window), F.lit(0))
    ranked = places.join(frequency, "term", "left").withColumn("start", F.explode(F.sequence(first, last)))
    out = ranked.groupBy("item_id", "w", "start").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "p"))).alias("ranked"))
    terms = F.array_sort(F.array_distinct(F.transform("ranked", lambda x: x["term"])))
    return stored(out.select(F.monotonically_increasing_id().alias("wid"), "item_id", F.least(F.lit(window), n).alias("size"), "w", "start", terms.alias("terms"), "ranked"), "windows")


def _of_rows(index: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of the documents that found names."""
    return index.join(_small(stored(found.select("row").distinct(), "rows")), "row", "left_semi").select("row", "pos", "term")


def search_phrases(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item_id, start, end): maximal exact matches that hold a whole
    window of the item; end exclusive."""
    second = F.col("ranked")[F.least(F.lit(1), F.col("size") - 1)]
    pairs = windows.select("item_id", "size", "w", F.col("ranked")[0].alias("a"), second.alias("b")).distinct()
    pairs = stored(pairs.select("item_id", "size", "w", F.col("a.term").alias("t1"), F.col("a.p").alias("p1"), F.col("b.term").alias("t2"), F.col("b.p").alias("p2")), "pairs")
    probe = _small(stored(pairs.select(F.col("t1").alias("term")).union(pairs.select("t2")).distinct(), "probe"))
    lists = stored(index.select("row", "term", "pos").join(probe, "term"), "lists")
    small = _small(pairs.drop("w"))
    at = lists.join(small, F.col("term") == F.col("t1")).select("row", "item_id", "size", "p1", (F.col("pos") - F.col("p1")).alias("shift"), F.col("t2").alias("term"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos"))
    both = stored(at.join(lists, ["row", "term", "pos"]).select("row", "item_id", "size", "p1", "shift").distinct(), "both")
    # what the windows around the rarest place ask for, against the documents' lists
    places = pairs.select("item_id", "size", "p1", "w").distinct()
    low, high = F.greatest(F.col("p1") - F.col("size") + 1, F.lit(0)), F.least(F.col("p1") + F.col("size"), F.size("w")) - 1
    places = places.select("item_id", "size", "p1", F.explode(F.transform(F.sequence(low, high), lambda p: F.struct(p.alias("p"), F.col("w")[p].alias("term")))).alias("x")).select("item_id", "size", "p1", "x.p", "x.term")
    wanted = both.join(_small(stored(places, "places")), ["item_id", "size", "p1"]).select("row", "item_id", "size", "shift", "p", "term", (F.col("shift") + F.col("p")).alias("pos")).distinct()
    met = wanted.join(_of_rows(index, both), ["row", "pos", "term"])
    held = met.groupBy("row", "item_id", "size", "shift").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    runs = held.select("row", "item_id", "size", "shift", F.posexplode("ps").alias("i", "p")).groupBy("row", "item_id", "size", "shift", (F.col("p") - F.col("i")).alias("run")).agg(F.min("p").alias("p"), F.count("*").cast("int").alias("n"))
    return runs.filter(F.col("n") >= F.col("size")).select("row", "item_id", (F.col("shift") + F.col("p")).alias("start"), (F.col("shift") + F.col("p") + F.col("n")).alias("end"))


def search_near(index: DataFrame, windows: DataFrame, near: int = NEAR) -> DataFrame:
    """(row, item_id) of the documents and items of which a span of ``near``
    document words holds all distinct terms of a window."""
    best = F.transform(F.array_sort(F.transform(F.col("terms"), lambda t: F.struct(F.filter("ranked", lambda x: x["term"] == t)[0]["n"].alias("n"), t.alias("t")))), lambda x: x["t"])
    own = windows.filter(F.size("terms") <= near).select("wid", "item_id", "terms", best.alias("best"))
    own = stored(own.select("wid", "item_id", "terms", F.col("best")[0].alias("t1"), F.col("best")[F.least(F.lit(1), F.size("best") - 1)].alias("t2")), "sought")
    probe = _small(stored(own.select(F.col("t1").alias("term")).union(own.select("t2")).distinct(), "probe"))
    lists = stored(index.select("row", "term", "pos").join(probe, "term"), "lists")
    cell = lambda c: F.floor(c / near).cast("int")
    around = lambda df: df.withColumn("cell", F.explode(F.sequence(cell(F.col("pos")) - 1, cell(F.col("pos")) + 1)))
    couples = _small(stored(own.select("t1", "t2").distinct(), "couples"))
    first = lists.join(couples, F.col("term") == F.col("t1")).select("row", "t1", "t2", F.col("pos").alias("at"), cell(F.col("pos")).alias("cell"))
    close = first.join(around(lists).withColumnRenamed("term", "t2"), ["row", "t2", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) < near).select("row", "t1", "t2", "at").distinct()
    close = stored(close, "close")
    kinds = _small(stored(own.select("wid", "t1", "t2", F.size("terms").alias("m"), F.explode("terms").alias("term")), "kinds"))
    asked = close.join(kinds, ["t1", "t2"]).select("row", "wid", "m", "at", "term", cell(F.col("at")).alias("cell"))
    met = asked.join(around(_of_rows(index, close)), ["row", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) < near)
    spans = met.groupBy("row", "wid", "m", "at").agg(F.collect_list(F.struct("pos", "term")).alias("h"), F.size(F.collect_set("term")).alias("k")).filter(F.col("k") == F.col("m"))
    full = F.exists("h", lambda a: F.size(F.array_distinct(F.transform(F.filter("h", lambda x: (x["pos"] >= a["pos"]) & (x["pos"] < a["pos"] + near)), lambda x: x["term"]))) == F.col("m"))
    return spans.filter(full).select("row", "wid").distinct().join(_small(stored(own.select("wid", "item_id"), "owners")), "wid").select("row", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", hit_share: int = HIT_SHARE, near: int = NEAR) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, hits, contaminated,
    n_near_items, near_items`` of every whole text: words inside an occurrence
    of a benchmark window, the items that occur (ids as sorted strings), the
    merged matches, whether n_hit > 0 and hit_share * n_hit >= n_words, and the
    items with a proximity match (none are sought if near is 0).

    An item of fewer than ``window`` words is one window; one without words,
    with a null text or a null id is ignored, and items with the same words
    all count. Null and empty texts have no words and are clean. Repeated
    documents, and null ids, each give a row. Without items all is clean.
    Other columns are ignored, whatever their names.
    """
    index = build_index(docs, id_col, text_col)
    windows = item_windows(index, stored(bench_items(benchmark, item_col, "text"), "items"), window)
    nothing = {"doc_id": "long", "n_words": "long", "hit": "struct<start:int,end:int>", "item_id": "string", "near_id": "string"}
    row = lambda df, **c: df.select("row", *[c.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in nothing.items()])
    parts = row(index.filter("term = ''"), doc_id=F.col("doc_id"), n_words=F.col("pos"))
    parts = parts.unionByName(row(search_phrases(index, windows), hit=F.struct("start", "end"), item_id=F.col("item_id")))
    if near:
        parts = parts.unionByName(row(search_near(index, windows, near), near_id=F.col("item_id")))
    per = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set("near_id")).alias("near_items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))).cast("long")
    out = per.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sort_array("hits").alias("hits"), F.size("near_items").cast("long").alias("n_near_items"), "near_items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words")))
