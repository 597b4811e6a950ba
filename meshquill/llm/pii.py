"""PII: pattern spans, and terms whose co-occurrence reveals a protected value.

Patterns find e-mail addresses, IP addresses, payment cards, phone numbers, and
secrets (runs of 24 or more letters, digits, _ and - with four of each of the
first two, so of 96 bits or more): the protected values. Terms (runs of letters and digits) anywhere in a document
that holds a value are its candidates. Over the whole corpus, with N documents,

    IC(v) = log2(N / n(v))        PMI(t; v) = log2(N n(t, v) / (n(t) n(v)))

so PMI / IC is the share of a value's information that a term discloses: 1 for
a term found only with the value. A term at or above ``remove`` is removed, one
at or above ``generalise`` is generalised, in the documents that hold both.
All expressions are built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, stored

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Leftmost matches of the kinds' patterns. Lookarounds and possessive
#: quantifiers only keep the search linear; the matches stay the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
#: Runs of 14 to 19 digits only, so that few matches are placed.
CARD_SIZED = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"
TERM = r"[^\p{L}\p{N}]"
#: Stands for a span when terms are sought.
CUT = "\uffff"
MIN_SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Bytes of candidate terms up to which they are broadcast; beyond, counts are joined.
MAX_BROADCAST = 16 << 20
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the matches, in code points from 0: the
    lengths of matches and of the text between them add up to their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("value")))
    none = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,value:string>>))")

    def step(a, m):
        start = a["at"] + m["gap"]
        return F.struct((start + F.char_length(m["value"])).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), m["value"].alias("value")))).alias("out"))

    return F.aggregate(both, none, step, lambda a: a["out"])


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")
    value = F.transform(each, lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(text: Column, k: int, likely: Column, pattern: str, valid) -> Column:
    good = F.filter(placed(text, pattern), lambda s: valid(s["value"]))
    spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), (s["start"] + F.char_length(s["value"])).alias("end"), s["value"].alias("value")))
    return F.when(likely, spans).otherwise(F.array().cast(SPAN))


def secret_spans(text: Column) -> Column:
    mixed = lambda m: m.rlike("(?:[0-9][^0-9]*){4}") & m.rlike("(?:[A-Za-z][^A-Za-z]*){4}")
    return _spans(text, KINDS.index("secret"), text.rlike("[A-Za-z0-9_-]{24}"), SECRET, mixed)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the first four kinds' matches, sorted."""
    n_digits = lambda m: F.char_length(digits(m))
    kinds = (
        (F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)),
        (text.rlike("[0-9]\\.[0-9]"), IP, lambda m: F.forall(F.split(m, "\\."), lambda p: p.cast("double") <= 255)),
        (text.rlike("[0-9][0-9 -]{12}"), CARD_SIZED, lambda m: luhn(digits(m))),
        (F.contains(text, F.lit("+")), PHONE, lambda m: n_digits(m).between(10, 15)),
    )

    return F.sort_array(F.concat(*[_spans(text, k, *kind) for k, kind in enumerate(kinds)]))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _value(s: Column) -> Column:
    """A span's protected value, as it is counted."""
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"].isin(1, KINDS.index("secret")), s["value"]).otherwise(digits(s["value"])))


def _terms(text: Column, spans: Column) -> Column:
    """Distinct candidate terms of the whole text; what touches a span is part of it."""

    def step(a, s):
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).otherwise(F.lit("")), F.lit(CUT)).alias("out"))

    rest = F.aggregate(spans, F.expr("named_struct('at', 0, 'out', '')"), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    rest = F.regexp_replace(rest, f"(?:\\G|(?<![\\p{{L}}\\p{{N}}]))[\\p{{L}}\\p{{N}}]*+(?:{CUT}[\\p{{L}}\\p{{N}}]*+)++", " ")
    return F.filter(F.array_distinct(F.split(F.lower(rest), TERM + "+")), lambda t: t.rlike("^(?=.*\\p{L}).{3,}$"))


def _places(text: Column, spans: Column, terms: Column) -> Column:
    """Spans of every occurrence of the terms that touches no other span."""
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])(?:"), F.array_join(terms, "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    found = F.transform(placed(text, pattern), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), (s["start"] + F.char_length(s["value"])).alias("end"), F.lower(s["value"]).alias("value")))
    return F.filter(found, lambda t: F.array_contains(terms, t["value"]) & ~F.exists(spans, lambda o: (o["start"] <= t["end"]) & (t["start"] <= o["end"])))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``doc_id, text_key, base, spans, removed`` of every whole text: spans of
    the first four kinds; all spans, with secrets and the disclosing terms (kind
    ``term``, value the term); the terms to remove (the others are generalised).
    A term counts from ``min_support`` common documents on: any term of a single
    document would disclose its values fully.

    Null and empty texts have no span. Repeated documents each give a row and
    count as documents of the corpus. Null ids are kept. Places are code
    points, ends exclusive. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # terms are only sought in documents with a span, so most rows cost a few scans
    found = own.withColumn("base", base_spans(F.col("text"))).withColumn("held", F.sort_array(F.concat("base", secret_spans(F.col("text")))))
    # and only their texts are kept for the places
    terms, kept = (F.when(F.size("held") > 0, c) for c in (_terms(F.col("text"), F.col("held")), F.col("text")))
    found = stored(found.select("doc_id", F.xxhash64("text").alias("text_key"), "base", "held", terms.alias("terms"), kept.alias("text")), "pii")
    n = found.count()
    # no pair has more documents than its value, so values short of support make none
    held_in = found.filter("size(held) > 0").select("doc_id", "text_key", F.explode(F.array_distinct(F.transform("held", _value))).alias("value"))
    by_value = stored(held_in.groupBy("value").agg(F.count("*").alias("n_value")).filter(F.col("n_value") >= min_support), "values")
    values = held_in.join(by_value, "value", "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_set("value").alias("values"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    holds = stored(found.filter("size(terms) > 0").join(values, same).select("doc_id", "text_key", "held", "terms", "values", "text"), "holds")
    both = holds.select("doc_id", "text_key", "values", F.explode("terms").alias("term")).select("doc_id", "text_key", "term", F.explode("values").alias("value"))
    pairs = both.groupBy("term", "value").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= min_support)
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select("term").distinct(), "wanted")
    words = own.select(F.explode(F.array_distinct(F.split(F.lower("text"), TERM + "+"))).alias("term"))
    if (wanted.agg(F.sum(F.octet_length("term") + 32).alias("n")).first()["n"] or 0) <= MAX_BROADCAST:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    by_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    shared = pairs.join(by_term, "term").join(by_value, "value")
    pmi = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_term") * F.col("n_value")))
    ic = F.log2(F.lit(float(n)) / F.col("n_value"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    told = stored(shared.withColumn("share", share).filter(F.col("share") >= generalise).select("term", "value", "share"), "told")
    told_in = both.join(told, ["term", "value"]).groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_set("term").alias("told"), F.collect_set(F.when(F.col("share") >= remove, F.col("term"))).alias("removed"))
    marked = holds.join(told_in, same).select("_d", "_k", _places(F.col("text"), F.col("held"), F.col("told")).alias("extra"), "removed").dropDuplicates(["_d", "_k"])
    out = found.select("doc_id", "text_key", "base", "held").join(marked, same, "left")
    return out.select("doc_id", "text_key", "base", F.sort_array(F.concat("held", F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))


def count_kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of find_spans applied to their texts: a value or a
    generalised term becomes its kind in angle brackets, a removed term goes.
    Where spans overlap, the first by start and kind wins."""
    d, k, spans, removed = fresh(docs, "d", "k", "spans", "removed")
    f = found.filter("size(spans) > 0").select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("spans").alias(spans), F.col("removed").alias(removed)).dropDuplicates([d, k])
    text, names = docs[text_col], F.array(*map(F.lit, KINDS))
    joined = docs.join(f, docs[id_col].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(k)), "left")

    def step(a, s):
        tag = F.when((s["kind"] == KINDS.index("term")) & F.array_contains(removed, s["value"]), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(F.get(names, s["kind"])), F.lit(">")))
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), tag).alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(a)

    done = F.aggregate(spans, F.expr("named_struct('at', 0, 'out', '')"), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return joined.withColumn(text_col, F.coalesce(F.when(F.col(spans).isNotNull(), done), text)).select(*docs.columns)
