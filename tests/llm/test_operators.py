"""Operators against plain forms, on a table with all odd cases at once:
nulls, empty and long texts, ties, repeated rows, clashing columns."""

import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from meshquill.llm import decontaminate, graycode, langid_ecoc, license_scan, mixing, pii, quality_knn, quality_rules, simhash, substring_dedup, token_dac  # noqa: E402

RNG = random.Random(11)
VOCABULARY = ["the", "of", "and", "to", "a", "in", "Éa", "über", "niño"] + ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE, ITEM = prose(40), prose(30)
TEXTS = [prose(120), f"{prose(60)}\n{PASSAGE} {prose(30)}", f"{PASSAGE}\t{prose(70)}", None, "", " \n ", "word", ITEM.upper() + " " + prose(20), prose(4000), f"{prose(900)} {ITEM} {prose(10)}", "x y z " * 60, "same line\nsame line\nother | line ### $$$", "Mail a.b@c-d.example.com or +1 (555) 123-4567, 10.0.0.255; 4111 1111 1111 1111!", "a@b.c_d@e.f 1.2.3.4.5 300.1.1.1 é@x.y", "tab\t\ttab  two   three\n\n  four"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(20, TEXTS[0]), (21, TEXTS[0] + " more"), (20, TEXTS[0]), (None, TEXTS[2]), (22, PASSAGE), (23, prose(200) + " " + "-" * 300)]
CLASHES = "w row chunk score q _q kept gone _gone d _d k _k n _n spans removed held base tie pos term h fp root".split()
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, None if i % 5 == 0 else "en", None, *CLASHES) for i, (d, t) in enumerate(ROWS)], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i not in (10, 11)), int(i == 12)) for i in range(24)] + [(1, None, None), (None, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


def test_substring(docs, none):
    got = substring_dedup.dedup_substrings(docs, chunk_bytes=4000).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == key(brute.substring(ROWS))
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_gray_index():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12), dtype=np.uint64)
    values = np.unique(np.concatenate([seeds, (seeds[:, None] ^ flips).ravel(), np.zeros(1, np.uint64)]))
    index = graycode.GrayIndex(values)
    pairs = {(int(a), int(b)) for i, j in index.pairs(2, block=7, max_frontier=64) for a, b in zip(i, j)}
    v = index.values
    assert pairs == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2}
    root = graycode.components(len(v), index.pairs(2))
    assert root.tolist() == brute.classes([int(x) for x in v])
    assert graycode.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_lose_nothing(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    values = sorted({int(b) for b in base} | {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 60, (15, 2))})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r["fp"]: r["root"] for r in simhash.join_stars(simhash.links(fps, hot=hot, per_bucket=20)).collect()}
    classes = brute.classes([v & (2**64 - 1) for v in values])
    groups = {}
    for v, c in zip(values, classes):
        groups.setdefault(c, set()).add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash(docs, none):
    got = key((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [brute.fingerprint(t) for _, t in ROWS]
    classes = brute.classes(fps)
    low = {}
    for (d, _), c in zip(ROWS, classes):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    assert got == key((d, f"{f:016x}", low.get(c)) for (d, _), f, c in zip(ROWS, fps, classes))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None} | set(low.values())
    assert simhash.near_duplicates(none).count() == 0


def test_quality_rules(docs, none, labels):
    got = quality_rules.apply_rules(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert key((r["doc_id"], *(r[n] for n in names)) for r in got) == key((d, *brute.base_counts(t)) for d, t in ROWS)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    kept = quality_rules.apply_rules(docs, labels, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert {r["score"] for r in quality_rules.apply_rules(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_rules.apply_rules(none, labels).count() == 0


def test_quality_scores_are_the_mean_log_ratios(docs, labels):
    ratios = quality_rules.log_ratios(docs, labels)
    bins = docs.select("doc_id", quality_rules.words_col(F.col("text")).alias("v")).select("doc_id", quality_rules.ngram_bins(F.col("v")).alias("b")).collect()
    score = {}
    for r in bins:
        score.setdefault(r["doc_id"], []).append(sum(ratios[j] for j in r["b"]) / max(1, len(r["b"])))
    counts = np.zeros(quality_rules.BINS)
    for r in bins:
        np.add.at(counts, r["b"], 1)
    good = np.zeros(quality_rules.BINS)
    trusted = {i for i in range(24) if i not in (10, 11) and zlib.crc32(str(i).encode()) % 5}
    for r in bins:
        if r["doc_id"] in trusted:
            np.add.at(good, r["b"], 1)
    common = (counts + 1) / (counts.sum() + len(counts))
    expected = np.log((good + quality_rules.LEAN * common) / (good.sum() + quality_rules.LEAN)) - np.log(common)
    assert np.allclose(ratios, expected)
    for r in quality_rules.apply_rules(docs, labels).collect():
        assert min(abs(r["score"] - s) for s in score[r["doc_id"]]) < 1e-9


def test_contamination(spark, docs, none):
    items = [(1, ITEM), (2, ITEM), (3, "word"), (4, None), (5, "!!"), (None, PASSAGE), (10, PASSAGE + " tail words here"), (10, PASSAGE + " tail words here"), (6, "x y z " * 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = key((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == key(brute.contamination(ROWS, [i for i in items if i[0] is not None]))
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def test_proximity(spark):
    """Against all spans of 20 words, with terms from a small vocabulary."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 13, 25])))) for i in range(12)]
    shuffled = items[3][1].split()
    rng.shuffle(shuffled)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 60, 400])))) for i in range(30)] + [(50, " ".join(shuffled)), (51, " y ".join(shuffled)), (52, items[5][1]), (52, None)]
    own, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t in rows:
        w, found = (t or "").split(), set()
        spans = [set(w[a : a + 20]) for a in range(len(w))]
        for item, text in items:
            x = text.split()
            n = min(13, len(x))
            if any(set(x[s : s + n]) <= span for s in range(len(x) - n + 1) for span in spans):
                found.add(str(item))
        expected.append((d, tuple(sorted(found))))
    got = [(r["doc_id"], tuple(r["near_items"])) for r in decontaminate.contamination(own, bench).collect()]
    assert sorted(got) == sorted(expected)


def test_pii(spark, docs, none):
    got = key((r["doc_id"], r["s"]) for r in pii.find_spans(docs).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect())
    assert got == key((d, brute.pii(t)) for d, t in ROWS)
    assert pii.find_spans(none).count() == 0
    rows = [(i, f"write to zorblax at me{i % 2}@x.org now please") for i in range(4)] + [(i, "write to someone now please") for i in range(4, 30)]
    own = spark.createDataFrame([(i, t.replace("zorblax", "zorblax" if i % 2 == 0 else "quuxly")) for i, t in rows], "doc_id long, text string")
    found = pii.find_spans(own).cache()
    spans = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert spans[0] == "term:9:16,email:20:29" and spans[4] == ""
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(own, found).collect()}
    secret = spark.createDataFrame([(1, 'key = "0f3a9c0f3a9c0f3a9c0f3a9c0f"; ' + "a" * 60), (2, "-" * 90 + "1" * 40)], "doc_id long, text string")
    assert [r["text"] for r in pii.sanitise(secret, pii.find_spans(secret)).orderBy("doc_id").collect()] == ['key = "<SECRET>"; ' + "a" * 60, "-" * 90 + "1" * 40]
    assert texts[0] == "write to  at <EMAIL> now please" and texts[5] == rows[5][1]


def test_pii_terms_by_counting(spark):
    """Terms against plain counts, with null ids, repeated rows and values of one document."""
    deal = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdk" for b in ("ora", "ume", "ilo") for c in ("n", "st", "ple")]
    texts = []
    for i in range(60):
        v = deal.choice([f"me{deal.randrange(6)}@x.org", f"one{i}@y.net", ""])
        own = [f"trait{v[2]}"] if v.startswith("me") and deal.random() < 0.8 else []
        texts.append(" ".join([*deal.sample(words, 6), *own, v, deal.choice(words), f"rare{i}"]))
    rows = [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)]
    rows += rows[:7] * 2
    emails = [set(re.findall(r"\S+@\S+", t)) for _, t in rows]
    whole = [set(re.split("[^a-z0-9]+", t)) for _, t in rows]
    terms = [{w for w in t.split() if "@" not in w} for _, t in rows]
    told = set()
    for v in set().union(*emails):
        for t in set().union(*(w for w, e in zip(terms, emails) if v in e)):
            n_v, n_t = sum(v in e for e in emails), sum(t in w for w in whole)
            n_both = sum(v in e and t in w for e, w in zip(emails, terms))
            if n_both >= 2 and math.log2(len(rows) * n_both / (n_t * n_v)) >= 0.8 * math.log2(len(rows) / n_v):
                told.add((t, v))
    want = []
    for (d, t), e in zip(rows, emails):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"\S+@\S+", t)]
        found += [(m.start(), 5, m.end()) for m in re.finditer("[a-z0-9@.]+", t) if any((m[0], v) in told for v in e)]
        want.append((d, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["s"]) for r in pii.find_spans(df).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()]
    assert told and sorted(map(str, got)) == sorted(map(str, want))


def test_long_runs_do_not_break_patterns(spark):
    texts = ["1 " * 30000, "a." * 20000 + "@b" + ".c" * 20000, "x" * 100000 + "@", "+" * 1000 + "12345678901", "9" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()}
    assert got == {0: "", 1: "email:0:80002", 2: "", 3: "phone:999:1011", 4: ""}


def test_licenses(spark, docs, none):
    whole = dict(license_scan.TEMPLATES[:6])
    wrapped = "\n".join(" ".join(whole["MIT"].split()[i : i + 9]) for i in range(0, 200, 9))
    changed = whole["ISC"].replace("this software", "the Example program")
    rows = [(1, "intro\nReleased under the MIT License.\nend"), (2, "licensed under the apache license version 2 0"), (3, prose(50)), (4, None), (5, ""), (6, "MIT"), (6, "MIT"), (7, f"{prose(40)}\n{wrapped} {prose(300)}"), (8, f"Copyright 2020 The Example Authors. {changed} {prose(9)}"), (9, f"{whole['MIT']} {prose(50)} Licensed under CC BY-NC 4.0. {whole['MIT']}")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    brief = {d: (r["n_matches"], r["license"]) for d, r in got.items()}
    assert brief == {1: (1, "MIT"), 2: (1, "Apache-2.0"), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None), 7: (1, "MIT"), 8: (1, "ISC"), 9: (3, "MIT")}
    assert got[1]["score"] == got[2]["score"] == got[7]["score"] == 1.0 and 0.8 <= got[8]["score"] < 1 and got[3]["score"] is None
    assert (got[7]["matches"][0]["start"], [m["license"] for m in got[9]["matches"]]) == (len(rows[7][1][: rows[7][1].index("Permission")].split()), ["MIT", "CC-BY-NC-4.0", "MIT"])
    assert license_scan.scan_licenses(docs).count() == len(ROWS)
    assert license_scan.scan_licenses(none).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_license_key_words_lose_nothing(threshold):
    keys = set(license_scan.key_words(license_scan.TEMPLATES, threshold))
    for _, text in license_scan.TEMPLATES:
        grams = license_scan._plain(text)
        free = sum(not set(g.split()) & keys for g in grams)
        assert free < threshold / (2 - threshold) * len(grams)


def test_mixing(spark, docs, none, labels):
    members = spark.createDataFrame([(i, i, 10 + i, [0.9, 0.05, 0.05] if i % 3 else [0.1, 0.8, 0.1]) for i in range(60)], "doc_id long, text_key long, n_tokens long, p array<double>")
    rated, report = mixing.fit_rates(members, {"a": 0.8, "b": 0.1, "c": 0.1}, tokens=2000)
    rows = rated.collect()
    n, p, r = (np.array([x[k] for x in rows]) for k in ("n_tokens", "p", "rate"))
    assert (r >= 0).all() and np.allclose((r * n) @ p, report["got"])
    # plain projected gradient on the same problem comes no nearer
    a = p * n[:, None]
    x, want = np.ones(len(n)), np.array(report["want"])
    metric = np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(3000):
        x = np.maximum(0, x - 0.5 * p @ metric @ (x @ a - want))
    assert np.abs(np.array(report["got"]) - want).max() <= 1.05 * np.abs(x @ a - want).max() + 1e-3
    found = mixing.mix(docs, labels)
    assert found.count() == len(ROWS)
    assert all(abs(sum(v for k, v in r.asDict().items() if k.startswith("p_")) - 1) < 1e-9 for r in found.collect())
    assert mixing.mixed(docs, labels).columns == docs.columns
    assert mixing.mix(none, labels).count() == 0


def test_token_codes(spark, docs, none, tmp_path):
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 300, np.uint32)
    payload = token_dac.dac_encode(ids)
    assert (token_dac.dac_decode(payload) == ids).all()
    assert [token_dac.dac_access(payload, i) for i in range(len(ids))] == ids.tolist()
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"file://{tmp_path}/tokens"
    token_dac.write_tokens(docs, path, out, block_tokens=500)
    got = {}
    for r in token_dac.read_tokens(spark, out).collect():
        got[r["start"]] = (r["doc_id"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    tok, start, flat = Tokenizer.from_file(path), 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[start] == (d, len(own), own)
        start, flat = start + len(own), flat + own
    assert [token_dac.token_at(spark, out, i) for i in (0, 700, len(flat) - 1)] == [flat[0], flat[700], flat[-1]]
    assert token_dac.token_at(spark, out, len(flat)) is None
    token_dac.write_tokens(none, path, f"{out}-none")
    assert token_dac.read_tokens(spark, f"{out}-none").count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    e = token_dac.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", "  a   b\n\n c \n", "<|endoftext|> a <|endoftext|>", "don't  we're x 　y 日本語 🙂🙂 x", "a\x00b \x1c c", "\n", "tab\t x", "É É's 'sa ª²", "a\u0085 b  ", " ".join(["w"] * 500), "x" * 300]
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "'s", "'", "a", "Zq", "é", "7", "½", ".", "$", "中", "я", "\u0301", "🙂", "<|endoftext|>", "\0"]
    odd = [*odd, None, *["".join(rng.choices(marks, k=rng.randint(0, 9))) for _ in range(3000)]]
    ids, counts = e.encode(pa.array(odd * 2, pa.string()))
    want = [e.tok.encode(t or "", add_special_tokens=False).ids for t in odd * 2]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_quality_model(spark, docs, none, labels):
    good = [(i, " ".join(RNG.choice(VOCABULARY) for _ in range(80)).capitalize() + ".", 1) for i in range(300)]
    bad = [(300 + i, " | ".join(RNG.choice(VOCABULARY) + "###" for _ in range(60)), 0) for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    rows = quality_knn.score_quality(df.drop("quality"), df).collect()
    truth = {d: q for d, _, q in good + bad}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and len(held) > 40
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    odd = quality_knn.score_quality(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality_knn.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.score_quality(none, labels).count() == 0


def test_language_model(spark, docs, none):
    syllables = {"aa": ["ka", "to", "ri"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "que", "ier"], "dd": ["ción", "ado", "ll"]}
    rows = [(i, " ".join("".join(RNG.choice(s) for _ in range(3)) for _ in range(40)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "katori", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid_ecoc.identify_language(df).collect()}
    held = [(d, lang) for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d, _ in held)
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    assert [got[d]["lang_pred"] for d in (900, 901)] == ["und", "und"] and got[900]["score"] == 0
    assert {r["lang_pred"] for r in langid_ecoc.identify_language(docs).collect()} == {"en", "und"}
    assert langid_ecoc.identify_language(none).count() == 0
    code = langid_ecoc.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 5


def test_mixing_fits_where_rates_are_clipped(spark):
    rng = np.random.default_rng(4)
    raw = rng.dirichlet([6.0, 0.8, 0.8], 400) ** 0.5
    p = raw / raw.sum(1, keepdims=True)
    members = spark.createDataFrame([(i, i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(rng.integers(20, 900, 400), p))], "doc_id long, text_key long, n_tokens long, p array<double>")
    rated, report = mixing.fit_rates(members, {"a": 0.9, "b": 0.06, "c": 0.04})
    rows = rated.collect()
    n, p, r = (np.array([x[k] for x in rows]) for k in ("n_tokens", "p", "rate"))
    assert (r == 0).any() and np.allclose((r * n) @ p, report["want"], rtol=1e-4) and not report["short"]
    _, report = mixing.fit_rates(members, {"a": 0.01, "b": 0.01, "c": 0.98}, tokens=1e6)
    assert set(report["short"]) and all(abs(w - g - report["short"].get(d, 0)) < 1.1 for d, w, g in zip("abc", report["want"], report["got"]))


def test_mixing_raises_a_domain_below_its_share(spark):
    members = spark.createDataFrame([(i, i, 100, [0.97, 0.01, 0.02] if i % 20 else [0.1, 0.1, 0.8]) for i in range(200)] + [(900, 900, 100, [0.1, 0.8, 0.1])], "doc_id long, text_key long, n_tokens long, p array<double>")
    rated, report = mixing.fit_rates(members, {"a": 0.9, "b": 0.05, "c": 0.05})
    got = np.array(report["got"])
    assert np.allclose(got / got.sum(), [0.9, 0.05, 0.05], atol=1e-4) and rated.agg(F.max("rate")).first()[0] > 1.5
    assert mixing.TARGETS == {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def test_mixing_tells_a_domain_by_a_few_words(spark):
    rude = ["trash", "scum", "moron"]
    rows = []
    for i in range(900):
        own = prose(300).split()
        if i % 9 == 0:
            for w in RNG.sample(rude, 2):
                own.insert(RNG.randrange(len(own)), w)
        rows.append((i, " ".join(own), 1, int(i % 9 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    p = {r["doc_id"]: r["p"] for r in mixing.posteriors(df.drop("quality", "toxic"), df, list(mixing.TARGETS)).collect()}
    assert all((p[i][2] > 0.5) == (i % 9 == 0) for i in held) and any(i % 9 == 0 for i in held)


def test_pii_terms_of_the_whole_text(spark):
    far = "filler words " * 30
    rows = [(i, f"Zorblax {far}me0@x.org {far}zorblax now") for i in range(3)] + [(i, f"{far}now") for i in range(3, 40)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_spans(own).cache()
    places = [(s["start"], s["end"]) for s in found.filter("doc_id = 0").first()["spans"] if s["value"] == "zorblax"]
    assert places == [(0, 7), (rows[0][1].index("zorblax"), rows[0][1].index("zorblax") + 7)]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(own, found).collect()}
    secret = spark.createDataFrame([(1, 'key = "0f3a9c0f3a9c0f3a9c0f3a9c0f"; ' + "a" * 60), (2, "-" * 90 + "1" * 40)], "doc_id long, text string")
    assert [r["text"] for r in pii.sanitise(secret, pii.find_spans(secret)).orderBy("doc_id").collect()] == ['key = "<SECRET>"; ' + "a" * 60, "-" * 90 + "1" * 40]
    assert "zorblax" not in texts[0].lower() and texts[5] == rows[5][1]


def test_clashing_columns_stay(spark, docs, none, labels):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    import corpus_pipeline

    for d in (docs, none):
        for out in (quality_rules.apply_rules(d, labels, keep_columns=True), simhash.keep_one(d), mixing.mixed(d, labels), pii.sanitise(d, pii.find_spans(d))):
            assert out.columns == d.columns and out.count() <= 3 * len(ROWS)
        assert decontaminate.contamination(d, bench).count() == d.count()
    assert corpus_pipeline.STAGES[2][1].__name__ == "drop_contaminated"
