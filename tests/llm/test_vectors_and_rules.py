"""Whitening, quality rules and hard negatives against brute force, and on odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from marlspike.llm import hard_negatives, quality_rules, whitening
from tests.oracle import SF

NAN, INF = float("nan"), float("inf")
ODD = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [-0.5, 0.25]), (8, [0.1, -7.0])]
VECTORS = "vec_id long, embedding array<double>"


# whitening --------------------------------------------------------------------------------------


def brute_whitening(rows, components=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, w, explained = brute_whitening(rows)
    got = whitening.op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    at = {r["vec_id"]: i for i, (r) in enumerate({"vec_id": v} for v, _ in rows)}
    found = np.zeros((n, 8))
    for r in got:
        found[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-4)
    signs = np.sign((found * w).sum(axis=0))
    assert np.abs(found * signs - w).max() < 1e-6
    centred = found - found.mean(axis=0)
    assert np.abs(centred.T @ centred / n - np.eye(8)).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, VECTORS).withColumn("component", F.lit("mine"))
    got = whitening.whiten(df).collect()
    kept = [(i, v) for i, v in ODD if v is not None and len(v) == 2 and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, _, _ = brute_whitening(kept, 2)
    assert sorted((r["vec_id"] or 0, r["component"], int(r["deviation"])) for r in got) == sorted((i or 0, c, d) for (i, _), d in zip(kept, deviation) for c in (1, 2))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 2")).count() == 0


def test_whitening_where_nothing_varies(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)).collect()
    assert len(one) == 6 and {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one} == {(None, None, None, 0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], VECTORS)).collect()
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True} and flat[0]["identity_error"] < 1e-9


def test_whitening_is_exact_beyond_64_bits_and_refuses_what_is_not(spark):
    big = [(i, [float(i * 2**20), -float(i)]) for i in range(50)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(big, VECTORS)).collect()}
    assert got == dict(zip(range(50), brute_whitening(big, 2)[1])) and max(got.values()) > 2**63
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [0.0, 0.0])], VECTORS))


# quality rules ----------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_fit(text, settings=quality_rules.Settings()):
    """chars per token, chars per piece, byte share and entropy, word by word without memo or arrays."""
    known = quality_rules.Vocabularies(settings)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    pieces = [p for w in words for p in known.pieces.encode(w)]
    ids = [t for w in words for t in known.bytes.encode_ordinary(" " + w)]
    chars, n = sum(map(len, words)), len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) / math.log2(min(max(n, 2), 1024))
    return chars / n, chars / len(pieces), sum(known.pieces.is_byte(p) for p in pieces) / len(pieces), entropy, n


def brute_kept(rows):
    """Verdicts by quartiles of sorted lists, for rows (doc_id, text, lang)."""
    s, found = quality_rules.Settings(), {}
    for i, text, lang in rows:
        base = brute_base(text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        found[i] = (lang, base[0], failed, brute_fit(text) if base[0] else None)
    groups = {}
    for lang, n_words, _, fit in found.values():
        if n_words >= 10:
            groups.setdefault(lang, set()).add((fit[4], *[round(x, 3) for x in fit[:4]]))
    out = {}
    for i, (lang, n_words, failed, fit) in found.items():
        if not failed:
            kinds = groups[lang]
            slack = (1 + math.sqrt(s.settled_tokens / fit[4])) * (1 + s.settled_docs / len(kinds))
            for k, (width, least, low, high) in enumerate([(s.chars_width, None, 1, 1), (s.chars_width, None, 1, 1), (s.bytes_width, s.least_bytes, 0, 1), (s.entropy_width, None, 1, 0)]):
                q1, q3 = np.quantile([t[k + 1] for t in kinds], [0.25, 0.75])
                room = max(q3 - q1, q3 * s.least_spread if least is None else least) * width * slack
                failed |= bool(low and fit[k] < q1 - room or high and fit[k] > q3 + room)
        out[i] = not failed
    return out


def test_quality_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in quality_rules.op12_quality_rules(spark, SF).collect()}
    kept = brute_kept(rows)
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r, base = got[i], brute_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r["kept"] == kept[i], i
        if base[0]:
            assert [r["chars_per_token"], r["chars_per_piece"], r["byte_share"], r["entropy"]] == pytest.approx(brute_fit(text)[:4])


def test_quality_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_rules.op12_quality_rules(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in got if labels[r["doc_id"]] == (1, 0)]
    assert sum(good) / len(good) > 0.99


def test_base_counts_of_random_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "#", "é", "\x85", "\xa0", "日"]) for _ in range(rng.randrange(120))) for _ in range(300)] + [None, "", " \n "]
    found = quality_rules.measures(texts)
    for i, t in enumerate(texts):
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_base(t)


def test_scripts():
    assert [quality_rules.script(t) for t in ("été 12", "ab где", "12 !", "", "日本 x")] == ["LATIN", "CYRILLIC", "none", "none", "CJK"]


def test_quality_of_odd_texts(spark):
    long = " ".join(f"word{i} of text" for i in range(60_000))
    odd = [(1, None, "en"), (2, "", None), (3, "short", None), (None, " \t\n", "en"), (4, long, None), (4, long, None), (5, "x" * 300_000 + " a b c d e f g h i j", "xx"), (6, "日本語 " * 12, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("n_words", F.lit("mine"))
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(odd) and all(r["n_words"] == "mine" for r in got)
    by = {r["doc_id"]: r["rules"] for r in got}
    assert by[1]["base_failed"] and not by[1]["kept"] and by[1]["entropy"] is None and by[4]["kept"] and by[4]["n_words"] == 180_000
    assert by[6]["band"] == "script:CJK" and by[6]["base_failed"] and by[5]["n_words"] == 11
    assert quality_rules.quality_rules(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality_rules.quality_rules(df, rules_as="lang")


def test_copies_count_once_in_bands(spark):
    """A third of the rows being copies of one odd document must not narrow the band of all others."""
    rows = [(r["doc_id"], r["text"], "en") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").collect()]
    alone = {r["doc_id"]: r["rules"]["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    many = rows + [(10_000 + i, rows[0][1], "en") for i in range(len(rows))]
    beside = {r["doc_id"]: r["rules"]["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(many, "doc_id long, text string, lang string")).collect()}
    assert all(beside[i] == kept for i, kept in alone.items())


# hard negatives ---------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=5, lower=80, upper=100):
    rows = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, x in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z)), j, w) for j, w, z in rows if len(z) == len(x))
        for s, j, _ in [t for t in scored if t[2] == y and t[1] != i][:positives]:
            fit = [t for t in scored if t[2] != y and lower * -s <= 100 * -t[0] <= upper * -s][:negatives]
            out += [(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label long, embedding array<double>"


def test_negatives_agree_with_brute_force_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    for given in ({}, {"positives": 2, "negatives": 3, "lower": 50, "upper": 90}):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **given)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0, **given)


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.25]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5]), (4, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (5, 2, None), (6, 2, []), (7, 2, [1.0, None]), (8, 2, [NAN, 1.0]), (9, 2, [1.0, 0.5, 0.25]), (10, 1, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_scores_are_exact_or_refused():
    big = np.array([[2**30, 2**30 - 1]])
    assert hard_negatives.scores(big, big)[0, 0] == 2**60 + (2**30 - 1) ** 2
    with pytest.raises(OverflowError):
        hard_negatives.scores(big * 4, big)


def test_negatives_in_a_hot_group(spark):
    """A third of all rows alike: results are those of brute force, with ties by id."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [1.0, 0.5, 0.25] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 50 == 0)
