"""The corpus operators against brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from marlspike.llm import embedding_dedup, exact_dedup, html_extraction, jaccard_join, language_id, line_dedup, packing, pii, queries, repeats, segmentation
from tests.oracle import SF, rows_of, sql_rows

ODD = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, "word " * 30_000), (5, "word " * 30_000), (6, "a b c d e f g"), (None, "a b c d e f g"), (7, " \t\n"), (8, "a\x00b é 日本\r\nz")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == sql_rows(queries.SQL[name])


# 1 ----------------------------------------------------------------------------------------------


def test_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = language_id.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 5


def test_language_odd(spark, odd, none):
    labelled = spark.createDataFrame([(i, "the thing is here and there", "en") for i in range(20)] + [(20 + i, "der Hund und das Haus", "de") for i in range(20)] + [(99, None, "en"), (98, "x", None)], f"{DOCS}, lang string")
    model = language_id.fit(labelled)
    got = language_id.identify(odd.withColumnRenamed("doc_id", "n"), model).collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not r["text"] or not re.search(r"[^\W\d_]", r["text"]))
    assert model.labels == ["de", "en"] and language_id.identify(none, model).count() == 0
    assert language_id.predict_texts(["the thing and there", "der Hund"], model)[0][0] == "en"
    nothing = language_id.fit(labelled.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.identify(odd.selectExpr("*", "1 AS score"), model)


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 230 // 26) * 3}{chr(97 + i % 26) * 2} {chr(97 + i % 230 % 26) * 4}", f"l{i % 230:03}") for i in range(459)]
    labelled = spark.createDataFrame(rows, f"{DOCS}, lang string")
    for most_rows in (60_000, 100):
        model = language_id.fit(labelled, language_id.Settings(epochs=1, most_rows=most_rows))
        assert model.labels == [f"l{k:03}" for k in range(230)]


def _bag(text):
    counts = np.zeros(1 << language_id.BITS)
    for bucket, _ in language_id.subwords([text]):
        counts += np.bincount(bucket, minlength=1 << language_id.BITS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / counts.sum()


def test_numerals_are_no_letters(spark):
    labelled = spark.createDataFrame([(i, "the thing is here", "en") for i in range(12)], f"{DOCS}, lang string")
    assert [language_id.predict_texts([t], language_id.fit(labelled))[0][0] for t in ("²½ 12", "² a", "日")] == ["und", "en", "en"]


def test_windows_lose_no_subword():
    text = "ab" * 40 + "7" + "é" * 50 + " " + "xyz" * 30
    counts = lambda pieces: sum((Counter(b.tolist()) for p in pieces for b, _ in language_id.subwords([p])), Counter())
    assert counts(language_id._windows(text, 20)) == counts([text]) and len(language_id._windows(text, 20)) > 2


def test_rows_of_one_id_are_sampled_apart(spark):
    rows = spark.createDataFrame([(None, f"word{i} is here", "en") for i in range(3000)], f"{DOCS}, lang string")
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000 < 0.1).count()
    assert 200 < taken < 400 and language_id.fit(rows).labels == ["en"]


def test_rejection(spark):
    """Letters out of order, and a language that wasn't learned, go; held-out rows and passages of the learned ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if language_id.has_letter(r["text"])]
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    model = language_id.fit(docs.where(~language_id._fold()))
    share = lambda texts, m: sum(x[2] for x in language_id.predict_texts(texts, m)) / len(texts)
    assert share([r["text"] for r in held], model) <= 0.01 and share([r["text"][:120] for r in held], model) <= 0.02
    assert share([language_id.shuffled(r["text"]) for r in held], model) >= 0.97
    assert share(["asdf qwer zxcv uiop hjkl", "Příliš žluťoučký kůň úpěl ďábelské ódy a pak se vrátil domů.", "это предложение"], model) == 1
    without = language_id.fit(docs.where(~language_id._fold() & (F.col("lang") != "de")))
    assert share([r["text"] for r in held if r["lang"] == "de"], without) >= 0.8
    assert share([r["text"] for r in held if r["lang"] != "de"], without) <= 0.02


# 2 ----------------------------------------------------------------------------------------------


def test_exact_dedup_odd(spark, odd, none):
    copies = spark.createDataFrame([(i, "hot") for i in range(10, 400)] + [(i, f"t{i % 7}") for i in range(400, 470)], DOCS)
    rows = odd.unionByName(copies).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    wanted = sorted((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g if i is not None)
    for counters in (2, 1024):
        got = exact_dedup.exact_dedup(odd.unionByName(copies), counters=counters).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is not None) == wanted
        assert len(got) == len(rows) and any(r["heavy"] for r in got)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_misra_gries_bound(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, bytearray([1]) if rng.random() < 0.3 else bytearray(rng.randbytes(3))) for i in range(3000)], "doc_id long, digest binary").repartition(5)
    got = exact_dedup.exact_groups(rows, counters=8)
    hot = [r for r in got.collect() if bytes(r["digest"]) == b"\x01"]
    assert all(r["heavy"] and r["group_size"] == len(hot) for r in hot)


# 3 ----------------------------------------------------------------------------------------------


def _check_packing(rows, capacity=packing.CAPACITY):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_ids_of_texts_with_combining_marks():
    """The tokenizer composes before it lower-cases: the order matters where a mark's lower case composes otherwise."""
    from tokenizers import Tokenizer

    from marlspike.llm.tokens import word_encoder

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, encoder, rng = Tokenizer.from_file(path), word_encoder(path), random.Random(11)
    letters = [*"aAeEoOiIuUnNsSyY", *"ΑΕΗΙΟΥΩαιΣσßİıÅé", "日", " ", "."]
    marks = [chr(c) for c in (0x300, 0x301, 0x303, 0x304, 0x307, 0x308, 0x30A, 0x313, 0x314, 0x323, 0x327, 0x342, 0x345)]
    texts = ["Α\u0345\u0301", "A\u030a", "İ", "ΑΣ"]
    texts += ["".join(rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 6))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(docs, public_tokenizers.path(packing.TOKENIZER)).collect()
    n = _check_packing(rows)
    total = sum(r["length"] for r in rows)
    assert n <= total / packing.CAPACITY * 1.02 + 1
    pieces = defaultdict(dict)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert b"".join(x for _, x in sorted(pieces[i].items())) == ids


def test_packing_odd(odd, none):
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.pack(odd, path).collect()
    _check_packing(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in ODD)
    assert next(r for r in rows if r["doc_id"] == 1)["length"] == 1
    assert packing.pack(none, path).count() == 0


def _agrees_with_tokenizer(texts):
    from tokenizers import Tokenizer

    from marlspike.llm import tokens

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, words = Tokenizer.from_file(path), tokens.WordEncoder(path, 500_000)
    wrong = [t for t in texts if np.frombuffer(words.encode(t), dtype="<u2").tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_ids_after_a_letter():
    _agrees_with_tokenizer([t for c in map(chr, range(0x250)) for t in (f"km{c}", f"km{c}b", f"km{c}.", f"{c}km")])


def test_ids_of_special_tokens():
    own = ["<|endoftext|>", "<|startoftext|>"]
    _agrees_with_tokenizer([f(s) for s in [*own, *map(str.upper, own)] for f in ("a {} b".format, "A{}B".format, "\n{0}{0}.\tX²{0}É".format, "{} <|EndOfText|>ΑΣ <|".format)])


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan(histogram):
    rows = packing.plan(histogram, 30)
    used, filled = Counter(), Counter()
    for k, (length, first, sequence, uses, _) in enumerate(rows):
        after = [r for r in rows[k + 1 :] if r[0] == length]
        n = (after[0][1] if after else histogram[length]) - first
        used[length] += n
        for j in range(n):
            filled[sequence + j // uses] += length
    assert all(used[x] == n for x, n in histogram.items() if x < 30) and all(v <= 30 for v in filled.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(0, 40))
def test_fullest(items, free):
    counts = np.bincount(items, minlength=41)
    uses = packing.fullest(free, sorted(set(items)), counts)
    best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= free)
    assert sum(x * n for x, n in uses.items()) == best and all(counts[x] >= n for x, n in uses.items())


# 4 ----------------------------------------------------------------------------------------------


def _links(vectors, t=0.9):
    ids = [i for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for i, v in vectors if i in set(ids)], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= t, 1)), strict=True)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + rng.standard_normal(24) * 0.25 * (i % 3)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300, rows[5][1]), (301, None), (302, [0.0] * 24), (303, [float("nan")] * 24), (304, [1.0, None]), (305, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block, miss=1e-6).collect()}
    ids, links = _links(rows[:241])
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for a, b in links:
        n[a] += 1
        n[b] += 1
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert len(links) > 300
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], find(i), find(i) == i) for i in parent}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    codes = embedding_dedup.Codes.of(10_000)
    r = embedding_dedup.rotations(48, codes)
    x = rng.standard_normal((400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.93 * x + 0.3 * rng.standard_normal((400, 48)) / 7
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turned = x @ r.rows[: r.used].T * r.scale
    c = np.abs(turned).sum(1) / np.sqrt(r.used)
    estimate = ((y @ r.rows[: r.used].T * r.scale) * np.sign(turned)).sum(1) / np.sqrt(r.used) / c
    true = (x * y).sum(1)
    assert abs((estimate - true).mean()) < 0.01
    slack = codes.eps * np.sqrt(1 - true**2) * np.sqrt(1 - c**2) / c / np.sqrt(r.used - 1)
    assert (np.abs(estimate - true) < slack).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_with_shipped_settings(spark, block):
    """Recall of what users get, on near copies at all distances from the threshold; nothing below it is linked."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    t = rng.uniform(0.85, 0.99, (400, 1))
    both = np.concatenate([x, t * x + np.sqrt(1 - t * t) * y]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(both)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()}
    n = Counter(i for pair in _links(rows)[1] for i in pair)
    assert all(got[i] <= n[i] for i in got) and sum(got.values()) >= 0.995 * sum(n.values()) > 400


def test_rounded_vectors_are_within_their_loss():
    x = np.random.default_rng(3).standard_normal((50, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    steps, step = embedding_dedup._steps(x)
    assert (np.abs(x - steps * step[:, None]) <= step[:, None] * 0.5000001).all()


def test_embeddings_of_one_id_and_of_other_columns(spark):
    """Different vectors of one id are one node; columns beside vec_id and embedding play no part, whatever their names."""
    rows = [(1, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [1.0, 0.01], 7), (3, [0.01, 1.0], 7), (4, [-1.0, 0.0], 7)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_embeddings_odd(spark):
    schema = "vec_id long, embedding array<double>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1e300, 2e300])], schema)).collect()
    assert sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


# 5 ----------------------------------------------------------------------------------------------


def _shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def _groups(texts, s):
    sets = {i: _shingles(t, s.words) for i, t in texts.items()}
    parent, at = {i: i for i in texts}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(texts):
        common = Counter(j for x in sets[i] for j in at[x])
        for x in sets[i]:
            at[x].append(i)
        for j, n in common.items():
            if s.den * n >= s.num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("s", [jaccard_join.Similarity(4, 85, 100), jaccard_join.Similarity(5, 80, 100), jaccard_join.Similarity(3, 60, 100, block=3)])
def test_jaccard(spark, texts, s):
    rng = random.Random(9)
    more = dict(texts)
    for k in range(120):  # edited copies at and around the threshold, of long and of very short texts
        words = (texts[rng.choice(list(texts))] or "").split()[: rng.choice((3, 6, 9, 40, 400))]
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        more[10_000 + k] = " ".join(words)
    got = jaccard_join.similar_groups(spark.createDataFrame(list(more.items()), DOCS), s).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _groups(more, s)


def test_signatures_meet():
    """Sets within the threshold share a signature, whatever their sizes."""
    from marlspike.llm.shingles import mix

    s, rng = jaccard_join.Similarity(4, 85, 100), np.random.default_rng(5)
    for size in [*range(1, 40), 100, 333, 1000, 5000]:
        base = np.unique(mix(rng.integers(0, 2**63, size, dtype=np.uint64)))
        drop = (len(base) * 15) // 100
        other = np.sort(rng.permutation(base)[: len(base) - drop])
        flat, own = np.concatenate([base, other]), np.repeat([0, 1], [len(base), len(other)])
        sig, who = jaccard_join.signatures(flat, own, np.array([len(base), len(other)]), s)
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_jaccard_odd(odd, none):
    got = jaccard_join.similar_groups(odd).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert next(r for r in got if r["doc_id"] is None)["component_id"] is None
    assert jaccard_join.similar_groups(none).count() == 0


# 6 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "wanted"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>\n c<p>d</article><footer>f</footer>", "T\na b c\nd"),
    ("<article><p>x<aside>side</aside><div class='comments'><p>c</div><form>f</form><script>s</script><p>y", "x\ny"),
    ("<header>h</header><main><p>m&nbsp;n</p></main><div id=sidebar>s</div>", "m n"),
    ("<article><p>1 < 2 &lt;b&gt;</p><!-- <p>no</p> --><style>p{}</style></article>", "1 < 2 <b>"),
    ("<p>one<div class='ad'>buy</div><p>two<br>lines", "one\ntwo lines"), ("<article><p hidden>h</p><p>v</p></article", "v"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<article></article>", ""), ("<title>t</title><script>never closed", ""),
])
def test_main_text(html, wanted):
    assert html_extraction.main_text(html) == wanted


def test_style_tree_cuts_what_pages_share(spark):
    page = lambda i: f"<div class=top><p>Our shop. Best prices.</p></div><div class=text><p>Story {i} told here.</p><p>Part two of {i}.</p></div><div class=bottom><p>All rights kept.</p></div>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(50, "http://b.example/1", page(50)), (51, None, None), (51, None, None)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 told here.\nPart two of 3." and "Our shop" in got[50] and got[51] == ""


def test_articles_of_a_templated_host_stay(spark):
    page = lambda i: f"<html><body><div class=wrap><nav>Menu</nav><div class=box><article><h1>Story {i}</h1><p>Told of {i}.</p></article></div><footer>All rights kept.</footer></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\nTold of {i}." for i in range(12)}


def test_style_tree_decides_beside_and_inside_articles(spark):
    page = lambda i: f"<body><div class=box><p>Our shop.</p></div><main><h1>Head {i}</h1><article><p>Story {i}.</p><div class=extra><p>Read us daily.</p></div></article></main><div class=long><p>More of {i}.</p></div></body>"
    same = "<article><h1>Terms</h1><div class=part><p>One for all.</p></div></article>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(20 + i, f"http://b.example/{i}", same) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nStory {i}.\nMore of {i}." for i in range(12)} | {20 + i: "Terms\nOne for all." for i in range(12)}


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("n", [2, 5, 7, 40])
def test_shared_text_goes_on_hosts_of_any_size(spark, n):
    """From five pages on; two near copies of a page can't be told from furniture and stay."""
    page = lambda i: f"<div class=top><p>Our shop.</p></div><p>Story {i}.</p>"
    got = html_extraction.extract(spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(n)], PAGES)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Our shop.\nStory {i}." if n < 5 else f"Story {i}." for i in range(n)}


def test_pages_all_alike_stay(spark):
    got = html_extraction.extract(spark.createDataFrame([(i, f"http://a.example/{i}", "<div><p>One</p><p>text</p></div>") for i in range(20)], PAGES)).collect()
    assert {r["text"] for r in got} == {"One\ntext"}


def test_main_text_beside_articles_and_in_sentences():
    text = html_extraction.main_text
    assert text("<article>teaser one</article><main><p>The real story</p></main>") == "teaser one\nThe real story"
    assert text("<main>Head <article class=card>card</article> tail</main>") == "Head\ncard\ntail"
    assert text("<p>See <a class=social>our site</a> now.</p><p><a class=share>Tweet</a></p><p>a<i hidden>b</i>c</p>") == "See our site now.\nac"


def test_pages_odd(spark, none):
    deep = "<div>a" * 10_000 + "</div>" * 10_000
    rows = [(1, "http://x.example/1", deep), (1, "http://x.example/1", deep), (2, None, "<p>" + "word " * 200_000), (None, "::", "<p>n"), (3, "http://x.example/2", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", host string, low int")
    got = html_extraction.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    texts_ = Counter((r["page_id"], r["text"][:3], len(r["text"])) for r in got.collect())
    assert texts_ == Counter({(1, "a\na", 19_999): 2, (2, "wor", 999_999): 1, (None, "n", 1): 1, (3, "", 0): 1})
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_importance_against_brute_force(spark):
    from math import log

    rng = random.Random(4)
    rows = []
    for host, m in (("a", 1), ("a2", 2), ("b", 9)):
        for page in range(m):
            for path in (1, 2):
                rows.append((host, page, path, None, rng.randrange(3), None))
                rows += [(host, page, path, None, None, t) for t in {rng.randrange(4) for _ in range(3)}]
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in html_extraction.importance(spark.createDataFrame(rows, html_extraction._FEATURES)).collect()}
    for (host, path), (n, value) in got.items():
        styles = Counter(r[4] for r in rows if r[0] == host and r[2] == path and r[4] is not None)
        told = Counter(r[5] for r in rows if r[0] == host and r[2] == path and r[5] is not None)
        m = sum(styles.values())
        layout = -sum(c / m * log(c / m) for c in styles.values()) / log(m) if m > 1 else 1.0
        content = sum(1 - log(k) / log(m) for k in told.values()) / len(told) if m > 1 else 1.0
        g = html_extraction.DECAY ** len(styles)
        assert n == m and value == pytest.approx((m * ((1 - g) * layout + g * content) + html_extraction.PRIOR) / (m + html_extraction.PRIOR))


def test_pages(spark):
    import html as h

    got = {r["page_id"]: r for r in html_extraction.op6_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        wanted = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == wanted and got[r["page_id"]]["n_chars"] == len(wanted)


# 7 ----------------------------------------------------------------------------------------------


def _covered(rows, length):
    seen, out = {}, []
    for key, text in sorted(rows):
        cov = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if seen.setdefault(w, (key, i)) != (key, i):
                cov[i : i + length] = True
        out.append((key, bytes(np.frombuffer(text, dtype=np.uint8)[~cov])))
    return dict(out)


def test_repeats(spark, texts):
    rows = {i: (t or "") for i, t in texts.items()}
    rows |= {9001: "ab" * 400, 9002: "x" * 99, 9003: "x" * 100, 9004: "x" * 100, 9005: "", 9006: ("é" * 300) + rows[3][:200]}
    got = repeats.remove_repeats(spark.createDataFrame(list(rows.items()), DOCS)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == _covered([(i, t.encode()) for i, t in rows.items()], 100)


def test_repeats_long_text_in_segments(spark):
    rng = random.Random(3)
    body = "".join(rng.choices("abcdefgh ", k=1700))
    texts = [(1, body), (2, "zz" + body[300:1500] + "yy" + body[300:450]), (3, body[::-1] + body[100:260])]
    assert len(list(repeats._segments([1, 2, 3], [t.encode() for _, t in texts], 100, 500))) > 4
    got = repeats.remove_repeats(spark.createDataFrame(texts, DOCS), segment=500).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == _covered([(i, t.encode()) for i, t in texts], 100)


def test_repeats_odd(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and repeats.remove_repeats(none).count() == 0
    long = [r for r in got if r["doc_id"] == 5]
    assert len({bytes(r["kept"]) for r in long}) == 1 and bytes(long[0]["kept"]) == _covered([(5, ("word " * 30_000).encode())], 100)[5]


# 8 ----------------------------------------------------------------------------------------------


def test_a_line_of_every_document_is_spread(spark):
    """Dropped occurrences go by their documents, so no range gets more than its share of one line's rows."""
    n, ranges = 2000, 8
    rows = spark.createDataFrame([(i, f"the same line\nonly here {i}") for i in range(n)], DOCS).coalesce(1)
    keyed = line_dedup._keyed(rows).select(F.col("__doc").alias("doc"), F.col("__text_hash").alias("text_hash"), "text")
    dealt = keyed.mapInArrow(line_dedup._digests(10, 1, False, ranges), line_dedup._SCHEMA)
    counts = Counter({r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()})
    assert sum(counts.values()) >= 3 * n and max(counts.values()) < 2 * sum(counts.values()) / ranges
    got = line_dedup.drop_lines(rows, line_dedup.keep_bitmaps(rows))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(i, f"only here {i}") for i in range(n)}


def test_lines_keep_first(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["A ", " a", "b", "", "c" * rng.randint(1, 3)]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for first in (False, True):
        got = {r["doc_id"]: r for r in line_dedup.drop_lines(df, line_dedup.keep_bitmaps(df, 10, keep_first=first)).collect()}
        key = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
        docs_of = defaultdict(set)
        for i, t in rows:
            for x in t.split("\n"):
                docs_of[key(x)].add(i)
        met = set()
        for i, t in rows:
            kept = []
            for x in t.split("\n"):
                common = key(x) and len(docs_of[key(x)]) >= 10
                if not common or (first and key(x) not in met):
                    kept.append(x)
                met.add(key(x))
            assert got[i]["text"] == "\n".join(kept) and got[i]["n_dropped"] == t.count("\n") + 1 - len(kept)


def test_lines_odd(odd, none):
    clashing = odd.selectExpr("*", "1 AS kept", "2 AS digest", "3 AS range")
    got = line_dedup.drop_lines(clashing, line_dedup.keep_bitmaps(clashing, 2)).collect()
    assert len(got) == len(ODD) and all(r["kept"] == 1 for r in got)
    assert {r["doc_id"]: r["text"] for r in got}[3] == "" and line_dedup.keep_bitmaps(none).count() == 0
    packed = line_dedup.bitmap(20, [0, 19])
    assert line_dedup.unpack(packed, 20).tolist() == [0, *[1] * 18, 0]
    clash = odd.selectExpr("*", "1 AS n_lines")
    with pytest.raises(ValueError):
        line_dedup.drop_lines(clash, line_dedup.keep_bitmaps(clash))


# 9 ----------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def _base(text):
    found = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if _holds(k, m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@1-+ 2()5%_é", max_size=50))
def test_pii_base(text):
    assert pii.listed([s for s in pii.find(text) if s[0] in pii.BASE]) == _base(text)


def test_pii_query(spark, texts):
    for r in pii.op9_pii(spark, SF).collect():
        base = _base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k) for x in base.split(",")) for k in pii.BASE]


def test_pii_more_kinds():
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"] and kinds("DE88370400440532013000") == []
    assert kinds("his SSN: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("password=7602ad27cf5550de1c st") == ["secret"]
    near = next(s for s in pii.find("call my phone +1 (456) 555-2186") if s[0] == "phone")
    far = next(s for s in pii.find("it is +1 (456) 555-2186") if s[0] == "phone")
    assert near[3] > far[3]
    assert pii.masked("to a@b.de, x", pii.find("to a@b.de, x")) == "to [EMAIL], x"


@pytest.mark.parametrize("n", [12, 128, 129, 5000])
def test_long_secrets_are_masked_whole(n):
    text = f"token={'k7' * n}"[: 6 + n] + " end"
    assert pii.masked(text, pii.find(text)) == "token=[SECRET] end"


def test_pii_is_linear_and_odd(odd, none):
    assert pii.find("1" * 200_000) == [] and pii.find("a" * 200_000 + "@") == [] and pii.find("1." * 100_000) == pii.find("1." * 100_000)
    out = pii.pii_spans(odd.selectExpr("*", "7 AS pii"), spans_as="found", masked_as="text").collect()
    assert len(out) == len(ODD) and all(r["pii"] == 7 for r in out) and pii.pii_spans(none).count() == 0
    with pytest.raises(ValueError):
        pii.pii_spans(odd.selectExpr("*", "7 AS pii"))


# 10 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def model():
    return segmentation.pieces(public_tokenizers.path(segmentation.MODEL))


def _all_scores(model, text, n):
    flat, out = segmentation.BLANK + text.replace(" ", segmentation.BLANK), []

    def go(i, score):
        if i == len(flat):
            out.append(score)
            return
        for j in range(i + 1, min(len(flat), i + model.longest) + 1):
            found = model.score.get(flat[i:j])
            if found:
                go(j, score + found[1])
            elif j == i + 1:
                go(j, score + model.unknown * len(flat[i].encode()))

    go(0, 0.0)
    return sorted(out, reverse=True)[:n]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abthe .é1\n²日!", min_size=1, max_size=8))
def test_nbest_against_all_segmentations(model, text):
    ids, listed = next(model.encode([text], 5))
    assert [s for s, _ in listed] == _all_scores(model, text, 5)
    each = [model.changed(ids, c) for _, c in listed]
    assert len(set(each)) == len(each) and all(model.decode(x) == text for x in each) and each[0] == ids


def test_round_trip(spark, texts, odd, none):
    path = public_tokenizers.path(segmentation.MODEL)
    for r in segmentation.op10_sentencepiece_nbest(spark, SF).collect():
        assert r["decoded_sha256"] == segmentation.text_digest(texts[r["doc_id"]]) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    back = segmentation.decode(segmentation.encode(odd, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in ODD)
    assert segmentation.encode(none, path).count() == 0
    with pytest.raises(ValueError):
        segmentation.encode(odd.selectExpr("*", "1 AS ids"), path)


def test_ties_end_soon(model):
    assert len(model.nbest("a" * 5000, 4)) == 4
