"""The stages, each on what the one before it kept, against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from marlspike.llm import jaccard_join, pii
from tests.llm.test_llm import ODD, _check_packing, _groups
from tests.oracle import SF


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """What each stage gets and gives, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(outputs):
    given, known, lines, unique, masked, packed = outputs
    assert all(x.columns == given.columns for x in (known, lines, unique, masked))
    assert known.count() >= 0.99 * given.count()
    before, after = _texts(known), _texts(lines)
    docs_of = defaultdict(set)
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
    for i, t in before.items():
        for x in t.split("\n"):
            docs_of[key(x)].add(i)
    assert after == {i: "\n".join(x for x in t.split("\n") if not key(x) or len(docs_of[key(x)]) < 10) for i, t in before.items()}
    groups = _groups(after, jaccard_join.Similarity())
    assert _texts(unique) == {i: t for i, t in after.items() if groups[i][1] == i}
    assert _texts(masked) == {i: pii.masked(t, pii.find(t)) for i, t in _texts(unique).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())
    rows = packed.collect()
    _check_packing(rows)
    assert {r["doc_id"] for r in rows} == set(_texts(masked))


def test_odd_documents(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (docs, docs.where("false")):
        given = docs
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert docs.columns == given.columns
                assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        rows = docs.collect()
        kept = Counter(r["doc_id"] for r in before.collect())
        # texts without a letter aren't in a known language; of 3 and 4, equal texts, the smaller id stays
        assert set(kept) == ({3, 5, 6, 8, None} if given.count() else set())
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == kept and all(0 < r["length"] <= 4096 for r in rows)
