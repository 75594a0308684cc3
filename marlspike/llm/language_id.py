"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the bag of its hashed subwords, byte n-grams of lower-cased letter runs with one mark at a
word's edge. Its vector is the mean of their embeddings and a linear softmax reads the language from
it, without a bias, so that a text of unknown subwords scores all languages alike. Embeddings and weights are trained together by stochastic gradient descent in numpy, one document
a step, on a bounded sample of labelled rows: ``rows_per_label`` rows of each label on average, taken
by a hash of id and text. For prediction each subword's embedding is multiplied by the weights beforehand,
so a text's logits are the mean of table rows, summed over the whole text in slices.

Part of the sample is held back from training, and a temperature is fitted to it. Rejection has a model
of its own: a logistic regression on how sure the softmax is, the share of a text's subwords that
training met, the evidence of each subword for the label, and length. It learns held-back rows, short
passages of them and two of them joined (documents in two languages are to stay) from the same texts with
their letters shuffled and from rows of labels that another fit left out, and is calibrated on the
former: a text goes where it holds it ``reject_odds`` times as likely to be of the latter, and the threshold
is lower still if more than ``reject_share`` of the held-back rows and of two joined would go.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices

ORDERS = (2, 3, 4, 5)
BITS = 16
LETTER = re.compile(r"[^\W\d_]")  # and numerals such as ² and ½, which isalpha() tells apart
#: A character that no subword goes across.
BREAK = re.compile(r"[\x00-@\[-`{-\x7f]")
UNKNOWN = "und"

_PRIME, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Settings:
    rows_per_label: int = 300
    most_rows: int = 30_000
    dims: int = 16
    epochs: int = 6
    rate: float = 0.4
    held_back: float = 0.3
    reject_share: float = 0.002
    reject_odds: float = 4.0  # how many times as likely a text must be a bad one
    left_out: int = 2  # labels that are left out of a fit each, those of most rows
    passage: int = 120  # characters of a short passage
    seed: int = 7


@dataclass
class Rejection:
    """A logistic regression on standardised features of a text; what is below ``threshold`` is rejected."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def margin(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.spread @ self.weights[1:] + self.weights[0]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # a row for each subword bucket: logits, temperature included, and whether training met it
    rejection: Rejection | None = None


#: Kinds of rows that tasks make of a sampled text: to learn from or held back, and of held-back ones a passage and both with shuffled letters.
LEARN, HELD, PASSAGE, SHUFFLED, SHUFFLED_PASSAGE = range(5)


def subwords(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) arrays, a pair for each n-gram order, over the whole texts."""
    blobs = [(t or "").lower().encode() for t in texts]
    flat = _LETTERS[np.frombuffer(b" ".join([*blobs, b""]) or b" ", dtype=np.uint8)]
    ends = np.cumsum([len(b) + 1 for b in blobs])
    letter = flat != 0x20
    hashed, inner = flat.astype(np.uint32), None
    for n in range(2, max(ORDERS) + 1):
        size = len(flat) - n + 1
        if size <= 0:
            return
        hashed = hashed[:size] * _PRIME ^ flat[n - 1 :]
        if n == 2:
            valid = letter[:-1] | letter[1:]
        else:
            inner = letter[1 : 1 + size] if inner is None else inner[:size] & letter[n - 2 : n - 2 + size]
            valid = inner
        if n in ORDERS:
            at = np.flatnonzero(valid)
            bucket = (hashed[at] * _MIX ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _PRIME >> np.uint32(32 - BITS)
            yield bucket, np.searchsorted(ends, at, side="right")


def _sums(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows and number of subwords for each text."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for bucket, owner in subwords(texts):
        n = np.bincount(owner, minlength=len(texts))
        count += n
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            total[some] += np.add.reduceat(weights[bucket], starts, axis=0, dtype=np.float64)
    return total, count


def _windows(text: str, most: int = 500_000) -> list[str]:
    """Slices of a very long text; a slice goes on to the next character that ends a run of letters, so no subword is lost."""
    out, at = [], 0
    while at < len(text):
        found = BREAK.search(text, at + most)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


def logits(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the table's rows over a text's subwords, how many subwords it has) of each text."""
    total, count = np.zeros((len(texts), model.table.shape[1])), np.zeros(len(texts), dtype=np.int64)
    short = [i for i, t in enumerate(texts) if len(t or "") <= 500_000]
    total[short], count[short] = _sums([texts[i] for i in short], model.table)
    for i in set(range(len(texts))) - set(short):
        for piece in _windows(texts[i]):
            part, n = _sums([piece], model.table)
            total[i] += part[0]
            count[i] += n[0]
    return total / np.maximum(count, 1)[:, None], count


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shuffled(text: str) -> str:
    """The text with its letters in an order drawn from a hash of it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, which = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds], dtype=bool)[which]
    out = code.copy()
    out[letter] = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(code[letter])
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def _bag(text: str) -> tuple[bytes, bytes, int] | None:
    """Distinct buckets of a text and their shares, at most 2 ** BITS, and the number of its subwords."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for piece in _windows(text):
        for bucket, _ in subwords([piece]):
            counts += np.bincount(bucket, minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return (ids.astype("<u2").tobytes(), (counts[ids] / counts.sum()).astype("<f4").tobytes(), int(counts.sum())) if len(ids) else None


def _bags(settings: Settings):
    """Sampled rows as (label, kind, distinct buckets, shares, number of subwords)."""

    def kinds(text: str) -> Iterator[tuple[int, str]]:
        mark = zlib.crc32(text.encode("utf-8", "replace"))
        if mark % 1000 >= 1000 * settings.held_back:
            yield LEARN, text
            return
        start = mark // 1000 % max(1, len(text) - settings.passage)
        passage = text[start : start + settings.passage]
        yield from ((HELD, text), (PASSAGE, passage), (SHUFFLED, shuffled(text)), (SHUFFLED_PASSAGE, shuffled(passage)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(label, kind, *bag) for kind, own in kinds(text) if (bag := _bag(own))]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["lang", "kind", "ids", "weights", "n"])

    return run


@dataclass(frozen=True)
class Bag:
    label: str
    kind: int
    ids: np.ndarray
    shares: np.ndarray
    n: int


def train(rows: list[Bag], labels: list[str], settings: Settings) -> np.ndarray:
    """The table, without temperature, of a model of these labels: stochastic gradient descent, one row a step."""
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, settings.dims)) / settings.dims
    weights = np.zeros((settings.dims, len(labels)))
    met = np.zeros(1 << BITS, dtype=bool)
    steps, step = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            ids, w = rows[i].ids, rows[i].shares
            rate = settings.rate * (1 - step / steps)
            step += 1
            met[ids] = True
            mean = w @ vectors[ids]
            slope = softmax((mean @ weights)[None])[0]
            slope[number[rows[i].label]] -= 1
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            vectors[ids] -= (rate * 20) * np.outer(w, back)
    return np.concatenate([(vectors @ weights) * met[:, None], met[:, None]], axis=1)  # subwords never met say nothing


def features(means: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of texts with these means of table rows: odds of the best label, share of subwords met, evidence a subword, length."""
    odds = softmax(means[:, :-1]).max(axis=1)
    odds = np.log(np.clip(odds, 1e-6, 1 - 1e-6) / np.clip(1 - odds, 1e-6, 1))
    return np.stack([odds, means[:, -1], means[:, :-1].max(axis=1), np.log1p(n)], axis=1)


def _means(bags: list[Bag], table: np.ndarray) -> np.ndarray:
    return np.array([b.shares @ table[b.ids] for b in bags]).reshape(-1, table.shape[1])


def _features(bags: list[Bag], table: np.ndarray) -> np.ndarray:
    return features(_means(bags, table), np.array([b.n for b in bags]))


def _mixed(bags: list[Bag], table: np.ndarray, seed: int) -> np.ndarray:
    """Features of each text joined to one drawn from all: documents in two languages are good ones too."""
    means, n = _means(bags, table), np.array([b.n for b in bags], dtype=np.float64)
    other = np.random.default_rng(seed).permutation(len(bags))
    total = n + n[other]
    return features((means * n[:, None] + means[other] * n[other, None]) / total[:, None], total)


def fit_rejection(good: np.ndarray, bad: np.ndarray, whole: np.ndarray, share: float, odds: float, rounds: int = 50) -> Rejection:
    """Fits features of good and bad texts, both kinds of equal weight, and a threshold that at most ``share`` of ``whole`` are below."""
    x = np.concatenate([good, bad])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1)
    y = np.repeat([1.0, 0.0], [len(good), len(bad)])
    each = np.repeat([0.5 / len(good), 0.5 / len(bad)], [len(good), len(bad)]) * len(x)
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton's steps, with a ridge that keeps separable kinds finite
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (each * (p - y)) + weights
        curve = (z * (each * p * (1 - p))[:, None]).T @ z + np.eye(z.shape[1])
        move = np.linalg.solve(curve, slope)
        weights -= move
        if np.abs(move).max() < 1e-8:
            break
    out = Rejection(mean, spread, weights)
    out.threshold = min(-float(np.log(odds)), float(np.quantile(out.margin(whole), share, method="lower")))
    return out


def fit_bags(rows: list[Bag], settings: Settings) -> Model:
    """The model of bags of all kinds. Labels with nothing to learn from but held-back rows learn from these, and these aren't held back."""
    labels = sorted({r.label for r in rows})
    taught = {r.label for r in rows if r.kind == LEARN}
    learn = [r for r in rows if r.kind == LEARN or (r.kind == HELD and r.label not in taught)]
    held = [r for r in rows if r.kind == HELD and r.label in taught]
    table = train(learn, labels, settings)
    checked = held or learn
    raw = _means(checked, table)[:, :-1]
    number = {x: i for i, x in enumerate(labels)}
    truth = np.array([number[r.label] for r in checked], dtype=int)

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    t = min(np.geomspace(0.05, 20, 60), key=loss)
    table[:, :-1] /= t
    good = held + [r for r in rows if r.kind == PASSAGE and r.label in taught]
    bad = [_features([r for r in rows if r.kind in (SHUFFLED, SHUFFLED_PASSAGE) and r.label in taught], table)]
    sizes = Counter(r.label for r in learn)
    for label in sorted(taught, key=lambda x: (-sizes[x], x))[: settings.left_out if len(taught) > 2 else 0]:
        without = train([r for r in learn if r.label != label], [x for x in labels if x != label], settings)
        without[:, :-1] /= t
        bad.append(_features([r for r in rows if r.label == label and r.kind in (HELD, PASSAGE)], without))
    bad = np.concatenate(bad)
    if not held or not len(bad):
        return Model(labels, table.astype(np.float32))
    mixed = np.concatenate([_mixed(held, table, settings.seed), _mixed(good, table, settings.seed + 1)])
    whole = np.concatenate([_features(held, table), mixed[: len(held)]])
    rejection = fit_rejection(np.concatenate([_features(good, table), mixed]), bad, whole, settings.reject_share, settings.reject_odds)
    return Model(labels, table.astype(np.float32), rejection)


def fit(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Fits a model to rows (doc_id, text, lang); null labels and texts are left out.

    Of each label about ``rows_per_label`` rows are taken, chosen by a hash of doc_id and text, or fewer where all
    labels together would have more than ``most_rows``, but the rows of least hash always, so that every
    label stays. The driver gets a bag for each, and four for a held-back one: at most 2 ** BITS entries of
    six bytes, and no more than the text has subwords, so by the default settings some 57,000 bags of
    ordinary texts. Without any labelled row the model has no label and predicts UNKNOWN; without a
    held-back one it rejects nothing that has letters.
    """
    settings = settings or Settings()
    labelled = bounded(labelled).where("lang is not null and text is not null")
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(drawn).alias("least")).orderBy("lang").collect()
    if not counts:
        return Model([], np.zeros((1 << BITS, 1), dtype=np.float32))
    n = min(settings.rows_per_label, settings.most_rows / len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(min(1.0, n / r["count"]), r["least"] + 5e-7))])
    bags = labelled.where(drawn < share[F.col("lang")]).select("lang", "text").mapInArrow(_bags(settings), "lang string, kind int, ids binary, weights binary, n long")
    rows = [Bag(r["lang"], r["kind"], np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(np.float64), r["n"]) for r in bags.collect()]
    rows.sort(key=lambda r: (r.label, r.kind, len(r.ids), r.ids.tobytes(), r.shares.tobytes()))
    if not rows:
        return Model([], np.zeros((1 << BITS, 1), dtype=np.float32))
    return fit_bags(rows, settings)


def predict_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) of each text."""
    if not model.labels:
        return [(UNKNOWN, 0.0, True)] * len(texts)
    means, n = logits(texts, model)
    chances = softmax(means[:, :-1])
    low = model.rejection.margin(features(means, n)) < model.rejection.threshold if model.rejection else np.zeros(len(texts), dtype=bool)
    out = []
    for text, p, rejected in zip(texts, chances, low, strict=True):
        if not has_letter(text):
            out.append((UNKNOWN, 0.0, True))
        else:
            k = int(p.argmax())
            out.append((model.labels[k], float(p[k]), bool(rejected)))
    return out


def _predict(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, column, 1_000_000):
                part = batch.slice(lo, hi - lo)
                rows = predict_texts(part.column(column).to_pylist(), model.value)
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, rejected for each row's whole text.

    A text that is null or has no letter gets UNKNOWN, score 0 and is rejected. Ties go to the
    alphabetically first label. Repeated rows get equal results; an empty table gives no rows. A column
    already named as an output is an error.
    """
    clash = {"lang_pred", "score", "rejected"} & set(docs.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    model = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of a number for each label
    return bounded(docs).mapInArrow(_predict(model, column), f"{schema}, lang_pred string, score double, rejected boolean")


def _fold(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(~_fold()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", _fold().alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the language model, fitted to the stage's own labelled rows, doesn't reject."""
    model = fit(docs.select("doc_id", "text", "lang"))
    kept = identify(docs, model).where("not rejected")
    return kept.drop("lang_pred", "score", "rejected").select(*docs.columns)


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
