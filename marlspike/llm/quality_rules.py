"""Quality rules from word counts and from how well public vocabularies fit a text.

Tokeniser fertility: each word is encoded as in running text by two public vocabularies, so that white
space has no tokens of its own. Measured per document are characters per token under both (a sentence
piece vocabulary with byte fallback and a byte-level one for many languages), the share of the first
one's tokens that are fallen-back bytes, and the entropy of the second one's tokens over the entropy
that so many tokens can have. A document is rejected where a measure leaves the band of its language;
documents without a language have the band of the script that most of their letters are of.

Bands come from all documents: quartiles over distinct measurements, so that a group of copies counts
once, widened by ``Settings``. Words are encoded once for each worker and slice of rows; everything
else is array arithmetic over a slice.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices
from marlspike.scratch import Scratch

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    """Parameters of the rules. Widths count quartile distances beyond the quartiles."""

    pieces: str = public_tokenizers.path("piece_bpe_32k.model")
    ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    least_words: int = 10
    most_repeated: int = 20  # percent of the words
    window: int = 5
    chars_width: float = 3.0
    entropy_width: float = 0.75
    bytes_width: float = 6.0
    least_spread: float = 0.02  # of the upper quartile
    least_bytes: float = 0.05  # spread of the byte share
    settled_tokens: int = 100  # bands are twice as wide for texts of so many tokens
    settled_docs: int = 20  # and for languages of so many documents
    entropy_tokens: int = 1024  # entropy is held against that of so many equally frequent tokens at most
    word_part: int = 256  # longer words are encoded in parts of so many code points
    memo_words: int = 500_000


_MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "n_tokens": pa.int64(), "chars_per_token": pa.float64(), "chars_per_piece": pa.float64(), "byte_share": pa.float64(), "entropy": pa.float64(), "script": pa.string(),
}
_DDL = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_tokens:long,chars_per_token:double,chars_per_piece:double,byte_share:double,entropy:double,script:string>"


class Vocabularies(dict):
    """Maps a word, as bytes, to (pieces, fallen-back bytes among them, ids of the byte-level vocabulary)."""

    def __init__(self, settings: Settings):
        import sentencepiece
        import tiktoken

        super().__init__()
        self.settings = settings
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=settings.pieces)
        self.fallback = frozenset(i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i))
        with open(settings.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.bytes = tiktoken.Encoding("ranks", pat_str=settings.pattern, mergeable_ranks=ranks, special_tokens={})

    def encoded(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """The entries of all words; those not met before are encoded together."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.settings.memo_words:
            self.clear()
            new = words
        most = self.settings.word_part
        texts = [w.decode() for w in new]
        parts = [[t] if len(t) <= most else [t[i : i + most] for i in range(0, len(t), most)] for t in texts]
        pieces = iter(self.pieces.encode([p for own in parts for p in own], num_threads=1))
        encode, fallen = self.bytes.encode_ordinary, self.fallback
        for word, own in zip(new, parts, strict=True):
            if len(own) == 1:
                ids, got = encode(" " + own[0]), next(pieces)
            else:
                ids = [t for i, p in enumerate(own) for t in encode(p if i else " " + p)]
                got = [t for _ in own for t in next(pieces)]
            self[word] = (len(got), 0 if fallen.isdisjoint(got) else sum(t in fallen for t in got), ids)
        found = [self[w] for w in words]
        for word in new:
            if len(word) > 64:
                del self[word]
        return found


@lru_cache(maxsize=1)
def vocabularies(settings: Settings) -> Vocabularies:
    return Vocabularies(settings)


_ASCII_LETTER = re.compile("[A-Za-z]")


@lru_cache(maxsize=100_000)
def _script(character: str) -> str:
    """The first word of a letter's Unicode name, which is its script's; none for other characters."""
    return unicodedata.name(character, "").split(" ")[0] if character.isalpha() else ""


def script(text: str) -> str:
    """The script that most letters of the text are of, ties by name; ``none`` without letters."""
    if text.isascii():
        return "LATIN" if _ASCII_LETTER.search(text) else "none"
    found: Counter[str] = Counter()
    for character, n in Counter(text).items():
        if name := _script(character):
            found[name] += n
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    codes, kinds = pd.factorize(values)
    return codes.astype(np.int64), len(kinds)


def _repeated(codes: np.ndarray, kinds: int, owner: np.ndarray, window: int) -> np.ndarray:
    """True for words that lie in a window of so many words that its document holds at least twice."""
    out = np.zeros(len(codes), dtype=bool)
    n = len(codes) - window + 1
    if n <= 0:
        return out
    named, of = codes[:n], kinds
    for k in range(1, window):
        named, of = _numbered(named * kinds + codes[k : k + n])
    named, of = _numbered(named * (owner[-1] + 1) + owner[:n])
    whole = owner[:n] == owner[window - 1 :]
    starts = np.flatnonzero(whole & (np.bincount(named, weights=whole, minlength=of)[named] >= 2))
    for k in range(window):
        out[starts + k] = True
    return out


def measures(texts: list[str | None], settings: Settings = Settings()) -> dict[str, np.ndarray | list]:
    """The measurements of whole texts, one of each a text; null counts as empty."""
    known, n = vocabularies(settings), len(texts)
    raw = [(t or "").encode() for t in texts]
    split = [t.split() for t in raw]  # bytes split at the six blanks of the contract and nothing else
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
    n_words = np.array([len(w) for w in split])
    chars = np.array([len(t or "") - sum((t or "").count(b) for b in BLANKS) for t in texts])
    words = np.empty(int(n_words.sum()), dtype=object)
    words[:] = [w for doc in split for w in doc]
    owner = np.repeat(np.arange(n), n_words)
    codes, kinds = pd.factorize(words)
    codes = codes.astype(np.int64)
    encoded = known.encoded(kinds.tolist())
    total = lambda of: np.bincount(owner, weights=np.array(of, dtype=np.float64)[codes], minlength=n).astype(np.int64)
    if len(kinds):
        n_pieces, n_bytes = total([e[0] for e in encoded]), total([e[1] for e in encoded])
        sizes = np.array([len(e[2]) for e in encoded])
        tokens = np.fromiter(chain.from_iterable(e[2] for e in encoded), dtype=np.int64, count=int(sizes.sum()))
        each = sizes[codes]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        token = tokens[np.repeat((np.cumsum(sizes) - sizes)[codes], each) + place]
        whose = np.repeat(owner, each)
        named, first = pd.factorize(whose * known.size + token)
        count = np.bincount(named).astype(np.float64)
        n_tokens = np.bincount(whose, minlength=n)
        repeated = np.bincount(owner, weights=_repeated(codes, len(kinds), owner, settings.window), minlength=n).astype(np.int64)
        inner = np.bincount(first // known.size, weights=count * np.log2(count), minlength=n)
    else:
        n_pieces = n_bytes = n_tokens = repeated = inner = np.zeros(n, dtype=np.int64)
    some = n_tokens > 0
    least = np.maximum(n_tokens, 1)
    entropy = (np.log2(least) - inner / least) / np.log2(np.clip(n_tokens, 2, settings.entropy_tokens))
    ratio = lambda a, b: np.where(some, a / np.maximum(b, 1), np.nan)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": np.array([sum(t.count(s) for s in SYMBOLS) if t else 0 for t in texts]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines]), "n_repeat_words": repeated, "n_tokens": n_tokens,
        "chars_per_token": ratio(chars, n_tokens), "chars_per_piece": ratio(chars, n_pieces), "byte_share": ratio(n_bytes, n_pieces),
        "entropy": np.where(some, entropy, np.nan), "script": [script(t or "") for t in texts],
    }


def _measured(column: str, out: str, settings: Settings):
    kind = pa.struct(list(_MEASURES.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, column):
                part = batch.slice(lo, hi - lo)
                found = measures(part.column(column).to_pylist(), settings)
                arrays = [pa.array(found[name], t, from_pandas=True) for name, t in _MEASURES.items()]
                names = [c for c in batch.schema.names if c != column]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.StructArray.from_arrays(arrays, fields=list(kind))], names=[*names, out])

    return run


_BANDED = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")


def bands(measured: DataFrame, group: str, rules: str, settings: Settings) -> DataFrame:
    """(group, for each banded measure its lower and upper quartile, n): from distinct measurements of texts with words enough.

    Measures are rounded to three places, so exact quartiles need a bounded map of values for each
    group, merged from each task's own.
    """
    values = measured.where(F.col(rules)["n_words"] >= settings.least_words).select(group, F.col(rules)["n_tokens"].alias("n_tokens"), *[F.round(F.col(rules)[m], 3).alias(m) for m in _BANDED])
    quartiles = [F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in _BANDED]
    return values.distinct().groupBy(group).agg(F.count("*").alias("n"), *quartiles)


def _outside(rules: str, settings: Settings) -> dict[str, Column]:
    """For each measure whether it leaves its band. Bands are wider for short texts and for languages of few documents."""
    of = F.col(rules)
    slack = (1 + F.sqrt(settings.settled_tokens / of["n_tokens"])) * (1 + settings.settled_docs / F.col("__band.n"))

    def leaves(measure: str, width: float, least: Column, low: bool = True, high: bool = True) -> Column:
        lower, upper = F.col(f"__band.{measure}")[0], F.col(f"__band.{measure}")[1]
        room = F.greatest(upper - lower, least) * width * slack
        return (F.lit(low) & (of[measure] < lower - room)) | (F.lit(high) & (of[measure] > upper + room))

    share = lambda m: F.col(f"__band.{m}")[1] * settings.least_spread
    return {
        "chars_per_token": leaves("chars_per_token", settings.chars_width, share("chars_per_token")),
        "chars_per_piece": leaves("chars_per_piece", settings.chars_width, share("chars_per_piece")),
        "byte_share": leaves("byte_share", settings.bytes_width, F.lit(settings.least_bytes), low=False),
        "entropy": leaves("entropy", settings.entropy_width, share("entropy"), high=False),
    }


#: Rows of bands that are broadcast; more are left to Spark's own choice of join.
MOST_BANDS = 10_000


def quality_rules(docs: DataFrame, text: str = "text", language: str | None = "lang", rules_as: str = "rules", settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` without its text, with a struct of what was measured and decided on the whole text.

    The struct holds the measurements, ``base_failed`` (too few words, or too large a share of them in
    repeated windows), ``failed`` (the measures outside their bands) and ``kept``. Null texts count as
    empty and fail; so do texts of blanks alone. Repeated rows are decided alike, and other columns are
    carried; one already named as the output is an error. Without ``language``, or where it is null, the
    script takes its place. An empty table gives no rows.
    """
    if rules_as in set(docs.columns) - {text}:
        raise ValueError(f"choose another output name: {rules_as}")
    scratch = Scratch(docs.sparkSession, "rules")
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    found = bounded(docs).mapInArrow(_measured(text, rules_as, settings), ", ".join([*rest, f"`{rules_as}` {_DDL}"]))
    by_script = F.concat(F.lit("script:"), F.col(rules_as)["script"])
    own = F.concat(F.lit("lang:"), F.col(f"`{language}`").cast("string")) if language else F.lit(None).cast("string")
    found = scratch.save(found.withColumn("__group", F.coalesce(own, by_script)), "measured")
    band = scratch.save(bands(found, "__group", rules_as, settings), "bands")
    few = band.count() <= MOST_BANDS
    band = band.select(F.col("__group"), F.struct("n", *_BANDED).alias("__band"))
    joined = found.join(F.broadcast(band) if few else band, "__group", "left")
    of = F.col(rules_as)
    base_failed = (of["n_words"] < settings.least_words) | (100 * of["n_repeat_words"] > settings.most_repeated * of["n_words"])
    failed = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in _outside(rules_as, settings).items()]), lambda x: x.isNotNull())
    decided = joined.withColumns({"__base": base_failed, "__failed": failed})
    struct = F.struct(*[of[m].alias(m) for m in _MEASURES], F.col("__group").alias("band"), F.col("__base").alias("base_failed"), F.col("__failed").alias("failed"), (~F.col("__base") & (F.size("__failed") == 0)).alias("kept"))
    return decided.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], struct.alias(rules_as))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_piece", "byte_share", "entropy")])


QUERIES = {"op12_quality_rules": op12_quality_rules}
SQL: dict[str, str] = {}
