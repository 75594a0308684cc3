"""Personal data: patterns propose spans, validators confirm them, context words move the score.

Base kinds follow the contract: email, ip (parts up to 255), card (14 to 19 digits that pass Luhn)
and phone (10 to 15 digits); a match that fails its validator is dropped without a retry. Further
kinds are iban (mod-97), ssn (area, group and serial rules) and secret. An iban is confirmed by its
checksum and a secret by the word that its pattern holds; an ssn has too low a score of its own and
needs a context word before it. Context words raise the other kinds' scores as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match of the contract's pattern can begin within a run of digits whose start has failed, so starts are bound to a run's start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_-]{12,})")
DIGIT = re.compile(r"[0-9]")
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35, "secret": 0.6}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "anruf", "appel", "llam"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "sozial", "sécu", "seguro"),
    "secret": (),
}
WINDOW, BOOST, ACCEPT = 40, 0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Validated (kind, start, end), in code points."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    yield "phone", m.start(), m.end()
        for m in IBAN.finditer(text):
            if mod97(m[0]):
                yield "iban", m.start(), m.end()
        for m in SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield "ssn", m.start(), m.end()
        if "=" in text or ":" in text:
            for m in SECRET.finditer(text):
                if DIGIT.search(m[1]):
                    yield "secret", m.start(1), m.end(1)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All accepted spans (kind, start, end, score) by start, then kind. Base kinds are always accepted."""
    out = []
    for kind, start, end in proposals(text or ""):
        near = text[max(0, start - WINDOW) : start].lower()
        score = min(1.0, SCORE[kind] + BOOST * any(word in near for word in CONTEXT[kind]))
        if kind in BASE or score >= ACCEPT:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(column: str, spans_as: str, masked_as: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch, column):
                part = batch.slice(lo, hi - lo)
                texts = part.column(column).to_pylist()
                found = [find(t) for t in texts]
                names = [c for c in batch.schema.names if c != column]
                arrays = [part.column(c) for c in names]
                if masked_as:
                    names.append(masked_as)
                    arrays.append(pa.array([masked(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, _SPAN)], names=[*names, spans_as])

    return run


def _ddl(df: DataFrame, skip: str) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != skip]


def pii_spans(docs: DataFrame, column: str = "text", spans_as: str = "pii", masked_as: str | None = None) -> DataFrame:
    """Every row of ``docs`` without its text, with the spans found in the whole text and, if
    ``masked_as`` is given, the text with the spans masked.

    Null texts have no spans and stay null. Repeated rows are scanned each on its own, other columns are
    carried, and an empty table gives no rows. A column already named as an output is an error.
    """
    clash = {spans_as, masked_as} & (set(docs.columns) - {column})
    if clash:
        raise ValueError(f"choose other output names: {sorted(clash)}")
    schema = ", ".join([*_ddl(docs, column), *([f"`{masked_as}` string"] if masked_as else []), f"`{spans_as}` {SPAN}"])
    return bounded(docs).mapInArrow(_scan(column, spans_as, masked_as), schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; every document stays and n_chars follows the text."""
    out = pii_spans(docs, spans_as="__pii", masked_as="text").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(listed([s for s in find(text) if s[0] in BASE]).encode()).hexdigest()


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
