"""N-best segmentation over the piece lattice of a SentencePiece model file, and decoding.

A text's lattice has an edge for each piece of the model at each place; a segmentation's score is the
sum of its pieces' scores in the model file. Forward Viterbi gives the best score up to each place.
These are exact heuristics for a backward A-star search from the end, which therefore takes the N best
segmentations off its agenda one after another.

No piece joins characters of two kinds of which the model never has one after the other (a letter and
a full stop, say), so a text's lattice falls into chunks that are segmented on their own and remembered
in each worker. All new chunks of a slice of texts go through Viterbi at once in numpy, forward and
backward, which gives each its best segmentation and the gap to its second best. Only the N - 1 chunks
with the smallest gaps can differ from their best in one of a text's N best segmentations. A-star lists
the N best of each of these, and once more, over chunks instead of places, the N best of the text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.common import bounded, table, text_slices

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
NO_SCORE = -1e8  # runs of blanks have less in model files of this kind; they count as so many single blanks
PENALTY = 10.0
N_BEST = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_models: dict[tuple[str, int], Pieces] = {}


class Memo(dict):
    """Numbers of chunks; a new chunk gets the next number and waits to be segmented."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []
        self.ids: list[bytes | None] = []
        self.score, self.gap, self.size = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)  # size: bytes of ids

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self.ids)
        self.ids.append(None)
        self.waiting.append(chunk)
        return number

    def grow(self) -> None:
        if len(self.score) < len(self.ids):
            more = np.zeros(2 * len(self.ids) - len(self.score))
            self.score, self.gap = np.concatenate([self.score, more]), np.concatenate([self.gap, more])
            self.size = np.concatenate([self.size, more.astype(np.int64)])


class Pieces:
    """A model's pieces, a memo of chunks, and the searches."""

    def __init__(self, path: str, most_chunks: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                if model.get_score(i) > NO_SCORE:
                    self.score[piece] = (i, model.get_score(i))
        blank = model.piece_to_id(BLANK)
        if BLANK not in self.score and not model.is_unknown(blank):
            self.score[BLANK] = blank, min(s for _, s in self.score.values())
        self.unknown = min(s for _, s in self.score.values()) - PENALTY  # a byte of a character without a piece
        self.longest = max(map(len, self.score))
        whole = all(s == int(s) and abs(s) < 400_000 for _, s in self.score.values())  # 40 of them stay below 2 ** 24
        self.exact = np.float32 if whole else np.float64
        self.chunk = re.compile(self._kinds())
        self._tables()
        self.memo = Memo()
        self.most_chunks = most_chunks
        self.listed: dict[str, list[tuple[float, bytes]]] = {}

    def _kinds(self) -> str:
        """A pattern for chunks, from the neighbours that the pieces have."""
        letter = re.compile(r"[^\W\d_]")
        odd: set[str] = set()
        kind = lambda c: "_" if c == BLANK else "D" if c in "0123456789" else "L" if letter.match(c) and c not in odd else "O"
        pairs = {(a, b) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        while True:
            more = {c for a, b in pairs if {kind(a), kind(b)} == {"L", "O"} for c in (a, b) if kind(c) == "L"}
            if not more:
                break
            odd |= more
        met = {kind(a) + kind(b) for a, b in pairs}
        if len(odd) > 100 or met - {"LL", "OO", "__", "_L", "_O"}:
            return rf"{BLANK}*[^{BLANK}]+|{BLANK}+"  # pieces join other kinds: cut before blanks only
        other = "".join(re.escape(c) for c in sorted(odd))
        letters, others = rf"[^\W\d_{other}]", rf"(?:[^\w{BLANK}]|[_{other}]|(?![0-9])\d)"
        return rf"{BLANK}*{letters}+|{BLANK}*{others}+|{BLANK}+|[0-9]"

    def _tables(self) -> None:
        by: dict[int, list[tuple[int, int, float]]] = {}
        for piece, (i, score) in self.score.items():
            h = 0
            for c in piece:
                h = (h * int(_P) + ord(c) + 1) & (2**64 - 1)
            by.setdefault(len(piece), []).append((h, i, score))
        self.table = {}
        for n, rows in by.items():
            rows.sort()
            h, i, s = zip(*rows, strict=True)
            self.table[n] = np.array(h, dtype=np.uint64), np.array(i), np.array(s)

    def edges(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """(start, piece, score) of the edges that end at each place; piece -1 is a character of bytes."""
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j in range(i + 1, min(len(chunk), i + self.longest) + 1):
                found = self.score.get(chunk[i:j])
                if found:
                    ends[j].append((i, *found))
                elif j == i + 1:
                    ends[j].append((i, -1, self.unknown * len(chunk[i].encode())))
        return ends

    def nbest(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk (score, ids), best first, by A-star from its end."""
        ends = self.edges(chunk)
        ahead = [0.0] * len(ends)
        for j in range(1, len(ends)):
            ahead[j] = max(ahead[i] + s for i, _, s in ends[j])
        order, out = count(), []
        # of equal totals the hypothesis nearest to the start goes on, so ties end soon
        agenda = [(-ahead[-1], len(chunk), next(order), 0.0, None)]
        while agenda and len(out) < n:
            _, at, _, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    start, piece, path = path
                    ids += [piece] if piece >= 0 else [self.byte_id[b] for b in chunk[start].encode()]
                out.append((behind, np.array(ids, dtype="<u4").tobytes()))
                continue
            for start, piece, s in ends[at]:
                heapq.heappush(agenda, (-(ahead[start] + s + behind), start, next(order), s + behind, (start, piece, path)))
        return out

    def known(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        if len(self.listed) >= self.most_chunks // 4:
            self.listed.clear()
        key = f"{n} {chunk}"
        found = self.listed.get(key)
        if found is None:
            found = self.listed[key] = self.nbest(chunk, n)
        return found

    def learn(self) -> None:
        """Segments the chunks that wait in the memo."""
        memo, waiting = self.memo, self.memo.waiting
        first = len(memo.ids) - len(waiting)
        memo.grow()
        short = [i for i, c in enumerate(waiting, first) if len(c) <= 40]
        for lo in range(0, len(short), 50_000):
            own = short[lo : lo + 50_000]
            self._viterbi([waiting[i - first] for i in own], own)
        for i, c in enumerate(waiting, first):
            if memo.ids[i] is None:
                best = self.nbest(c, 2)
                memo.ids[i], memo.score[i] = best[0][1], best[0][0]
                memo.gap[i] = best[0][0] - best[1][0] if len(best) > 1 else np.inf
        memo.size[first : len(memo.ids)] = list(map(len, memo.ids[first:]))
        waiting.clear()

    def _viterbi(self, chunks: list[str], numbers: list[int]) -> None:
        """Best segmentation and gap of many chunks; those with characters of bytes are left out.

        Sums of a short chunk's whole-number scores are exact in 32-bit floats; other scores take 64 bits.
        """
        longest_first = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
        chunks, numbers = [chunks[i] for i in longest_first], np.array(numbers)[longest_first]
        size = np.array([len(c) for c in chunks])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        room = np.repeat(first + size, size) - np.arange(len(flat))  # characters left in the chunk
        longest = int(min(self.longest, size[0]))
        score = np.full((longest + 1, len(flat)), -np.inf, dtype=self.exact)
        ident = np.full((longest + 1, len(flat)), -1, dtype=np.int32)
        hashed = np.zeros(len(flat), dtype=np.uint64)
        for n in range(1, longest + 1):
            at = np.flatnonzero(room >= n)
            hashed[at] = hashed[at] * _P + flat[at + n - 1]
            if n in self.table:
                h, i, s = self.table[n]
                k = np.minimum(np.searchsorted(h, hashed[at]), len(h) - 1)
                hit = h[k] == hashed[at]
                score[n, at[hit]], ident[n, at[hit]] = s[k[hit]], i[k[hit]]
        plain = np.logical_and.reduceat(ident[1] >= 0, first)
        origin = first + np.arange(len(chunks))  # places: one more than characters
        ahead = np.full(len(flat) + len(chunks), -np.inf, dtype=self.exact)
        behind = ahead.copy()
        back = np.zeros(len(ahead), dtype=np.int64)
        ahead[origin] = behind[origin + size] = 0
        for j in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -j, side="right"))
            to, start = origin[:live] + j, first[:live] + j
            for n in range(1, min(j, longest) + 1):
                value = ahead[to - n] + score[n, start - n]
                better = value > ahead[to]
                ahead[to[better]], back[to[better]] = value[better], n
        for j in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -j, side="right"))
            to, start = (origin + size)[:live] - j, (first + size)[:live] - j
            for n in range(1, min(j, longest) + 1):
                np.maximum(value := behind[to + n] + score[n, start], behind[to], out=value)
                behind[to] = value
        owner = np.repeat(np.arange(len(chunks)), size)
        place = np.arange(len(flat)) + owner
        rest, rows, pieces = np.where(plain, size, 0), [], []
        while rest.any():
            own = np.flatnonzero(rest)
            n = back[origin[own] + rest[own]]
            start = first[own] + rest[own] - n
            rows.append(own)
            pieces.append(ident[n, start])
            score[n, start] = -np.inf  # what remains are edges off the best path
            rest[own] -= n
        second = np.full(len(flat), -np.inf, dtype=self.exact)
        for n in range(1, longest + 1):
            at = np.flatnonzero(score[n] > -np.inf)
            second[at] = np.maximum(second[at], ahead[place[at]] + score[n, at] + behind[place[at] + n])
        best, second = ahead[origin + size], np.maximum.reduceat(second, first)
        if not rows:
            return
        row, piece = np.concatenate(rows)[::-1], np.concatenate(pieces)[::-1].astype("<u4")
        order = np.argsort(row, kind="stable")
        ids, ends = piece[order].tobytes(), np.cumsum(np.bincount(row, minlength=len(chunks))) * 4
        done = np.flatnonzero(plain)
        self.memo.score[numbers[done]], self.memo.gap[numbers[done]] = best[done], best[done] - second[done]
        lo, held = 0, self.memo.ids
        for i, ok, hi in zip(numbers.tolist(), plain.tolist(), ends.tolist(), strict=True):
            if ok:
                held[i] = ids[lo:hi]
            lo = hi

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, texts: list[str | None], n: int) -> Iterator[tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]]:
        """For each text its best ids, and its n best as (score, changes); a change puts a chunk's other ids between two places of the best."""
        if len(self.memo) > self.most_chunks:
            self.memo = Memo()
        cut = [self.chunks(t or "") for t in texts]
        numbers = [list(map(self.memo.__getitem__, own)) for own in cut]
        self.learn()
        for own, at in zip(cut, numbers, strict=True):
            if not own:
                yield b"", [(0.0, [])]
                continue
            index = np.array(at)
            ids = b"".join(map(self.memo.ids.__getitem__, at))
            yield ids, self._best_of_text(own, index, n)

    def _best_of_text(self, chunks: list[str], index: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, int, bytes]]]]:
        total, gaps, ends = float(self.memo.score[index].sum()), self.memo.gap[index], np.cumsum(self.memo.size[index])
        slots = np.argpartition(gaps, n - 2)[: n - 1] if 0 < n - 1 < len(gaps) else np.arange(len(gaps)) if n > 1 else []
        slots = sorted(int(i) for i in slots if np.isfinite(gaps[i]))
        options = []
        for i in slots:  # of equal segmentations the one in the memo comes first
            k = self.memo[chunks[i]]
            best = (float(self.memo.score[k]), self.memo.ids[k])
            options.append([best, *(x for x in self.known(chunks[i], n) if x[1] != best[1])][:n])
        # over slots: what lies ahead of each can be had at its best, so the heuristic is 0 and the cost is what is given up
        options_of = {i: own[0][1] for i, own in zip(slots, options, strict=True)}
        order, out = count(), []
        agenda = [(0.0, len(slots), next(order), ())]
        while agenda and len(out) < n:
            cost, k, _, taken = heapq.heappop(agenda)
            if k == 0:
                changes = [(slots[s], options[s][o][1]) for s, o in taken if o]
                out.append((total - cost, [(int(ends[i]) - len(options_of[i]), int(ends[i]), ids) for i, ids in changes]))
                continue
            for o, (s, _) in enumerate(options[k - 1]):
                heapq.heappush(agenda, (cost + options[k - 1][0][0] - s, k - 1, next(order), ((k - 1, o), *taken)))
        return out

    @staticmethod
    def changed(best: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
        """Another segmentation's ids, from the best one's and the changes in order of place."""
        out, at = [], 0
        for start, end, ids in changes:
            out += [best[at:start], ids]
            at = end
        return b"".join([*out, best[at:]])

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank that encoding puts first goes, and ill-formed bytes become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode(errors="replace")
        return text.removeprefix(" ")


def pieces(path: str, most_chunks: int = 1_000_000) -> Pieces:
    key = (path, most_chunks)
    if key not in _models:
        _models[key] = Pieces(path, most_chunks)
    return _models[key]


_KIND = "array<struct<score:double,ids_crc32:long>>"
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("ids_crc32", pa.int64())]))


def _encode(path: str, column: str, n: int, decoded_as: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for lo, hi in text_slices(batch, column, 2_000_000):
                part = batch.slice(lo, hi - lo)
                texts, ids, best = part.column(column).to_pylist(), [], []
                for own, listed in model.encode(texts, n):
                    ids.append(own)
                    best.append([{"score": s, "ids_crc32": zlib.crc32(model.changed(own, c) if c else own)} for s, c in listed])
                names = [c for c in batch.schema.names if c != column]
                columns = [*(part.column(c) for c in names), pa.array(ids, pa.binary()), pa.array(best, _NBEST)]
                names += ["ids", "nbest"]
                if decoded_as:
                    columns.append(pa.array([model.decode(x) for x in ids], pa.string()))
                    names.append(decoded_as)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _decode(path: str, column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                names = [c for c in batch.schema.names if c != column]
                texts = [None if x is None else model.decode(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])

    return run


def _schema(df: DataFrame, column: str, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column), *more])


def encode(docs: DataFrame, path: str, column: str = "text", n: int = N_BEST, decoded_as: str | None = None) -> DataFrame:
    """Every row with its text replaced by ids (little-endian unsigned 32-bit, the best segmentation) and nbest.

    nbest lists the n best segmentations, or as many as there are, best first: score and CRC-32 of ids.
    Null and empty texts have no ids and one segmentation of score 0. Characters without a piece become
    their bytes' pieces. Of equal scores either may come first, always the same one. Other columns are
    carried; one named ids or nbest is an error. A U+2581 in a text is the pieces' mark of a blank, so it is
    encoded as one and decodes as one; all other texts decode as they were. An empty table gives no rows. With ``decoded_as`` the ids
    are decoded again in the same pass.
    """
    clash = {"ids", "nbest", decoded_as} & (set(docs.columns) - {column})
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    return bounded(docs).mapInArrow(_encode(path, column, n, decoded_as), _schema(docs, column, "ids binary", f"nbest {_KIND}", *([f"`{decoded_as}` string"] if decoded_as else [])))


def decode(docs: DataFrame, path: str, column: str = "ids", out: str = "text") -> DataFrame:
    """Every row with its ids replaced by their text; null stays null."""
    if out in set(docs.columns) - {column}:
        raise ValueError(f"rename this column first: {out}")
    return bounded(docs).mapInArrow(_decode(path, column, out), _schema(docs, column, f"`{out}` string"))


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text: counts, digest of the best ids, the n best scores, digest of the decoded text."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    found = encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, decoded_as="decoded")
    scores = F.transform("nbest", lambda x: x["score"]).alias("nbest_scores")
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), scores, F.sha2("decoded", 256).alias("decoded_sha256"))


def text_digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


QUERIES = {"op10_sentencepiece_nbest": op10_sentencepiece_nbest}
SQL: dict[str, str] = {}
