"""Text of PDF files: objects, Flate streams and the text operators of page contents. Scanned pages have none."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in an array of strings that counts as a blank, in thousandths of the font's size.
GAP = 200
#: A longer stream is an error, so that a small file can't fill a worker's memory.
MOST_STREAM = 256 * 1024 * 1024


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if found is None:
        return b""
    data = found[1]
    if b"/FlateDecode" in body[: found.start()]:
        inflate = zlib.decompressobj()
        data = inflate.decompress(data, MOST_STREAM)
        if inflate.unconsumed_tail:
            raise ValueError(f"a stream holds more than {MOST_STREAM} bytes")
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" not in body.split(b"stream", 1)[0]:
            continue
        n, first = (int(re.search(rb"/" + key + rb"\s+(\d+)", body)[1]) for key in (b"N", b"First"))
        packed = _stream(body)
        numbers = [int(x) for x in packed[:first].split()[: 2 * n]]
        starts = [*(first + at for at in numbers[1::2]), len(packed)]
        for number, a, b in zip(numbers[::2], starts, starts[1:], strict=False):
            out.setdefault(number, packed[a:b])
    return out


def _value(body: bytes, key: bytes, objects: dict[int, bytes]) -> bytes:
    """What a key of a dictionary holds, references followed; its text up to the end of the object."""
    found = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
    if found is None:
        return b""
    rest = body[found.end() :]
    reference = _REFERENCE.match(rest)
    return objects.get(int(reference[1]), b"") if reference else rest


def _literal(token: bytes) -> bytes:
    def plain(m: re.Match) -> bytes:
        x = m[1]
        if x[:1] in b"01234567" and x:
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _cmap(source: bytes) -> dict[bytes, str]:
    """Codes and their characters, from a font's table to Unicode."""
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16), 65535) + 1):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + i) if len(c) <= 4 else text(c)
    return out


def _decoded(raw: bytes, cmap: dict[bytes, str]) -> str:
    if not cmap:
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = len(next(iter(cmap)))
    return "".join(cmap.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out, held, cmap, array = [], [], {}, False
    for token in _TOKEN.findall(content):
        head = token[:1]
        if head == b"(":
            held.append(_decoded(_literal(token), cmap))
        elif head == b"<":
            digits = b"".join(token[1:-1].split())
            held.append(_decoded(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), cmap))
        elif head in b"[]":
            array = head == b"["
        elif head == b"/":
            cmap = fonts.get(token[1:], cmap) if token[1:] in fonts else cmap
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if token in (b"'", b'"') else "") + "".join(held))
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            held = []
        elif array and re.fullmatch(rb"-\d+(\.\d*)?", token) and float(token) <= -GAP:
            held.append(" ")
    return re.sub(r"\s+", " ", "".join(out)).strip()


def pdf(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """The pages' texts, joined by blanks, as one text; its metadata tells how many pages there are."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = _objects(data)
    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page(?![A-Za-z])", body)]
    texts = []
    for body in pages:
        resources = _value(body, b"Resources", objects)
        listed = _value(resources or body, b"Font", objects).split(b">>", 1)[0]
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            table = _value(objects.get(int(number), b""), b"ToUnicode", objects)
            fonts[name] = _cmap(_stream(table)) if table else {}
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        parts = [_stream(objects.get(int(n), b"")) for n in _REFERENCE.findall(found[1])] if found else []
        texts.append(_page_text(b"\n".join(parts), fonts))
    return [(" ".join(texts), {"type": "text", "page_count": str(len(pages))})]
