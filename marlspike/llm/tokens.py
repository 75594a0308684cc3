"""Token ids of a word-level BPE tokenizer file, with a memo of words in each worker process.

The tokenizer composes and lower-cases first, and its pre-tokenizer never joins characters across a
blank or a line feed. So a text's ids are the ids of its pieces between blanks, one after another, and a piece that
is one run of letters, perhaps followed by punctuation, is one or two words of the BPE model. Other
pieces go through the pre-tokenizer, and those with a special token's string through the whole
tokenizer before they are lower-cased. ``tests/llm/test_llm.py`` holds this against the tokenizer's
own ids of whole texts. Ids are held in 16 bits, so a vocabulary of more than 65,536 is refused.
"""

from __future__ import annotations

import array
import os
import re
import unicodedata

_encoders: dict[tuple[str, int], WordEncoder] = {}

#: Of the characters below U+0250 that _composed lets through, \w takes six that are numbers and not letters.
_LETTERS_THEN_PUNCTUATION = re.compile(r"([^\W\d_²³¹¼½¾]+)([!-/:-@\[-`{-~]*)\Z")


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins that byte-level pre-tokenizers use, by Latin-1 code point."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Maps a piece of text without blanks to its ids, as bytes of unsigned 16-bit numbers."""

    def __init__(self, path: str, most_words: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.most_words = most_words
        self.characters = _byte_characters()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
        return array.array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most_words:
            self.clear()
        parts = _LETTERS_THEN_PUNCTUATION.match(piece) if piece.isascii() or _composed(piece) else None
        if parts is None:
            # not by encode(), which would compose once more: a mark may go with a lower-case letter alone
            words = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
            ids = array.array("H", [t.id for word, _ in words for t in self.model.tokenize(word)]).tobytes()
        elif parts[2] == "":
            ids = self._word(piece)
        else:
            ids = self[parts[1]] + self._punctuation(parts[2])
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _punctuation(self, run: str) -> bytes:
        if run not in self:
            self[run] = array.array("H", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        return self[run]

    def encode(self, text: str) -> bytes:
        if not text.isascii():  # the tokenizer composes before it lower-cases
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        lower = text.lower()
        if any(s in lower for s in self.special):
            return b"".join(map(self._perhaps_special, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.__getitem__, lower.replace("\n", " ").split(" ")))

    def _perhaps_special(self, piece: str) -> bytes:
        """A special token's string has the token's id as it is written, but not in other case."""
        lower = piece.lower()
        if any(s in lower for s in self.special):
            return array.array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return self[lower]


def _composed(piece: str) -> bool:
    """Latin letters in composed form; normalisation leaves them as they are."""
    return all(c < "ɐ" for c in piece)


def word_encoder(path: str, most_words: int = 500_000) -> WordEncoder:
    key = (path, most_words)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, most_words)
    return _encoders[key]
