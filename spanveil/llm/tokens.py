"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import re
from array import array

PIECES_HELD = 300_000  # twice as many at most, in two generations
# White space as Unicode has it (the tokenizers' own), and what follows up to the next.
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# One space or line feed or none, Latin letters, then signs: a word and signs for each of the tokenizers.
PLAIN = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
SAMPLES = ("a", "Hello", "Zażółć", "straße", "Éñü", "word,", "End.**", "it", "thonnd$$$", "naïve!!", "ÅNGSTRÖM;", "x")

_ENCODERS: dict[str, Encoder] = {}


def _letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself
    if it prints in Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


class _Pieces(dict):
    """Ids by piece, learnt when missed; those of the generation before are taken over."""

    def __init__(self, learn, old):
        super().__init__()
        self.learn, self.old = learn, old

    def __missing__(self, piece):
        ids = self.old.get(piece)  # get() learns nothing there
        if ids is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers.

    No token of these files reaches from a character to white space after it,
    and how white space is cut depends only on what directly follows it, so a
    text is cut where white space begins and each distinct piece is encoded
    once. The pieces held are bounded: a generation that is full becomes the
    old one. A piece of letters and signs goes straight to the library's
    model, in the form that its own preparation gives such words (tried on
    samples at the start); all others go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._table = _letters()
        self._signs: dict[str, bytes] = {}
        self._form = None
        for form in ("spaced", "lower"):
            self._form, self._signs = form, {"": b"", " ": b""}
            self._signs["\n"] = self._encode("\n")
            if all(self._plain(PLAIN.fullmatch(gap + x)) == self._encode(gap + x) for x in SAMPLES for gap in ("", " ", "\n")):
                break
        else:
            self._form = None
        self._pieces = _Pieces(self._learn, {})

    def _encode(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokens(self, text: str) -> bytes:
        if not text.isascii() or " " in text:
            text = text.encode().decode("latin-1").translate(self._table)
        return array("I", [t.id for t in self._model.tokenize(text)]).tobytes()

    def _plain(self, found: re.Match) -> bytes | None:
        gap, word, signs = found.groups()
        if signs not in self._signs:
            if len(self._signs) > 10_000:
                self._signs = {k: self._signs[k] for k in ("", " ", "\n")}
            self._signs[signs] = self._tokens(signs)
        if self._form == "lower":
            word = word.lower()
            if not word.isalpha():
                return None
        elif gap == " ":
            word = " " + word
        return self._signs[gap] + self._tokens(word) + self._signs[signs]

    def _learn(self, piece: str) -> bytes:
        found = PLAIN.fullmatch(piece) if self._form else None
        ids = self._plain(found) if found else None
        return self._encode(piece) if ids is None else ids

    def ids(self, texts: list[str]):
        """The ids of each text, in order."""
        for text in texts:
            if len(self._pieces) > PIECES_HELD:
                self._pieces.old = {}  # two generations, no more
                self._pieces = _Pieces(self._learn, self._pieces)
            yield b"".join(map(self._pieces.__getitem__, PIECE.findall(text)))


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def released(run, drop):
    """A task's function after which ``drop`` empties what its worker holds.

    Workers outlive their tasks; what they hold is not there for other stages
    of an executor, which may need the memory. ``drop`` is a function of a
    module, since a task gets copies of anything else.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            drop()
            give_back()

    return whole


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it keeps what it likes


def drop_encoders() -> None:
    _ENCODERS.clear()
