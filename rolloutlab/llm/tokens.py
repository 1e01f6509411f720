"""Token ids by the tokenizers library, one encode call per distinct word.

Both vocabularies split a text into pre-tokens that never span certain cuts,
and a pre-token's ids depend on nothing else. So a text is cut at such places
and only pieces not seen before by this Python worker reach the library. The
cache has a fixed bound. Arrow splits a lot of texts and numbers its distinct
pieces; only these are looked up, and one take lays the ids out. A text whose
cuts are unsafe is cut more carefully or encoded whole.
"""

from __future__ import annotations

import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 300_000       # of each of two generations
LOT_BYTES = 8 << 20           # of text that is split into pieces at a time
#: A trailing run of these never joins the letters before it into one pre-token (no apostrophe: contractions).
TRAIL = ".,;:!?*#$%&|"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER = frozenset(c for c in map(chr, range(256)) if _LETTERS.fullmatch(c))
_ABSENT = object()


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def worker_state(key, make):
    """A value that lives as long as the Python worker, across its tasks."""
    holder = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


class _Pieces(dict):
    """piece -> ids as little-endian uint32 bytes, None if it is unsafe; ``prefix`` stands before every piece."""

    def __init__(self, owner, prefix: str):
        super().__init__()
        self.owner, self.prefix, self.older = owner, prefix, {}

    def __missing__(self, piece: str) -> bytes | None:
        ids = self[piece] = self.owner.piece(piece, self)
        return ids

    def prime(self, pieces: list[str]) -> None:
        """Encode the unknown letters-only pieces (without trailing marks) in a few long calls, and lay the marks' ids behind them."""
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)          # what is still in use moves back piece by piece
            self.clear()
        new = [p for p in pieces if p not in self]
        if self.older:
            old = self.older.get
            self.update(back := {p: ids for p in new if (ids := old(p, _ABSENT)) is not _ABSENT})
            new = [p for p in new if p not in back]
        stripped = [p.rstrip(TRAIL) for p in new]
        cores = {c for c in stripped if c not in self}
        if self.older:
            self.update(back := {c: ids for c in cores if (ids := old(c, _ABSENT)) is not _ABSENT})
            cores -= back.keys()
        cores = [c for c in cores if _LETTERS.fullmatch(c)]
        for lo in range(0, len(cores), 2048):
            lot = cores[lo:lo + 2048]
            self.update(zip(lot, self.owner.words_ids(lot, self.prefix)))
        marks = self.owner.marks
        for p, core in zip(new, stripped):
            if len(core) < len(p) and core and core[-1] in _LETTER and (ids := self.get(core)) is not None:
                self[p] = ids + marks[p[len(core):]]


def _pieces_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts split at blanks: bounds of each text's pieces, the distinct pieces, and the place of every piece among them."""
    parts = pc.split_pattern(column, " ")
    coded = parts.flatten().dictionary_encode()
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    # one call makes all strings; to_pylist makes a scalar of each first
    return bounds, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def _joined(bounds: np.ndarray, ids: list[bytes | None], places: np.ndarray) -> list[bytes]:
    """The ids of each text, laid end to end by one take."""
    laid = pa.array(ids, pa.large_binary()).take(pa.array(places))
    _, offsets, data = laid.buffers()
    cut = np.frombuffer(offsets, np.int64)[bounds].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


class _Encoder:
    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def words_ids(self, words: list[str], prefix: str) -> list[bytes]:
        """The ids of letters-only words; joined by ``joint`` each is one pre-token, so the library's word numbers tell them apart."""
        first, joint, every = self.joints[prefix]
        code = self.tokenizer.encode(first + joint.join(words), add_special_tokens=False)
        word, raw, at = np.array(code.word_ids, np.int64), np.array(code.ids, "<u4").tobytes(), np.arange(len(words)) * every
        cut, end = ((np.searchsorted(word, at, side) * 4).tolist() for side in ("left", "right"))
        return [raw[a:b] for a, b in zip(cut, end)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


class ByteLevelEncoder(_Encoder):
    """Byte-level BPE: a blank or line feed between two non-blank characters is always a cut."""

    _cuts = re.compile(r"(?<=\S)(?= \S)")
    joints = {" ": (" ", " ", 1), "": ("", "\n", 2)}

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.head, self.tail = _Pieces(self, ""), _Pieces(self, " ")
        self.marks, self.line_feed = self.head, self.raw("\n")
        blank = tokenizer.id_to_token(int(np.frombuffer(self.raw(" "), "<u4")[0]))
        self.leads = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.leads[[i for t, i in tokenizer.get_vocab().items() if t.startswith(blank)]] = True

    def words_ids(self, words: list[str], prefix: str) -> list[bytes]:
        if not prefix:
            return super().words_ids(words, prefix)
        # a blank starts every pre-token and stands nowhere else, so the ids whose token starts with one tell the words apart
        code = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0]
        ids = np.array(code.ids, "<u4")
        cut = np.flatnonzero(self.leads[ids])
        if len(cut) != len(words):
            return super().words_ids(words, prefix)
        cut, raw = [*(cut * 4).tolist(), 4 * len(ids)], ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def piece(self, piece: str, pieces: _Pieces) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        core = piece.rstrip(TRAIL)
        if core != piece and core and _LETTERS.fullmatch(core[-1]):
            return pieces[core] + self.head[piece[len(core):]]
        return self.raw(pieces.prefix + piece)

    def encode_column(self, column: pa.Array) -> list[bytes]:
        # every line start is a piece with its line feed in front, the text's own start too
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(column, "\n", " \n"), "")
        parts, words, places = _pieces_of(marked)
        starts = [k for k, w in enumerate(words) if w[:1] == "\n"]
        heads = [words[k][1:] for k in starts]
        for k in starts:
            words[k] = ""
        self.head.prime(heads)
        self.tail.prime(words)
        ids = list(map(self.tail.__getitem__, words))
        for k, head in zip(starts, heads):
            found = self.head[head]
            ids[k] = None if found is None else self.line_feed + found
        unsafe = np.zeros(len(words), bool)
        unsafe[[k for k, x in enumerate(ids) if x is None]] = True
        skip = len(self.line_feed)
        out = [text[skip:] for text in _joined(parts, ids, places)]
        if unsafe.any():
            counts = np.concatenate([[0], np.cumsum(unsafe[places])])
            for i in np.flatnonzero(counts[parts[1:]] > counts[parts[:-1]]).tolist():
                out[i] = b"".join(self._unit(u) for u in self._cuts.split(column[i].as_py()))
        return out

    def _unit(self, unit: str) -> bytes:
        ids = self.tail[unit[1:]] if unit[:1] == " " else self.head[unit]
        return self.raw(unit) if ids is None else ids


class WordEncoder(_Encoder):
    """Lower-casing BPE whose pre-tokens never hold white space."""

    joints = {"": ("", " ", 1)}

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.words = self.marks = _Pieces(self, "")

    def piece(self, piece: str, pieces: _Pieces) -> bytes:
        core = piece.rstrip(TRAIL)
        if core != piece and core and _LETTERS.fullmatch(core[-1]):
            return pieces[core] + pieces[piece[len(core):]]
        return self.raw(piece)

    def encode_column(self, column: pa.Array) -> list[bytes]:
        parts, words, places = _pieces_of(pc.replace_substring(column, "\n", " "))
        self.words.prime(words)
        return _joined(parts, list(map(self.words.__getitem__, words)), places)


class WholeEncoder(_Encoder):
    """Any other tokenizer: the library gets every text whole."""

    def encode_column(self, column: pa.Array) -> list[bytes]:
        return [self.raw(t) for t in column.to_pylist()]


ENCODERS = {"byte_level": ByteLevelEncoder, "word": WordEncoder, "whole": WholeEncoder}


def encoded(column, enc):
    """(first row, ids of each text as uint32 bytes) of a string column, in lots of bounded size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + LOT_BYTES, "right")))
        yield lo, enc.encode_column(pc.fill_null(column.slice(lo, hi - lo), ""))
        lo = hi


def encoder(path: str, kind: str):
    """The worker's encoder for a vocabulary file; strings of special tokens are ordinary text."""

    def make():
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return ENCODERS[kind](tokenizer)

    return worker_state((path, kind), make)
