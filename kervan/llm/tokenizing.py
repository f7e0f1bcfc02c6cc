"""Exact token ids of whole texts, fast where words repeat.

A text is cut only where the tokenizer itself always separates (before a single space or line feed that stands
between non-space characters), a batch's pieces are dictionary-coded in Arrow, and only pieces that this Python worker
has not met are given to the tokenizer library. The ids of a text are then gathered with numpy. Texts with runs of
spaces, with white space beside one, or with SentencePiece's own mark for a space go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import flat_bytes

CACHE_PIECES = 400_000
CACHE_WORDS = 500_000
ENCODE_AT_ONCE = 8_192
LINE_WORDS = 512
# Two white-space characters together, at an end, or any that is not a space or a line feed.
_IRREGULAR = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}][ \n]|[ \n][\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}]|^[ \n]|[ \n]$|\x00"
# What the two JSON tokenizers' own split patterns separate: a piece is taken apart along these before it is looked up.
# Pieces are split many at a time, with a zero character between them, which no piece holds.
_WORDS = regex.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+")

_WORKER: dict[str, "Pieces"] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


class _Rows:
    """Rows of token ids, end to end in one array that grows; a row is known by its number."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 20, dtype), 0
        self.start, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        """Adds rows of the given sizes; returns their numbers."""
        used, n = self.used + len(flat), self.n + len(sizes)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * used - self.used, self.flat.dtype)])
        if n > len(self.start):
            more = np.zeros(2 * n - self.n, np.int64)
            self.start, self.size = np.concatenate([self.start[: self.n], more]), np.concatenate([self.size[: self.n], more])
        self.flat[self.used : used] = flat
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        added = range(self.n, n)
        self.used, self.n = used, n
        return added

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows, end to end, and the end of each row."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[rows] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], ends


class Pieces:
    """One tokenizer and the ids of the pieces that were met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind = "sp" if path.endswith(".model") else "json"
        self.special = None
        if self.kind == "sp":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
            # User-defined pieces are matched before all else, so one with white space inside could span a cut.
            own = [x for i, x in enumerate(names) if not (self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i))]
            self.cuttable = all("▁" not in x.lstrip("▁") and "\n" not in x for x in own)
            self.spaced, self.width = False, 4
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            # Byte-level tokenizers keep the space before a word; the others drop it.
            self.spaced = self.model.encode("a b", add_special_tokens=False).ids != self.model.encode("a  b", add_special_tokens=False).ids
            self.lowers = self.model.encode("A", add_special_tokens=False).ids == self.model.encode("a", add_special_tokens=False).ids
            # Pieces that hold an added token go to the library as they are; added tokens that reach over white space forbid cuts.
            added = list(self.model.get_added_tokens_decoder().values())
            self.cuttable = not any(t.lstrip or t.rstrip or regex.search(r"\s", t.content) for t in added)
            if added:
                self.special = regex.compile("|".join(regex.escape(t.content) for t in added), regex.IGNORECASE)
            self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
            # Byte-level tokens are written with one character a byte.
            self.token_bytes = np.zeros(self.model.get_vocab_size(), np.int64)
            for token, i in self.model.get_vocab().items():
                self.token_bytes[i] = len(token)
        self.dtype = np.uint16 if self.width == 2 else np.uint32
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows = _Rows(self.dtype)
        self.uses = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and their number per text."""
        flats, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        # The library's results are large objects: they are taken over a few at a time.
        for at in range(0, len(texts), ENCODE_AT_ONCE):
            some = texts[at : at + ENCODE_AT_ONCE]
            if self.kind == "sp":
                found = self.model.encode(some, num_threads=1)
            else:
                found = [e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter(chain.from_iterable(found), self.dtype, int(sizes[-1].sum())))
        return np.concatenate(flats), np.concatenate(sizes)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode. Where the space stays with the word, words that begin with one are given to the library many in a
        line, and the ids are dealt to them by the bytes that each id stands for."""
        lead = [w for w in words if w[0] == " " and len(w) > 1] if self.spaced else []
        if len(lead) < LINE_WORDS:
            return self._encode(words)
        lines = ["".join(lead[at : at + LINE_WORDS]) for at in range(0, len(lead), LINE_WORDS)]
        flat, sizes = self._encode(lines)
        ends = np.cumsum(pc.binary_length(pa.array(lead, pa.string())).to_numpy(zero_copy_only=False), dtype=np.int64)
        upto = np.cumsum(self.token_bytes[flat])
        last = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[last] != ends).any():
            return self._encode(words)  # not a byte-level vocabulary
        others = [w for w in words if w[0] != " " or len(w) == 1]
        more, more_sizes = self._encode(others)
        lead.extend(others)
        words[:] = lead
        return np.concatenate([flat, more]), np.concatenate([np.diff(last + 1, prepend=0), more_sizes])

    def _forget(self) -> None:
        """Keeps the cache bounded: all pieces go, and where words are many, those that were looked up only once."""
        if len(self.words) > CACHE_WORDS:
            uses = self.uses[np.fromiter(self.words.values(), np.int64, len(self.words))]
            least = max(2, int(np.partition(uses, len(uses) // 2)[len(uses) // 2]))
            self.words = {w: row for (w, row), often in zip(self.words.items(), (uses >= least).tolist()) if often}
        old, self.rows, self.known = self.rows, _Rows(self.dtype), {}
        flat, ends = old.take(np.fromiter(self.words.values(), np.int64, len(self.words)))
        self.words = dict(zip(self.words, self.rows.append(flat, np.diff(ends, prepend=0))))
        self.uses = np.zeros(self.rows.n, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Makes pieces known: the words of a piece, which the tokenizer treats one by one, are looked up and put together."""
        if self.kind == "sp":
            whole, split = pieces, []
        else:
            # Lower-casing may change how letters beyond ASCII compose, so such pieces stay whole there.
            whole = [p for p in pieces if not p.isascii()] if self.lowers else []
            split = [p for p in pieces if p.isascii()] if self.lowers else pieces
            if self.special is not None and self.special.search("\0".join(split)):
                whole += [p for p in split if self.special.search(p)]
                split = [p for p in split if not self.special.search(p)]
        if whole:
            self.known.update(zip(whole, self.rows.append(*self._encode(whole))))
        if not split:
            return
        joined = "\0".join(split)
        parts = _WORDS.findall(joined.lower() if self.lowers else joined)
        parts.append("\0")
        words = self.words
        fresh = [w for w in set(parts).difference(words) if w != "\0"]
        if fresh:
            found = self._encode_words(fresh)  # may put fresh in another order
            words.update(zip(fresh, self.rows.append(*found)))
        words["\0"] = -1
        rows = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
        del words["\0"]
        ends = np.flatnonzero(rows < 0)
        used = rows[rows >= 0]
        seen = np.bincount(used, minlength=self.rows.n)
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        flat, upto = self.rows.take(used)
        upto = np.concatenate([[0], upto])[ends - np.arange(len(ends))]
        self.known.update(zip(split, self.rows.append(flat, np.diff(upto, prepend=0))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the n + 1 offsets of the texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False), bool)
        if self.kind == "sp":  # its own mark for a space may join the pieces on both sides of one
            odd = odd | np.asarray(pc.match_substring(texts, "▁").to_numpy(zero_copy_only=False), bool)
        if not self.cuttable:
            odd[:] = True
        flat, counts = self._cut(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = flat.dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        pieces = pc.binary_join(distinct, pa.scalar("\0", pa.large_string()))[0].as_py().split("\0") if len(coded.dictionary) else []
        if len(self.known) > CACHE_PIECES:
            self._forget()
        found = list(map(self.known.get, pieces))
        missing = [p for p, row in zip(pieces, found) if row is None]
        if missing:
            self._learn(missing)
            found = [self.known[p] if row is None else row for p, row in zip(pieces, found)]
        rows = np.array(found, np.int64)
        out, ends = self.rows.take(rows[coded.indices.to_numpy(zero_copy_only=False)])
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if odd.any():
            out, offsets = self._insert(texts, odd, out, offsets)
        return out, offsets

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts and their number per text."""
        if self.spaced:  # the space stays with the word behind it
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
            parts = pc.split_pattern(marked, "\x00")
        elif self.kind == "sp":
            parts = pc.split_pattern(texts, " ")
        else:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)

    def _insert(self, texts: pa.Array, odd: np.ndarray, out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.flatnonzero(odd)
        flat, sizes = self._encode(texts.take(pa.array(where)).to_pylist())
        whole = dict(zip(where.tolist(), np.split(flat, np.cumsum(sizes)[:-1])))
        parts = [whole[i] if odd[i] else out[offsets[i] : offsets[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.ids(texts)[1])


def worker_pieces(path: str) -> Pieces:
    """This Python worker's tokenizer for a vocabulary file."""
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def release_pieces() -> None:
    """Gives back the memory of this worker's tokenizers, for stages that need none."""
    _WORKER.clear()


def sub_batches(column: pa.Array, most_bytes: int = 16 << 20):
    """Slices (start, length) of a text column of about most_bytes each, one row at least."""
    _, offsets = flat_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, min(end, len(column)) - at
        at = min(end, len(column))
