"""Token ids of whole texts with a public tokenizer file.

Byte-level tokenizers of the usual pattern never join what stands on both sides
of a single space between two characters that aren't white space, so texts are
cut there, in Arrow, and each distinct piece of a batch is looked up in what the
worker remembers. Where a new piece is made of Latin letters, common punctuation
and single line feeds, the pattern's cuts in it are known: runs of one kind. Each
distinct run is given to the library's model, without the pattern; other pieces
are given to the whole tokenizer. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Default vocabulary: a name of the installed package of public tokenizer files.
DEFAULT = "byte_bpe_50k.json"
#: Distinct pieces that a worker remembers, and distinct runs.
REMEMBERED = 400_000
#: Marks pieces that no space stands before, and what the whole tokenizer encodes; not a character that a text can hold.
MARK = "\ud800"
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_LETTERS, _SIGNS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r".,;:!?$%*&"
#: The pattern's cuts in text of these letters, signs and single line feeds, and what pieces of other text hold.
_RUN, _OTHER = re.compile(rf" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n"), re.compile(rf"[^{_LETTERS}{_SIGNS}\n]|^\n|\n\n|\n$|^$")
_SPACE = "\u0120"  # as byte-level vocabularies write it
_WRITTEN = list(zip(map(chr, (b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))), map(chr, range(256, 512))))
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _written(runs: list[str]) -> list[str]:
    """Runs as byte-level vocabularies write them."""
    text = "\0".join(runs).encode().decode("latin-1")
    for byte, char in _WRITTEN[1:]:
        text = text.replace(byte, char)
    return text.split("\0") if runs else []


class _Numbers(dict):
    """Key -> number. A number may be given to none."""

    def __init__(self, keys: list[str] = []) -> None:
        super().__init__(zip(keys, range(len(keys))))
        self.next = len(keys)

    def of(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """The keys' numbers, and the keys that are new, in the order of their numbers."""
        numbers = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(numbers < 0)
        unknown = [keys[i] for i in missing.tolist()]
        new = list(dict.fromkeys(unknown))
        self.update(zip(new, range(self.next, self.next + len(new))))
        self.next += len(new)
        numbers[missing] = np.fromiter(map(self.__getitem__, unknown), np.int64, len(unknown))
        return numbers, new


class _Lists:
    """Lists of numbers, one after another."""

    def __init__(self, kind: type) -> None:
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, counts: np.ndarray, pool: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(counts) - counts])
        self.count, self.pool = np.concatenate([self.count, counts]), np.concatenate([self.pool, pool.astype(self.pool.dtype)])

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given lists in a row, and where each list begins and the last one ends."""
        counts = self.count.take(which)
        total = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(self.first.take(which) - total[:-1], counts)
        where += np.arange(total[-1])
        return self.pool.take(where), total


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        added = shape.get("added_tokens", [])
        odd = [t for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])]
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not shape.get("normalizer") and not odd and not shape.get("truncation")
        self.by_run = self.by_piece and all(_OTHER.search(t["content"]) for t in added)
        self.model = self.tokenizer.model
        if self.by_piece and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # what is encoded once isn't looked up again
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.good, self.used, self.ids = _Numbers(), np.zeros(0, bool), np.zeros(0, bool), _Lists(np.uint32)
        self.runs, self.run_ids = _Numbers(), _Lists(np.uint32)

    def _make_room(self) -> None:
        """Forget pieces that didn't come back, and all runs if they are too many; everything, if that isn't half."""
        kept = np.flatnonzero(self.used)
        if len(self.pieces) > REMEMBERED and 2 * len(kept) > REMEMBERED or len(self.runs) > 2 * REMEMBERED:
            return self._forget()
        if len(self.pieces) > REMEMBERED:
            pieces = list(self.pieces)  # in the order of their numbers
            self.pieces, ids, self.ids = _Numbers([pieces[i] for i in kept.tolist()]), self.ids, _Lists(np.uint32)
            self.ids.add(ids.count[kept], ids.joined(kept)[0])
            self.good, self.used = self.good[kept], np.zeros(len(kept), bool)
        if len(self.runs) > REMEMBERED:
            self.runs, self.run_ids = _Numbers(), _Lists(np.uint32)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        numbers, new = self.pieces.of(pieces)
        self.used[numbers[numbers < len(self.used)]] = True
        self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
        self._learn(new)
        return numbers

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        words = [self.by_run and p.isascii() and p.isalpha() for p in new]
        # a piece that begins or ends with white space was cut where it must not be
        good = [w or p[:1] == MARK or bool(p) and not p[0].isspace() and not p[-1].isspace() for p, w in zip(new, words)]
        whole = [not w and (not self.by_run or _OTHER.search(p) is not None) for p, w in zip(new, words)]
        kind = np.array(whole, np.int8) * 2 + ~(np.array(words, bool) | np.array(whole, bool))  # 0 words, 1 cut into runs, 2 whole
        runs = [p for p, k in zip(new, kind.tolist()) if k == 1]
        keys = _written(_RUN.findall(" " + " ".join(runs))) if runs else []
        starts = np.flatnonzero(np.fromiter((k[0] == _SPACE for k in keys), bool, len(keys)))
        counts = np.ones(len(new), np.int64)
        counts[kind == 1] = np.diff(starts, append=len(keys))
        group = np.repeat(kind, counts)
        numbers = np.empty(len(group), np.int64)
        alone = [_SPACE + p for p, w in zip(new, words) if w]
        found, runs = self.runs.of(alone + keys)
        numbers[group == 0], numbers[group == 1] = found[: len(alone)], found[len(alone) :]
        others = [p[1:] if p[:1] == MARK else " " + p for p, w in zip(new, whole) if w]
        numbers[group == 2] = self.runs.next + np.arange(len(others))
        ids: list[int] = []
        many: list[int] = []
        for tokens in map(self.model.tokenize, runs):
            ids += [t.id for t in tokens]
            many.append(len(tokens))
        for coded in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            ids += coded.ids
            many.append(len(coded))
        self.run_ids.add(np.array(many, np.int64), np.array(ids, np.uint32))
        self.runs.next += len(others)
        pool, ends = self.run_ids.joined(numbers)
        self.ids.add(np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]), pool)
        self.good = np.concatenate([self.good, np.array(good, bool)])

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' offsets in them; null texts count as empty."""
        if not self.by_piece:
            ids = [c.ids for c in self.tokenizer.encode_batch_fast([str(t or "") for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), np.concatenate([[0], np.cumsum(counts)])
        self._make_room()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.fill_null(column, ""), " ")
        ends, found = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        pieces, places = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        numbers = self._numbers(pieces).take(places)
        heads = ends[:-1]  # every text has a first piece, an empty one too
        numbers[heads] = self._numbers([MARK + pieces[i] for i in places[heads].tolist()])
        bad = ~self.good.take(numbers)
        if bad.any():
            redo = np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right") - 1)
            rest = [_BOUNDARY.split(column[i].as_py()) for i in redo.tolist()]
            again = self._numbers([MARK + (f" {r}" if k else r) for x in rest for k, r in enumerate(x)])
            old = np.diff(ends)
            sizes = old.copy()
            sizes[redo] = [len(x) for x in rest]
            bad = np.zeros(len(sizes), bool)
            bad[redo] = True
            kept = numbers[~np.repeat(bad, old)]
            where = np.repeat(bad, sizes)
            numbers = np.empty(len(where), np.int64)
            numbers[where], numbers[~where] = again, kept
            ends = np.concatenate([[0], np.cumsum(sizes)])
        ids, total = self.ids.joined(numbers)
        return ids, total[ends]


def encode_column(column: pa.Array, path: str, rows: int = 512):
    """(first row, ids, offsets) of runs of rows of an Arrow string column."""
    coder = encoder(path)
    for at in range(0, len(column), rows):
        ids, offsets = coder.encode(column.slice(at, rows))
        yield at, ids, offsets
