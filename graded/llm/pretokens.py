"""Cutting texts into pieces that byte-level BPE encodes independently.

A byte-level BPE first cuts a text by a fixed pattern; merges never cross a
cut. A space that is followed by a character other than white space always
starts a new piece there, so a text may be split at such spaces ("chunks") and
each distinct chunk of many texts cut once. Without an apostrophe, pieces are
the runs of letters, of numbers, of white space and of other characters, seen
from all chunks' characters in one array. Chunks with one are cut by the
pattern, like texts with other white-space runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed value: the public byte-level pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = regex.compile(PATTERN)
SPACE = 3  # number of white space in ``kinds``
# white space after a space, or a space that ends the text
_ODD_SPACE = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"
KEEP = 64  # characters; longer chunks are rare and aren't remembered
MEMORY = 400_000  # remembered chunks, and as many pieces


@cache
def kinds() -> np.ndarray:
    """The kind of each code point, as the pattern sees it."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), dtype=np.uint8)
    for n, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = n
    return out


class _Memory:
    """A bounded mapping: it takes what comes until it is full, and keeps it.
    The strings that most texts share come early."""

    def __init__(self, size: int):
        self.known: dict[str, bytes] = {}
        self._size = size

    def learn(self, keys: list[str], ids: list[bytes]) -> list[str]:
        """Add ids; returns the keys that must be forgotten after use."""
        room = self._size - len(self.known)
        self.known.update(zip(keys, ids, strict=True))
        return [k for n, k in enumerate(keys) if n >= room or len(k) > KEEP]

    def keep(self, keys: list[str], ids: list[bytes]) -> None:
        """Add ids as far as there is room."""
        room = self._size - len(self.known)
        if room > 0:
            self.known.update((k, x) for k, x in zip(keys[:room], ids) if len(k) <= KEEP)

    def forget(self, keys: list[str]) -> None:
        pop = self.known.pop
        for k in keys:
            pop(k)


class ChunkEncoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit integers.

    ``encode_pieces`` maps a list of distinct pieces to a list of such bytes.
    ``specials`` maps the strings of special tokens to their ids. At most
    ``memory`` chunks, and as many pieces, are remembered."""

    def __init__(
        self,
        encode_pieces: Callable[[list[str]], list[bytes]],
        specials: dict[str, int],
        memory: int = MEMORY,
    ):
        self._encode_pieces = encode_pieces
        self._specials = {s: int(i).to_bytes(4, "little") for s, i in specials.items()}
        longest_first = sorted(specials, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self._chunks = _Memory(memory)
        self._pieces = _Memory(memory)

    def forget(self) -> None:
        """Empty the memories: a worker that lives on has other tasks' data to hold."""
        self._chunks.known = {}
        self._pieces.known = {}

    def _cut(self, text: str) -> list[str]:
        if not self._has_special(text):
            return _PIECES.findall(text)
        out: list[str] = []
        for part in self._split.split(text):
            if part in self._specials:
                out.append(part)
            else:
                out.extend(_PIECES.findall(part))
        return out

    def _has_special(self, text: str) -> bool:
        for s in self._specials:
            if s in text:
                return True
        return False

    def _encode_runs(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without an apostrophe, each with a space before it,
        one after another, and their number in each."""
        if not len(chunks):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.binary_join_element_wise(none, chunks, space)
        size = pc.utf8_length(spaced).to_numpy().astype(np.int64)
        begins = np.cumsum(size) - size
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(spaced)], pa.int64()), spaced)
        text = pc.binary_join(whole, none)[0].as_buffer()
        points = np.frombuffer(str(text, "utf-8").encode("utf-32-le"), dtype="<u4")
        kind = kinds()[points]
        more = begins[size > 1]
        kind[more] = kind[more + 1]  # the space goes with what follows it
        opens = np.zeros(len(points), dtype=bool)
        opens[begins] = True
        new = opens.copy()
        new[1:] |= kind[1:] != kind[:-1]
        # of white space before something else, the last character stands alone
        new[:-1] |= (kind[:-1] == SPACE) & new[1:] & ~opens[1:]
        start = np.flatnonzero(new)
        width = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))
        offsets = np.concatenate([[0], width[start[1:] - 1], width[-1:]])
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), text)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._pieces.known
        ids = list(map(known.get, distinct))
        at = [n for n, x in enumerate(ids) if x is None]
        todo = [distinct[n] for n in at]
        learnt = self._encode_pieces(todo)
        for n, x in zip(at, learnt, strict=True):
            ids[n] = x
        self._pieces.keep(todo, learnt)
        flat, ends = gather(ids, coded.indices.to_numpy(), 4, "<u4")
        cuts = np.concatenate([[0], ends])[np.searchsorted(start, begins)]
        return flat, np.diff(cuts, append=len(flat))

    def _learn(self, cuts: list[list[str]]) -> list[bytes]:
        """Ids of these cut texts or chunks."""
        known = self._pieces.known
        known.update(self._specials)
        todo = list({p for cut in cuts for p in cut if p not in known})
        extra = self._pieces.learn(todo, self._encode_pieces(todo))
        out = [known[cut[0]] if len(cut) == 1 else b"".join([known[p] for p in cut]) for cut in cuts]
        self._pieces.forget(extra)
        return out

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more
        entry than texts: the last is the number of ids)."""
        known = self._chunks.known
        given = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(given, _ODD_SPACE)
        for special in self._specials:
            unusual = pc.or_(unusual, pc.match_substring(given, special))
        odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False))
        first = np.flatnonzero(~unusual.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.if_else(unusual, "", given) if len(odd) else given, " ")
        starts = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary
        at = coded.indices.to_numpy().astype(np.int64)
        # the first chunk has no space before it, all others have
        heads = distinct.take(pa.array(at[starts[first]])).to_pylist()
        cuts = list(map(self._cut, given.take(pa.array(odd)).to_pylist())) + list(map(_PIECES.findall, heads))

        quoted = pc.match_substring(distinct, "'")
        chunks = distinct.filter(quoted).to_pylist()
        ids = list(map(known.get, chunks))
        todo = [c for c, x in zip(chunks, ids, strict=True) if x is None]
        learnt = self._learn([*[_PIECES.findall(" " + c) for c in todo], *cuts])
        self._chunks.keep(todo, learnt[: len(todo)])
        new = iter(learnt)
        ids = [next(new) if x is None else x for x in ids]
        ids += learnt[len(todo) :]
        runs, sizes = self._encode_runs(distinct.filter(pc.invert(quoted)))
        if chunks:
            place = np.empty(len(distinct), dtype=np.int64)
            kept = quoted.to_numpy(zero_copy_only=False)
            place[np.flatnonzero(~kept)] = np.arange(len(sizes))
            place[np.flatnonzero(kept)] = len(sizes) + np.arange(len(chunks))
            at = place[at]
        at[starts[np.concatenate([odd, first])]] = len(distinct) + np.arange(len(given))
        items = np.concatenate([runs, np.frombuffer(b"".join(ids), dtype="<u4")])
        flat, ends = picked(items, np.concatenate([sizes, lengths(ids) // 4]), at)
        return flat, np.concatenate([[0], ends])[starts]


def lengths(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


def gather(parts: list[bytes], at: np.ndarray, width: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """``parts[at[0]] + parts[at[1]] + ...`` as an array of items of ``width``
    bytes, and the number of items up to and with each."""
    return picked(np.frombuffer(b"".join(parts), dtype=dtype), lengths(parts) // width, at)


def picked(items: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``items`` are runs of these sizes. The runs ``at[0]``, ``at[1]``, ...
    one after another, and the number of items up to and with each."""
    begin = np.cumsum(sizes) - sizes
    n = sizes[at]
    ends = np.cumsum(n)
    shift = np.repeat(begin[at] - (ends - n), n)
    shift += np.arange(len(shift))
    return items[shift], ends


def read_tokenizer(path: str) -> dict:
    """A tokenizer file, on the machine that calls this. The path is the same
    on every machine, like any installed file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def special_ids(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
