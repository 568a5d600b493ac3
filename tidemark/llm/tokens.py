"""Whole texts to token ids by the tokenizers library, with a memo of what it gave for a chunk, bounded in bytes.

Texts repeat their words, and the library's own cache is small. A text is cut at single spaces, where these tokenizers cut
anyway; each new chunk goes to the library once, and a text's ids are those of its chunks in turn. The memo is a few flat
arrays, sorted by 128 bits of hash of the chunk; long chunks (texts without spaces, encoded data) never enter it. Cutting,
hashing, looking up and gathering are Arrow and numpy calls over a whole slice of texts. Texts whose cuts might not be the
tokenizer's go to it whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Bytes of one generation of the memo; two generations are kept.
MEMO_BYTES = 48 << 20
#: Chunks of more bytes are never kept.
LONGEST_CHUNK = 64
#: Chunks and bytes in one call of the library, a chunk at least.
CALL, CALL_BYTES = 20_000, 1 << 20
#: Bytes of texts that are cut at once.
SLICE_BYTES = 4 << 20

# A byte-level pretoken starts at a single space between two characters that are no white space. Texts with other spaces,
# or with white space that this pattern's engine takes for a letter, go to the library whole.
_ODD_SPACE = "^ | [ \t\n\v\f\r]|[ \t\n\v\f\r] | $|[\x1c-\x1f\u0085   -     　]"


def _cut(spec: dict) -> str:
    """How a tokenizer treats spaces: led (they start a pretoken), bare (they are dropped) or unknown."""
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "led"
    steps = pre.get("pretokenizers") or []
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    if (
        steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0].get("invert")
        and r"\s" in steps[0]["pattern"].get("Regex", "").rpartition("[^")[2]
        and all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"} for n in norms)
    ):
        return "bare"
    return "unknown"


#: Keys of the chunk hash, drawn anew by each process, so that no text can aim at a collision.
_KEYS = np.frombuffer(os.urandom(16), "u8") | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _chunk_keys(chunks: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each string: (strings, 2)."""
    n = len(chunks)
    out = np.zeros((n, 2), "u8")
    if not n:
        return out
    edges = np.frombuffer(chunks.buffers()[1], "i4")[chunks.offset : chunks.offset + n + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", "u1")[edges[0] : edges[-1]]
    edges = edges - edges[0]
    sizes = np.diff(edges)
    full = np.flatnonzero(sizes)
    if len(full):
        letters = data.astype("u8") + np.uint64(1) + ((np.arange(len(data)) - np.repeat(edges[:-1], sizes)).astype("u8") << np.uint64(8))
        for k, key in enumerate(_KEYS):
            x = (letters ^ key) * _FACTOR
            x ^= x >> np.uint64(29)
            x *= key
            x ^= x >> np.uint64(32)
            out[full, k] = np.add.reduceat(x, edges[:-1][full])
    return out


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one after another."""
    upto = np.cumsum(count)
    return np.repeat(begin - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


class _Generation:
    """Chunks by hash with their ids: flat arrays, sorted by the first hash."""

    def __init__(self) -> None:
        self.first, self.second = np.zeros(0, "u8"), np.zeros(0, "u8")
        self.begin, self.count, self.ids = np.zeros(0, "u4"), np.zeros(0, "u2"), np.zeros(0, "u4")

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.first, self.second, self.begin, self.count, self.ids))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not known."""
        if not len(self.first):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.first, keys[:, 0]), len(self.first) - 1)
        return np.where((self.first[at] == keys[:, 0]) & (self.second[at] == keys[:, 1]), at, -1)

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New keys with their numbers of ids, and all their ids in turn. A second key with the same first hash is left out."""
        begin = len(self.ids) + np.cumsum(count) - count
        _, kept = np.unique(keys[:, 0], return_index=True)
        at = np.searchsorted(self.first, keys[kept, 0])
        if len(self.first):
            clash = self.first[np.minimum(at, len(self.first) - 1)] == keys[kept, 0]
            kept, at = kept[~clash], at[~clash]
        self.first, self.second = np.insert(self.first, at, keys[kept, 0]), np.insert(self.second, at, keys[kept, 1])
        self.begin, self.count = np.insert(self.begin, at, begin[kept]), np.insert(self.count, at, count[kept])
        self.ids = np.concatenate([self.ids, ids])


class TextTokenizer:
    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = _cut(spec)
        end = spec["model"].get("end_of_word_suffix") or ""
        self.bytes_of = np.zeros(self.library.get_vocab_size(), "i8")
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = len(token.removesuffix(end) if end else token)  # a letter a byte
        for t in spec.get("added_tokens", []):
            self.bytes_of[t["id"]] = len(t["content"].encode())
        self.limit = memo_bytes
        self.young, self.old = _Generation(), _Generation()

    @property
    def memo_bytes(self) -> int:
        return self.young.nbytes + self.old.nbytes

    def _each(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and their number for each."""
        found = [np.array(e.ids, "u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, "u4"), np.array([len(f) for f in found], "i8")

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, from one call; where a chunk's ids end follows from their lengths in bytes."""
        gap = "" if self.cut == "led" else " "
        ids = np.array(self.library.encode_batch_fast([gap.join(chunks)], add_special_tokens=False)[0].ids, "u4")
        ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in chunks])
        cuts = np.searchsorted(ends, wanted)
        if not len(ids) or ends[-1] != wanted[-1] or not np.array_equal(ends[cuts], wanted):
            half = len(chunks) // 2  # a chunk changes its length on the way: find it
            return self._each(chunks) if half < 64 else _joined([self._together(chunks[:half]), self._together(chunks[half:])])
        return ids, np.diff(cuts + 1, prepend=0)

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, for chunks that the memo lacks, in calls of a bounded size."""
        odd = np.array([not (c and not c[-1].isspace() and (c[0] == " " or self.cut == "bare")) for c in chunks], bool)
        ids, count = [], np.zeros(len(chunks), "i8")
        place = []
        for which, call in ((np.flatnonzero(odd), self._each), (np.flatnonzero(~odd), self._together)):
            ends = np.cumsum([len(chunks[i]) for i in which])
            at = 0
            while at < len(which):
                to = min(at + CALL, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CALL_BYTES, "right"))))
                some, n = call([chunks[i] for i in which[at:to]])
                ids.append(some)
                count[which[at:to]] = n
                place.append(which[at:to])
                at = to
        if not ids:
            return np.zeros(0, "u4"), count
        order = np.concatenate(place)
        begin = np.zeros(len(chunks), "i8")
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(ids)[_spans(begin, count)], count

    def _known(self, keys: np.ndarray, short: np.ndarray, chunk_of) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each key in turn and their number. ``short`` marks chunks that may be kept, ``chunk_of`` gives the text of some."""
        count, begin, source = np.zeros(len(keys), "i8"), np.zeros(len(keys), "i8"), np.full(len(keys), -1, "i1")
        young, old = self.young, self.old
        for k, generation in enumerate((young, old)):
            at = generation.find(keys)
            hit = (at >= 0) & (source < 0)
            source[hit], begin[hit], count[hit] = k, generation.begin[at[hit]], generation.count[at[hit]]
        lacking = np.flatnonzero(source < 0)
        _, first, same = np.unique(keys[lacking], axis=0, return_index=True, return_inverse=True) if len(lacking) else (None, lacking, lacking)
        new = lacking[first]
        new_ids, new_count = self._fresh(chunk_of(new))
        new_begin = np.cumsum(new_count) - new_count
        source[lacking] = 2
        count[lacking], begin[lacking] = new_count[same.ravel()], new_begin[same.ravel()]
        out = np.zeros(int(count.sum()), "u4")
        target = np.cumsum(count) - count
        for k, ids in enumerate((young.ids, old.ids, new_ids)):
            own = np.flatnonzero(source == k)
            out[_spans(target[own], count[own])] = ids[_spans(begin[own], count[own])]
        self._keep(keys, np.concatenate([np.flatnonzero(source == 1), new[short[new]]]), out, target, count)
        return out, count

    def _keep(self, keys: np.ndarray, which: np.ndarray, ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Put some chunks into the young generation; a full one becomes the old one."""
        if not len(which):
            return
        which = which[count[which] < 1 << 16]
        self.young.add(keys[which], count[which], ids[_spans(begin[which], count[which])])
        if self.young.nbytes > self.limit:
            self.old, self.young = self.young, _Generation()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls as empty ones) one after another, as unsigned 32-bit integers; and where each text begins and the last ends."""
        found = [self._encode(pc.fill_null(texts.slice(a, b - a), "")) for a, b in slices(texts, SLICE_BYTES)]
        ids, sizes = _joined(found)
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype("i8")

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)
        if self.cut == "led":
            whole = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        elif self.cut == "unknown":
            whole[:] = True
        cuttable = pc.if_else(pa.array(~whole), texts, "") if whole.any() else texts
        if self.cut == "bare":
            cuttable = pc.replace_substring(cuttable, "\n", " ")
        pieces = pc.split_pattern(cuttable, " ")
        begin = pieces.offsets.to_numpy()
        codes = pieces.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin = begin - begin[0]
        words, index = codes.dictionary, codes.indices.to_numpy().copy()
        keys, size = _chunk_keys(words), pc.binary_length(words).to_numpy(zero_copy_only=False)
        word, led = np.arange(len(words)), ""
        if self.cut == "led":  # a text's first chunk has no space before it: it is a chunk of its own
            firsts, led = index[begin[:-1]], " "
            keys = np.concatenate([keys, keys[firsts] ^ _FACTOR])
            word = np.concatenate([word, firsts])
            index[begin[:-1]] = len(words) + np.arange(len(firsts))

        def chunk_of(which: np.ndarray) -> list[str]:
            return [led + w if i < len(words) else w for i, w in zip(which.tolist(), words.take(pa.array(word[which])).to_pylist(), strict=True)]

        ids, count = self._known(keys, size[word] <= LONGEST_CHUNK, chunk_of)
        edges = np.concatenate([[0], np.cumsum(count)])
        counts = count[index]
        ids = ids[_spans(edges[index], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[begin]
        sizes = np.diff(ends)
        if whole.any():
            parts = np.split(ids, ends[1:-1])
            at = np.flatnonzero(whole)
            own, n = self._each([texts[int(i)].as_py() for i in at])
            for i, data in zip(at, np.split(own, np.cumsum(n)[:-1]), strict=True):
                parts[i] = data
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], "i8")
        return ids, sizes


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, "u4"), np.zeros(0, "i8")
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> TextTokenizer:
    """The tokenizer of a file, loaded once a process."""
    return TextTokenizer(path)
