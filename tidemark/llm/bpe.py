"""Byte-level BPE as a streaming transducer, and its inverse.

The encoder reads a text piece by piece. Pretokens come from the vocabulary's pattern; inside a pretoken merges apply by
rank. A run of bytes that goes on for long is not held: from the merge list follows how many bytes right of a token can
still change it, and a token with that many bytes after it is emitted. So memory is bounded by the piece, the lookahead
and the bounded memo of short pretokens, whatever the length of the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, col, slices

# The pretoken pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = 1 << 16
#: A pretoken of more characters than this is streamed, one of fewer is merged at once.
LONG_RUN = 256
#: Pretokens in one generation of the memo, and the characters that one may have; two generations are kept.
MEMO, LONGEST_KEPT = 200_000, 48
#: The rank of a pair that no merge names.
NEVER = 1 << 60
_RUN_KINDS = [regex.compile(p) for p in (r"\s+", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+")]
_GOES_ON = [regex.compile(p) for p in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary's tokens as bytes, its merges by pair of ids, its special strings, and its sufficient lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token: dict[int, bytes] = {i: as_bytes(t) for t, i in model["vocab"].items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[model["vocab"][a], model["vocab"][b]] = rank, model["vocab"][a + b]
        self.rank = {p: rank for p, (rank, _) in self.pair.items()}
        self.made = dict(self.pair.values())
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes right of a token that can decide about it.

        Whether pair (a, b) merges depends on b staying whole: an earlier merge (b, c) may take it first, which in turn
        depends on c, and so on, with ever earlier merges. The longest such chain, in bytes, comes from one pass over the
        merges by rank. b itself was made by a merge whose right half could have been taken likewise.
        """
        reach: dict[int, int] = dict.fromkeys(self.byte_id, 0)
        for (a, b), (_, whole) in sorted(self.pair.items(), key=lambda x: x[1][0]):
            chain = len(self.token[b]) + reach.get(b, 0)
            reach[whole] = max(reach.get(whole, 0), reach.get(b, 0))
            reach[a] = max(reach.get(a, 0), chain)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one whole run of bytes."""
        ids = [self.byte_id[b] for b in data]
        return self._merge_short(ids) if len(ids) <= 32 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [*map(rank, zip(ids, ids[1:], strict=False), repeat(NEVER))]  # of each pair of neighbours
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pair = len(ids), self.pair
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*pair[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pair]
        heap = [(rank, i, whole, a, b) for rank, whole, i, a, b in queue]
        heapq.heapify(heap)
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (p := (ids[left], ids[right])) in pair:
                    rank, made = pair[p]
                    heapq.heappush(heap, (rank, left, made, *p))
        return [t for t in ids if t >= 0]


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    """The vocabulary of a file, read once a process."""
    return Merges(path)


class RunEncoder:
    """Bytes of one pretoken in, stable ids out."""

    def __init__(self, merges: Merges, block: int = 512) -> None:
        self.merges, self.held, self.block = merges, b"", block

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.block):
            self.held += data[i : i + self.block]
            if len(self.held) > self.merges.lookahead + self.block:
                out += self._emit(len(self.held) - self.merges.lookahead)
        return out

    def _emit(self, stable: int) -> list[int]:
        out, end = [], 0
        for token in self.merges.merge(self.held):
            if end + len(self.merges.token[token]) > stable:
                break
            end += len(self.merges.token[token])
            out.append(token)
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class _Young(dict):
    """The young generation: what it lacks is asked of ``lacking``. A lookup that succeeds calls no Python code."""

    def __init__(self, lacking: Callable[[str], bytes]) -> None:
        self.lacking = lacking

    def __missing__(self, word: str) -> bytes:
        return self.lacking(word)


class Memo:
    """Encoded short pretokens in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, merges: Merges, size: int = MEMO) -> None:
        self.merges, self.size = merges, size
        self.young: dict[str, bytes] = _Young(self._lacking)
        self.old: dict[str, bytes] = {}

    def __getitem__(self, word: str) -> bytes:
        return self.young[word]

    def all(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        return [*map(self.young.__getitem__, words)]  # of the generation that was young at first: both hold right ids

    def _lacking(self, word: str) -> bytes:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            found = pack_ids(self.merges.merge(word.encode()))
        if len(word) <= LONGEST_KEPT:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, _Young(self._lacking)
            self.young[word] = found
        return found


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack_ids(data: bytes) -> list[int]:
    return memoryview(data).cast("I").tolist()


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo(load(path))


class StreamEncoder:
    """Pieces of ordinary text in, stable ids (little-endian, 4 bytes each) out; finish() gives the rest."""

    def __init__(self, merges: Merges, memo: Memo | None = None, pattern: str = PATTERN) -> None:
        self.merges, self.memo = merges, memo or Memo(merges)
        self.pattern = regex.compile(pattern)
        self.held = ""
        self.kind = -1  # of the open run, -1: none
        self.run = RunEncoder(merges)

    def feed(self, piece: str, last: bool = False) -> bytes:
        text, out, at = self.held + piece, [], 0
        self.held = ""
        if self.kind >= 0:
            end = _GOES_ON[self.kind].match(text).end()
            if end == len(text) and not last:
                out.append(pack_ids(self.run.feed(text[:-1].encode())))
                self.held = text[-1:]
                return b"".join(out)
            at = end - 1 if self.kind == 0 and end < len(text) else end
            out.append(pack_ids(self.run.feed(text[:at].encode())))
            out.append(pack_ids(self.run.finish()))
            self.kind = -1
        if last:
            words = self.pattern.findall(text, at)
        else:
            words = []
            # What could still change: a run at the end of the text, and its last three characters, which may become a
            # contraction. Only that much is searched match by match.
            for m in self.pattern.finditer(text, at):
                if m.end() == len(text) or m.start() + 3 > len(text):
                    self.held = text[m.start() :]
                    break
                words.append(m.group())
        if max(map(len, words), default=0) <= LONG_RUN:
            out += self.memo.all(words)
        else:
            out += (self.memo[w] if len(w) <= LONG_RUN else self._long(w) for w in words)
        if len(self.held) > LONG_RUN:
            kind = next((k for k, p in enumerate(_RUN_KINDS) if (m := p.match(self.held)) and m.end() == len(self.held)), -1)
            if kind >= 0:
                out.append(pack_ids(self.run.feed(self.held[:-1].encode())))
                self.held, self.kind = self.held[-1:], kind
        return b"".join(out)

    def _long(self, word: str) -> bytes:
        run = RunEncoder(self.merges)
        return pack_ids(run.feed(word.encode()) + run.finish())

    def finish(self) -> bytes:
        return self.feed("", last=True)


def encode(text: str, merges: Merges, memo: Memo | None = None, piece: int = PIECE) -> Iterator[bytes]:
    """Ids of a whole text, a piece at a time. Special strings become their own ids, as in the vocabulary's library."""
    parts = [text]
    if any(s in text for s in merges.special):
        parts = regex.split("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")", text)
    for part in parts:
        if part in merges.special:
            yield pack_ids([merges.special[part]])
            continue
        stream = StreamEncoder(merges, memo)
        for i in range(0, len(part) - piece, piece):
            yield stream.feed(part[i : i + piece])
        yield stream.feed(part[max(0, (len(part) - 1) // piece * piece) :], last=True)


class StreamDecoder:
    """Ids in, text out. Holds the bytes of a character whose end is still to come; broken bytes become U+FFFD."""

    def __init__(self, merges: Merges) -> None:
        self.token = merges.token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.token.__getitem__, unpack_ids(ids))))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode(ids: bytes, merges: Merges, block: int = 1 << 14) -> str:
    stream = StreamDecoder(merges)
    return "".join([*(stream.feed(ids[i : i + 4 * block]) for i in range(0, len(ids), 4 * block)), stream.finish()])


def transcode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): little-endian unsigned 32-bit ids of each whole text, and the text they decode to.

    A null text is an empty one: no ids, an empty string. Repeated rows give equal rows; an empty table gives none. A very
    long text is encoded in bounded memory; its ids, being one value of a column, are held whole, beside those of a slice
    of texts at most. Columns beside the two named are not read.
    """
    arrow_batches(docs.sparkSession)
    bare = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    schema = bare.select("doc_id").schema.add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo = load(path), _memo(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = [b"".join(encode(t or "", merges, memo)) for t in batch.column(1).slice(a, b - a).to_pylist()]
                texts = [decode(i, merges) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return bare.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    out = transcode_documents(docs, path)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
