"""BPE encoding and decoding (operator 7) by forced-boundary splitting.

The vocabulary of a byte-pair tokenizer tells which two adjacent bytes ever
stand next to each other inside a token. A pair of bytes that stands inside no
token can't be merged across, so the text is certainly cut there. The fragments
between such cuts are encoded independently and the ids are concatenated. The
distinct new words of a piece of a batch are encoded together: their fragments
are merged side by side in arrays, one merge of each fragment in a round. A worker keeps the
ids of up to MOST_WORDS words at hand, and those of one piece.

The tokenizer is read from a JSON file (its path is a parameter) on the driver
and its text, a few MB at most, is broadcast. Supported is the layout of
``word_bpe_49k.json``: NFC, white space, lower case, a split pattern, byte
symbols and merges with a suffix at word ends; special tokens in a text count
as such. The split pattern of that layout is a fixed value below.

Cases: a null text counts as empty; an empty text has no ids; rows may repeat;
an empty table gives an empty table; other columns are not read. Words are
bounded only by the text: long ones are merged with a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow_text import pieces
from .common import texts

#: White space of the split pattern, and what Unicode has assigned since the version 16 that the pattern's tables follow.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD"
)


def split_pattern() -> regex.Pattern:
    """The split pattern of this layout: contractions, runs of letters, single digits, runs of other characters."""
    later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{later}]]+|[\p{{N}}--[{later}]]|[[^{SPACES}\p{{L}}\p{{N}}]||[{later}]]+")


#: The same for ASCII texts, where it is quicker.
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: The same for texts of Latin letters up to U+024F, all of which are letters from U+00C0 on but two signs.
SPLIT_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµº²³¹¼-¾À-ÖØ-öø-ɏ]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
SPLIT = split_pattern()
#: Words whose ids a worker keeps: when half of them are new, those not met since the last time are forgotten.
MOST_WORDS = 150_000
#: Where two ids have no merge; those that have one have rank << 32 | new id.
_NONE = 1 << 62
#: Fragments up to this length are merged by plain scans, or side by side where there are FEW words or more.
SHORT, FEW = 48, 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def token_names(source: str) -> list[str]:
    """The token of each id, special ones included."""
    spec = json.loads(source)
    names = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    out = [""] * (1 + max(names.values()))
    for name, i in names.items():
        out[i] = name
    return out


def decode(ids: bytes, names: list[str]) -> str:
    """The names of ids with single spaces between; this layout has no further decoder."""
    return " ".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Tokenizer:
    """ids of texts, from the text of a tokenizer's JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        code = {c: b for b, c in enumerate(symbols)}
        self.alone = [vocab[c] for c in symbols]
        self.last = [vocab[c + self.suffix] for c in symbols]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.keys = np.array(sorted(self.merges), np.int64)
        self.found = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        #: left byte << 9 | right byte | 256 at a word's end, of bytes that stand together inside a token
        self.joined: set[int] = set()
        for name in vocab:
            ends = name.endswith(self.suffix) and len(name) > len(self.suffix)
            data = [code[c] for c in (name[: -len(self.suffix)] if ends else name)]
            for i in range(1, len(data)):
                self.joined.add(data[i - 1] << 9 | data[i] | (256 if ends and i == len(data) - 1 else 0))
        self.together = np.zeros(1 << 17, bool)
        self.together[list(self.joined)] = True
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes, final: bool) -> list[int]:
        """Repeatedly merge the leftmost pair of the lowest rank."""
        ids = [self.alone[b] for b in data]
        if final:
            ids[-1] = self.last[data[-1]]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            at = found.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 32 | ids[at], _NONE)
            if at < len(found):
                found[at] = get(ids[at] << 32 | ids[at + 1], _NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (found >> 32, i, ids[i], ids[j], found & 0xFFFFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a word, as little-endian 32-bit integers: cut where no token can reach across, then merge each fragment."""
        data, out, a = word.encode(), [], 0
        end = len(data) - 1
        for i in range(1, end + 1):
            if (data[i - 1] << 9 | data[i] | (256 if i == end else 0)) not in self.joined:
                out += self.merge(data[a:i], False)
                a = i
        out += self.merge(data[a:], True)
        return struct.pack(f"<{len(out)}I", *out)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """`word` of many words."""
        if len(words) < FEW:
            return list(map(self.word, words))
        data = [w.encode() for w in words]
        end = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        b = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        final = np.zeros(len(b), bool)
        final[end - 1] = True
        opens = np.ones(len(b), bool)
        opens[1:] = final[:-1] | ~self.together[b[:-1] << 9 | b[1:] | final[1:].astype(np.int64) << 8]
        ids, at = self._side_by_side(np.where(final, np.array(self.last)[b], np.array(self.alone)[b]), np.flatnonzero(opens))
        cuts, joined = (4 * np.searchsorted(at, np.r_[0, end])).tolist(), ids.astype("<u4").tobytes()
        return [joined[i:j] for i, j in zip(cuts, cuts[1:])]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What `merges` has for each pair, _NONE where nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], _NONE)

    def _side_by_side(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges, and where each began; fragments begin at start."""
        size, at, done = np.diff(np.r_[start, len(ids)]), np.arange(len(ids)), []
        for f in np.flatnonzero(size > SHORT).tolist():
            own = np.array(self._heap(ids[start[f] : start[f] + size[f]].tolist()), np.int64)
            done.append((own, np.full(len(own), start[f])))
        short = np.repeat(size <= SHORT, size)
        ids, at, size = ids[short], at[short], size[size <= SHORT]
        best = np.full(len(ids), _NONE)
        best[:-1] = self._pairs(ids[:-1], ids[1:])
        best[np.cumsum(size) - 1] = _NONE
        while len(ids):
            least = np.minimum.reduceat(best, np.cumsum(size) - size)
            goes = least != _NONE
            live = np.repeat(goes, size)
            done.append((ids[~live], at[~live]))
            ids, at, best, size, least = ids[live], at[live], best[live], size[goes], least[goes]
            if len(ids) == 0:
                break
            of = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(best == least[of])
            hit = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]]]  # the leftmost of each fragment
            ids[hit] = least & 0xFFFFFFFF
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            ids, at, best = ids[stays], at[stays], best[stays]
            hit, size = hit - np.arange(len(hit)), size - 1
            end = np.cumsum(size)
            best[hit] = _NONE
            right, left = hit[hit < end - 1], hit[hit > end - size]
            best[right] = self._pairs(ids[right], ids[right + 1])
            best[left - 1] = self._pairs(ids[left - 1], ids[left])
        ids, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return ids[order], at[order]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one, so no final sigma
        text = text.lower()
        return (SPLIT if BEYOND_LATIN.search(text) else SPLIT_LATIN).findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """`encode` of many texts."""
        found = [[p if k % 2 else self.split(p) for k, p in enumerate(self.marks.split(x) if self.marks else [x])] for x in texts]
        if len(self.words) >= MOST_WORDS // 2:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        new = set().union(*(p for x in found for p in x[::2])).difference(known)
        known.update((w, older[w]) for w in new.intersection(older))
        new = list(new.difference(known))
        known.update(zip(new, self.ids_of(new)))
        return [b"".join(i for k, p in enumerate(x) for i in ([struct.pack("<I", self.special[p])] if k % 2 else map(known.__getitem__, p))) for x in found]


_tokenizers: dict[int, Tokenizer] = {}


def tokenizer(source: str) -> Tokenizer:
    """The tokenizer of a JSON text, built once for each worker."""
    key = hash(source)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(source)
    return _tokenizers[key]


_names: dict[int, list[str]] = {}


def names_of(source: str) -> list[str]:
    """`token_names` of a JSON text, read once for each worker."""
    key = hash(source)
    if key not in _names:
        _names.clear()
        _names[key] = token_names(source)
    return _names[key]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every whole text."""
    source = _read(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(source.value)
        for b in pieces(batches, "text"):
            yield pa.record_batch([b["doc_id"], pa.array(t.encode_all([x or "" for x in b["text"].to_pylist()]), pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their text, from encoded's result."""
    source = _read(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = names_of(source.value)
        for b in pieces(batches, "ids"):
            yield pa.record_batch([b["doc_id"], b["ids"], pa.array([decode(x, names) for x in b["ids"].to_pylist()], pa.large_string()).cast(pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def _read(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # the driver's own copy of the tokenizer
        return df.sparkSession.sparkContext.broadcast(f.read())
