"""Byte-level BPE token ids of whole columns, by way of the tokenizers library.

The library's own call costs several microseconds a word, most of it outside of the merges. So the
texts of a batch are cut into pre-tokens in arrays: each code point is a letter, a number, white
space or something else - the library is asked once which - and the rule of the byte-level
pre-tokenizer (runs of one kind, a space ahead of a run goes with it, short English endings on their
own) turns these kinds into cuts. Every different pre-token of a batch is then encoded once, by
the library's model, many in one call, and what was encoded lately is kept.

The rule holds for byte-level BPE without a normalizer, with no space put ahead. For any other
vocabulary, and for texts that hold one of its added tokens (such as its end mark), the library
encodes the whole text by itself. By default the strings of special tokens stand for those tokens, as
in the library's plain call.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens kept in each of two generations, and the longest that is kept (in characters).
CACHED = 150_000
LONGEST_CACHED = 40
#: Bytes of text that are encoded together: the more, the fewer pre-tokens come again; bounded for memory.
BATCH_BYTES = 2 << 20
#: Pre-tokens in one call of the library.
CALL = 20_000

#: The endings that the pre-tokenizer cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def _byte_letters() -> np.ndarray:
    """The code point that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    shown = np.zeros(256, dtype=bool)
    for a, z in ((33, 126), (161, 172), (174, 255)):
        shown[a : z + 1] = True
    return np.where(shown, np.arange(256), 256 + np.cumsum(~shown) - 1).astype(np.uint16)


class Cache:
    """Two generations of ids by string; what is found in the old one moves to the young one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def of(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        if self.old:
            missed = [i for i, f in enumerate(found) if f is None]
            again = {}
            for i, f in zip(missed, map(self.old.get, [keys[i] for i in missed]), strict=True):
                if f is not None:
                    found[i] = again[keys[i]] = f
            self.put(again)
        return found

    def put(self, ids: dict[str, bytes]) -> None:
        self.young.update(ids)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Encoder:
    """Encodes batches of texts; one lives in each Python worker while a stage needs it."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.cache = Cache(CACHED)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        self.by_rule = (
            said["model"].get("type") == "BPE"
            and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(said["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        )
        added = [t for t in said.get("added_tokens", []) if special or not t["special"]]
        self.by_rule &= not any(t["normalized"] or t["single_word"] for t in added)
        self.added = [t["content"] for t in added]
        if self.by_rule:
            self.model = Tokenizer.from_file(path)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no byte is spelled as white space
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.bytes_of = np.zeros(1 + max(vocabulary.values()), dtype=np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)  # a character for each byte
            self.letters = _byte_letters()
            self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def _ask_kinds(self, points: np.ndarray) -> None:
        """Which kind each code point is, as the library's pre-tokenizer treats it."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            self.kind[p] = next((k for k, friend in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(friend + c)) == 1), SPACE)

    def _cuts(self, a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point of a; texts are a[first[i]:last[i]], none empty."""
        kind = self.kind[a]
        if (kind == UNKNOWN).any():
            self._ask_kinds(np.unique(a[kind == UNKNOWN]))
            kind = self.kind[a]
        space = kind == SPACE
        start = np.ones(len(a), dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        start[first] = True
        # white space: the last of a run goes on its own, or, if it is a plain space, with what follows; a run at the end of a text stays whole
        ahead = space & ~np.append(space[1:], True)  # the next code point is no white space
        ahead[last - 1] = False
        start |= ahead
        joins = ahead & (a == 32)
        start[1:] &= ~joins[:-1]
        # endings
        at = np.flatnonzero((a == 39) & start)
        at = at[at + 1 < len(a)]
        if len(at):
            room = last[np.searchsorted(first, at, side="right") - 1] - at
            one = a[at + 1]
            two = a[np.minimum(at + 2, len(a) - 1)]
            size = np.zeros(len(at), dtype=np.int64)
            for e in ENDINGS:
                hit = (one == ord(e[0])) & (room > len(e))
                if len(e) == 2:
                    hit &= two == ord(e[1])
                size[hit & (size == 0)] = len(e)
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            after = at + 1 + size
            start[after[after < len(a)]] = True
        return start

    def _called(self, spelled: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and where those of each end: spelled holds their bytes, one pre-token after the other."""
        out, begin = [], 0
        for i in range(0, len(ends), CALL):
            own = ends[i : i + CALL]
            line = np.insert(self.letters[spelled[begin : own[-1]]], own[:-1] - begin, 32)
            begin = own[-1]
            out.append(np.asarray(self.model.encode_batch_fast([line.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, dtype=np.uint32))
        ids = np.concatenate(out)
        return ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1

    def _ids_of(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, one after the other, and how many each has."""
        keys = tokens.to_numpy(zero_copy_only=False).tolist()
        found = self.cache.of(keys)
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            own = tokens.take(pa.array(new, pa.int64()))
            offsets = np.frombuffer(own.buffers()[1], dtype=np.int64)[own.offset : own.offset + len(own) + 1]
            ids, ends = self._called(np.frombuffer(own.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0])
            flat, ends = ids.tobytes(), (4 * ends).tolist()
            cut = [flat[a:z] for a, z in zip([0, *ends], ends, strict=False)]
            for i, b in zip(new, cut, strict=True):
                found[i] = b
            self.cache.put({k: b for k, b in zip([keys[i] for i in new], cut, strict=True) if len(k) <= LONGEST_CACHED})
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.uint32), sizes

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 64):
            out += [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids end. A null is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        hard = np.ones(len(texts), dtype=bool)
        if self.by_rule:
            hard[:] = False
            for content in self.added:
                hard |= np.asarray(pc.match_substring(texts, content))
        if not hard.any():
            return self._by_rule(texts)
        ids, ends = self._by_rule(pc.if_else(pa.array(hard), "", texts))
        whole = self._whole(texts.filter(pa.array(hard)).to_pylist())
        sizes = np.diff(ends, prepend=0)
        sizes[hard] = [len(w) for w in whole]
        at = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        from_rule = np.repeat(~hard, sizes)
        out[from_rule] = ids
        for a, w in zip(at[hard].tolist(), whole, strict=True):
            out[a : a + len(w)] = w
        return out, np.cumsum(sizes)

    def _by_rule(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        done = np.zeros(len(texts), dtype=np.int64)
        if offsets[0] == offsets[-1]:
            return np.zeros(0, dtype=np.uint32), done
        data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        raw = np.frombuffer(data, dtype=np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
        a = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), dtype=np.uint32)
        some = np.flatnonzero(np.diff(offsets))
        first = np.searchsorted(lead, offsets[some] - offsets[0])
        last = np.append(first[1:], len(a))
        begin = np.flatnonzero(self._cuts(a, first, last))
        cut = np.append(lead[begin], len(raw))
        tokens = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cut.astype(np.int64)), data).dictionary_encode()
        code = tokens.indices.to_numpy(zero_copy_only=False)
        pool, sizes = self._ids_of(tokens.dictionary)
        took = sizes[code]
        ends = np.cumsum(took)
        at = np.arange(int(ends[-1])) + np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - took), took)
        of_text = np.searchsorted(begin, np.append(first[1:], len(a)))  # pre-tokens up to the end of each text
        done[some] = ends[of_text - 1]
        return pool[at], np.maximum.accumulate(done)


@lru_cache(maxsize=1)
def encoder(path: str | None = None, special: bool = True) -> Encoder:
    """The worker's encoder; path: a tokenizer file, by default the public byte-level BPE of 50k entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Encoder(path, special)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after those of each text, and where each text ends then."""
    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
