"""Language identification of mixed texts.

Unicode script ranges narrow the candidate languages of each word; words are scored by a naive
Bayes model over their character n-grams; a Viterbi pass with a switching penalty labels spans.
The text's language is that of most of its letters. A word is a run of letters of one script, 40 at
most: longer runs, such as sentences without spaces, are cut where the script changes and after each
40 letters, and every piece is scored, labelled and counted in spans as a word of its own.

The model is fitted on a bounded sample: at most sample_docs documents of each language, by the
smallest hash of the id, and of each at most sample_words words (both are parameters). All texts
are labelled whole. A text that is null or has no letter gives `und`, score 0 and no spans; a
text in a script that no learned language uses gets the most frequent language with a low score.
With one learned language every text in its scripts is in it. Without any labelled document that has
a word every text is `und`. A letter is what Unicode calls one (marks go with their letters, number signs
are none). Repeated rows are rows of their own; of languages with equally many letters the more frequent
one in the sample counts, then the first by name. Further columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.llm.common import fields, free_names, pieces, tidy

_PLAIN = re.compile("[A-Za-z]+")
BUCKETS = 1 << 17
FLOOR = -30.0

#: First and last code point of the letters of a script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_NAMES = sorted({n for n, _, _ in SCRIPTS})
_STARTS = np.array([a for _, a, _ in SCRIPTS])
_ENDS = np.array([z for _, _, z in SCRIPTS])
_SCRIPT_OF = np.array([_NAMES.index(n) for n, _, _ in SCRIPTS])
OTHER = len(_NAMES)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The number of the script of each code point; OTHER outside all ranges."""
    i = np.searchsorted(_STARTS, points, side="right") - 1
    inside = (i >= 0) & (points <= _ENDS[np.maximum(i, 0)])
    return np.where(inside, _SCRIPT_OF[np.maximum(i, 0)], OTHER)


_P = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 48)], dtype=np.uint64)
_LONGEST = 40


def _script_pieces() -> re.Pattern:
    """At most _LONGEST letters of one script; letters outside all ranges go on with any."""
    ranges = {n: "".join(f"{chr(a)}-{chr(z)}" for m, a, z in SCRIPTS if m == n) for n in _NAMES}
    no = "[^" + "".join(ranges.values()) + "]"
    kinds = [rf"(?={no}{{0,{_LONGEST - 1}}}[{own}])(?:[{own}]|{no}){{1,{_LONGEST}}}" for own in ranges.values()]
    return re.compile("|".join([*kinds, rf"{no}{{1,{_LONGEST}}}"]))


_PIECE = _script_pieces()


@lru_cache(1)
def _word() -> re.Pattern:
    """A run of Unicode letters and the marks on them, with a letter at least."""
    kinds = "".join({"L": "L", "M": "M"}.get(unicodedata.category(chr(p))[0], " ") for p in range(sys.maxunicode + 1))
    ranges = {k: "".join(f"{re.escape(chr(m.start()))}-{re.escape(chr(m.end() - 1))}" for m in re.finditer(f"{k}+", kinds)) for k in "LM"}
    return re.compile(f"[{ranges['M']}]*[{ranges['L']}][{ranges['L']}{ranges['M']}]*")


@lru_cache(1 << 16)
def _cut(run: str) -> list[str]:
    return _PIECE.findall(run)


def letter_runs(text: str) -> list[str]:
    """The words of a text: its runs of letters, cut where the script changes and after each 40 letters."""
    found = (_PLAIN if text.isascii() else _word()).findall(text)
    if max(map(len, found), default=0) <= _LONGEST and text.isascii():
        return found
    out: list[str] = []
    for w in found:
        if len(w) <= _LONGEST:
            if w.isascii():
                out.append(w)
            else:
                out += _cut(w)
        else:
            out += _PIECE.findall(w)  # too many kinds, and too long, to keep
    return out


class Grams:
    """Buckets of the 1- to 4-grams of some words, ends marked, and of the words as wholes.

    All words stand in one array of code points; buckets has a row for each gram length (the last
    for whole words) and a column for each place, -1 where no gram of the word begins.
    """

    def __init__(self, words: list[str]):
        line = "".join([f"<{w}>" for w in words]).lower()
        a = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.start = np.flatnonzero(a == ord("<"))
        size = np.diff(np.append(self.start, len(a)))
        left = np.repeat(size, size) - (np.arange(len(a)) - np.repeat(self.start, size))  # characters from here to the word's end
        self.buckets = np.full((5, len(a)), -1, dtype=np.int64)
        h = np.zeros(len(a), dtype=np.uint64)
        for n in range(4):
            h[: len(a) - n] += a[n:] * _P[n]
            self.buckets[n] = np.where(left > n, _bucket(h, n), -1)
        within = np.arange(len(a)) - np.repeat(self.start, size)
        whole = np.add.reduceat(a * _P[np.minimum(within, len(_P) - 1)], self.start)
        self.buckets[4, self.start] = _bucket(whole, 4)
        self.count = np.add.reduceat((self.buckets >= 0).sum(axis=0), self.start)
        self.script = np.minimum.reduceat(scripts_of(a.astype(np.int64)), self.start)  # that of the letters inside a range

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each word the sum of values [bucket, label] over its grams; the last row of values belongs to bucket -1."""
        total = np.zeros((self.buckets.shape[1], values.shape[1]), dtype=np.float32)
        for row in self.buckets:
            total += values[row]
        return np.add.reduceat(total, self.start, axis=0)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    x = (h + np.uint64(n + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """languages, log-probabilities [bucket, language], prior, and the scripts each language uses."""

    def __init__(self, languages, log_p, prior, scripts):
        self.languages, self.log_p, self.prior, self.scripts = languages, log_p, prior, scripts

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language: 0 for the best, and at least FLOOR.

        Languages that don't use the word's script get FLOOR; where no language does, all get 0.
        """
        return self._scored(words)[0]

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and which languages use each word's script."""
        g = Grams(words)
        s = g.sums(self.log_p) / np.sqrt(g.count)[:, None]
        allowed = self.scripts[:, g.script].T
        s = np.where(allowed, s - np.where(allowed, s, -np.inf).max(axis=1, keepdims=True, initial=-1e9), FLOOR)
        s[~allowed.any(axis=1)] = 0.0
        return np.maximum(s, FLOOR), allowed

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code of each word; by code the scores, and whether any language uses the word's script."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        scores, allowed = self._scored(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return coded.indices.to_numpy(zero_copy_only=False), scores, allowed.any(axis=1)


def fit(rows: list[tuple[str, list[str]]], power: float = 0.75) -> Model | None:
    """A model from (language, words) rows; languages without a word aren't learned.

    A word that comes n times counts n ** power times, so that a few words don't make up the whole model.
    """
    rows = [r for r in rows if r[1]]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    counts = np.full((BUCKETS, len(languages)), 0.05)
    prior = np.zeros(len(languages))
    seen = np.zeros((len(languages), OTHER + 1))
    by_language = [Counter() for _ in languages]
    for lang, words in rows:
        i = languages.index(lang)
        prior[i] += 1
        by_language[i].update(words)
    for i, words in enumerate(by_language):
        if not words:
            continue
        g = Grams(list(words))
        n = np.fromiter(words.values(), dtype=np.float64, count=len(words))
        weight = np.repeat(n**power, np.diff(np.append(g.start, g.buckets.shape[1])))
        for row in g.buckets:
            counts[:, i] += np.bincount(row[row >= 0], weights=weight[row >= 0], minlength=BUCKETS)
        seen[i] = np.bincount(g.script, weights=n, minlength=OTHER + 1)
    log_p = np.log(counts) - np.log(counts.sum(axis=0))
    log_p = np.concatenate([log_p, np.zeros((1, len(languages)))]).astype(np.float32)  # bucket -1: no gram
    share = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
    return Model(languages, log_p, prior / prior.sum(), share >= 0.01)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float, block: int | None = None) -> np.ndarray:
    """The best label of each word: sum of scores less penalty for each change, for each text on its own.

    scores [words, labels]; text i has words bounds[i] to bounds[i + 1]. All texts advance together
    in blocks of words: first a block's best score from each entry to each exit label, in lockstep over all
    blocks; then the blocks of each text are joined, which gives each block's entry; from there the
    best way through each block is found again, with its path. Blocks are longer the more labels there
    are, so that memory is that of the scores, twice or so.
    """
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int16)
    if not n:
        return labels
    block = block or max(32, k * k // 2)
    sizes = np.diff(bounds)
    n_blocks = -(-sizes // block)
    text_of = np.repeat(np.arange(len(sizes)), n_blocks)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = bounds[text_of] + nth * block
    length = np.minimum(block, bounds[text_of + 1] - start)
    b = len(start)
    longest = int(length.max())
    # best[block, entry, exit]; entry is the label ahead of the block
    best = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (b, k, k)).copy()
    for t in range(longest):
        on = np.flatnonzero(length > t)
        stay = best[on]
        best[on] = np.maximum(stay, stay.max(axis=2, keepdims=True) - penalty) + scores[start[on] + t][:, None, :]
    # forward over the blocks of each text, and back
    first_of = np.concatenate([[0], np.cumsum(n_blocks)])[:-1]
    some = np.flatnonzero(n_blocks)
    value = np.zeros((len(sizes), k))
    via = np.zeros((b, k), dtype=np.int64)
    for j in range(int(n_blocks.max())):
        on = some[n_blocks[some] > j]
        at = first_of[on] + j
        step = value[on][:, :, None] + best[at]
        via[at] = step.argmax(axis=1)
        value[on] = step.max(axis=1)
    del best
    entry, state = np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64)
    now = value.argmax(axis=1)
    for j in range(int(n_blocks.max()) - 1, -1, -1):
        on = some[n_blocks[some] > j]
        at = first_of[on] + j
        state[at] = now[on]
        entry[at] = now[on] = via[at, now[on]]
    # through each block once more, from its own entry
    own = np.full((b, k), -np.inf)
    own[np.arange(b), entry] = 0.0
    came = np.zeros((longest, b, k), dtype=np.int16)
    for t in range(longest):
        on = np.flatnonzero(length > t)
        stay = own[on]
        change = stay.max(axis=1, keepdims=True) - penalty
        came[t, on] = np.where(stay >= change, np.arange(k)[None, :], stay.argmax(axis=1)[:, None])
        own[on] = np.maximum(stay, change) + scores[start[on] + t]
    for t in range(longest - 1, -1, -1):
        on = np.flatnonzero(length > t)
        labels[start[on] + t] = state[on]
        state[on] = came[t, on, state[on]]
    return labels


def _labelled(sent, penalty, carry=(), names=()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for b in pieces(batches, "text", 1 << 20):
            found = [letter_runs(t) if t else [] for t in b.column("text").to_pylist()]
            sizes = np.array([len(f) for f in found])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            n = len(found)
            lang, score, letters_in = ["und"] * n, [0.0] * n, [sum(map(len, f)) for f in found] if carry else []
            spans: list[list] = [[] for _ in range(n)]
            if model is not None and bounds[-1]:
                words = [w for f in found for w in f]
                code, by_code, of_script = model.of_words(words)
                s = by_code[code].astype(np.float64)
                labels = viterbi(s, bounds, penalty)
                unique_size = np.zeros(len(by_code), dtype=np.int64)
                unique_size[code] = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                letters = unique_size[code]
                k = len(model.languages)
                text_of = np.repeat(np.arange(n), sizes)
                own = np.bincount(text_of * k + labels, weights=letters, minlength=n * k).reshape(n, k)
                known = of_script[code]
                sure = np.bincount(text_of[known], weights=letters[known], minlength=n)
                total = np.maximum(1, own.sum(axis=1))
                pick = (own + 1e-6 * model.prior[None, :]).argmax(axis=1)
                edge = np.flatnonzero(np.diff(labels, prepend=-1) | np.isin(np.arange(len(labels)), bounds[:-1]))
                ends = np.append(edge[1:], len(labels))
                for a, z in zip(edge.tolist(), ends.tolist(), strict=True):
                    i = int(text_of[a])
                    spans[i].append((model.languages[labels[a]], a - int(bounds[i]), z - int(bounds[i])))
                for i in np.flatnonzero(sizes):
                    lang[i] = model.languages[pick[i]]
                    score[i] = float(own[i, pick[i]] / total[i] * max(0.01, sure[i] / total[i]))
            if carry:
                yield pa.record_batch([*(b.column(c) for c in carry), pa.array(lang), pa.array(score, pa.float64()), pa.array(letters_in, pa.int64())], names=[*carry, *names])
                continue
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
            rows = [[dict(zip(("lang", "first_word", "end_word"), x, strict=True)) for x in own_spans] for own_spans in spans]
            yield pa.record_batch(
                [b.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64()), pa.array(rows, kind)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return run


def train(labelled: DataFrame, sample_docs: int = 400, sample_words: int = 2000) -> Model | None:
    """Fit on documents (doc_id, text, lang) with a language: a bounded sample of each language."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    # hashes up to a bound that takes about twice the sample, then the exact cut by rank in that small rest; where
    # repeated ids leave too few, a greater bound
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    draw = F.xxhash64("doc_id")
    words = F.slice(F.split("text", r"\s+", sample_words + 1), 1, sample_words)
    taken: dict[str, list] = {}
    wanted = {lang: -(-(2 * sample_docs << 64) // n) for lang, n in sizes.items()}  # of the 2^64 hashes
    while wanted:
        keep = F.lit(False)
        for lang, share in wanted.items():
            keep = keep | ((F.col("lang") == lang) & (draw <= F.lit(min(share, 1 << 64) - (1 << 63) - 1)))
        sample = rows.where(keep).groupBy("lang", draw.alias("draw")).agg(F.min(F.struct("doc_id", words.alias("words"))).alias("one"))  # one of equal ids
        taken |= {lang: [] for lang in wanted}
        for r in sample.toLocalIterator():
            taken[r["lang"]].append((r["draw"], r["one"]["doc_id"] or 0, r["one"]["words"]))
        wanted = {lang: 8 * share for lang, share in wanted.items() if len(taken[lang]) < sample_docs and share < 1 << 64}
    out = []
    for lang, own in taken.items():
        own.sort(key=lambda x: x[:2])
        out += [(lang, letter_runs(" ".join(words))) for _, _, words in own[:sample_docs]]
    return fit(out)


def identify(docs: DataFrame, model: Model | None, penalty: float = 6.0, carry: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language) and spans (lang, first_word, end_word); no shuffle.

    With carry, those columns (text among them) and, under three names that they don't have, the language, the
    score and how many letters there are instead.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    if carry:
        names = names or free_names(carry, "lang_pred", "score", "letters")
        schema = f"{fields(docs.select(*carry).schema)}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` bigint"
        return docs.select(*carry).mapInArrow(tidy(_labelled(sent, penalty, tuple(carry), tuple(names))), schema)
    return docs.select("doc_id", "text").mapInArrow(
        tidy(_labelled(sent, penalty)), "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,first_word:int,end_word:int>>"
    )
