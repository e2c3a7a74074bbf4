"""Columns over text: normalization, tokens, n-grams and their 64-bit identities.

Everything is a built-in expression but normalization, the shingles of
characters and hashing with another seed than 42, which go through Arrow.
"""

from __future__ import annotations

import hashlib
import importlib.util
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quern.errors import HashingError

WHITE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"
WORD = r"[\p{L}\p{N}_]+"
SEPARATOR = "\x1f"
_SPELT = 32  # length up to which n-grams are joined element by element
SPARK_SEED = 42  # the one that xxhash64 of Spark has


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def strip_html(text: str) -> str:
    """The text between tags, entities decoded, comments dropped; nothing is put where a tag was."""
    if "<" not in text and "&" not in text:
        return text
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.found)


_SPACES = re.compile(r"\s+")


def normalize_text(text: str, nfkc: bool = True, lower: bool = True, html: bool = True, collapse: bool = True, strip: bool = True) -> str:
    """One text, in this order: NFKC, lower case, markup, white space, ends."""
    if nfkc:
        text = unicodedata.normalize("NFKC", text)
    if lower:
        text = text.lower()
    if html:
        text = strip_html(text)
    if collapse:
        text = _SPACES.sub(" ", text)
    return text.strip() if strip else text


_PART = 1 << 18  #: bytes of text that a worker holds as Python strings, or as code points, at a time; a longer text alone


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole rows of at most ``_PART`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = before = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, before + _PART, side="right")))
        yield texts[lo:hi]
        lo, before = hi, ends[hi - 1]


def _normalized(text: str) -> str:
    """As :func:`normalize_text` with its defaults: what splits on white space and is joined is collapsed and stripped."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(strip_html(text.lower()).split())


@F.arrow_udf(StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else _normalized(t) for t in part.to_pylist()], pa.string()) for part in _parts(texts))])


def normalize(text: Column) -> Column:
    """Normalized text; null stays null."""
    return _normalize(text)


def plain_normalize(text: Column) -> Column:
    """The steps that Spark has itself: lower case, white space, ends. Equal to :func:`normalize` where NFKC and markup don't matter."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE + "+", " "))


def cjk_ratio(text: Column) -> Column:
    """Part of the characters other than white space that are CJK; 0 where there are none."""
    all_ = F.length(F.regexp_replace(text, WHITE, ""))
    return F.coalesce(F.length(F.regexp_replace(text, "(?!" + CJK + r")[\s\S]", "")) / F.nullif(all_, F.lit(0)), F.lit(0.0))


def is_cjk(text: Column, threshold: float = 0.2) -> Column:
    return cjk_ratio(text) >= threshold


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def char_tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def sentence_tokens(text: Column) -> Column:
    """Sentences, cut behind . ! ? and white space, and at the control character U+0001, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\x01"), F.trim), lambda s: s != "")


def tokens(text: Column, mode: str, cjk_threshold: float | None = None) -> Column:
    """Tokens by ``mode`` (char, word or sentence); with a threshold, text that is CJK from it on is cut into characters instead of words."""
    if mode == "char":
        return char_tokens(text)
    if mode == "sentence":
        return sentence_tokens(text)
    if mode != "word":
        raise ValueError(f"mode has to be 'char', 'word' or 'sentence', not {mode!r}")
    if cjk_threshold is None:
        return word_tokens(text)
    return F.when(is_cjk(text, cjk_threshold), char_tokens(text)).otherwise(word_tokens(text))


def ngrams(toks: Column, k: int) -> Column:
    """Runs of k tokens; all tokens as one where there are fewer, nothing where there are none."""
    if k < 1:
        raise ValueError(f"k has to be at least 1, not {k}")

    def of(t: Column) -> Column:
        n = F.size(t)
        if k <= _SPELT:  # no array is made for each n-gram
            many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws(SEPARATOR, *(F.get(t, i + j) for j in range(k))))
        else:
            many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), SEPARATOR))
        return F.when(n >= k, many).when(n > 0, F.array(F.array_join(t, SEPARATOR))).otherwise(F.array().cast("array<string>"))

    # the tokens are bound to a variable: named in the inner function they would be made anew for every n-gram
    return F.get(F.transform(F.array(toks), of), F.lit(0))


def stable_hash64(text: str, seed: int = SPARK_SEED) -> int:
    """XXH64 of the UTF-8 bytes, unsigned."""
    import xxhash

    if not isinstance(text, str):
        raise HashingError(f"only text can be hashed, not {type(text).__name__}")
    return xxhash.xxh64_intdigest(text.encode(), seed)


def _hash_all(seed: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(lists: pa.Array) -> pa.Array:
        import xxhash

        digest = xxhash.xxh64_intdigest
        values = np.array([digest(g.encode(), seed) for g in lists.flatten().to_pylist()], np.uint64).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return run


def hashed(grams: Column, seed: int = SPARK_SEED) -> Column:
    """XXH64 of every element, as two's complement. With seed 42 this is Spark's own function."""
    return F.transform(grams, lambda g: F.xxhash64(g)) if seed == SPARK_SEED else _hash_all(seed)(grams)


def portable_hashed(grams: Column) -> Column:
    """60-bit identities that any SQL engine with MD5 can make."""
    return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("long"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every row of a (rows, length) table of bytes, of fewer than 32 columns."""
    n, length = rows.shape
    h = np.full(n, (seed + int(_P5) + length) % (1 << 64), np.uint64)
    at = 0
    for at in range(0, length - 7, 8):
        h = _turned(h ^ _turned(rows[:, at : at + 8].copy().view("<u8").ravel() * _P2, 31) * _P1, 27) * _P1 + _P4
    at = length // 8 * 8
    if length - at >= 4:
        h = _turned(h ^ rows[:, at : at + 4].copy().view("<u4").ravel().astype(np.uint64) * _P1, 23) * _P2 + _P3
        at += 4
    for at in range(at, length):
        h = _turned(h ^ rows[:, at].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _gram_hashes(grams: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of n-grams, a row of code points each, joined by ``SEPARATOR`` as UTF-8."""
    n, k = grams.shape
    out = np.zeros(n, np.uint64)
    plain = grams.max(axis=1) < 128
    rows = np.full((int(plain.sum()), 2 * k - 1), ord(SEPARATOR), np.uint8)
    rows[:, ::2] = grams[plain]
    out[plain] = xxh64_rows(rows, seed)
    other = np.flatnonzero(~plain)
    spelt = [SEPARATOR.join(map(chr, g)).encode() for g in grams[other].tolist()]
    length = np.array([len(x) for x in spelt], np.int64)
    for m in np.unique(length):
        own = np.flatnonzero(length == m)
        if m < 32:
            out[other[own]] = xxh64_rows(np.frombuffer(b"".join(spelt[i] for i in own), np.uint8).reshape(-1, m), seed)
        else:
            import xxhash

            out[other[own]] = [xxhash.xxh64_intdigest(spelt[i], seed) for i in own]
    return out


def _distinct_windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of k characters of each text: ``(texts' numbers, numbers of n-grams)`` once each, in the order of the texts, and the n-grams as rows of code points. Texts of fewer than k characters have none."""
    found = texts.to_pylist()
    length = np.array([len(t or "") for t in found], np.int64)
    points = np.frombuffer("".join(t or "" for t in found).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(points.max(initial=0)) + 1, bool)
    used[points] = True
    code, kinds = (np.cumsum(used) - 1)[points], int(used.sum())
    letters = np.flatnonzero(used).astype(np.uint32)
    windows = max(0, len(points) - k + 1)
    doc = np.repeat(np.arange(len(length)), length)
    whole = np.flatnonzero(doc[:windows] == doc[len(points) - windows :])
    if kinds**k * (len(length) + 1) < 1 << 62:  # text and n-gram are one number
        gram = np.zeros(windows, np.int64)
        for i in range(k):
            gram = gram * kinds + code[i : i + windows]
        both = _once(doc[whole] * kinds**k + gram[whole])
        seen, number = np.unique(both % max(1, kinds**k), return_inverse=True)
        return both // max(1, kinds**k), number, letters[seen[:, None] // kinds ** np.arange(k - 1, -1, -1) % max(1, kinds)] if len(seen) else np.zeros((0, k), np.uint32)
    gram, many = code[:windows], kinds
    for i in range(1, k):
        if many * kinds >= 1 << 62:  # what was found so far is numbered anew, so that no two n-grams get one number
            seen, gram = np.unique(gram, return_inverse=True)
            many = len(seen)
        gram, many = gram * kinds + code[i : i + windows], many * kinds
    _, first, number = np.unique(gram[whole], return_index=True, return_inverse=True)
    both = _once(doc[whole] * len(first) + number)
    return both // len(first), both % len(first), points[whole[first][:, None] + np.arange(k)]


def _once(numbers: np.ndarray) -> np.ndarray:
    """Sorted, without repetitions."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


@lru_cache
def _char_shingles(k: int, seed: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int64()))]
        for part in _parts(texts):
            doc, number, grams = _distinct_windows(part, k)
            values = _gram_hashes(grams, seed)[number]
            size = np.bincount(doc, minlength=len(part))
            few = pc.utf8_length(part).fill_null(0).to_numpy(zero_copy_only=False)
            short = np.flatnonzero((few > 0) & (few < k))
            if len(short):  # all of a short text is its only n-gram
                alone = np.concatenate([_gram_hashes(np.array([[ord(c) for c in part[int(i)].as_py()]], np.uint32), seed) for i in short])
                values = np.insert(values, (np.cumsum(size) - size)[short], alone)
                size[short] = 1
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.view(np.int64))))
        return pa.concat_arrays(out)

    return run


@lru_cache
def _char_shingle_counts(k: int):
    @F.arrow_udf(LongType())
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for part in _parts(texts):
            few = pc.utf8_length(part).fill_null(0).to_numpy(zero_copy_only=False)
            out.append(np.bincount(_distinct_windows(part, k)[0], minlength=len(part)) + ((few > 0) & (few < k)))
        return pa.array(np.concatenate(out).astype(np.int64))

    return run


def char_gram_counts(text: Column, k: int) -> tuple[Column, Column]:
    """How many runs of k characters a text has, and how many different ones; 0 for none and null."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n >= k, n - (k - 1)).otherwise(F.least(n, F.lit(1))).cast("long"), _char_shingle_counts(k)(text)


_WORDS, _WHITES, _CJKS = re.compile(r"\w+"), re.compile(WHITE), re.compile(CJK)  # \w: the letters, digits and underscores of WORD


def _word_grams(text: str, k: int, cjk_threshold: float | None) -> set[bytes]:
    """:func:`ngrams` of :func:`tokens` of mode word, once each, as UTF-8."""
    if cjk_threshold is not None and _cut(text, cjk_threshold):
        return {SEPARATOR.join(text[i : i + k]).encode() for i in range(max(1, len(text) - k + 1))} if text else set()
    w = _WORDS.findall(text)
    whole = SEPARATOR.join(w).encode()
    if len(w) <= k:
        return {whole} if w else set()
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == ord(SEPARATOR)).tolist()
    return {whole[a:z] for a, z in zip([0, *(e + 1 for e in ends)], [*ends[k - 1 :], len(whole)])}


def _cut(text: str, cjk_threshold: float) -> bool:
    """As :func:`is_cjk`."""
    if text.isascii():
        return cjk_threshold <= 0
    dense = len(text) - len(_WHITES.findall(text))
    return (len(_CJKS.findall(text)) / dense if dense else 0.0) >= cjk_threshold


def _lists(texts: pa.Array, make) -> pa.Array:
    """An array of 64-bit identities for every text; a null text counts as empty."""
    found = [make(t or "") for part in _parts(texts) for t in part.to_pylist()]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


@lru_cache
def _portable_word_shingles(k: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return _lists(texts, lambda t: _portable(_word_grams(t, k, None)))

    return run


@lru_cache
def _word_shingles(k: int, cjk_threshold: float, seed: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest as digest

        return _lists(texts, lambda t: np.array([digest(g, seed) for g in _word_grams(t, k, cjk_threshold)], np.uint64).view(np.int64))

    return run


@lru_cache
def _word_gram_counts(k: int, cjk_threshold: float):
    @F.arrow_udf(StructType([StructField("grams", LongType()), StructField("kinds", LongType())]))
    def run(texts: pa.Array) -> pa.Array:
        n, kinds = [], []
        for part in _parts(texts):
            for t in part.to_pylist():
                t = t or ""
                tokens = len(t) if _cut(t, cjk_threshold) else len(_WORDS.findall(t))
                n.append(max(tokens - k + 1, min(1, tokens)))
                kinds.append(len(_word_grams(t, k, cjk_threshold)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(kinds, pa.int64())], ["grams", "kinds"])

    return run


def word_gram_counts(text: Column, k: int, cjk_threshold: float) -> Column:
    """``(grams, kinds)``: how many n-grams of words (of characters where the text is CJK) a text has, and how many different ones; 0 for none and null."""
    return _word_gram_counts(k, cjk_threshold)(text)


def _portable(grams) -> np.ndarray:
    """The identities of :func:`portable_hashed`, sorted and once each."""
    return _once((np.frombuffer(b"".join([hashlib.md5(g).digest()[:8] for g in grams]), ">u8") >> np.uint64(4)).astype(np.int64))


def portable_word_shingles(text: Column, k: int) -> Column:
    """The set of a normalized text's n-grams of words by their portable identities, sorted; empty for a text without words and null."""
    return _portable_word_shingles(k)(text)


def shingles(text: Column, mode: str = "char", k: int = 5, cjk_threshold: float = 0.2, seed: int = SPARK_SEED) -> Column:
    """The set of a normalized text's shingle identities; empty for a text without tokens."""
    if mode == "char" and k <= 16:
        return _char_shingles(k, seed)(text)
    if mode == "word" and importlib.util.find_spec("xxhash"):
        return _word_shingles(k, cjk_threshold, seed)(text)
    return F.array_distinct(hashed(ngrams(tokens(text, mode, cjk_threshold), k), seed))


def without_words(toks: Column, stopwords: list[str]) -> Column:
    """Tokens but for stop words."""
    return F.filter(toks, lambda w: ~w.isin(stopwords)) if stopwords else toks


def with_placeholders(text: Column) -> Column:
    """URLs and runs of digits replaced by one sign each."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+", "<URL>"), r"\d+", "<NUM>")
