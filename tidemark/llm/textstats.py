"""Per-document text statistics, and rules that tell prose and program source from lists, tables, dumps and junk.

Each document is read once, whole, where it lies; there is no exchange. There are three kinds of statistics:

* of the words: number, mean length, shares of symbols, digits, vowels and common words, share of lines that end in punctuation;
* of repetition: shares of duplicate lines and paragraphs, the part of the words' characters that the most frequent 2-, 3- and
  4-gram cover and that all 5-grams cover that occurred before, and the part of all characters in stretches that repeat with a
  period of up to ``PERIOD`` characters;
* of the lines: the shares of the characters in list items, table rows, log and hex lines, encoded blobs and lines of source.

``verdict`` combines them. A form of line alone decides nothing where another statistic speaks against it: items
that wrap or read as sentences are terms of a text, separated values in running words are enumerations, stars in
source are comments, blobs and repetitions in source are literals. Random text is told by its words alone.
"""

from __future__ import annotations

import re
from collections import Counter
from types import SimpleNamespace
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Common words of English, German and Spanish.
COMMON_WORDS = frozenset(
    """a about after all an and another any are as at be because been but by can could do each even every for from
    had has have he her his how i if in into is it its may might more most must no not of on one or other our out
    over shall she should so some such than that the their them then there these they this those to under until up
    was we were what when where whether which while who will with without would you your
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer eines er es für hat
    ich im ist jede jeder jedes kein keine mit nach nicht noch nur obwohl oder ohne sich sie sind über um und uns
    unser von vor war weil wenn wie wir zu zum zur
    al ante aunque como con cuando de del desde donde el ella en entre es esta este ha hasta hay la las le lo los
    mas más muy ni o para pero por porque que se si sin sobre son su sus también un una uno y ya""".split()
)

# The kinds of lines, tried in this order on the line without outer white space.
_LINE = re.compile(
    r"""(?P<hex>(?:0x)?[0-9a-fA-F]{4,16}[:\s]\s*(?:[0-9a-fA-F]{2,8}\s+){3,}|(?:[0-9a-fA-F]{2}[\s:]){7,}[0-9a-fA-F]{2}\b)
    |(?P<log>\[?(?:\d{4}[-/]\d\d[-/]\d\d[T\s]\d\d:\d\d|\d{10}(?:\.\d+)?\s|\d\d:\d\d:\d\d|[A-Z][a-z]{2}\s+\d\d?\s\d\d:\d\d:\d\d)|<\d+>|(?:\d{1,3}\.){3}\d{1,3}\s.*\[)
    |(?P<pipe>\|.*\|$|\+[-=+]{5,}\+$)
    |(?P<blob>[A-Za-z0-9+/_-]{32,}={0,2}$)
    |(?P<item>(?:[-*+•·‣◦–]|\(?\d{1,6}[.)]|\(?[a-zA-Z][.)]|\[[\sx]\])\s+\S.*(?<![;{}=:])$)
    |(?P<lock>[\w.@/-]+(?:\s|\s?[=@>]=?\s?)v?\d+\.\d+(?:\.\d+)?\S*(?:\s+[0-9a-zA-Z:/+=-]{8,})*\s*$)
    |(?P<word>[^\W\d_][\w.'-]*[,;]?$)
    """,
    re.X | re.S,
)
_GAP = re.compile(r"[ ]{2,}|\t+[ ]*")
_SEPARATORS = (",", ";", "\t", "|")
_QUOTED = re.compile(r'"[^"]*"')
_NESTED = re.compile(r"[{}\[\]<>]|\w\(|\b0x")
_WORD = re.compile(r"\w+")
_ENDS = (".", "!", "?", '"', "'", "…", ":", ";", ")", "”", "。")
_VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûåæøœаеиоуыэюяαεηιουω"
_CODE = re.compile(r"^(?:\}|</?\w)|[\w\])]\s{0,8}[-+*/]?=\s{0,8}\S|\w\([^)]{0,200}\)\s{0,8}[;{:]?$|0x[0-9a-fA-F]{1,16}\w?,|^[-\d.,\s]+,$")
_KEYWORD = re.compile(r"(?:def|class|return|import|from|if|for|while|func|fn|let|var|const|static|public|package|use|using|#include|SELECT|INSERT|CREATE|UPDATE)\b")
_YAML = re.compile(r"^\s*(?:-\s+)?[\w.\"'/-]+\s*:(?:\s|$)", re.M)

#: The longest period of repeated characters, and the least length of a stretch of them.
PERIOD, STRETCH = 4, 9


def _cells(line: str) -> tuple[str, int] | None:
    """The separator and the number of cells of a line that may be a row of separated values."""
    if '"' in line:
        line = _QUOTED.sub("q", line)
    for sep in _SEPARATORS:
        n = line.count(sep)
        if n:
            return None if _NESTED.search(line) else (sep, n)
    return None


#: Kinds of lines that may be source.
_OPEN_KINDS = frozenset(("text", "word", "aligned", "item"))


def _is_code(x: str) -> bool:
    """Whether a line looks like source. The search is made only where a character that it needs is there."""
    if x[-1] in ";{}" or _KEYWORD.match(x):
        return True
    return ("=" in x or "(" in x or "0x" in x or x[0] in "}<" or x[-1] == ",") and _CODE.search(x) is not None


def _kind(s: str) -> str:
    m = _LINE.match(s)
    if m:
        kind = m.lastgroup
        if kind == "blob" and (s.isalpha() and (s.islower() or s.isupper()) or s.count("_") + s.count("-") > len(s) / 10):
            return "text"
        return kind
    if ("  " in s or "\t" in s) and len(_GAP.split(s)) >= 3:
        return "aligned"
    return "text"


def _classes() -> np.ndarray:
    """For each code point up to the last Cyrillic letter, and one more for all beyond: bits for white space, digit, letter with vowels, vowel, control."""
    out = np.zeros(0x501, np.int8)
    for bit, chars in enumerate((" \n\t\r", "0123456789", "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0x250), *range(0x370, 0x500)])), _VOWELS, "".join(map(chr, [*range(9), *range(14, 32), 127])))):
        out[[ord(c) for c in chars]] |= 1 << bit
    return out


_CLASS = _classes()
_SPACE, _DIGIT, _LETTER, _VOWEL, _CONTROL = range(5)
#: (5, 32): which sets of bits have each bit.
_HAS = np.array([[k >> bit & 1 for k in range(32)] for bit in range(5)])


def _periodic(c: np.ndarray) -> float:
    """The share of the characters in stretches of at least ``STRETCH`` that repeat with a period of up to ``PERIOD``."""
    if len(c) < STRETCH:
        return 0.0
    inside = None
    for p in range(1, PERIOD + 1):
        same = np.zeros(len(c) - p + 2, np.int8)
        np.equal(c[p:], c[:-p], out=same[1:-1].view(bool))
        edges = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edges[::2], edges[1::2] + p
        long = end - begin >= max(STRETCH, 3 * p)
        if long.any():
            if inside is None:
                inside = np.zeros(len(c) + 1, np.int32)
            np.add.at(inside, begin[long], 1)
            np.subtract.at(inside, end[long], 1)
    return 0.0 if inside is None else float((np.cumsum(inside)[:-1] > 0).mean())


def _grams(words: list[str]) -> tuple[float, float, float, float]:
    """Shares of the characters of all words that lie in the 2-, 3- and 4-gram covering most of them (occurring at least twice), and in 5-grams that have occurred before."""
    out = [0.0, 0.0, 0.0, 0.0]
    if len(words) < 4:
        return tuple(out)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return tuple(out)
    ids = np.array(list(map(number.__getitem__, words)), np.uint64)
    size = np.array(list(map(len, number)), np.int64)[ids.astype(np.int64)]
    ends = np.r_[0, np.cumsum(size)]
    key = ids
    with np.errstate(over="ignore"):
        for n in range(2, 6):
            if len(words) < n:
                break
            key = (key[:-1] ^ (key[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[n - 1 :]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            many = count > 1
            if not many.any():
                break  # nor does any longer one repeat
            if n < 5:
                out[n - 2] = min(1.0, float((count[many] * (ends[first[many] + n] - ends[first[many]])).max() / ends[-1]))
            else:
                again = np.ones(len(key), np.int64)
                again[first] = 0
                out[3] = float(size[np.convolve(again, np.ones(n, np.int64)) > 0].sum() / ends[-1])
    return tuple(out)


def _duplicates(parts: list[str]) -> float:
    """The share of the characters that lie in repeats of a part that came before."""
    if len(set(parts)) == len(parts):
        return 0.0
    total = sum(map(len, parts))
    return sum((n - 1) * len(p) for p, n in Counter(parts).items() if n > 1) / total


FIELDS = {
    "n_chars": "bigint", "n_words": "bigint", "n_lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "vowel_ratio": "double",
    "control_ratio": "double", "punctuated_lines": "double", "common_words": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double",
    "top_2gram": "double", "top_3gram": "double", "top_4gram": "double", "repeated_5grams": "double", "periodic_share": "double",
    "item_share": "double", "item_words": "double", "word_list_share": "double", "lock_share": "double", "row_share": "double", "cells_share": "double", "aligned_share": "double",
    "log_share": "double", "blob_share": "double", "source_share": "double", "config_share": "double", "not_prose": "boolean",
}

#: From this share of common words on a text has a voice: it is written in sentences.
VOICE = 0.15
#: Shares of source lines from which encoded blobs, and other forms and repetitions, are parts of a program.
EMBEDDED, PROGRAM = 0.1, 0.3


def verdict(s: SimpleNamespace) -> bool:
    """Whether more than half of a text with these statistics is a list, table, dump or junk."""
    voice, program, config = s.common_words >= VOICE, s.source_share >= PROGRAM, s.config_share > 0.3
    listed = 0.0
    if not config:
        listed = s.lock_share + s.word_list_share
        # items of a text in sentences that are sentences themselves are its numbered terms; in source they are comments
        if not (voice and (s.source_share >= EMBEDDED or s.item_words >= 15 and s.punctuated_lines >= 0.5)):
            listed += s.item_share
    table = s.row_share
    if not program and not config:
        # enumerations in running words aren't rows, nor are gaps between them, unless figures stand in between
        table += (0.0 if voice else s.cells_share) + (0.0 if voice and s.digit_ratio < 0.08 else s.aligned_share)
    repeated = 0.0
    if not program and not config:
        # periods cover their own characters only; a passage that makes up half of a text makes all of it repetition
        whole = max(s.duplicate_lines, s.duplicate_paragraphs, s.top_2gram, s.top_3gram, s.top_4gram, s.repeated_5grams)
        repeated = max(s.periodic_share, whole if whole > 0.5 else 0.0)
    blob = s.blob_share if s.source_share < EMBEDDED else 0.0
    form = listed + table + s.log_share + blob
    # no known form and no source: signs instead of words, words without vowels, or characters that aren't text
    signs = s.symbol_ratio > 0.3 and s.source_share < PROGRAM and not config
    mute = s.vowel_ratio < 0.15 and s.n_words >= 4 and s.source_share < PROGRAM and not config
    random = mute or signs or s.control_ratio > 0.02
    return bool(form + repeated > 0.5 or random and s.n_chars >= 16)


def measures(text: str) -> SimpleNamespace:
    """The statistics of one text."""
    lower = text.lower()
    words = _WORD.findall(lower)
    total, n_words, n = sum(map(len, words)), len(words), max(1, len(text))
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind_of = _CLASS[np.minimum(points, 0x500)]
    counts = (_HAS @ np.bincount(kind_of, minlength=32)).tolist()
    letters = counts[_LETTER]
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    kinds = [_kind(x) for x in lines]
    chars, number = Counter(), Counter(kinds)
    for k, x in zip(kinds, lines, strict=True):
        chars[k] += len(x)
    body = max(1, sum(chars.values()))
    code = [k in _OPEN_KINDS and _is_code(x) for k, x in zip(kinds, lines, strict=True)]
    source = sum(len(x) for k, x, c in zip(kinds, lines, code, strict=True) if c and k in ("text", "word", "aligned"))
    # an item that goes on in the next line is the beginning of a paragraph
    whole = []
    if number["item"]:
        whole = [x for k, x, after, stop in zip(kinds, lines, [*kinds[1:], ""], [*lines[1:], ""], strict=True) if k == "item" and not (after == "text" and stop[:1].islower())]
    # separated values: one number of cells for most of the lines that may be rows
    shapes: Counter = Counter()
    size: Counter = Counter()
    for k, x, c in zip(kinds, lines, code, strict=True):
        if k == "text" and not c and (shape := _cells(x)):
            shapes[shape] += 1
            size[shape] += len(x)
    cells = certain = 0
    if shapes:
        shape, rows = shapes.most_common(1)[0]
        if rows >= 5 and shape[1] > 1 and rows >= 0.9 * len(lines):
            certain = size[shape]  # running words don't keep this up
        elif rows >= 3 and rows >= (0.6 if shape[1] > 1 else 0.9) * max(sum(shapes.values()), number["text"] / 2):
            cells = sum(size.values())
    aligned = sum(len(x) for k, x, c in zip(kinds, lines, code, strict=True) if k == "aligned" and not c)
    top = _grams(words)
    share = lambda x: x / body
    return SimpleNamespace(
        n_chars=len(text), n_words=n_words, n_lines=len(lines), mean_word_length=total / n_words if n_words else 0.0,
        symbol_ratio=max(0, len(text) - counts[_SPACE] - total) / n, digit_ratio=counts[_DIGIT] / n,
        vowel_ratio=counts[_VOWEL] / letters if 2 * letters > total else 1.0, control_ratio=(counts[_CONTROL] + text.count("\ufffd")) / n,
        punctuated_lines=sum(x.endswith(_ENDS) for x in lines) / max(1, len(lines)), common_words=sum(map(COMMON_WORDS.__contains__, words)) / max(1, n_words),
        duplicate_lines=_duplicates(lines), duplicate_paragraphs=_duplicates([q.strip() for q in re.split(r"\r?\n\s*\n", text) if q.strip()]),
        top_2gram=top[0], top_3gram=top[1], top_4gram=top[2], repeated_5grams=top[3], periodic_share=_periodic(points[kind_of & 1 == 0]),
        item_share=share(sum(map(len, whole))), item_words=sum(len(x.split()) for x in whole) / max(1, len(whole)),
        word_list_share=share(chars["word"]) if number["word"] >= 5 and number["word"] > 0.5 * len(lines) else 0.0, lock_share=share(chars["lock"]),
        row_share=share(chars["pipe"] + certain), cells_share=share(cells), aligned_share=share(aligned),
        log_share=share(chars["hex"] + chars["log"]), blob_share=share(chars["blob"]), source_share=share(source),
        config_share=len(_YAML.findall(text)) / max(1, len(lines)) if ":" in text else 0.0,
    )


def statistics(text: str) -> tuple:
    """The values of ``FIELDS`` for one text."""
    s = measures(text)
    return (*(getattr(s, f) for f in FIELDS if f != "not_prose"), verdict(s))


def text_statistics(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its key and the columns of ``FIELDS``; ``not_prose`` marks lists, tables, dumps and junk.

    Nulls: a null text counts as empty, and an empty text has zeros everywhere and isn't marked; a null key is
    kept. Repeated rows give repeated rows. Texts are read whole whatever their length. Empty input gives no
    rows; further columns, also of the names above, are ignored.
    """
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x or "") for x in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, kinds[k]) for c, k in zip(columns, FIELDS.values(), strict=True))], [key, *FIELDS])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items()))
