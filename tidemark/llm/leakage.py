"""Evaluation texts in training texts: rare n-gram seeds, then Smith-Waterman alignment.

The held-out set is stated and small; its texts are counted first (``MAX_CHARS``) and become an index that is built once and
broadcast, in blocks of ``BLOCK`` texts. The corpus streams past once (once a block), each document whole, with no exchange. Both sides
go through the same normalisation (layout, case, punctuation, markup, comment marks, quoting, escaping, look-alike letters).

A seed is an n-gram of an item's words that few items share; where a window of an item has too few rare ones,
all of its n-grams are seeds. A document and an item text with enough seeds close to each other on close
diagonals are aligned in the band of those diagonals (local alignment, gaps and mismatches at unit cost), so copies with
changed, added and dropped words are found. An alignment is then cut into passages (see ``qualifying``), and the pair
counts if one of them covers enough of the item's words with few enough edits.

Some 20 words of a passage have two edits at most, each of which breaks up to three 3-grams: 8 of 14 rare ones stay intact (``MIN_SEEDS``).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 3
#: An n-gram in at most so many item texts is rare.
RARE = 3
#: Rare seeds that each window of WINDOW words should have; else all n-grams of the window are seeds.
WINDOW, WINDOW_SEEDS = 20, 14
#: Seeds within REACH words of one another and DIAGONAL of one another's diagonals that call for an alignment.
MIN_SEEDS, REACH, DIAGONAL = 8, 40, 8
#: What makes a case: words of the item covered; what an edit costs if a match counts 1; the worth of a clean part of a text with more edits; edits in a row that end a passage.
MIN_WORDS, EDIT_COST, CLEAN, BREAK = 20, 7, 24, 5
#: Edits that the best MIN_WORDS words of a passage have at most, and the least score that an alignment with a passage has.
WINDOW_EDITS = MIN_WORDS // (EDIT_COST + 1)
MIN_SCORE = MIN_WORDS - 2 * WINDOW_EDITS - 1
#: The largest area that is aligned at once, in words of the item and diagonals.
MOST_ROWS, MOST_BAND = 4096, 1024
#: Item texts that a block of the index holds, and characters that all item texts may have.
BLOCK, MAX_CHARS = 20_000, 1 << 30

# Letters of other scripts that look like Latin ones, after decomposition and lower-casing.
LOOK_ALIKES = str.maketrans(
    dict(
        а="a", б="b", с="c", ԁ="d", е="e", һ="h", і="i", ј="j", ӏ="l", к="k", м="m", о="o", р="p", ԛ="q", г="r", ѕ="s", т="t", ѵ="v", ԝ="w", х="x", у="y", з="z", ь="b", в="b", н="h", п="n",
        α="a", γ="y", δ="d", ε="e", η="n", ι="i", κ="k", ν="v", ο="o", ρ="p", σ="o", τ="t", υ="u", ω="w", χ="x", ϲ="c", ϳ="j",
        ı="i", ȷ="j", ø="o", ł="l", đ="d", ħ="h", ɡ="g", ɑ="a", ß="ss", æ="ae", œ="oe",
    )
)
_TAGS = re.compile(r"</?(?:a|b|i|u|p|s|q|em|strong|code|pre|div|span|br|hr|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6]|blockquote|html|head|body|title|section|article|main|header|footer|nav|sup|sub|small|mark|kbd|samp|tt|font|center|img|link|meta|script|style|label)(?:\s[^<>]{0,400})?/?>", re.I)
_ESCAPES = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|[nrtfvb](?![a-z]{0,2}\\)|.)", re.S)
_NUMBERED = re.compile(r"^[ \t]*(?:[-+>#*/|;%]{1,3}[ \t]*)?\d{1,6}[ \t]*[|:│][ \t]?", re.M)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u202a-\u202e]")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t#/*>|;%-]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        at = int(code, 16)
        return chr(at) if at < 0x110000 and not 0xD800 <= at < 0xE000 else " "
    return " " if m.group(0)[1] in "nrtfvb" else m.group(0)[1]


def normal_words(text: str) -> list[str]:
    """The words of a text, apart from layout, case, punctuation, markup, comment marks, quoting, escaping and look-alike letters."""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAGS.sub(" ", text)
    if "\\" in text:
        text = _ESCAPES.sub(_unescape, text)
    if "|" in text or ":" in text or "│" in text:
        text = _NUMBERED.sub("", text)
    if "-\n" in text or "-\r\n" in text:
        text = _HYPHENATED.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(LOOK_ALIKES)
    return _WORD.findall(text.lower())


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return -1


class ItemIndex:
    """Seeds of a block of item texts: (item_id, words) pairs."""

    def __init__(self, texts: list[tuple[int, list[str]]]):
        self.vocabulary = _Vocabulary()
        self.items = [i for i, _ in texts]
        self.words = []
        for _, words in texts:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
            self.words.append(np.array([self.vocabulary[w] for w in words], np.int64))
        self.base = max(2, len(self.vocabulary) + 1)
        held = [self.grams(w) for w in self.words]
        count: dict[int, int] = defaultdict(int)
        for g in held:
            for x in np.unique(g):
                count[int(x)] += 1
        rows = []
        for k, g in enumerate(held):
            rare = np.array([count[int(x)] <= RARE for x in g], bool)
            keep = rare.copy()
            span = WINDOW - N + 1
            for i in range(max(1, len(g) - span + 1)):
                if rare[i : i + span].sum() < WINDOW_SEEDS:
                    keep[i : i + span] = True
            rows += [(int(g[p]), k, int(p)) for p in np.flatnonzero(keep)]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.seed, self.first = np.unique(table[:, 0], return_index=True)
        self.last = np.append(self.first[1:], len(table))
        self.text, self.at = table[:, 1], table[:, 2]

    def grams(self, words: np.ndarray) -> np.ndarray:
        """A number for each n-gram; negative where a word isn't in any item."""
        if len(words) < N:
            return np.zeros(0, np.int64)
        key = words[: len(words) - N + 1].copy()
        bad = key < 0
        for i in range(1, N):
            w = words[i : len(words) - N + 1 + i]
            bad |= w < 0
            key = key * self.base + w
        key[bad] = -1
        return key

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item texts, positions in them and positions in the document of all seeds that a document has."""
        g = self.grams(words)
        where = np.flatnonzero(g >= 0)
        none = np.zeros(0, np.int64)
        if not len(where) or not len(self.seed):
            return none, none, none
        i = np.searchsorted(self.seed, g[where])
        i[i == len(self.seed)] = 0
        ok = self.seed[i] == g[where]
        where, i = where[ok], i[ok]
        n = self.last[i] - self.first[i]
        if not n.sum():
            return none, none, none
        rows = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.text[rows], self.at[rows], np.repeat(where, n)

    def found(self, words: list[str]) -> dict[int, tuple[int, float]]:
        """The items that a document holds: item_id → (words covered, edits per word) of the longest passage found."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        text, at, doc = self.hits(ids)
        out: dict[int, tuple[int, float]] = {}
        if len(text) < MIN_SEEDS:
            return out
        order = np.lexsort((doc, text))
        text, at, doc = text[order], at[order], doc[order]
        edges = np.flatnonzero(text[1:] != text[:-1]) + 1
        for a, b in zip([0, *edges], [*edges, len(text)], strict=True):
            if b - a < MIN_SEEDS:
                continue
            k = int(text[a])
            for area in _clusters(doc[a:b], at[a:b]):
                span, rate = best_passage(self.words[k], ids, *area)
                if span > out.get(self.items[k], (0, 0.0))[0]:
                    out[self.items[k]] = (span, rate)
        return out


def _clusters(doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Areas (first and last word of the item, least and greatest diagonal) around seeds that lie together: grouped by close diagonals, then cut at long gaps.

    Neither side of an area is longer than ``MOST_ROWS`` or ``MOST_BAND``; longer ones are cut with an overlap that
    holds a passage of ``MIN_WORDS``, so a passage that lies in two areas is found in at least one.
    """
    diagonal = doc - at
    order = np.lexsort((doc, diagonal))
    doc, at, diagonal = doc[order], at[order], diagonal[order]
    cut = np.flatnonzero(np.diff(diagonal) > DIAGONAL) + 1
    for a, b in zip([0, *cut], [*cut, len(doc)], strict=True):
        if b - a < MIN_SEEDS:
            continue
        for lo in range(int(diagonal[a]), int(diagonal[b - 1]) + 1, MOST_BAND - 4 * DIAGONAL):
            x, y = a + np.searchsorted(diagonal[a:b], [lo, lo + MOST_BAND])
            by = np.argsort(at[x:y], kind="stable")
            d, i, g = doc[x:y][by], at[x:y][by], diagonal[x:y][by]
            gaps = np.flatnonzero(np.diff(i) > REACH) + 1
            for u, w in zip([0, *gaps], [*gaps, len(i)], strict=True):
                if w - u >= MIN_SEEDS and len(np.unique(d[u:w])) >= MIN_SEEDS:
                    for top in range(int(i[u]), int(i[w - 1]) + 1, MOST_ROWS - 4 * REACH):
                        bottom = min(top + MOST_ROWS, int(i[w - 1]))
                        inside = g[u + np.searchsorted(i[u:w], top) : u + np.searchsorted(i[u:w], bottom, side="right")]
                        if len(inside) >= MIN_SEEDS:
                            yield top, bottom, int(inside.min()), int(inside.max())


def align(item: np.ndarray, doc: np.ndarray, first: int, last: int, low: int, high: int) -> Iterator[np.ndarray]:
    """Smith-Waterman (match 1, mismatch and gap -1) of item words ``first`` to ``last`` on the diagonals ``low`` to ``high``, best alignment first.

    Yields each alignment as an array of steps (item word, document word, is a match). The matches of an alignment
    are taken out before the next one is sought, until none can hold a passage.
    """
    rows = np.arange(first, last + 1)
    width = high - low + 1
    ramp = np.arange(width, dtype=np.int32)
    columns = rows[:, None] + low + np.arange(width)[None, :]
    inside = (columns >= 0) & (columns < len(doc))
    same = inside & (doc[np.clip(columns, 0, len(doc) - 1)] == item[rows][:, None])
    h = np.zeros((len(rows) + 1, width + 1), np.int32)  # the last column stays 0: beyond the band
    while True:
        # some MIN_WORDS words of a passage have no more than their share of edits: without such a stretch there is none
        held = np.r_[0, np.cumsum(same.any(axis=1))]
        if len(rows) < MIN_WORDS or (held[MIN_WORDS:] - held[:-MIN_WORDS]).max() < MIN_WORDS - WINDOW_EDITS:
            return
        for r in range(1, len(rows) + 1):
            row = np.maximum(h[r - 1, :width] + np.where(same[r - 1], 1, -1), h[r - 1, 1:] - 1)
            np.maximum(row, 0, out=row)
            h[r, :width] = np.maximum.accumulate(row + ramp) - ramp  # gaps in the item: best of row[c - g] - g
        r, c = divmod(int(h.argmax()), width + 1)
        if h[r, c] < MIN_SCORE:
            return
        steps = []
        while r > 0 and h[r, c] > 0:
            here = h[r, c]
            hit = bool(same[r - 1, c])
            if here == h[r - 1, c] + (1 if hit else -1):
                steps.append((first + r - 1, columns[r - 1, c], hit))
                r -= 1
            elif here == h[r - 1, c + 1] - 1:
                steps.append((first + r - 1, columns[r - 1, c], False))
                r, c = r - 1, c + 1
            else:
                steps.append((first + r - 1, columns[r - 1, c], False))
                c -= 1
        path = np.array(steps[::-1])
        yield path
        hits = path[path[:, 2] == 1]
        same[hits[:, 0] - first, hits[:, 1] - hits[:, 0] - low] = False
        h[:] = 0


def qualifying(path: np.ndarray) -> tuple[int, float]:
    """The longest passage in an alignment that is a case: (item words covered, edits per step); (0, 1.0) if there is none.

    An alignment is cut at ``BREAK`` edits in a row: what lies on either side are passages of their own. A match
    counts 1 and an edit -``EDIT_COST``. A passage is a case if it is worth 0 or more as a whole, that is if about one
    word in ten is edited. Of a passage with more edits a part is a case if it is worth ``CLEAN``: that is more than chance
    leaves in a text of which a fifth of the words was replaced.
    """
    hit = path[:, 2] == 1
    ends = np.flatnonzero(hit)
    best = (0, 1.0)
    if not len(ends):
        return best
    cuts = np.flatnonzero(np.diff(ends) > BREAK)
    for x, y in zip(ends[np.r_[0, cuts + 1]], ends[np.r_[cuts, len(ends) - 1]] + 1, strict=True):
        worth = np.r_[0, np.cumsum(np.where(hit[x:y], 1, -EDIT_COST))]
        u, w = 0, y - x
        if worth[-1] < 0:
            gain = worth - np.minimum.accumulate(worth)
            w = int(gain.argmax())
            u = int(worth[: w + 1].argmin())
            if gain[w] < CLEAN:
                continue
        span = int(path[x + w - 1, 0] - path[x + u, 0] + 1)
        if span >= MIN_WORDS and span > best[0]:
            best = span, float(1 - hit[x + u : x + w].mean())
    return best


def best_passage(item: np.ndarray, doc: np.ndarray, first: int, last: int, low: int, high: int) -> tuple[int, float]:
    """The longest qualifying passage of the first alignment around an area of seeds that has one."""
    lo, hi = max(0, first - REACH), min(len(item) - 1, last + N - 1 + REACH)
    for path in align(item, doc, lo, hi, low - DIAGONAL, high + DIAGONAL):
        span, rate = qualifying(path)
        if span:
            return span, rate
    return 0, 1.0


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold a passage of an item's prompt or solution: doc_id, item_id, n_words, edit_rate.

    Nulls: null and empty texts hold nothing; item texts shorter than ``MIN_WORDS`` words are in no document.
    Repeated documents give repeated rows, repeated items none. Null ids are kept for documents and ignored for
    items. Empty tables give no rows; further columns are ignored. More than ``MAX_CHARS`` characters of items raise.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "prompt", "solution").where("item_id is not null").distinct()
    chars = items.agg(F.sum(F.coalesce(F.length("prompt"), F.lit(0)).cast("bigint") + F.coalesce(F.length("solution"), F.lit(0)))).first()[0] or 0
    if chars > MAX_CHARS:
        raise ValueError(f"the held-out texts have {chars} characters, more than {MAX_CHARS}")
    texts: list[tuple[int, list[str]]] = []
    for row in items.collect():
        for text in (row["prompt"], row["solution"]):
            words = normal_words(text or "")
            if len(words) >= MIN_WORDS:
                texts.append((row["item_id"], words))
    texts.sort()
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id bigint, n_words int, edit_rate double"

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    if text:
                        rows += [(at, item, span, rate) for item, (span, rate) in index.found(normal_words(text)).items()]
                if rows:
                    at, item, span, rate = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(item, pa.int64()), pa.array(span, pa.int32()), pa.array(rate, pa.float64())], ["doc_id", "item_id", "n_words", "edit_rate"])

        return run

    docs = documents.select("doc_id", "text")
    out = None
    for i in range(0, max(1, len(texts)), BLOCK):
        # built once, and sent to each executor once
        part = docs.mapInArrow(search(spark.sparkContext.broadcast(ItemIndex(texts[i : i + BLOCK]))), schema)
        out = part if out is None else out.union(part)
    if len(texts) > BLOCK:  # an item whose two texts fell into different blocks
        out = out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.min_by("edit_rate", "n_words").alias("edit_rate"))
    return out
