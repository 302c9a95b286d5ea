"""Keyword-stuffed and link-list texts, by term recurrence.

A text is read as a row of words, links and tags; scripts without blanks are cut into runs of one script, and those of ideographs or of South-East Asian letters
into pairs. At every place the gaps to the last and next occurrence of the term, the autocorrelation of the row over a window of lags
and, at any distance, the evenness of the term's own gaps tell how regularly terms come back; lists of
distinct nouns, links and tags tell by the want of function words and sentences around them. Words of scripts without a list of function words
are neutral by themselves: recurrence speaks for stuffing, a sentence against it. All feed a
two-state path (ordinary or stuffed) of least cost through the text, so that a stuffed part is found with its borders;
traces, logs, module lists and tables are told by their form and count as ordinary. A text is flagged if more
than half of its words lie in stuffed parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Lags of the autocorrelation and places on either side over which it is averaged.
LAGS, REACH = 12, 10
#: Terms of the longest line of a list, and how many lines away one that begins alike may be.
SHORT, NEAR = 10, 4
#: Terms of the longest sentence.
LONGEST = 60
#: Cost of passing from one state to the other, within a line and between lines.
SWITCH, SWITCH_LINE = 6.0, 3.0

# Function words by language, lower case.
FUNCTION_WORDS = frozenset(
    """
a an the this that these those some any each every no all both of to in on at by for with from into over under after before during
while when whenever where if unless until once because since so as than then and or nor but though although not never is are was were be been being am do
does did done has have had having can could will would shall should may might must i you he she it we they me him her us them my your his its our their who whom which what
there here only just also too very more most less again still yet even out up down off about between without within per via
el la los las un una unos unas de del al y o u en con por para sin se que es son está no lo le su sus más menos casi aquí también
le les un une des du de la au aux et ou dans avec pour sans sur ce cette est sont se s’arrête j’ai ici ne pas par qui que
der die das ein eine einen einem einer des dem den und oder nicht in im mit bei nach von zu auf für ist sind wenn es ich sie jedes nur ab
""".split()
)
_ANCHOR = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'<>\s]*)[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_BREAK = re.compile("\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]")
_QUOTE = re.compile(r"^(?:\s*>)+\s?")
_WORD = re.compile(r"[^\W_]+")
_HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}/", re.I)
_HASH = re.compile(r"^#[^\W\d]\w*")
_MODEL = re.compile(r"^(?=\w*\d)(?=\w*[A-Z])[A-Z0-9]{3,10}$")
_CODE = re.compile(r"::|\w\(|\(\)|\w_\w|0x[0-9a-f]+|^[./~]|[\w)]/\w|\.\w+:\d+|=|\w\.so\b|^[\[(]?\d", re.I)
_FOREIGN = re.compile("[\u0370-\u1fff\u2e80-\uffef]")
# Scripts without blanks: runs of kana, pairs of ideographs and of Thai, Lao, Myanmar and Khmer letters.
_UNBLANKED = re.compile("[\u3041-\u309f]+|[\u30a1-\u30ff]+|[\u3005\u3400-\u9fff\uf900-\ufaff]{1,2}|[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff]{1,2}")
_END = re.compile("[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4][\"')\\]}»”’」』]*$")
_MATERIAL = re.compile(
    r"^\s*(?:#\d+\s|\[\s*\d[\d.:]*\s*\]|at\s+[\w.$<>]+\(|\|.*\d.*\||[\w./-]+\s+0x[0-9a-f]+|\d{4}-\d\d-\d\d[ T]\d|[\w.$]+(?:Exception|Error)\b|Thread\s+\d|(?:\+\+\+|---|@@)\s|[\w-]+\.so[.\d]*\b)", re.I
)


#: Kinds of a chunk, one bit each.
LINK, TAG, MODEL, FUNCTION, CODE, FOREIGN, END = (1 << k for k in range(7))
#: Chunks whose kinds a worker remembers.
CACHE = 300_000
_known: dict[str, tuple[int, str, int]] = {}


def _chunk(c: str) -> tuple[int, str, int]:
    """(words, term, kinds) of a piece of text without blanks."""
    words = len(_WORD.findall(c))
    term = c.strip(".,;:!?()[]{}\"'|*#<>/-–—·•").lower()
    # Searched for in this way, for a pattern would be tried from every place of a long chunk.
    scheme, www = c.find("://"), c.lower().find("www.")
    link = scheme > 0 and len(c) > scheme + 3 and c[scheme - 1].isalnum() or 0 <= www < len(c) - 4 or bool(_HOST.match(c))
    tag = bool(_HASH.match(c))
    model = bool(_MODEL.match(term.upper() if not c.islower() else c))
    kinds = link * LINK + tag * TAG + model * MODEL
    if term in FUNCTION_WORDS:
        kinds += FUNCTION
    if _FOREIGN.search(term):
        kinds += FOREIGN
    if _END.search(c[-8:]):
        kinds += END
    if not (link or tag or model) and _CODE.search(c):
        kinds += CODE
    if len(c) <= 40:
        if len(_known) > CACHE:
            _known.clear()
        _known[c] = words, term, kinds
    return words, term, kinds


def _row(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk its term, words and kinds, whether it begins a line, whether its line is working material."""
    text = _TAG.sub(" ", _ANCHOR.sub(r" \1 ", text)) if "<" in text else text
    text = text.replace("](", " ")
    terms: list[str] = []
    words: list[int] = []
    kinds: list[int] = []
    begins: list[bool] = []
    material: list[bool] = []
    known = _known.get
    for line in _BREAK.split(text):
        if ">" in line:
            line = _QUOTE.sub("", line)
        held = len(terms)
        if not line.isascii():
            line = _UNBLANKED.sub(r" \g<0> ", line)
        for c in line.split():
            n, term, kind = known(c) or _chunk(c)
            if n:
                terms.append(term)
                words.append(n)
                kinds.append(kind)
            elif kind & END and len(terms) > held:
                kinds[-1] |= END
        if len(terms) > held:
            more = len(terms) - held
            begins += [True] + [False] * (more - 1)
            material += [bool(_MATERIAL.match(line))] * more
    return terms, np.array(words, np.int64), np.array(kinds, np.int64), np.array(begins, bool), np.array(material, bool)


def recurrence(codes: np.ndarray, lags: int = LAGS) -> tuple[np.ndarray, np.ndarray]:
    """Gap to the nearer occurrence of the same term (0: none within ``lags``), and the number of lags at which the place repeats."""
    n = len(codes)
    gap = np.zeros(n, np.int64)
    hits = np.zeros(n, np.int64)
    at = np.argsort(codes, kind="stable")
    code = codes[at]
    # Places of one term follow each other; the k-th next one is looked at while any is near.
    for k in range(1, min(lags, n - 1) + 1):
        near = (code[k:] == code[:-k]) & (at[k:] - at[:-k] <= lags)
        if not near.any():
            break
        first, second = at[:-k][near], at[k:][near]
        hits[first] += 1
        hits[second] += 1
        if k == 1:
            gap[second] = second - first
            ahead = second - first
            gap[first] = np.where(gap[first] > 0, np.minimum(gap[first], ahead), ahead)
    return gap, hits


def evenness(codes: np.ndarray) -> np.ndarray:
    """Whether the gaps to the last and next occurrence of the same term, however far, are alike (four fifths or more); at a term's ends, its two outermost gaps."""
    n = len(codes)
    even = np.zeros(n, bool)
    at = np.argsort(codes, kind="stable")
    code = codes[at]
    middle = np.flatnonzero(code[2:] == code[:-2]) + 1
    if len(middle):
        before, after = at[middle] - at[middle - 1], at[middle + 1] - at[middle]
        alike = middle[5 * np.minimum(before, after) >= 4 * np.maximum(before, after)]
        even[at[alike]] = True
        first = alike[(alike < 2) | (code[alike - 2] != code[alike])]
        last = alike[(alike > n - 3) | (code[np.minimum(alike + 2, n - 1)] != code[alike])]
        even[at[first - 1]] = True
        even[at[last + 1]] = True
    return even


def sentences(terms: list[str], end: np.ndarray) -> np.ndarray:
    """Places in sentences: at most ``LONGEST`` terms up to a full stop, at least four different ones, and more than half of them different."""
    out = np.zeros(len(terms), bool)
    start = 0
    for e in (np.flatnonzero(end) + 1).tolist():
        if 4 <= e - start <= LONGEST:
            different = len(set(terms[start:e]))
            out[start:e] = different >= 4 and 2 * different > e - start
        start = e
    return out


def alike_lines(codes: np.ndarray, begins: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places in lines of two to ``SHORT`` terms without a full stop that begin with the same term as another of the ``NEAR`` lines before or after."""
    starts = np.flatnonzero(begins)
    length = np.diff(np.append(starts, len(codes)))
    closed = np.logical_or.reduceat(end, starts)
    short = (length >= 2) & (length <= SHORT) & ~closed
    first = np.where(short, codes[starts], -1 - np.arange(len(starts)))
    found = np.zeros(len(starts), bool)
    for k in range(1, min(NEAR, len(starts) - 1) + 1):
        same = first[k:] == first[:-k]
        found[k:] |= same
        found[:-k] |= same
    return np.repeat(found, length)


def _smooth(x: np.ndarray, reach: int = REACH) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(x))
    return (total[hi] - total[lo]) / (hi - lo)


def evidence(terms: list[str], kinds: np.ndarray, material: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each chunk, how much it speaks for stuffing (positive) or against it."""
    n = len(terms)
    index: dict[str, int] = {}
    codes = np.array([index.setdefault(t, len(index)) for t in terms], np.int64)
    link, tag, model, function, code, foreign, end = ((kinds & k) > 0 for k in (LINK, TAG, MODEL, FUNCTION, CODE, FOREIGN, END))
    content = ~(link | tag | function | code)
    gap, hits = recurrence(codes)
    repeated = content & (gap > 0) & (gap <= 8)
    # Autocorrelation: how many of the lags repeat here, over what chance would give.
    density = _smooth(np.where(content, np.minimum(hits, 6), 0) / 6.0)
    grammar = _smooth((function & ~repeated).astype(float) * np.clip(1 - 4 * (density - 0.15), 0, 1))
    bare = content & (grammar < 0.06)
    score = np.full(n, -0.4)
    # Function words make no sentence where keywords come back at every few words, nor in short lines that begin alike.
    score[function] = -1.2 * np.clip(1 - 4 * (density[function] - 0.15), 0, 1)
    listed = alike_lines(codes, begins, end) & ~code & ~material
    score[function & listed] = 0.15
    score[bare] = 0.15
    score[repeated] = 0.5
    score += np.where(content, 1.5 * (density - 0.15), 0.0)
    strange = content & foreign
    if bare.any() or strange.any():
        prose = sentences(terms, end)
        # Nouns strung together speak for stuffing by themselves, what chance would give is not taken off them.
        score[bare & ~prose] += 1.5 * 0.15
        score[strange] = 1.5 * (density[strange] - 0.15)
        if len(index) < n:
            even = _smooth((content & evenness(codes)).astype(float))
            score += np.where((bare | strange) & ~prose, 1.5 * np.maximum(even - 0.3, 0.0), 0.0)
        score[strange & prose] = -1.2
    score[link | tag] = 1.6
    score[model] = 1.2
    score -= 2.0 * np.maximum(grammar - 0.12, 0)
    score[code] = -0.8
    score[material] = -1.5
    return score


def stuffed(score: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The two-state path of least cost: True where the text is stuffed."""
    n = len(score)
    # A part pays if twice its sum is more than one border; the best sum over all parts tells whether any does.
    total = np.concatenate([[0.0], np.cumsum(score)])
    if 2 * (total - np.minimum.accumulate(total)).max() <= SWITCH_LINE:
        return np.zeros(n, bool)
    change = np.where(begins, SWITCH_LINE, SWITCH).tolist()
    plain, full = 0.0, -SWITCH_LINE
    from_full = [False] * n
    from_plain = [False] * n
    for i, s in enumerate(score.tolist()):
        c = change[i]
        if full - c > plain:
            p, from_full[i] = full - c, True
        else:
            p = plain
        if plain - c > full:
            f, from_plain[i] = plain - c, True
        else:
            f = full
        plain, full = p - s, f + s
    out = np.zeros(n, bool)
    state = full > plain
    for i in range(n - 1, -1, -1):
        out[i] = state
        if state and from_plain[i]:
            state = False
        elif not state and from_full[i]:
            state = True
    return out


def stuffed_share(text: str | None) -> tuple[int, int]:
    """(words in stuffed parts, words) of a text; null, empty and wordless texts have none."""
    if not text:
        return 0, 0
    terms, words, kinds, begins, material = _row(text)
    if not terms:
        return 0, 0
    path = stuffed(evidence(terms, kinds, material, begins), begins)
    return int(words[path].sum()), int(words.sum())


def find_stuffed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, stuffed_words, words`` of every document; null texts have 0 words. Each text is judged whole, by itself, in one pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [stuffed_share(v.as_py()) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=[doc_id, "stuffed_words", "words"]
            )

    source = spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("text")))
    return source.mapInArrow(run, f"`{doc_id}` long, stuffed_words long, words long")
