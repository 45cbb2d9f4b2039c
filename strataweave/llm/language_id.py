r"""Language identification: spans of mixed-language text by Viterbi over per-word scores.

A word is a run of letters and marks. The script of its first letter narrows the languages to those that were seen in that
script; a score for each of these is the log likelihood of its character pairs and triples (lower-cased, with word
borders), hashed to a fixed number of buckets. Viterbi over the words, with a penalty for each switch, labels
each word; words in a row of one label are a span. The text's language is the one with most letters.

Counts are gathered over all labelled rows given: each task adds up a matrix of buckets by languages, and what leaves it is a row for each
cell above zero, summed with a map-side combine. The model has ``buckets`` x languages numbers, whatever the corpus.

The best path is found in parallel: runs of ``RUN`` words give a max-plus matrix each (best score from each state at the start to each at the end),
all runs of a batch at once; the matrices of a text are chained, and the paths within runs are read back from their ends, again at once.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.textblocks import U, mix, pieces, strings, trimmed

#: first and last code points of scripts: blocks of the Unicode standard (fixed values)
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
#: what a text without letters is
UNKNOWN = "und"
BUCKETS = 1 << 15
#: cost of a switch between two words, in nats
SWITCH = 6.0
#: share of a language's words in a script from which it is a candidate for words in it
SCRIPT_SHARE = 0.01
#: words in a run
RUN = 128
#: languages that a task counts at a time
HELD = 256
#: score of a language that a word's script rules out, for each word
RULED_OUT = -1e4


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter or mark, number of the script) of every code point."""
    letter = np.zeros(0x110000, bool)
    for at in range(0x110000):
        letter[at] = unicodedata.category(chr(at))[0] in "LM"
    script = np.zeros(0x110000, np.int8)
    for name, low, high in SCRIPTS:
        script[low : high + 1] = NAMES.index(name)
    return letter, script


class LetterRuns:
    """The words of texts: code points lower-cased, starts, ends, owners, scripts."""

    def __init__(self, column: pa.Array):
        # the only letter whose lower case is longer than itself gives way, so that places are those of the text
        texts = [t.replace("\u0130", "i").lower() for t in column.to_pylist()]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        letter, script = _tables()
        live = np.zeros(len(points) + 2, bool)
        live[1:-1] = letter[points]
        edge = np.flatnonzero(live[1:] != live[:-1])
        self.start, self.end, self.n = edge[::2], edge[1::2], len(texts)
        #: where each text starts
        self.off = np.concatenate([[0], np.cumsum(size + 1)])
        self.ptr = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.ptr)
        self.points = points
        self.script = script[points[self.start]] if len(self.start) else np.zeros(0, np.int8)
        self.letters = self.end - self.start

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, offsets) of each word's pairs and triples, with a border before and after."""
        n = self.letters + 1  # the places of a word and that after it
        at = np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = at - np.repeat(self.start, n)
        here = np.where(place < np.repeat(self.letters, n), self.points[np.minimum(at, len(self.points) - 1)] if len(at) else 0, 0).astype(U)
        one = np.where(place > 0, self.points[at - 1] if len(at) else 0, 0).astype(U)
        two = np.where(place > 1, self.points[at - 2] if len(at) else 0, 0).astype(U)
        pair = one | here << U(21)
        both = np.empty(2 * len(at), np.int64)
        both[::2] = mix(pair) & U(buckets - 1)
        both[1::2] = mix(pair | two << U(42)) & U(buckets - 1)
        return both, np.concatenate([[0], np.cumsum(2 * n)])


# -- counts and model ----------------------------------------------------------------


def _cells(held: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    for name, total in held.items():
        at = np.flatnonzero(total)
        at = at if len(at) else np.zeros(1, np.int64)  # a language without words is learned too
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array((at >= buckets).astype(np.int32)), pa.array(np.where(at >= buckets, at - buckets, at).astype(np.int32)), pa.array(total[at])], names=["lang", "kind", "at", "n"])


def _gather(buckets: int):
    """(lang, kind, at, n) above zero of a task's rows: kind 0 counts grams by bucket, kind 1 words by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            lang = batch.column("lang").dictionary_encode()
            names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            w = LetterRuns(strings(batch.column("text")))
            gram, off = w.grams(buckets)
            of_word = np.repeat(which, w.count)
            counts = np.bincount(np.repeat(of_word, np.diff(off)) * buckets + gram, minlength=len(names) * buckets).reshape(-1, buckets)
            words = np.bincount(of_word * len(NAMES) + w.script, minlength=len(names) * len(NAMES)).reshape(-1, len(NAMES))
            for i, name in enumerate(names):
                total = held.setdefault(name, np.zeros(buckets + len(NAMES), np.int64))
                total[:buckets] += counts[i]
                total[buckets:] += words[i]
            if len(held) > HELD:
                yield from _cells(held, buckets)
                held = {}
        yield from _cells(held, buckets)

    return run


@dataclass
class Languages:
    """Languages with their log likelihoods by bucket, candidates by script, and log shares of words."""

    names: list[str]
    table: np.ndarray  # (buckets, languages)
    candidates: np.ndarray  # (scripts, languages)
    prior: np.ndarray


def model_of(cells: list[tuple[str, int, int, int]], buckets: int = BUCKETS, share: float = SCRIPT_SHARE, smoothing: float = 0.5) -> Languages:
    """The model of counts (lang, kind, at, n): smoothed shares of buckets, and the scripts that hold a stated share of a language's words."""
    names = sorted({c[0] for c in cells})
    number = {name: i for i, name in enumerate(names)}
    grams, scripts = np.zeros((buckets, len(names))), np.zeros((len(NAMES), len(names)))
    for lang, kind, at, n in cells:
        (scripts if kind else grams)[at, number[lang]] += n
    total = scripts.sum(0)
    table = np.log((grams + smoothing) / (grams.sum(0) + smoothing * buckets))
    return Languages(names, table.astype(np.float32), (scripts > 0) & (scripts >= share * total), np.log((total + 1) / (total.sum() + len(names) + 1)))


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, **how) -> Languages:
    """The model of all rows with a language. Null texts count as empty; no such rows give a model of no languages.

    At most (``buckets`` + scripts) x languages counts come to the driver, however many rows there are.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(trimmed(_gather(buckets)), "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    return model_of(list(zip(*(got.column(c).to_pylist() for c in ("lang", "kind", "at", "n")), strict=True)), buckets, **how)


# -- Viterbi -------------------------------------------------------------------------


def best_paths(score: np.ndarray, ptr: np.ndarray, switch: float, start: np.ndarray | None = None, run: int = RUN) -> np.ndarray:
    """The state of each word on the best path of its text. score: (words, states); text i has words ptr[i] to ptr[i + 1]; ``start``: scores before the first word.

    Staying goes before switching at equal scores, then the lowest state.
    """
    words, k = score.shape
    if not words or k == 1:
        return np.zeros(words, np.int64)
    runs = -(-np.diff(ptr) // run)
    first = np.cumsum(runs) - runs
    text = np.repeat(np.arange(len(runs)), runs)
    begin = ptr[:-1][text] + (np.arange(len(text)) - first[text]) * run
    size = np.minimum(run, ptr[1:][text] - begin)
    step = lambda best: np.maximum(best, best.max(-1, keepdims=True) - switch)

    # max-plus matrices of the runs that another follows, which are all of full length
    full = np.flatnonzero(np.append(text[1:] == text[:-1], False))
    matrix = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (len(full), k, k))
    for t in range(run if len(full) else 0):
        matrix = step(matrix) + score[begin[full] + t][:, None, :]
    number = np.zeros(len(text), np.int64)
    number[full] = np.arange(len(full))
    # scores before each run: the matrices of a text chained, all texts at once
    enter = np.zeros((len(text), k)) + (0 if start is None else start)
    for nth in range(1, int(runs.max())):
        r = first[runs > nth] + nth
        best = (enter[r - 1][:, :, None] + matrix[number[r - 1]]).max(1)
        enter[r] = best - best.max(1, keepdims=True)

    # forward within the runs; longest first, so that those still open are the first ones
    order = np.argsort(-size, kind="stable")
    at = begin[order]
    live = np.searchsorted(-size[order], -np.arange(1, run + 1), "right")
    best, now = np.empty((words, k)), enter[order]
    for t in range(run):
        if n := live[t]:
            now[:n] = step(now[:n]) + score[at[:n] + t]
            best[at[:n] + t] = now[:n]
    # backward from every state that a run may end in
    state = np.broadcast_to(np.arange(k), (len(text), k)).copy()
    path = np.empty((words, k), np.int32)
    for t in range(run - 1, -1, -1):
        if n := live[t]:
            path[at[:n] + t] = state[:n]
            before = best[at[:n] + t - 1] if t else enter[order[:n]]
            stay = np.take_along_axis(before, state[:n], 1) >= before.max(1, keepdims=True) - switch
            state[:n] = np.where(stay, state[:n], before.argmax(1)[:, None])
    came = np.empty_like(state)
    came[order] = state
    # the states that runs end in, from each text's last one back
    end = np.zeros(len(text), np.int64)
    lasts = first[runs > 0] + runs[runs > 0] - 1
    end[lasts] = best[begin[lasts] + size[lasts] - 1].argmax(1)
    for nth in range(int(runs.max()) - 1, 0, -1):
        r = first[runs > nth] + nth
        end[r - 1] = came[r, end[r]]
    return path[np.arange(words), np.repeat(end, size)].astype(np.int64)


def word_scores(w: LetterRuns, model: Languages, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(scores, candidates) of each word for each language; a language that its script rules out scores ``RULED_OUT``. Without candidates all score 0."""
    k = len(model.names)
    score = np.zeros((len(w.start), k))
    gram, off = w.grams(len(model.table))
    i = 0
    while i < len(w.start):  # some words at a time
        j = max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1)
        score[i:j] = np.add.reduceat(model.table[gram[off[i] : off[j]]], off[i:j] - off[i], axis=0, dtype=np.float64)
        i = j
    fits = model.candidates[w.script]
    some = fits.any(1, keepdims=True)
    return np.where(some, np.where(fits, score, RULED_OUT), 0.0), fits


def labelled_words(column: pa.Array, model: Languages, switch: float = SWITCH) -> tuple[LetterRuns, np.ndarray, np.ndarray]:
    """(words, label of each, whether the label's language is a candidate of it) of texts without nulls."""
    w = LetterRuns(column)
    score, fits = word_scores(w, model)
    label = best_paths(score, w.ptr, switch, model.prior)
    return w, label, fits[np.arange(len(label)), label] if len(label) else np.zeros(0, bool)


SPAN = "array<struct<start:int,end:int,lang:string>>"


def identify_languages(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """Columns ``keep`` of docs (default: all) with lang_pred, score, n_spans and, if asked for, spans.

    lang_pred has most letters (ties: the first by name); score is the share of all letters that are labelled so in words for which it is a
    candidate. A span's start and end are places of code points in the text. Null texts, texts without letters, and all
    texts under a model without languages are ``und`` with score 0 and no spans. Rows are independent; repeated rows fare alike; an empty table stays one;
    columns named like an output are replaced.
    """
    names = ["lang_pred", "score", "n_spans", *(["spans"] if spans else [])]
    out = T._parse_datatype_string(f"lang_pred string, score double, n_spans long{f', spans {SPAN}' if spans else ''}")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    k = len(model.names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in pieces(batches):
            column = strings(batch.column("text"))
            lang, score, n_spans = np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.zeros(len(column), np.int64)
            lists = [[] for _ in range(len(column))]
            if k:
                w, label, fits = labelled_words(column, known, switch)
                owner = np.repeat(np.arange(w.n), w.count)
                letters = np.bincount(owner * k + label, weights=w.letters, minlength=w.n * k).reshape(-1, k)
                sure = np.bincount(owner * k + label, weights=w.letters * fits, minlength=w.n * k).reshape(-1, k)
                some, top = w.count > 0, letters.argmax(1)
                lang[some] = np.array(known.names, object)[top[some]]
                score = np.where(some, sure[np.arange(w.n), top] / np.maximum(letters.sum(1), 1), 0.0)
                heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                n_spans = np.bincount(owner[heads], minlength=w.n)
                if spans:
                    tails = np.append(heads[1:], len(label))[: len(heads)] - 1
                    for i, a, b, s in zip(owner[heads].tolist(), (w.start[heads] - w.off[owner[heads]]).tolist(), (w.end[tails] - w.off[owner[heads]]).tolist(), label[heads].tolist(), strict=True):
                        lists[i].append({"start": a, "end": b, "lang": known.names[s]})
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_spans, pa.int64())]
            if spans:
                columns.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=keep + names)

    given = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].cast("string").alias("text"))
    return given.mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in keep] + out.fields))
