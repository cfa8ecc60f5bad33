"""Language identification of mixed-language text.

A word is a run of letters of one script, with the marks on them; scripts without spaces are cut
into words of GROUP letters. A word's script (from code-point ranges) narrows the languages that
may label it; byte-trigram log-likelihoods score the word in each of those; a Viterbi pass with a
penalty for switching then labels every word, and runs of one label are the text's spans. The
document's language is the one with the most letters; the score is its share of them.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, make_room, slices, text_buffer

#: Trigram buckets (fewer with many languages: the table has TABLE numbers at most), and the labels
#: beyond which a column holds no languages.
BUCKET_BITS, TABLE, MOST_LABELS = 16, 1 << 24, 1 << 14
GROUP = 8
#: First code points of script ranges, and the script of each.
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xFB50, 0xFF00, 0x20000, 0x30000]
SCRIPT_NAMES = ["Latin", "Greek", "Cyrillic", "Other", "Hebrew", "Arabic", "Devanagari", "Other", "Thai", "Other", "Hangul", "Other", "Latin", "Greek", "Other", "Hiragana", "Katakana", "Other", "Han", "Other", "Hangul", "Other", "Arabic", "Other", "Han", "Other"]
_NAMES = sorted(set(SCRIPT_NAMES))
_STARTS = np.array(SCRIPT_STARTS)
_SCRIPT_OF = np.array([_NAMES.index(n) for n in SCRIPT_NAMES], np.int8)
_LATIN = _NAMES.index("Latin")
UNSPACED = ["Han", "Hiragana", "Katakana", "Thai"]
UND = "und"

#: ASCII letters in lower case; all other ASCII parts words and becomes 0.
_FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 0 for b in range(256)], np.uint8)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point its script if it is a letter (str.isalpha), -2 for a combining mark, -1
    for all others."""
    out = np.repeat(_SCRIPT_OF, np.diff([*SCRIPT_STARTS, 0x110000]))
    # No letters beyond the third plane; of the marks there are variation selectors.
    alpha = np.zeros(0x110000, bool)
    alpha[:0x40000] = [chr(i).isalpha() for i in range(0x40000)]
    marks = [i for i in (*range(0x300, 0x40000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(i)) in ("Mn", "Mc")]
    out[~alpha] = -1
    out[marks] = -2
    return out


@dataclass
class Model:
    languages: list[str]
    #: log-likelihood of each trigram bucket in each language
    scores: np.ndarray
    #: whether a language uses a script
    scripts: np.ndarray
    switch_penalty: float

    @property
    def bits(self) -> int:
        return self.scores.shape[1].bit_length() - 1


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (0 between words), each byte's trigram bucket (it and the two before), its
    script or -1, and whether a letter begins there."""
    folded = _FOLD[buf]
    script = np.where(folded == 0, -1, _LATIN).astype(np.int8)
    lead = np.flatnonzero(buf >= 0xC0)
    if lead.size:
        at = lambda k: buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int64) & 63
        b = buf[lead].astype(np.int64)
        size = np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
        point = np.where(size == 2, (b & 31) << 6 | at(1), np.where(size == 3, (b & 15) << 12 | at(1) << 6 | at(2), (b & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = _kinds()[np.minimum(point, 0x10FFFF)]
        script[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            script[np.minimum(lead[more] + k, len(buf) - 1)] = kind[more]
    marks = script == -2
    if marks.any():
        # A mark belongs to what stands before it; nothing stands before a text.
        own = np.where(marks, -1, np.arange(len(buf)))
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        first = first[marks[first]]
        own[first], script[first] = first, -1
        script = script[np.maximum.accumulate(own)]
    folded = np.where(script >= 0, folded, 0).astype(np.uint8)
    letter = (script >= 0) & ((buf < 0x80) | (buf >= 0xC0)) & ~marks
    # The bytes before a text's first are another text's.
    code, first = folded.astype(np.uint32), offsets[:-1]
    one, two = np.zeros_like(code), np.zeros_like(code)
    one[1:] = code[:-1]
    two[2:] = np.where(folded[1:-1] == 0, 0, code[:-2])
    one[first[first < len(code)]] = 0
    for k in (0, 1):
        two[first[first + k < len(code)] + k] = 0
    code = code * np.uint32(0x9E3779B1) + one * np.uint32(0x85EBCA6B) + two * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return folded, code >> np.uint32(32 - bits), script, letter


def _word_bounds(script: np.ndarray, letter: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = script >= 0
    cut = np.zeros(len(script) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= script[1:] != script[:-1]
    for name in UNSPACED:
        at = np.flatnonzero(letter & (script == _NAMES.index(name)))
        if at.size:
            # Every GROUP-th letter of a run begins a word.
            runs = np.cumsum(cut[:-1] & inside)[at]
            head = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
            no = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            cut[at[no % GROUP == 0]] = True
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends


def viterbi(emit: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all texts' words (rows of ``emit``, ``counts`` of them in each text): the path
    with the highest sum of scores less ``penalty`` for each change; ties to the smaller label,
    and to staying. Texts advance together, word by word."""
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    length, base = counts[order], first[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    labels = np.zeros(len(emit), np.int16)
    back = np.zeros(emit.shape, np.int16)
    stay = np.arange(emit.shape[1], dtype=np.int16)
    if not steps:
        return labels
    score = emit[base[: alive[0]]].copy()
    last = np.zeros(len(counts), np.int16)
    for t in range(1, steps + 1):
        n = int(alive[t]) if t < steps else 0
        ended = slice(n, len(score))
        last[ended] = score[ended].argmax(axis=1)
        score = score[:n]
        if not n:
            break
        best = score.argmax(axis=1)
        top = score[np.arange(n), best] - penalty
        at = base[:n] + t
        change = top[:, None] > score
        back[at] = np.where(change, best[:, None].astype(np.int16), stay)
        score = np.where(change, top[:, None], score) + emit[at]
    state = last.copy()
    for t in range(steps - 1, -1, -1):
        n = int(alive[t])
        at = base[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def label(model: Model, buf: np.ndarray, offsets: np.ndarray):
    """Of texts in one buffer: word starts, ends, labels, letters, and words per text."""
    offsets = offsets - offsets[0]
    _, bucket, script, letter = features(buf, offsets, model.bits)
    starts, ends = _word_bounds(script, letter, offsets)
    counts = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(offsets) - 1)
    upto = np.concatenate(([0], np.cumsum(letter)))
    n_lang = len(model.languages)
    emit = np.empty((len(starts), n_lang), np.float32)
    for j in range(n_lang):
        sums = np.concatenate(([0.0], np.cumsum(model.scores[j][bucket], dtype=np.float64)))
        emit[:, j] = sums[ends] - sums[starts]
    if len(starts):
        kind = script[starts]
        for s in np.unique(kind).tolist():
            use = model.scripts[s]
            if use.any() and not use.all():
                emit[np.ix_(kind == s, ~use)] = -1e6
        # Scores count from the word's best language, so that sums stay small.
        emit -= emit.max(axis=1, keepdims=True)
    return starts, ends, viterbi(emit, counts, model.switch_penalty), upto[ends] - upto[starts], counts


def train(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_language: int = 1500,
    switch_penalty: float = 12.0, script_share: float = 0.02,
) -> Model:
    """Fit trigram likelihoods on at most ``sample_per_language`` whole labelled texts of each
    label, picked by a hash. Every label is learned; with more than 256 of them buckets are fewer,
    so that the table, which the driver gets, has TABLE numbers at most. More than MOST_LABELS
    labels raise ``ValueError``. Rows with null text or label take no part; repeated rows are rows
    of their own; other columns are ignored. Without labelled rows the model knows no language."""
    named = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("pick"))
    counts = named.groupBy("lang").count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: these are no languages")
    languages = sorted(r["lang"] for r in counts)
    bits = BUCKET_BITS
    while bits > 8 and len(languages) << bits > TABLE:
        bits -= 1
    buckets = 1 << bits
    if not languages:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros((len(_NAMES), 0), bool), switch_penalty)
    number = {g: i for i, g in enumerate(languages)}
    # One literal: rows of Python objects would start a daemon and workers of their own, which stay.
    rows = json.dumps([{"lang": r["lang"], "no": number[r["lang"]], "share": min(1.0, (1.3 * sample_per_language + 20) / r["count"])} for r in counts])
    shares = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<lang:string,no:int,share:double>>")))
    near = named.join(F.broadcast(shares), "lang").filter((F.pmod("pick", F.lit(1_000_003)) / 1_000_003.0) <= F.col("share"))
    row = F.row_number().over(Window.partitionBy("no").orderBy("pick", "text"))
    sample = near.select("text", "no", "pick").withColumn("row", row).filter(F.col("row") <= sample_per_language).select("text", "no", "row")

    def count(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            langs = batch.column(1).to_numpy()
            for g in np.unique(langs).tolist():
                tri, scr = np.zeros(buckets, np.int64), np.zeros(len(_NAMES), np.int64)
                for i in np.flatnonzero(langs == g).tolist():
                    part = buf[offsets[i] : offsets[i + 1]]
                    folded, bucket, script, letter = features(part, np.array([0, len(part)]), bits)
                    tri += np.bincount(bucket[folded != 0], minlength=buckets)
                    scr += np.bincount(script[letter], minlength=len(_NAMES))
                both = np.concatenate((tri, scr))
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at), pa.array(both[at])], ["lang", "at", "n"])

    # More tasks than labels, and rows dealt by number: equal texts don't meet in one.
    spread = sample.repartition(max(8, len(languages)), F.xxhash64("no", "row")).select("text", "no")
    sums = spread.mapInArrow(count, "lang int, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), buckets + len(_NAMES)))
    table[sums["lang"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    tri, scr = table[:, :buckets], table[:, buckets:]
    scores = np.log((tri + 0.05) / (tri.sum(axis=1, keepdims=True) + 0.05 * buckets)).astype(np.float32)
    use = (scr >= script_share * np.maximum(1, scr.sum(axis=1, keepdims=True))).T
    return Model(languages, scores, use, switch_penalty)


def identify(
    df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True,
    names: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """The columns ``keep``, then label and score and, on request, spans, called ``names``: an array
    of (lang, start, end) in code points, in order, from a run's first word to its last.

    A null text or one without a letter is ``und`` with score 0, without spans; so is every text
    if the model knows no language. A text with letters always gets a learned language. Ties go
    to the language first in order of name. Each row is labelled by itself: null ids and repeated
    rows are kept as they are. Only ``keep`` and the text are read; a column of ``keep`` with one
    of the new names is replaced. An empty table gives an empty result.
    """
    names = names if spans else names[:2]
    keep = tuple(c for c in keep if c.lower() not in {n.lower() for n in names})
    chosen = df.select(*keep)
    fields = chosen.schema.fields
    at_text = keep.index(text_col) if text_col in keep else len(keep)
    if at_text == len(keep):
        chosen = df.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text")))
    span_type = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        make_room()
        labels_of = np.array([*model.languages, UND], object)
        n_lang = len(model.languages)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(at_text))
            for lo, hi in slices(offsets, max(1 << 16, (1 << 23) // max(4, n_lang + 1))):
                n = hi - lo
                part = buf[offsets[lo] : offsets[hi]]
                pred, score = np.full(n, n_lang), np.zeros(n)
                spans_at, span_rows = np.zeros(n + 1, np.int32), None
                if n_lang and len(part):
                    starts, ends, labels, letters, counts = label(model, part, offsets[lo : hi + 1])
                    doc = np.repeat(np.arange(n), counts)
                    weight = np.bincount(doc * n_lang + labels, weights=letters, minlength=n * n_lang).reshape(n, -1)
                    total = weight.sum(axis=1)
                    lettered = total > 0
                    pred = np.where(lettered, weight.argmax(axis=1), pred)
                    score = np.where(lettered, weight.max(axis=1) / np.maximum(total, 1), 0.0)
                    if spans and len(starts):
                        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1]))))
                        tail = np.concatenate((head[1:], [len(starts)])) - 1
                        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                        zero = points[offsets[lo:hi] - offsets[lo]][doc[head]]
                        span_rows = (labels_of[labels[head]], points[starts[head]] - zero, points[ends[tail]] - zero)
                        spans_at = np.concatenate(([0], np.cumsum(np.bincount(doc[head], minlength=n)))).astype(np.int32)
                out = [batch.column(k).slice(lo, n) for k in range(len(keep))] + [pa.array(labels_of[pred], pa.string()), pa.array(score)]
                if spans:
                    lang, a, b = span_rows if span_rows else ([], [], [])
                    values = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(span_type))
                    out.append(pa.ListArray.from_arrays(pa.array(spans_at), values))
                yield pa.RecordBatch.from_arrays(out, [*keep, *names])

    kinds = ["string", "double", "array<struct<lang:string,start:bigint,end:bigint>>"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {k}" for n, k in zip(names, kinds, strict=False)])
    return chosen.mapInArrow(run, ddl)
