"""SpotSigs fingerprints.

A signature is a chain: a common word (an anchor) and the next ``chain`` content words after it.
Common are the listed words of four languages, listed characters of three more, and those that stand in a share of the corpus's
documents, which are counted first. In scripts without spaces each character is a word.
A document's fingerprint is the sorted set of its signatures' 32-bit hashes. Fingerprints are
partitioned by their length, since a Jaccard similarity of t needs lengths within the factor t,
and compared only where lengths and a shared rare signature allow it.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NOT_WORD, U, hash_word, hashed_words, mix
from .common import saved, slices, text_buffer

CHAIN = 2
#: A common word stands in this share of the documents, and in FEWEST of them at least.
COMMON, FEWEST = 0.05, 20
#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was were which will with would you
als am auf aus bei das dem den der des die ein eine einem einen einer es für ich im ist mit nicht noch oder sich sie sind so und von war wie wird zu zum zur
au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas pour plus qui que sa se ses son sont sur un une vous
al como con del el ella ellos entre era esta este fue ha hay las lo los más mi muy no nos para pero por porque sin sobre su sus también una uno y ya
""".split()
#: Common characters of Chinese, Japanese and Thai, which are words here.
ANCHORS += "的 一 是 不 了 在 有 和 也 の は を に が で と も า น ร อ".split()
_ANCHOR_HASHES = np.sort(np.array(sorted({hash_word(w) for w in ANCHORS}), U))


def anchors_of(df: DataFrame, text_col: str = "text", share: float = COMMON, fewest: int = FEWEST) -> np.ndarray:
    """Hashes of the listed words and of all words that stand in ``share`` of the texts, ascending.
    Texts that repeat count each time; null texts have no words. The driver gets the common words
    alone: if a text has w different words on average, at most w / share of them."""

    def count(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets, 1 << 21):
                words, counts = hashed_words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NOT_WORD, single=True)
                doc = np.repeat(np.arange(hi - lo), counts)
                order = np.lexsort((words, doc))
                words, doc = words[order], doc[order]
                once = np.ones(len(words), bool)
                once[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
                word, n = np.unique(words[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    texts = df.select(F.col(text_col).cast("string").alias("text"))
    least = max(fewest, share * texts.count())
    found = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.union1d(_ANCHOR_HASHES, np.array([r["word"] for r in found.select("word").collect()], np.int64).view(U))


def signatures(buf: np.ndarray, offsets: np.ndarray, chain: int = CHAIN, anchors: np.ndarray = _ANCHOR_HASHES) -> list[np.ndarray]:
    """For each text the sorted distinct signatures. A text with words but without a whole chain
    has one signature, of all its words; a text without words has one of its bytes, if any."""
    words, counts = hashed_words(buf, offsets, NOT_WORD, single=True)
    at = np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)
    is_anchor = anchors[at] == words
    content = np.flatnonzero(~is_anchor)
    before = np.cumsum(~is_anchor)
    spots = np.flatnonzero(is_anchor)
    nth = before[spots]  # the first content word after an anchor
    good = nth + chain <= len(content)
    spots, nth = spots[good], nth[good]
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, spots, side="right")
    good = content[nth + chain - 1] < ends[doc] if len(spots) else np.zeros(0, bool)
    spots, nth, doc = spots[good], nth[good], doc[good]
    h = words[spots] * U(0x9E3779B97F4A7C15)
    for k in range(chain):
        h = mix(h + words[content[nth + k]] * U(2 * k + 3)) if len(spots) else h
    h = (mix(h) >> U(32)).astype(np.uint32)
    per = np.bincount(doc, minlength=len(counts)).tolist()
    out, lo = [], 0
    for i, n in enumerate(per):
        if n:
            out.append(np.unique(h[lo : lo + n]))
        else:
            a, b = int(offsets[i]), int(offsets[i + 1])
            own = words[int(ends[i]) - int(counts[i]) : int(ends[i])] if counts[i] else buf[a:b].astype(U)
            seed = mix(np.arange(1, len(own) + 1, dtype=U))
            out.append((mix((mix(own) * seed).sum(keepdims=True)) >> U(32)).astype(np.uint32) if len(own) else np.zeros(0, np.uint32))
        lo += n
    return out


def likeness(x: np.ndarray, y: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 1 for two empty ones. Below ``threshold`` the
    answer may be 0: lengths alone can rule it out."""
    if not len(x) and not len(y):
        return 1.0
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) or not len(x) or not len(y):
        return 0.0
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def text_form(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype("<u4").tobytes()).decode()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, anchors: np.ndarray | None = None) -> DataFrame:
    """``doc_id, fingerprint``: one row for each row, with the table's own common words or the
    given ``anchors``. Null and empty texts have the empty fingerprint; null ids and repeated rows
    are kept; other columns are ignored; an empty table gives an empty result."""
    anchors = anchors_of(df, text_col) if anchors is None else anchors

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, 1 << 21):
                found = signatures(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chain, anchors)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(map(text_form, found), pa.string())], ["doc_id", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def similar(fps: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """From ``doc_id, fingerprint``: pairs ``(a, b, likeness)`` of classes of equal fingerprints
    (each named by its smallest id) with at least ``threshold``, and the membership
    ``(doc_id, class_id)``. Empty fingerprints and null ids are in no class.

    Length partitions are powers of 1 / threshold: a class meets its own and the next one only.
    In each, it is listed under the rarest ``n - ceil(threshold * n) + 1`` of its signatures, which
    any partner must share one of, so frequent signatures list few.
    """
    named = fps.filter("doc_id is not null and fingerprint <> ''")
    classes = saved(named.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "spots")
    members = named.join(classes, "fingerprint").select("doc_id", "class_id")

    def spread(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fp = np.frombuffer(base64.b64decode(text), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i)), pa.array(np.full(len(fp), len(fp), np.int32)), pa.array(fp)], ["class_id", "n", "sig"])

    listed = classes.select("class_id", "fingerprint").mapInArrow(spread, "class_id long, n int, sig long")
    often = listed.groupBy("sig").agg(F.count("*").alias("often")).filter("often > 1")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("often", "sig"))
    # Signatures of one class alone come first in order, so they take places without being kept.
    alone = listed.join(often, "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    prefix = alone.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).filter("often > 1")
    band = F.floor(F.log("n") / F.lit(float(np.log(1 / threshold)) if threshold < 1 else 1e-9)).cast("long")
    prefix = saved(prefix.select("class_id", "n", "sig", band.alias("band")), "prefix")
    x = prefix.select(F.col("class_id").alias("x"), F.col("n").alias("nx"), "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    y = prefix.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), "sig", "band")
    near = x.join(y, ["sig", "band"]).filter((F.col("x") != F.col("y")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")))
    pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def compare(batches):
        for batch in batches:
            like = [likeness(*(np.frombuffer(base64.b64decode(s), "<u4") for s in fs), threshold) for fs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    of = lambda n: classes.select(F.col("class_id").alias(n), F.col("fingerprint").alias(f"f{n}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "fa", "fb")
    return full.mapInArrow(compare, "a long, b long, likeness double").filter(F.col("likeness") >= threshold), members
