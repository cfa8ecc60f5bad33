"""Token ids of a JSON tokenizer, encoded once per distinct white-space-delimited word.

White space never joins two words in one token of such a tokenizer (its pre-tokenizer removes
it), so a text's ids are those of its words in order. Each Python worker keeps a bounded cache of
words; the tokenizer library encodes the words that are missing.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Generations, slices, text_buffer
from .wordcache import WordIds

CACHE_WORDS, CACHE_STEMS = 1_000_000, 100_000
#: Bytes of text that are encoded at once: their ids and places take 15 times as much.
SLICE = 1 << 19
#: Space, tab and line ends.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0D]] = True
END_ID = 1
#: Marks that may follow a word; each is a word of its own to the tokenizer.
MARKS = ".,;:!?|"
_encoders: dict[str, WordEncoder] = {}
KEPT.append(_encoders)


class WordEncoder:
    """``ids(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.stems = WordIds(CACHE_WORDS), Generations(CACHE_STEMS)
        self.parting: dict[str, bool] = {}
        self.marks = dict(zip(MARKS, self._words(list(MARKS)), strict=True)) | {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lowers = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        # Words may be encoded apart only if the pre-tokenizer drops white space.
        self.by_word = '"Removed"' in json.dumps(spec.get("pre_tokenizer")) and "\\\\s" in json.dumps(spec.get("pre_tokenizer")) and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or [])

    def _words(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, letter: str) -> bool:
        """Whether a mark after this letter is a word of its own. It isn't where the normaliser
        ends the letter in a sign: a dotted capital I becomes i and a combining dot."""
        if letter not in self.parting:
            both = self._words([letter, *(letter + x for x in MARKS)])
            self.parting[letter] = all(x == both[0] + self.marks[m] for x, m in zip(both[1:], MARKS, strict=True))
        return self.parting[letter]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, encoded as one text; each is one word to the tokenizer too."""
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        of = np.array(coded.word_ids, np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
        if len(cuts) != len(words) + 1:
            return self._words(words)
        raw, cuts = np.array(coded.ids, "<u4").tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _missing(self, raw: list[bytes]) -> list[bytes]:
        """Ids of new words. A word of letters and one mark after them is both apart, and plain
        letters count in lower case, if the tokenizer lowers them anyhow."""
        parts: list[tuple[str, str]] = []
        stems: set[str] = set()
        others: set[str] = set()
        for w in raw:
            w = w.decode("utf-8", "replace")
            mark = w[-1]
            stem, mark = (w[:-1], mark) if mark in MARKS else (w, "")
            if stem.isalpha() and (not mark or stem[-1].isascii() or self._parts(stem[-1])):
                if self.lowers and stem.isascii():
                    stem = stem.lower()
                stems.add(stem)
                parts.append((stem, mark))
            else:
                others.add(w)
                parts.append((w, ""))
        known = self.stems.take(stems)
        letters, odd = [x for x in stems if x not in known], list(others)
        fresh: dict[str, bytes] = {}
        for lo in range(0, len(letters), 10_000):
            fresh.update(zip(letters[lo : lo + 10_000], self._letters(letters[lo : lo + 10_000]), strict=True))
        self.stems.add(fresh)
        known.update(fresh)
        for lo in range(0, len(odd), 10_000):
            known.update(zip(odd[lo : lo + 10_000], self._words(odd[lo : lo + 10_000]), strict=True))
        marks = self.marks
        return [known[stem] + marks[mark] for stem, mark in parts]

    def buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and the n + 1 offsets of each text's."""
        if self.by_word:
            return self.cache.encode(buf, offsets, SEPARATORS, self._missing)
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = self._words(texts)
        return np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))

    def texts(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        ids, at = self.buffer(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_groups(texts: list[str], limit: int = 1 << 21):
    """Lists of texts of about ``limit`` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids, then END_ID, cut into runs of ``capacity``; only a last run is shorter.

    Columns: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids`` (little-endian
    unsigned 32-bit). A null text counts as empty, so it is END_ID alone.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                base = int(offsets[lo])
                ids, at = enc.buffer(buf[base : offsets[hi]], offsets[lo : hi + 1] - base)
                raw, at = ids.tobytes(), (4 * at).tolist()
                rows: list[tuple] = []
                for doc, a, b in zip(docs[lo:hi], at[:-1], at[1:], strict=True):
                    whole = raw[a:b] + end
                    for k, cut in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[cut : cut + 4 * capacity]
                        rows.append((doc, k, cut // 4, len(part) // 4, zlib.crc32(part), part)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
