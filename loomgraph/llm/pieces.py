"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut before each run of spaces (no piece holds one further in), and distinct words that
aren't cached are encoded together: words of equal length advance position by position; at each,
hashes of the substrings that end there probe the sorted hashes of the pieces, and a vectorised
maximum over the candidates stores the backpointers.

A long word (a script without spaces, one letter again and again) is first cut wherever two
characters meet that stand side by side in no piece. What is still long goes, for a BPE model, in
windows of equal length that advance together. A window begins WARM characters early, as if the
text began there. The last piece of a prefix follows from those of the ``longest`` prefixes before
it, so where as many in a row agree with the window before, all that follow agree; a window that
doesn't is done again from where the one before it ended. Unigram models have no such test: there
a long word that can't be cut advances alone.

A unigram model maximises the sum of piece scores. For a BPE model that sum would give other
pieces than merging does, so there a candidate's score says whether the step is one that merging
could take: the piece before and this piece must not merge across their border. Each prefix then
has exactly one last piece, so the same pass gives the model's own encoding.
"""

from __future__ import annotations

import re
import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U
from .common import Generations, slices, text_buffer
from .wordcache import WordIds

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_WORDS, CACHE_ODD = 700_000, 50_000
#: Code points: words beyond CUT are cut at sure borders, what is beyond LONG goes in windows of
#: STEP + WARM, WINDOWS at a time, and a window that disagrees is done again MEND by MEND.
CUT, LONG, STEP, WARM, WINDOWS, MEND = 48, 512, 512, 128, 2048, 64
_SPACE_ONLY = np.arange(256) == 0x20
_B = U(0x9E3779B97F4A7C15)
_models: dict[str, PieceModel] = {}


def _fields(raw: bytes):
    """Field number and value of a protobuf message; nested ones stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", raw[at : at + n])[0], at + n
        yield key >> 3, value


class Lookup:
    """Values of 64-bit keys, -1 for others. A table of hash bits first rules most others out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.seen = np.zeros(1 << 21, bool)
        self.seen[(self.keys.astype(U) * _B) >> U(43)] = True

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(keys.astype(U) * _B) >> U(43)])
        if maybe.size:
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


class PieceModel:
    """Pieces of a ``.model`` file with the tables that the Viterbi pass needs. The file may have
    no normalisation rules beyond the space marks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, self.kind, self.byte_fallback, self.unk = [], UNIGRAM, False, 0
        self.dummy_prefix, squeeze, charsmap = True, True, b""
        for no, value in _fields(raw):
            if no == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif no == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif no == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, squeeze, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if self.kind not in (UNIGRAM, BPE) or squeeze or charsmap:
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        if any(kind == USER for _, _, kind in pieces) or any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("user-defined pieces, or pieces with an inner space, are not supported")
        self.pieces, self.kinds = [p for p, _, _ in pieces], np.array([k for _, _, k in pieces])
        self.unk = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.scores = np.array([s for _, s, _ in pieces])
        self.normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.longest = max(map(len, self.normal), default=1)
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unk_score = float(self.scores[self.kinds == NORMAL].min(initial=0.0)) - 10.0
        ids = np.array(list(self.normal.values()), np.int64)
        hashes = np.array([int(self._hash(np.array([[ord(c) for c in p]]))[0]) for p in self.normal], U) if self.normal else np.zeros(0, U)
        self.by_hash = Lookup(hashes, ids)
        inner = {ord(a) << 21 | ord(b) for p in self.normal for a, b in pairwise(p)}
        self.inner = np.array(sorted(inner), np.int64)
        # Neighbours without a piece of their own are one unknown piece in a unigram model.
        self.alone = np.array(sorted(ord(p) for p in self.normal if len(p) == 1), np.int64)
        self.warm = max(WARM, 2 * self.longest)
        if self.kind == BPE:
            self._merge_tables()
        self.cache, self.odd = WordIds(CACHE_WORDS), Generations(CACHE_ODD)
        # What decoding writes for each id.
        shown = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.shown, self.shown_len = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        h = np.zeros(len(points), U)
        for j in range(points.shape[1]):
            h = h * _B + points[:, j].astype(U) + U(1)
        return h

    def _merge_tables(self) -> None:
        """For each piece its rank (lower merges first; a single character has -1) and the two
        parts of its last merge; the sorted pairs of pieces whose concatenation is a piece."""
        n = len(self.pieces)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        order = sorted(self.normal.values(), key=lambda i: -self.scores[i])
        for r, i in enumerate(order):
            if len(self.pieces[i]) > 1:
                self.rank[i] = r
        self.reachable = np.zeros(n, bool)
        for p, i in self.normal.items():
            parts = list(p)
            while len(parts) > 1:
                best = min(((self.rank[j], k) for k, (a, b) in enumerate(pairwise(parts)) if (j := self.normal.get(a + b)) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                if len(parts) == 2:
                    self.left[i], self.right[i] = self.normal.get(parts[0], -1), self.normal.get(parts[1], -1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.reachable[i] = len(parts) == 1
            if len(p) > 1 and self.reachable[i] and max(self.rank[self.left[i]] if self.left[i] >= 0 else -1, self.rank[self.right[i]] if self.right[i] >= 0 else -1) >= self.rank[i]:
                raise ValueError(f"the piece {p!r} ranks before its parts")
        pairs = {(self.normal[p[:k]], self.normal[p[k:]]): i for p, i in self.normal.items() for k in range(1, len(p)) if p[:k] in self.normal and p[k:] in self.normal}
        # A character that is no piece of its own merges too, if a longer piece starts with it.
        if any(c not in self.normal for p in self.normal for c in p):
            raise ValueError("a piece has a character that is no piece")
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int64)
        self.pairs = Lookup(keys, self.rank[made])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces ``a`` and ``b`` (-1: no piece) alone.

        The symbols at the border are nodes on the right edge of ``a``'s merge tree and on the
        left edge of ``b``'s. Two of them merge if they stand there together before either is
        merged away; on equal ranks the left one goes first. The walk goes back in time."""
        far = np.int64(1 << 60)
        ok = np.ones(len(a), bool)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[open_], b[open_]
        px, py = np.full(len(x), far), np.full(len(x), far)
        n = len(self.pieces)
        while len(open_):
            rank = self.pairs.get(x * n + y)
            rx, ry = self.rank[x], self.rank[y]
            crossed = (rank >= 0) & (rank < px) & (rank <= py)
            ok[open_[crossed]] = False
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            open_, x, y, px, py, rx, ry = (v[go] for v in (open_, x, y, px, py, rx, ry))
            first = rx > ry
            px, py = np.where(first, rx, px), np.where(first, py, ry)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def _apart_distinct(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`apart`, worked out once for each distinct pair."""
        n = len(self.pieces) + 1
        key, back = np.unique((a + 1) * n + b + 1, return_inverse=True)
        return self.apart(key // n - 1, key % n - 1)[back]

    def _forward(self, points: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Size and number (-1: none) of the last piece of every prefix, positions by words. With
        ``before``, the numbers at the ``longest`` positions before the words (the latest last),
        ``points`` begins with the code points of those positions; sizes and numbers are those
        after them."""
        given = 0 if before is None else self.longest
        w, n = points.shape
        prefix = np.zeros((n + 1, w), U)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _B + points[:, j].astype(U) + U(1)
        power = np.array([pow(int(_B), k, 1 << 64) for k in range(self.longest + 1)], U)
        back = np.zeros((n + 1, w), np.int32)
        last = np.full((n + 1, w), -1, np.int64)
        best = np.zeros((n + 1, w))
        if given:
            last[1 : given + 1] = before
        for j in range(given + 1, n + 1):
            best[j] = -np.inf
            for size in range(1, min(j - bool(given), self.longest) + 1):
                piece = self.by_hash.get(prefix[j] - prefix[j - size] * power[size])
                if size == 1:
                    use = np.arange(w)
                else:
                    use = np.flatnonzero(piece >= 0)
                if not use.size:
                    continue
                piece = piece[use]
                if self.kind == BPE:
                    good = (piece < 0) | self.reachable[piece]
                    good[good] = self._apart_distinct(last[j - size, use[good]], piece[good])
                    good &= best[j - size, use] == 0
                    value = np.where(good, 0.0, -np.inf)
                else:
                    value = best[j - size, use] + np.where(piece >= 0, self.scores[piece], self.unk_score)
                better = value > best[j, use]
                to = use[better]
                best[j, to], back[j, to], last[j, to] = value[better], size, piece[better]
        return back[given:], last[given:]

    def _long(self, points: np.ndarray) -> bytes:
        """Ids of one long word of a BPE model, by windows."""
        n, warm, span = len(points), self.warm, self.longest
        back, last = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int64)
        done = 0  # the sizes and numbers of all prefixes up to here are known
        again: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        while done < n:
            # The first window is the text's own begin, or begins early like the others.
            first = max(0, done - warm)
            count = min(WINDOWS, max(1, -(-(n - first - warm) // STEP)))
            at = first + STEP * np.arange(count)[:, None] + np.arange(STEP + warm)[None, :]
            b, x = self._forward(np.where(at < n, points[np.minimum(at, n - 1)], 0))
            for k in range(count):
                lo = first + k * STEP
                hi = min(n, lo + STEP + warm)
                at = lo + warm if lo else 0
                while at and at < hi and not np.array_equal(x[at - lo - span + 1 : at - lo + 1, k], last[at - span + 1 : at + 1]):
                    to = min(at + MEND, hi)
                    here, state = points[at - span : to], last[at - span + 1 : at + 1]
                    key = (here.tobytes(), state.tobytes())
                    if key not in again:
                        if len(again) > 1 << 14:
                            again.clear()
                        got = self._forward(here[None, :], state[:, None])
                        again[key] = got[0][1:, 0], got[1][1:, 0]
                    back[at + 1 : to + 1], last[at + 1 : to + 1] = again[key]
                    at = to
                back[at + 1 : hi + 1], last[at + 1 : hi + 1] = b[at - lo + 1 : hi - lo + 1, k], x[at - lo + 1 : hi - lo + 1, k]
                done = hi
        ends, at, sizes = [], n, back.tolist()
        while at:
            ends.append(at)
            at -= sizes[at]
        ends = np.array(ends[::-1])
        ids = np.where(last[ends] >= 0, last[ends], -1 - points[ends - 1].astype(np.int64))
        return np.array(self._spell(ids.tolist()) if (ids < 0).any() else ids, "<u4").tobytes()

    def _viterbi(self, points: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids of words of ``sizes`` characters, filled up to one length: what a prefix is cut
        into doesn't depend on what follows."""
        w = len(points)
        back, last = self._forward(points)
        # All words step back together; what step s finds is the s-th piece from the end.
        word, place, ids = [], [], []
        at, rows, step = sizes.copy(), np.arange(w), 0
        while rows.size:
            here = at[rows]
            piece = last[here, rows]
            word.append(rows)
            place.append(np.full(len(rows), step))
            ids.append(np.where(piece >= 0, piece, -1 - points[rows, here - 1].astype(np.int64)))
            at[rows] = here - back[here, rows]
            rows, step = rows[at[rows] > 0], step + 1
        word, place, ids = np.concatenate(word), np.concatenate(place), np.concatenate(ids)
        order = np.lexsort((-place, word))
        ids, ends = ids[order], np.cumsum(np.bincount(word, minlength=w))
        raw, odd = ids.astype("<u4").tobytes(), np.zeros(w, bool)
        odd[word[order][ids < 0]] = True
        starts = np.concatenate(([0], ends[:-1]))
        return [np.array(self._spell(ids[a:b].tolist()), "<u4").tobytes() if o else raw[4 * a : 4 * b] for a, b, o in zip(starts.tolist(), ends.tolist(), odd.tolist(), strict=True)]

    def _spell(self, ids: list[int]) -> list[int]:
        """Code points without a piece become bytes, or unknown pieces (a run of them is one in a
        unigram model)."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes_[b] for b in chr(-1 - i).encode("utf-8", "replace"))
            elif not (self.kind == UNIGRAM and out and out[-1] == self.unk):
                out.append(self.unk)
        return out

    def _parts(self, word: str) -> list[str]:
        """``word`` cut where no piece and no run of unknown characters goes on."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = points[:-1] << 21 | points[1:]
        joined = np.isin(pair, self.inner)
        if self.kind == UNIGRAM:
            odd = ~np.isin(points, self.alone)
            joined |= odd[:-1] & odd[1:]
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in pairwise(cuts)]

    def words(self, words: list[str]) -> dict[str, bytes]:
        cut = {x: self._parts(x) for x in words if len(x) > CUT}
        by: dict[int, set[str]] = {}
        for x in words:
            for p in cut.get(x, (x,)):
                n = len(p)
                # Beyond 24 characters lengths are filled up to a multiple of 8 or 64.
                by.setdefault(n if n <= 24 or n > LONG else -(-n // 8) * 8 if n <= 128 else -(-n // 64) * 64, set()).add(p)
        out = {}
        for n, group in by.items():
            group = list(group)
            if n > LONG and self.kind == BPE:
                for x in group:
                    out[x] = self._long(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32))
                continue
            step = max(1, min(10_000, 1_000_000 // (n + 1)))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                points = np.frombuffer("".join(x.ljust(n, "\0") for x in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                out.update(zip(part, self._viterbi(points, np.array([len(x) for x in part])), strict=True))
        return {x: b"".join([out[p] for p in cut[x]]) if x in cut else out[x] for x in words}

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with any spaces."""
        split = [re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", (SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*split)
        known = self.odd.take(words)
        fresh = self.words([w for w in words if w not in known])
        self.odd.add(fresh)
        known.update(fresh)
        return [b"".join([known[w] for w in words]) for words in split]

    def _after_space(self, raw: list[bytes]) -> list[bytes]:
        words = [SPACE + w.decode("utf-8", "replace") for w in raw]
        made = self.words(list(set(words)))
        return [made[w] for w in words]

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        n = len(offsets) - 1
        # A text without a double, leading or trailing space or a space mark is its words, each
        # with one space before it.
        plain = np.full(n, self.dummy_prefix)
        space = np.concatenate((buf == 0x20, [False]))
        of = lambda at: np.searchsorted(offsets, at, side="right") - 1
        plain[of(np.flatnonzero(space[:-1] & space[1:]))] = False
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        plain[full[space[offsets[full]] | space[offsets[full + 1] - 1]]] = False
        mark = np.flatnonzero(buf == 0xE2)
        mark = mark[(mark + 2 < len(buf))]
        plain[of(mark[(buf[mark + 1] == 0x96) & (buf[mark + 2] == 0x81)])] = False
        ids, at = self.cache.encode(buf, offsets, _SPACE_ONLY, self._after_space)
        raw, at = ids.tobytes(), (4 * at).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        other = np.flatnonzero(~plain).tolist()
        for i, x in zip(other, self._spaced([buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in other]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        return self.encode_buffer(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ``ids`` spell, without the space put before it."""
        size = self.shown_len[ids]
        total = int(size.sum())
        at = np.repeat(self.shown_at[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        raw = self.shown[at].tobytes()
        return raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit): one row for each row. A null or empty text
    has no ids. Null ids and repeated rows are kept; other columns are ignored."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, 1 << 21):
                ids = m.encode_buffer(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text``: what the ids spell. Null ids give a null text; bytes that are no
    UTF-8 become replacement characters. An input column named text is replaced."""
    kept = [c for c in df.columns if c != "text"]
    at = kept.index(ids_col)

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if x is None else m.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, "text"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    return df.select(*kept).mapInArrow(run, f"{ddl}, text string")
