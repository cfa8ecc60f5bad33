"""MinHash near-duplicates through a multi-index Hamming join.

A document is its set of distinct five-word shingles. Its signature has ``chunks * width``
symbols of 16 bits, one for each MinHash function; two signatures differ at a symbol with
probability 1 - J. The signature is split into ``chunks`` chunks. By the pigeonhole principle two
signatures within ``radius = chunks * (errors + 1) - 1`` differing symbols have a chunk with at
most ``errors`` of them; every choice of ``errors`` symbols to leave out of a chunk is enumerated
as a key, so all pairs within the radius share a key. Pairs beyond the radius are mostly found
too: with 12 chunks of five symbols and one allowed error, a pair at similarity 0.75 shares no
key with probability 0.37 ** 12 = 6e-6.

Documents with equal sets are one class from the start. A key's classes are first compared with
one of them, the hub (a star, never all pairs): the one whose keys have the most classes in all,
which is the text that the others of a family were made from, if it is there. The links that the
full sets confirm give components. Then the pairs of a key that are still in different components are compared, less
those whose parity sketches rule a link out: a sketch has a bit for each of 2048 hash values, the
parity of the set's shingles there, so two sketches never differ in more bits than the sets do in
shingles. A pair inside one component needs no look, since it can't change the result. Neither
loses a connection.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U, hashed_words, mix, shingle_sets
from .common import make_room, saved, slices, text_buffer

SHINGLE_WORDS, CHUNKS, WIDTH, ERRORS = 5, 12, 5, 1
SLICE = 1 << 21
SKETCH_LONGS = 32
#: 8 bytes each: a broadcast of a few MB.
BROADCAST_IDS = 250_000
PART_PAIRS = 1024


def signatures(sets: list[np.ndarray], functions: int, block: int = 1 << 15) -> np.ndarray:
    """MinHash symbols (16 bits) of non-empty sets."""
    seeds = mix(np.arange(1, 2 * functions + 1, dtype=U) * U(0xA0761D6478BD642F))
    out = np.zeros((len(sets), functions), np.uint16)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= block):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        least = np.empty((functions, hi - lo), U)
        room = np.empty(len(flat), U)
        for j in range(functions):
            np.multiply(flat, seeds[2 * j] | U(1), out=room)
            room += seeds[2 * j + 1]
            least[j] = np.minimum.reduceat(room, starts)
        out[lo:hi] = (mix(least.T) >> U(24)).astype(np.uint16)
        lo = hi
    return out


def chunk_keys(symbols: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """All keys of each signature: a chunk's symbols without any ``errors`` of them."""
    parts = symbols.reshape(len(symbols), chunks, width).astype(U)
    factors = mix(np.arange(1, chunks * width + 1, dtype=U)).reshape(chunks, width) | U(1)
    out = []
    for v, left in enumerate(combinations(range(width), width - errors)):
        pick = list(left)
        out.append(mix((parts[:, :, pick] * factors[None, :, pick]).sum(axis=2, dtype=U) + mix(np.arange(chunks, dtype=U) * U(1000) + U(v + 1))[None, :]))
    return np.concatenate(out, axis=1).view(np.int64)


def parity_sketch(items: np.ndarray) -> np.ndarray:
    """SKETCH_LONGS * 64 bits: the parity of how many items fall on each bit."""
    hit = np.bincount((items >> U(20)) & U(64 * SKETCH_LONGS - 1), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(hit.astype(bool)).view(np.int64)


def sign(df: DataFrame, id_col: str, text_col: str, shingle_words: int, functions: int) -> DataFrame:
    def run(batches):
        make_room()
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                words, counts = hashed_words(buf, offsets[lo : hi + 1])
                sets = shingle_sets(words, counts, shingle_words)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                symbols = np.zeros((hi - lo, functions), np.uint16)
                if full.size:
                    symbols[full] = signatures([sets[i] for i in full], functions)
                digest = [(int(mix(s).sum(dtype=U)) << 64 | int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))).to_bytes(16, "big") for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in symbols], pa.binary())], ["id", "n", "digest", "symbols"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, digest binary, symbols binary")


def _keys(classes: DataFrame, functions: int, chunks: int, width: int, errors: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                symbols = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, functions)
                keys = chunk_keys(symbols, chunks, width, errors)
                each = keys.shape[1]
                pick = np.repeat(np.arange(len(keys)), each)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(pick)), part.column(1).take(pa.array(pick))], ["key", "id", "n"])

    return classes.select("id", "n", "symbols").mapInArrow(run, "key long, id long, n long")


def _sketched(full: DataFrame) -> DataFrame:
    names = ["id", *(f"k{j}" for j in range(SKETCH_LONGS))]

    def run(batches):
        for batch in batches:
            bits = np.array([parity_sketch(np.frombuffer(x.as_buffer(), U)) for x in batch.column(1)], np.int64).reshape(-1, SKETCH_LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH_LONGS))], names)

    return full.select("id", "items").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _full_sets(wanted: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """The whole shingle sets of the wanted ids. Up to BROADCAST_IDS of them are broadcast, which
    spares a shuffle of all texts; beyond that it is a shuffled semi-join."""

    def sets(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                found = shingle_sets(*hashed_words(buf, offsets[lo : hi + 1]), shingle_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "items"])

    few = wanted.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    return saved(found.select("id", "text").mapInArrow(sets, "id long, items binary"), "sets")


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A large family's hub stands in many pairs: its set goes to a part for each PART_PAIRS of them.
    parts = saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).cast("int").alias("parts")), "parts")
    a = full.select(F.col("id").alias("a"), F.col("items").alias("items_a")).join(parts, "a").select("a", "items_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = full.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    joined = dealt.join(b, "b").join(a, ["a", "part"]).select("a", "b", "items_a", "items_b")
    return joined.mapInArrow(compare, "a long, b long")


def _smaller_first(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of the ids in ``edges`` (u, v): the smallest id that is reachable. An id that
    is its own label is missing.

    A round takes two steps, which keep the components. First every id hands the smallest of
    itself and all its neighbours to its larger neighbours, then to its smaller ones and itself.
    An edge's smaller end thus jumps, as pointers do when they are doubled: a chain of length n
    takes about log2(n) rounds, whatever the order of its ids. No id's neighbours meet in one
    task: each step is a minimum and a join. The rounds end when every id has either one smaller
    neighbour or only larger ones, so that the edges are the result.
    """
    edge = saved(edges.select(*_smaller_first("u", "v")).filter("u < v").distinct(), "edges")
    while True:
        roles = edge.select(F.col("v").alias("id"), F.lit(1).alias("n")).unionByName(edge.select(F.col("u").alias("id"), F.lit(0).alias("n")))
        held = roles.groupBy("id").agg(F.sum("n").alias("up"), F.min("n").alias("kind"))
        if held.filter("up > 1 or (up = 1 and kind = 0)").isEmpty():
            return edge.select(F.col("v").alias("id"), F.col("u").alias("label"))
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = edge.join(least, "u").select(F.col("least").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(least, "v").select(F.col("least").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        edge = saved(small.filter("u < v").distinct(), "edges")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle_words: int = SHINGLE_WORDS,
    chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS,
) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_shingles, component_id, kept``.

    A null or empty text has no shingles and is linked with nothing. A null id takes no part: its
    component is null and it is kept. Rows that repeat an id are one document if their texts have
    equal sets; otherwise the id's classes are joined in one component. Other columns are
    ignored. An empty table gives an empty result. Ties can't occur: the smallest id is kept.
    """
    functions = chunks * width
    signed = saved(sign(df, id_col, text_col, shingle_words, functions), "signed")
    in_classes = signed.filter("n > 0 and id is not null")
    classes = saved(in_classes.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("symbols").alias("symbols")), "classes")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    fits = lambda x, y: F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")
    keys = _keys(classes, functions, chunks, width, errors)
    sizes = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    shared = saved(keys.join(sizes, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"), "n")).alias("hub"))
    members = saved(shared.join(hubs.select("key", (-F.col("hub.less")).alias("a"), F.col("hub.n").alias("n_a")), "key").filter("id <> a").select("key", "id", "n", "a", "n_a"), "members")
    stars = saved(members.filter(fits("n", "n_a")).select("a", F.col("id").alias("b")).distinct(), "stars")
    wanted = saved(shared.select("id").distinct(), "wanted")
    full = _full_sets(wanted, texts, shingle_words)
    links = saved(_confirm(stars, full, percent), "links")
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    label = labels.select(F.col("id"), "label")
    tagged = members.select("key", "id", "n").join(label, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("part"))
    # The part with the most members of a key has no links to look for inside it: only the others
    # meet all of the key's members.
    parts = tagged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("size", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", F.col("most.part").alias("most"))
    sketches = _sketched(full)
    rest = saved(tagged.join(open_keys, "key").withColumn("main", F.expr("part = most")).drop("most").join(sketches, "id"), "rest")
    x = rest.filter(~F.col("main")).select("key", *[F.col(c).alias(f"x_{c}") for c in rest.columns if c != "key"])
    y = rest.select("key", *[F.col(c).alias(f"y_{c}") for c in rest.columns if c != "key"])
    apart = " + ".join(f"bit_count(x_k{j} ^ y_k{j})" for j in range(SKETCH_LONGS))
    # The sets of a link differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
    near = f"(y_main or x_id < y_id) and x_part <> y_part and {100 + percent} * ({apart}) <= {100 - percent} * (x_n + y_n)"
    pairs = x.join(y, (x["key"] == y["key"]) & F.expr(near) & fits("x_n", "y_n"))
    pairs = saved(pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    more = saved(_confirm(pairs, full, percent), "more")
    # An id whose rows have different sets holds their classes together.
    ids = in_classes.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("id")
    same = in_classes.join(ids, "id", "left_semi").select("id", "digest").join(classes.select("digest", F.col("id").alias("v")), "digest").select(F.col("id").alias("u"), "v")
    if not more.isEmpty() or not same.isEmpty():
        known = labels.select(F.col("label").alias("u"), F.col("id").alias("v"))
        labels = components(known.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(same))
    named = classes.select("digest", F.col("id").alias("class_id")).join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left").select("digest", F.coalesce("label", "class_id").alias("label"))
    out = signed.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col("id"))).alias("kept"))
