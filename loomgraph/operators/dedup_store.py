"""A deduplicating file store: chunk index, recipes, containers, upload, download, delete, report.

Metadata are deltas: a commit writes the index and recipe rows that it adds and the names that it
takes away, under a number of its own, and a marker file that is created only if it isn't there
commits it. The state is that of the newest checkpoint at or before the newest commit, with the
later deltas applied; every CHECKPOINTS commits a checkpoint folds them. So a failed run changes
nothing, of two runs that start from one version the second one fails, and a commit costs what it
changes. Chunk bytes lie in containers of up to CONTAINER_BYTES, each one row; a chunk is read out
of its container by offset and size. Reference counts are derived from the recipes.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from .chunking import chunk

CONTAINER_BYTES = 1 << 20
RANGE_CHUNKS = 500
CHECKPOINTS = 16
#: Containers whose live share of bytes is less are written anew by a vacuum.
COMPACT = 0.5
INDEX = "hash string, container_id long, offset long, size long"
RECIPE = "path string, chunk_no int, hash string"
CONTAINERS = "container_id long, content binary"
_MARKER = re.compile(r"(delta|full) ([0-9]+-[0-9a-f]{32})")


class Conflict(RuntimeError):
    """Another run has committed since this one read the store; nothing was changed."""


def running_total(rows: DataFrame, key: str, value: str, partitions: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over smaller keys. Each range of keys sums up
    by itself; the driver adds one number per range."""
    dealt = saved(rows.repartitionByRange(partitions, key).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect()
    base, total = [], 0
    for r in sums:
        base += [F.lit(r["_range"]), F.lit(total)]
        total += r["s"]
    if not base:
        return dealt.drop("_range").withColumn("before", F.lit(0).cast("long"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("before", F.coalesce(inside, F.lit(0)) + F.create_map(*base)[F.col("_range")].cast("long")).drop("_range")


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """One row per hash: the chunk first in order of path and number."""
    first = chunks.groupBy("hash").agg(F.min(F.struct("path", "chunk_no", "size")).alias("f"))
    return first.select("hash", "f.path", "f.chunk_no", "f.size")


def next_fit(new_chunks: DataFrame, first_id: int = 0, capacity: int = CONTAINER_BYTES, more: tuple[str, ...] = ()) -> DataFrame:
    """``hash, container_id, offset, size``, then the columns ``more``: each file's new chunks, in
    order, fill containers of its own, numbered on from ``first_id`` in order of path."""
    spark = new_chunks.sparkSession

    def place(frames):
        for pdf in frames:
            for path, items in zip(pdf["path"], pdf["items"], strict=True):
                used, seq, rows = 0, 0, []
                for x in items:
                    if used + x["size"] > capacity:
                        used, seq = 0, seq + 1
                    rows.append((path, x["chunk_no"], x["hash"], seq, used, x["size"]))
                    used += x["size"]
                yield pd.DataFrame(rows, columns=["path", "chunk_no", "hash", "seq", "offset", "size"])

    per_file = new_chunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "hash", "size"))).alias("items"))
    placed = saved(per_file.mapInPandas(place, "path string, chunk_no int, hash string, seq long, offset long, size long"), "placed")
    counts = placed.groupBy("path").agg((F.max("seq") + 1).alias("n"))
    base = running_total(counts, "path", "n", max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return placed.join(base, "path").select("hash", (F.col("before") + F.col("seq") + first_id).alias("container_id"), "offset", "size", *more)


def refcounts(recipe: DataFrame) -> DataFrame:
    return recipe.groupBy("hash").agg(F.count("*").alias("refs"))


def liveness(recipe: DataFrame, index: DataFrame) -> DataFrame:
    """``container_id, refs, chunks``: references to and live chunks in each container."""
    return index.join(refcounts(recipe), "hash").groupBy("container_id").agg(F.sum("refs").alias("refs"), F.count("*").alias("chunks"))


def report(recipe: DataFrame, index: DataFrame) -> DataFrame:
    """One row: files, logical and unique chunks and bytes, containers, and their ratio."""
    files = recipe.select("path").distinct().agg(F.count("*").alias("files"))
    live = index.join(refcounts(recipe), "hash")
    sums = live.agg(
        F.coalesce(F.sum("refs"), F.lit(0)).alias("logical_chunks"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum(F.col("refs") * F.col("size")), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.count_distinct("container_id").alias("containers"), F.try_divide(F.sum(F.col("refs") * F.col("size")), F.sum("size")).alias("ratio"),
    )
    return files.crossJoin(F.broadcast(sums))  # one row each


def report_lines(report: DataFrame) -> list[str]:
    """The report as text, the ratio with two decimals."""
    r = report.first()
    names = ["files", "logical_chunks", "unique_chunks", "logical_bytes", "unique_bytes", "containers"]
    return [f"{n.replace('_', ' ')}: {r[n]}" for n in names] + [f"ratio: {r['ratio'] or 0:.2f}"]


def join_chunks(parts: DataFrame) -> DataFrame:
    """``path, content`` from ``path, chunk_no, content``: ranges of RANGE_CHUNKS chunks are joined
    first, then the ranges. A file is one cell in the end, so it has 2 GB at most."""
    glue = lambda no: F.expr(f"listagg(content, X'') WITHIN GROUP (ORDER BY {no})")
    ranges = parts.groupBy("path", F.floor((F.col("chunk_no") - 1) / RANGE_CHUNKS).alias("range")).agg(glue("chunk_no").alias("content"))
    return ranges.groupBy("path").agg(glue("range").alias("content"))


def _sealed(chunks: DataFrame) -> DataFrame:
    """``container_id, content`` from ``container_id, offset, content``: the chunks of a container
    side by side."""
    return chunks.groupBy("container_id").agg(F.expr("listagg(content, X'') WITHIN GROUP (ORDER BY offset)").alias("content"))


class DedupStore:
    """A store under a URI that Spark can write."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.fs.exists(self._path(folder)) else []

    def _commits(self) -> dict[int, tuple[str, str]]:
        """For each version the folder of its metadata and its kind; the marker holds both, in
        whole. One that isn't whole is of a commit under way, or of one that died."""
        out = {}
        for name in self._names("commits"):
            stream = self.fs.open(self._path(f"commits/{name}"))
            try:
                line = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if whole := _MARKER.fullmatch(line):
                out[int(name)] = (whole[2], whole[1])
        return out

    def version(self) -> int:
        """The newest committed version; 0 for an absent store, which is empty."""
        return max(self._commits(), default=0)

    def repair(self) -> list[int]:
        """Remove the markers of commits that died between creating and filling them, which hold
        up all later commits; their versions. Only while no other run commits."""
        broken = sorted({int(name) for name in self._names("commits")} - self._commits().keys())
        for v in broken:
            self.fs.delete(self._path(f"commits/{v}"), False)
        return broken

    def _parts(self) -> tuple[str | None, list[str]]:
        """The folder of the newest checkpoint, and those of the later deltas."""
        commits = self._commits()
        full = max((v for v, (_, kind) in commits.items() if kind == "full"), default=None)
        later = [folder for v, (folder, kind) in sorted(commits.items()) if kind != "full" and (full is None or v > full)]
        return None if full is None else commits[full][0], later

    def _table(self, folders: list[str], name: str, ddl: str) -> DataFrame:
        paths = [f"{self.uri}/meta/{f}/{name}" for f in folders]
        paths = [p for p in paths if self.fs.exists(self._path(p.removeprefix(self.uri + "/")))]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def _state(self, name: str, key: str, ddl: str) -> DataFrame:
        full, later = self._parts()
        rows = self._table([full] * bool(full), name, ddl)
        # What is between two removals is read together.
        run: list[str] = []
        for folder in later:
            if self.fs.exists(self._path(f"meta/{folder}/gone_{name}")):
                rows = rows.unionByName(self._table(run, name, ddl)) if run else rows
                rows, run = rows.join(self._table([folder], f"gone_{name}", f"{key} string"), key, "left_anti"), []
            run.append(folder)
        return rows.unionByName(self._table(run, name, ddl)) if run else rows

    @property
    def index(self) -> DataFrame:
        return self._state("chunk_index", "hash", INDEX)

    @property
    def recipe(self) -> DataFrame:
        return self._state("recipe", "path", RECIPE)

    def _containers(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.uri}/container/{f}" for f in folders]
        return self.spark.read.schema(CONTAINERS).parquet(*paths) if paths else self.spark.createDataFrame([], CONTAINERS)

    def _folders(self) -> list[str]:
        """The committed container folders; a run that failed may have left others."""
        there = set(self._names("container"))
        return sorted(folder for folder, _ in self._commits().values() if folder in there)

    @property
    def containers(self) -> DataFrame:
        return self._containers(self._folders())

    def _commit(self, based_on: int, next_id: int, tables: dict[str, DataFrame], kind: str = "delta", folder: str | None = None) -> None:
        folder = folder or self._folder(based_on)
        for name, rows in tables.items():
            rows.write.parquet(f"{self.uri}/meta/{folder}/{name}")
        self.spark.range(1).select(F.lit(next_id).alias("next_id")).write.parquet(f"{self.uri}/meta/{folder}/sequence")
        try:
            # Created only if it isn't there: one of two runs gets the version.
            out = self.fs.create(self._path(f"commits/{based_on + 1}"), False)
        except Py4JJavaError as e:
            if not self.fs.exists(self._path(f"commits/{based_on + 1}")):
                raise
            raise Conflict(f"version {based_on + 1} was committed by another run") from e
        try:
            out.write(f"{kind} {folder}".encode())
        finally:
            out.close()
        if kind == "delta" and (based_on + 1) % CHECKPOINTS == 0:
            self.checkpoint()

    @staticmethod
    def _folder(based_on: int) -> str:
        return f"{based_on + 1}-{uuid.uuid4().hex}"

    def checkpoint(self) -> None:
        """Fold all deltas into whole tables."""
        v = self.version()
        self._commit(v, self._next_id(), {"chunk_index": self.index, "recipe": self.recipe}, "full")

    def _next_id(self) -> int:
        commits = self._commits()
        return self.spark.read.parquet(f"{self.uri}/meta/{commits[max(commits)][0]}/sequence").first()["next_id"] if commits else 0

    def upload(self, files: DataFrame, least: int = 4096, avg: int = 8192, most: int = 16384, base: int = 257, byte_mode: str = "signed") -> DataFrame:
        """Add files (``path, content``) and return the report. A known or repeated path raises, and
        so does a store that another run changes meanwhile (:class:`Conflict`). Files are cut once."""
        if most > CONTAINER_BYTES:
            raise ValueError("max must not exceed a container")
        version = self.version()
        index, recipe, first_id = self.index, self.recipe, self._next_id()
        if not files.groupBy("path").count().filter("count > 1").isEmpty() or not files.join(recipe.select("path").distinct(), "path", "left_semi").isEmpty():
            raise ValueError("a path is in the store already, or twice in the upload")
        # Written with their bytes: columns are read apart later, so hashes move without them.
        cut = saved(chunk(files, least, avg, most, base, byte_mode, with_content=True), "chunks")
        new = first_occurrences(cut).join(index.select("hash"), "hash", "left_anti")
        placed = saved(next_fit(new, first_id, more=("path", "chunk_no")), "index")
        top = placed.agg(F.max("container_id")).first()[0]
        # Bytes move once, and only those of new chunks.
        bytes_ = cut.select("hash", "path", "chunk_no", "content").join(placed, ["hash", "path", "chunk_no"])
        folder = self._folder(version)
        _sealed(bytes_).write.parquet(f"{self.uri}/container/{folder}")
        self._commit(version, first_id if top is None else top + 1, {"chunk_index": placed.select("hash", "container_id", "offset", "size"), "recipe": cut.select("path", "chunk_no", "hash")}, folder=folder)
        return self.report()

    def download(self, path: str | None = None) -> DataFrame:
        """``path, content`` of one file, or of all. An unknown path raises. Only the containers that
        hold its chunks are moved, and chunks are read from them by offset and size."""
        recipe = self.recipe if path is None else self.recipe.filter(F.col("path") == path)
        if path is not None and recipe.isEmpty():
            raise ValueError(f"no file {path!r} in the store")
        index = self.index
        wanted = saved(index if path is None else index.join(recipe.select("hash").distinct(), "hash", "left_semi"), "wanted")
        return join_chunks(recipe.join(read_chunks(self.containers, wanted), "hash").select("path", "chunk_no", "content"))

    def fetch(self, path: str, target: str) -> None:
        """Write one file to ``target``, a path of any file system that Spark can write. Ranges of
        RANGE_CHUNKS chunks come to the driver one after the other, so memory stays bounded."""
        recipe = self.recipe.filter(F.col("path") == path)
        if recipe.isEmpty():
            raise ValueError(f"no file {path!r} in the store")
        wanted = saved(self.index.join(recipe.select("hash").distinct(), "hash", "left_semi"), "wanted")
        parts = recipe.join(read_chunks(self.containers, wanted), "hash")
        glue = F.expr("listagg(content, X'') WITHIN GROUP (ORDER BY chunk_no)")
        ranges = saved(parts.groupBy(F.floor((F.col("chunk_no") - 1) / RANGE_CHUNKS).alias("range")).agg(glue.alias("content")), "ranges")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            for r in ranges.orderBy("range").toLocalIterator():
                out.write(bytes(r["content"]))
        finally:
            out.close()

    def delete(self, path: str) -> DataFrame:
        """Remove a file and the index rows that nothing refers to; the report."""
        gone = self.spark.createDataFrame([(path,)], "path string")
        if self.recipe.filter(F.col("path") == path).isEmpty():
            raise ValueError(f"no file {path!r} in the store")
        return self.delete_all(gone)

    def delete_all(self, paths: DataFrame) -> DataFrame:
        """Remove the files of a column ``path`` in one commit; unknown ones don't count."""
        version, recipe, paths = self.version(), self.recipe, saved(paths.select("path").distinct(), "gone")
        mine = saved(recipe.join(paths, "path", "left_semi").select("path", "hash"), "mine")
        hashes = mine.select("hash").distinct()
        kept = recipe.join(paths, "path", "left_anti").join(hashes, "hash", "left_semi").select("hash")
        self._commit(version, self._next_id(), {"gone_recipe": mine.select("path").distinct(), "gone_chunk_index": hashes.join(kept, "hash", "left_anti")})
        return self.report()

    def vacuum(self, compact: float = COMPACT) -> None:
        """Free the bytes of dead chunks. Containers whose live share is below ``compact`` are written
        anew without their dead chunks; live containers that share a folder with dead ones move as
        they are; one commit does both. Then the folders that hold no live container of their own
        are deleted, those of failed runs too. An upload under way has a later number and is left
        alone; it fails if this commits first."""
        version, index, folders = self.version(), self.index, self._folders()
        every = self._containers(folders).select("container_id", F.octet_length("content").cast("long").alias("bytes"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder"))
        live = index.groupBy("container_id").agg(F.sum("size").alias("live"))
        state = saved(every.join(live, "container_id", "left").withColumn("good", F.coalesce(F.col("live") >= compact * F.col("bytes"), F.lit(False))), "state")
        # Folders in which something is dead or poor; a number for each upload comes to the driver.
        stale = {r["folder"] for r in state.groupBy("folder").agg(F.min("good").alias("good")).collect() if not r["good"]}
        if stale:
            poor = saved(index.join(state.filter("live is not null and not good").select("container_id").distinct(), "container_id", "left_semi"), "poor")
            first_id, folder = self._next_id(), self._folder(version)
            by_container = poor.select(F.col("container_id").cast("string").alias("path"), F.col("offset").cast("int").alias("chunk_no"), "hash", "size")
            placed = saved(next_fit(by_container, first_id), "compacted")
            top = placed.agg(F.max("container_id")).first()[0]
            held = self._containers(folders)
            anew = _sealed(read_chunks(held, poor).join(placed, "hash").select("container_id", "offset", "content"))
            moved = held.join(state.filter("good").filter(F.col("folder").isin(sorted(stale))).select("container_id").distinct(), "container_id", "left_semi").dropDuplicates(["container_id"])
            anew.unionByName(moved).write.parquet(f"{self.uri}/container/{folder}")
            self._commit(version, first_id if top is None else top + 1, {"chunk_index": placed.select("hash", "container_id", "offset", "size"), "gone_chunk_index": poor.select("hash")}, folder=folder)
        for name in self._names("container"):
            if name in stale or name not in folders and int(name.partition("-")[0]) <= version:
                self.fs.delete(self._path(f"container/{name}"), True)

    def report(self) -> DataFrame:
        return report(self.recipe, self.index)


def read_chunks(containers: DataFrame, wanted: DataFrame) -> DataFrame:
    """``hash, content`` of the chunks ``hash, container_id, offset, size``: each container is read
    once, and its chunks are cut out of it by offset and size."""
    plan = wanted.groupBy("container_id").agg(F.collect_list(F.struct("hash", "offset", "size")).alias("chunks"))

    def cut(batches):
        for batch in batches:
            hashes, parts = [], []
            for content, chunks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = content.as_py()
                for x in chunks:
                    hashes.append(x["hash"])
                    parts.append(raw[x["offset"] : x["offset"] + x["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(parts, pa.binary())], ["hash", "content"])

    # Two folders may hold a container while a vacuum moves it.
    once = containers.join(plan, "container_id").dropDuplicates(["container_id"])
    return once.select("content", "chunks").mapInArrow(cut, "hash string, content binary")


def read_index_text(lines: DataFrame) -> DataFrame:
    """A text index: ``hash,container,offset,size,refcount``; lines of other lengths, such as the
    first with the number of containers, are skipped."""
    parts = F.split("value", ",")
    ok = lines.filter(F.size(parts) == 5)
    number = lambda i: parts[i].cast("bigint")
    return ok.select(parts[0].alias("hash"), number(1).alias("container_id"), number(2).alias("offset"), number(3).alias("size"))


def index_text(recipe: DataFrame, index: DataFrame) -> DataFrame:
    """``id, value``: first the number of containers, then a line for each live chunk."""
    live = index.join(refcounts(recipe), "hash")
    lines = live.select(F.lit(1).alias("id"), F.concat_ws(",", "hash", *[F.col(c).cast("string") for c in ("container_id", "offset", "size", "refs")]).alias("value"))
    return index.agg(F.count_distinct("container_id").cast("string").alias("value")).select(F.lit(0).alias("id"), "value").unionByName(lines)


def read_recipe_text(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """``path,no,hash,no,hash,...``, or ``path,hash,hash,...`` without numbers."""
    parts = F.split("value", ",")
    step = 2 if numbered else 1
    hashes = F.filter(F.slice(parts, 2, F.size(parts)), lambda x, i: (i % step) == step - 1)
    return lines.filter(F.size(parts) > 1).select(parts[0].alias("path"), F.posexplode(hashes)).select("path", (F.col("pos") + 1).cast("int").alias("chunk_no"), F.col("col").alias("hash"))


def recipe_text(recipe: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("chunk_no", "hash")))
    lines = recipe.groupBy("path").agg(items.alias("items"))
    return lines.select(F.concat_ws(",", "path", F.array_join(F.transform("items", lambda x: F.concat_ws(",", x["chunk_no"].cast("string"), x["hash"])), ",")).alias("value"))
