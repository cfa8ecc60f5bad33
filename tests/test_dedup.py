import base64
import hashlib
import random

import pytest

from loomgraph import verify
from loomgraph.operators import chunking as ch
from loomgraph.operators import dedup_store as ds
from loomgraph.streaming.ingest import ingest

F1 = b"1 2 10\n1 3 5\n1 5 2"


def slow_chunks(data, least, avg, most, base):
    """Chunk ends by a direct evaluation of every window."""
    signed = [b - 256 if b > 127 else b for b in data]
    ends, c = [], 0
    while c < len(data):
        if len(data) - c < least:
            ends.append(len(data))
            break
        e = c + least
        while True:
            p = sum(signed[e - least + j] * pow(base, least - 1 - j, avg) for j in range(least)) % avg
            if p == 0 or e == c + most or e == len(data):
                break
            e += 1
        ends.append(e)
        c = e
    return ends


@pytest.mark.parametrize("sizes", [(4, 8, 16), (8, 8, 8), (4, 64, 32), (1, 2, 4)])
@pytest.mark.parametrize("base", [257, 6, 3])
def test_chunks_against_direct_windows(sizes, base):
    rng = random.Random(3)
    for n in (0, 1, 5, 8, 16, 200):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert ch.cuts(n, ch.anchors(data, sizes[0], sizes[1], base, block=37), sizes[0], sizes[2]) == slow_chunks(data, *sizes, base)


def test_fixture_offsets():
    ends = lambda a, b, c: ch.cuts(len(F1), ch.anchors(F1, a, b), a, c)
    assert ends(4096, 8192, 16384) == [18] and ends(4, 8, 16) == [12, 16, 18] and ends(8, 8, 8) == [8, 16, 18]
    with pytest.raises(ValueError):
        ch.check_sizes(3, 8, 16)


def test_store(spark, tmp_path):
    rng = random.Random(1)
    big = bytes(rng.randrange(256) for _ in range(40_000))
    files = {"a": F1, "b": big, "c": big, "d": b"x" + big, "zero": bytes(5000), "empty": b""}
    frame = lambda names: spark.createDataFrame([(n, bytearray(files[n])) for n in names], "path string, content binary")
    store = ds.DedupStore(spark, str(tmp_path / "store"))
    assert store.report().first()["files"] == 0 and store.report().first()["ratio"] is None
    first = store.upload(frame(["a"])).first()
    assert (first["files"], first["logical_chunks"], first["unique_bytes"], first["containers"], first["ratio"]) == (1, 1, 18, 1, 1.0)
    assert store.index.first()["hash"] == base64.b64encode(hashlib.sha256(F1).digest()).decode()
    store.upload(frame(["b", "c", "d", "zero", "empty"]), 64, 256, 1024)
    r = store.report().first()
    assert r["files"] == 5 and r["logical_bytes"] == 18 + 3 * 40_000 + 1 + 5000 and r["unique_bytes"] < 50_000
    for name in ("a", "b", "c", "d", "zero"):
        assert bytes(store.download(name).first()["content"]) == files[name]
    with pytest.raises(ValueError):
        store.upload(frame(["b"]))
    before = store.report().first()["unique_chunks"]
    assert store.delete("c").first()["unique_chunks"] == before
    store.delete("b")
    assert bytes(store.download("d").first()["content"]) == files["d"]
    store.delete("d")
    store.delete("zero")
    with pytest.raises(ValueError):
        store.download("d")
    assert store.report().first()["containers"] == 1
    store.vacuum()
    assert bytes(store.download("a").first()["content"]) == F1
    assert store.containers.count() == 1


def test_two_uploads_at_once(spark, tmp_path):
    """Both start from one version: the second one to commit fails and changes nothing."""
    frame = lambda n: spark.createDataFrame([(n, bytearray(F1 + n.encode()))], "path string, content binary")
    one, two = (ds.DedupStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.upload(frame("a"))
    commit, report = two._commit, one.upload
    two._commit = lambda *args, **more: (report(frame("b")), commit(*args, **more))
    with pytest.raises(ds.Conflict):
        two.upload(frame("c"))
    del two._commit
    assert sorted(r["path"] for r in two.recipe.collect()) == ["a", "b"]
    two.upload(frame("c"))
    for n in "abc":
        assert bytes(one.download(n).first()["content"]) == F1 + n.encode()


def test_a_commit_that_died(spark, tmp_path):
    """An empty or torn marker changes nothing for readers, holds up commits, and can be removed."""
    frame = lambda n: spark.createDataFrame([(n, bytearray(F1))], "path string, content binary")
    store = ds.DedupStore(spark, str(tmp_path / "store"))
    store.upload(frame("a"))
    v = store.version()
    for torn in ("", "delta 2-abc"):
        (tmp_path / "store" / "commits" / str(v + 1)).write_text(torn)
        assert store.version() == v and bytes(store.download("a").first()["content"]) == F1
        with pytest.raises(ds.Conflict):
            store.delete("a")
        assert store.repair() == [v + 1] and store.repair() == []
    store.upload(frame("b"))
    assert store.report().first()["files"] == 2


def test_batches_of_many_and_of_large_files(spark, monkeypatch):
    """Rows come in batches of their own size, whatever the files', and are the same rows."""
    rng = random.Random(3)
    raw = {f"f{i}": rng.randbytes(rng.choice([0, 1, 300, 20_000])) for i in range(60)}
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in raw.items()] + [("none", None)], "path string, content binary")
    sizes = []
    plain = ch._batch
    monkeypatch.setattr(ch, "BATCH_BYTES", 5000)
    monkeypatch.setattr(ch, "_batch", lambda *args: sizes.append(len(args[0])) or plain(*args))
    rows = [(n, 1, 0, 5, "h", b[:3000]) for n, b in raw.items()]
    kinds = {"path": ch.pa.string(), "chunk_no": ch.pa.int32(), "start_offset": ch.pa.int64(), "size": ch.pa.int64(), "hash": ch.pa.string(), "content": ch.pa.binary()}
    got = [tuple(r.values()) for b in ch._gathered(iter(rows), kinds) for r in b.to_pylist()]
    assert got == rows and 1 < len(sizes) < 60 and list(ch._gathered(iter([]), kinds)) == []
    chunks = ch.chunk(files, 64, 128, 256, with_content=True).orderBy("path", "chunk_no").collect()
    for n, b in raw.items():
        mine = [r for r in chunks if r["path"] == n]
        assert b"".join(bytes(r["content"]) for r in mine) == b and [r["chunk_no"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(r["size"] == len(r["content"]) for r in mine) and [r["start_offset"] for r in mine] == [sum(x["size"] for x in mine[:i]) for i in range(len(mine))]


def test_checkpoints_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ds, "CHECKPOINTS", 3)
    rng = random.Random(9)
    files = {f"f{i}": bytes(rng.randrange(256) for _ in range(3000)) for i in range(4)}
    store = ds.DedupStore(spark, str(tmp_path / "store"))
    for n, raw in files.items():
        store.upload(spark.createDataFrame([(n, bytearray(raw)), (f"{n}-too", bytearray(raw[:1000]))], "path string, content binary"), 64, 128, 256)
    assert any(kind == "full" for _, kind in store._commits().values())
    for n in files:
        store.delete(n)  # the first third of each file stays, as its copy refers to it
    held = store.containers.agg({"content": "count"}).first()[0]
    before = sum(len(r["content"]) for r in store.containers.collect())
    store.vacuum()
    after = sum(len(r["content"]) for r in store.containers.collect())
    live = store.index.agg({"size": "sum"}).first()[0]
    assert held > 0 and after < before and after <= live / ds.COMPACT
    for n, raw in files.items():
        assert bytes(store.download(f"{n}-too").first()["content"]) == raw[:1000]
    assert store.report().first()["logical_bytes"] == 4000


def test_next_fit_opens_containers(spark):
    chunks = spark.createDataFrame([("f", i, 400, f"h{i}") for i in range(1, 6)] + [("g", 1, 10, "k")], "path string, chunk_no int, size long, hash string")
    got = {r["hash"]: (r["container_id"], r["offset"]) for r in ds.next_fit(chunks, 7, capacity=1000).collect()}
    assert got == {"h1": (7, 0), "h2": (7, 400), "h3": (8, 0), "h4": (8, 400), "h5": (9, 0), "k": (10, 0)}


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.bin").write_bytes(F1)
    store = ds.DedupStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert store.report().first()["files"] == 1


def test_legacy_text(spark):
    recipe = spark.createDataFrame([("p", 1, "h1"), ("p", 2, "h2"), ("q", 1, "h1")], ds.RECIPE)
    assert verify.differences(recipe, ds.read_recipe_text(ds.recipe_text(recipe))).isEmpty()
    plain = spark.createDataFrame([("p,h1,h2",)], "value string")
    assert [tuple(r) for r in ds.read_recipe_text(plain, numbered=False).collect()] == [("p", 1, "h1"), ("p", 2, "h2")]
    index = spark.createDataFrame([("3",), ("h1,0,0,5,2",)], "value string")
    assert [tuple(r) for r in ds.read_index_text(index).collect()] == [("h1", 0, 0, 5)]
    rows = spark.createDataFrame([("h1", 0, 0, 5), ("h2", 1, 0, 7)], ds.INDEX)
    assert [r["value"] for r in ds.index_text(recipe, rows).orderBy("id", "value").collect()] == ["2", "h1,0,0,5,2", "h2,1,0,7,1"]
    ratio = spark.createDataFrame([(1, 2, 1, 30, 18, 1, 30 / 18)], "files long, logical_chunks long, unique_chunks long, logical_bytes long, unique_bytes long, containers long, ratio double")
    assert ds.report_lines(ratio)[-1] == "ratio: 1.67"
