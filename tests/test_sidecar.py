"""Arrays and results as files, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.sources import popfile, sidecar


@pytest.fixture
def arrays(spark, tmp_path):
    sidecar.register(spark)
    rng = np.random.default_rng(3)
    made = {"losses": rng.normal(size=1000), "flags": rng.integers(0, 5, 70).astype("<i4"), "grid": rng.normal(size=(40, 2, 3)).astype("<f4"), "none": np.zeros(0), "one": np.array(2.5), "wide": np.arange(6, dtype="i8")}
    for name in ("losses", "grid", "none", "one"):
        np.save(tmp_path / f"{name}.npy", made[name])
    np.savez(tmp_path / "plain.npz", flags=made["flags"], losses=made["losses"])
    np.savez_compressed(tmp_path / "packed.npz", grid=made["grid"], wide=made["wide"])
    return tmp_path, made


def read(spark, path, **options):
    return spark.read.format("sidecar").options(**options).load(f"file://{path}")


def test_arrays(spark, arrays):
    path, made = arrays
    for per in (7, 1_000_000):
        rows = read(spark, path, entries_per_partition=per).collect()
        got = {}
        for r in rows:
            got.setdefault((r.file, r.array), {})[r.place] = r["values"]
        want = {("losses.npy", "losses"), ("grid.npy", "grid"), ("one.npy", "one"), ("plain.npz", "flags"), ("plain.npz", "losses"), ("packed.npz", "grid"), ("packed.npz", "wide")}
        assert set(got) == want  # an empty array has no rows
        for (_, name), entries in got.items():
            flat = made[name].reshape(len(made[name]) if made[name].ndim else 1, -1)
            assert np.array_equal([entries[i] for i in range(len(flat))], flat.astype(float))
        assert len(rows) == sum(len(e) for e in got.values())


def test_filters_choose_what_is_planned(spark, arrays):
    path, made = arrays
    (path / "broken.npy").write_bytes(b"no array")
    with pytest.raises(Exception):
        read(spark, path).count()
    assert read(spark, path).where("file = 'losses.npy'").count() == 1000
    one = read(spark, path).where("file = 'plain.npz' and array = 'flags' and place >= 60")
    assert [r.place for r in one.orderBy("place").collect()] == list(range(60, 70))
    assert read(spark, path).where("file = 'losses.npy' and file = 'grid.npy'").count() == 0


def test_small_files_share_tasks():
    runs = [sidecar.Piece(f"{i}", "", "", "", "<f8", 0, 1, 0, 3) for i in range(250)] + [sidecar.Piece("x", "", "", "", "<f8", 0, 1, 0, 1000)]
    made = sidecar.bundled(runs, 1000)
    assert [len(b.members) for b in made] == [100, 100, 50, 1] and [m for b in made for m in b.members] == runs
    assert sidecar.bundled([], 5)[0].members == []


def test_raw_arrays_and_refusals(spark, tmp_path):
    sidecar.register(spark)
    np.arange(10, dtype="<f4").tofile(tmp_path / "a.bin")
    got = read(spark, tmp_path, kind="<f4", entries_per_partition=3).agg(F.sum(F.col("values")[0] * (1 + F.col("place")))).first()[0]
    assert got == sum(i * (1 + i) for i in range(10))
    assert read(spark, tmp_path / "a.bin", kind="<f4").count() == 10
    assert read(spark, tmp_path / "nothing").count() == 0
    with pytest.raises(Exception, match="needs the option kind"):
        read(spark, tmp_path).count()
    with pytest.raises(Exception, match="not a whole number"):
        read(spark, tmp_path, kind="V3").count()
    for name, array, why in (("o", np.array([{}], dtype=object), "numbers only"), ("f", np.asfortranarray(np.ones((2, 3))), "stored by columns"), ("i", np.array([1 << 60]), "beyond 2")):
        folder = tmp_path / name
        folder.mkdir()
        np.save(folder / f"{name}.npy", array, allow_pickle=True)
        with pytest.raises(Exception, match=why):
            read(spark, folder).collect()
    short = tmp_path / "short"
    short.mkdir()
    np.save(short / "s.npy", np.ones(9))
    (short / "s.npy").write_bytes((short / "s.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="size and header differ"):
        read(spark, short).count()


def population(spark, path, parts):
    """Trees c0 * ... of K = place % 3 constants, one population file a part."""
    popfile.register(spark)
    leaf, times = (lambda i: (1, 0.0, i)), (3, 3.0, -1)
    rows = []
    for part, m in parts.items():
        for place in range(m):
            k = place % 3
            nodes = [times] * max(k - 1, 0) + [leaf(i) for i in range(k)] if k else [(0, 0.0, -1)]
            rows.append((part, place, nodes, [float(part + place + i) for i in range(k)], [1.0, 2.0], 1, [0.0, 1.0]))
    df = spark.createDataFrame(rows, popfile.SCHEMA)
    df.repartition("part").sortWithinPartitions("part", "place").write.format("population").mode("append").save(f"file://{path}")
    return rows


def test_results_round_trip(spark, tmp_path):
    sidecar.register(spark)
    rows = population(spark, tmp_path / "pop", {1: 25, 2: 4, 3: 1, 4: 6})
    results = [(r[0], r[1], r[1] % 5, [v + 0.5 for v in r[3]], 4.0, float("inf") if r[1] == 2 else 0.25) for r in rows if r[0] != 4]
    results[0] = (*results[0][:2], None, results[0][3], None, None)
    df = spark.createDataFrame(results, sidecar.RESULTS)
    df.repartition("part").sortWithinPartitions("part", "place").write.format("fitted").mode("append").save(f"file://{tmp_path}/out")
    for per in (4, 50_000):
        back = spark.read.format("fitted").options(populations=f"file://{tmp_path}/pop", trees_per_partition=per).load(f"file://{tmp_path}/out").collect()
        got = {(r.part, r.place): r for r in back}
        assert len(got) == len(back) == len(results)  # part 4 has no results yet
        for part, place, status, c, first, last in results:
            r = got[part, place]
            assert (r.status, r.c_final) == (2 if status is None else status, c)
            assert np.array_equal([r.loss_init, r.loss_final], [np.nan if v is None else v for v in (first, last)], equal_nan=True)
    blob = np.fromfile(tmp_path / "out" / "part-1" / "c_final.bin", "<f4")
    assert blob.tolist() == [v for r in results if r[0] == 1 for v in r[3]]
    raw = read(spark, tmp_path / "out", kind="<f4").where("array = 'loss_final'").agg(F.count("*").alias("n")).first().n
    assert raw == len(results)
    assert read(spark, tmp_path / "out", kind="<i4").where("file = 'part-2/status.bin'").count() == 4
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_temporary")]


def test_results_refused(spark, tmp_path):
    sidecar.register(spark)
    population(spark, tmp_path / "pop", {1: 3})

    def put(rows, mode="append"):
        spark.createDataFrame(rows, sidecar.RESULTS).coalesce(1).write.format("fitted").mode(mode).save(f"file://{tmp_path}/out")

    for places in ((1, 2), (0, 0), (0, 2)):
        with pytest.raises(Exception, match="was due"):
            put([(1, i, 0, [], 1.0, 1.0) for i in places])
    assert not (tmp_path / "out" / "part-1").exists()
    with pytest.raises(Exception, match="only added to"):
        put([(1, 0, 0, [], 1.0, 1.0)], "overwrite")
    put([(1, i, 0, [], 1.0, 1.0) for i in range(3)])
    with pytest.raises(Exception, match="came twice"):
        put([(1, i, 0, [], 1.0, 1.0) for i in range(3)])
    with pytest.raises(Exception, match="not as long as its population"):
        spark.read.format("fitted").options(populations=f"file://{tmp_path}/pop").load(f"file://{tmp_path}/out").collect()
