import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.media import _tables, describe, find_copies, matches, read_image, render, resize, write_image


def picture(seed, side=120):
    r = np.random.default_rng(seed)
    return resize(r.uniform(20, 235, (10, 10)), side, side)


def test_copies_and_edits_are_found(spark):
    r = np.random.default_rng(0)
    base = picture(1)
    rows = [
        (0, base), (1, base), (2, base[12:, 15:]), (3, base * 0.8 + 20), (4, base + r.normal(0, 3, base.shape)),
        (5, np.rot90(base)), (6, resize(base, 84, 84)), *((50 + i, picture(100 + i)) for i in range(40)),
    ]
    rows = [(i, bytearray(write_image(p)), "x") for i, p in rows] + [(97, None, "x"), (98, bytearray(b"P5 broken"), "x"), (None, bytearray(write_image(base)), "x"), (1, bytearray(write_image(base)), "x")]
    images = spark.createDataFrame(rows, "image_id long, image binary, rep string")
    got = sorted(find_copies(images, F.col("image_id") == 0).collect(), key=lambda x: (x.image_id is None, x.image_id or 0))
    by = {x.image_id: x for x in got}
    assert len(got) == len(rows) and (by[1].copy_id, by[1].n_copies) == (0, 3) and by[None].copy_id is None
    assert [i for i in by if i is not None and by[i].matches] == [2, 3, 4, 5, 6]
    assert all(m.copy_id == 0 and m.votes >= 5 for i in range(2, 7) for m in by[i].matches)
    assert find_copies(images.limit(0), F.col("image_id") == 0).collect() == []


def test_one_id_with_several_images(spark):
    """No image is lost, and each has its own matches."""
    a, b = picture(1), picture(2)
    rows = [(0, a), (7, b), (7, a[10:, 8:]), (8, b), (0, picture(3))]
    images = spark.createDataFrame([(i, bytearray(write_image(p))) for i, p in rows], "image_id long, image binary")
    got = sorted((r.image_id, r.copy_id, r.n_copies, [m.copy_id for m in r.matches]) for r in find_copies(images, F.col("image_id") == 0).collect())
    assert got == [(0, 0, 1, []), (0, 0, 1, []), (7, 7, 1, [0]), (7, 7, 2, []), (8, 7, 2, [])]


def test_images_round_trip():
    p = np.rint(picture(2))
    assert (read_image(write_image(p)) == p).all()
    assert read_image(b"P6\n# note\n2 1\n255\n" + bytes([1, 2, 3, 3, 3, 3])).tolist() == [[2, 3]]
    assert all(read_image(x) is None for x in (None, b"", b"PNG", b"P5", b"P5 5 5 255 x", b"P5\n0 0\n255\n"))
    assert len(describe(np.full((60, 60), 9.0))[0]) == 0


def test_vectors_are_drawn(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.5, 0.1, 0.2]), (2, None), (3, []), (4, [None, float("nan")])], "vec_id long, embedding array<float>")
    got = {r.image_id: r.image for r in render(rows).collect()}
    assert read_image(bytes(got[1])).shape == (96, 96) and got[2] is None and got[3] is None and got[4] is not None


def test_tables_find_what_brute_force_finds():
    """Descriptors at a given distance meet as often as TABLES says, and always up to 19; matches are brute force's."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2, (2000, 256)).astype(np.uint8)
    words = lambda bits: np.packbits(bits, axis=1).view(np.uint64)
    for distance, least in ((10, 1), (19, 1), (28, 0.93), (36, 0.72)):
        other = base.copy()
        for row in other:
            row[r.permutation(256)[:distance]] ^= 1
        q, p = matches(_tables(words(base)), words(base), words(other))
        near = (base[q] != other[p]).sum(axis=1)
        assert (near <= 36).all() and len(set(zip(q, p))) == len(q)
        assert (q == p).sum() >= least * len(base)


def test_small_crops_of_large_pictures(spark):
    r = np.random.default_rng(7)
    base = resize(r.uniform(20, 235, (60, 60)), 480, 480)
    rows = [(0, base), (1, base[100:250, 180:330]), (2, base[300:420, 20:140]), *((10 + i, resize(r.uniform(20, 235, (60, 60)), 480, 480)) for i in range(4))]
    images = spark.createDataFrame([(i, bytearray(write_image(p))) for i, p in rows], "image_id long, image binary")
    got = {x.image_id: [m.copy_id for m in x.matches] for x in find_copies(images, F.col("image_id") == 0).collect()}
    assert got[1] == got[2] == [0] and not any(got[10 + i] for i in range(4))


def test_near_vectors_give_near_pictures(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=64)
    near = [base, base + r.normal(0, 0.1, 64), base + r.normal(0, 0.1, 64)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*near, *r.normal(size=(30, 64))])]
    got = {x.image_id: [m.copy_id for m in x.matches] for x in find_copies(render(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("image_id") == 0).collect()}
    assert got == {i: [0] if i in (1, 2) else [] for i in range(33)}
