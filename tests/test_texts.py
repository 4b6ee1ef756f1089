"""Text vectors, room types and crops of one size on odd small tables."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from atrium.functions import texts
from atrium.operators import masks
from atrium.plans import room_types


def _vector(text, dims=16, n=3):
    padded = f" {(text or '').lower()} "
    v = np.zeros(dims)
    for g in [padded[i : i + n] for i in range(len(padded) - n + 1)] or [padded]:
        h = int(hashlib.md5(g.encode()).hexdigest()[:8], 16)
        v[h % dims] += -1 if h // dims % 2 else 1
    return v / np.linalg.norm(v) if v.any() else v


def test_text_vectors_equal_plain_python(spark):
    names = ["Chair", "a", "", None, "straße 椅子", "stairs " * 300]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "id long, t string").select("id", texts.text_vector(F.col("t"), 16).alias("v")).collect()
    for r in got:
        assert np.allclose(r.v, _vector(names[r.id]), atol=1e-12)
    templates = ["a %", "no name", "% and %"]
    df = spark.createDataFrame([("chair",), ("chair",), (None,)], "name string")
    mean = {r["name"]: r.vector for r in texts.template_vectors(df, spark.createDataFrame([(t,) for t in templates], "template string"), dims=16).collect()}
    assert len(mean) == 2
    for name, v in mean.items():
        total = sum(_vector(t.replace("%", name or "")) for t in templates)
        assert np.allclose(v, total / np.linalg.norm(total), atol=1e-12)


def test_room_types_by_log_odds(spark):
    known = [("kitchen", "oven"), ("kitchen", "oven"), ("kitchen", "chair"), ("bath", "tub"), ("bath", "chair"), (None, "oven"), ("bath", None)]
    weights = room_types.type_weights(spark.createDataFrame(known, "room_type string, name string"))
    got = {(r.room_type, r["name"]): r.weight for r in weights.collect()}
    assert len(got) == 6
    assert math.isclose(got["kitchen", "oven"], math.log(((2 + 1) / (3 + 3)) / ((0 + 1) / (2 + 3))))
    assert math.isclose(got["bath", "oven"], math.log(((0 + 1) / (2 + 3)) / ((2 + 1) / (3 + 3))))
    objects = spark.createDataFrame([(1, "oven"), (1, "chair"), (2, "tub"), (2, "chair"), (2, "lamp"), (3, "lamp"), (4, None)], "room_id long, name string")
    types = {r.room_id: (r.room_type, r.score) for r in room_types.room_types(objects, weights).collect()}
    assert {k: v[0] for k, v in types.items()} == {1: "kitchen", 2: "bath"}
    assert math.isclose(types[1][1], got["kitchen", "oven"] + got["kitchen", "chair"], abs_tol=2e-9)
    assert {r.room_type for r in room_types.room_types(objects, weights, among=["bath"]).collect()} == {"bath"}
    assert room_types.room_types(objects, room_types.type_weights(spark.createDataFrame([], "room_type string, name string"))).isEmpty()


def test_crops_of_one_size_weigh_pixels_by_area(spark):
    rng = np.random.default_rng(4)
    pictures = {i: rng.uniform(0, 9, s) for i, s in enumerate([(1, 1), (3, 5), (4, 4), (9, 2)])}
    rows = [(0, i, r, c, float(v)) for i, p in pictures.items() for (r, c), v in np.ndenumerate(p) if (i, r, c) != (2, 1, 1)]
    pictures[2][1, 1] = 0  # a pixel off the mask is black
    boxes = spark.createDataFrame([(0, i, p.shape[1], p.shape[0]) for i, p in pictures.items()], "frame_id long, mask_id long, w long, h long")
    got = masks.resize_area(spark.createDataFrame(rows, "frame_id long, mask_id long, row long, col long, v double"), boxes, 4, ("v",)).collect()
    made = {i: np.zeros((4, 4)) for i in pictures}
    for r in got:
        made[r.mask_id][r.row, r.col] = r.v
    for i, p in pictures.items():
        # every pixel as 4 by 4 equal ones, then means of blocks of the picture's size
        h, w = p.shape
        fine = np.kron(p, np.ones((4, 4)))
        assert np.allclose(made[i], fine.reshape(4, h, 4, w).mean((1, 3)))
