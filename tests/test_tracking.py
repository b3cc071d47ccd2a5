import time
import tracemalloc

import numpy as np
import pandas as pd

from depthlane.config import Config
from depthlane.operators import tracks as T
from depthlane.sources.sinks import METRICS, companion_csv, safe_name, write_metrics
from depthlane.streaming.tracking import track_stream

BOX = (10, 10, 30, 30)


def test_confirmation_counts_hits_that_are_not_consecutive():
    state, config = T.State(), Config()
    seen = [bool(T.step(state, f, [(BOX, 400, 1000)] if f % 2 == 0 else [], config)) for f in range(5)]
    assert seen == [False, False, False, False, True]


def test_expiry_and_new_id():
    state, config = T.State(), Config(track_miss=1, track_confirm=1)
    assert T.step(state, 0, [(BOX, 400, 1000)], config)[0].track_id == 1
    assert T.step(state, 1, [], config)[0].misses == 1
    assert T.step(state, 2, [], config) == []
    assert T.step(state, 3, [(BOX, 400, 1000)], config)[0].track_id == 2


def test_gates_smoothing_and_late_frames():
    state, config = T.State(), Config(track_confirm=1)
    T.step(state, 5, [(BOX, 400, 1000)], config)
    out = T.step(state, 6, [(BOX, 400, 1100), (BOX, 400, 1400)], config)
    assert [(t.track_id, t.depth) for t in out] == [(1, 1035), (2, 1400)]
    assert T.step(state, 6, [(BOX, 400, 1100)], config) == []


def test_ids_are_unique_and_matching_is_one_to_one():
    rng, state, config = np.random.default_rng(0), T.State(), Config(track_confirm=1, max_regions=1000)
    for f in range(40):
        cands = [((x, y, x + 20, y + 20), 400, 1000) for x, y in rng.integers(0, 200, (8, 2)).tolist()]
        out = T.step(state, f, cands, config)
        assert len({t.track_id for t in out}) == len(out)
        assert sum(t.misses == 0 for t in out) == 8


def rows():
    rng = np.random.default_rng(1)
    out = []
    for camera in range(2):
        for frame in range(20):
            for k in range(3):
                if rng.random() < 0.7:
                    x = 50 * k + frame
                    out.append((camera, frame, frame * 1000 + k, x, 10, x + 30, 40, 900 + k, 1000 + 50 * k))
    return pd.DataFrame(out, columns="camera_id frame_index observation_id roi_x0 roi_y0 roi_x1 roi_y1 area depth_mm".split())


def test_stream_equals_batch_whatever_the_split(spark, tmp_path):
    from depthlane.runtime import ship

    ship(spark)
    all_rows, config = rows(), Config(track_miss=2)
    schema = "camera_id long, frame_index long, observation_id long, roi_x0 long, roi_y0 long, roi_x1 long, roi_y1 long, area long, depth_mm long"
    batch = T.track(spark.createDataFrame(all_rows, schema), config).toPandas()
    source = tmp_path / "in"
    for n, (a, b) in enumerate([(0, 7), (7, 8), (8, 20)]):
        spark.createDataFrame(all_rows[all_rows.frame_index.between(a, b - 1)], schema).coalesce(1).write.mode("append").parquet(str(source / f"part={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(*[str(source / "part=*")])
    q = track_stream(stream, config).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = ["camera_id", "frame_index", "track_id"]
    streamed = spark.table("tracked").toPandas().sort_values(key).reset_index(drop=True)
    assert len(batch) and streamed.astype(int).equals(batch.sort_values(key).reset_index(drop=True).astype(int))


def test_idle_cameras_are_forgotten(spark, tmp_path):
    from depthlane.runtime import ship

    ship(spark)
    schema = "camera_id long, frame_index long, observation_id long, roi_x0 long, roi_y0 long, roi_x1 long, roi_y1 long, area long, depth_mm long"
    spark.createDataFrame(rows(), schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = track_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Config(track_miss=2), idle_ms=1)
    q = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    held = []
    for _ in range(60):
        time.sleep(0.5)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        if 2 in held and held[-1] == 0:
            break
    q.stop()
    assert 2 in held and held[-1] == 0


def test_metrics_csv_and_names(spark, tmp_path):
    assert len(METRICS) == 32
    write_metrics(spark.createDataFrame([(1, 2)], "frame_index long, candidate_count long"), str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert back.columns == METRICS and back.first()["candidate_count"] == "2" and back.first()["frame_ms"] is None
    assert companion_csv("a/b.avi") == "a/b.csv" and safe_name("a b/c") == "a_b_c"


def test_replay_source(spark, tmp_path):
    from depthlane.runtime import ship
    from depthlane.sources.replay import ReplaySource

    ship(spark)
    for k in range(3):
        np.savez(tmp_path / f"{k}.npz", frame_id=k, filtered=np.full((4, 5), k), raw=np.full((4, 5), k), gray=np.zeros((4, 5)))
    spark.dataSource.register(ReplaySource)
    got = spark.read.format("depth_replay").load(str(tmp_path)).toPandas().sort_values("frame_id")
    assert got.frame_id.tolist() == [0, 1, 2] and got.width.tolist() == [5] * 3
    q = spark.readStream.format("depth_replay").option("framesPerBatch", 2).load(str(tmp_path)).writeStream.format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames").count() == 3


def brute_tracker(candidates, frames, config):
    """The tracker by its rules, pair by pair, on every frame from the first to the last: {frame: [(id, hits, misses, box, area, depth)]}."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    tracks, fresh, out, weight = [], 1, {}, config.track_smooth_percent / 100
    mix = lambda old, new: int(old * weight + new * (1 - weight) + 0.5)
    for frame in frames:
        own, pairs = candidates.get(frame, []), []
        for t in tracks:
            for k, (box, area, depth) in enumerate(own):
                ratio = min(t["area"], area) / max(t["area"], area)
                away = np.hypot((t["box"][0] + t["box"][2] - box[0] - box[2]) / 2, (t["box"][1] + t["box"][3] - box[1] - box[3]) / 2)
                over, deep = iou(t["box"], box), abs(t["depth"] - depth)
                if deep <= config.track_depth_gap_mm and ratio >= 0.15 and (over >= config.track_iou_percent / 100 or away <= config.track_center_gap):
                    pairs.append((4 * over + 2 * max(0, 1 - away / config.track_center_gap) + 1 - deep / config.track_depth_gap_mm + ratio, t, k))
        free, used = [t["id"] for t in tracks], set()
        for _, t, k in sorted(pairs, key=lambda p: (-p[0], p[1]["id"], p[2])):
            if t["id"] in free and k not in used:
                free.remove(t["id"]), used.add(k)
                box, area, depth = own[k]
                old, new = [((b[0] + b[2]) // 2, (b[1] + b[3]) // 2) for b in (t["box"], box)]
                dx, dy = mix(old[0], new[0]) - new[0], mix(old[1], new[1]) - new[1]
                t |= {"box": (box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy), "area": mix(t["area"], area), "depth": mix(t["depth"], depth), "misses": 0}
                t["hits"] = min(t["hits"] + 1, config.track_confirm + config.track_miss + 1)
        for t in tracks:
            t["misses"] += t["id"] in free
        for k, (box, area, depth) in enumerate(own):
            if k not in used:
                tracks.append({"id": fresh, "box": box, "area": area, "depth": depth, "hits": 1, "misses": 0})
                fresh += 1
        tracks = [t for t in tracks if t["misses"] <= config.track_miss]
        out[frame] = [(t["id"], t["hits"], t["misses"], t["box"], t["area"], t["depth"]) for t in tracks if t["hits"] >= config.track_confirm][: config.max_regions]
    return out


def test_batch_tracking_against_brute_force(spark):
    """Cameras with gaps of every length, on more than one Arrow batch, in shuffled order."""
    from depthlane.runtime import ship

    ship(spark)
    rng, config, out = np.random.default_rng(3), Config(track_miss=2), []
    for camera in range(3):
        for frame in sorted(rng.choice(60, 35, replace=False).tolist()):
            for k in range(int(rng.integers(1, 6))):
                x, y = (int(v) for v in rng.integers(0, 120, 2))
                out.append((camera, frame, frame * 100 + k, x, y, x + 40, y + 40, int(rng.integers(500, 2000)), int(rng.integers(900, 1400))))
    rows_ = pd.DataFrame(out, columns="camera_id frame_index observation_id roi_x0 roi_y0 roi_x1 roi_y1 area depth_mm".split())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = T.track(spark.createDataFrame(rows_.sample(frac=1, random_state=1)).repartition(3), config).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for camera, own in rows_.groupby("camera_id"):
        frames = {f: c for f, c in T.frames_of(own)}
        for frame, tracks in brute_tracker(frames, range(min(frames), max(frames) + 1), config).items():
            want |= {(camera, frame, i, hits, misses, *box, area, depth) for i, hits, misses, box, area, depth in tracks}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_frames_without_candidates_are_misses():
    state, config, seen = T.State(), Config(), {}
    for frame, own in [(0, 1), (1, 1), (2, 1), (20, 1)]:
        seen |= {f: [(t.track_id, t.misses) for t in tracks] for f, tracks in T.advance(state, frame, [(BOX, 400, 1000)] * own, config)}
    assert seen == {0: [], 1: [], 2: [(1, 0)], 3: [(1, 1)], 4: [(1, 2)], 5: [(1, 3)], 6: [(1, 4)], 7: [(1, 5)], 8: [], 20: []}
    assert state.tracks[0].track_id == 2


def test_without_history_candidates_come_out_as_they_are():
    state, config = T.State(), Config(history=False)
    assert [(t.box, t.area) for t in T.step(state, 0, [(BOX, 400, 1000), (BOX, 300, 900)], config)] == [(BOX, 400), (BOX, 300)]
    assert state.tracks == []


def test_match_pairs_without_an_overlap_gate(spark):
    one = spark.createDataFrame([(1, 1, 0, 0, 9, 9, 100, 1000)], "frame_index long, track_id long, roi_x0 long, roi_y0 long, roi_x1 long, roi_y1 long, area long, depth_mm long")
    far = spark.createDataFrame([(2, 7, 5000, 0, 5009, 9, 100, 1299), (2, 8, 0, 0, 9, 9, 100, 1301)], one.schema)
    assert [r["candidate"] for r in T.match_pairs(one, far, Config(track_iou_percent=0)).collect()] == [7]
    assert T.match_pairs(one, far, Config()).count() == 0


MATCHED = "frame_index long, track_id long, roi_x0 long, roi_y0 long, roi_x1 long, roi_y1 long, area long, depth_mm long"


def shuffled(df):
    """Rows that a collected plan without adaptive execution has put through its exchanges."""
    def found(plan):
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        return own + sum(found(plan.children().apply(k)) for k in range(plan.children().size()))

    return found(df._jdf.queryExecution().executedPlan())


def test_match_pairs_shuffles_rows_and_not_cells(spark):
    """Large boxes touch some 300 image cells each; a row goes to its depth block, a track to those beside it too."""
    n, key = 40, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows_ = [spark.createDataFrame([(f, k, k, k, 4000 + k, 4000 + k, 1000 + k, 1000) for k in range(n)], MATCHED) for f in (1, 2)]
        pairs = T.match_pairs(*rows_, Config())
        assert len(pairs.collect()) == n * n
        assert 2 * n <= shuffled(pairs) <= 4 * n
    finally:
        spark.conf.set(key, was)


def test_match_pairs_against_brute_force(spark):
    """Copies beyond a list, unnamed tracks, rows without a depth, and boxes of every size on either side of the origin."""
    rng, out = np.random.default_rng(11), []
    for frame in (0, 1, 2, 4):
        for k in range(150):
            side = rng.choice([5, 60, 700], 2)
            x, y = rng.integers(-400, 400, 2)
            out.append((frame, k, int(x), int(y), int(x + side[0]), int(y + side[1]), int(rng.integers(0, 3000)), int(rng.integers(900, 1900))))
        out += [(frame, None, 0, 0, 50, 50, 700, 1000), (frame, 900, 0, 0, 50, 50, 700, None), (frame, 901, 0, 0, 50, 50, 1, None)]
        out += [(frame, 1000 + k, 3, 3, 50, 50, 700, 1100) for k in range(T.COPIES + 9)]
    table = spark.createDataFrame(out, MATCHED)
    order = lambda r: tuple((v is None, v or 0) for v in r[:3])
    for config in (Config(), Config(track_iou_percent=0), Config(track_iou_percent=1), Config(track_iou_percent=60, track_center_gap=5), Config(track_depth_gap_mm=1)):
        want = []
        for frame in (0, 1):
            t, c = ([r for r in out if r[0] == f and r[7] is not None] for f in (frame, frame + 1))
            values = lambda rows: np.array([(*r[2:6], r[6], r[7], (r[2] + r[4]) / 2, (r[3] + r[5]) / 2) for r in rows], float)
            found = T.scores(values(t), values(c), config)
            want += [(frame + 1, t[i][1], c[j][1], found[i, j]) for i, j in zip(*np.nonzero(found >= 0))]
        got = sorted(((r.frame_index, r.track, r.candidate, r.score) for r in T.match_pairs(table, table, config, digits=9).collect()), key=order)
        want = sorted(want, key=order)
        assert len(want) > 100 and [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-8)


def dense(tracks, candidates, config):
    """The matching by a sorted list of all pairs."""
    rows = lambda v: np.array([(*b, area, depth, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b, area, depth in v], float)
    found = T.scores(rows([(t.box, t.area, t.depth) for t in tracks]), rows(candidates), config)
    t_at, c_at = np.nonzero(found >= 0)
    out, own, other = [], set(), set()
    for i in np.lexsort((c_at, t_at, -found[t_at, c_at])):
        if t_at[i] not in own and c_at[i] not in other:
            own.add(t_at[i]), other.add(c_at[i]), out.append((int(t_at[i]), int(c_at[i])))
    return out


def test_matching_against_all_pairs():
    """Copies, ties, and more of either side than are held of a row's best."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        wide, n, m = int(rng.choice([2, 30, 400])), int(rng.integers(1, 150)), int(rng.integers(1, 150))
        one = lambda: ((x := int(rng.integers(0, wide)), 0, x + 20, 20), int(rng.integers(300, 302)), 1000)  # noqa: E731, B023
        tracks, candidates = [T.Track(k, *one()) for k in range(n)], [one() for _ in range(m)]
        config = Config(track_center_gap=int(rng.choice([5, 200])))
        assert T.assigned(tracks, candidates, config) == dense(tracks, candidates, config)


def test_memory_of_the_matching_does_not_grow_with_pairs():
    rng = np.random.default_rng(5)
    one = lambda: ((x := int(rng.integers(0, 4000)), y := int(rng.integers(0, 400)), x + 20, y + 20), int(rng.integers(300, 900)), int(rng.integers(900, 1400)))
    tracks, candidates = [T.Track(k, *one()) for k in range(2500)], [one() for _ in range(2500)]
    tracemalloc.start()
    T.assigned(tracks, candidates, Config(track_center_gap=200, track_depth_gap_mm=600))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2500 * 2500 * 8  # one matrix of scores
