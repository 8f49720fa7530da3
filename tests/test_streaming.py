import json

from gristmill.streaming import score_stream as S


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("pair", "role_match", "experience_short", "blocker", "at"), r, strict=True))) for r in rows))


def test_files_are_scored_once(spark, tmp_path):
    arrive = tmp_path / "in"
    run = lambda: S.write_scores(S.score_stream(S.read_signals(spark, str(arrive))), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    _put(arrive, "a.json", [("p1", 0.9875, 0.13, 0.05, "2026-01-01T10:00:00"), ("p2", None, 0.1, 0.0, "2026-01-01T10:01:00")])
    run()
    _put(arrive, "b.json", [("p3", 1.0, 0.0, 0.0, "2026-01-01T11:00:00")])
    run()
    run()
    assert sorted((r.pair, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("p1", 87), ("p2", None), ("p3", 99)]


def test_windows_leave_late_rows_out(spark, tmp_path):
    arrive = tmp_path / "in"
    run = lambda: S.write_scores(S.score_windows(S.read_signals(spark, str(arrive), 1)), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    _put(arrive, "a.json", [("p1", 1.0, 0.0, 0.0, "2026-01-01T10:00:00"), ("p1", 1.0, 0.0, 0.0, "2026-01-01T10:00:00"), ("p2", 0.0, 0.0, 0.0, "2026-01-01T10:30:00")])
    run()
    _put(arrive, "b.json", [("p3", 1.0, 0.0, 0.0, "2026-01-01T13:00:00")])
    run()
    _put(arrive, "c.json", [("late", 1.0, 0.0, 0.0, "2026-01-01T10:10:00"), ("p4", 1.0, 0.0, 0.0, "2026-01-01T16:00:00")])
    run()
    _put(arrive, "d.json", [("p5", 1.0, 0.0, 0.0, "2026-01-01T20:00:00")])
    run()
    got = {r.begins.hour: (r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[10] == (2, 90.0) and got[13] == (1, 99.0)
