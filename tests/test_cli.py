import json
import subprocess
from pathlib import Path

import pytest

from chronoloom import cli
from chronoloom.operators.folds import GateConfig
from chronoloom.plans import recordings, worklog
from chronoloom.sources import media

S = 1_000_000


def length():
    return lambda texts: [[float(len(t)), float(t.count("x")) + 1] for t in texts]


def decoder(command, timeout):
    """Stands for the programs: two frames a second apart, a scene at the second, sound of three seconds; bad.mp4 breaks."""
    if any("bad.mp4" in x for x in command):
        raise media.ProgramFailed(command[0], 1, "broken")
    done = lambda out=b"", err=b"": subprocess.CompletedProcess(command, 0, out, err)
    if command[0] == "ffprobe":
        return done(b"audio\n" if "stream=codec_type" in command else b"3.0\n")
    if "showinfo" in " ".join(command):
        return done(err=b"pts_time:2.0\n")
    for i in (1, 2):
        Path(command[-1] % i).write_bytes(b"png")
    return done()


def reader():
    return lambda path: ["plan.xlsx - Excel"] if path.endswith("1.png") else ["Page 2 of 9"]


def teller():
    return lambda path, prompt: json.dumps({"action": f"{Path(path).name}", "app_guess": None})


def hearer():
    return lambda path, start, length: [{"start_us": 500_000, "end_us": 900_000, "text": "hello all"}, {"start_us": 2_500_000, "end_us": 2_600_000, "text": "!"}]


def test_recordings_to_worklogs(spark, tmp_path):
    videos = spark.createDataFrame([("a", "/in/a.mp4"), ("bad", "/in/bad.mp4")], "video string, path string")
    place = tmp_path / "frames"
    ports = recordings.Ports(reader, teller, hearer)
    for mode in recordings.PRESETS:
        run = recordings.worklogs(videos, str(place), ports, recordings.preset(mode, save_frames=True), decoder, str(tmp_path / "kept"))
        rows, lost = run.entries.orderBy("ord").collect(), run.unseen
        assert [(r.video, r.t_us // S, r.action, r.app, r.resource, r.location, r.speech) for r in rows] == [
            ("a", 0, "frame_000001.png", "Excel", "plan.xlsx", None, ["hello all"]), ("a", 2, "frame_000002.png", None, None, "Page 2 of 9", []),
        ][: 2 if mode == "screencast" else 1]
        assert [r.video for r in lost.collect()] == ["bad"] and rows[0].frame == "frames/frame_000000_0.png"
        assert (tmp_path / "kept/a" / rows[0].frame).read_bytes() == b"png" and run.counts["images"] == len(rows) and run.counts["images_failed"] == 0
        assert run.warnings() == ["no frame in /in/bad.mp4"]
    run = recordings.worklogs(videos.limit(1), str(place), ports, recordings.preset("screencast"), decoder)
    assert all(r.frame is None for r in run.entries.collect()) and run.counts["frames"] == 2 and not run.counts["frames_unread"]
    entries = worklog.with_images(run.entries, spark.createDataFrame([("a", 0, 0, "x"), ("a", 1, 2 * S, "y")], "video string, idx long, t_us long, path string"))
    frames = spark.createDataFrame([("a", 0, 0, str(next(place.glob("*/frame_000001.png"))), True), ("a", 1, 2 * S, "/gone.png", True)], "video string, idx long, t_us long, path string, is_keyframe boolean")
    copied = worklog.copied(entries, frames, str(tmp_path / "out")).orderBy("ord").collect()
    assert (tmp_path / "out/a" / copied[0].frame).read_bytes() == b"png" and copied[0].warning is None
    assert copied[1].frame is None and copied[1].warning.startswith("/gone.png")


def test_what_fails_is_told(spark, tmp_path):
    videos = spark.createDataFrame([("a", "/in/a.mp4"), ("c", "/in/c.mp4")], "video string, path string")

    def half_reader():
        def read(path):
            if path.endswith("1.png"):
                raise ValueError(path)
            return ["x"]

        return read

    def late_teller():
        asked = []

        def tell(path, prompt):
            asked.append(path)
            if path.endswith("2.png"):
                raise KeyError(path)
            return "" if asked.count(path) == 1 else '{"action": "told at last"}'

        return tell

    def deaf_at_first():
        def hear(path, start, length):
            if start == 0 or "c.mp4" in path:
                raise RuntimeError("no")
            return [{"start_us": i, "end_us": i + 1, "text": f"word {i}"} for i in range(40 * S, 40 * S + 4)]

        return hear

    def no_words():
        def say(lines):
            raise RuntimeError("no")

        return say

    def long(command, timeout):
        done = decoder(command, timeout)
        return subprocess.CompletedProcess(command, 0, b"100.0\n", b"") if done.stdout == b"3.0\n" else done

    ports = recordings.Ports(half_reader, late_teller, deaf_at_first, no_words)
    run = recordings.worklogs(videos, str(tmp_path), ports, recordings.preset("screencast", chunk_minutes=50 / 60, filter_speech=False), long)
    rows = run.entries.orderBy("video", "ord").collect()
    assert [(r.video, r.action, len(r.speech)) for r in rows] == [("a", "told at last", 0), ("a", "（VLM呼び出し失敗: KeyError）", 4), ("c", "told at last", 0), ("c", "（VLM呼び出し失敗: KeyError）", 0)]
    assert run.warnings() == ["speech of a is lost in 0-50 seconds", "no speech of c could be heard", "2 frames could not be read, of 4", "2 descriptions failed, of 4", "1 summaries failed, of 1"]


def test_sound_reaches_the_transcriber_as_samples(spark, tmp_path):
    import wave

    import numpy as np

    sound = (np.arange(3 * 16_000) % 1000).astype("<i2")

    def with_sound(command, timeout):
        if "-ar" in command:
            with wave.open(command[-1], "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000)
                w.writeframes(sound.tobytes())
            return subprocess.CompletedProcess(command, 0, b"", b"")
        return decoder(command, timeout)

    def hear():
        return lambda samples, rate: [{"start_us": 0, "end_us": len(samples) * S // rate, "text": f"{rate} {len(samples)} {int(samples[1])}"}]

    videos = spark.createDataFrame([("a", "/in/a.mp4")], "video string, path string")
    ports = recordings.Ports(reader, teller, hear=hear)
    said, lost = recordings.spoken(videos, ports, str(tmp_path), recordings.preset("screencast", chunk_minutes=0), with_sound)
    assert [(r.start_us, r.end_us, r.text) for r in said.collect()] == [(0, 3 * S, "16000 48000 1")] and lost.first().n_failed == 0
    said, lost = recordings.spoken(videos, ports, str(tmp_path), recordings.preset("screencast", chunk_minutes=0), lambda c, t: decoder(["bad.mp4"] if "-ar" in c else c, t))
    assert said.count() == 0 and lost.first().all_failed


def test_what_is_needed_is_there(tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"")
    cli.ready([str(tmp_path / "v.mp4"), "hdfs://x/y"], ("ls",))
    for videos, programs in ((["/no/such.mp4"], ()), ([str(tmp_path / "v.mp4")], ("no-such-program",))):
        with pytest.raises(FileNotFoundError):
            cli.ready(videos, programs)


def test_options():
    args = lambda *more: cli.parser().parse_args(["log", "out", "a.mp4", "--recognise", "tests.test_cli:reader", "--describe", "tests.test_cli:teller", *more])
    assert cli.options(args()) == recordings.Options()
    meeting = cli.options(args("--mode", "meeting", "--gate-least-gap", "5", "--no-keyframes-only"))
    assert meeting.gate == GateConfig(least_gap_us=5 * S) and not meeting.keyframes_only
    assert cli.options(args("--mode", "meeting")).keyframes_only
    for wrong in (["--fps", "0"], ["--scene-threshold", "2"], ["--gate-similarity", "-1"], ["--gate-least-gap", "200"], ["--chunk-minutes", "-1"], ["--most-no-speech", "2"], ["--least-logprob", "1"], ["--tolerance", "-1"], ["--alike", "7"]):
        with pytest.raises(ValueError):
            cli.options(args(*wrong))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["log", "out"])


def test_index_and_query(spark, tmp_path, capsys):
    line = {"t": "00:00:01", "t_end": None, "app_guess": "Word", "action": "xxxx"}
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/worklog.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line | {"action": "yy", "app_guess": None}) + "\n")
    model = ["--embed", "tests.test_cli:length", "--model", "m"]
    assert cli.main(["index", str(tmp_path / "i"), str(tmp_path / "rec/worklog.jsonl"), *model]) == 0
    assert cli.main(["query", str(tmp_path / "i"), "xxxx", *model, "-k", "1"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("1. [") and "  rec  Word\n   xxxx" in out
    assert cli.main(["query", str(tmp_path / "none"), "x", *model]) == 1 and "no index" in capsys.readouterr().err
    assert cli.main(["query", str(tmp_path / "i"), "x", "--embed", "tests.test_cli:length", "--model", "other"]) == 1
