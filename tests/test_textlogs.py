"""The text log source: appended files, restarts, torn lines and splits."""

from __future__ import annotations

import os

import pytest

from corpusprep.sources import textlogs


def offsets(text: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split(b"\n"):
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_every_line_in_one_part(spark, tmp_path, split):
    text = "a\n\nbb\r\nü — long line of text\n\n\nlast without break".encode()
    (tmp_path / "one.log").write_bytes(text)
    (tmp_path / "two.txt").write_bytes(b"x\ny\n")
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "other.bin").write_bytes(b"no log")
    got = textlogs.read_text_logs(spark, str(tmp_path), split=split).collect()
    assert sorted((r.seq, r.line) for r in got if r.run_id == "one") == offsets(text)
    assert sorted((r.seq, r.line) for r in got if r.run_id == "two") == [(0, "x"), (2, "y")]
    assert {r.run_id for r in got} == {"one", "two"}


def test_lines_longer_than_a_block(spark, tmp_path):
    lines = ["x" * 200_000, "short", "y" * 70_000, ""]
    (tmp_path / "r.log").write_text("\n".join(lines) + "\n")
    got = textlogs.read_text_logs(spark, str(tmp_path), split=50_000).orderBy("seq").collect()
    assert [r.line for r in got] == lines


def test_stream_with_appends_a_restart_and_a_torn_line(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    os.makedirs(logs / "runs" / "b")

    def drain():
        # Each call is a new query on the same checkpoint, as after a restart.
        stream = textlogs.stream_text_logs(spark, str(logs), run=r"([^/]*)/[^/]*$", split=5)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run_id, r.seq, r.line) for r in spark.read.schema(textlogs.TEXT_LOG_SCHEMA).parquet(out).collect())

    a, b = logs / "runs" / "train.log", logs / "runs" / "b" / "train.log"
    a.write_bytes(b"ENV {}\nPHASE:LM start\nProgr")
    want = [("runs", 0, "ENV {}"), ("runs", 7, "PHASE:LM start")]
    assert drain() == want
    assert drain() == want
    with a.open("ab") as file:
        file.write(b"ess: 5%\nDON")
    b.write_bytes(b"ERR:busy\nDONE\n")
    want += [("runs", 22, "Progress: 5%"), ("b", 0, "ERR:busy"), ("b", 9, "DONE")]
    assert drain() == sorted(want)
    with a.open("ab") as file:
        file.write(b"E\n")
    assert drain() == sorted([*want, ("runs", 35, "DONE")])
    times = [r.ts for r in spark.read.schema(textlogs.TEXT_LOG_SCHEMA).parquet(out).collect()]
    assert all(t is not None for t in times) and len(set(times)) == 3


def test_no_files(spark, tmp_path):
    assert textlogs.read_text_logs(spark, str(tmp_path / "missing")).collect() == []
