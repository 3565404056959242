from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from corpusprep.functions.tokens import byte_ids
from corpusprep.operators import telemetry as L
from corpusprep.operators.packing import pack_blocks, with_offsets
from corpusprep.sources import jsonl, listing, logs, manifest, text
from corpusprep.streaming.examples import stream_examples
from corpusprep.streaming.logs import stream_idle, stream_latest
from corpusprep.streaming.packing import BlockPacker, stream_pack


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\nCR\r\n\r\n```py\r\ntw\xffo\rthree")
    lines = text.scan_lines(spark, str(tmp_path / "in")).orderBy("path", "block", "line")
    assert [r.text for r in lines.collect()] == ["one", "two", "three"]
    docs = text.scan_documents(spark, str(tmp_path / "in")).collect()
    assert [r.text for r in docs] == ["one\n\n\n\ntwo\nthree"]
    paragraphs = text.split_paragraphs(text.scan_documents(spark, str(tmp_path / "in")))
    assert [r.text for r in paragraphs.collect()] == ["one", "two\nthree"]
    for _ in range(2):  # the second write replaces the first
        text.write_corpus(lines, str(tmp_path / "out"))
        text.write_run(lines, str(tmp_path / "run"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    assert spark.read.parquet(str(tmp_path / "run")).count() == 3


def test_jsonl_scan(spark, tmp_path):
    (tmp_path / "d.jsonl").write_bytes(b'{"a":1}\n\n  \n{bad\n[1]\n {"text":"x\xff"} \n')
    good, bad = jsonl.scan_jsonl(spark, str(tmp_path / "d.jsonl"))
    assert [r.raw for r in good.orderBy("line").collect()] == ['{"a":1}', '{"text":"x"}']
    assert [r.reject for r in bad.orderBy("line").collect()] == ["unparsable", "not an object"]
    good, bad = jsonl.scan_jsonl(spark, str(tmp_path / "d.jsonl"), strict=True)
    assert [r.raw for r in good.collect()] == ['{"a":1}']
    assert [r.reject for r in bad.orderBy("line").collect()] == ["unparsable", "not an object", "undecodable"]


def test_listings(spark, tmp_path):
    for folder, names in (("one", ["b.jsonl", "a.jsonl", "m.gguf"]), ("two", ["b.jsonl", "dataset.jsonl", "m.gguf", "k.gguf"])):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_text("x")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    files = listing.list_files(spark, one, "*.jsonl").unionByName(listing.list_files(spark, two, "*.jsonl"))
    picked = {r.folder: r.path.rsplit("/", 1)[1] for r in listing.pick_dataset(files).collect()}
    assert picked == {one: "a.jsonl", two: "dataset.jsonl"}
    models = [listing.list_files(spark, d, "*.gguf") for d in (one, two)]
    assert [r.name for r in listing.merge_listings(*models).collect()] == ["k.gguf", "m.gguf"]
    requests = spark.createDataFrame([("m.gguf",), ("k.gguf",), ("z.gguf",)], "name string")
    found = {r.name: r.path for r in listing.resolve_paths(requests, *models).collect()}
    assert found["m.gguf"].endswith("/one/m.gguf") and found["k.gguf"].endswith("/two/k.gguf")
    assert found["z.gguf"] == "z.gguf"


def test_paragraphs_of_a_split_file(spark, tmp_path):
    """Many splits, mixed line breaks, fences and tags at their borders: the rows of the whole-text scan."""
    rng = random.Random(2)
    bits = ["one line", "two\nlines", "a <0x0A> tag", "tag <0x0D>", "<0x0A>", "```py\nx = 1\n```", " ", "self CR", "ü — ", "x" * 300, "", "\t", "CR13"]
    for k, newline in enumerate(["\n", "\r\n", "\r"]):
        made = "".join(rng.choice(bits) + newline * rng.choice([1, 1, 2, 3]) for _ in range(150))
        (tmp_path / f"f{k}.txt").write_bytes(made.replace("\n", newline).encode() + b"\xff end")
    (tmp_path / "empty.txt").write_bytes(b"")
    want = text.split_paragraphs(text.scan_documents(spark, str(tmp_path))).collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = text.scan_paragraphs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    def texts(rows):
        return [(r.path, r.text) for r in sorted(rows, key=lambda r: (r.path, r.paragraph_no))]

    assert texts(got) == texts(want) and len(want) > 100


def test_manifest_tables(spark, tmp_path):
    spark.createDataFrame([("m", "k", "1", "int", None)], manifest.KV_SCHEMA).write.parquet(str(tmp_path / "kv"))
    spark.createDataFrame([("m", "t", [2, 3], "F16", 12)], manifest.TENSOR_SCHEMA).write.parquet(str(tmp_path / "t"))
    kv, tensors = manifest.read_manifest(spark, str(tmp_path / "kv"), str(tmp_path / "t"))
    assert kv.count() == 1 and tensors.first().shape == [2, 3]


def drain(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_examples_equal_batch(spark, tmp_path):
    rows = ['{"prompt":"p%d","answer":"a"}' % i for i in range(5)] + ["{bad", "", '{"text":"t"}', '{"prompt":1,"answer":"a"}']
    for i in range(3):
        (tmp_path / f"f{i}.jsonl").write_text("\n".join(rows[i::3]) + "\n")
    examples, rejected = stream_examples(spark, str(tmp_path), files_per_trigger=1)
    drain(examples, "append", "examples")
    drain(rejected, "append", "rejected")
    assert spark.table("examples").groupBy("kind").count().orderBy("kind").collect() == [("pair", 5), ("text", 1)]
    assert sorted(r.reject for r in spark.table("rejected").collect()) == ["field is not a string", "unparsable"]


def test_stream_examples_reject_torn_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_bytes(b'{"text":"good"}\n{"text":"x\xff"}\n')
    examples, rejected = stream_examples(spark, str(tmp_path))
    drain(examples, "append", "whole_examples")
    drain(rejected, "append", "torn")
    assert [r.example for r in spark.table("whole_examples").collect()] == ["good"]
    assert [r.reject for r in spark.table("torn").collect()] == ["not UTF-8"]


def test_stream_pack_equals_batch(spark, tmp_path):
    rows = [("hot" if i % 3 else f"s{i % 2}", i, "x" * (i * 7 % 40) + str(i)) for i in range(60)]
    schema = "source string, seq bigint, text string"
    (tmp_path / "in").mkdir()
    for part in range(4):
        body = [dict(zip(("source", "seq", "text"), r)) for r in rows[part * 15 : part * 15 + 15]]
        if part == 2:
            body.append({"source": "hot", "seq": 1, "text": "late"})
            body.append({"source": "hot", "seq": None, "text": "no key"})
        file = tmp_path / "in" / f"{part}.json"
        file.write_text("\n".join(map(json.dumps, body)))
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))  # files are read oldest first
    packer = BlockPacker(str(tmp_path / "out"), 16, byte_ids(F.col("text")))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        query = stream_pack(stream, packer, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(200)
    batch = spark.createDataFrame(rows, schema)
    ids = with_offsets(batch, byte_ids(F.col("text")), key="seq", group=["source"])
    columns = ["source", "block_id", "x", "y"]
    wanted = {tuple(map(str, r)) for r in pack_blocks(ids, 16, ["source"]).select(columns).collect()}
    got = spark.read.parquet(packer.path("blocks")).select(columns).collect()
    assert len(got) == len(wanted) and {tuple(map(str, r)) for r in got} == wanted
    late = spark.read.parquet(packer.path("late")).collect()
    assert sorted((r.reason, r.source, r.seq) for r in late) == [("late", "hot", 1), ("no key", "hot", None)]


def test_stream_pack_loses_no_token(spark, tmp_path):
    """Tokens in are those in blocks, tails and set-aside rows, with keys null and repeated."""
    random.seed(4)
    rows = [("s%d" % (i % 3), random.choice([i, i // 2, None]), "y" * random.randint(0, 30)) for i in range(60)]
    rows += [("empty", 1, "")]
    packer = BlockPacker(str(tmp_path / "out"), 8, byte_ids(F.col("text")))
    schema = "source string, seq bigint, text string"
    for k in range(3):
        packer(spark.createDataFrame(rows[k::3], schema), k)
    count = lambda df, c: df.agg(F.sum(F.size(c))).first()[0] or 0
    blocks = spark.read.parquet(packer.path("blocks")).withColumn("x", F.col("x"))
    late = spark.read.parquet(packer.path("late"))
    state = spark.read.parquet(packer.path("state", 2))
    total = sum(len(t) + 2 for _, _, t in rows)
    assert count(blocks, "x") + count(state, "tail") + count(late, "ids") == total
    assert {r.source for r in state.collect()} == {"s0", "s1", "s2", "empty"}


LOG = [
    (1, 0, "2024-01-01 00:00:00", "PHASE:LM start"),
    (1, 1, "2024-01-01 00:00:04", "Progress:  10.00% | epoch 1/2 | step 5/50 | loss 2.5 | s_it 0.1s/it"),
    (1, 2, "2024-01-01 00:00:30", "Progress:  12.00% | epoch 1/2 | step 6/50 | loss 2.4 | s_it 0.1s/it | elapsed 1.0m | ETA 2.0m"),
    (1, 3, "2024-01-01 00:00:31", "PHASE:LM done"),
    (1, 4, "2024-01-01 00:00:32", "Saved weights: out/m.gguf"),
    (1, 5, "2024-01-01 00:00:33", "DONE"),
    (2, 0, "2024-01-01 00:00:00", 'ENV {"phase":"spm_train","status":"start"}'),
    (2, 1, "2024-01-01 01:00:00", "ERROR: ValueError: x"),
]


def test_log_operators(spark):
    log = spark.createDataFrame(LOG, "run_id bigint, seq bigint, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    ordered = L.order_lines(log)
    steps = L.eta(ordered, total=4).orderBy("done").collect()
    assert [(r.done, r.elapsed, r.per_step, r.remaining) for r in steps] == [(1, 4.0, 4.0, 12.0), (2, 30.0, 15.0, 30.0)]
    spans = {r.run_id: (r.phase, r.lines, r.closed, r.seconds) for r in L.phase_spans(ordered).collect()}
    assert spans == {1: ("LM", 6, True, 31.0), 2: ("spm_train", 2, False, 3600.0)}
    assert [(r.run_id, r.gap_seconds) for r in L.idle_gaps(ordered).orderBy("run_id").collect()] == [(1, 26.0), (2, 3600.0)]
    ends = {r.run_id: (r.done, r.failed, r.last_error, r.saved_path) for r in L.run_outcome(log).collect()}
    assert ends == {1: (True, False, None, "out/m.gguf"), 2: (False, True, "ERROR: ValueError: x", None)}


def test_log_streams(spark, tmp_path):
    for i, (run, seq, ts, line) in enumerate([*LOG, (3, 0, "2024-01-02 00:00:00", "x")]):
        body = {"run_id": run, "seq": seq, "ts": ts.replace(" ", "T") + "Z", "line": line}
        (tmp_path / f"{i:02d}.json").write_text(json.dumps(body))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    log = logs.read_log_stream(spark, str(tmp_path), files_per_trigger=3)
    drain(stream_latest(log), "update", "latest")
    last = spark.table("latest").filter("run_id = 1").orderBy(F.desc("step"), F.desc_nulls_last("saved_path")).first()
    assert (last.step, last.loss, last.eta, last.saved_path) == ("6", "2.4", "2.0m", "out/m.gguf")
    drain(stream_idle(log), "append", "idle")
    stretches = {(r.run_id, str(r.started), r.lines) for r in spark.table("idle").collect()}
    assert stretches >= {(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 00:00:30", 4), (2, "2024-01-01 00:00:00", 1)}
