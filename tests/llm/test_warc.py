from __future__ import annotations

import hashlib
import io
import random
import struct

import zstandard

from corpusprep.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, digest string")


def row(i, url, html):
    return (i, url, html, "clash", "clash")


def written(spark, rows, **options):
    place = warc.archive_folder(spark)
    manifest = warc.write_archives(warc.plan_records(pages(spark, rows)), place, **options)
    return place, manifest, warc.read_archives(spark, manifest, place, payload=True).collect()


def test_round_trip(spark):
    rng = random.Random(2)
    body = lambda n: "".join(rng.choice("<p>abcdé \n\r") for _ in range(n))
    big, hot = body(5000), body(1200)
    rows = [row(i, f"http://e.org/{i}", body(rng.randint(0, 3000))) for i in range(200)]
    rows += [row(300 + i, "http://e.org/hot page", hot) for i in range(60)]
    rows += [row(400, "u", big), row(401, "u", big), row(402, None, None), row(403, "x\r\nEvil: 1", ""), row(404, "u", "s"), row(405, "u", "s")]
    rows += [row(None, "n", big), row(406, "u", "y" * 2_000_000), row(401, "u", big)]
    place, manifest, got = written(spark, rows, archive_bytes=200_000, sample_bytes=40_000, dictionary_bytes=4096)
    assert len(got) == len(rows) and all(r.valid for r in got)
    want = {}
    for i, u, h, *_ in rows:
        payload = (h or "").encode()
        same = [x[0] for x in rows if x[0] is not None and (x[2] or "").encode() == payload] if len(payload) >= 1000 else []
        full = max(same) if same else i
        want[i] = (len(payload), hashlib.sha1(payload).hexdigest(), "response" if i == full else "revisit", None if i == full else full)
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    files = manifest.collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 3


def test_file_format(spark):
    _, manifest, _ = written(spark, [row(i, "http://e.org", "<html>" + "same words here " * 60 + str(i)) for i in range(300)])
    path = max(manifest.collect(), key=lambda f: f.bytes).path
    raw = open(path, "rb").read()
    magic, length = struct.unpack("<II", raw[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + length]))
    frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    first = frame.decompress(raw[8 + length :])
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n")
    assert first.count(b"WARC-Type:") == 1 and frame.unused_data[:4] == raw[8 + length : 12 + length]


def test_lost_tasks_leave_no_files(spark):
    place = warc.archive_folder(spark)
    store, base = warc.open_folder(place)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/left-over.warc.zst", compression=None) as out:
        out.write(b"half")
    manifest = warc.write_archives(warc.plan_records(pages(spark, [row(1, "u", "x")])), place)
    names = [f.path for f in store.get_file_info(warc.fs.FileSelector(base)) if f.path.endswith(".zst")]
    assert len(names) == manifest.count() == 1


def test_empty_table(spark):
    assert written(spark, [])[2] == []


def test_small_samples_make_a_dictionary():
    samples = [b"tiny"]
    dictionary = warc.build_dictionary(samples, 1024)
    packed = zstandard.ZstdCompressor(dict_data=dictionary).compress(b"tiny tiny")
    again = zstandard.ZstdCompressionDict(dictionary.as_bytes())
    assert zstandard.ZstdDecompressor(dict_data=again).stream_reader(io.BytesIO(packed)).read() == b"tiny tiny"
