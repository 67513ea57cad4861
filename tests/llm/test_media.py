import hashlib
import json
import zlib

import pytest
from pyarrow import fs

from quorate.llm import media

SCHEMA = "doc_id long, text string, media string"


def test_round_trip(spark):
    texts = [(1, None, "x"), (2, "", "x"), (None, "é" * 500, "x"), (4, "a" * 192, "x"), (5, "same", "x"), (5, "same", "x"), (6, "long \n" * 40000, "x")]
    rows = media.round_trip(spark.createDataFrame(texts, SCHEMA)).collect()
    assert len(rows) == len(texts)
    want = set()
    for i, t, _ in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.add((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
        stored = media.to_png(raw)
        assert media.from_png(stored) == (payload, len(raw))
        assert any(r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored) and r.feature == media.feature(payload) for r in rows)
    assert {tuple(r)[:5] for r in rows} == want
    assert media.round_trip(spark.createDataFrame(texts, SCHEMA).limit(0)).count() == 0


def test_ranges_retries_and_orphans(spark, tmp_path):
    folder = f"file://{tmp_path}/arch"
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(cast(id as string), 100) as text").repartition(3)
    assert media.write_archives(docs, folder) == 3
    (tmp_path / "arch" / "orphan.zip").write_bytes(b"left by a failed attempt")
    got = media.read_archives(spark, folder, rangeBytes=3000, batchBytes=1000)
    assert got.rdd.getNumPartitions() > 3
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))
    reader = media.ArchiveReader({"path": folder, "retries": "2"})
    store, root = fs.FileSystem.from_uri(folder)
    name = json.loads((tmp_path / "arch" / media.MANIFEST).read_text())[0][0]
    with pytest.raises(OSError, match="damaged"):
        reader.member(store, f"{root}/{name}", 0, 10, 0)


def test_a_member_is_read_again_at_its_offset(tmp_path):
    (tmp_path / "a").write_bytes(b"PK\x03\x04" + bytes(26) + b"payload")
    store, calls = fs.LocalFileSystem(), []

    class Flaky:
        def open_input_file(self, path):
            calls.append(path)
            if len(calls) == 1:
                raise OSError("gone for a moment")
            return store.open_input_file(path)

    reader = media.ArchiveReader({"path": "x"})
    assert reader.member(Flaky(), str(tmp_path / "a"), 0, 7, zlib.crc32(b"payload")) == (b"payload", 2)
