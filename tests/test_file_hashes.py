"""Files are hashed piece by piece: no file is held as one value."""

import hashlib

import pytest

from tallyspark.sources import headers, results

KEY = "spark.sql.sources.binaryFile.maxLength"


def test_a_file_that_does_not_fit_into_a_value(spark, tmp_path, monkeypatch):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "m%20.bin").write_bytes(bytes(range(256)) * 40_000)
    (tmp_path / "n.bin").write_bytes(b"n")
    whole = results.fingerprints(spark, str(tmp_path), "*.bin").first()
    monkeypatch.setattr(results, "reachable", lambda path: False)
    in_store = results.fingerprints(spark, str(tmp_path), "*.bin").first()
    monkeypatch.setattr(results, "WHOLE", 9)
    by_driver = results.fingerprints(spark, str(tmp_path), "*.bin").first()
    monkeypatch.undo()
    spark.conf.set(KEY, "1000")
    try:
        cut = results.fingerprints(spark, str(tmp_path), "*.bin").first()
    finally:
        spark.conf.unset(KEY)
    assert whole == in_store == by_driver == cut and whole["files"] == 2


def test_hash_of_a_file(tmp_path):
    data = b"x\n" * (headers.PIECE // 2 + 7)
    (tmp_path / "f").write_bytes(data)
    assert headers.sha256(str(tmp_path / "f"), len(data)) == headers.sha256(f"file:{tmp_path}/f", len(data)) == hashlib.sha256(data).hexdigest()
    with pytest.raises(OSError):
        headers.sha256(str(tmp_path / "f"), len(data) + 1)


def test_no_files(spark, tmp_path):
    assert results.fingerprints(spark, str(tmp_path), "*.bin").first()["files"] == 0
