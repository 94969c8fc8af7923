"""Digests of large files are those of the whole file, though no task reads one whole."""

import hashlib
import random

import pyarrow as pa
import pytest

from attestry.sources import file_digests as D
from attestry.sources.exports import scan_manifest

SPLIT, WHOLE, ROUND = 20_000, 30_000, 50_000


@pytest.mark.parametrize("openssl", [True, False])
def test_state_is_carried(openssl, monkeypatch):
    if not openssl:
        monkeypatch.setattr(D, "_LIB", None)
    elif not D._LIB:
        pytest.skip("no OpenSSL here")
    r = random.Random(1)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 1000, 5000):
        data, state, at = r.randbytes(n), None, 0
        while at < n:
            step = r.choice([1, 63, 64, 65, 700])
            state = D.Sha256(state).update(pa.py_buffer(data[at : at + step])).state
            at += step
        assert D.Sha256(state).length == n and D.Sha256(state).hexdigest() == hashlib.sha256(data).hexdigest()


def contents():
    r = random.Random(2)
    noise = r.randbytes(230_001)
    return {
        "small.bin": noise[:WHOLE],
        "noise.bin": noise,
        "ends.bin": noise[:120_000] + b"\n",
        "marked.txt": b"\xef\xbb\xbf" + b"one\r\ntwo\n\n" * 9_000,
        "marked_end.txt": b"\xef\xbb\xbf" + b"one two\n" * 9_000 + b"x",
        "two_marks.txt": b"\xef\xbb\xbf" * 2 + b"\n" * 70_000,
        "sub/list of {a,b} %20é.json": b'["' + b'a b","' * 20_000 + b'"]',
        "zeros.bin": b"\0" * 90_000,
        "run.bin": b"a" * 90_000,
        "named.gz": noise[5:100_000],
    }


@pytest.fixture
def limits(spark, monkeypatch):
    for name, value in (("WHOLE", WHOLE), ("ROUND", ROUND), ("RUN", 5_000)):
        monkeypatch.setattr(D, name, value)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_digests_of_large_files(spark, tmp_path, limits):
    """Splits and rounds cut the files anywhere; ends without a separator, marks of UTF-8, long runs, names that would be unpacked or escaped."""
    (tmp_path / "sub").mkdir()
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    got = sorted((r.path.removeprefix(f"file:{tmp_path}/"), r.size, r.digest) for r in scan_manifest(spark, str(tmp_path)).collect())
    assert got == sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in contents().items())


def test_large_files_are_not_read_whole(spark, tmp_path, limits):
    """Spark's reader of whole files is kept from all above ``WHOLE``, as it refuses those above its own limit."""
    data = contents()["noise.bin"]
    (tmp_path / "noise.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(WHOLE))
    try:
        rows = scan_manifest(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.size, r.digest) for r in rows] == [(len(data), hashlib.sha256(data).hexdigest())]
