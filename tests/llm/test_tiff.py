"""Damaged TIFF files give a page with an error, and the query's media columns are those of the stored files."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.llm import tiff

SF_DIR = "/root/testdata/sf0.001"


def with_tag(data, tag, value):
    """A stored file with the value of a tag of its first directory changed."""
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    for k in range(n):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", data, place)[0] == tag:
            kind = struct.unpack_from("<H", data, place + 2)[0]
            return data[: place + 8] + struct.pack("<HH" if kind == 3 else "<I", *([value, 0] if kind == 3 else [value])) + data[place + 12 :]
    raise KeyError(tag)


@pytest.mark.parametrize("seed", range(4))
def test_damaged_directories_do_not_crash(seed):
    data = tiff.store(bytes([seed]) * 576 * 4)
    for tag, value in [(277, 0), (256, 0), (257, 2**31), (256, 2**31), (258, 0), (259, 7), (317, 9)]:
        found = tiff.read(with_tag(data, tag, value))
        assert found and found[-1]["error"], (tag, value)
    assert tiff.read(data)[0]["pixels"] == bytes([seed]) * 576 * 4


def test_random_damage_is_contained():
    r = np.random.default_rng(3)
    data = bytearray(tiff.store(bytes(range(256)) * 576))
    for _ in range(200):
        broken = bytearray(data)
        for at in r.integers(0, len(data), 6):
            broken[at] = r.integers(256)
        assert isinstance(tiff.read(bytes(broken)), list)


def test_media_columns_and_features(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "ab" * 900_000)], "doc_id long, text string"))
    stored = {r["doc_id"]: bytes(r["media"]) for r in tiff.stored(docs).collect()}
    got = tiff.payload_digests(tiff.stored(docs)).collect()
    assert len(got) == docs.count()
    for row in got:
        media = stored[row["doc_id"]]
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        payload = np.frombuffer(b"".join(p["pixels"] for p in tiff.read(media)), np.uint8)
        p = np.bincount(payload, minlength=256) / len(payload)
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
        cells = np.array([[c.mean() for c in np.array_split(r, 8, axis=1)] for r in np.array_split(payload.reshape(-1, 576), 8) if len(r)])
        bits = int("".join("1" if v > cells.mean() else "0" for v in cells.reshape(-1)), 2)
        pages = -(-len(payload) // (576 * tiff.PAGE_ROWS))
        assert row["feature"] == f"pages={pages};mean={payload.mean():.4f};std={payload.std():.4f};entropy={entropy:.4f};hash={bits:016x}"
    assert next(r for r in got if r["doc_id"] == -1)["feature"].startswith("pages=2;")
    assert tiff.payload_digests(tiff.stored(docs.filter(F.lit(False)))).count() == 0
