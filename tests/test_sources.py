"""Snapshots, the flat binary file and its corruptions, and the stream sink."""

import struct

import pytest

from orrery import errors as E
from orrery.functions.metrics import Metric
from orrery.sources.snapshot import Snapshot
from orrery.sources.vndb import open_vndb, write_vndb
from orrery.streaming.ingest import SnapshotSink
from tests.test_vectors import frame, found

ROWS = [(10, [0, 0, 0]), (20, [1, 0, 0]), (30, [10, 10, 10])]


def test_snapshot_and_file_round_trips(spark, tmp_path):
    Snapshot.write(frame(spark, ROWS), f"file://{tmp_path}/s", 3)
    write_vndb(frame(spark, ROWS), f"{tmp_path}/v.bin", 3, Metric.COSINE)
    for s in (Snapshot.open(spark, f"file://{tmp_path}/s"), open_vndb(spark, f"{tmp_path}/v.bin")):
        assert s.get(20) == [1, 0, 0] and len(s) == 3
    assert found(Snapshot.open(spark, f"file://{tmp_path}/s").search([0, 0.1, 0], 2)) == [10, 20]
    assert s.metric is Metric.COSINE
    with pytest.raises(E.DuplicateId):
        Snapshot.write(frame(spark, ROWS + ROWS[:1]), f"file://{tmp_path}/t", 3)
    with pytest.raises(E.EngineIOError):
        Snapshot.open(spark, f"file://{tmp_path}/t")


def test_file_layout(spark, tmp_path):
    write_vndb(frame(spark, [(5, [1, 2])]), f"{tmp_path}/one.bin", 2)
    data = (tmp_path / "one.bin").read_bytes()
    assert len(data) == 48 and data[:4] == b"BDNV"


@pytest.mark.parametrize("data", [b"garbage", b"", struct.pack("<IIQQII", 0x564E4442, 999, 2, 0, 0, 0), struct.pack("<IIQQII", 1, 1, 2, 0, 0, 0), struct.pack("<IIQQII", 0x564E4442, 1, 0, 5, 0, 0), struct.pack("<IIQQII", 0x564E4442, 1, 4, 1000, 0, 0), struct.pack("<IIQQII", 0x564E4442, 1, 2**64 - 1, 2**64 - 1, 0, 0), struct.pack("<IIQQII", 0x564E4442, 1, 2, 0, 99, 0)])
def test_corrupt_files(spark, tmp_path, data):
    (tmp_path / "x.bin").write_bytes(data)
    with pytest.raises(E.EngineIOError):
        open_vndb(spark, f"{tmp_path}/x.bin")


def test_stream_sink_adds_batches_once(spark, tmp_path):
    sink = SnapshotSink(f"file://{tmp_path}/st", 3)
    sink(frame(spark, ROWS[:2]), 0)
    sink(frame(spark, ROWS[2:]), 1)
    sink(frame(spark, ROWS[2:]), 1)
    assert len(sink.latest(spark, 2)) == 3
    with pytest.raises(E.DuplicateId):
        sink(frame(spark, ROWS[:1]), 2)
    assert len(sink.latest(spark, 3)) == 3 and found(sink.latest(spark, 3).search([9, 9, 9], 1)) == [30]
    assert len(sink.latest(spark, 1)) == 2 and sink.latest(spark, 0) is None
    assert len([p for p in (tmp_path / "st").iterdir() if p.name.startswith("segment-")]) == 2  # earlier batches aren't written again
