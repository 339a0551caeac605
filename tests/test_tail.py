"""Following files that grow."""

import io
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirevault.session import new_scratch_dir
from wirevault.sources import tail
from wirevault.sources.tail import finished, lines_of, stream_tail


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: b.replace(b"\n", b"")), max_size=30), st.binary(max_size=5), st.integers(1, 40), st.integers(1, 9))
def test_parts_have_every_finished_line_once(lines, torn, part, block):
    data = b"".join(line + b"\n" for line in lines) + torn.replace(b"\n", b"")
    old, tail._BLOCK = tail._BLOCK, block
    try:
        file = pa.PythonFile(io.BytesIO(data), mode="r")
        end = finished(file, len(data))
        assert end == len(data) - len(torn.replace(b"\n", b""))
        found = []
        for low in range(0, end, part):
            found += lines_of(file, low, min(low + part, end), end)
    finally:
        tail._BLOCK = old
    assert found == lines


@pytest.fixture
def follow(spark):
    root = new_scratch_dir(spark, "test-tail")
    os.makedirs(f"{root}/logs")

    def run(name="a", **options):
        stream_tail(spark, f"{root}/logs", **options).writeStream.format("parquet").option(
            "checkpointLocation", f"{root}/state-{name}"
        ).trigger(availableNow=True).start(f"{root}/lines-{name}").awaitTermination()
        found = spark.read.schema("value string, src_file string").parquet(f"{root}/lines-{name}").collect()
        return sorted((os.path.basename(r.src_file), r.value) for r in found)

    def write(name, data, mode="ab"):
        with open(f"{root}/logs/{name}", mode) as file:
            file.write(data)

    return run, write


def test_lines_come_once_when_they_are_finished(follow):
    run, write = follow
    write("x.log", b"one\ntw")
    assert run(part_bytes=3) == [("x.log", "one")]
    write("x.log", b"o\r\n\nthree \xff\nfo")
    write("y.log", b"other\n")
    write(".hidden", b"no\n")
    want = [("x.log", ""), ("x.log", "one"), ("x.log", "three �"), ("x.log", "two"), ("y.log", "other")]
    assert run(part_bytes=3) == want
    assert run(part_bytes=3) == want  # nothing new
    write("x.log", b"ur\n")
    assert run(part_bytes=1 << 20) == sorted([*want, ("x.log", "four")])
    write("x.log", b"again\n", mode="wb")  # cut and written anew
    assert run() == sorted([*want, ("x.log", "four"), ("x.log", "again")])


def test_start_at_the_end(follow):
    run, write = follow
    write("x.log", b"old\nto")
    assert run(start="end") == []
    write("x.log", b"rn\nnew\n")
    assert run(start="end") == [("x.log", "new"), ("x.log", "torn")]
    with pytest.raises(ValueError, match="beginning"):
        run(start="middle")


def test_parts_grow_with_the_growth(tmp_path):
    (tmp_path / "x.log").write_bytes(b"".join(b"line %d\n" % n for n in range(1000)))
    (tmp_path / "y.log").write_bytes(b"other\n")
    reader = tail._Reader({"path": str(tmp_path), "partbytes": "16", "parts": "8"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 10  # one more for a file at most; in parts of 16 bytes there would be 557
    found = [value for part in parts for batch in reader.read(part) for value in batch.column("value").to_pylist()]
    assert found == [f"line {n}" for n in range(1000)] + ["other"]
    assert tail.part_size(100, 16, 8) == 16 and tail.part_size(1 << 40, 16, 8) == tail.PART_BYTES
    assert tail.part_size(1 << 40, tail.PART_BYTES * 2, 8) == tail.PART_BYTES * 2
