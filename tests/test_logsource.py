"""A log that grows between triggers is read once; a torn last line waits; ranges of any size give the same lines."""

import random

import pytest

from tallyloom.sources import logsource
from tallyloom.sources.logsource import AppendLog, LogReader


def lines_of(data: bytes, begin: int, end: int):
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if begin <= at < end:
            out.append((line.decode("utf-8", "replace"), at))
        at += len(line) + 1
    return out


def read(reader, start, end):
    return [(t, at) for p in reader.partitions(start, end) for b in reader.read(p) for t, at in zip(b.column("line").to_pylist(), b.column("at").to_pylist())]


@pytest.mark.parametrize("split, block", [(1, 7), (3, 1), (10, 64), (1 << 20, 5), (64, 1 << 20)])
def test_ranges_of_any_size(tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(logsource, "BLOCK", block)
    rnd, data, path = random.Random(split), b"", tmp_path / "log"
    reader = LogReader({"path": str(path), "split": str(split)})
    assert reader.latestOffset() == {"at": 0}  # not there yet
    at = {"at": 0}
    for _ in range(12):
        data += b"".join(rnd.choice([b"", b"a", "é日".encode(), b"\xff", b"x" * 30, b"\r"]) + b"\n" for _ in range(rnd.randint(0, 9))) + rnd.choice([b"", b"torn"])
        path.write_bytes(data)
        now = reader.latestOffset()
        assert now["at"] == data.rfind(b"\n") + 1
        assert read(reader, at, now) == lines_of(data, at["at"], now["at"])
        at = now
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(at, {"at": at["at"] - 1})


@pytest.mark.parametrize("split", [1, 3, 17, 1 << 20])
def test_parts_of_a_log(tmp_path, split):
    """The ranges of a folder's parts give the lines of the parts one behind the other; the last one may be torn, and grow."""
    rnd, whole, at = random.Random(split), b"", {"at": 0}
    reader = LogReader({"path": str(tmp_path / "log"), "split": str(split), "parts": "true"})
    assert reader.latestOffset() == {"at": 0}
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "_SUCCESS").write_bytes(b"")
    for i in range(6):
        data = b"".join(rnd.choice([b"", b"a", "é日".encode(), b"x" * 30]) + b"\n" for _ in range(rnd.randint(0, 9)))
        (tmp_path / "log" / f"part-{i:05d}").write_bytes(data + (b"torn" if i % 2 else b""))
        now = reader.latestOffset()
        assert now["at"] == len(whole + data)
        assert read(reader, at, now) == lines_of(whole + data, at["at"], now["at"])
        (tmp_path / "log" / f"part-{i:05d}").write_bytes(data + (b"torn\n" if i % 2 else b""))
        whole, at = whole + data + (b"torn\n" if i % 2 else b""), now
    now = reader.latestOffset()
    assert now["at"] == len(whole) and read(reader, {"at": 0}, now) == lines_of(whole, 0, len(whole))


def test_a_growing_log(spark, tmp_path):
    path, spark_ = tmp_path / "ledger.jsonl", spark
    spark_.dataSource.register(AppendLog)

    def run():
        stream = spark_.readStream.format("append_log").option("path", str(path)).option("split", "40").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["at"], r["line"]) for r in spark_.read.schema("line string, at long").parquet(str(tmp_path / "out")).collect())

    path.write_text('{"n": 1}\n{"n": 2}\n{"n"')
    assert [line for _, line in run()] == ['{"n": 1}', '{"n": 2}']
    with path.open("a") as f:
        f.write(': 3}\n\n{"n": 4}\n' + "".join(f'{{"n": {i}}}\n' for i in range(5, 30)))
    assert [line for _, line in run()] == [f'{{"n": {i}}}' for i in (1, 2, 3)] + [""] + [f'{{"n": {i}}}' for i in range(4, 30)]
    assert len(run()) == 30  # nothing new
