"""Readers of records in byte ranges, cut at every place."""

import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.sources import alignments, quartets, records


@pytest.fixture(params=[7, 64, 1 << 20])
def split(request, monkeypatch):
    monkeypatch.setattr(records, "SPLIT_BYTES", request.param)
    return request.param


def put(tmp_path, name, content):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{tmp_path / name}"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b"\n>ab"[x % 4] for x in b)), st.integers(1, 20), st.sampled_from([b"\n", b"\n>"]), st.integers(1, 9))
def test_pieces_of_all_ranges_are_those_of_the_whole(text, step, separator, block):
    found, before = [], records.BLOCK_BYTES
    records.BLOCK_BYTES = block
    try:
        for low in range(0, len(text), step):
            found += records.pieces(io.BytesIO(text), len(text), low, min(len(text), low + step), separator)
    finally:
        records.BLOCK_BYTES = before
    want, at = [], 0
    for piece in text.split(separator):
        if at < len(text):
            want.append((at, piece))
        at += len(piece) + len(separator)
    assert found == want


def test_phylip_in_ranges(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    seqs = ["".join(rng.choice(list("ACGT-"), 90)) for _ in range(11)]
    path = put(tmp_path, "a.phy", "\n 11 90\r\n" + "".join(f"t{10 - i}  {s[:40]} {s[40:]}\r\n\n" for i, s in enumerate(seqs)))
    rows = alignments.read_phylip(spark, path, renumber=False).orderBy("taxon_id").collect()
    assert [tuple(r) for r in rows] == [(i, f"t{10 - i}", s) for i, s in enumerate(seqs)]
    assert {r["taxon"]: r["taxon_id"] for r in alignments.read_phylip(spark, path).collect()} == {f"t{i}": i for i in range(11)}
    with pytest.raises(ValueError, match="rows differ from the header: 2"):
        alignments.read_phylip(spark, put(tmp_path, "b.phy", "3 2\na AC\nb AC"))
    with pytest.raises(ValueError, match="no header"):
        alignments.read_phylip(spark, put(tmp_path, "c.phy", "a AC\nb AC\n"))


def test_fasta_in_ranges(spark, tmp_path, split):
    path = put(tmp_path, "a.fa", "\n>one > x\nAC\n GT\n\n>two\r\nA\r\nC\r\n>three\n>four\nT")
    rows = [tuple(r) for r in alignments.read_fasta(spark, path).orderBy("taxon_id").collect()]
    assert rows == [(0, "one > x", "ACGT"), (1, "two", "AC"), (2, "three", ""), (3, "four", "T")]
    assert [r["taxon"] for r in alignments.read_fasta(spark, put(tmp_path, "b.fa", ">a\nA\n>b\nC\n")).orderBy("taxon_id").collect()] == ["a", "b"]


def test_nexus_in_ranges(spark, tmp_path, split):
    text = "#NEXUS\n[a matrix; of\nnothing]\nbegin data;\n dimensions ntax=3 nchar=4;\n Matrix\n'a' 01?-\n\nb  01 01\nc 1111;\nend;\nbegin trees;\n tree x = (a,b);\nend;\n"
    want = [(0, "a", "01?-"), (1, "b", "0101"), (2, "c", "1111")]
    assert [tuple(r) for r in alignments.read_nexus(spark, put(tmp_path, "a.nex", text)).orderBy("taxon_id").collect()] == want
    with pytest.raises(ValueError, match="rows differ from ntax"):
        alignments.read_nexus(spark, put(tmp_path, "b.nex", text.replace("ntax=3", "ntax=4")))
    with pytest.raises(ValueError, match="no matrix"):
        alignments.read_nexus(spark, put(tmp_path, "c.nex", "#NEXUS\nbegin trees;\nend;\n"))


def test_binary_in_ranges(spark, tmp_path, split):
    rng = np.random.default_rng(0)
    rows = np.empty(500, records.RECORD)
    rows["key"], rows["w"] = rng.integers(0, 1 << 63, 500, dtype=np.uint64) % np.uint64(97), rng.integers(-3, 4, 500)
    path = put(tmp_path, "a.bin", rows.tobytes())
    sums = {}
    for k, w in rows[rows["w"] != 0].tolist():
        sums[k] = sums.get(k, 0) + w
    assert {r["d"]: r["w"] for r in quartets.read_binary(spark, path).collect()} == sums
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "x").write_bytes(rows[:30].tobytes())
    (folder / "y").write_bytes(rows[30:].tobytes())
    (folder / "_done").write_bytes(b"no record")
    assert {r["d"]: r["w"] for r in quartets.read_binary(spark, f"file://{folder}").collect()} == sums
    for big in (np.array([(1, 1 << 31)], records.RECORD), np.array([(1, (1 << 31) - 1), (1, 1)], records.RECORD)):
        with pytest.raises(Exception, match="more than 32 bits"):
            quartets.read_binary(spark, put(tmp_path, "big.bin", big.tobytes()), int32=True).collect()
    with pytest.raises(FileNotFoundError):
        records.located(f"file://{tmp_path}/absent")


def test_index_of_quartets(spark, tmp_path):
    q = spark.createDataFrame([(3, 1, 2, 0), (5, 6, 8, 7)], "q0 int, q1 int, q2 int, q3 int")
    q.write.parquet(f"file://{tmp_path}/q")
    assert sorted(map(tuple, quartets.read_index(spark, f"file://{tmp_path}/q").collect())) == [(0, 1, 2, 3), (5, 6, 7, 8)]
    blocks = put(tmp_path, "b.csv", "block_id,members\n0,4 2 0 1 3\n")
    assert sorted(map(tuple, quartets.read_index(spark, blocks, "csv").collect())) == [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (1, 2, 3, 4)]
    with pytest.raises(Exception, match="no quartet"):
        quartets.read_index(spark, put(tmp_path, "r.csv", "q0,q1,q2,q3\n1,2,2,3\n"), "csv").collect()
