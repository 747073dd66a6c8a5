"""Sources and sinks over small files."""

import io
import json

import pytest

from parchment.sources import pack as P
from parchment.sources import warehouse as W


def test_scans_and_packs(spark, tmp_path, sf):
    assert W.scan_warehouse(spark, sf, "region").columns == ["r_regionkey", "r_name"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"header": [{"batch_id": "x", "n": 1}],\n "other": [1]}')
    pack = W.scan_pack(spark, str(tmp_path / "p"), {"header": "batch_id string, n int", "missing": "a string"})
    assert [tuple(r) for r in pack["header"].collect()] == [("x", 1)]
    assert pack["missing"].collect() == [] and pack["missing"].columns == ["a"]
    (tmp_path / "p" / "b.txt").write_bytes(b"caf\xe9 ok")
    assert "ok" in W.scan_text_media(spark, str(tmp_path / "p" / "b.txt")).first()["text"]
    assert [r["size"] for r in W.scan_objects(spark, str(tmp_path / "p"), "txt").collect()] == [7]


def test_admission_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.pdf", 300 << 20), ("d.pdf", 0)], "filename string, size long")
    ok, bad = W.admit_files(files, ["pdf"])
    assert [r.filename for r in ok.collect()] == ["a.PDF"]
    assert sorted((r.filename, r.reason) for r in bad.collect()) == [("b.exe", "extension"), ("c.pdf", "size"), ("d.pdf", "empty")]
    W.write_snapshot({"r": spark.createDataFrame([(1, "x")], "run_id int, v string")}, str(tmp_path / "s"))
    assert W.read_snapshot(spark, str(tmp_path / "s"), ["r"])["r"].select("v").first()[0] == "x"
    for _ in range(2):
        W.write_audit(spark.createDataFrame([(1,)], "run_id int"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_snapshots_of_other_runs_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    for run, value in ((1, "a"), (2, "b"), (1, "c")):
        W.write_snapshot({"r": spark.createDataFrame([(run, value)], "run_id int, v string")}, path)
    assert sorted((r.run_id, r.v) for r in W.read_snapshot(spark, path, ["r"])["r"].collect()) == [(1, "c"), (2, "b")]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_packs_are_read_piece_by_piece(chunk):
    rows = [{"a": k, "b": "é\\\"]}" * k, "c": [k, {"x": None}]} for k in range(40)]
    text = json.dumps({"n": 12.5, "other": [[1, 2], 3, {"rows": [1]}], "rows": rows[:30], "t": {"rows": [9]}, "none": []}, ensure_ascii=False)[:-1] + ', "rows": ' + json.dumps([*rows[30:], 7, None]) + "}"
    assert list(P.pack_rows(io.BytesIO(("\ufeff" + text).encode()), "rows", chunk)) == rows
    assert list(P.pack_rows(io.BytesIO(text.encode()), "none", chunk)) == list(P.pack_rows(io.BytesIO(b" {} "), "rows", chunk)) == []
    with pytest.raises(ValueError):
        list(P.pack_rows(io.BytesIO(b'{"rows": [{"a": 1}'), "rows", chunk))


def test_a_relation_larger_than_what_is_held(spark, tmp_path):
    """A pack of one long line; values that don't fit the declared type are null."""
    with (tmp_path / "big.json").open("w") as f:
        f.write('{"rows": [')
        f.write(", ".join(json.dumps({"id": k, "name": "x" * 200, "value": "many" if k % 2 else k / 2}) for k in range(20_000)))
        f.write("]}")
    seen = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            seen.append(n)
            return super().read(n)

    assert sum(1 for _ in P.pack_rows(Counted(str(tmp_path / "big.json")), "rows")) == 20_000
    assert max(seen) <= 1 << 17
    out = W.scan_pack(spark, str(tmp_path), {"rows": "id long, name string, value double"})["rows"]
    assert out.count() == 20_000 and out.filter("value is null").count() == 10_000
