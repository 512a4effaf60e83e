"""Archives of an index, and passages chosen under a cap."""

import io
import random
import tarfile

import pytest

from pressloom.operators import chunking as D
from pressloom.operators import export as E


def tree(root):
    for name in ("manifest/a.parquet", "chunks/b.parquet", "chunks/sub/c.parquet", "vectors/v.parquet", "secret/key", ".env"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())


def test_pack_holds_listed_parts_only(tmp_path):
    root = tmp_path / "root"
    tree(root)
    record = E.pack(root, tmp_path / "a.tar.gz", model="m1")
    assert record["totals"]["files"] == 4 and E.read_record(tmp_path / "a.tar.gz") == record
    with tarfile.open(tmp_path / "a.tar.gz") as tar:
        assert sorted(tar.getnames()) == ["EXPORT.json", "chunks/b.parquet", "chunks/sub/c.parquet", "manifest/a.parquet", "vectors/v.parquet"]
    assert E.verify(tmp_path / "a.tar.gz", "m1") == [] and "not of m2" in E.verify(tmp_path / "a.tar.gz", "m2")[0]
    assert E.unpack(tmp_path / "a.tar.gz", tmp_path / "out") == 5 and (tmp_path / "out/chunks/b.parquet").read_text() == "chunks/b.parquet"


def test_missing_parts_and_links_out(tmp_path):
    root = tmp_path / "root"
    tree(root)
    (root / "chunks/link").symlink_to("/etc/hostname")
    with pytest.raises(ValueError):
        E.pack(root, tmp_path / "a.tar.gz")
    (root / "chunks/link").unlink()
    (root / "manifest/a.parquet").unlink()
    (root / "manifest").rmdir()
    with pytest.raises(FileNotFoundError, match="manifest"):
        E.pack(root, tmp_path / "a.tar.gz")


def test_verify_tells_what_is_wrong(tmp_path):
    root = tmp_path / "root"
    tree(root)
    a = tmp_path / "a.tar.gz"
    E.pack(root, a)
    (tmp_path / "a.tar.gz.sha256").write_text("0" * 64 + "  a.tar.gz\n")
    assert E.verify(a) == ["checksum differs"]
    (tmp_path / "a.tar.gz.sha256").unlink()
    assert E.verify(a) == ["no checksum beside the archive"]
    bad = tmp_path / "bad.tar.gz"
    with tarfile.open(bad, "w:gz") as tar:
        for name, body in (("../x", b"1"), (E.RECORD, b'{"model": "", "totals": {"files": 3}, "parts": [{"path": "chunks", "files": 1}]}')):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    found = E.verify(bad)
    assert any("unsafe" in x for x in found) and any("3" in x for x in found) and any("chunks" in x for x in found)
    with pytest.raises(ValueError):
        E.unpack(bad, tmp_path / "out")
    assert not (tmp_path / "x").exists()


@pytest.mark.parametrize("seed", range(3))
def test_cap_equals_the_walk_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{i:03d}", "x" * 200, rng.choice(["h1", "h2", "h3", "h4", "", None, f"u{i}", f"u{i}"]), f"f{rng.randrange(9)}", "video") for i in range(150)]
    seen, kept, want = set(), {}, {}
    for c, _, h, f, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        k = h or c
        if kept.get(f, 0) >= 6:
            want[c] = "over_file_cap"
        elif k in seen:
            want[c] = "duplicate"
        else:
            seen.add(k)
            kept[f] = kept.get(f, 0) + 1
            want[c] = None
    df = spark.createDataFrame(rows, "chunk_id string, text string, content_hash string, source_file string, source_type string")
    got = {r.chunk_id: r.skip for r in D.select_chunks(df, cap=6).collect()}
    # a file that stays within its cap may tell a copy from an overflow only where the cap is met
    assert {c for c, s in got.items() if s is None} == {c for c, s in want.items() if s is None}
