"""Archives of an index: what belongs into one, packing with a record, and checking.

An archive holds only the parts that are listed, each whole, and a record of what they are.
Packing and checking work on one archive's files and so on one machine; what they compare is
also there as tables (manifest.inventory, manifest.verify)."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

#: Parts of an index in the order they are packed, and whether it is none without them.
PARTS = (("manifest", True), ("chunks", True), ("vectors", True), ("graph", False), ("extracted", False), ("ontology.yaml", False))
RECORD = "EXPORT.json"


def files_of(path: Path) -> Iterator[Path]:
    yield from [path] if path.is_file() else sorted(p for p in path.rglob("*") if p.is_file())


def inventory(root: Path, parts=PARTS) -> list[dict]:
    """One entry for every part: path, whether it is required and there, files and bytes."""
    out = []
    for name, required in parts:
        own = list(files_of(root / name)) if (root / name).exists() else []
        out.append({"path": name, "required": required, "present": (root / name).exists(), "files": len(own), "bytes": sum(p.stat().st_size for p in own)})
    return out


def missing(parts: list[dict]) -> list[str]:
    return [p["path"] for p in parts if p["required"] and not p["present"]]


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pack(root: Path, archive: Path, model: str = "", counts: dict | None = None, parts=PARTS) -> dict:
    """Write an archive, its record as the last member and a checksum beside it; the record
    comes back. A required part that is not there, or a link out of the root, raises."""
    found = inventory(root, parts)
    if lost := missing(found):
        raise FileNotFoundError(f"required parts are missing: {', '.join(lost)}")
    record = {"format": 1, "model": model, "counts": counts or {}, "parts": found, "totals": {"files": sum(p["files"] for p in found), "bytes": sum(p["bytes"] for p in found)}}
    base = root.resolve()
    with tarfile.open(archive, "w:gz") as tar:
        for part in found:
            for file in files_of(root / part["path"]) if part["present"] else ():
                if base not in file.resolve().parents:
                    raise ValueError(f"{file} lies outside {root}")
                tar.add(file, arcname=file.relative_to(root).as_posix())
        body = json.dumps(record, ensure_ascii=False).encode()
        info = tarfile.TarInfo(RECORD)
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    archive.with_name(archive.name + ".sha256").write_text(f"{digest(archive)}  {archive.name}\n")
    return record


def contained(name: str) -> bool:
    """Whether a member stays inside the folder it is unpacked into."""
    return not name.startswith("/") and ".." not in PurePosixPath(name).parts


def read_record(archive: Path) -> dict:
    with tarfile.open(archive) as tar:
        if RECORD not in tar.getnames():
            raise ValueError(f"{archive.name} has no {RECORD}")
        return json.load(tar.extractfile(RECORD))


def verify(archive: Path, model: str = "") -> list[str]:
    """What is wrong with an archive, nothing if it is whole."""
    record, problems = read_record(archive), []
    beside = archive.with_name(archive.name + ".sha256")
    if not beside.exists():
        problems.append("no checksum beside the archive")
    elif beside.read_text().split()[:1] != [digest(archive)]:
        problems.append("checksum differs")
    with tarfile.open(archive) as tar:
        members = [m for m in tar.getmembers() if not m.isdir()]
    names = {m.name for m in members}
    problems += [f"unsafe member {m.name}" for m in members if not contained(m.name) or not m.isfile()]
    if record["totals"]["files"] != len(names - {RECORD}):
        problems.append(f"{len(names - {RECORD})} files, the record says {record['totals']['files']}")
    problems += [f"part {p['path']} is not there" for p in record["parts"] if p["files"] and not any(n == p["path"] or n.startswith(p["path"] + "/") for n in names)]
    if model and record["model"] and record["model"] != model:
        problems.append(f"vectors are of {record['model']}, not of {model}")
    return problems


def unpack(archive: Path, folder: Path) -> int:
    """Files unpacked; nothing is written if any member is unsafe."""
    with tarfile.open(archive) as tar:
        members = tar.getmembers()
        if bad := [m.name for m in members if not contained(m.name) or not (m.isfile() or m.isdir())]:
            raise ValueError(f"unsafe members: {bad[:3]}")
        tar.extractall(folder, members, filter="data")
    return sum(m.isfile() for m in members)
