"""Fetch a dataset: download, unpack, checksum, count, and a record of where it came from."""

from __future__ import annotations

import hashlib
import json
import shutil
import urllib.request
import warnings
import zipfile
from datetime import UTC, datetime
from pathlib import Path

CHUNK = 1 << 20


def sha256_of(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as file:
        while part := file.read(CHUNK):
            digest.update(part)
    return digest.hexdigest()


def fetch(url: str, folder: str | Path, members: tuple[str, ...] = (), expected_rows: dict[str, int] | None = None, force: bool = False) -> dict:
    """Files of ``url`` in ``folder``: itself, or ``members`` of a zip archive (all of them if none are named).

    Files that are there stay, unless forced. Row counts that differ from the
    expected ones are a warning. The record, also written as
    ``provenance.json``, has each file's size, checksum and rows. It runs on
    the driver: what is fetched is put where the readers find it.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    name = url.rstrip("/").rsplit("/", 1)[-1]
    packed = name.endswith(".zip")
    wanted = list(members) if packed else [name]
    if force or not wanted or not all((folder / Path(m).name).exists() for m in wanted):
        part = folder / f".{name}.part"
        with urllib.request.urlopen(url) as source, part.open("wb") as out:  # noqa: S310  the caller's address
            shutil.copyfileobj(source, out, CHUNK)
        if packed:
            with zipfile.ZipFile(part) as archive:
                wanted = wanted or [m for m in archive.namelist() if not m.endswith("/")]
                for member in wanted:
                    with archive.open(member) as source, (folder / Path(member).name).open("wb") as out:
                        shutil.copyfileobj(source, out, CHUNK)
            part.unlink()
        else:
            part.replace(folder / name)
    files = {}
    for member in wanted:
        path = folder / Path(member).name
        rows = quoted_rows(path) if path.suffix == ".csv" else None
        hoped = (expected_rows or {}).get(path.name)
        if hoped is not None and rows != hoped:
            warnings.warn(f"{path.name} has {rows} rows, not {hoped}", stacklevel=2)
        files[path.name] = {"bytes": path.stat().st_size, "sha256": sha256_of(path), "rows": rows}
    record = {"url": url, "fetched_utc": datetime.now(UTC).isoformat(timespec="seconds"), "files": files}
    (folder / "provenance.json").write_text(json.dumps(record, indent=2))
    return record


def quoted_rows(path: Path) -> int:
    """Records of a CSV file without its header; line breaks within quotes don't count."""
    rows, within, filled = 0, False, False
    with path.open("rb") as file:
        for line in file:
            filled = filled or bool(line.strip())
            within ^= line.count(b'"') % 2 == 1
            if not within and filled:
                rows, filled = rows + 1, False
    return max(0, rows + (within or filled) - 1)
