"""Names of columns: captions as people write them, and physical names."""

from __future__ import annotations

import re

from plinth.plans.findings import Refused


def to_phys(caption: str) -> str:
    """Fixed rule, which names elsewhere follow too: runs of other signs than letters and digits become "_", without those at the ends, in capitals."""
    return re.sub(r"[^A-Za-z0-9]+", "_", caption).strip("_").upper() or "COL"


def canonical(name: str) -> str:
    """What two spellings of a name share: its letters and digits, in small letters."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(caption: str, columns: list[str], renames: dict[str, str] | None = None) -> str:
    """The column that a caption means: by a rename, else by its physical or canonical name."""
    wanted = (renames or {}).get(caption, to_phys(caption))
    if wanted in columns:
        return wanted
    found = [c for c in columns if canonical(c) == canonical(caption)]
    if len(found) != 1:
        raise Refused("measure-unresolved", f"{caption!r} fits {found or 'no column'}")
    return found[0]


def align(wanted: list[str], columns: list[str]) -> dict[str, str]:
    """Each wanted name to the one column with its canonical name; missing or ambiguous names are refused."""
    return {name: resolve(name, columns) for name in wanted}
