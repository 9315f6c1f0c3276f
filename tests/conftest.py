from __future__ import annotations

import datetime as dt
import json
import os
import sys
import zipfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from aprlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "4")), "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def day():
    return dt.date.fromisoformat


def write_archive(path: Path, members: dict[str, list]) -> None:
    """A zip whose members hold one line per item: text as it is, other values as JSON."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, items in members.items():
            lines = [i if isinstance(i, str) else json.dumps(i) for i in items]
            archive.writestr(name, "" if name.endswith("/") else "\n".join(lines))


def rows_of(df, *columns):
    """Rows as tuples, of the named columns."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
