"""Single files that appear whole or not at all, and tables of many."""

from __future__ import annotations

import json
import os
import sys
import tempfile
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame


def write_atomic(path: str | Path, data: bytes) -> None:
    """Through a private file in the same folder, renamed into place; folders are made for their owner alone."""
    path = Path(path)
    path.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=".tmp-", dir=path.parent)  # 0600
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value) -> None:
    """Indented, with a line break at the end."""
    write_atomic(path, (json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode())


def emit_json(value, path: str = "", out: TextIO | None = None) -> None:
    """To the file, or to the stream without one."""
    if path:
        write_json(path, value)
    else:
        print(json.dumps(value, indent=2, ensure_ascii=False), file=out or sys.stdout)


def write_documents(rows: DataFrame, folder: str, id_name: str, column: str) -> None:
    """rows(id, JSON text) as JSON lines partitioned by id: for tables of results; one document goes through write_json."""
    rows.select(id_name, column).write.mode("overwrite").partitionBy(id_name).text(folder)
