"""Files that tasks write to and read from shared storage.

A task may run twice, so each attempt writes under a name of its own and reports
that name in its output rows. Spark commits the rows of one attempt only; readers
open what the committed rows name and never list the folder.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def open_write(uri: str):
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def open_read(uri: str):
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def attempt_name(folder: str, part: int, ending: str) -> str:
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{ending}"
