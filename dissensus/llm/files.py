"""Files that tasks write below the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file; a task that runs twice leaves one whole file."""
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(root, recursive=True)
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{root}/{name}")
