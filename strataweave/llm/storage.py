"""Files in the shared folder, opened from Python workers by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_output(uri: str):
    """A binary stream to a new file; folders on the way are made."""
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def fresh_folder(shared: str, name: str) -> str:
    return f"{shared}/{name}-{uuid.uuid4().hex[:12]}"


def attempt_name(folder: str, part: int, suffix: str) -> str:
    """Another name for each attempt: a retried task never touches the files of the one it replaces."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}{suffix}"
