"""A journal of answers: one file for each request, so that a task that dies and starts anew asks for nothing twice."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from hashlib import sha256

from pyarrow import fs

#: Status, content type, body and error of a request.
Entry = tuple[int | None, str | None, bytes | None, str | None]


@dataclass(frozen=True)
class Journal:
    """Answers below ``folder``, a path or URI that all executors share (file, hdfs, s3, gs)."""

    folder: str

    def _place(self, key: str) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.folder)
        name = sha256(key.encode()).hexdigest()
        return files, f"{root}/{name[:2]}/{name}"

    def read(self, key: str) -> Entry | None:
        files, path = self._place(key)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as source:
            head, _, body = source.read().partition(b"\n")
        said = json.loads(head)
        return said["status"], said["content_type"], body if said["body"] else None, said["error"]

    def write(self, key: str, entry: Entry) -> None:
        """The file appears whole or not at all: it is written beside its place and renamed."""
        files, path = self._place(key)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        status, kind, body, error = entry
        beside = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(beside) as sink:
            sink.write(json.dumps({"key": key, "status": status, "content_type": kind, "body": body is not None, "error": error}).encode() + b"\n" + (body or b""))
        files.move(beside, path)
