"""Folders of files, local or of any store that pyarrow reaches by its address."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


class Folder:
    def __init__(self, path: str):
        u = urlparse(path)
        self.local = u.scheme in ("", "file")
        if self.local:
            self.path = (unquote(u.path) if u.scheme else path).rstrip("/")
        else:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(path.rstrip("/"))

    def _info(self, path: str):
        from pyarrow import fs

        return [i for i in self.store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.File]

    def names(self, ending: str) -> list[str]:
        """Names of the files with this ending, in order; hidden ones not."""
        if self.local:
            found = os.listdir(self.path) if os.path.isdir(self.path) else []
        else:
            found = [i.base_name for i in self._info(self.path)]
        return sorted(n for n in found if n.endswith(ending) and not n.startswith("."))

    def is_file(self) -> bool:
        if self.local:
            return os.path.isfile(self.path)
        from pyarrow import fs

        return self.store.get_file_info(self.path).type == fs.FileType.File

    def at(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def read(self, name: str):
        return open(self.at(name), "rb") if self.local else self.store.open_input_file(self.at(name))

    def write(self, name: str):
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            return open(self.at(name), "xb")
        self.store.create_dir(self.path, recursive=True)
        return self.store.open_output_stream(self.at(name))

    def close(self, stream) -> None:
        """Closes a written file; a local one is on the disk then."""
        if self.local:
            stream.flush()
            os.fsync(stream.fileno())
        stream.close()

    def rename(self, old: str, new: str) -> None:
        if self.local:
            if os.path.exists(self.at(new)):
                raise FileExistsError(f"{self.at(new)} is there already: is there another writer?")
            os.rename(self.at(old), self.at(new))
        else:
            self.store.move(self.at(old), self.at(new))

    def remove(self, name: str) -> None:
        if self.local:
            if os.path.exists(self.at(name)):
                os.remove(self.at(name))
        else:
            self.store.delete_file(self.at(name))
