"""A folder of any store that Arrow's file systems reach, seen from a task."""

from __future__ import annotations

from pyarrow import fs


class Files:
    """Names are relative to the folder. Paths are local ones or URIs (file:, hdfs:, s3: and so on)."""

    def __init__(self, root: str):
        if "://" in root or root.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = fs.LocalFileSystem(), root
        self.root = self.root.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return [f.base_name for f in found if f.is_file]

    def open(self, name: str):
        return self.fs.open_input_file(self._at(name))

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self._at(name))

    def write(self, name: str, data: bytes) -> None:
        """Under a passing name first, so that readers see the whole file or none."""
        with self.create(f".{name}.new") as f:
            f.write(data)
        self.fs.move(self._at(f".{name}.new"), self._at(name))

    def delete(self, name: str) -> None:
        if self.fs.get_file_info(self._at(name)).type != fs.FileType.NotFound:
            self.fs.delete_file(self._at(name))
