"""The few file operations that data sources need beside Spark's own readers."""

from __future__ import annotations

import os


class Folder:
    """A folder of files; a file: path is opened directly, others through Arrow's file systems."""

    def __init__(self, path: str):
        self.fs = None
        if path.startswith("file:") or "://" not in path:
            self.base = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.base = FileSystem.from_uri(path)

    def open(self, name: str, mode: str):
        if self.fs is None:
            if mode == "wb":
                os.makedirs(self.base, exist_ok=True)
            return open(f"{self.base}/{name}", mode)
        if mode == "rb":
            return self.fs.open_input_file(f"{self.base}/{name}")
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def names(self) -> list[str]:
        if self.fs is None:
            return sorted(os.listdir(self.base))
        from pyarrow.fs import FileSelector

        return sorted(x.base_name for x in self.fs.get_file_info(FileSelector(self.base)))

    def rename(self, old: str, new: str) -> None:
        if self.fs is None:
            os.replace(f"{self.base}/{old}", f"{self.base}/{new}")
        else:
            self.fs.move(f"{self.base}/{old}", f"{self.base}/{new}")

    def delete(self, name: str) -> None:
        if self.fs is None:
            os.remove(f"{self.base}/{name}")
        else:
            self.fs.delete_file(f"{self.base}/{name}")
