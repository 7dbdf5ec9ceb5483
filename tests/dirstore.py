"""A store client over a directory, for tests."""

import os


class DirStore:
    def __init__(self, root):
        self.root = root

    def _read(self, name):
        path = os.path.join(self.root, name)
        return open(path, "rb").read() if os.path.exists(path) else None

    def bitmap(self, epoch):
        return self._read(f"{epoch}-bitmap")

    def block(self, epoch, block_id):
        return self._read(f"{epoch}-{block_id}")

    def latest(self):
        return int.from_bytes(self._read("EpochCount") or b"", "big") or -1


def connect(options):
    return DirStore(options.get("store_root") or options["root"])
