"""A run's lease: one holder at a time, which a crash doesn't keep for ever.

Holders are numbered by epochs. The file epochs/<n> is made by whoever takes epoch n, and can be made once; beside it, until/<n> says up to when the lease is held, and the holder writes it again
in time. Who finds the latest epoch run out (or given back) takes the next one. Before a write a holder checks that its epoch is still the latest: a holder that was taken for dead is refused then,
however late it wakes up. Clocks need to agree to much less than the length of a lease."""

from __future__ import annotations

import json
import os
import time

from .tables import _bytes, put, store


class LeaseLost(RuntimeError):
    pass


class Lease:
    def __init__(self, path: str, epoch: int, seconds: float) -> None:
        self.path, self.epoch, self.seconds = path, epoch, seconds

    @classmethod
    def take(cls, path: str, seconds: float = 60.0) -> Lease:
        """The lease of path, or LeaseLost if it is held."""
        latest = _latest(path)
        if latest and (until := _until(path, latest)) > time.time():
            raise LeaseLost(f"{path} is held for another {until - time.time():.0f} s")
        if not _create(path, latest + 1):
            raise LeaseLost(f"{path} was taken by another one just now")
        lease = cls(path, latest + 1, seconds)
        lease.renew()
        return lease

    def renew(self) -> None:
        """Holds it for its length from now on; LeaseLost if it has passed on."""
        self.check()
        system, root = store(self.path)
        put(system, f"{root}/until/{self.epoch}", repr(time.time() + self.seconds).encode())

    def check(self) -> None:
        """To be called before each write."""
        if (latest := _latest(self.path)) != self.epoch:
            raise LeaseLost(f"epoch {self.epoch} of {self.path} has passed on to {latest}")

    def release(self) -> None:
        system, root = store(self.path)
        put(system, f"{root}/until/{self.epoch}", b"0")

    def token(self) -> str:
        return json.dumps([self.path, self.epoch, self.seconds])

    @classmethod
    def from_token(cls, token: str) -> Lease:
        return cls(*json.loads(token))

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _latest(path: str) -> int:
    from pyarrow import fs

    system, root = store(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/epochs", allow_not_found=True))
    return max((int(i.base_name) for i in found if i.base_name.isdigit()), default=0)


def _until(path: str, epoch: int) -> float:
    """When the epoch runs out; an epoch whose holder has not said so yet counts from its making."""
    system, root = store(path)
    said = _bytes(system, f"{root}/until/{epoch}")
    if said is not None:
        return float(said)
    made = system.get_file_info(f"{root}/epochs/{epoch}").mtime
    return made.timestamp() + 60.0 if made else 0.0


def _create(path: str, epoch: int) -> bool:
    """Makes the epoch's file unless it is there, in one step: by exclusive creation on a local file system, by a rename that replaces nothing on HDFS. Stores that have neither can't hold leases."""
    from pyarrow import fs

    system, root = store(path)
    system.create_dir(f"{root}/epochs", recursive=True)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.close(os.open(f"{root}/epochs/{epoch}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        elif isinstance(system, fs.HadoopFileSystem):
            put(system, f"{root}/epochs/{epoch}", b"")
        else:
            raise ValueError(f"{path}: no lease without exclusive creation or renaming")
    except OSError:
        return False
    return True
