"""Extended-XYZ files as a data source: ``spark.read.format("extxyz").load(path)`` and ``df.write.format("extxyz").save(path)``.

One partition per file; a frame is parsed and handed on before the next is read, so a long
trajectory does not have to fit in memory. Writers put each task's frames into a file of its own under
a hidden folder, and commit moves them into place: a failed write leaves what was there.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, pos long, info map<string,string>, cell array<double>, pbc array<boolean>, atoms array<struct<idx:int,symbol:string,x:double,y:double,z:double,fx:double,fy:double,fz:double>>"
_FIELD = re.compile(r'([\w.-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))|([\w.-]+)')
#: Names of force columns, most specific first.
FORCES = ("REF_forces", "forces", "force")


def comment(line: str) -> dict[str, str]:
    """The key=value pairs of a frame's second line; a bare key is true."""
    out = {}
    for m in _FIELD.finditer(line):
        if m[4]:
            out[m[4]] = "T"
        else:
            out[m[1]] = (m[2].replace('\\"', '"') if m[2] is not None else m[3])
    return out


def frames(lines: Iterator[str], name: str) -> Iterator[tuple]:
    pos = 0
    for head in lines:
        if not head.strip():
            continue
        try:
            n = int(head)
        except ValueError:
            raise ValueError(f"{name}: frame {pos} does not begin with a number of atoms: {head[:60]!r}") from None
        info = comment(next(lines, ""))
        columns, at = {}, 0
        spec = info.pop("Properties", "species:S:1:pos:R:3").split(":")
        for key, kind, width in zip(spec[::3], spec[1::3], spec[2::3], strict=False):
            columns[key] = (at, kind, int(width))
            at += int(width)
        force = next((columns[f][0] for f in FORCES if f in columns and columns[f][2] == 3), None)
        s, p = columns.get("species", (0, "S", 1))[0], columns.get("pos", (1, "R", 3))[0]
        atoms = []
        for i in range(n):
            parts = next(lines, "").split()
            if len(parts) < at:
                raise ValueError(f"{name}: frame {pos}, atom {i} has {len(parts)} of {at} values")
            f = [float(x) for x in parts[force : force + 3]] if force is not None else [None] * 3
            atoms.append((i, parts[s], *(float(x) for x in parts[p : p + 3]), *f))
        lattice = info.pop("Lattice", None)
        flags = info.pop("pbc", None)
        cell = [float(x) for x in lattice.split()] if lattice else None
        pbc = [x in ("T", "True", "1") for x in flags.split()] if flags else ([True] * 3 if cell else [False] * 3)
        yield name, pos, info, cell, pbc, atoms
        pos += 1


def render(row) -> str:
    """One frame as text."""
    atoms = row["atoms"] or []
    with_forces = any(a["fx"] is not None for a in atoms)
    head = []
    if row["cell"]:
        head.append('Lattice="' + " ".join(repr(float(x)) for x in row["cell"]) + '"')
    head.append("Properties=species:S:1:pos:R:3" + (":REF_forces:R:3" if with_forces else ""))
    for k, v in sorted((row["info"] or {}).items()):
        if v is not None:
            head.append(f"{k}={v}" if re.fullmatch(r'[^\s"=]+', v) else '{}="{}"'.format(k, v.replace('"', '\\"')))
    head.append('pbc="' + " ".join("T" if x else "F" for x in row["pbc"] or [False] * 3) + '"')
    lines = [str(len(atoms)), " ".join(head)]
    for a in atoms:
        values = [a["x"], a["y"], a["z"], *([a["fx"] or 0.0, a["fy"] or 0.0, a["fz"] or 0.0] if with_forces else [])]
        lines.append(a["symbol"] + " " + " ".join(repr(float(v)) for v in values))
    return "\n".join(lines) + "\n"


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = _local(path)

    def partitions(self):
        if os.path.isdir(self.path):
            names = sorted(f for f in glob.glob(os.path.join(self.path, "**", "*.xyz"), recursive=True) if "/." not in f[len(self.path) :])
        else:
            names = sorted(glob.glob(self.path))
        if not names:
            raise FileNotFoundError(self.path)
        return [InputPartition(n) for n in names]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            yield from frames(iter(f), partition.value)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = _local(path), overwrite
        self.hidden = os.path.join(self.path, f".writing-{uuid.uuid4().hex}")

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.hidden, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.xyz"
        n = 0
        with open(os.path.join(self.hidden, name), "w", encoding="utf-8") as f:
            for row in rows:
                f.write(render(row))
                n += 1
        return _Written(name if n else None)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.xyz")):
                os.remove(old)
        for m in messages:
            if m is not None and m.name:
                os.replace(os.path.join(self.hidden, m.name), os.path.join(self.path, m.name))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.hidden, ignore_errors=True)


class ExtXyz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExtXyz)
