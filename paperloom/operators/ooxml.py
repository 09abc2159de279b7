"""Office packages: size-limited reading of their parts.

Parts are parsed into trees whose tags and attributes carry local names; attributes of the relationships namespace are
prefixed with ``rel:``.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from typing import NamedTuple
from xml.etree import ElementTree

from paperloom.operators.options import Limits, UnsafeDocumentError


class Relation(NamedTuple):
    target: str
    kind: str
    external: bool


def local(root: ElementTree.Element) -> ElementTree.Element:
    for node in root.iter():
        if not isinstance(node.tag, str):
            continue
        node.tag = node.tag.rpartition("}")[2]
        for key in [k for k in node.attrib if k[0] == "{"]:
            space, _, name = key[1:].partition("}")
            node.attrib[("rel:" if space.endswith("/relationships") else "") + name] = node.attrib.pop(key)
    return root


def switched_on(node) -> bool:
    """A toggle property: present and not turned off."""
    return node is not None and node.get("val", "true").lower() not in ("0", "false", "off", "none")


class Package:
    def __init__(self, data: bytes, limits: Limits):
        self.limits, self.read_bytes = limits, 0
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError("not an Office package") from e
        self.parts = {i.filename: i for i in self.zip.infolist()}
        for i in self.parts.values():
            if i.file_size > limits.part_bytes:
                raise UnsafeDocumentError(f"part {i.filename} declares {i.file_size} bytes; the limit is {limits.part_bytes}")
            if i.file_size > limits.ratio_bytes and i.compress_size and i.file_size > limits.ratio * i.compress_size:
                raise UnsafeDocumentError(f"part {i.filename} inflates more than {limits.ratio} times")
        if sum(i.file_size for i in self.parts.values()) > limits.package_bytes:
            raise UnsafeDocumentError(f"the package declares more than {limits.package_bytes} bytes")

    def read(self, name: str) -> bytes:
        out = bytearray()
        with self.zip.open(name) as f:
            while chunk := f.read(1 << 16):
                out += chunk
                self.read_bytes += len(chunk)
                if len(out) > self.limits.part_bytes or self.read_bytes > self.limits.package_bytes:
                    raise UnsafeDocumentError(f"part {name} inflates past the limit")
        return bytes(out)

    def xml(self, name: str | None) -> ElementTree.Element | None:
        if name not in self.parts:
            return None
        data = self.read(name)
        low = data.lower()
        if b"<!doctype" in low[:4096] or b"<!entity" in low:
            raise UnsafeDocumentError(f"part {name} declares a document type or entities")
        try:
            return local(ElementTree.fromstring(data))
        except ElementTree.ParseError as e:
            raise ValueError(f"part {name} is not well-formed: {e}") from e

    def relations(self, part: str) -> dict[str, Relation]:
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", f"{name}.rels"))
        out = {}
        for r in root.findall("Relationship") if root is not None else ():
            target, external = r.get("Target", ""), r.get("TargetMode") == "External"
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = Relation(target, r.get("Type", "").rpartition("/")[2], external)
        return out

    def related(self, relations: dict[str, Relation], kind: str) -> str | None:
        """The target of the first internal relation of a kind (the last part of its type)."""
        return next((r.target for r in relations.values() if r.kind == kind and not r.external), None)

    def main(self, otherwise: str) -> str:
        return self.related(self.relations(""), "officeDocument") or otherwise
