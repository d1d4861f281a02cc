"""Office files as segments of text and back, by the standard library's zip and XML parts."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from xml.dom import minidom

MEDIA = {".docx": "word/media/", ".pptx": "ppt/media/", ".xlsx": "xl/media/"}
#: The rewriting of one segment: its new text, whether that differs, and whether it is to be grey.
Rewrite = Callable[[str], tuple[str, bool, bool]]


class Segment(NamedTuple):
    """container: body, table, header, footer, a sheet's name, or a slide's number; cell_type: s for text, else what the cell holds."""

    container: str
    cell_type: str
    text: str


class Package:
    """The parts of a zip file; changed ones are written back in their old order."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names, self.trees = set(self.zip.namelist()), {}

    def tree(self, name: str):
        if name not in self.trees:
            self.trees[name] = minidom.parseString(self.zip.read(name))
        return self.trees[name]

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id to (kind, part) of a part."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.tree(rels).documentElement.childNodes:
            if r.nodeType == r.ELEMENT_NODE and r.getAttribute("TargetMode") != "External":
                target = r.getAttribute("Target")
                part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.getAttribute("Id")] = (r.getAttribute("Type").rsplit("/", 1)[-1], part)
        return out

    def save(self, changed: Iterable[str], members: dict[str, bytes] | None = None) -> bytes:
        out, new = io.BytesIO(), {n: self.trees[n].toxml(encoding="UTF-8") for n in changed} | (members or {})
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.zip.infolist():
                z.writestr(item, new.get(item.filename) if item.filename in new else self.zip.read(item.filename))
        return out.getvalue()


def _kids(node, *names: str) -> list:
    return [n for n in node.childNodes if n.nodeType == n.ELEMENT_NODE and n.localName in names]


def _first(node, *path: str):
    for name in path:
        found = _kids(node, name) if node is not None else []
        node = found[0] if found else None
    return node


def _attribute(node, name: str) -> str:
    """An attribute by its local name, whatever its prefix."""
    return next((a.value for a in node.attributes.values() if (a.localName or a.name) == name), "") if node is not None else ""


def _text(node) -> str:
    return "".join(n.data for n in node.childNodes if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE))


# DOCX


def _run_text(run) -> str:
    out = []
    for n in _kids(run, "t", "tab", "br", "cr", "noBreakHyphen"):
        out.append({"t": _text(n) if n.localName == "t" else "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}[n.localName])
    return "".join(out)


def _paragraph_text(p) -> str:
    return "".join(_run_text(r) for n in _kids(p, "r", "hyperlink") for r in ([n] if n.localName == "r" else _kids(n, "r")))


def _cells(table) -> Iterator:
    """Cells row by row; one that spans columns or rows comes once for each place it covers."""
    above: list = []
    for row in _kids(table, "tr"):
        line: list = []
        for tc in _kids(row, "tc"):
            span, merge = _first(tc, "tcPr", "gridSpan"), _first(tc, "tcPr", "vMerge")
            goes_on = merge is not None and _attribute(merge, "val") != "restart"
            cell = above[len(line)] if goes_on and len(line) < len(above) else tc
            line += [cell] * max(1, int(_attribute(span, "val") or 1))
        yield from line
        above = line


def _docx(package: Package) -> Iterator[tuple[str, str, object]]:
    """(part, container, paragraph): the body's own paragraphs, then its tables' cells, then each section's header and footer."""
    main = next((part for kind, part in package.relations("").values() if kind == "officeDocument"), "word/document.xml") if "_rels/.rels" in package.names else "word/document.xml"
    body = _first(package.tree(main).documentElement, "body")
    yield from ((main, "body", p) for p in _kids(body, "p"))
    for t in _kids(body, "tbl"):
        yield from ((main, "table", p) for c in _cells(t) for p in _kids(c, "p"))
    relations, now = package.relations(main), {}
    sections = [s for p in _kids(body, "p") if (s := _first(p, "pPr", "sectPr")) is not None] + _kids(body, "sectPr")
    for s in sections:
        for kind in ("header", "footer"):
            for ref in _kids(s, f"{kind}Reference"):
                if _attribute(ref, "type") in ("default", "") and _attribute(ref, "id") in relations:
                    now[kind] = relations[_attribute(ref, "id")][1]
            if kind in now:  # a section without its own goes on with the one before
                yield from ((now[kind], kind, p) for p in _kids(package.tree(now[kind]).documentElement, "p"))


# PPTX


def _frames(shapes) -> Iterator:
    """The text bodies of shapes, of those in groups, and of table cells."""
    for n in _kids(shapes, "sp", "grpSp", "graphicFrame"):
        if n.localName == "grpSp":
            yield from _frames(n)
        elif n.localName == "sp":
            yield from _kids(n, "txBody")
        else:
            table = _first(n, "graphic", "graphicData", "tbl")
            if table is not None:
                yield from (b for r in _kids(table, "tr") for c in _kids(r, "tc") for b in _kids(c, "txBody"))


def _slide_text(p) -> str:
    return "".join(_text(t) for r in _kids(p, "r") for t in _kids(r, "t"))


def _pptx(package: Package) -> Iterator[tuple[str, str, object]]:
    """(part, slide number, paragraph): shapes in order, then the notes of each slide."""
    show = "ppt/presentation.xml"
    relations = package.relations(show)
    for number, ref in enumerate(_kids(_first(package.tree(show).documentElement, "sldIdLst") or minidom.Document(), "sldId"), 1):
        rid = next((a.value for a in ref.attributes.values() if a.prefix and a.localName == "id"), "")
        part = relations[rid][1]
        for frame in _frames(_first(package.tree(part).documentElement, "cSld", "spTree")):
            yield from ((part, str(number), p) for p in _kids(frame, "p"))
        for kind, notes in package.relations(part).values():
            if kind == "notesSlide":
                for shape in _kids(_first(package.tree(notes).documentElement, "cSld", "spTree"), "sp"):
                    if _attribute(_first(shape, "nvSpPr", "nvPr", "ph"), "type") == "body":
                        yield from ((notes, str(number), p) for b in _kids(shape, "txBody")[:1] for p in _kids(b, "p"))
                        break


# XLSX


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", reference).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return int(digits), column


def _rich(node) -> str:
    return "".join(_text(t) for n in _kids(node, "t", "r") for t in ([n] if n.localName == "t" else _kids(n, "t")))


def _xlsx(package: Package) -> Iterator[tuple[str, str, object, str, str]]:
    """(part, sheet, cell, cell type, text) by sheet, row and column. A formula's type is f, whatever it yields."""
    book = "xl/workbook.xml"
    relations = package.relations(book)
    shared = next((part for kind, part in relations.values() if kind == "sharedStrings"), None)
    strings = [_rich(s) for s in _kids(package.tree(shared).documentElement, "si")] if shared else []
    for sheet in _kids(_first(package.tree(book).documentElement, "sheets"), "sheet"):
        kind, part = relations[next(a.value for a in sheet.attributes.values() if a.prefix and a.localName == "id")]
        if kind != "worksheet":
            continue
        cells, at = [], (0, 0)
        for row in _kids(_first(package.tree(part).documentElement, "sheetData"), "row"):
            at = (int(_attribute(row, "r") or at[0] + 1), 0)
            for c in _kids(row, "c"):
                at = _place(_attribute(c, "r")) if _attribute(c, "r") else (at[0], at[1] + 1)
                cells.append((at, c))
        for _, c in sorted(cells, key=lambda x: x[0]):
            kind, v = _attribute(c, "t") or "n", _first(c, "v")
            value = _text(v) if v is not None else ""
            if _first(c, "f") is not None:
                kind, value = "f", "=" + _text(_first(c, "f"))
            elif kind == "inlineStr":
                kind, value = "s", _rich(_first(c, "is")) if _first(c, "is") is not None else ""
            elif kind == "s":
                value = strings[int(value)] if value else ""
            elif kind == "str":
                kind = "s"
            yield part, _attribute(sheet, "name"), c, kind, value


def segments(data: bytes, extension: str) -> Iterator[Segment]:
    """The pieces of text of a file in the order in which they make its text; blank ones are left out.

    DOCX: body paragraphs, table cells, headers and footers. XLSX: cells by sheet, row and column. PPTX: paragraphs of shapes, of shapes
    in groups, of tables and notes. Any other extension raises ValueError.
    """
    package = Package(data) if extension in MEDIA else None
    if extension == ".docx":
        found = ((where, "s", _paragraph_text(p)) for _, where, p in _docx(package))
    elif extension == ".pptx":
        found = ((where, "s", _slide_text(p)) for _, where, p in _pptx(package))
    elif extension == ".xlsx":
        found = ((sheet, kind, value) for _, sheet, _, kind, value in _xlsx(package))
    else:
        raise ValueError(f"unsupported file type {extension}")
    yield from (Segment(*x) for x in found if x[2].strip())


def _child(node, name: str, first: bool = True):
    """The child of a name in the node's own namespace, made if there is none."""
    local = name.rsplit(":", 1)[-1]
    found = _kids(node, local)
    if found:
        return found[0]
    prefix = node.tagName.rpartition(":")[0]
    made = node.ownerDocument.createElementNS(node.namespaceURI, f"{prefix}:{local}" if prefix else local)
    return node.insertBefore(made, node.firstChild) if first else node.appendChild(made)


def _set(node, **attributes: str) -> None:
    prefix = node.tagName.rpartition(":")[0]
    for k, v in attributes.items():
        node.setAttribute(f"{prefix}:{k}" if prefix == "w" else k, v)


def _write_run(run, text: str) -> None:
    """text as the only content of a run, its properties kept."""
    for n in [n for n in _kids(run, "t", "tab", "br", "cr", "noBreakHyphen")]:
        run.removeChild(n)
    t = run.ownerDocument.createElementNS(run.namespaceURI, f"{run.tagName.rpartition(':')[0]}:t".lstrip(":"))
    if run.tagName.startswith("w:"):
        t.setAttribute("xml:space", "preserve")
    t.appendChild(run.ownerDocument.createTextNode(text))
    run.appendChild(t)


def _grey_run(run) -> None:
    if run.tagName.startswith("a:"):
        fill = _child(_child(run, "a:rPr"), "a:solidFill")
        for n in list(fill.childNodes):
            fill.removeChild(n)
        _child(fill, "a:srgbClr").setAttribute("val", "808080")
    else:
        _set(_child(_child(run, "w:rPr"), "w:highlight", first=False), val="lightGray")


def rewrite(data: bytes, extension: str, change: Rewrite) -> bytes:
    """The file with each segment's text changed. The runs of a changed paragraph become its first one; formulas are never changed."""
    package, parts = Package(data), set()
    if extension == ".xlsx":
        grey = _Greys(package)
        for part, _, cell, kind, value in _xlsx(package):
            if kind == "s" and value:
                text, differs, is_grey = change(value)
                if differs:
                    for n in list(cell.childNodes):
                        cell.removeChild(n)
                    cell.setAttribute("t", "inlineStr")
                    t = _child(_child(cell, "is"), "t")
                    t.setAttribute("xml:space", "preserve")
                    t.appendChild(cell.ownerDocument.createTextNode(text))
                    if is_grey:
                        cell.setAttribute("s", grey.like(cell.getAttribute("s") or "0"))
                        parts.add(grey.part)
                    parts.add(part)
        return package.save(parts)
    if extension not in MEDIA:
        raise ValueError(f"unsupported file type {extension}")
    done = set()
    for part, _, p in _docx(package) if extension == ".docx" else _pptx(package):
        runs = _kids(p, "r")
        if id(p) in done or not runs:  # a cell that spans several places, a header of several sections
            continue
        done.add(id(p))
        read = _run_text if extension == ".docx" else lambda r: "".join(_text(t) for t in _kids(r, "t"))
        text = "".join(map(read, runs))
        if text.strip():
            text, differs, is_grey = change(text)
            if differs:
                _write_run(runs[0], text)
                for r in runs[1:]:
                    _write_run(r, "")
                if is_grey:
                    _grey_run(runs[0])
                parts.add(part)
    return package.save(parts)


class _Greys:
    """Styles of a workbook with a grey fill, made as they are asked for."""

    def __init__(self, package: Package):
        self.package, self.made, self.fill = package, {}, None
        self.part = next((part for kind, part in package.relations("xl/workbook.xml").values() if kind == "styles"), None)

    def like(self, style: str) -> str:
        if self.part is None:
            return style
        root = self.package.tree(self.part).documentElement
        formats, fills = _first(root, "cellXfs"), _first(root, "fills")
        if style not in self.made and formats is not None and fills is not None:
            if self.fill is None:
                self.fill = str(len(_kids(fills, "fill")))
                pattern = _child(fills.appendChild(fills.ownerDocument.createElementNS(fills.namespaceURI, "fill")), "patternFill")
                pattern.setAttribute("patternType", "solid")
                _child(pattern, "fgColor").setAttribute("rgb", "FFB0B0B0")
                fills.setAttribute("count", str(int(self.fill) + 1))
            have = _kids(formats, "xf")
            copy = formats.appendChild(have[min(int(style), len(have) - 1)].cloneNode(True))
            copy.setAttribute("fillId", self.fill)
            copy.setAttribute("applyFill", "1")
            self.made[style] = str(len(have))
            formats.setAttribute("count", str(len(have) + 1))
        return self.made.get(style, style)


# Images


def images(data: bytes, extension: str) -> list[tuple[str, bytes]]:
    """(id, content) of the embedded images by name."""
    if extension not in MEDIA:
        raise ValueError(f"unsupported file type for images {extension}")
    z = zipfile.ZipFile(io.BytesIO(data))
    return [(n, z.read(n)) for n in sorted(z.namelist()) if n.startswith(MEDIA[extension]) and not n.endswith("/")]


def image_format(name: str) -> str:
    return "JPEG" if name.rsplit(".", 1)[-1].lower() in ("jpg", "jpeg") else "PNG"


def replace_images(data: bytes, ids: Iterable[str], replacement: bytes | None = None) -> tuple[bytes, int]:
    """The file with its images `ids` blanked, or replaced where a replacement is given, and how many there were."""
    package = Package(data)
    new = {n: prepared(replacement, image_format(n)) if replacement is not None else blank(image_format(n)) for n in set(ids) & package.names}
    return package.save((), new), len(new)


def blank(kind: str, size: int = 300, grey: int = 211) -> bytes:
    """A plain grey square."""
    if kind == "PNG":
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        rows = (b"\0" + bytes([grey]) * (3 * size)) * size
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    # JPEG of one component, in blocks of 8 x 8: the first one's mean (in quanta of 8, so grey - 128), then no difference. Two codes
    # for means (0: no difference, 10: one of `width` bits), one for the rest of a block (0: nothing).
    level = grey - 128
    width, blocks = abs(level).bit_length(), (-(-size // 8)) ** 2
    bits = "10" + format(level if level > 0 else level + (1 << width) - 1, f"0{width}b") + "0" + "00" * (blocks - 1)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    table = lambda where, counts, symbols: bytes([where, *counts, *[0] * (16 - len(counts)), *symbols])
    return (
        b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + b"\x08" * 64) + part(0xC0, struct.pack(">BHHB", 8, size, size, 1) + b"\1\x11\0")
        + part(0xC4, table(0, [1, 1], [0, width])) + part(0xC4, table(0x10, [1], [0])) + part(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    )


def prepared(image: bytes, kind: str) -> bytes:
    """An image in the format of the slot it goes to. One that already has it needs no imaging library."""
    if image.startswith(b"\x89PNG" if kind == "PNG" else b"\xff\xd8"):
        return image
    try:
        from PIL import Image
    except ModuleNotFoundError as e:
        raise ValueError(f"the replacement is not {kind}, and the imaging library that converts it is not installed") from e
    picture = Image.open(io.BytesIO(image)).convert("RGBA")
    if kind == "JPEG":
        ground = Image.new("RGB", picture.size, (255, 255, 255))
        ground.paste(picture, mask=picture.getchannel("A"))
        picture = ground
    out = io.BytesIO()
    picture.save(out, format=kind)
    return out.getvalue()
