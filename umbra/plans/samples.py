"""Office files made from segments, for queries and tests that need some."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from html import escape

from ..sources.ooxml import Segment

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_W, _A, _P, _R, _S = ("http://schemas.openxmlformats.org/" + x for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships", "spreadsheetml/2006/main"))
_PR, _CT = ("http://schemas.openxmlformats.org/package/2006/" + x for x in ("relationships", "content-types"))


def _relations(*targets: tuple[str, str]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{_R}/{kind}" Target="{part}"/>' for i, (kind, part) in enumerate(targets, 1))
    return f'{_XML}<Relationships xmlns="{_PR}">{rows}</Relationships>'


def build(extension: str, rows: Iterable[Segment], media: dict[str, bytes] | None = None) -> bytes:
    """A plain file that holds the segments (and images by name): paragraphs of a body, cells of a sheet's first column, shapes of a slide."""
    rows, q = list(rows), lambda x: escape(x, quote=True)
    if extension == ".docx":
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{q(s.text)}</w:t></w:r></w:p>' for s in rows)
        main, kind = "word/document.xml", "wordprocessingml.document"
        parts = {main: f'{_XML}<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>{body}<w:sectPr/></w:body></w:document>'}
    elif extension == ".pptx":
        main, kind = "ppt/presentation.xml", "presentationml.presentation"
        numbers = list(dict.fromkeys(s.container for s in rows))
        parts, ids = {}, "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(numbers) + 1))
        parts[main] = f'{_XML}<p:presentation xmlns:p="{_P}" xmlns:r="{_R}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
        parts["ppt/_rels/presentation.xml.rels"] = _relations(*(("slide", f"slides/slide{i}.xml") for i in range(1, len(numbers) + 1)))
        for i, n in enumerate(numbers, 1):
            shapes = "".join(f"<p:sp><p:txBody><a:bodyPr/><a:p><a:r><a:t>{q(s.text)}</a:t></a:r></a:p></p:txBody></p:sp>" for s in rows if s.container == n)
            parts[f"ppt/slides/slide{i}.xml"] = f'{_XML}<p:sld xmlns:p="{_P}" xmlns:a="{_A}" xmlns:r="{_R}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
    elif extension == ".xlsx":
        main, kind = "xl/workbook.xml", "spreadsheetml.sheet"
        names = list(dict.fromkeys(s.container for s in rows))
        sheets = "".join(f'<sheet name="{q(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        parts = {main: f'{_XML}<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>{sheets}</sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)))}
        for i, n in enumerate(names, 1):
            cells = []
            for r, s in enumerate((s for s in rows if s.container == n), 1):
                value = f'<c r="A{r}" t="inlineStr"><is><t xml:space="preserve">{q(s.text)}</t></is></c>' if s.cell_type == "s" else f'<c r="A{r}"><f>{q(s.text.lstrip("="))}</f></c>' if s.cell_type == "f" else f'<c r="A{r}"><v>{q(s.text)}</v></c>'
                cells.append(f'<row r="{r}">{value}</row>')
            parts[f"xl/worksheets/sheet{i}.xml"] = f'{_XML}<worksheet xmlns="{_S}"><sheetData>{"".join(cells)}</sheetData></worksheet>'
    else:
        raise ValueError(f"unsupported file type {extension}")
    kinds = f'<Override PartName="/{main}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/>'
    out, stamp = io.BytesIO(), (1980, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("[Content_Types].xml", stamp), f'{_XML}<Types xmlns="{_CT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        z.writestr(zipfile.ZipInfo("_rels/.rels", stamp), _relations(("officeDocument", main)))
        for name, body in {**parts, **(media or {})}.items():
            z.writestr(zipfile.ZipInfo(name, stamp), body)
    return out.getvalue()
