"""Small office files, PDF files and pictures, made with the standard library."""

import io
import struct
import zipfile
import zlib

XML = '<?xml version="1.0" encoding="UTF-8"?>'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(items):
    rows = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in items)
    return f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def workbook(sheets, formats=(), shared=(), is_1904=False):
    """sheets: name to XML rows."""
    names = list(sheets)
    parts = {
        "_rels/.rels": relations([("r1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'{XML}<workbook xmlns:r="{OFFICE}"><workbookPr date1904="{int(is_1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": relations([(f"s{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(len(names))] + [("st", "styles", "styles.xml"), ("sh", "sharedStrings", "sharedStrings.xml")]),
        "xl/styles.xml": f"{XML}<styleSheet><numFmts>" + "".join(f'<numFmt numFmtId="{200 + i}" formatCode="{f}"/>' for i, f in enumerate(formats)) + '</numFmts><cellXfs><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + i}"/>' for i in range(len(formats))) + "</cellXfs></styleSheet>",
        "xl/sharedStrings.xml": f"{XML}<sst>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>",
    }
    for i, n in enumerate(names):
        parts[f"xl/worksheets/sheet{i}.xml"] = f"{XML}<worksheet><sheetData>{sheets[n]}</sheetData></worksheet>"
    return package(parts)


def document(body, styles="", numbering=""):
    return package({
        "_rels/.rels": relations([("r1", "officeDocument", "word/document.xml")]),
        "word/_rels/document.xml.rels": relations([("a", "styles", "styles.xml"), ("b", "numbering", "numbering.xml")]),
        "word/document.xml": f'{XML}<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'{XML}<w:styles xmlns:w="w">{styles}</w:styles>',
        "word/numbering.xml": f'{XML}<w:numbering xmlns:w="w">{numbering}</w:numbering>',
    })


def pdf(pages, packed=False, broken=False):
    """pages: lists of lines; packed: flate-compressed content; broken: no usable cross-reference."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"}
    kids, number = [], 4
    for lines in pages:
        text = "BT /F1 12 Tf 72 720 Td 14 TL " + " ".join(f"({line}) Tj T*" for line in lines) + " ET"
        data = zlib.compress(text.encode("cp1252")) if packed else text.encode("cp1252")
        objects[number] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if packed else b"", data)
        objects[number + 1] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F1 3 0 R>>>>>>" % number
        kids.append(b"%d 0 R" % (number + 1))
        number += 2
    objects[2] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    out, offsets = b"%PDF-1.4\n", {}
    for n in sorted(objects):
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    start = len(out)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % number + b"".join(b"%010d 00000 n \n" % offsets[n] for n in sorted(objects))
    return out + table + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (number, 7 if broken else start)


def png(width, height, pixel, kind=2):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
