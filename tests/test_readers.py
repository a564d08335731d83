import json
import time

import numpy as np
import pytest

from leafspark.sources import pdf_crypt as crypt
from leafspark.sources.excel import workbook_cells
from leafspark.sources.jpeg import decode_jpeg
from leafspark.sources.markdown import markdown_rows
from leafspark.sources.pdf import page_lines, pdf_rows
from leafspark.sources.pictures import decode_gif, decode_png, shrink
from leafspark.sources.structured import page_rows
from leafspark.sources.webpage import html_rows
from leafspark.sources.word import word_rows
from tests import office


def texts(rows, style=None):
    return [r["text"] for r in rows if r["style"] != "space" and (style is None or r["style"] == style)]


def test_markdown_blocks():
    rows = markdown_rows("---\na: 1\n---\n# Title\n\ntext **bold** my_var_name\nmore\n\n- a\n    - b\n- [x] c\n1) d\n\n> [!WARNING] Hey\n> body\n\n| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n| -- | x |\n")
    assert texts(rows, "h1") == ["Title"] and texts(rows, "p") == ["text bold my_var_name more"]
    items = [(r["indent"], r["marker"], r["text"]) for r in rows if r["style"] == "li"]
    assert items == [(0, "•", "a"), (1, "•", "b"), (0, "☑", "c"), (0, "1.", "d")]
    assert [r["tone"] for r in rows if r["style"] == "panel"] == ["warning", "warning"]
    assert [r["cells"] for r in rows if r["style"] in ("th", "td")] == [["a", "b"], ["1", "2|3"], ["--", "x"]]
    assert rows[-1]["anchor"] == 'line 20 (under "Title")'


def test_markdown_edges():
    assert texts(markdown_rows("# C#"), "h1") == ["C#"]
    assert texts(markdown_rows("One\n===\n\nTwo\n---"))[::2] == ["One", "Two"]
    assert texts(markdown_rows("````\n```\nx\n````\nafter")) == ["```", "x", "after"]
    assert texts(markdown_rows("~~~\nopen")) == ["open"]
    assert markdown_rows("") == [] and texts(markdown_rows("a\r\nb")) == ["a b"]
    start = time.time()
    assert len(markdown_rows("line\n\n" * 25_000)) == 49_999
    assert time.time() - start < 10


def test_html_pages():
    rows = html_rows("<html><head><title>x</title></head><body>\n<h1>Hi &amp; you</h1><p>a<p>5&euro; &times; 2 &#9999999999; &unknown;<ul><li>x<ol><li>y</ol></ul><table><tr><th>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><div class='warning'>w</div><script>if (a<b) x()</script><p title='a>b'>end")
    assert texts(rows) == ["Hi & you", "", "a", "5€ × 2 � &unknown;", "x", "y", "A | B | ", "1 | 2 | 3", "w", "end"]
    assert [r["anchor"] for r in rows if r["style"] == "p"][:2] == ['<p> at line 2 (under "Hi & you")', '<p> #2 at line 2 (under "Hi & you")']
    assert texts(html_rows("<body><style>never closed <p>shown")) == ["never closed", "shown"]
    start = time.time()
    assert len(html_rows("<body>" + "".join(f"<p>line {i} of a long page</p>\n" for i in range(20_000)))) == 39_999
    assert time.time() - start < 15


def test_structured_pages():
    page = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": "Plan"}]},
        None,
        {"type": "paragraph", "content": [{"type": "text", "text": "Hi ", "marks": [{"type": "strong"}]}, {"type": "mention", "attrs": {"text": "@Ann"}}, {"type": "date", "attrs": {"timestamp": "1767225600000"}}, {"type": "status", "attrs": {"text": "done"}}]},
        {"type": "taskList", "content": [{"type": "taskItem", "attrs": {"state": "DONE"}, "content": [{"type": "text", "text": "t"}]}]},
        {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "b"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "c"}]}]}]}]}]},
        {"type": "panel", "attrs": {"panelType": "info"}, "content": [{"type": "paragraph", "content": [{"type": "text", "text": "p"}]}]},
    ]}
    rows = page_rows(json.dumps(page))
    assert texts(rows) == ["Plan", "", "Hi @Ann2026-01-01 DONE", "t", "b", "c", "p"]
    assert rows[0]["anchor"] == 'content[0] (under "Plan")' and rows[-1]["tone"] == "info"
    assert [(r["indent"], r["marker"]) for r in rows if r["style"] == "li"] == [(0, "☑"), (0, "•"), (1, "◦")]


def test_workbooks():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Jan</t></is></c></row>'
    rows += '<row r="2"><c t="s"><v>1</v></c><c><v>700</v></c><c r="C2"><f t="shared" si="0" ref="C2:C3">B2*2</f></c><c r="D2" s="1"><v>46023</v></c></row>'
    rows += '<row r="3"><c r="B3"><v>8000</v></c><c r="C3"><f t="shared" si="0"/></c><c r="D3"><f>SUM(B:B)</f></c><c r="E3"><f>NOPE(1)</f></c><c r="F3"><f>1/0</f></c><c r="G3"><f>B2+1</f><v>5</v></c><c r="H3"><f>\'Q 2\'!A1&amp;"!"</f></c></row>'
    book = office.workbook({"Budget": rows, "Q 2": '<row r="1"><c r="A1" t="b"><v>1</v></c></row>'}, formats=["yyyy-mm-dd"], shared=["<t>Item</t>", "<r><t>Face</t></r><r><t>book</t></r><rPh><t>x</t></rPh>"])
    cells = {(c["sheet"], c["r"], c["c"]): c for c in workbook_cells(book)}
    b = lambda r, c: cells["Budget", r, c]
    assert b(0, 0)["v"] == "Item" and b(1, 0)["v"] == "Facebook" and b(1, 1)["x"] == 700
    assert b(1, 2)["x"] == 1400 and b(2, 2)["x"] == 16000 and b(2, 2)["f"] == "=B3*2"
    assert b(2, 3)["x"] == 8700 and b(1, 3)["fmt"] == "yyyy-mm-dd"
    assert (b(2, 4)["status"], b(2, 5)["status"], b(2, 5)["v"]) == ("unsupported", "error", "#DIV/0!")
    assert b(2, 6)["x"] == 5 and b(2, 7)["v"] == "TRUE!"


def test_word_documents():
    def p(text, pr=""):
        return f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"

    num = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="7"/></w:numPr>'
    body = p("Doc", '<w:pStyle w:val="T"/>') + "<w:p/>" + p("Summary", '<w:pStyle w:val="H1"/>') + p("one", num.format(0)) + p("deep", num.format(1)) + p("two", num.format(0))
    body += "<w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:rPr><w:b/></w:rPr><w:t>in</w:t></w:r></w:ins></w:p>"
    cell = "<w:tc><w:tcPr>{}</w:tcPr><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body += "<w:tbl><w:tr>" + cell.format('<w:vMerge w:val="restart"/>', "A") + cell.format('<w:gridSpan w:val="2"/>', "B") + "</w:tr><w:tr>" + cell.format("<w:vMerge/>", "") + cell.format("", "x") + cell.format("", "y") + "</w:tr></w:tbl>"
    styles = '<w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style>'
    levels = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num>'
    rows = word_rows(office.document(body, styles, levels))
    assert texts(rows) == ["Doc", "", "Summary", "one", "deep", "two", "kept in", "A | B | ", "A | x | y"]
    assert [(r["indent"], r["marker"]) for r in rows if r["style"] == "li"] == [(0, "1."), (1, "•"), (0, "2.")]
    assert next(r for r in rows if r["text"] == "kept in")["anchor"] == 'paragraph 7 (under "Summary")'
    assert rows[-1]["anchor"] == 'table 1, row 2 (under "Summary")'
    assert next(r for r in rows if r["text"] == "Summary")["style"] == "h2"


def test_pdf_files():
    pages = [["First line", "Second caf\xe9"], ["On page two"]]
    for options in ({}, {"packed": True}, {"broken": True}):
        rows = pdf_rows(office.pdf(pages, **options))
        assert texts(rows) == ["Page 1", "First line", "Second café", "Page 2", "On page two"], options
        assert rows[2]["anchor"] == "page 1, line 2"
    assert page_lines([(0, 100, 30, 10, "a"), (32, 100, 60, 10, "b"), (0, 80, 20, 10, "c"), (20.5, 80, 30, 10, "d")]) == ["a b", "cd"]


def test_pictures():
    data = office.png(40, 24, lambda x, y: (0xDD, 0x22, 0x22) if x < 20 else (0x22, 0x44, 0xDD))
    pixels = decode_png(data)
    assert pixels.shape == (24, 40, 4) and tuple(pixels[5, 5]) == (0xDD, 0x22, 0x22, 255) and tuple(pixels[5, 30][:3]) == (0x22, 0x44, 0xDD)
    assert shrink(pixels, 20).shape == (12, 20, 3)
    grey = decode_png(office.png(3, 2, lambda x, y: (x * 100,), kind=0))
    assert grey[0, 2, 0] == 200
    assert np.all(shrink(np.zeros((4, 4, 4), np.uint8)) == 255)


def test_gif_pictures():
    # Two by two, four colours, three-bit codes: clear, 0, 1, 2, 3, end.
    codes, bits = [4, 0, 1, 2, 3, 5], 0
    packed, have = [], 0
    width = 3
    for n, c in enumerate(codes):
        bits |= c << have
        have += width
        if n == 3:
            width = 4  # the table has eight entries by then
        while have >= 8:
            packed.append(bits & 255)
            bits, have = bits >> 8, have - 8
    packed.append(bits & 255)
    data = b"GIF89a" + bytes([2, 0, 2, 0, 0x81, 0, 0]) + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]) + b"\x21\xf9\x04\x01\x00\x00\x03\x00" + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 2, 0, 0]) + bytes([2, len(packed)]) + bytes(packed) + b"\x00\x3b"
    pixels = decode_gif(data)
    assert pixels[0, 0].tolist() == [255, 0, 0, 255] and pixels[0, 1].tolist() == [0, 255, 0, 255] and pixels[1, 0].tolist() == [0, 0, 255, 255] and pixels[1, 1, 3] == 0


def test_ciphers():
    key = bytes(range(16))
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_encrypt(key, bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    long = bytes(range(256))
    for size in (16, 32):
        assert crypt.aes_decrypt(bytes(range(size)), key, crypt.aes_encrypt(bytes(range(size)), key, long)) == long
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_encrypted_pdf_with_an_empty_password():
    from hashlib import md5

    file_id, owner, permissions = b"0123456789abcdef", bytes(32), -4
    key = md5(crypt._PAD + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()[:5]
    user = crypt.rc4(key, crypt._PAD)
    plain = office.pdf([["secret line"]])
    start, end = plain.index(b"stream\n", plain.index(b"4 0 obj")) + 7, plain.index(b"\nendstream")
    own = md5(key + (4).to_bytes(3, "little") + bytes(2)).digest()[:10]
    body = plain[:start] + crypt.rc4(own, plain[start:end]) + plain[end:]
    info = b"/Encrypt<</Filter/Standard/V 1/R 2/O<" + owner.hex().encode() + b">/U<" + user.hex().encode() + b">/P -4>>/ID[<" + file_id.hex().encode() + b">]"
    data = body.replace(b"/Root 1 0 R>>", b"/Root 1 0 R" + info + b">>")
    assert texts(pdf_rows(data)) == ["Page 1", "secret line"]
    wrong = data.replace(user.hex().encode(), bytes(32).hex().encode())
    with pytest.raises(ValueError, match="password"):
        pdf_rows(wrong)


def jpeg(progressive, blocks, width):
    """Grey blocks of flat light, from their DC differences; codes are 4 bits for each size and one for the end."""

    def marker(kind, body):
        return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body

    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([0, 1] + [0] * 14) + bytes([0])
    out, before = "", 0
    for level in blocks:
        diff, before = level - before, level
        size = abs(diff).bit_length()
        out += f"{size:04b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + ("" if progressive else "00")
    out += "1" * (-len(out) % 8)
    scan = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    head = marker(0xDB, bytes([0]) + bytes([8]) * 64) + marker(0xC2 if progressive else 0xC0, bytes([8, 0, 8, 0, width, 1, 1, 0x11, 0]))
    return b"\xff\xd8" + head + marker(0xC4, bytes([0]) + dc) + marker(0xC4, bytes([0x10]) + ac) + marker(0xDA, bytes([1, 1, 0, 0, 0 if progressive else 63, 0])) + scan + b"\xff\xd9"


def test_jpeg_pictures():
    for progressive in (False, True):
        pixels = decode_jpeg(jpeg(progressive, [50, -20, -20, 100], 30))
        assert pixels.shape == (8, 30, 4)
        assert pixels[3, [0, 8, 16, 29], 0].tolist() == [178, 108, 108, 228]
    with pytest.raises(ValueError, match="not a JPEG"):
        decode_jpeg(b"GIF89a")
