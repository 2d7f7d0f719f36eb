"""Small PDF files for tests: pages of placed texts, with outlines, and with or without object streams."""

import zlib


def pdf_file(pages, outline=(), packed=False, comments=(), hex_font=False, encrypted=False):
    """pages: lists of (x, y from the top, size, bold, text); outline: (level, title, page, y from the top or None).

    comments: (page, kind, author, text, marked box (x0, x1, top, low) or None).
    """
    objects = {1: "<< /Type /Catalog /Pages 2 0 R" + (" /Outlines 5 0 R" if outline else "") + " >>", 3: None, 4: None}
    kids, n = [], 10
    if hex_font:
        chars = sorted({c for p in pages for *_, t in p for c in t})
        codes = {c: k + 1 for k, c in enumerate(chars)}
        cmap = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items())
        cmap = f"begincmap\n{len(codes)} beginbfchar\n{cmap}\nendbfchar\nendcmap".encode()
        objects[7] = (f"<< /Length {len(cmap)} >>", cmap)
        objects[6] = "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Odd /DW 500 >>"
        for k, name in ((3, "Odd"), (4, "Odd-Bold")):
            objects[k] = f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
        show = lambda t: "<" + "".join(f"{codes[c]:04x}" for c in t) + ">"
    else:
        for k, name in ((3, "Courier"), (4, "Courier-Bold")):
            objects[k] = f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [{' '.join(['500'] * 224)}] >>"
        show = lambda t: "(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    for page in pages:
        body = "".join(f"BT /{'B' if bold else 'R'} {size} Tf 1 0 0 1 {x} {800 - y} Tm {show(text)} Tj ET\n" for x, y, size, bold, text in page)
        raw = zlib.compress(body.encode("cp1252"))
        objects[n + 1] = (f"<< /Length {len(raw)} /Filter /FlateDecode >>", raw)
        notes = ""
        for at, kind, author, text, box in comments:
            if at == len(kids):
                quad = "" if box is None else f" /QuadPoints [{box[0]} {800 - box[2]} {box[1]} {800 - box[2]} {box[0]} {800 - box[3]} {box[1]} {800 - box[3]}]"
                notes += f"<< /Type /Annot /Subtype /{kind} /T ({author}) /M (D:20240101) /Contents <feff{text.encode('utf-16-be').hex()}>{quad} >> "
        objects[n] = f"<< /Type /Page /Parent 2 0 R /Contents {n + 1} 0 R{f' /Annots [{notes}]' if notes else ''} >>"
        kids.append(n)
        n += 2
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /MediaBox [0 0 600 800] /Resources << /Font << /R 3 0 R /B 4 0 R >> >> /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>"
    if outline:
        at = list(range(n, n + len(outline)))
        child = lambda k: next((j for j in range(k + 1, len(outline)) if outline[j][0] <= outline[k][0] or outline[j][0] == outline[k][0] + 1), None)
        for k, (level, title, page, y) in enumerate(outline):
            inner = child(k)
            first = f" /First {at[inner]} 0 R" if inner is not None and outline[inner][0] == level + 1 else ""
            after = next((j for j in range(k + 1, len(outline)) if outline[j][0] <= level), None)
            following = f" /Next {at[after]} 0 R" if after is not None and outline[after][0] == level else ""
            to = f"[{kids[page]} 0 R /Fit]" if y is None else f"[{kids[page]} 0 R /XYZ 0 {800 - y} null]"
            objects[at[k]] = f"<< /Title <feff{title.encode('utf-16-be').hex()}> /Dest {to}{first}{following} >>"
        objects[5] = f"<< /Type /Outlines /First {at[0]} 0 R >>"
    out = b"%PDF-1.7\n"
    plain = {k: v for k, v in objects.items() if isinstance(v, str)}
    if packed:
        heads, bodies, offset = [], [], 0
        for k, v in plain.items():
            heads.append(f"{k} {offset}")
            bodies.append(v)
            offset += len(v) + 1
        head = (" ".join(heads) + " ").encode()
        raw = zlib.compress(head + " ".join(bodies).encode("latin-1"))
        out += f"900 0 obj\n<< /Type /ObjStm /N {len(plain)} /First {len(head)} /Filter /FlateDecode /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
        out += b"901 0 obj\n<< /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream\nendobj\n"
    else:
        for k, v in plain.items():
            out += f"{k} 0 obj\n{v}\nendobj\n".encode("latin-1")
    for k, v in objects.items():
        if isinstance(v, tuple):
            out += f"{k} 0 obj\n{v[0]}\nstream\n".encode() + v[1] + b"\nendstream\nendobj\n"
    return out + (b"trailer\n<< /Root 1 0 R" + (b" /Encrypt << >>" if encrypted else b"") + b" >>\n" if not packed else b"") + b"%%EOF"
