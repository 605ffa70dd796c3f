"""Small binary workbooks, written record by record, for the tests of their reader."""

import struct

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, length="<H", wide=None):
    wide = any(ord(c) > 255 for c in s) if wide is None else wide
    return struct.pack(length, len(s)) + bytes([int(wide)]) + s.encode("utf-16-le" if wide else "latin-1")


def workbook(sheets, strings, formats=(), xfs=(0,), date1904=False, sst_cut=None):
    """sheets: {name: list of records}. `sst_cut` splits the string table's record there, inside
    the characters of a wide string, as long tables are."""
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(text(s) for s in strings)
    table = record(0xFC, sst) if sst_cut is None else record(0xFC, sst[:sst_cut]) + record(0x3C, b"\x01" + sst[sst_cut:])
    head = record(0x809, struct.pack("<HHHH", 0x600, 5, 0, 0)) + record(0x22, struct.pack("<H", date1904))
    head += b"".join(record(0x41E, struct.pack("<H", k) + text(f)) for k, f in formats) + b"".join(record(0xE0, struct.pack("<HH", 0, f)) for f in xfs)
    bodies = [record(0x809, struct.pack("<HHHH", 0x600, 16, 0, 0)) + b"".join(r) + record(0x0A) for r in sheets.values()]
    names = list(sheets)
    bound = lambda at, n: record(0x85, struct.pack("<IBB", at, 0, 0) + text(n, "<B"))
    start = len(head) + sum(len(bound(0, n)) for n in names) + len(table) + 4
    offsets = [start + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    return head + b"".join(bound(o, n) for o, n in zip(offsets, names, strict=True)) + table + record(0x0A) + b"".join(bodies)


def compound(data, name="Workbook"):
    """An OLE file with one stream: in sectors of its own from 4096 bytes on, else in small ones."""
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    small = len(data) < 4096
    entry = lambda n, kind, start, size: pad(n.encode("utf-16-le") + b"\0\0", 64)[:64] + struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)
    body = pad(data, 64) if small else pad(data, 512)
    blocks = -(-len(body) // 512)
    table = [FAT, END] + ([END] if small else [])
    first = len(table)
    table += [*range(first + 1, first + blocks), END]
    root = entry("Root Entry", 5, first if small else END, len(body) if small else 0)
    directory = pad(root + entry(name, 2, 0 if small else first, len(data)), 512)
    assert len(table) <= 128
    sectors = [struct.pack("<128I", *table, *[FREE] * (128 - len(table))), directory]
    if small:
        count = len(body) // 64
        sectors.append(struct.pack("<128I", *range(1, count), END, *[FREE] * (128 - count)))
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<IIIIIII", 1, 1, 0, 4096, 2 if small else END, int(small), END) + struct.pack("<I", 0) + struct.pack("<109I", 0, *[FREE] * 108)
    return header + b"".join(sectors) + pad(body, 512)
