"""Text of a PDF file's pages: by the package pypdf where it is installed, else by a small reader of our own.

The small reader knows plain and Flate streams, object streams, page trees, simple
fonts (Latin text or a ToUnicode map) and the operators that show text.  It reads no
encrypted files, and says so.
"""

from __future__ import annotations

import importlib.util
import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(
    rb"""%[^\r\n]*|(?P<open><<|\[)|(?P<close>>>|\])|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<ref>\d+\s+\d+\s+R\b)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))
    |<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<string>\()|(?P<word>[A-Za-z'"*][A-Za-z0-9'"*]*)""",
    re.X,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, without its slash."""


class Ref(int):
    """The number of an object."""


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string that opens before at, and the place after it."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            if n not in b"\r\n":
                out += _ESCAPES.get(n, n)
            elif data[at + 1 : at + 3] == b"\r\n":
                at += 1
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes, at: int = 0, *, one: bool = False):
    """The values and words of a piece of PDF syntax; with one, only the first value and the place after it."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    while m := _TOKEN.search(data, at):
        at = m.end()
        if m["open"]:
            stack.append([])
            kinds.append(m["open"])
            continue
        if m["close"]:
            if not kinds:
                continue
            items, kind = stack.pop(), kinds.pop()
            value = items if kind == b"[" else {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}
        elif m["name"]:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"][1:])
            value = Name(raw.decode("latin-1"))
        elif m["ref"]:
            value = Ref(m["ref"].split()[0])
        elif m["number"]:
            value = float(m["number"]) if b"." in m["number"] else int(m["number"])
        elif m["string"]:
            value, at = _string(data, at)
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m["word"]:
            word = m["word"].decode("latin-1")
            value = {"true": True, "false": False, "null": None}.get(word, Word(word))
            if word == "BI" and not kinds:  # an image in the page: no text
                end = re.compile(rb"\bEI\b").search(data, at)
                at = end.end() if end else len(data)
                continue
        else:
            continue
        stack[-1].append(value)
        if one and len(stack) == 1:
            return value, at
    return (stack[0][0] if stack[0] else None, at) if one else stack[0]


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.at = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}  # a later object takes the place of an earlier one
        self.known: dict[int, object] = {}
        if any(b"/Encrypt" in m for m in re.findall(rb"trailer.*?startxref|/Type\s*/XRef.*?stream", data, re.S)):
            raise ValueError("the file is encrypted")
        for number in list(self.at):
            value = self.object(number)
            if isinstance(value, tuple) and value[0].get("Type") == "ObjStm":
                self._unpack(value)

    def _unpack(self, packed: tuple[dict, bytes]) -> None:
        info, body = packed[0], self.decoded(packed)
        head = values(body[: int(info["First"])])
        for number, offset in zip(head[::2], head[1::2], strict=False):
            if number not in self.at:
                self.known[number] = values(body, int(info["First"]) + offset, one=True)[0]

    def object(self, value):
        """What a reference leads to; a stream is (dictionary, raw bytes)."""
        if isinstance(value, Ref) or type(value) is int and value in self.at:
            number = int(value)
            if number not in self.known and number in self.at:
                self.known[number] = None  # a loop ends here
                got, end = values(self.data, self.at[number], one=True)
                m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end)
                if isinstance(got, dict) and m:
                    size = got.get("Length")
                    size = self.object(size) if isinstance(size, Ref) else size
                    stop = m.end() + size if isinstance(size, int) and self.data[m.end() + size :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
                    got = (got, self.data[m.end() : stop])
                self.known[number] = got
            return self.known.get(number)
        return value

    def follow(self, value):
        return self.object(value) if isinstance(value, Ref) else value

    def decoded(self, stream: tuple[dict, bytes]) -> bytes:
        info, body = stream
        filters = self.follow(info.get("Filter")) or []
        for f in [filters] if isinstance(filters, Name) else filters:
            if f != "FlateDecode":
                raise ValueError(f"a stream is coded by {f}")
            body = zlib.decompressobj().decompress(body)
        return body

    def pages(self) -> list[dict]:
        """Dictionaries of the pages in order, what they inherit included."""
        roots = [self.follow(v) for n in sorted({*self.at, *self.known}) if isinstance(v := self.object(Ref(n)), dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(node, inherited: dict, seen: frozenset) -> None:
            if not isinstance(node, dict):
                return
            inherited = inherited | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.follow(node["Kids"]) or []:
                    if kid not in seen:
                        walk(self.follow(kid), inherited, seen | {kid})
            else:
                out.append(inherited | node)

        if roots:
            walk(self.follow(roots[-1].get("Pages")), {}, frozenset())
        return out

    def font(self, font: dict):
        """bytes -> text for a font's strings."""
        unicode_map = self.follow(font.get("ToUnicode"))
        if isinstance(unicode_map, tuple):
            return _mapped(self.decoded(unicode_map), 2 if font.get("Subtype") == "Type0" else 1)
        if font.get("Subtype") == "Type0":
            return lambda raw: raw.decode("utf-16-be", "replace")
        return lambda raw: raw.decode("cp1252", "replace")

    def text(self, page: dict) -> str:
        resources = self.follow(page.get("Resources")) or {}
        fonts = {k: self.font(self.follow(v) or {}) for k, v in (self.follow(resources.get("Font")) or {}).items()}
        contents = self.follow(page.get("Contents"))
        parts = [self.follow(c) for c in contents] if isinstance(contents, list) else [contents]
        out: list[str] = []
        show, stack, line = fonts.get(""), [], None
        for v in values(b"\n".join(self.decoded(p) for p in parts if isinstance(p, tuple))):
            if not isinstance(v, Word):
                stack.append(v)
                continue
            read = show or (lambda raw: raw.decode("cp1252", "replace"))
            if v == "Tf" and stack[:1]:
                show = fonts.get(str(stack[0]))
            elif v == "Tj" and stack:
                out.append(read(stack[-1]))
            elif v in ("'", '"') and stack:
                out += ["\n", read(stack[-1])]
            elif v == "TJ" and stack:
                # a wide gap between pieces is a space
                out += [read(x) if isinstance(x, bytes) else " " if x < -200 else "" for x in stack[-1]]
            elif v == "T*":
                out.append("\n")
            elif v in ("Td", "TD") and len(stack) >= 2:
                out.append("\n" if stack[-1] else " ")
            elif v == "Tm" and len(stack) >= 6:
                if line is not None and out:
                    out.append("\n" if stack[-1] != line else " ")
                line = stack[-1]
            elif v == "ET":
                out.append("\n")
            stack = []
        return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def _mapped(table: bytes, width: int):
    """A ToUnicode map as a function of a string's bytes."""
    codes: dict[int, str] = {}
    stack: list = []
    for v in values(table):
        if v == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                codes[int.from_bytes(a, "big")], width = b.decode("utf-16-be", "replace"), len(a)
        elif v == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                width = len(a)
                for k in range(int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535) + 1):
                    d = k - int.from_bytes(a, "big")
                    codes[k] = c[d].decode("utf-16-be", "replace") if isinstance(c, list) else (c[:-2] + ((int.from_bytes(c[-2:], "big") + d) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
        if isinstance(v, Word):
            stack = []
        else:
            stack.append(v)
    return lambda raw: "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def page_texts(content: bytes) -> list[str]:
    """The text of each page, in order."""
    if importlib.util.find_spec("pypdf"):  # an optional package
        import io

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    reader = Reader(content)
    return [reader.text(p) for p in reader.pages()]
