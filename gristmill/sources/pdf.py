"""Text of PDF resumes: a small reader for plain files, in a child process of each task, with bounds on time, memory, pages, depth and size.

It reads uncompressed and Flate-compressed objects and streams, classic and stream cross references alike (objects are found by
scanning), page trees with cycles, and text shown with Tj, TJ, ' and ". Glyphs go through a font's ToUnicode map where it has one, else
through Latin-1. Encrypted files and other compressions are errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.sources.guarded import SECONDS, Child, ChildError, ItemError

_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)[ \r\n\t]+[0-9]+[ \r\n\t]+obj\b")
_REF = re.compile(rb"([0-9]+)\s+[0-9]+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """The file can't be read, holds no text, or too much."""


def _stream(body: bytes) -> bytes | None:
    at = re.search(rb"stream\r?\n", body)
    if not at:
        return None
    raw = body[at.end() : body.rfind(b"endstream")]
    head = body[: at.start()]
    if b"/Filter" not in head:
        return raw
    if b"FlateDecode" not in head:
        raise PdfError("unknown compression")
    return zlib.decompressobj().decompress(raw, 64 << 20)


def _objects(raw: bytes) -> dict[int, bytes]:
    if b"/Encrypt" in raw:
        raise PdfError("encrypted")
    out: dict[int, bytes] = {}
    found = list(_OBJECT.finditer(raw))
    for m, nxt in zip(found, [*found[1:], None], strict=True):
        body = raw[m.end() : nxt.start() if nxt else len(raw)]
        end = body.rfind(b"endobj")
        out[int(m[1])] = body[:end] if end >= 0 else body
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body[:2000]):
            head, data = body[: body.find(b"stream")], _stream(body) or b""
            n, first = (int(re.search(rb"/" + k + rb"\s+([0-9]+)", head)[1]) for k in (b"N", b"First"))
            places = [int(x) for x in data[:first].split()[: 2 * n]]
            for i in range(n):
                stop = places[2 * i + 3] if i + 1 < n else len(data) - first
                out.setdefault(places[2 * i], data[first + places[2 * i + 1] : first + stop])
    return out


def _after(body: bytes, key: bytes) -> bytes:
    m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
    return body[m.end() :] if m else b""


def _refs(body: bytes, key: bytes) -> list[int]:
    rest = _after(body, key)
    if rest.startswith(b"["):
        return [int(x) for x in _REF.findall(rest[: rest.find(b"]")])]
    m = _REF.match(rest)
    return [int(m[1])] if m else []


def collect_pages(objects: dict[int, bytes], most: int = X.PDF_PAGES) -> list[int]:
    """The first `most` pages in order; a tree that is too deep or too large, as one that contains itself, is an error."""
    catalogs = [b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)]
    roots = _refs(catalogs[-1], b"Pages") if catalogs else []
    pages: list[int] = []
    nodes = 0

    def walk(node: int, depth: int) -> None:
        nonlocal nodes
        if depth > X.PDF_DEPTH:
            raise PdfError("malformed page tree")
        for kid in _refs(objects.get(node, b""), b"Kids"):
            if len(pages) >= most:
                return
            nodes += 1
            if nodes > X.PDF_NODES:
                raise PdfError("malformed page tree")
            body = objects.get(kid, b"")
            if re.search(rb"/Type\s*/Pages\b", body):
                walk(kid, depth + 1)
            elif re.search(rb"/Type\s*/Page\b", body):
                pages.append(kid)

    for r in roots:
        walk(r, 0)
    return pages


def _literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    text = token[1:-1]
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code to text)."""
    out: dict[int, str] = {}
    wide = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", data)
    decode = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = decode(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[k] = chr(int(c, 16) + k - int(a, 16)) if len(c) <= 4 else decode(c)
    return (len(wide[1]) // 2 if wide else 1), out


def _page_text(objects: dict[int, bytes], page: int) -> str:
    body = objects[page]
    resources = body
    for r in _refs(body, b"Resources"):
        resources += objects.get(r, b"")
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    table = _after(resources, b"Font")
    for r in _REF.findall(table[:40]) if not table.startswith(b"<<") else ():
        table = objects.get(int(r), b"")
        break
    for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+([0-9]+)\s+[0-9]+\s+R", table):
        for u in _refs(objects.get(int(ref), b""), b"ToUnicode"):
            fonts.setdefault(name, _unicode_map(_stream(objects.get(u, b"")) or b""))
    data = b"\n".join(_stream(objects.get(c, b"")) or b"" for c in _refs(body, b"Contents"))
    out: list[str] = []
    stack: list[bytes] = []
    font: tuple[int, dict[int, str]] | None = None

    def show(raw: bytes) -> None:
        if font and font[1]:
            step = font[0]
            out.append("".join(font[1].get(int.from_bytes(raw[i : i + step]), "") for i in range(0, len(raw), step)))
        else:
            out.append(raw.decode("latin-1"))

    for token in _TOKEN.findall(data):
        if token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in stack:
                if x[:1] in (b"(", b"<") and x != b"<<":
                    show(_literal(x))
                elif token == b"TJ" and re.fullmatch(rb"-[0-9.]+", x) and float(x) < -180:
                    out.append(" ")  # a gap as wide as a space
        elif token in (b"Td", b"TD", b"T*", b"ET", b"Tm") and out and not out[-1].endswith("\n"):
            moved = token in (b"T*", b"ET", b"Tm") or len(stack) < 1 or stack[-1] not in (b"0", b"0.0")
            out.append("\n" if moved else " ")
        elif token == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:])
        if re.fullmatch(rb"[A-Za-z'\"*]+[0-9]?\*?", token):
            stack = []
        else:
            stack.append(token)
    return "".join(out)


def text_of(raw: bytes, most: int = X.TEXT_BYTES) -> str:
    """The text of a PDF's pages, a line break after each; not yet normalised. PdfError if it can't be read or is too large."""
    if not raw.startswith(b"%PDF"):
        raise PdfError("not a PDF")
    try:
        objects = _objects(raw)
        text = ""
        for p in collect_pages(objects):
            text += _page_text(objects, p) + "\n"
            if len(text.encode()) > most:
                raise PdfError("too large")
    except (KeyError, IndexError, TypeError, zlib.error, RecursionError) as e:
        raise PdfError(f"the reader failed: {type(e).__name__}") from e
    return text


def space_after_bullet(line: Column) -> Column:
    return F.regexp_replace(line, f"^([{X.BULLETS}])(?=[^ ])", "$1 ")


def normalise(text: Column) -> Column:
    """PDF text in the convention of a resume: no blank lines, a bullet on its own joined to its item, known headings marked with #."""
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[\r\t\f]", " "))), lambda x: x != "")
    bullet = lambda x: x.rlike(f"^[{X.BULLETS}]$")
    head = lambda x: F.lower(F.regexp_replace(x, ":$", "")).isin(*X.PDF_HEADINGS)
    start = F.struct(F.lit("").alias("mark"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        said = F.when(s["mark"] != "", F.concat(s["mark"], F.lit(" "), x)).when(head(x), F.concat(F.lit("# "), x)).otherwise(space_after_bullet(x))
        return F.when(bullet(x), F.struct(x.alias("mark"), s["out"].alias("out"))).otherwise(F.struct(F.lit("").alias("mark"), F.concat(s["out"], F.array(said)).alias("out")))

    return F.array_join(F.aggregate(lines, start, step)["out"], "\n")


def read_pdfs(spark: SparkSession, path: str, id_name: str = "resume_id", seconds: float = SECONDS, reader: Callable[[bytes], str] = text_of) -> DataFrame:
    """(id, text, error): each .pdf whole; the error says why there is no text.

    Files are read in a child process of the task, which has `seconds` for each: one that loops, or takes the memory, loses its own row.
    """
    work = cloudpickle.dumps(reader)

    def run(batches):
        import pandas as pd

        with Child(work, seconds) as child:
            for b in batches:
                texts, errors = [], []
                for raw in b["content"]:
                    try:
                        texts.append(child(raw) if raw is not None else None)
                        errors.append(None if raw is not None else "too large")
                    except (ItemError, ChildError) as e:
                        texts.append(None)
                        known = isinstance(e, ChildError) or e.kind == "PdfError"
                        errors.append(str(e) if known else f"the reader failed: {e.kind}")
                yield pd.DataFrame({"path": b["path"], "raw": texts, "error": errors})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    some = files.select("path", F.when(F.col("length") <= X.PDF_BYTES, F.col("content")).alias("content"))
    rows = some.mapInPandas(run, "path string, raw string, error string").withColumn("text", normalise(F.coalesce("raw", F.lit(""))))
    error = F.coalesce("error", F.when(F.trim("text") == "", "no text").when(F.octet_length("text") > X.TEXT_BYTES, "too large"))
    return rows.select(F.regexp_extract("path", "([^/]+)[.][^./]+$", 1).alias(id_name), F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))
