"""File scans: binaryFile rows to pages. Parsers run in Arrow batches over one file at a time; cleaning is native."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import names, rules

# Fixed values.
PDF_PAGES, TEXT_LEAST = 20, 12
ENTRIES_MOST, BYTES_MOST, NAME_BYTES = 5000, 500 * 2**20, 200
JUNK = {"__MACOSX", ".DS_Store", "Thumbs.db"}
PAGE = "struct<pageNumber:int,text:string,hasText:boolean,imagePath:string>"
SCAN = f"path string, format string, pages array<{PAGE}>, pageCount int, hasTextLayer boolean, note string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every file under path as a row of pages; a file that can't be read gives a note, not a failure."""
    return scan_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def scan_contents(files: DataFrame) -> DataFrame:
    """The same for a table of path and content."""
    typed = files.select("path", F.coalesce(rules.format_of(F.col("path")), F.lit("other")).alias("format"), "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, kind, content in zip(b.path, b.format, b.content):
                yield pd.DataFrame([(f, *ingest(kind, content, f))], columns=[c.split()[0] for c in ("path s", "format s", "texts s", "pageCount s", "note s", "image s")])

    raw = typed.mapInPandas(rows, "path string, format string, texts array<string>, pageCount int, note string, image boolean")
    cleaned = F.when(F.col("format") == "text", F.transform("texts", rules.clean_lines)).when(F.col("format") == "hwp", F.transform("texts", rules.clean_blocks)).otherwise(F.col("texts"))
    least = F.when(F.col("format") == "pdf", TEXT_LEAST).otherwise(1)
    page = lambda t, i: F.struct((i + 1).cast("int").alias("pageNumber"), t.alias("text"), (F.length(F.trim(t)) >= least).alias("hasText"), F.when(F.col("image"), F.col("path")).alias("imagePath"))
    paged = raw.withColumn("texts", cleaned).withColumn("pages", F.transform("texts", page))
    note = F.when((F.col("format") == "pdf") & F.col("note").isNull() & ~F.exists("pages", lambda p: p["hasText"]), "scanned PDF without a text layer").otherwise(F.col("note"))
    return paged.select("path", "format", "pages", "pageCount", F.exists("pages", lambda p: p["hasText"]).alias("hasTextLayer"), note.alias("note"))


def ingest(kind: str, content: bytes, path: str) -> tuple:
    """format, page texts, number of pages, note and whether it is an image."""
    try:
        if kind == "text":
            return kind, [content.decode("utf-8", "replace").removeprefix("﻿")], 1, None, False
        if kind == "pdf":
            texts = pdf_pages(content)
            return kind, texts[:PDF_PAGES] or [""], max(1, len(texts)), None, False
        if kind == "hwp":
            text = hwpx_text(content) if content[:2] == b"PK" else hwp_text(content)
            return kind, [text], 1, None, False
        return "image", [""], 1, None if kind == "image" else "unknown format, taken as an image", True
    except Exception as e:  # noqa: BLE001  any damaged file
        return (kind, [], 0, f"not readable: {e}", False) if kind == "hwp" else (kind, [""], 1, f"not readable: {e}", kind == "pdf")


# ---- PDF: objects, plain or in object streams, pages in tree order, fonts' Unicode maps


class Ref(int):
    """Number of an object that is referred to."""


class Word(str):
    """A name (with its slash), operator or keyword; strings are bytes."""


TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^\s()<>\[\]{}/%]*|\((?:[^()\\]|\\.)*|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|[{}()]", re.S)
REF = re.compile(rb"\s+(\d+)\s+R(?![^\s()<>\[\]{}/%])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that opens at `at`, and where it ends."""
    depth, i = 0, at
    while i < len(data):
        c = data[i]
        i += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
        if not depth and c != 0x5C:
            break
    raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1]), data[at + 1 : i - 1], flags=re.S)
    return raw, i


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators of a content stream or object, with where each ends: numbers, bytes, Word, Ref, lists, dicts."""
    stack: list[tuple[bytes, list]] = []
    while m := TOKEN.search(data, at):
        t, at = m[0], m.end()
        value: object
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append((t, []))
            continue
        if t in (b">>", b"]"):
            if not stack:
                continue
            opened, inside = stack.pop()
            value = dict(zip(inside[::2], inside[1::2])) if opened == b"<<" else inside
        elif t[:1] == b"(":
            value, at = literal(data, m.start())
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1]).decode()
            value = bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif t.isdigit() and (r := REF.match(data, at)):
            value, at = Ref(t), r.end()
        elif NUMBER.match(t):
            value = float(t)
        else:
            value = Word(t.decode("latin-1"))
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class Pdf:
    """Objects by number: the dictionary or value, and the stream's bytes behind it."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:4] == b"%PDF":
            raise ValueError("no PDF header")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        starts = [(int(m[1]), m.end()) for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj(?![a-z])", data)]
        for n, at in starts:
            value, end = next(tokens(data, at), (None, at))
            m = re.compile(rb"\s*stream\r?\n?").match(data, end)
            body = None
            if m:
                stop = data.find(b"endstream", m.end())
                size = value.get("/Length") if isinstance(value, dict) else None
                whole = m.end() + int(size) if isinstance(size, float) else -1
                exact = whole >= 0 and data[whole : whole + 20].lstrip().startswith(b"endstream")
                body = data[m.end() : whole] if exact else re.sub(rb"\r?\n$", b"", data[m.end() : stop])
            self.objects[n] = (value, body)
        for value, body in list(self.objects.values()):
            if isinstance(value, dict) and value.get("/Type") == "/ObjStm":
                inside, first = self.unpacked(value, body), int(value["/First"])
                head = [int(x) for x, _ in tokens(inside[:first])]
                for n, at in zip(head[::2], head[1::2]):
                    self.objects.setdefault(n, (next(tokens(inside, first + at), (None, 0))[0], None))

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def unpacked(self, value: dict, body: bytes | None) -> bytes:
        filters = self.get(value.get("/Filter"))
        out = body or b""
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("/FlateDecode", "/Fl"):
                out = zlib.decompressobj().decompress(out)
            elif f in ("/ASCIIHexDecode", "/AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", out.split(b">")[0]).decode()
                out = bytes.fromhex(digits + "0" * (len(digits) % 2))
            elif f is not None:
                return b""  # images
        return out

    def stream(self, ref: object) -> bytes:
        value, body = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        return self.unpacked(value, body) if isinstance(value, dict) and body is not None else b""

    def pages(self) -> list[dict]:
        """In the order of the page tree, with what they inherit; without a tree by object number."""
        dicts = [v for v, _ in self.objects.values() if isinstance(v, dict)]
        root = next((self.get(d["/Pages"]) for d in dicts if d.get("/Type") == "/Catalog" and "/Pages" in d), None)
        out: list[dict] = []
        todo, seen = [(root, {})] if isinstance(root, dict) else [], set()
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = above | ({"/Resources": node["/Resources"]} if "/Resources" in node else {})
            if "/Kids" in node:
                todo += [(self.get(k), own) for k in reversed(self.get(node["/Kids"]) or [])]
            else:
                out.append(own | node)
        return out or [self.objects[n][0] for n in sorted(self.objects) if isinstance(self.objects[n][0], dict) and self.objects[n][0].get("/Type") == "/Page"]

    def text(self, page: dict) -> str:
        contents = page.get("/Contents")
        parts = self.get(contents) if isinstance(self.get(contents), list) else [contents]
        resources = self.get(page.get("/Resources")) or {}
        fonts = self.get(resources.get("/Font")) if isinstance(resources, dict) else None
        maps = {name: unicode_map(self.stream(f["/ToUnicode"])) for name, ref in (fonts or {}).items() if isinstance(f := self.get(ref), dict) and "/ToUnicode" in f}
        return shown(b"\n".join(self.stream(p) for p in parts), maps)


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Width of a code in bytes, and the text of each code."""
    out: dict[int, str] = {}
    width, held = 1, []
    text = lambda b: b.decode("utf-16-be", "replace")
    for t, _ in tokens(cmap):
        if not isinstance(t, Word):
            held.append(t)
            continue
        if t == "endcodespacerange" and held:
            width = max(len(x) for x in held if isinstance(x, bytes))
        elif t == "endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif t == "endbfrange":
            for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                low = int.from_bytes(a, "big")
                for k in range(min(65536, int.from_bytes(b, "big") - low + 1)):
                    if isinstance(to, list):
                        if k < len(to):
                            out[low + k] = text(to[k])
                    else:
                        out[low + k] = text((int.from_bytes(to, "big") + k).to_bytes(max(2, len(to)), "big"))
        held = []
    return width, out


def shown(content: bytes, maps: dict[str, tuple[int, dict[int, str]]]) -> str:
    """The strings that a content stream shows, blanks where it moves to another place or line."""
    out: list[str] = []
    held: list = []
    font: tuple[int, dict[int, str]] | None = None

    def read(raw: bytes) -> str:
        if font:
            width, known = font
            return "".join(known.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8") if _utf8(raw) else raw.decode("latin-1")

    for t, _ in tokens(content):
        if not isinstance(t, Word) or t.startswith("/"):
            held.append(t)
            continue
        if t == "Tf" and len(held) > 1:
            font = maps.get(held[-2])
        elif t in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
            out.append((" " if t != "Tj" else "") + read(held[-1]))
        elif t == "TJ" and held and isinstance(held[-1], list):
            out.append("".join(read(x) if isinstance(x, bytes) else " " if isinstance(x, float) and x < -200 else "" for x in held[-1]))
        elif t in ("Td", "TD", "T*", "Tm", "ET"):
            out.append(" ")
        held = []
    return re.sub(r"\s+", " ", "".join(out)).strip()


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page; a document without page objects is one page of all its streams."""
    pdf = Pdf(data)
    pages = pdf.pages()
    if pages:
        return [pdf.text(p) for p in pages]
    return [" ".join(filter(None, (shown(pdf.unpacked(v, s), {}) for v, s in pdf.objects.values() if isinstance(v, dict) and s is not None)))]


def _utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


# ---- HWP: compound files and zipped XML


def compound_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no compound file")
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<I", data, 44) + struct.unpack_from("<I", data, 48) + struct.unpack_from("<I", data, 56) + struct.unpack_from("<4I", data, 60)
    at = lambda i: data[(i + 1) * sector : (i + 2) * sector]
    heads = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_more):
        more = struct.unpack(f"<{sector // 4}I", at(first_more))
        heads += more[:-1]
        first_more = more[-1]
    fat: list[int] = []
    for i in heads[:n_fat]:
        fat += struct.unpack(f"<{sector // 4}I", at(i))

    def chain(start: int, table: list[int], read: Callable[[int], bytes]) -> bytes:
        out, seen = [], set()
        while start < 0xFFFFFFFA and start < len(table) and start not in seen:
            seen.add(start)
            out.append(read(start))
            start = table[start]
        return b"".join(out)

    directory = chain(first_dir, fat, at)
    entries = []
    for i in range(0, len(directory), 128):
        e = directory[i : i + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child, start, length = *struct.unpack_from("<3I", e, 68), struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]
        entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length))
    small = chain(entries[0][5], fat, at)
    raw_mini = chain(first_mini, fat, at)
    mini_fat = list(struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini))
    out: dict[str, bytes] = {}
    todo, seen = [(entries[0][4], "")], set()
    while todo:
        i, folder = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, folder), (right, folder)]
        if kind == 1:
            todo.append((child, f"{folder}{name}/"))
        elif kind == 2:
            whole = chain(start, fat, at) if length >= cutoff else chain(start, mini_fat, lambda k: small[k * mini : (k + 1) * mini])
            out[folder + name] = whole[:length]
    return out


def hwp_text(data: bytes) -> str:
    """A section that can't be unpacked is left out; without a header, sections are taken as packed."""
    streams = compound_streams(data)
    header = streams.get("FileHeader", b"")
    packed = len(header) <= 36 or bool(header[36] & 1)
    out = []
    for _, s in sorted((int(m[1]), s) for name, s in streams.items() if (m := re.fullmatch(r"BodyText/Section(\d+)", name))):
        try:
            out.append(section_text(zlib.decompress(s, -15) if packed else s))
        except (zlib.error, struct.error):
            continue
    return "\n".join(out)


#: The text record's tag, and the control codes of one unit; other controls take eight.
TEXT_TAG, LINE_CODES, SINGLE = 67, {10, 13}, {0, 10, 13, *range(24, 32)}


def section_text(data: bytes) -> str:
    out, at = [], 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        tag, length = head & 0x3FF, head >> 20
        if length == 0xFFF:
            length = struct.unpack_from("<I", data, at)[0]
            at += 4
        if tag == TEXT_TAG:
            out.append(record_text(data[at : at + length]))
        at += length
    return "\n".join(out)


def record_text(data: bytes) -> str:
    units, out, i = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2]), [], 0
    while i < len(units):
        code = units[i]
        if code >= 32:
            out.append(struct.pack("<H", code))
        elif code in LINE_CODES:
            out.append(b"\n\0")
        i += 1 if code >= 32 or code in SINGLE else 8
    return b"".join(out).decode("utf-16-le", "replace")


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def hwpx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
        return "\n".join(section_runs(z.read(n).decode("utf-8", "replace")) for _, n in names)


def section_runs(xml: str) -> str:
    runs = re.findall(r"<hp:t(?:\s[^>]*)?>(.*?)</hp:t>", xml, re.S)
    text = "".join(runs) if runs else re.sub(r"<[^>]+>", " ", xml)
    for name, c in ENTITIES:
        text = text.replace(name, c)
    return re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text).replace("&amp;", "&")


# ---- archives


def entry_name(raw: bytes, flags: int) -> str:
    """UTF-8 if flagged or valid, else CP949; composed."""
    text = raw.decode("utf-8", "replace") if flags & 0x800 or _utf8(raw) else raw.decode("cp949", "replace")
    return unicodedata.normalize("NFC", text)


def short_name(name: str, most: int = NAME_BYTES) -> str:
    """At most so many bytes, the extension kept and no character cut."""
    if len(name.encode()) <= most:
        return name
    stem, dot, tail = name.rpartition(".")
    stem, ext = (stem, dot + tail) if stem else (name, "")
    room = max(0, most - len(ext.encode()))
    return (stem.encode()[:room].decode("utf-8", "ignore") or "_") + ext


def safe_component(name: str) -> str:
    """No control characters, separators or blanks around; a name that leads elsewhere becomes an underscore."""
    name = re.sub(r"[/\\]", "_", re.sub(r"[\x00-\x1f\x7f-\x9f]", "", name)).strip()
    return short_name("_" if name in ("", ".", "..") else name)


def leaves_root(path: str, root: str = "/r") -> bool:
    whole = posixpath.normpath(posixpath.join(root, path.replace("\\", "/")))
    return whole != root and not whole.startswith(root + "/")


def _raw_name(info: zipfile.ZipInfo) -> bytes:
    return info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437")


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content, note) of every entry of the archives under path. An archive that can't be read, is beyond the caps or
    has an entry that leaves its root gives one row with a note and no path; an entry that can't be read is left out."""
    return unzip_contents(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def unzip_contents(archives: DataFrame) -> DataFrame:
    """The same for a table of path and content."""
    zips = archives.select("path", "content")

    def rows(batches):
        for b in batches:
            for archive, content in zip(b.path, b.content):
                for name, data, note in unpack(content):
                    yield pd.DataFrame([(archive, name, data, note)], columns=["archive", "path", "content", "note"])

    return zips.mapInPandas(rows, "archive string, path string, content binary, note string")


def unpack(content: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """Entries with their contents, one at a time, or a note alone."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name, info in planned(z):
                try:
                    data = z.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                    continue
                yield name, data, None
    except (zipfile.BadZipFile, ValueError, struct.error, OSError) as e:
        yield None, None, f"not readable: {e}"


def planned(z: zipfile.ZipFile) -> list[tuple[str, zipfile.ZipInfo]]:
    """The entries to read under safe names. Everything counts for the caps; folders and junk are then left out."""
    infos = z.infolist()
    if len(infos) > ENTRIES_MOST:
        raise ValueError("too many entries")
    if sum(i.file_size for i in infos) > BYTES_MOST:
        raise ValueError("too many bytes")
    out = []
    for info in infos:
        name = entry_name(_raw_name(info), info.flag_bits)
        if info.is_dir() or any(p in JUNK for p in name.split("/")):
            continue
        safe = "/".join(safe_component(p) for p in name.split("/") if p)
        if safe and leaves_root(safe):
            raise ValueError(f"unsafe entry {name}")
        if safe:
            out.append((safe, info))
    return out


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


# ---- metrics of accelerators


def csv_fields(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Column `line` of comma-separated values as trimmed, typed columns; lines of another length are left out."""
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    good = lines.select(parts.alias("p")).where(F.size("p") == len(fields))
    return good.select(*(F.get("p", i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())))


CARD = {"index": "int", "uuid": "string", "memory_used": "long", "memory_total": "long", "utilization": "int"}
PROCESS = {"uuid": "string", "pid": "int", "memory": "long"}
CLIMB = 5  # fixed value


def models_of(pids: DataFrame, processes: DataFrame, loaded: str = "ollama") -> DataFrame:
    """pids: pid. processes: pid, ppid, cmdline. The model each process serves: from its own command line or from that of a
    launcher among its parents, CLIMB lines at most; 'unknown' otherwise."""
    known = F.broadcast(processes.select(F.col("pid").alias("at"), "ppid", "cmdline"))  # one machine's processes
    line = F.coalesce("cmdline", F.lit(""))
    named = F.coalesce(F.nullif(F.regexp_extract(line, r"--served-model-name\s+(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract(line, r"serve\s+(\S+)", 1), F.lit("")), F.lit("vllm"))
    serves = F.when(line.rlike("vllm serve") | (line.contains(" serve ") & line.contains("vllm")), F.regexp_replace(F.regexp_replace(named, "/+$", ""), "^.*/", ""))
    own = F.when(line.contains("llama-server") | line.contains("ollama"), loaded)
    now = pids.select("pid", F.col("pid").alias("at"), F.lit(None).cast("string").alias("model"))
    for step in range(CLIMB):
        told = F.coalesce("model", *([own] if step == 0 else []), serves)
        now = now.join(known, "at", "left").select("pid", told.alias("model"), F.when(F.col("ppid") > 1, F.col("ppid")).alias("at"))
    return now.select("pid", F.coalesce("model", F.lit("unknown")).alias("model"))


def gpu_metrics(cards: DataFrame, processes: DataFrame, models: DataFrame) -> DataFrame:
    """cards: uuid, index, memory_used, memory_total, utilization. processes: uuid, pid, memory. models: pid, model.
    Prometheus lines, with '?' for an unknown card and 'other' for a process of no model."""
    def line(name: str, labels: dict[str, Column], value: Column) -> Column:
        inner = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in labels.items()))
        return F.concat(F.lit(f"{name}{{"), inner, F.lit("} "), value.cast("string"))

    per_card = [cards.select(line(f"gpu_{m}", {"gpu": F.col("index")}, F.col(m)).alias("line")) for m in ("memory_used", "memory_total", "utilization")]
    joined = processes.join(cards.select("uuid", "index"), "uuid", "left").join(models, "pid", "left")
    used = joined.groupBy(F.coalesce(F.col("index").cast("string"), F.lit("?")).alias("gpu"), F.coalesce("model", F.lit("other")).alias("model")).agg(F.sum("memory").alias("memory"))
    out = used.select(line("gpu_model_memory", {"gpu": F.col("gpu"), "model": F.col("model")}, F.col("memory")).alias("line"))
    for df in per_card:
        out = out.unionByName(df)
    return out


#: Fixed values.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "txt": "text/plain; charset=utf-8"}
UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def mime_type(filename: Column) -> Column:
    return F.coalesce(rules.lookup(MIME, F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))), F.lit("application/octet-stream"))


def file_headers(document_id: Column, filename: Column, filepath: Column, download: Column | None = None) -> Column:
    """Struct of content_type and content_disposition of a served file: shown if a browser can, else (or if asked) saved, under its
    own name if that is readable, in ASCII and in percent-encoded UTF-8."""
    kind = mime_type(filepath)
    ext = F.lower(F.regexp_extract(filepath, r"(\.[^./\\]+)$", 1))
    name = F.coalesce(rules.readable_name(names.nfc(filename)), F.concat(F.lit("document-"), F.substring(document_id, 1, 8), ext))
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7e]", "_"), r'["\\]', "_")
    encoded = F.url_encode(name)
    for old, new in UNESCAPED.items():
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    shown_ = kind.rlike("^(image/|text/)|^application/pdf$") & ~(F.lit(False) if download is None else F.coalesce(download, F.lit(False)))
    disposition = F.concat(F.when(shown_, "inline").otherwise("attachment"), F.lit('; filename="'), F.when(plain == "", F.concat(F.lit("document"), ext)).otherwise(plain), F.lit("\"; filename*=UTF-8''"), encoded)
    return F.struct(kind.alias("content_type"), disposition.alias("content_disposition"))
