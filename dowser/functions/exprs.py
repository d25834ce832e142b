"""Column expressions of the engine: paths, categories, sizes, text, intent and distance. No Python UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dowser import schemas as S

# Extensions by category, as the index knows them.
DOCUMENT_EXTS = "docx xlsx xls xlsm xlsb xla xlam ods odp odt pdf pptx txt log md mdx ini".split()
IMAGE_EXTS = "jpg jpeg png gif webp".split()
AUDIO_EXTS = "mp3 wav aac flac ogg m4a wma amr".split()
VIDEO_EXTS = "mp4 avi mov mkv".split()
# Media types by extension; everything else is application/octet-stream.
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "mp3": "audio/mpeg",
              "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac"}
# Attribute bits and their names.
ATTRIBUTES = {0x1: "Read only", 0x2: "Hidden", 0x4: "System", 0x10: "Directory", 0x20: "Archive", 0x40: "Normal", 0x80: "Temporary",
              0x800: "Compressed", 0x100: "Offline", 0x4000: "Encrypted", 0x400: "Reparse Point", 0x200: "Sparse File"}
# Words that make a query hybrid.
HYBRID_WORDS = "about related that which where notes document".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- paths --------------------------------------------------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    """The last segment; both separators part segments, trailing ones don't count."""
    return F.regexp_extract(_col(path), r"([^/\\]*)[/\\]*$", 1)


def file_ext(path: Column | str) -> Column:
    """The lower-cased extension; '' for dot-files and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def path_kind(path: Column | str) -> Column:
    """'file' or 'directory', guessed from the spelling."""
    p = F.regexp_replace(_col(path), r"\\", "/")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return (F.when(p.endswith("/") | (p == ""), "directory").when(F.regexp_extract(name, r"^.+\.([^.]+)$", 1) != "", "file")
            .when(name.startswith(".") & (F.length(name) > 1) & (name != ".."), "file").otherwise("directory"))


def ensure_separator(path: Column | str, separator: str = "/") -> Column:
    p = _col(path)
    return F.when(p.endswith(separator), p).otherwise(F.concat(p, F.lit(separator)))


def ancestors(path: Column | str) -> Column:
    """Every directory above the path, without its separator, the shortest first; either separator counts."""
    p = _col(path)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.substring(p, i, F.lit(1)).isin("/", "\\"))
    return F.transform(places, lambda i: F.substring(p, F.lit(1), i - 1))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), UPPER, LOWER)


def like_prefix(path: Column | str, prefix: str) -> Column:
    """path LIKE prefix% with ASCII case folded; % and _ of the prefix are wildcards, a backslash is none."""
    return ascii_lower(path).like(prefix.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def under_directory(path: Column | str, directory: str, separator: str = "/") -> Column:
    return like_prefix(path, directory if directory.endswith(separator) else directory + separator)


def valid_file(path: Column | str, ignore_exts: Sequence[str] = (), ignore_files: Sequence[str] = ()) -> Column:
    """Has an extension that is not ignored, is not itself ignored, and does not begin with a dot."""
    ext = file_ext(path)
    out = (ext != "") & ~file_name(path).startswith(".")
    if ignore_exts:
        out = out & ~ext.isin(*ignore_exts)
    return out & ~_col(path).isin(*ignore_files) if ignore_files else out


def in_ignored_directory(path: Column | str, root: str, ignore_dirs: Sequence[str] = ()) -> Column:
    """Whether a directory between the root, which is not tested itself, and the file is hidden or ignored."""
    segments = F.split(F.substring(_col(path), len(root) + 1, 1 << 20), r"[/\\]")
    between = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.exists(between, lambda s: s.startswith(".") | (s.isin(*ignore_dirs) if ignore_dirs else F.lit(False)))


# --- categories, sizes, media types -------------------------------------------------------------------------------


def category(ext: Column | str) -> Column:
    e = _col(ext)
    return (F.when(e.isin(*DOCUMENT_EXTS), S.DOCUMENT).when(e.isin(*IMAGE_EXTS), S.IMAGE).when(e.isin(*AUDIO_EXTS), S.AUDIO)
            .when(e.isin(*VIDEO_EXTS), S.VIDEO).otherwise(S.OTHER))


def category_name(code: Column | str) -> Column:
    return reduce(lambda a, kv: a.when(_col(code) == kv[0], kv[1]), S.CATEGORIES.items(), F.when(F.lit(False), "")).otherwise("other")


def category_code(name: Column | str) -> Column:
    return reduce(lambda a, kv: a.when(_col(name) == kv[1], kv[0]), S.CATEGORIES.items(), F.when(F.lit(False), 0)).otherwise(S.OTHER)


def status_name(code: Column | str) -> Column:
    return reduce(lambda a, kv: a.when(_col(code) == kv[0], kv[1]), S.STATUSES.items(), F.when(F.lit(False), "")).otherwise("waiting")


def task_status(text: Column | str) -> Column:
    known = ("pending", "running", "paused", "completed", "failed", "cancelled")
    return F.when(_col(text).isin(*known), _col(text)).otherwise("pending")


def mime_type(ext: Column | str) -> Column:
    e = F.lower(_col(ext))
    return reduce(lambda a, kv: a.when(e == kv[0], kv[1]), MIME_TYPES.items(), F.when(F.lit(False), "")).otherwise("application/octet-stream")


def human_size(size: Column | str) -> Column:
    n = _col(size)
    out = F.when(F.lit(False), "")
    for unit, letter in ((1 << 30, "G"), (1 << 20, "M"), (1 << 10, "K")):
        out = out.when(n > unit, F.concat(F.floor(n / unit).cast("string"), F.lit(letter)))
    return out.otherwise(F.concat(n.cast("string"), F.lit("B")))


def attribute_names(bits: Column | str) -> Column:
    named = [F.when(_col(bits).bitwiseAND(bit) != 0, F.lit(name)) for bit, name in ATTRIBUTES.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def data_uri(content: Column | str, ext: Column | str) -> Column:
    return F.concat(F.lit("data:"), mime_type(ext), F.lit(";base64,"), F.regexp_replace(F.base64(_col(content)), r"\r\n", ""))


def page_count(total: Column | str, size: int) -> Column:
    return F.ceil(_col(total) / size)


# --- text ---------------------------------------------------------------------------------------------------------


def collapse_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[\r\n]+", "\n")


def kept_content(content: Column | str, category_: Column | str, keep: Column | str) -> Column:
    """The text where the category's parsed content is to be kept, else ''. keep: a struct of booleans by name."""
    k, c = _col(keep), _col(category_)
    wanted = (F.when(c == S.DOCUMENT, k["document"]).when(c == S.IMAGE, k["image"]).when(c == S.AUDIO, k["audio"]).when(c == S.VIDEO, k["video"]).otherwise(F.lit(False)))
    return F.when(F.coalesce(wanted, F.lit(False)), F.coalesce(_col(content), F.lit(""))).otherwise("")


def parse_metadata(text: Column | str) -> Column:
    """The metadata struct; malformed or null JSON gives its defaults, and so do missing fields."""
    m = F.from_json(_col(text), S.METADATA, {"mode": "PERMISSIVE"})
    return F.struct(*(F.coalesce(m[f.name], F.lit(0).cast(f.dataType) if f.dataType == S._L else F.lit("")).alias(f.name) for f in S.METADATA))


def metadata_text(m: Column | str) -> Column:
    """One sentence of a metadata struct."""
    c = _col(m)
    parts = (("file name:", c["name"]), (",file extension:", c["extension"]), (",file category:", c["category"]), (",size:", c["size"].cast("string")),
             (" bytes,creation time:", c["created"]), (",last write time:", c["modified"]), (",author:", c["author"]))
    return F.concat(*(x for label, value in parts for x in (F.lit(label), F.coalesce(value, F.lit("")))), F.lit(",file attributes:"))


def search_intent(query: Column | str) -> Column:
    """'path', 'hybrid' or 'semantic'. The order of the tests matters; the length is in bytes, without white space at
    the ends."""
    q = F.regexp_replace(_col(query), r"(?U)^\s+|\s+\z", "")
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    hybrid = reduce(lambda a, w: a | q.contains(w), HYBRID_WORDS, F.lit(False))
    return (F.when(q.rlike(r"[\\/*.]"), "path").when(words <= 2, "path").when(hybrid, "hybrid").when(F.octet_length(q) > 20, "semantic").otherwise("hybrid"))


def highlight(text: Column | str, keywords: Sequence[str]) -> Column:
    return reduce(lambda t, k: F.regexp_replace(t, f"(?i)({_quoted(k)})", "<b>$1</b>"), keywords, _col(text))


def _quoted(keyword: str) -> str:
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_keyword(keywords: Sequence[str]) -> str:
    """A pattern that finds the leftmost, then longest, of the keywords, ASCII case ignored."""
    seen: dict[str, str] = {}
    for k in keywords:
        seen.setdefault(k.translate(str.maketrans(UPPER, LOWER)), k)
    return "(?i)(" + "|".join(_quoted(k) for k in sorted(seen, key=lambda k: (-len(k), k))) + ")"


# --- vectors ------------------------------------------------------------------------------------------------------


def cosine_distance(vector: Column | str, query: Sequence[float]) -> Column:
    """1 - cosine to a fixed vector, rounded to 6 places so that ties are ties; null for a vector of another length, an
    all-zero one or one with nulls. Unrolled, so that it stays within generated code."""
    v, q = _col(vector), [float(x) for x in query]
    size = sum(x * x for x in q) ** 0.5
    if len(q) <= 128:
        parts = [F.get(v, F.lit(i)).cast("double") for i in range(len(q))]
        dot = reduce(lambda a, b: a + b, (p * F.lit(x) for p, x in zip(parts, q, strict=True)))
        square = reduce(lambda a, b: a + b, (p * p for p in parts))
    else:
        literal = F.array(*map(F.lit, q))
        dot = F.aggregate(F.zip_with(v, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
        square = F.aggregate(v, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    return F.when((F.size(v) == len(q)) & (square > 0) & F.lit(size > 0), F.round(1 - F.try_divide(dot, F.sqrt(square) * F.lit(size)), 6))


# --- media, dates, secrets ----------------------------------------------------------------------------------------

# The first bytes (hexadecimal) of media files, with what follows at byte 8 where the first are shared.
MAGIC = (("89504E470D0A1A0A", "", "png"), ("FFD8FF", "", "jpg"), ("47494638", "", "gif"), ("52494646", "57454250", "webp"), ("52494646", "57415645", "wav"),
         ("494433", "", "mp3"), ("FFFB", "", "mp3"), ("664C6143", "", "flac"), ("4F676753", "", "ogg"), ("FFF1", "", "aac"), ("FFF9", "", "aac"), ("2321414D52", "", "amr"))


def media_kind(content: Column | str) -> Column:
    """The extension that a file's first bytes tell, or null."""
    head = F.hex(F.substring(_col(content), 1, 16))
    out = F.when(F.substring(head, 9, 8) == "66747970", F.when(F.substring(head, 17, 6) == "4D3441", "m4a").otherwise("mp4"))
    for first, ninth, kind in MAGIC:
        hit = head.startswith(first)
        out = out.when(hit & (F.substring(head, 17, 8) == ninth) if ninth else hit, kind)
    return out


def media_uri(content: Column | str, exts: Sequence[str]) -> Column:
    """A data URI of media whose first bytes are of one of the kinds; null of anything else."""
    kind = media_kind(content)
    return F.when(kind.isin(*exts), data_uri(content, kind))


SECONDS, FRACTIONS = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS"


def parse_time(text: Column | str, pattern: str = SECONDS) -> Column:
    """'' is the epoch; what does not parse is null."""
    return F.when(_col(text) == "", F.lit("1970-01-01").cast("timestamp_ntz")).otherwise(F.try_to_timestamp(_col(text), F.lit(pattern)).cast("timestamp_ntz"))


def format_time(time: Column | str, pattern: str = SECONDS) -> Column:
    return F.date_format(_col(time), pattern)


def encrypt(text: Column | str, key: str, iv: str) -> Column:
    """AES-128 in CBC mode with PKCS padding; 16 bytes of key and of vector. The vector is not part of the result."""
    return F.substring(F.aes_encrypt(_col(text).cast("binary"), F.lit(key).cast("binary"), F.lit("CBC"), F.lit("PKCS"), F.lit(iv).cast("binary")), 17, 1 << 30)


def decrypt(data: Column | str, key: str, iv: str) -> Column:
    return F.aes_decrypt(F.concat(F.lit(iv).cast("binary"), _col(data)), F.lit(key).cast("binary"), F.lit("CBC"), F.lit("PKCS")).cast("string")
