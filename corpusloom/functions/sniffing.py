"""Text or binary, from the bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case extensions that mean binary without a look inside.
BINARY_EXTENSIONS = (
    # images
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "tiff", "webp", "svg",
    # video
    "mp4", "avi", "mov", "wmv", "flv", "webm", "mkv",
    # audio
    "mp3", "wav", "flac", "aac", "ogg", "wma",
    # archives
    "zip", "tar", "gz", "bz2", "xz", "7z", "rar",
    # executables
    "exe", "dll", "so", "dylib", "app",
    # documents
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    # fonts
    "ttf", "otf", "woff", "woff2",
    # other
    "bin", "dat", "db", "sqlite",
)

# Published file signatures (offset, bytes in hex) of formats that are not text.
SIGNATURES = (
    (0, "89504E47"),  # PNG
    (0, "47494638"),  # GIF
    (0, "FFD8FF"),  # JPEG
    (0, "424D"),  # BMP
    (0, "49492A00"),  # TIFF, little endian
    (0, "4D4D002A"),  # TIFF, big endian
    (8, "57454250"),  # WebP
    (0, "00000100"),  # ICO
    (0, "38425053"),  # PSD
    (4, "66747970"),  # MP4 family
    (0, "1A45DFA3"),  # Matroska, WebM
    (8, "41564920"),  # AVI
    (0, "000001BA"),  # MPEG program stream
    (0, "3026B2758E66CF11A6D9"),  # ASF, WMV, WMA
    (0, "464C5601"),  # FLV
    (0, "494433"),  # MP3 with a tag
    (0, "FFFB"),  # MP3 frame
    (0, "4F676753"),  # Ogg
    (0, "664C6143"),  # FLAC
    (8, "57415645"),  # WAV
    (0, "4D546864"),  # MIDI
    (0, "504B0304"),  # ZIP and office files
    (0, "504B0506"),  # empty ZIP
    (0, "504B0708"),  # spanned ZIP
    (257, "7573746172"),  # TAR
    (0, "526172211A07"),  # RAR
    (0, "1F8B08"),  # GZIP
    (0, "425A68"),  # BZIP2
    (0, "377ABCAF271C"),  # 7z
    (0, "FD377A585A00"),  # XZ
    (0, "28B52FFD"),  # Zstandard
    (0, "25504446"),  # PDF
    (0, "D0CF11E0A1B11AE1"),  # compound documents
    (0, "7B5C727466"),  # RTF
    (0, "53514C69746520666F726D6174203300"),  # SQLite
    (0, "7F454C46"),  # ELF
    (0, "4D5A"),  # DOS and Windows programs
    (0, "CAFEBABE"),  # Java class, fat Mach-O
    (0, "FEEDFACE"),  # Mach-O, 32 bit
    (0, "FEEDFACF"),  # Mach-O, 64 bit
    (0, "CFFAEDFE"),  # Mach-O, 64 bit, little endian
    (0, "0061736D"),  # WebAssembly
    (0, "213C617263683E"),  # static library
    (0, "774F4646"),  # WOFF
    (0, "774F4632"),  # WOFF2
    (0, "0001000000"),  # TrueType
    (0, "4F54544F00"),  # OpenType
    (0, "4D534346"),  # cabinet
    (0, "43723234"),  # browser extension
    (0, "EDABEEDB"),  # RPM
    (0, "4C5A4950"),  # LZIP
    (0, "2321414D52"),  # AMR sound, which begins like a script
    (8, "41494646"),  # AIFF
    (128, "4449434D"),  # DICOM
)

# The tags that HTML is told by, before a blank or a closing bracket, whatever their case.
HTML_STARTS = (
    "!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE", "A", "STYLE", "TITLE", "B",
    "BODY", "BR", "P",
)
# Beginnings of texts: such a tag or a comment, or an XML declaration (behind white space), or a script's first line.
_TEXT_KIND = r"^(?:[\t\n\x0C\r ]*<(?:(?i:%s)[ >]|!--|\?xml)|#!)" % "|".join(HTML_STARTS)

_SNIFFED_BYTES = 1024
_UTF8_MARK = "EFBBBF"

# One pattern over the first bytes in hex; the tar signature lies too deep for it.
_NEAR = 32
_SIGNED = "^(?:%s)" % "|".join("." * 2 * at + sig for at, sig in SIGNATURES if at < _NEAR)


def _hex(digits: str) -> Column:
    return F.lit(bytes.fromhex(digits))


def has_binary_extension(ext: Column) -> Column:
    names = F.split(F.lit(",".join(BINARY_EXTENSIONS)), ",")
    return F.array_contains(names, F.lower(ext))


def looks_binary(raw: Column | str) -> Column:
    """Known signature, or a NUL byte near the start of bytes that no mark or beginning tells to be text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    signed = F.rlike(F.hex(F.substring(raw, 1, _NEAR)), F.lit(_SIGNED))
    for at, sig in SIGNATURES:
        if at >= _NEAR:
            signed = signed | (F.substring(raw, at + 1, len(sig) // 2) == _hex(sig))
    nul = F.contains(F.substring(raw, 1, _SNIFFED_BYTES), _hex("00"))
    # The beginning is only looked at where there is a NUL.
    told = F.startswith(raw, _hex(_UTF8_MARK)) | F.rlike(F.decode(raw, "ISO-8859-1"), F.lit(_TEXT_KIND))
    return signed | (nul & ~told)


def is_utf8(raw: Column | str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.is_valid_utf8(raw.cast("string"))
