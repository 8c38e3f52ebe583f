"""Column functions: timecodes, frame snapping, redaction, text clean-up, gains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def timecode(frames: Column, fps: int) -> Column:
    """HH:MM:SS:FF of a frame count."""
    s = F.floor(frames / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, frames % fps)


def srt_time(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def parsed_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm (or a dot); null if it isn't one."""
    pattern = r"^\s*(\d{1,3}):(\d{2}):(\d{2})[,.](\d{3})\s*$"
    part = [F.regexp_extract(text, pattern, i).cast("long") for i in range(1, 5)]
    return F.when(text.rlike(pattern), ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3])


def chapter_time(ms: Column) -> Column:
    """HH:MM:SS of a chapter, whole seconds, never negative."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def snapped_frames(ms: Column, fps: int) -> Column:
    """The nearest frame, halves up."""
    return F.floor(ms * fps / 1000 + 0.5)


#: Patterns of what must not leave the machine, in the order of their use, and their marks.
REDACTIONS = (
    (r"(?i)file://[^\s'\")]+", "[redacted-path]"),
    (r"(?i)blob:[^\s'\")]+", "[redacted-path]"),
    (r"(?:/[^\s'\")]+)+", "[redacted-path]"),
    (r"(?:[A-Za-z]:\\[^\s'\")]+(?:\\[^\s'\")]+)*)", "[redacted-path]"),
    (r"(?:[^\s'\"]+\\)+[^\s'\"]+", "[redacted-path]"),
    (r"([\"'`])([^\"'`]*(?:\.[A-Za-z0-9]{2,5})[^\"'`]*)\1", "$1[redacted-file]$1"),
    (r"(?i)\b[^\s/\\'\"]+\.(mp4|mov|webm|mkv|png|jpe?g|webp|gif|mp3|m4a|wav|ogg|srt|vtt|cube)\b", "[redacted-file]"),
    (r"(?i)\b[a-f0-9]{32,}\b", "[redacted-fingerprint]"),
)


def redacted(text: Column) -> Column:
    """URLs, paths, file names (quoted or bare) and long hex runs replaced by placeholders, in this order."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def normalised_text(text: Column) -> Column:
    """Lower case, punctuation out, white space collapsed."""
    text = F.regexp_replace(F.lower(text), "[.,!?;:\"'()]", "")
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def safe_file_name(name: Column) -> Column:
    """Unsafe characters as dashes, runs of them collapsed, none at the ends; ``export`` if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9 _.-]+", "-"), "-+", "-")
    name = F.regexp_replace(name, "^[-. ]+|[-. ]+$", "")
    return F.when(name == "", "export").otherwise(name)


def level_db(level: Column, floor: float = -60.0) -> Column:
    return F.when(level <= 0, floor).otherwise(F.greatest(F.lit(floor), 20 * F.log10(level)))


def equal_power(mix: Column) -> tuple[Column, Column]:
    """Gains of the outgoing and the incoming side at a mix of 0 to 1."""
    angle = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mix)) * F.lit(3.141592653589793 / 2)
    return F.cos(angle), F.sin(angle)


def _clamped_pan(pan: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(pan, F.lit(0.0))))


def balance_pan(pan: Column) -> tuple[Column, Column]:
    """Left and right gain of a stereo balance: the far side falls, the near side stays."""
    p = _clamped_pan(pan)
    return F.least(F.lit(1.0), 1 - p), F.least(F.lit(1.0), 1 + p)


def equal_power_pan(pan: Column) -> tuple[Column, Column]:
    angle = (_clamped_pan(pan) + 1) * F.lit(3.141592653589793 / 4)
    return F.cos(angle), F.sin(angle)


def fade_gain(at: Column, length: Column, fade_in: Column, fade_out: Column) -> Column:
    up = F.when(fade_in > 0, F.least(F.lit(1.0), at / fade_in)).otherwise(1.0)
    down = F.when(fade_out > 0, F.least(F.lit(1.0), (length - at) / fade_out)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(up, down))


def gram_ratio(text: Column, n: int = 4) -> Column:
    """Bytes over distinct runs of ``n`` bytes; 1 for texts under ``n``."""
    raw = text.cast("binary")
    size = F.octet_length(text)
    grams = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(raw, i, F.lit(n)))))
    return F.when(size < n, 1.0).otherwise(F.round(size / grams, 6))


#: Words of an error message (all of one tuple), and the code, severity and hint that they mean; the first match counts.
IMPORT_ERRORS = (
    ((("permission",), ("not allowed",)), "import.permission_denied", "error", "Grant file access permission and try again."),
    ((("abort",), ("cancel",)), "import.user_canceled", "info", "Re-import the file when ready."),
    ((("unsupported", "codec"),), "import.unsupported_codec", "error", "Transcode the file to H.264/VP9/AV1 and import again."),
    ((("unsupported",), ("not recognized",), ("unknown format",)), "import.unsupported_container", "error", "Convert to MP4, WebM, or MOV container and import again."),
    ((("corrupt",), ("invalid",), ("parse",), ("malformed",)), "import.corrupt_media", "error", "The file may be damaged. Try re-downloading or re-encoding it."),
    ((("read",), ("io error",), ("network",)), "import.read_error", "error", "Check the file is accessible and try again."),
)
EXPORT_ERRORS = (
    ((("device lost",), ("device_lost",)), "export.device_lost", "error", "GPU device was lost during export. Reload the app and retry."),
    ((("permission",), ("not allowed",)), "export.permission_lost", "error", "Output file permission was lost. Choose a new output location and retry."),
    ((("encode",),), "export.encode_failed", "error", "The encoder encountered an error. Try a different codec or lower resolution."),
    ((("decode",),), "export.decode_failed", "error", "A source could not be decoded during export. Check source health in diagnostics."),
    ((("mux",), ("container",)), "export.mux_failed", "error", "Container muxing failed. Try a different container format."),
    ((("write",), ("disk",), ("quota",)), "export.write_failed", "error", "Could not write the output file. Check disk space and permissions."),
)
UNKNOWN_ERRORS = {"import": ("import.unknown", "error", "Check the diagnostics panel for details and try again."), "export": ("export.unknown", "error", "Export failed. Settings are preserved for retry.")}


def error_class(text: Column, side: str = "import") -> Column:
    """``code, severity, hint`` of an import or export error message: the first class whose words occur in it."""
    low, made = F.lower(text), None
    told = lambda code, severity, hint: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(hint).alias("hint"))
    for words, *what in IMPORT_ERRORS if side == "import" else EXPORT_ERRORS:
        hit = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [low.contains(w) for w in every]) for every in words])
        made = F.when(hit, told(*what)) if made is None else made.when(hit, told(*what))
    return made.otherwise(told(*UNKNOWN_ERRORS[side]))


def fnv1a(text: Column, seed: int) -> Column:
    """32-bit FNV-1a of the code points of a text."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def stable_id(text: Column) -> Column:
    """16 hex digits from two seeds of FNV-1a (fixed values)."""
    return F.concat(*[F.lpad(F.lower(F.hex(fnv1a(text, seed))), 8, "0") for seed in (0x811C9DC5, 0x01000193)])


def parsed_timecode(text: Column, fps: int) -> Column:
    """The frame count of HH:MM:SS:FF; null if it isn't one or has a frame beyond the rate."""
    pattern = r"^(\d{1,3}):([0-5]\d):([0-5]\d):(\d{2})$"
    h, m, s, f = (F.regexp_extract(text, pattern, i).cast("long") for i in range(1, 5))
    return F.when(text.rlike(pattern) & (f < fps), ((h * 60 + m) * 60 + s) * fps + f)


def parsed_draft(text: Column) -> Column:
    """``titles`` (at most 3), ``hashtags`` (at most 5) and ``caption`` of a structured answer; missing parts are empty."""
    part = lambda head, stop: F.regexp_extract(text, rf"(?is){head}:\s*(.*?)(?={stop})", 1)
    titles = F.slice(F.filter(F.transform(F.split(part("TITLES", r"HASHTAGS:|\z"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), 1, 3)
    tags = F.slice(F.filter(F.split(part("HASHTAGS", r"CAPTION:|\z"), r"\s+"), lambda x: x.startswith("#")), 1, 5)
    return F.struct(titles.alias("titles"), tags.alias("hashtags"), F.regexp_replace(part("CAPTION", r"\z"), r"^\s+|\s+$", "").alias("caption"))


def duration_bucket(ms: Column) -> Column:
    """A coarse duration that gives nothing away."""
    return F.when(ms.isNull() | (ms < 0), "unknown").when(ms < 10_000, "<10s").when(ms < 60_000, "10s-1m").when(ms < 600_000, "1m-10m").when(ms < 3_600_000, "10m-1h").otherwise(">1h")


def expanded_template(template: Column, values: dict[str, Column]) -> Column:
    """A file-name template with each ``{name}`` replaced; null if it names anything else."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(~template.rlike(r"\{[A-Za-z]*\}"), template)


def canonical_json(df, column: str) -> Column:
    """JSON of a struct column with the fields of all structs sorted by name, as stable keys need it."""
    from pyspark.sql.types import ArrayType, StructType

    def sorted_(c: Column, kind) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*[sorted_(c[n], kind[n].dataType).alias(n) for n in sorted(kind.names)])
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: sorted_(x, kind.elementType))
        return c

    return F.to_json(sorted_(F.col(column), df.schema[column].dataType))
