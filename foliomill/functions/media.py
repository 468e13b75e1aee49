"""Media types, integrity, policies, names and attribute lists, as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes and their media types, in order.
SIGNATURES = [
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"<svg ", "image/svg+xml"),
    (b"RIFF....WEBPVP8 ", "image/webp"),
    (b"\x00\x00\x01\x00", "image/x-icon"),
    (b"ID3", "audio/mpeg"),
    (b"\xff\x0e", "audio/mpeg"),
    (b"\xff\x0f", "audio/mpeg"),
    (b"OggS", "audio/ogg"),
    (b"RIFF....WAVEfmt ", "audio/wav"),
    (b"fLaC", "audio/x-flac"),
    (b"RIFF....AVI LIST", "video/avi"),
    (b"....ftyp", "video/mp4"),
    (b"\x00\x00\x01\x0b", "video/mpeg"),
    (b"....moov", "video/quicktime"),
    (b"\x1aE\xdf\xa3", "video/webm"),
]
# File name endings and their media types.
EXTENSIONS = {
    "css": "text/css",
    "js": "application/javascript",
    "json": "application/json",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "ico": "image/x-icon",
    "mp3": "audio/mpeg",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "flac": "audio/x-flac",
    "mp4": "video/mp4",
    "avi": "video/avi",
    "mov": "video/quicktime",
    "webm": "video/webm",
    "mpeg": "video/mpeg",
    "mpg": "video/mpeg",
}
# Plain text types that don't begin with text/.
PLAINTEXT = [
    "application/javascript",
    "application/json",
    "application/ld+json",
    "application/x-sh",
    "application/xhtml+xml",
    "application/xml",
    "application/vnd.mozilla.xul+xml",
    "image/svg+xml",
]
# Parts of addresses of advertisements and trackers.
AD_PATTERNS = [
    "doubleclick", "googleadservices", "googlesyndication",
    "amazon-adsystem", "facebook.com/tr", "google-analytics",
    "googletagmanager", "scorecardresearch", "quantserve",
    "outbrain", "taboola", "adsystem", "/ads/", "/ad/",
    "tracking", "analytics", "metrics", "telemetry",
    "pixel", "beacon", "adsense", "admob", "adnxs",
    "1x1",
]
# CSS properties whose values may be images.
IMAGE_PROPERTIES = [
    "background", "background-image", "border-image", "border-image-source", "content", "cursor",
    "list-style", "list-style-image", "mask", "mask-image",
    "additive-symbols", "negative", "pad", "prefix", "suffix", "symbols",
]
# Attributes that hold event handlers.
EVENT_ATTRIBUTES = [
    "onabort",
    "onauxclick",
    "onblur",
    "oncancel",
    "oncanplay",
    "oncanplaythrough",
    "onchange",
    "onclick",
    "onclose",
    "oncontextmenu",
    "oncuechange",
    "ondblclick",
    "ondrag",
    "ondragend",
    "ondragenter",
    "ondragexit",
    "ondragleave",
    "ondragover",
    "ondragstart",
    "ondrop",
    "ondurationchange",
    "onemptied",
    "onended",
    "onerror",
    "onfocus",
    "onformdata",
    "oninput",
    "oninvalid",
    "onkeydown",
    "onkeypress",
    "onkeyup",
    "onload",
    "onloadeddata",
    "onloadedmetadata",
    "onloadstart",
    "onmousedown",
    "onmouseenter",
    "onmouseleave",
    "onmousemove",
    "onmouseout",
    "onmouseover",
    "onmouseup",
    "onwheel",
    "onpause",
    "onplay",
    "onplaying",
    "onprogress",
    "onratechange",
    "onreset",
    "onresize",
    "onscroll",
    "onsecuritypolicyviolation",
    "onseeked",
    "onseeking",
    "onselect",
    "onslotchange",
    "onstalled",
    "onsubmit",
    "onsuspend",
    "ontimeupdate",
    "ontoggle",
    "onvolumechange",
    "onwaiting",
    "onwebkitanimationend",
    "onwebkitanimationiteration",
    "onwebkitanimationstart",
    "onwebkittransitionend",
    "onafterprint",
    "onbeforeprint",
    "onbeforeunload",
    "onhashchange",
    "onlanguagechange",
    "onmessage",
    "onmessageerror",
    "onoffline",
    "ononline",
    "onpagehide",
    "onpageshow",
    "onpopstate",
    "onrejectionhandled",
    "onstorage",
    "onunhandledrejection",
    "onunload",
    "oncut",
    "oncopy",
    "onpaste",
]


def media_type_of_name(name: Column) -> Column:
    ending = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)\z", 1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.lit("application/octet-stream"))


def media_type(data: Column, path: Column) -> Column:
    """By the leading bytes, or else by the ending of the path."""
    out = None
    for prefix, kind in SIGNATURES:
        test = F.startswith(data, F.unhex(F.lit(prefix.hex())))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(media_type_of_name(path))


def content_type(header: Column) -> Column:
    """media_type, charset and is_base64 of a Content-Type value; empty strings where absent."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    parts = F.transform(F.split(header, ";"), trim)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    charsets = F.filter(rest, lambda p: p.startswith("charset="))
    named = F.regexp_replace(F.substring(F.element_at(charsets, -1), 9, 1 << 20), r'^"+|"+\z', "")
    # The last charset wins, and "base64" may stand anywhere after the type.
    return F.struct(
        F.lower(parts[0]).alias("media_type"),
        F.when(F.size(charsets) > 0, named).otherwise("").alias("charset"),
        F.array_contains(rest, "base64").alias("is_base64"),
    )


def is_plaintext(kind: Column) -> Column:
    return kind.startswith("text/") | kind.isin(PLAINTEXT)


def integrity_holds(data: Column, integrity: Column) -> Column:
    """Whether a single sha256-, sha384- or sha512- value is the digest of the bytes; other prefixes never hold.

    The base64 form of SHA-512 is one line only while the session option
    spark.sql.chunkBase64String.enabled is off, as ``session.configure`` sets it.
    """
    out = None
    for bits in (256, 384, 512):
        prefix = f"sha{bits}-"
        same = F.concat(F.lit(prefix), F.base64(F.unhex(F.sha2(data, bits)))) == integrity
        out = F.when(integrity.startswith(prefix), same) if out is None else out.when(integrity.startswith(prefix), same)
    return out.otherwise(F.lit(False))


def data_url(kind: Column, charset: Column, data: Column, path: Column) -> Column:
    """A base64 data: URL; an empty type is detected, a blank or US-ASCII charset left out."""
    typed = F.when(kind == "", media_type(data, path)).otherwise(kind)
    blank = (F.trim(charset) == "") | (F.upper(F.trim(charset)) == "US-ASCII")
    return F.concat(F.lit("data:"), typed, F.when(blank, "").otherwise(F.concat(F.lit(";charset="), F.trim(charset))), F.lit(";base64,"), F.base64(data))


def content_security_policy(isolate: Column, no_css: Column, no_fonts: Column, no_frames: Column, no_js: Column, no_images: Column) -> Column:
    """The directives of the options that are set, in fixed order."""
    return F.concat_ws(
        " ",
        F.when(isolate, "default-src 'unsafe-eval' 'unsafe-inline' data:;"),
        F.when(no_css, "style-src 'none';"),
        F.when(no_fonts, "font-src 'none';"),
        F.when(no_frames, "frame-src 'none'; child-src 'none';"),
        F.when(no_js, "script-src 'none';"),
        F.when(no_images, "img-src data:;"),
    )


def output_path(template: Column, title: Column, is_mhtml: Column, at: Column | None = None) -> Column:
    """%timestamp%, %title%, %extension% and %ext% filled in; the title made fit for a file name."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH_mm_ss'Z'")
    name = F.coalesce(title, F.lit(""))
    for old, new in (("/", "_"), ("\\", "_"), ("<", "["), (">", "]"), (":", " - "), ('"', ""), ("|", "-"), ("?", "")):
        name = F.replace(name, F.lit(old), F.lit(new))
    name = F.regexp_replace(name, r"^\.+", "")
    fills = [("%timestamp%", stamp), ("%title%", name), ("%extension%", F.when(is_mhtml, "mhtml").otherwise("html")), ("%ext%", F.when(is_mhtml, "mht").otherwise("htm"))]
    return reduce(lambda out, fill: F.replace(out, F.lit(fill[0]), fill[1]), fills, template)


def link_types(rel: Column) -> Column:
    """The known meanings of a link's rel, in order."""
    known = {"alternate": "Alternate", "dns-prefetch": "DnsPrefetch", "preload": "Preload", "stylesheet": "Stylesheet", "icon": "Favicon", "apple-touch-icon": "AppleTouchIcon"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.filter(F.transform(F.split(F.lower(rel), r"(?U)\s+"), lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull())


def is_favicon(rel: Column) -> Column:
    return F.lower(rel).isin("icon", "shortcut icon")


def is_image_property(name: Column) -> Column:
    return F.lower(name).isin(IMAGE_PROPERTIES)


def is_event_attribute(name: Column) -> Column:
    return F.lower(name).isin(EVENT_ATTRIBUTES)


def is_ad_or_tracker(url: Column) -> Column:
    """One of the known parts occurs anywhere in the address, whatever its case."""
    quoted = "|".join(p.replace(".", r"\.") for p in AD_PATTERNS)
    return F.lower(url).rlike(quoted)


def include_resource(url: Column, size: Column, kind: Column, level: Column, max_image_kb: Column, max_css_kb: Column, exclude_ads: Column) -> Column:
    """Whether a fetched resource stays, by filtering level; a null level filters nothing.

    Minimal: advertisements if they are excluded.  Moderate: and images over
    500 KiB, style sheets over 100 KiB, or the given limits.  Aggressive:
    always advertisements, all scripts and fonts, and images over 200 KiB, style
    sheets over 50 KiB, or the given limits.  Custom: only the limits that are given.
    """
    ad, image, css = is_ad_or_tracker(url), kind.startswith("image/"), kind == "text/css"
    over = lambda limit, kb: F.coalesce(size > F.coalesce(limit, F.lit(kb)) * 1024, F.lit(False))
    too_large = lambda image_kb, css_kb: (image & over(max_image_kb, image_kb)) | (css & over(max_css_kb, css_kb))
    unwanted = exclude_ads & ad
    script_or_font = ~image & (kind.startswith("application/javascript") | (kind == "text/javascript") | kind.contains("font"))
    return (
        F.when(level.isNull(), True)
        .when(level == "Minimal", ~unwanted)
        .when(level == "Aggressive", ~(ad | too_large(200, 50) | script_or_font))
        .when(level == "Custom", ~(unwanted | too_large(None, None)))
        .otherwise(~(unwanted | too_large(500, 100)))
    )
