"""What a file is, by its leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Leading bytes (hex), with WebP needing a second part at byte 8.
PDF_SIGNATURE = "255044462D"
JPEG_SIGNATURE = "FFD8FF"
PNG_SIGNATURE = "89504E470D0A1A0A"
GIF_SIGNATURES = ("474946383761", "474946383961")
RIFF_SIGNATURE = "52494646"
WEBP_SIGNATURE = "57454250"
WEBP_OFFSET = 8


def bytes_at(content: Column, signature: str, offset: int = 0) -> Column:
    found = F.substring(content, offset + 1, len(signature) // 2)
    return F.coalesce(found == F.unhex(F.lit(signature)), F.lit(False))


def is_pdf(content: Column) -> Column:
    return bytes_at(content, PDF_SIGNATURE)


def image_type(content: Column) -> Column:
    """The media type an image's own bytes name, or null."""
    gif = bytes_at(content, GIF_SIGNATURES[0]) | bytes_at(content, GIF_SIGNATURES[1])
    webp = bytes_at(content, RIFF_SIGNATURE) & bytes_at(content, WEBP_SIGNATURE, WEBP_OFFSET)
    return (
        F.when(bytes_at(content, JPEG_SIGNATURE), "image/jpeg")
        .when(bytes_at(content, PNG_SIGNATURE), "image/png")
        .when(gif, "image/gif")
        .when(webp, "image/webp")
    )
