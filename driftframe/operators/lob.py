"""Large cells: content types, display, budgeted capture and profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic bytes in hex and their types, tried in this order; of zip files, parts whose names tell office files.
MAGIC = (("255044462D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("474946383761", "gif"), ("474946383961", "gif"), ("1F8B", "gz"), ("D0CF11E0A1B11AE1", "doc"), ("424D", "bmp"))
OFFICE = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))
CELLS, EACH_BYTES, TOTAL_BYTES = 50, 32_000_000, 64_000_000
#: Characters of a cell that are shown beside its object.
PREVIEW = 200


def is_text(c: str = "bytes") -> F.Column:
    """Valid UTF-8 without a NUL."""
    return F.is_valid_utf8(F.col(c).cast("string")) & ~F.contains(F.col(c), F.lit(bytearray(b"\0")))


def sniff(c: str = "bytes") -> F.Column:
    """Type by magic bytes, of zip files also by the names of their parts, else by the head of the text; JSON only if it parses."""
    head = F.hex(F.substring(c, 1, 12))
    out = F.when(F.col(c).isNull(), "bin")
    for magic, kind in MAGIC:
        # the two letters of a bitmap may begin a text
        out = out.when(head.startswith(magic) & (~is_text(c) if kind == "bmp" else F.lit(True)), kind)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    zipped = F.when(F.lit(False), "")
    for part, kind in OFFICE:
        zipped = zipped.when(F.contains(F.substring(c, 1, 1 << 20), F.lit(bytearray(part.encode()))) | F.contains(F.substring(c, -(1 << 18), 1 << 18), F.lit(bytearray(part.encode()))), kind)
    out = out.when(head.startswith("504B0304"), zipped.otherwise("zip")).when(~is_text(c), "bin")
    text = F.regexp_replace(F.substring(F.regexp_replace(F.col(c).cast("string"), "^\ufeff", ""), 1, 1024), r"^\s+", "")
    low = F.lower(text)
    out = out.when(low.startswith("<svg") | (low.startswith("<?xml") & low.contains("<svg")), "svg").when(low.startswith("<!doctype html") | low.startswith("<html"), "html").when(low.startswith("<"), "xml")
    parses = text.rlike(r"^[\[{]") & F.try_parse_json(F.when(text.rlike(r"^[\[{]"), F.concat(F.lit("["), F.col(c).cast("string"), F.lit("]")))).isNotNull()  # a list, so that nothing may follow
    return out.when(low.startswith("{\\rtf"), "rtf").when(parses, "json").otherwise("txt")


#: Fixed value: characters of a cell that are shown in its place.
MOST_SHOWN = 4_000


def inline_cell(c: str = "bytes") -> F.Column:
    """(shown, cut) of a cell: what ``display`` shows, its first MOST_SHOWN characters where it has more."""
    whole = display(c)
    return F.struct(F.substring(whole, 1, MOST_SHOWN).alias("shown"), (F.length(whole) > MOST_SHOWN).alias("cut"))


def display(c: str = "bytes", cap: int = 40) -> F.Column:
    """UTF-8 text as it is, else capped hex with the length."""
    n = F.octet_length(c)
    short = F.concat(F.hex(F.substring(c, 1, cap)), F.when(n > cap, F.concat(F.lit("… ("), n.cast("string"), F.lit(" bytes)"))).otherwise(""))
    return F.when(is_text(c), F.col(c).cast("string")).otherwise(short)


def capture(cells: DataFrame, cells_most: int = CELLS, each: int = EACH_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """(call_id, row_id, column_name, size, captured, reason) of the cells (call_id, row_id, column_name, bytes) of each call, in order.

    What is taken depends on what was: only places and lengths go through Python, the bytes don't.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_id", "column_name"])
        taken = used = 0
        out = []
        for size in frame["size"]:
            reason = "too many cells" if taken >= cells_most else "cell too large" if size > each else "total exceeded" if used + size > total else None
            if reason is None:
                taken, used = taken + 1, used + size
            out.append(reason)
        return frame.assign(captured=[r is None for r in out], reason=out)

    sizes = cells.select("call_id", "row_id", "column_name", F.octet_length("bytes").cast("long").alias("size"))
    return sizes.groupBy("call_id").applyInPandas(run, "call_id long, row_id long, column_name string, size long, captured boolean, reason string")


def profile(cells: DataFrame) -> DataFrame:
    """(column_name, mime, n, n_bytes, longest, n_over) of large cells; n_over counts those of over 4 000 bytes."""
    size = F.octet_length("bytes")
    return cells.groupBy("column_name", sniff().alias("mime")).agg(F.count("*").alias("n"), F.sum(size).alias("n_bytes"), F.max(size).alias("longest"), F.count_if(size > 4000).alias("n_over"))


def lob_objects(cells: DataFrame) -> DataFrame:
    """(label, ext, n_bytes, sha256, preview) of each cell as an object of its own."""
    return cells.select(F.concat_ws("-", F.lit("cells"), "column_name", F.concat(F.lit("row"), F.col("row_id"))).alias("label"), sniff().alias("ext"), F.octet_length("bytes").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"), F.substring(display(), 1, PREVIEW).alias("preview"))
