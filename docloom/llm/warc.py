"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each response yields one `metadata` and one `conversion` record, both linked by WARC-Refers-To and
the target URI to their response and keeping the source's HTTP status and content type, its payload
digest and their own block digest (SHA-1, Base32). Record ids are name-based, so reruns agree.
Expressions only; one pass, no shuffle. `write_warc` writes records as WARC files.

Defined results: a null or empty page body gives records with an empty text; a null URL leaves the
target URI null; broken markup is taken as it stands (an unclosed tag hides text up to the next '>');
repeated rows give the same record ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, whole

DATE = "2024-01-01T00:00:00Z"
STATUS = "HTTP/1.1 200 OK"
CONTENT_TYPE = "text/html; charset=utf-8"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Frequent named characters; they are looked up before ALL_ENTITIES. Names that neither has stay as written.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "euro": "€"}
ALL_ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def sha1_base32(block: Column) -> Column:
    """'sha1:' and the Base32 digest of a text's UTF-8 bytes."""
    return F.concat(F.lit("sha1:"), _once(F.sha1(F.encode(block, "UTF-8")), _base32))


def _base32(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    digit = lambda i: F.conv(F.substring(digest, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
    letter = lambda i: F.substring(F.lit(BASE32), (F.floor(digit(i) / F.element_at(F.array(*[F.lit(x) for x in (32768, 1024, 32, 1)]), (i % 4 + 1).cast("int"))) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once."""
    return _once(text, _decoded)


def _decoded(text: Column) -> Column:
    # written as text and parsed, so that the plan holds two literals and not some thousands
    known = lambda entities: F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entities.items())), F.lit("\x01"), F.lit("\x02"))
    frequent, every = known(ENTITIES), known(ALL_ENTITIES)

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.length(name))).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(name == "", F.concat(F.lit("&"), part)).when(name.startswith("#"), F.when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))).otherwise(
            F.coalesce(F.concat(F.coalesce(F.try_element_at(frequent, name), F.try_element_at(every, name)), rest), F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), "")))


def plain_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles or tags; block tags break lines; blanks collapsed."""
    for pattern, by in (
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<script\b.*?</script\s*>", ""),
        (r"(?is)<style\b.*?</style\s*>", ""),
        (r"[\s]+", " "),
        (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"),
        (r"<[a-zA-Z/!?][^>]*>", ""),
    ):
        html = F.regexp_replace(html, pattern, by)
    text = decode_entities(html)
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    html = whole(F.col("html"))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.md5(html)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit(STATUS).alias("http_status"),
        F.lit(CONTENT_TYPE).alias("http_content_type"),
        html.alias("payload"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records, two rows a response."""
    title = F.btrim(decode_entities(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)))
    language = F.regexp_extract("payload", r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1)
    d = source.withColumns({"source_digest": sha1_base32(F.col("payload")), "text": plain_text(F.col("payload"))})
    fields = F.concat(
        F.lit("title: "), title, F.lit(f"{CRLF}language: "), language, F.lit(f"{CRLF}payload-length: "), F.octet_length("payload").cast("string"),
        F.lit(f"{CRLF}text-length: "), F.octet_length("text").cast("string"), F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    return d.withColumn("x", F.explode(kinds)).select(
        "page_id", "x.record_type", record_id(F.col("x.record_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        "x.content_type", "http_status", "http_content_type", "source_digest", sha1_base32(F.col("x.block")).alias("block_digest"), F.octet_length("x.block").cast("long").alias("content_length"), "x.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """One column, value: each record's WARC headers and block."""
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit(""))
    return records.select(
        F.concat(
            F.lit("WARC/1.1"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Date", F.col("warc_date")),
            header("WARC-Refers-To", F.col("refers_to")), header("WARC-Refers-To-Target-URI", F.col("target_uri")), header("WARC-Target-URI", F.col("target_uri")),
            header("X-Source-HTTP-Status", F.col("http_status")), header("X-Source-Content-Type", F.col("http_content_type")), header("X-Source-Payload-Digest", F.col("source_digest")),
            header("WARC-Block-Digest", F.col("block_digest")), header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")),
            F.lit(CRLF * 2), F.col("block"),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each partition; every record ends in two line breaks, as the format asks."""
    serialised(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
