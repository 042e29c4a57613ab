"""Web pages and addresses: tables, links, public addresses, secrets in addresses, content addresses."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that hold secrets, path parts of login pages, and file endings by content type.
SECRET_PARAMETERS = "api[-_]?key|key|token|access_token"
PRIVATE_PARTS = "captcha|j_security_check|/login|/signin|/sign-in|/logon|/auth/|sso"
ENDINGS = {
    "application/pdf": "pdf", "text/html": "html", "application/xhtml+xml": "html", "text/csv": "csv", "text/plain": "txt", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "application/rss+xml": "xml", "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/zip": "zip",
}


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell = 0, [], None
        self.found: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(self.tables)
            self.tables += 1
        elif tag == "tr":
            self._end_cell()
            self.found.append((self.open[-1] if self.open else -1, []))
        elif tag in ("td", "th") and self.found:
            self._end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self):
        if self.cell is not None:
            self.found[-1][1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table_no, row_no and cells of every table row of pages(key, html); a null page has none."""

    def scan(batches):
        for batch in batches:
            out = []
            for page, html in zip(batch[key], batch["html"]):
                parser = _Rows()
                parser.feed(html or "")
                parser._end_cell()
                for k, (table, cells) in enumerate((t, c) for t, c in parser.found if t >= 0 and c):
                    out.append((page, table, k, cells))
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, "html").mapInPandas(scan, f"{key} {pages.schema[key].dataType.simpleString()}, table_no int, row_no int, cells array<string>")


def table_with(rows: DataFrame, words: list[str], key: str = "page_id") -> DataFrame:
    """Rows below the header of each page's first table that has a row with all the words."""
    text = F.lower(F.array_join("cells", " "))
    heads = rows.where(F.forall(F.array(*[F.lit(w.lower()) for w in words]), lambda w: text.contains(w)))
    first = heads.groupBy(key).agg(F.min(F.struct("table_no", "row_no")).alias("h")).select(F.col(key).alias("__key"), "h")
    return rows.join(first, (F.col(key) == F.col("__key")) & (F.col("table_no") == F.col("h.table_no")) & (F.col("row_no") > F.col("h.row_no"))).drop("__key", "h")


# The commonest character entities, the ampersand's last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def plain(html: Column) -> Column:
    """The text of a piece of HTML, without tags, its commonest entities as characters and its spaces single."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    """Addresses that a page links to, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), 1)


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, rf"(?i)([?&](?:{SECRET_PARAMETERS})=)[^&#]*", "$1REDACTED")


def is_public(url: Column) -> Column:
    """http or https, a host with a dot, no credentials, no login part."""
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    return url.rlike("^https?://") & host.contains(".") & ~host.contains("@") & ~url.rlike(rf"(?i){PRIVATE_PARTS}")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def ending(content_type: Column, url: Column) -> Column:
    """The file ending by content type, else that of the address, else bin."""
    kinds = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    tail = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.trim(F.substring_index(content_type, ";", 1)))), F.when(tail != "", tail), F.lit("bin"))


def content_key(source: Column, content: Column, day: Column, suffix: Column) -> Column:
    """raw/source/yyyy/mm/sha256.suffix; NULL for empty content."""
    return F.when(F.length(content) > 0, F.concat(F.lit("raw/"), source, F.date_format(day, "/yyyy/MM/"), F.sha2(content.cast("binary"), 256), F.lit("."), suffix))
