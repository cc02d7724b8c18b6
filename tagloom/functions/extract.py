"""Values inside text, URLs, JSON and HTML, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Seconds of a duration's units, and scores of video qualities.
UNITS = {"y": 31557600, "mo": 2629800, "w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
QUALITIES = {"4k": 2160, "2160": 2160, "1440": 1440, "1080": 1080, "720": 720, "480": 480, "360": 360}


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def iso_seconds(c: Column) -> Column:
    """Seconds of a duration as PT1H2M3S; null unless all of it is one."""
    ok = c.rlike(r"^PT(?=\d)(\d+H)?(\d+M)?(\d+S)?$")
    part = lambda u: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){u}", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")
    return F.when(ok, part("H") * 3600 + part("M") * 60 + part("S"))


def spoken_seconds(c: Column) -> Column:
    """Seconds of a duration as 1w2d3h, its units from long to short.

    What stands before a unit's first place is its number, what is between that and its second place is read on; a number
    that can't be read counts 0, and at a unit without anything before it reading ends. `now` is 0 in any case; null stays null.
    """
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(n).cast("long").alias("seconds")) for u, n in UNITS.items()])

    def read(acc: Column, u: Column) -> Column:
        head = F.split_part(acc["rest"], u["unit"], F.lit(1))
        number = F.when(head.rlike("^[+]?[0-9]+$"), F.regexp_replace(head, "[+]", "").try_cast("long"))
        after = F.struct(F.split_part(acc["rest"], u["unit"], F.lit(2)).alias("rest"), (acc["total"] + u["seconds"] * F.coalesce(number, F.lit(0))).alias("total"), F.lit(False).alias("over"))
        return F.when(acc["over"] | ~F.contains(acc["rest"], u["unit"]), acc).when(head == "", F.struct(acc["rest"].alias("rest"), acc["total"].alias("total"), F.lit(True).alias("over"))).otherwise(after)

    total = F.aggregate(units, F.struct(c.alias("rest"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("over")), read)["total"]
    return F.when(c.isNull(), F.lit(None).cast("long")).when(F.lower(c) == "now", F.lit(0).cast("long")).otherwise(total)


def last_path_number(url: Column) -> Column:
    """The last segment of a URL's path if it is a number."""
    return F.nullif(F.regexp_extract(url, r"/([0-9]+)/*$", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(?:[a-z]+://)?([^/?#]+)", 1), F.lit(""))


def url_segment(url: Column, i: int) -> Column:
    """The i-th segment of the path, from 1; null beyond the last."""
    return F.nullif(F.split_part(F.regexp_replace(url, r"^(?:[a-z]+://)?[^/]+/?|[?#].*$", ""), F.lit("/"), F.lit(i)), F.lit(""))


def url_query(url: Column) -> Column:
    """The query's parameters as a map; repeated keys keep the last value."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(q != "", F.map_from_entries(F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.split_part(x, F.lit("="), F.lit(2))))))


def absolute_url(base: str, href: Column) -> Column:
    """An address as it stands on a page of ``base``, made absolute."""
    scheme = base.split("://")[0]
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href)).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def quality_score(label: Column) -> Column:
    """The greatest quality a label names; 1 if it names none."""
    out = F.lit(1)
    for name, score in reversed(QUALITIES.items()):
        out = F.when(F.lower(label).contains(name), score).otherwise(out)
    return out


def base64_hex(c: Column) -> Column:
    """Base64 as lower-case hex; null if it can't be read."""
    return F.lower(F.hex(F.try_to_binary(c, F.lit("base64"))))


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds of a time with or without fraction and offset; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(c))


def html_links(c: Column) -> Column:
    """Targets of all links."""
    return F.regexp_extract_all(c, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def video_id(url: Column) -> Column:
    """The number behind /video/ in an address; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/video/([0-9]+)", 1), F.lit(""))


def script_constant(page: Column, name: str) -> Column:
    """The text that a page's script gives a constant; null if it gives none."""
    return F.nullif(F.regexp_extract(page, rf"""const\s+{name}\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def pushed_text(page: Column) -> Column:
    """The text that a page's script pushes for its frame, unescaped; null if there is none or it can't be read."""
    raw = F.nullif(F.regexp_extract(page, r"""__next_f\.push\(\[\s*\d+\s*,\s*"((?:[^"\\]|\\.)*)"\s*\]""", 1), F.lit(""))
    return F.from_json(F.concat(F.lit('{"t":"'), raw, F.lit('"}')), "t string")["t"]


def media_hash(page: Column) -> Column:
    """The 32 hex digits that name an encoded address's WebP file; null if there is none."""
    return F.nullif(F.regexp_extract(page, r"%2F([a-f0-9]{32})\.webp", 1), F.lit(""))


def slug(url: Column) -> Column:
    """The last part of an address's path that isn't empty."""
    return F.nullif(F.regexp_extract(url, r"/([^/?#]+)/*(?:[?#].*)?$", 1), F.lit(""))


def file_stem(url: Column) -> Column:
    """The last part of an address up to its first dot: a digest, where files are named so."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("."), F.lit(1))


def page_numbers(page: Column) -> Column:
    """The greatest page that a page's links lead to; 1 if they lead to none."""
    found = F.transform(F.regexp_extract_all(page, F.lit(r"[?&;]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.array_max(found), F.lit(1).cast("long")))


def html_title(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def json_ld(c: Column) -> Column:
    """The first script of JSON-LD in a page that can be read, as text."""
    found = F.regexp_extract_all(c, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.get(F.filter(found, lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def _read_html(html: str) -> str:
    from html.parser import HTMLParser

    out: list[str] = []

    class Reader(HTMLParser):
        quiet = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.quiet += 1
            if tag in ("p", "br", "div", "li", "tr"):
                out.append("\n")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.quiet = max(0, self.quiet - 1)
            if tag in ("p", "div", "li", "tr"):
                out.append("\n")

        def handle_data(self, data):
            if not self.quiet:
                out.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return "\n".join(x for x in (" ".join(x.split()) for x in "".join(out).split("\n")) if x)


_ELEMENT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("id", T.StringType()), T.StructField("href", T.StringType()), T.StructField("own_text", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("parent", T.IntegerType())])


def _read_elements(html: str) -> list[dict]:
    from html.parser import HTMLParser

    out: list[dict] = []
    alone = {"br", "img", "hr", "input", "meta", "link"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[int] = []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            out.append({"tag": tag, "classes": (a.get("class") or "").split(), "id": a.get("id"), "href": a.get("href"), "own_text": [], "text": [], "depth": len(self.open), "parent": self.open[-1] if self.open else -1})
            if tag not in alone:
                self.open.append(len(out) - 1)

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if out[self.open[k]]["tag"] == tag:
                    del self.open[k:]
                    break

        def handle_data(self, data):
            if self.open:
                out[self.open[-1]]["own_text"].append(data)
                if not any(out[i]["tag"] in ("script", "style") for i in self.open):
                    for i in self.open:
                        out[i]["text"].append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    for e in out:
        e["own_text"], e["text"] = "".join(e["own_text"]), "".join(e["text"])
    return out


@F.pandas_udf(T.ArrayType(_ELEMENT))
def html_elements(s: pd.Series) -> pd.Series:
    """All elements of a page in order: (tag, classes, id, href, own_text, text, depth, parent), parent the place of the one around, else -1."""
    return s.map(_read_elements, na_action="ignore")


def tags_by_class(elements: Column, namespaces: dict[str, str]) -> Column:
    """(ns, name) of the links whose class stands for a namespace; empty ones are left out."""
    hit = lambda css, ns: F.transform(F.filter(elements, lambda e: (e["tag"] == "a") & F.array_contains(e["classes"], css) & (F.trim(e["text"]) != "")), lambda e: F.struct(F.lit(ns).alias("ns"), F.trim(e["text"]).alias("name")))
    return F.concat(*[hit(css, ns) for css, ns in namespaces.items()])


def children_of_first(elements: Column, tag: str, css: str) -> Column:
    """The elements right inside the first ``tag`` with a class: a list's rows."""
    at = F.array_position(F.transform(elements, lambda e: (e["tag"] == tag) & F.array_contains(e["classes"], css)), F.lit(True)) - 1
    return F.when(at >= 0, F.filter(elements, lambda e: e["parent"] == at.cast("int")))


def chapters(elements: Column) -> Column:
    """(url, title, paid) of a list of chapters: links of class `chapter` around a title, paid where a cost is shown inside."""
    indexed = F.transform(elements, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    links = F.filter(indexed, lambda x: (x["e"]["tag"] == "a") & F.array_contains(x["e"]["classes"], "chapter") & x["e"]["href"].isNotNull())

    def one(x: Column) -> Column:
        end = F.coalesce(F.array_min(F.transform(F.filter(indexed, lambda y: (y["i"] > x["i"]) & (y["e"]["depth"] <= x["e"]["depth"])), lambda y: y["i"])), F.size(elements))
        inside = F.filter(indexed, lambda y: (y["i"] > x["i"]) & (y["i"] < end))
        title = F.get(F.filter(inside, lambda y: (y["e"]["tag"] == "div") & F.array_contains(y["e"]["classes"], "title")), F.lit(0))["e"]["text"]
        return F.struct(x["e"]["href"].alias("url"), collapsed(title).alias("title"), F.exists(inside, lambda y: F.array_contains(y["e"]["classes"], "cost")).alias("paid"))

    return F.filter(F.transform(links, one), lambda x: x["title"].isNotNull())


def body_lines(elements: Column, watermark: str, skip: tuple[str, ...] = ("advertisment",)) -> Column:
    """The text of all `div`s that aren't advertisements, each on a line, without watermarks; empty ones are left out."""
    bad = F.lit(False)
    divs = F.filter(elements, lambda e: (e["tag"] == "div") & ~F.exists(e["classes"], lambda k: F.array_contains(F.array(*map(F.lit, skip)), k)) & ~F.coalesce(e["id"].rlike("bg-ssp|yandex_rtb"), bad))
    lines = F.transform(divs, lambda e: F.trim(without_watermark(F.trim(F.regexp_replace(e["own_text"], r"^\s+|\s+$", "")), watermark)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_watermark(text: Column, watermark: str) -> Column:
    """A text without a watermark, whatever its case."""
    return F.regexp_replace(text, f"(?i){watermark}", "")


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of a page: blocks on lines of their own, scripts and styles left out; null stays null."""
    return s.map(_read_html, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def braced_csv(s: pd.Series) -> pd.Series:
    """Fields of {a,"b,c","d""e"}; null if the braces are missing."""
    import csv

    def read(x: str):
        if not (x.startswith("{") and x.endswith("}")):
            return None
        return next(csv.reader([x[1:-1]]), []) if len(x) > 2 else []

    return s.map(read, na_action="ignore")


def paired(c: Column) -> Column:
    """Neighbours of an array two by two, as (first, second); an odd last one has a null second."""
    n = F.size(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.struct(F.get(c, i * 2).alias("first"), F.get(c, i * 2 + 1).alias("second")))).otherwise(F.array().cast("array<struct<first:string,second:string>>"))


def joined_query(base: str, tags: Column, page: Column) -> Column:
    """A search address: tags joined by +, and the page."""
    return F.concat(F.lit(base + "?tags="), F.array_join(tags, "+"), F.lit("&page="), page.cast("string"))


def error_kind(message: Column) -> Column:
    """quota, blocked or other, by what a message says."""
    low = F.lower(message)
    return F.when(low.contains("quota") | low.contains("over limit"), "quota").when(low.contains("blocked") | low.contains("denied"), "blocked").otherwise("other")


def params(text: Column) -> Column:
    """Words of a job's parameter as (kind, value): addresses are `Url`, all else `Normal`."""
    words = F.filter(F.split(text, " "), lambda x: x != "")
    return F.transform(words, lambda x: F.struct(F.when(x.rlike("^https?://[^/]+"), "Url").otherwise("Normal").alias("kind"), x.alias("value")))
